"""Every query against its SQL on the smallest tables; the entry point without the llm folder; the command line; a stream."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from prosegauge import cli
from prosegauge.queries import ORACLE_SQL, QUERIES
from prosegauge.streaming import documents as streaming

DATA = "/root/testdata/sf0.001"
#: Queries that have features of whole documents, long sentences included.
LONG = ["connector_density", "enumeration_meta_counts", "lexical_diversity", "passive_ratio", "punctuation_density", "sentence_length_stats", "uniform_groups"]


def rows(df: pd.DataFrame) -> list[tuple]:
    one = lambda x: "null" if x is None or x is pd.NA or x != x else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def long_documents(spark, tmp_path_factory):
    """Documents with a sentence of over 46,340 characters, whose square is beyond an integer."""
    path = tmp_path_factory.mktemp("long")
    docs = [(1, "word, " * 10_000), (2, "受到首先，" * 10_000 + "。完")]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", LONG)
def test_long_sentences(spark, long_documents, name):
    got = QUERIES[name](spark, str(long_documents)).toPandas()
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{long_documents}/documents.parquet/*.parquet'")
        assert rows(got) == rows(c.sql(ORACLE_SQL[name]).df())


def test_full_reports_of_long_sentences(spark, long_documents):
    found = {r.doc_id: json.loads(r.json) for r in QUERIES["full_reports"](spark, str(long_documents)).collect()}
    assert set(found) == {1, 2} and found[1]["basic_info"]["total_chars"] > 60_000 and found[1]["statistics"]["sentence_length_cv"] > 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_entry_without_the_llm_folder(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "prosegauge", tmp_path / "prosegauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    out = run()
    assert set(out.stdout.split()) == set(QUERIES), out.stderr
    # something else that is missing isn't taken for that
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    assert "a_module_that_is_not_there" in run().stderr


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "a.md"
    path.write_text("真正重要的不是速度，而是你是否能长期坚持。\n\n普通的一段话。", encoding="utf-8")
    cli.main(["--input", str(path), "--format", "json", "--profile", "deep", "--rewrite"])
    out = json.loads(capsys.readouterr().out)
    assert out["runtime"]["enabled_detectors"] == ["rule", "author_fit", "stat", "seekdb", "probability"] and out["paragraphs"][0]["signals"] and out["rewritten_text"].startswith("更要紧")
    assert out["suspected_segments"] == out["paragraphs"]
    cli.main(["--input", str(path), "--profile", "fast"])
    lines = capsys.readouterr().out.split("\n")
    assert lines[0] == "[runtime] profile=fast enabled=rule, author_fit, stat" and lines[1] == "" and lines[2].startswith("[paragraph 0] score=")
    assert any(x.startswith("  - zh.arg.not_x_but_y (rule, severity=") for x in lines) and any(x.startswith("    dimensions: ") for x in lines) and any(x.startswith("    review_signal: ") for x in lines)
    cli.main(["--input", str(path), "--format", "legacy-json", "--profile", "fast"])
    assert json.loads(capsys.readouterr().out)[0]["hits"]
    index = ["--input", str(path), "--format", "legacy-json", "--profile", "fast", "--seekdb-path", str(tmp_path / "index")]
    cli.main(index)
    assert not (tmp_path / "index").exists()
    for version in (0, 1):
        cli.main([*index, "--rebuild-seekdb-index"])
        assert (tmp_path / "index" / "prosegauge" / "cases" / f"version={version}").exists()
    with pytest.raises(FileNotFoundError):
        cli.main(["--input", str(tmp_path / "none.md")])


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "稳稳接住你"), (2, "")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    docs = streaming.read_stream(spark, str(tmp_path / "in"))
    streaming.analyze_stream(docs, streaming.write_batches(str(tmp_path / "out")), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
