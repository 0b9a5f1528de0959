"""The pipeline's stages against brute force, and the registry."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from prosegauge.llm import registry
from tests.llm.test_operators import SAMPLES, brute_dedup, brute_leaks

COLUMNS = corpus_pipeline.COLUMNS


def documents(spark, path):
    rng = random.Random(7)
    text = lambda k, n: " ".join(rng.choice(SAMPLES[k].split()) + rng.choice("abcdefghij") for _ in range(n))
    rows = [(i, text(k, rng.randint(30, 120)), k, f"s{i % 3}", None) for i, k in enumerate(sorted(SAMPLES) * 40)]
    leak = text("en", 30)
    passage = text("fr", 60)
    rows += [(1000, rows[0][1], "de", "s0", 1), (1001, rows[1][1] + " more", "en", "s0", 1), (1002, "12 34 ...", "en", "s0", 1), (1003, None, None, None, None), (1004, text("en", 20) + " " + leak + " " + text("en", 20), "en", None, 1)]
    rows += [(1010 + i, text("fr", 70) + " " + passage + " " + text("fr", 70), "fr", "s1", 1) for i in range(3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return leak, passage


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    leak, passage = documents(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, path)
        if i < 4:
            assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before), name
        kept.append((before, after))
    language, near, suffix, bench, tokens = kept
    assert set(language[0]) - set(language[1]) == {1002, 1003}
    assert set(near[0]) - set(near[1]) == {1000, 1001}
    want = brute_dedup(list(suffix[0].items()))
    assert {d: r.text for d, r in suffix[1].items()} == {d: x[3].decode("utf-8", "ignore") for d, x in want.items() if not x[1] or x[3].strip()}
    assert sum(passage[30:-30] in r.text for r in suffix[1].values()) == 1
    leaks = brute_leaks(list(bench[0].items()), [(1, leak), (2, None)])
    assert set(bench[1]) == {d for d, x in leaks.items() if not x[1]} and 1004 not in bench[1]
    assert all(r.n_tokens == len(r.ids_text.split()) > 0 for r in tokens[1].values()) and set(tokens[0]) == set(tokens[1])


def test_run(spark, tmp_path):
    documents(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == out.select("doc_id").distinct().count() > 100


def test_registry():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES] == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want))
