"""The case library: JSON records, cases and their matchers."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ROOT = Path(__file__).parent / "cases"
MATCHER = "struct<type:string,pattern:string,weight:double>"
CASE = (
    "case_seq int, id string, lang string, genres array<string>, label string, severity double, diagnostic_dimensions array<string>, description string, "
    f"rewrite_hint string, matchers array<{MATCHER}>, why_it_sounds_ai string, aliases array<string>, examples array<string>, counter_examples array<string>, prompt_rule string"
)
REQUIRED = ["id", "lang", "genres", "label", "severity", "diagnostic_dimensions", "description", "rewrite_hint", "matchers"]


def read_records(path: Path) -> list[dict]:
    """The records of one JSON file; none if the key is missing."""
    return json.loads(Path(path).read_text(encoding="utf-8")).get("records", [])


def cases(root: str | Path | None = None, lang: str = "zh", genres: list[str] | None = None) -> list[tuple]:
    """Cases in order of file name and record; a missing folder has none, a missing field raises KeyError."""
    out = []
    for path in sorted((Path(root or DEFAULT_ROOT) / lang).glob("*.json")):
        for r in read_records(path):
            if genres and not set(genres) & set(r["genres"]):
                continue
            fixed = [r[k] for k in REQUIRED]
            fixed[4] = float(fixed[4])
            fixed[-1] = [(m["type"], m["pattern"], float(m.get("weight", 1.0))) for m in r["matchers"]]
            out.append((len(out), *fixed, r.get("why_it_sounds_ai"), r.get("aliases", []), r.get("examples", []), r.get("counter_examples", []), r.get("prompt_rule")))
    return out


def load_cases(spark: SparkSession, root: str | Path | None = None, lang: str = "zh", genres: list[str] | None = None) -> DataFrame:
    """The cases as a table."""
    return spark.createDataFrame(cases(root, lang, genres), CASE)


def matchers(cases_df: DataFrame) -> DataFrame:
    """A row for each matcher, in library order."""
    m = cases_df.select("case_seq", F.col("id").alias("case_id"), "label", "severity", "rewrite_hint", "diagnostic_dimensions", F.posexplode("matchers").alias("place", "m"))
    return m.select((F.col("case_seq") * 1000 + F.col("place")).alias("matcher_seq"), "case_id", "label", "severity", "rewrite_hint", "diagnostic_dimensions", F.col("m.type").alias("type"), F.col("m.pattern").alias("pattern"), F.coalesce("m.weight", F.lit(1.0)).alias("weight"))


def any_genre(genres: list[str]) -> Column:
    """Cases of at least one of the genres."""
    return F.arrays_overlap("genres", F.array(*map(F.lit, genres)))


def document(where: str = "") -> Column:
    """The text under which a case is indexed."""
    from ..functions.dialect import strip

    return strip(F.concat_ws("\n", "label", "description", F.coalesce("why_it_sounds_ai", F.lit("")), F.array_join("examples", " "), "rewrite_hint"))
