"""Documents to paragraphs and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, text, in_code_fence of each paragraph; a document without any has no row."""
    split = docs.select("doc_id", B.paragraphs(F.col("text")).alias("parts"))
    # a part has no empty line within, so one parts them again when they are joined; the pieces between fences are outside and inside in turn
    pieces = F.split(F.array_join("parts", "\n\n"), B.FENCE)
    marked = F.array_join(F.transform(pieces, lambda x, i: F.replace(x, F.lit("\n\n"), F.when(i % 2 == 1, F.lit("\n\n1")).otherwise(F.lit("\n\n0")))), B.FENCE)
    inside = F.transform(F.split(F.concat(F.lit("0"), marked), "\n\n"), lambda x: F.startswith(x, F.lit("1")) | F.contains(x, F.lit(B.FENCE)))
    fenced = F.when(F.exists("parts", lambda p: F.contains(p, F.lit(B.FENCE))), inside).otherwise(F.transform("parts", lambda p: F.lit(False)))
    rows = split.select("doc_id", F.posexplode(F.arrays_zip(F.col("parts").alias("text"), fenced.alias("in_code_fence"))).alias("paragraph_index", "p"))
    return rows.select("doc_id", "paragraph_index", F.col("p.text").alias("text"), F.col("p.in_code_fence").alias("in_code_fence"))


def sentences(rows: DataFrame, kind: str = "detect") -> DataFrame:
    """doc_id, paragraph_index, sentence_index, sentence; kind: detect or stats."""
    found = B.sentences(F.col("text")) if kind == "detect" else B.stat_sentences(F.col("text"))
    return rows.select("doc_id", "paragraph_index", F.posexplode(found).alias("sentence_index", "sentence"))
