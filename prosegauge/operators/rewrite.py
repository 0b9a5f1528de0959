"""Local rewrites of paragraphs with a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import lexicon as L
from ..functions import rewriting as R


def signal_codes(segments: DataFrame) -> DataFrame:
    """doc_id and a map from paragraph to the codes of its signals; segments without a paragraph are left out."""
    codes = segments.where("paragraph_index IS NOT NULL").select("doc_id", "paragraph_index", F.explode("signals.code").alias("code"))
    each = codes.groupBy("doc_id", "paragraph_index").agg(F.collect_set("code").alias("codes"))
    return each.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("paragraph_index", "codes"))).alias("codes"))


def rewrite(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, rewritten_text of each row: front matter, then the paragraphs parted by one blank line.

    A row's paragraphs are rewritten within it; only those of documents with a gated one go through Python. Rows of one doc_id are
    rewritten by the same segments; ``plans.analyze.rewritten`` tells texts apart too.
    """
    none = F.array().cast("array<string>")
    found = signal_codes(segments).withColumnRenamed("doc_id", "__doc")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(found, F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    rows = rows.select("doc_id", B.front(F.col("text")).alias("front"), B.paragraphs(F.col("text")).alias("parts"), F.coalesce("codes", F.create_map().cast("map<int,array<string>>")).alias("codes"))
    of = lambda i: F.coalesce(F.try_element_at(F.col("codes"), i), none)
    gated = F.transform("parts", lambda p, i: F.arrays_overlap(of(i), F.array(*map(F.lit, L.NOT_BUT_CODES))))
    rows = rows.withColumn("gated", F.when(F.size("codes") > 0, gated))
    asked = F.exists("gated", lambda g: g)
    positive = F.coalesce(R.not_but(F.when(asked, F.col("parts")), F.when(asked, F.col("gated"))), F.col("parts"))
    done = rows.withColumn("kept", positive).withColumn("done", F.transform("kept", lambda t, i: R.simple(t, of(i))))
    return done.select("doc_id", F.concat("front", F.array_join("done", "\n\n")).alias("rewritten_text"))
