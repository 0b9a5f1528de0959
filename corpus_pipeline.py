"""Documents to training tokens: language ID, near-duplicates, repeated passages, benchmark passages, BPE.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns the tokens. The result of each is
written and read again. Null ids, texts and labels, empty texts and repeated rows pass as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import bpe, decontaminate, language, simhash_similar, suffix_dedup
from prosegauge.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no letter, or far from every learned language. A missing label is filled in."""
    marked = language.predict(docs.select(*COLUMNS), language.learned(docs), into="found")
    kept = marked.where(~F.col("found.rejected"))
    return kept.withColumn("lang", F.coalesce("lang", F.col("found.lang"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates (five words, similarity of 0.8)."""
    return simhash_similar.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte covered by a 100-byte string that starts earlier; a document that loses all its text goes."""
    cut = suffix_dedup.kept_text(docs.select(*COLUMNS), into="cut")
    left = cut.where((F.col("cut.n_removed") == 0) | (F.trim(F.col("cut.kept")) != ""))
    n_chars = F.when(F.col("cut.n_removed") > 0, F.char_length("cut.kept").cast("bigint")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("cut.kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark window."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and digests of the ids and the decoded text."""
    out = bpe.with_tokens(docs.select(*COLUMNS), bpe.vocabulary_text(bpe.default_path()))
    return out.select("doc_id", "lang", "source", F.col("bpe.n_tokens").alias("n_tokens"), F.col("bpe.ids_text").alias("ids_text"), F.sha2("bpe.ids_text", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", tokens),
]
#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i + 1}")
    return docs
