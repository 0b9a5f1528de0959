"""Token counts as delta-maintained rollups.

Changes of documents become signed deltas: an insert adds a document and its tokens, a delete takes them away, a revised count
adds the difference. A batch of deltas is summed by source, language and tokenizer version before it is written, into a folder
named by the batch. A batch that is already there is left as it is: committing again, after a lost driver or by a replay, changes
nothing. ``compact`` adds the batches up to a rollup and notes which it holds; totals are the last rollup and the batches after it.

A folder without _SUCCESS is half-written: it isn't read, and is written anew. One writer at a time commits a batch or compacts.

Cases: a null source, language or tokenizer is a group of its own; null or empty texts count no tokens; rows repeated within a
batch add up; groups whose sums are all zero are not shown; an empty ledger has no rows; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, work_dir

GROUP = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
#: Words between white space, and words of letters, digits and code points from U+0080 on.
SPACED, PLAIN = "[^\\x20\\x09-\\x0D]+", "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def inserted(rows: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """Deltas of new documents."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("bigint").alias("n_docs"), tokens.cast("bigint").alias("n_tokens"))


def deleted(rows: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """Deltas of documents taken away."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(-1).cast("bigint").alias("n_docs"), (-tokens).cast("bigint").alias("n_tokens"))


def revised(rows: DataFrame, tokenizer: str, before: Column, after: Column) -> DataFrame:
    """Deltas of documents that stay but have a new count."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("bigint").alias("n_docs"), (after - before).cast("bigint").alias("n_tokens"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Ledger:
    """Batches of summed deltas, and rollups of them, in a folder of shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _done(self, pattern: str) -> list[str]:
        """The names of the folders that match and were written to the end."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(x.getPath().getParent().getName() for x in found or [])

    def _rollup(self) -> tuple[int, set[str]]:
        """The last rollup's number (0: none) and the batches that it holds."""
        last = max((int(x.partition("=")[2]) for x in self._done("rollup=*")), default=0)
        if not last:
            return 0, set()
        return last, {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/rollup={last}").toLocalIterator()}

    def committed(self, batch: str) -> bool:
        return bool(self._done(f"batch={batch}"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Write a batch once; False if it was there."""
        if self.committed(batch):
            return False
        summed(deltas).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def _rows(self) -> tuple[DataFrame, int, set[str]]:
        """Sums of the last rollup and of each committed batch after it; the rollup's number; all batches."""
        last, held = self._rollup()
        batches = {x.partition("=")[2] for x in self._done("batch=*")}
        paths = [f"{self.path}/totals={last}"] * bool(last) + [f"{self.path}/batch={x}" for x in sorted(batches - held)]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows, last, held | batches

    def compact(self) -> None:
        """A new rollup of all batches; it counts from when its list of batches is written, after its totals."""
        rows, last, batches = self._rows()
        summed(rows).write.mode("overwrite").parquet(f"{self.path}/totals={last + 1}")
        self.spark.createDataFrame([(x,) for x in sorted(batches)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rollup={last + 1}")

    def totals(self) -> DataFrame:
        """Sums over all committed batches."""
        return summed(self._rows()[0]).where("n_docs <> 0 OR n_tokens <> 0")


def op7_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over documents, one of them sent twice, with a rollup between.

    All documents are loaded as spaced-1. Those labelled toxic are withdrawn; the others of quality 0 are recounted by plain
    words; last, all that stay are loaded as plain-2. The withdrawal is sent again and must not count twice. The two tokenizers
    are patterns, which SQL can follow; any column of counts will do, such as that of ``bpe.with_tokens``.
    """
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.regexp_count(text, F.lit(SPACED)).alias("spaced"), F.regexp_count(text, F.lit(PLAIN)).alias("plain"))
    rows = stored(docs.join(labels, "doc_id", "left").select("source", "lang", "spaced", "plain", (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("toxic"), (F.coalesce(F.col("quality"), F.lit(1)) == 0).alias("poor")), "ledger-counts")
    ledger = Ledger(spark, work_dir(spark, "ledger"))
    withdrawn = deleted(rows.where("toxic"), "spaced-1", F.col("spaced"))
    ledger.commit("1-load", inserted(rows, "spaced-1", F.col("spaced")))
    ledger.commit("2-withdraw", withdrawn)
    ledger.commit("3-recount", revised(rows.where("poor AND NOT toxic"), "spaced-1", F.col("spaced"), F.col("plain")))
    ledger.compact()
    ledger.commit("4-load", inserted(rows.where("NOT toxic"), "plain-2", F.col("plain")))
    ledger.commit("2-withdraw", withdrawn)
    return ledger.totals()


OP7_SQL = r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT source, lang, coalesce(l.toxic, 0) = 1 AS toxic, coalesce(l.quality, 1) = 0 AS poor,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS spaced,
    len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS plain
  FROM documents LEFT JOIN l USING (doc_id)
),
t AS (
  SELECT source, lang, 'spaced-1' AS tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(CASE WHEN poor THEN plain ELSE spaced END) AS BIGINT) AS n_tokens
  FROM d WHERE NOT toxic GROUP BY source, lang
  UNION ALL
  SELECT source, lang, 'plain-2', CAST(count(*) AS BIGINT), CAST(sum(plain) AS BIGINT) FROM d WHERE NOT toxic GROUP BY source, lang
)
SELECT source, lang, tokenizer, n_docs, n_tokens FROM t WHERE n_docs <> 0 OR n_tokens <> 0
"""
