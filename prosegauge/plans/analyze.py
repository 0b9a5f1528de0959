"""The analysis of documents from text to report."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, probability, rules
from ..operators.paragraphs import paragraphs
from ..operators.rewrite import rewrite
from ..sources import library

#: The analysis holds fuzzy matchers against a paragraph by these, whatever a caller sets for the plain detection.
THRESHOLD, ALGORITHM = 70.0, "partial_ratio"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a hash of the text in doc_id: rows of a repeated or null id are told apart by their texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct("doc_id", F.xxhash64(text).alias("mark")).alias("doc_id"), text.alias("text"))


def unkeyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id.doc_id"))


def detect(docs: DataFrame, root: str | Path | None = None, lang: str = "zh", genres: list[str] | None = None, threshold: float = rules.THRESHOLD, algorithm: str = rules.ALGORITHM) -> DataFrame:
    """Paragraphs with a rule hit, their hits and scores, without any threshold on the score."""
    spark = docs.sparkSession
    found = rules.rule_hits(paragraphs(docs), library.matchers(library.load_cases(spark, root, lang, genres)), threshold, algorithm)
    return rules.paragraph_scores(found)


def segments(docs: DataFrame, root: str | Path | None = None, lang: str = "zh", genres: list[str] | None = None, fuzzy: bool = True) -> DataFrame:
    """Suspected paragraphs of all documents."""
    spark = docs.sparkSession
    rows = paragraphs(docs)
    matchers = library.matchers(library.load_cases(spark, root, lang, genres))
    hits = rules.rule_hits(rows, matchers, THRESHOLD, ALGORITHM, fuzzy)
    return fusion.segments(rules.paragraph_scores(hits), fusion.anomalies(rows))


def analyze(docs: DataFrame, root: str | Path | None = None, lang: str = "zh", genres: list[str] | None = None, fuzzy: bool = True, enable_perplexity: bool = False, scorer=probability.bigram_tokens) -> DataFrame:
    """A report for each row. docs: doc_id, text; a null text is empty.

    Rows are told apart by doc_id and text, so repeated and null ids do no harm. enable_perplexity adds a column ``probability`` and its
    segments; it is null where there is no scorer.
    """
    given = keyed(docs)
    found = segments(given, root, lang, genres, fuzzy)
    if not enable_perplexity:
        return unkeyed(fusion.reports(given, found))
    scored = probability.analyze_probability(given, scorer)
    if scored is None:
        return unkeyed(fusion.reports(given, found)).withColumn("probability", F.lit(None).cast(probability.RESULT))
    found = found.unionByName(probability.probability_segments(given, scored), allowMissingColumns=True)
    row = scored.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("of"), F.struct(*probability.FIELDS).cast(probability.RESULT).alias("probability"))
    return unkeyed(fusion.reports(given, found).join(row, F.col("doc_id") == F.col("of"), "left").drop("of"))


def rewritten(docs: DataFrame, root: str | Path | None = None, lang: str = "zh", genres: list[str] | None = None, fuzzy: bool = True) -> DataFrame:
    """doc_id, rewritten_text of each row, by the segments of its own text."""
    given = keyed(docs)
    return unkeyed(rewrite(given, segments(given, root, lang, genres, fuzzy)))
