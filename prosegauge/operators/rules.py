"""Rules: paragraphs against the matchers of the case library."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.dialect import rounded

CJK = "[\\x{4e00}-\\x{9fff}]"
_CJK = range(0x4E00, 0xA000)
THRESHOLD, ALGORITHM = 75.0, "ratio"
#: Matchers that are sent to every executor at most; a library has tens.
MOST_MATCHERS = 5000


def needs_cjk(kind: str, pattern: str) -> bool:
    """Whether all that a phrase, substring or regex matcher can match has a Chinese character; False where that isn't plain."""
    if kind != "regex":
        return any(ord(c) in _CJK for c in pattern)

    def among(items) -> bool:
        return any(one(op, arg) for op, arg in items)

    def one(op, arg) -> bool:
        name = str(op)
        if name == "LITERAL":
            return arg in _CJK
        if name == "IN":
            return all((str(k) == "LITERAL" and v in _CJK) or (str(k) == "RANGE" and v[0] in _CJK and v[1] in _CJK) for k, v in arg)
        if name == "BRANCH":
            return all(among(x) for x in arg[1])
        if name == "SUBPATTERN":
            return among(arg[3])
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            return arg[0] > 0 and among(arg[2])
        return False

    try:
        return among(re._parser.parse(pattern))
    except (re.error, AttributeError, OverflowError):
        return False


def matched_text(text: Column, kind: Column, pattern: Column) -> Column:
    """What a phrase, substring or regex matcher finds, or null. An empty match is none."""
    found = F.expr("regexp_extract(text, concat('(?md)', pattern), 0)")
    return F.when(kind.isin("phrase", "substring") & F.contains(text, pattern) & (pattern != ""), pattern).when((kind == "regex") & (found != ""), found)


def _plain_hits(rows: DataFrame, matchers: DataFrame) -> DataFrame:
    text, kind, pattern = F.col("text"), F.col("type"), F.col("pattern")
    hit = (kind.isin("phrase", "substring") & F.contains(text, pattern)) | ((kind == "regex") & F.expr("text RLIKE concat('(?md)', pattern)"))
    return rows.join(F.broadcast(matchers), hit).withColumn("matched_text", matched_text(text, kind, pattern)).where("matched_text IS NOT NULL").withColumn("factor", F.lit(1.0))


def may_be_like(algorithm: str, threshold: float) -> Column:
    """Whether a pattern can be as like a text as the threshold: at most by its characters that the text has."""
    text, pattern = F.col("text"), F.col("pattern")
    n, size = F.length(pattern), F.length(text)
    met = F.aggregate(F.split(pattern, ""), F.lit(0), lambda a, c: a + F.when((c != "") & F.contains(text, c), 1).otherwise(0))
    if algorithm == "partial_ratio":  # windows cut at the ends of the text may be shorter than the pattern
        return (size < n) | (200.0 * met / (n + met) >= threshold - 1e-9)
    if algorithm in ("token_sort_ratio", "token_set_ratio"):  # white space goes
        return F.lit(True)
    return 200.0 * F.least(met, size) / (n + size) >= threshold - 1e-9


def rule_hits(paragraphs: DataFrame, matchers: DataFrame, threshold: float = THRESHOLD, algorithm: str = ALGORITHM, fuzzy_too: bool = True) -> DataFrame:
    """A row for each matcher that hits a paragraph: the matcher, matched_text, confidence.

    Paragraphs without a Chinese character aren't held against matchers that need one, which the patterns tell.
    """
    known = matchers.select("matcher_seq", "type", "pattern").limit(MOST_MATCHERS + 1).collect()
    if len(known) > MOST_MATCHERS:
        raise ValueError(f"a library of more than {MOST_MATCHERS} matchers")
    rows = paragraphs.select("doc_id", "paragraph_index", "text")
    plain = [r for r in known if r.type in ("phrase", "substring", "regex")]
    gated = [r.matcher_seq for r in plain if needs_cjk(r.type, r.pattern)]
    of = matchers.where(F.col("type").isin("phrase", "substring", "regex"))
    inside = F.col("matcher_seq").isin(gated)
    found = _plain_hits(rows.where(F.col("text").rlike(CJK)), of.where(inside))
    if len(gated) < len(plain):
        found = found.unionByName(_plain_hits(rows, of.where(~inside)))
    if fuzzy_too and any(r.type == "fuzzy" and r.pattern for r in known):
        pairs = rows.join(F.broadcast(matchers.where("type = 'fuzzy' AND pattern <> ''")), may_be_like(algorithm, threshold))
        near = pairs.withColumn("likeness", fuzzy.score(algorithm)("pattern", "text")).where(F.col("likeness") >= threshold)
        found = found.unionByName(near.withColumn("matched_text", F.col("pattern")).withColumn("factor", F.col("likeness") / 100).drop("likeness"))
    base = rounded(F.col("severity") * F.col("weight"), 4)
    return found.withColumn("confidence", rounded(base * F.col("factor"), 4)).drop("factor", "weight", "pattern")


def score(confidences: Column, dimensions: Column) -> Column:
    """Complement product of the confidences, raised by different dimensions, at most 1."""
    none = F.aggregate(confidences, F.lit(1.0), lambda a, c: a * (1 - c))
    spread = 1 + 0.05 * F.greatest(F.lit(0), F.size(F.array_distinct(F.flatten(dimensions))) - 1)
    return F.when(F.size(confidences) == 0, F.lit(0.0)).otherwise(rounded(F.least(F.lit(1.0), (1 - none) * spread), 4))


def paragraph_scores(hits: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, text, score and hits (by confidence, then library order) of paragraphs with a hit; rows repeated count once."""
    row = F.struct((-F.col("confidence")).alias("order"), "matcher_seq", "case_id", "label", F.col("type").alias("matcher_type"), "matched_text", "confidence", "severity", "rewrite_hint", "diagnostic_dimensions")
    grouped = hits.groupBy("doc_id", "paragraph_index").agg(F.first("text").alias("text"), F.array_sort(F.collect_set(row)).alias("hits"))
    by_seq = F.array_sort(F.transform("hits", lambda h: F.struct(h["matcher_seq"].alias("s"), h["confidence"].alias("c"), h["diagnostic_dimensions"].alias("d"))))
    return grouped.withColumn("score", score(F.transform(by_seq, lambda h: h["c"]), F.transform(by_seq, lambda h: h["d"])))
