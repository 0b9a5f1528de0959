"""Detectors to signals, segments, summaries and document scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import lexicon as L
from ..functions import stats as S
from ..functions.dialect import rounded

KEPT, STAT_CAP, TOP_HITS = 0.5, 0.7, 3


def band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def review_signals(code: Column, source: Column) -> Column:
    one = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(code.isin(L.RHYTHM_CODES), one("uniform_sentence_length"))
        .when(code.isin(L.FORCED_CODES), one("author_fit_low", "forced_summary"))
        .when(code == L.LADDER_CODE, one("author_fit_low", "perfect_ladder"))
        .when(F.startswith(code, F.lit("zh.fit.")), one("author_fit_low"))
        .when(source == "rule", one("cliche_phrase"))
        .when(code.isin(L.CLICHE_STATS), one("cliche_phrase"))
        .otherwise(F.array().cast("array<string>"))
    )


def primary_signal(signals: Column) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, L.PRIORITY)), lambda x: F.array_contains(signals, x)), F.lit(0))


def anomalies(paragraphs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, text, anomalies of eligible paragraphs that have any; the cheap test comes first."""
    fit = paragraphs.where(~F.col("in_code_fence") & B.eligible(F.col("text")))
    # explode keeps the optimizer from copying the features into each of their uses
    found = fit.select("doc_id", "paragraph_index", "text", F.explode(F.array(S.features(F.col("text"), S.JUDGED))).alias("features"))
    return found.select("doc_id", "paragraph_index", "text", S.anomalies(F.col("features")).alias("anomalies")).where(F.size("anomalies") > 0)


def _signal(code, score, severity, evidence, reason, hint, source: str, dims) -> Column:
    signals = review_signals(code, F.lit(source))
    return F.struct(code.alias("code"), score.alias("score"), severity.alias("severity"), evidence.alias("evidence"), reason.alias("reason"), hint.alias("rewrite_hint"), F.lit(source).alias("source"), dims.alias("diagnostic_dimensions"), signals.alias("review_signals"), primary_signal(signals).alias("review_signal"))


def segments(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """Paragraphs that a rule (from KEPT on) or an anomaly marks, fused: one grouping of both sides, no outer join."""
    rule = scores.where(F.col("score") >= KEPT).select("doc_id", "paragraph_index", "text", "score", "hits", F.lit(None).cast(stats.schema["anomalies"].dataType).alias("anomalies"))
    stat = stats.select("doc_id", "paragraph_index", "text", F.lit(None).cast("double").alias("score"), F.lit(None).cast(scores.schema["hits"].dataType).alias("hits"), "anomalies")
    both = rule.unionByName(stat).groupBy("doc_id", "paragraph_index").agg(F.max("text").alias("text"), F.max("score").alias("rule_score"), F.first("hits", ignorenulls=True).alias("hits"), F.first("anomalies", ignorenulls=True).alias("anomalies"))
    total = F.aggregate("anomalies", F.lit(0.0), lambda a, x: a + x["score"])
    both = both.withColumn("stat_score", F.when(F.col("anomalies").isNotNull(), F.least(F.lit(STAT_CAP), total / F.size("anomalies"))))  # least() skips nulls
    both = both.withColumn("risk_score", rounded(F.greatest("rule_score", "stat_score"), 4))
    top = F.coalesce(F.slice("hits", 1, TOP_HITS), F.array().cast(scores.schema["hits"].dataType))
    found = F.coalesce("anomalies", F.array().cast(stats.schema["anomalies"].dataType))
    of_rules = F.transform(top, lambda h: _signal(h["case_id"], h["confidence"], band(F.col("rule_score")), h["matched_text"], h["label"], h["rewrite_hint"], "rule", h["diagnostic_dimensions"]))
    of_stats = F.transform(found, lambda a: _signal(a["type"], a["score"], band(F.col("stat_score")), a["label"], a["description"], a["rewrite_hint"], "stat", a["diagnostic_dimensions"]))
    reasons = F.concat(F.transform(top, lambda h: F.concat(h["label"], F.lit(" ("), h["matcher_type"], F.lit(")"))), F.transform(found, lambda a: a["description"]))
    hints = F.concat(F.filter(F.transform(top, lambda h: h["rewrite_hint"]), lambda x: x != ""), F.transform(found, lambda a: a["rewrite_hint"]))
    method = F.when(F.col("rule_score").isNotNull() & F.col("stat_score").isNotNull(), "rule+stat").when(F.col("rule_score").isNotNull(), "rule").otherwise("stat")
    return both.select(
        "doc_id", "paragraph_index", "text", "rule_score", "stat_score", "risk_score", band(F.col("risk_score")).alias("risk_level"), reasons.alias("reasons"),
        F.array_distinct(hints).alias("suggestions"), method.alias("detection_method"), F.concat(of_rules, of_stats).alias("signals"),
    )


def excerpt(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def segment_score(segments_: Column, total: Column, prefix: str = "") -> Column:
    """Best matching signal of each segment, added up, for each paragraph of the document."""
    best = lambda s: F.array_max(F.transform(F.filter(s["signals"], lambda x: F.startswith(x["code"], F.lit(prefix))), lambda x: x["score"]))
    total_score = F.aggregate(segments_, F.lit(0.0), lambda a, s: a + F.coalesce(best(s), F.lit(0.0)))
    return rounded(total_score / F.greatest(total, F.lit(1)), 4)


#: Features that a report shows, and those that its scores need.
BASIC = ["char_count", "sentence_count", "paragraph_count"]
STATISTICS = ["sentence_length_cv", "adjacent_length_delta_mean", "extreme_sentence_ratio", "connector_density", "passive_ratio", "lexical_diversity"]


def reports(docs: DataFrame, found: DataFrame, statistics: bool = True) -> DataFrame:
    """One row for each document: basic info, statistics, scores, summary and paragraphs by risk; none are left out.

    Without statistics there are no basic info and statistics, and no features of whole texts are computed.
    """
    row = F.struct((-F.col("risk_score")).alias("order"), F.coalesce("paragraph_index", F.lit(0)).alias("place"), "paragraph_index", "text", "risk_score", "risk_level", "reasons", "suggestions", "detection_method", "signals")
    grouped = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("segments"))
    kind = grouped.schema["segments"].dataType
    info = docs.select("doc_id", F.explode(F.array(S.features(B.body(F.coalesce("text", F.lit(""))), BASIC + STATISTICS if statistics else ["paragraph_count"]))).alias("f"))
    all_ = info.join(grouped, "doc_id", "left").withColumn("segments", F.coalesce("segments", F.array().cast(kind)))
    seg, pars = F.col("segments"), F.col("f.paragraph_count")
    count = lambda level: F.size(F.filter(seg, lambda s: s["risk_level"] == level)).cast("bigint")
    high, medium = count("high"), count("medium")
    issues = F.filter(F.transform(F.slice(seg, 1, 3), lambda s: F.get(s["signals"], F.lit(0))["code"]), lambda x: x.isNotNull())
    review = F.slice(F.array_distinct(F.filter(F.flatten(F.transform(seg, lambda s: F.transform(s["signals"], lambda x: x["review_signal"]))), lambda x: x.isNotNull())), 1, 5)
    fit_risk = segment_score(seg, pars, "zh.fit.")
    of_text = [
        F.struct(F.col("f.char_count").alias("total_chars"), F.col("f.sentence_count").alias("total_sentences"), pars.alias("total_paragraphs")).alias("basic_info"),
        F.struct(*[F.col(f"f.{x}").alias(x) for x in STATISTICS]).alias("statistics"),
    ] if statistics else []
    return all_.select(
        "doc_id",
        F.struct(segment_score(seg, pars).alias("overall_risk"), fit_risk.alias("author_fit_risk"), rounded(F.greatest(F.lit(0.0), 1 - fit_risk), 4).alias("author_fit"), F.when(F.size(seg) > 0, 0.6).otherwise(0.3).alias("confidence")).alias("document_score"),
        *of_text[:1],
        F.transform(seg, lambda s: F.struct(s["paragraph_index"].alias("paragraph_index"), excerpt(s["text"], 200).alias("text"), excerpt(s["text"], 120).alias("text_excerpt"), s["risk_score"].alias("risk_score"), s["risk_level"].alias("risk_level"), s["reasons"].alias("reasons"), s["suggestions"].alias("rewrite_hints"), s["detection_method"].alias("detection_method"), s["signals"].alias("signals"))).alias("paragraphs"),
        *of_text[1:],
        F.struct(pars.alias("total_segments_checked"), F.size(seg).cast("bigint").alias("suspected_segments_count"), high.alias("high_risk_count"), medium.alias("medium_risk_count"), issues.alias("top_issues"), review.alias("top_review_signals"), F.when((high > 0) | (medium > 0), "retry").otherwise("accept").alias("stop_or_retry"), F.lit(L.NOTE).alias("note")).alias("summary"),
    )
