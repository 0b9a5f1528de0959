"""Stylometric features of a text and their anomalies, as column functions without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blocks import kept, stat_sentences
from .dialect import BREAK, occurrences, rounded
from .lexicon import CONNECTORS, DASH, META, PASSIVE, THREE_PART, WORD_RUN

TOLERANCE = 5


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def matches(text: Column, patterns: list[str]) -> Column:
    """Matches of each pattern, added up."""
    return _sum([F.regexp_count(text, F.lit(f"(?d){p}")) for p in patterns]).cast("bigint")


def connectors(text: Column) -> Column:
    return _sum([occurrences(text, c) for c in CONNECTORS])


def _in_runs(found: Column, count) -> Column:
    """What is counted in the runs of Chinese characters alone; words of nothing else are in no other place, and the runs are short where a text has few."""
    return _let(F.array_join(found, "\n"), count)


def passives(text: Column, found: Column) -> Column:
    words = [p for p in PASSIVE if all("\u4e00" <= c <= "\u9fff" for c in p)]
    return _in_runs(found, lambda runs: _sum([occurrences(runs, w) for w in words])) + matches(text, [p for p in PASSIVE if p not in words])


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rounded(value: Column, digits: int) -> Column:
    """Rounded, by the wide form only where the value needs it: one sentence may be a whole document."""
    return F.coalesce(F.round(value.try_cast("decimal(18,10)"), digits).cast("double"), rounded(value, digits, wide=True))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, _rounded(a / b, 4)).otherwise(F.lit(0.0))


def uniform_groups(lengths: Column, tolerance: int = TOLERANCE) -> Column:
    """Maximal runs of three or more sentences whose neighbours differ by at most the tolerance."""
    start = F.struct(F.lit(0).alias("groups"), F.lit(0).alias("run"), F.lit(-1).cast("bigint").alias("last"))

    def step(a: Column, x: Column) -> Column:
        near = (a["last"] >= 0) & (F.abs(x - a["last"]) <= tolerance)
        run = F.when(near, a["run"] + 1).otherwise(F.lit(1))
        return F.struct((a["groups"] + F.when(run == 3, 1).otherwise(0)).alias("groups"), run.alias("run"), x.cast("bigint").alias("last"))

    return F.aggregate(lengths, start, step)["groups"]


def features(text: Column, names: list[str] | None = None) -> Column:
    """The named features (all: those of FEATURES) as a struct; the arrays that several need are made once, and only if one does.

    All listed words and patterns have a Chinese character, so a text without one isn't searched for them.
    """

    def of(x: Column, total: Column) -> dict:
        lengths, found = x["lengths"], x["words"]
        searched = lambda count: F.when(F.size(found) > 0, count).otherwise(F.lit(0).cast("bigint"))
        n = F.size(lengths).cast("bigint")  # lengths are long too: a product of two of these is beyond an integer from 46,341 characters on
        mean = F.when(n > 0, total / n).otherwise(F.lit(0.0))
        squares = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, v: a + v * v)
        # population variance from whole numbers, so that no order of additions matters
        scaled = squares.cast("decimal(19,0)") * n.cast("decimal(10,0)") - (total * total).cast("decimal(19,0)")
        spread = F.when(n > 0, F.sqrt(scaled.cast("double") / (n * n))).otherwise(F.lit(0.0))
        steps = F.greatest(n - 1, F.lit(0)).cast("int")
        deltas = F.aggregate(F.zip_with(F.slice(lengths, 2, steps), F.slice(lengths, 1, steps), lambda a, b: F.abs(a - b)), F.lit(0).cast("bigint"), lambda a, v: a + v)
        extreme = F.size(F.filter(lengths, lambda v: (2 * v * n <= total) | (2 * v * n >= 3 * total)))
        words = F.size(found)
        return {
            "sentence_count": lambda: n,
            "word_count": lambda: words.cast("bigint"),
            "sentence_length_mean": lambda: _rounded(mean, 2),
            "sentence_length_std": lambda: _rounded(spread, 2),
            "sentence_length_cv": lambda: F.when(mean > 0, rounded(spread / mean, 4)).otherwise(F.lit(0.0)),
            "adjacent_length_delta_mean": lambda: F.when(n >= 2, _rounded(deltas / (n - 1), 4)).otherwise(F.lit(0.0)),
            "extreme_sentence_ratio": lambda: _ratio(extreme, n),
            "unique_words": lambda: F.size(F.array_distinct(found)).cast("bigint"),
            "lexical_diversity": lambda: _ratio(F.size(F.array_distinct(found)), words),
            "connector_density": lambda: F.when(F.length(text) > 0, rounded(searched(_in_runs(found, connectors)) / F.length(text) * 100, 4)).otherwise(F.lit(0.0)),
            "passive_ratio": lambda: _ratio(searched(passives(text, found)), n),
            "comma_density": lambda: _ratio(occurrences(text, "，") + occurrences(text, ","), n),
            "dash_density": lambda: _ratio(searched(matches(text, DASH)), n),
            "three_part_enumeration_count": lambda: searched(matches(text, THREE_PART)),
            "meta_discourse_count": lambda: searched(matches(text, META)),
            "uniform_sentence_group_count": lambda: uniform_groups(lengths).cast("bigint"),
            "sentence_lengths": lambda: lengths,
        }

    wanted = names or FEATURES
    plain = {"char_count": lambda: F.length(text).cast("bigint"), "paragraph_count": lambda: F.size(kept(F.split(text, BREAK))).cast("bigint")}
    if set(wanted) <= set(plain):
        return F.struct(*[plain[c]().alias(c) for c in wanted])
    arrays = F.struct(F.transform(stat_sentences(text), lambda s: F.length(s).cast("bigint")).alias("lengths"), F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0)).alias("words"))
    total = lambda x: F.aggregate(x["lengths"], F.lit(0).cast("bigint"), lambda a, v: a + v)
    # the total is made once too: it is asked for at every sentence
    return _let(arrays, lambda x: _let(total(x), lambda t: F.struct(*[(plain | of(x, t))[c]().alias(c) for c in wanted])))


FEATURES = [
    "char_count", "paragraph_count", "sentence_count", "word_count", "sentence_length_mean", "sentence_length_std", "sentence_length_cv", "adjacent_length_delta_mean", "extreme_sentence_ratio",
    "unique_words", "lexical_diversity", "connector_density", "passive_ratio", "comma_density", "dash_density", "three_part_enumeration_count", "meta_discourse_count", "uniform_sentence_group_count", "sentence_lengths",
]
#: Those that anomalies() reads.
JUDGED = [
    "sentence_count", "word_count", "sentence_length_cv", "adjacent_length_delta_mean", "extreme_sentence_ratio", "lexical_diversity", "connector_density", "passive_ratio", "dash_density",
    "three_part_enumeration_count", "meta_discourse_count", "uniform_sentence_group_count",
]


#: Anomaly types in order, with label, hint and dimensions; predicates, scores and descriptions follow in anomalies().
RULES = [
    ("low_sentence_variation", "句子长度过于均匀", "刻意改变句子长度，加入短句打破节奏", ["rhythm", "authenticity"]),
    ("low_adjacent_sentence_delta", "相邻句长度跳变太小", "穿插明显更短或更长的句子，不要让每句都沿着同一节奏往前走", ["rhythm", "authenticity"]),
    ("low_extreme_sentence_ratio", "长短句交替不足", "补一两句更短的判断句，或者把某一句展开，拉开句长层次", ["rhythm", "authenticity"]),
    ("uniform_sentence_groups", "存在均匀句长段落", "打断均匀节奏：缩短、拉长、或拆成两句", ["rhythm", "authenticity"]),
    ("high_connector_density", "连接词密度过高", "删除逻辑连接词，用上下文自然衔接", ["connector_driven", "over_explicitness"]),
    ("high_passive_ratio", "被动语态过多", "改为主动语态，明确主语", ["average_style", "meta_discourse_density"]),
    ("low_lexical_diversity", "词汇重复度高", "使用同义词替换，避免重复", ["average_style", "refinement"]),
    ("high_dash_density", "破折号使用过多", "删除破折号后的解释，相信读者能理解", ["trust", "meta_discourse_density"]),
    ("three_part_enumeration", "三段式列举", "改成两项或四项，或去掉编号直接列举", ["structure_symmetry", "average_style"]),
    ("meta_discourse_pollution", "元话语污染", "删除元话语标记，只保留正文内容", ["pure_output", "meta_discourse_density"]),
]


def anomalies(s: Column) -> Column:
    """The anomalies that features show, in the order of RULES."""
    n = s["sentence_count"]
    cv, delta, ext, groups = s["sentence_length_cv"], s["adjacent_length_delta_mean"], s["extreme_sentence_ratio"], s["uniform_sentence_group_count"]
    con, pas, lex, dash, three, meta = s["connector_density"], s["passive_ratio"], s["lexical_diversity"], s["dash_density"], s["three_part_enumeration_count"], s["meta_discourse_count"]
    two = lambda x: F.format_string("%.2f", x)
    judged = [
        ((cv < 0.3) & (n >= 3), rounded(0.7 - cv, 2), F.concat(F.lit("句长变异系数 "), cv.cast("string"), F.lit("，人类写作通常变化更大"))),
        ((delta < 8) & (n >= 4), rounded(F.least(F.lit(0.75), 0.82 - delta / 20), 2), F.concat(F.lit("相邻句平均长度差 "), two(delta), F.lit("，段落起伏偏平"))),
        ((ext < 0.12) & (n >= 4), rounded(F.least(F.lit(0.7), 0.5 + (0.12 - ext) * 2), 2), F.concat(F.lit("极长/极短句占比 "), two(ext), F.lit("，段落缺少明显节奏拐点"))),
        ((groups >= 1) & (n >= 5), rounded(F.least(F.lit(0.85), 0.6 + groups * 0.15), 2), F.concat(F.lit("发现 "), groups.cast("string"), F.lit(" 处连续句子长度相近"))),
        (con > 2.0, F.least(F.lit(0.9), con / 3), F.concat(F.lit("每100字出现 "), two(con), F.lit(" 个连接词"))),
        (pas > 0.5, F.least(F.lit(0.8), pas), F.concat(F.lit("平均每句 "), two(pas), F.lit(" 个被动标记"))),
        ((lex < 0.4) & (s["word_count"] > 50), rounded(0.8 - lex, 2), F.concat(F.lit("词汇多样性 "), lex.cast("string"), F.lit("，存在重复用词"))),
        ((dash > 0.3) & (n >= 3), rounded(F.least(F.lit(0.78), 0.5 + dash * 0.3), 2), F.concat(F.lit("平均每句 "), two(dash), F.lit(" 个破折号，可能存在过度解释"))),
        (three >= 1, rounded(F.least(F.lit(0.82), 0.7 + three * 0.1), 2), F.concat(F.lit("发现 "), three.cast("string"), F.lit(" 处三段式列举结构"))),
        (meta >= 1, rounded(F.least(F.lit(0.9), 0.8 + meta * 0.05), 2), F.concat(F.lit("发现 "), meta.cast("string"), F.lit(" 处元话语标记"))),
    ]
    rows = []
    for i, ((kind, label, hint, dims), (when, score, text)) in enumerate(zip(RULES, judged)):
        rows.append(F.when(when, F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("type"), F.lit(label).alias("label"), score.cast("double").alias("score"), text.alias("description"), F.lit(hint).alias("rewrite_hint"), F.array(*map(F.lit, dims)).alias("diagnostic_dimensions"))))
    return F.filter(F.array(*rows), lambda x: x.isNotNull())
