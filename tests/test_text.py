"""Blocks, statistics, rules and reports against plain Python written from the blueprint."""

import json
import re
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prosegauge.functions import blocks as B
from prosegauge.functions import dialect, fuzzy, lexicon, rewriting, spans, stats
from prosegauge.operators import fusion, probability, retrieval, rewrite, rules
from prosegauge.operators.paragraphs import paragraphs
from prosegauge.plans import analyze as plans
from prosegauge.sources import library


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2)


def column(spark, texts, f):
    return [r[1] for r in sorted(table(spark, texts).select("doc_id", f(F.col("text"))).collect())]


TEXTS = [
    "First paragraph.\n\nSecond paragraph.\n\nThird paragraph.", "", "   ", "\n\n\n", "one\ntwo", "Para one.\n  \n  \nPara two.", "a\n　\nb", "　x　\n\ny\x85",
    "---\na: b\n---\nbody\n\nmore", "---\nno end", "---\na\n---\nb\n---\nc", "第一句。第二句！第三句？", "```python\nprint('hi')\n```", "# 标题\n\n- a\n- b\n\n| x |\n| y |",
]


def body(t):
    if t.startswith("---\n") and "\n---\n" in t:
        return t.split("\n---\n", 1)[1]
    return t


def parts(t):
    return [x.strip() for x in re.split(r"\n\s*\n", body(t)) if x.strip()]


def test_paragraphs(spark):
    assert column(spark, TEXTS, B.paragraphs) == [parts(t) for t in TEXTS]


def test_front_and_body_make_the_text(spark):
    assert column(spark, TEXTS, lambda c: F.concat(B.front(c), B.body(c))) == TEXTS
    assert column(spark, TEXTS, B.body) == [body(t) for t in TEXTS]


def test_sentences(spark):
    given_ = ["第一句。第二句！第三句？", "```python\nprint('hi')\n```", "", "  ", "；；", "甲；乙", "# 一。二。"]
    assert column(spark, given_, B.sentences) == [["第一句。", "第二句！", "第三句？"], [given_[1]], [], [], ["；；"], ["甲；", "乙"], [given_[6]]]


def test_block_types(spark):
    given_ = ["## 标题", "```\nx", "x\n```", "| a |\n| b |", "- a\n* b\n1. c", "- a\nb", "text"]
    assert column(spark, given_, B.block_type) == ["heading", "code", "code", "table", "list", "prose", "prose"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a`\n 。", max_size=40), min_size=1, max_size=30))
def test_fences_follow_parity(spark, texts):
    rows = paragraphs(table(spark, texts)).collect()
    got = {(r.doc_id, r.paragraph_index): r.in_code_fence for r in rows}
    want = {}
    for d, t in enumerate(texts):
        inside = False
        for i, p in enumerate(parts(t)):
            n = p.count("```")
            want[d, i] = inside or n > 0
            inside ^= n % 2 == 1
    assert got == want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="甲乙，。！\n 首先但是被", max_size=80), min_size=1, max_size=30))
def test_features(spark, texts):
    got = column(spark, texts, lambda c: stats.features(c))
    for t, f in zip(texts, got):
        lengths = [len(x.strip()) for x in re.split(r"[。！？!?\n]+", t) if x.strip()]
        assert f.sentence_lengths == lengths and f.sentence_count == len(lengths) and f.char_count == len(t)
        mean = sum(lengths) / len(lengths) if lengths else 0
        assert abs(f.sentence_length_mean - mean) < 0.0051
        assert abs(f.sentence_length_std - (statistics.pstdev(lengths) if lengths else 0)) < 0.0051
        deltas = [abs(a - b) for a, b in zip(lengths, lengths[1:])]
        assert abs(f.adjacent_length_delta_mean - (sum(deltas) / len(deltas) if deltas else 0)) < 0.000051
        words = re.findall("[一-鿿]+", t)
        assert (f.word_count, f.unique_words) == (len(words), len(set(words)))
        assert abs(f.connector_density - (sum(t.count(c) for c in lexicon.CONNECTORS) / len(t) * 100 if t else 0)) < 0.000051
        runs, run = 0, 1
        for a, b in zip(lengths, lengths[1:]):
            run = run + 1 if abs(a - b) <= 5 else 1
            runs += run == 3
        assert f.uniform_sentence_group_count == runs


def test_features_of_long_sentences_and_many(spark):
    texts = ["a" * 60_000 + "。" + "b" * 8 + "首先，被", "ab。" * 50_000, "。".join(["a" * 40_000] * 3 + ["b"] * 30_000)]
    for t, f in zip(texts, column(spark, texts, lambda c: stats.features(c))):
        lengths = [len(x) for x in t.split("。") if x]
        n, total = len(lengths), sum(lengths)
        assert f.sentence_lengths == lengths and f.sentence_count == n
        assert abs(f.sentence_length_mean - total / n) < 0.0051 and abs(f.sentence_length_std - statistics.pstdev(lengths)) < 0.0051
        assert abs(f.extreme_sentence_ratio - sum(2 * v * n <= total or 2 * v * n >= 3 * total for v in lengths) / n) < 0.000051


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a，\n 首先但是因此外被受到由完成", max_size=60), min_size=1, max_size=30))
def test_connectors_and_passives_beside_other_characters(spark, texts):
    assert all(re.fullmatch("[一-鿿]+", c) for c in lexicon.CONNECTORS)
    for t, f in zip(texts, column(spark, texts, lambda c: stats.features(c))):
        n = len([x for x in re.split(r"[。！？!?\n]+", t) if x.strip()])
        assert abs(f.connector_density - (sum(t.count(c) for c in lexicon.CONNECTORS) / len(t) * 100 if t else 0)) < 0.000051
        assert abs(f.passive_ratio - (sum(len(re.findall(p, t)) for p in lexicon.PASSIVE) / n if n else 0)) < 0.000051


@pytest.mark.parametrize("name", ["connector_density", "passive_ratio"])
def test_words_are_looked_for_in_chinese_runs_only(spark, monkeypatch, name):
    searched = []
    monkeypatch.setattr(stats, "occurrences", lambda text, word: searched.append(str(text)) or F.lit(0).cast("bigint"))
    monkeypatch.setattr(stats, "_in_runs", lambda found, count: count(F.lit("the runs")), raising=False)
    stats.features(F.col("whole"), [name])
    words = {"connector_density": lexicon.CONNECTORS, "passive_ratio": lexicon.PASSIVE[:4]}[name]
    assert len(searched) == len(words) and not any("whole" in x for x in searched)


def test_overlapping_connectors_count_each(spark):
    assert column(spark, ["因此外"], stats.connectors) == [2]


def codes(spark, text):
    return {s.code for r in plans.segments(table(spark, [text])).collect() for s in r.signals}


@pytest.mark.parametrize(
    "text,code,there",
    [
        ("这是一个普通测试句子。这是另一条普通测试句子。这又是一条普通测试句子。这还是一条普通测试句子。", "low_adjacent_sentence_delta", True),
        ("这个句子长度差不多。第二句长度也差不多。第三句还是差不多。第四句依旧差不多。第五句仍然差不多。", "low_extreme_sentence_ratio", True),
        ("## 第一版：本地内存存储", "high_connector_density", False),
        ("为了把这些问题落下来，我写了一个任务管理的 Demo，把这套技术栈走了一遍。", "high_passive_ratio", False),
        ("\n```typescript\nconst tasks: Task[] = [];\n\napp.get('/tasks', (req, res) => {\n  res.json(tasks);\n});\n```\n", "low_sentence_variation", False),
    ],
)
def test_statistical_signals(spark, text, code, there):
    assert (code in codes(spark, text)) == there


def test_library():
    rows = library.cases()
    assert len({r[1] for r in rows}) == len(rows) == 47
    for genre, least in (("argumentative", 22), ("narrative", 10), ("academic", 8)):
        assert len(library.cases(genres=[genre])) >= least
    assert all(0 <= r[5] <= 1 and r[6] and r[9] and r[8] for r in rows)
    assert library.cases(lang="xx") == []


def test_library_needs_its_fields(tmp_path):
    (tmp_path / "zh").mkdir()
    (tmp_path / "zh" / "a.json").write_text(json.dumps({"records": [{"id": "x"}]}))
    with pytest.raises(KeyError):
        library.cases(tmp_path)


@pytest.mark.parametrize(
    "text,case_id",
    [
        ("稳稳接住你", "zh.arg.steadily_catch_you"), ("真正重要的不是速度，而是你是否能长期坚持。", "zh.arg.not_x_but_y"), ("说穿了，这件事没有那么神秘。", "zh.arg.meta_essence"),
        ("在 AI Coding 的浪潮中，我们常常会遭遇代码生成的失控感。", "zh.fit.wave_opening"), ("我们不仅要掌握“术”，更要坚守工程质量的“道”。", "zh.fit.tao_shu_pairing"),
        ("我更在意的是它为什么一读就发空。", "zh.fit.conclusion_before_journey"), ("如果非让我给它一个定位，我现在不太想叫它检测器。", "zh.fit.editorial_neutrality"),
        ("本文将深入拆解语义指纹技术，揭秘 AI 检测的核心技术。", "zh.arg.reveal_the_secret"), ("这场文本DNA追踪革命让 AI 生成内容无处遁形。", "zh.arg.tech_myth_hype"), ("## 未来展望", "zh.fit.future_outlook_heading"),
    ],
)
def test_known_patterns(spark, text, case_id):
    assert case_id in {h.case_id for r in plans.detect(table(spark, [text])).collect() for h in r.hits}


def test_plain_text_has_no_hit(spark):
    assert plans.detect(table(spark, ["这是一段完全普通的中文，没有任何模式。", "完全无关的普通文本。\n\n另一段也没有任何模式匹配。"])).count() == 0


def test_two_matchers_are_two_hits(spark):
    hits = plans.detect(table(spark, ["不绕弯子，开门见山地说。"])).first().hits
    assert [h.case_id for h in hits].count("zh.arg.direct_to_point_opening") >= 2


def scored(spark, confidences, dims):
    df = spark.createDataFrame([(confidences, dims)], "c array<double>, d array<array<string>>")
    return df.select(rules.score(F.col("c"), F.col("d"))).first()[0]


def test_score(spark):
    assert scored(spark, [], []) == 0.0
    assert scored(spark, [0.8], [["a"]]) == 0.8
    assert scored(spark, [0.8, 0.888], [["a"], ["a"]]) == 0.9776
    assert scored(spark, [0.5], [["a", "b", "c"]]) == 0.55
    assert scored(spark, [1.0, 0.9], [["a"], ["b"]]) == 1.0


def test_report(spark):
    r = {x.doc_id: x for x in plans.analyze(table(spark, ["", "## 未来展望\n\n这项技术带来了无尽的想象空间，其爆发潜力不容小觑。", "真正重要的不是速度，而是你是否能长期坚持。", None])).collect()}
    assert len(r) == 4
    assert r[0].summary.suspected_segments_count == r[3].summary.suspected_segments_count == 0 and r[0].document_score.confidence == 0.3
    assert r[1].document_score.author_fit < 1 and r[1].summary.stop_or_retry == "retry" and r[1].summary.top_review_signals == ["author_fit_low"]
    assert r[2].document_score.author_fit == 1.0 and r[2].summary.top_review_signals == ["cliche_phrase"]


def test_report_has_no_stat_score_without_anomalies(spark):
    s = plans.segments(table(spark, ["稳稳接住你"])).first()
    assert s.stat_score is None and s.detection_method == "rule"


def test_review_priority(spark):
    df = spark.createDataFrame([(["cliche_phrase", "author_fit_low"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(fusion.primary_signal(F.col("s"))).collect()] == ["author_fit_low", None]


def test_fuzzy():
    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(96.5517, abs=1e-3)
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("a", "") == 0
    assert fuzzy.partial_ratio("test", "this is a test!") == 100
    assert fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.token_set_ratio("a b", "a b c") == 100


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=14))
def test_partial_ratio_tries_every_window(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    if n:
        want = max(fuzzy.ratio(short, long[max(0, i) : i + n]) for i in range(-(n - 1), len(long)))
        assert fuzzy.partial_ratio(a, b) == pytest.approx(want)


def test_matchers_of_any_script(spark):
    """A library whose phrases have no Chinese character is held against every paragraph."""
    kinds = [("phrase", "As an AI"), ("regex", "(?:deep|wide) dive"), ("substring", "稳稳"), ("regex", "不是.{1,9}而是|真正"), ("fuzzy", "in conclusion we see")]
    matchers = spark.createDataFrame([(i, f"c{i}", "l", 0.8, "h", ["d"], k, p, 1.0) for i, (k, p) in enumerate(kinds)], "matcher_seq int, case_id string, label string, severity double, rewrite_hint string, diagnostic_dimensions array<string>, type string, pattern string, weight double")
    rows = paragraphs(table(spark, ["As an AI I take a deep dive", "他稳稳地走", "nothing", "这不是快而是慢 As an AI", "in conclusion we see it"]))
    hits = {(r.doc_id, r.case_id) for r in rules.rule_hits(rows, matchers).collect()}
    assert hits == {(0, "c0"), (0, "c1"), (1, "c2"), (3, "c0"), (3, "c3"), (4, "c4")}


@pytest.mark.parametrize("pattern,needs", [("甲+", True), ("甲*", False), ("[一-龥]{2}x?", True), ("[甲a]", False), ("a|甲", False), ("乙|甲", True), ("(?:甲|(乙b))c", True), (".{3}", False), ("(甲", False), ("^在.*AI", True)])
def test_patterns_that_need_a_chinese_character(pattern, needs):
    assert rules.needs_cjk("regex", pattern) == needs and rules.needs_cjk("phrase", "x甲") and not rules.needs_cjk("phrase", "x")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("abc é", min_size=1, max_size=8), st.text("abcd é", max_size=16)), min_size=20, max_size=60), st.sampled_from([40.0, 70.0, 75.0, 100.0]))
def test_the_bound_of_likeness_loses_nothing(spark, pairs, threshold):
    df = spark.createDataFrame(pairs, "pattern string, text string")
    for name, one in (("ratio", fuzzy.ratio), ("partial_ratio", fuzzy.partial_ratio)):
        kept = {(r.pattern, r.text) for r in df.where(rules.may_be_like(name, threshold)).collect()}
        assert {p for p in pairs if one(*p) >= threshold} <= kept


def test_rows_of_repeated_and_null_ids(spark):
    """Each is reported and rewritten by its own text."""
    texts = ["真正重要的不是速度，而是你能坚持。", "普通的一段话。\n\n真正重要的不是速度，而是你能坚持。", "普通。", "真正重要的不是速度，而是你能坚持。"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[0]), (7, texts[0]), (8, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.rewritten_text) for r in plans.rewritten(docs).collect())
    one = "更要紧的是你能坚持。"
    assert got == sorted([(1, one), (1, "普通的一段话。\n\n" + one), (0, "普通。"), (0, one), (7, one), (7, one), (8, "")])
    report = [(r.doc_id or 0, r.summary.suspected_segments_count, [p.paragraph_index for p in r.paragraphs], len(r.paragraphs[0].signals) if r.paragraphs else 0) for r in plans.analyze(docs).collect()]
    n = max(x[3] for x in report)
    assert sorted(report) == sorted([(1, 1, [0], n), (1, 1, [1], n), (0, 0, [], 0), (0, 1, [0], n), (7, 1, [0], n), (7, 1, [0], n), (8, 0, [], 0)])


def test_analysis_with_probability(spark):
    docs = table(spark, ["ab " * 100, "short"])
    rows = {r.doc_id: r.probability for r in plans.analyze(docs, enable_perplexity=True).collect()}
    assert rows[0].overall_ppl >= 1 and rows[1].reasons == [probability.TOO_SHORT]
    assert [r.probability for r in plans.analyze(docs, enable_perplexity=True, scorer=None).collect()] == [None, None]
    assert probability.analyze_perplexity(docs, None) is None and probability.get_detector() is probability.get_detector()

    def broken(rows):
        raise ValueError("no model")

    assert probability.analyze_probability(docs, broken) is None
    with pytest.raises(probability.ProbabilityRuntimeError):
        probability.Detector(broken).analyze(docs)


def test_scorer_of_ones_own(spark):
    def load():
        return lambda text: ([-0.5] * (len(text) // 4), [1 + i % 2 for i in range(len(text) // 4)])

    r = {x.doc_id: x for x in probability.probability(table(spark, ["ab " * 100, "short"]), probability.token_scorer(load)).collect()}
    assert r[0].overall_ppl == round(2.718281828 ** 0.5, 2) and r[0].top1_ratio == pytest.approx(0.5, abs=0.02) and r[1].overall_ppl == 0


def test_rounding_of_large_values(spark):
    df = spark.createDataFrame([(1e8,), (1e10,), (123456789012.345,), (2.675,)], "x double")
    assert [r[0] for r in df.select(dialect.rounded(F.col("x"), 2, wide=True)).collect()] == [1e8, 1e10, 123456789012.35, 2.68]


def test_rewrites(spark):
    assert rewriting.keep_positive("AI 不是替代者，而是合作伙伴。") == "AI合作伙伴。"
    assert rewriting.keep_positive("真正重要的不是速度，而是坚持。") == "更要紧的是坚持。"
    docs = table(spark, ["---\nt: 1\n---\n真正重要的不是速度，而是你能坚持。\n\n本质上，底层逻辑就是快。\n\n普通。", "普通。"])
    out = {r.doc_id: r.rewritten_text for r in rewrite.rewrite(docs, plans.segments(docs)).collect()}
    assert out[0] == "---\nt: 1\n---\n更要紧的是你能坚持。\n\n关键处就是快。\n\n普通。" and out[1] == "普通。"


def test_spans():
    assert spans.spans("ab\n\ncd") == [{"start": 0, "stop": 2}, {"start": 4, "stop": 6}]
    assert len(spans.spans("a\n\ncd")) == 1


def test_span_index(spark):
    df = spark.createDataFrame([([(2, 4), (6, 9)], p) for p in (0, 2, 3, 4, 5, 6, 8, 12)], "s array<struct<start:int,stop:int>>, p int")
    assert [r[0] for r in df.select(B.span_index(F.col("s"), F.col("p"))).collect()] == [0, 0, 0, None, None, 1, 1, 1]


def chunks_of(text, size=256):
    out, cur = [], ""
    pieces = re.split(r"([。！？!?\.\n]+)", text)
    for i in range(0, len(pieces), 2):
        cur += pieces[i] + (pieces[i + 1] if i + 1 < len(pieces) else "")
        if len(cur) >= size:
            out.append(cur)
            cur = ""
    return out + [cur] if cur else out


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab.\n。 ", max_size=90), min_size=1, max_size=20))
def test_chunks(spark, texts):
    assert column(spark, texts, lambda c: probability.chunks(c, 10)) == [chunks_of(t, 10) for t in texts]


def test_windows_slide_where_chunks_are_few(spark):
    rows = probability.windows(table(spark, ["x" * 600, "x" * 40])).orderBy("window_index").collect()
    assert [(r.window_index, r.start_pos, r.end_pos) for r in rows] == [(0, 0, 256), (1, 256, 512), (2, 512, 768), (3, 768, 984)]


def test_probability_report(spark):
    r = {x.doc_id: x for x in probability.probability(table(spark, ["ab " * 100, "short", None, " " * 90])).collect()}
    assert len(r) == 4 and r[0].overall_ppl >= 1 and 0 <= r[0].risk_score <= 1 and r[0].reasons != [probability.TOO_SHORT]
    assert all((r[i].overall_ppl, r[i].risk_score, r[i].risk_level, r[i].reasons, r[i].mean_rank) == (0, 0, "low", [probability.TOO_SHORT], None) for i in (1, 2, 3))
    with pytest.raises(probability.ProbabilityUnavailableError):
        probability.probability(table(spark, ["x"]), None)


def test_index_and_search(spark, tmp_path):
    index = retrieval.upsert(spark, str(tmp_path), retrieval.index_rows(library.load_cases(spark)))
    changed = retrieval.index_rows(library.load_cases(spark, genres=["narrative"])).withColumn("document", F.concat("document", F.lit("!")))
    again = retrieval.upsert(spark, str(tmp_path / "one"), changed)
    assert again.count() == changed.count() < 47
    again = retrieval.upsert(spark, str(tmp_path), changed)
    assert again.count() == index.count() == 47 and again.join(changed, ["id", "document"]).count() == changed.count()
    assert set(retrieval.open_index(spark, str(tmp_path)).schema["metadata"].dataType.names) >= {"matchers", "examples", "prompt_rule", "label"}
    (tmp_path / "version=1" / "_SUCCESS").unlink()  # half-written
    assert retrieval.open_index(spark, str(tmp_path)).join(changed, ["id", "document"]).count() < changed.count()
    with pytest.raises(retrieval.IndexUnavailableError):
        retrieval.open_index(spark, str(tmp_path / "none"))
    with pytest.raises(retrieval.IndexUnavailableError):
        retrieval.open_index(spark, "nowhere://x/y")
    (tmp_path / "file").write_text("x")
    with pytest.raises(retrieval.IndexRuntimeError):
        retrieval.upsert(spark, str(tmp_path / "file"), changed)
    q = spark.createDataFrame([(0, "情绪托举")], "query_id int, text string")
    top = retrieval.search(q, index).orderBy("rank").collect()
    assert len(top) == 5 and top[0].case_id == "zh.arg.steadily_catch_you" and 0 <= top[0].score <= 1
    assert {r.case_id for r in retrieval.search(q, index, "vector", genres=["academic", "narrative"]).collect()} <= {c[1] for c in library.cases(genres=["academic"])}


def test_every_vector_can_be_a_neighbour(spark, tmp_path, monkeypatch):
    import numpy as np

    from prosegauge import queries

    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v[7] = 0
    v[299] = v[40] * 2
    texts = [(i, f"text of number {i % 150}") for i in range(200)]
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    like = np.round(unit @ unit.T, 6)
    want = {q: sorted(range(300), key=lambda i: (-like[q, i], i))[:5] for q in range(0, 300, 20)}
    for size in (4096, 4):
        monkeypatch.setattr(retrieval, "BLOCK", size)
        monkeypatch.setattr(retrieval, "LEADS", size)
        got = queries.QUERIES["knn_topk"](spark, str(tmp_path)).collect()
        assert {q: [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in want} == want and want[40][:2] == [40, 299]
        fused = {(r.query_id, r.id): r.fused for r in queries.QUERIES["hybrid_rrf"](spark, str(tmp_path)).collect()}
        assert fused[20, 20] == round(2 / 61, 8) and fused[20, 170] >= round(1 / 62, 8) and fused[280, 280] == round(1 / 61, 8)


def test_documents_that_contain_a_beginning(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["ab", "xaby", "", None, "b", "ba ab", "aab", "é漢ab", "x" * 70, "y" + "x" * 64])]
    queries = spark.createDataFrame(rows + [(20, "ab"), (21, "nowhere")], "query_id int, text string")
    index = spark.createDataFrame([(i, t) for i, t in rows] + [(30 + i, "ab" * i) for i in range(400)], "id int, document string").repartition(3)
    want = {(q, i, n) for q, t in [*rows, (20, "ab"), (21, "nowhere")] if t is not None for n, i in enumerate(sorted(r.id for r in index.collect() if r.document is not None and t[:64] in r.document)[:5], 1)}
    for size in (20_000, 2):
        monkeypatch.setattr(retrieval, "LEADS", size)
        assert {tuple(r) for r in retrieval.lexical_in_blocks(queries, index).collect()} == want
    assert {tuple(r) for r in retrieval.lexical(queries, index).collect()} == want


def test_case_search_takes_every_sentence(spark, tmp_path):
    import hashlib

    from prosegauge import queries

    spark.createDataFrame([(12, "A plain English line. Another one here.\nUne phrase claire.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["case_search"](spark, str(tmp_path)).collect()
    every = [r.sentence for r in queries.sentences(queries.paragraphs(queries.corpus(spark, str(tmp_path)))).collect()]
    assert any("English" in x for x in every) and {hashlib.md5(x.encode()).hexdigest() for x in every} == {r.query_id for r in got}
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(every)], "query_id int, text string")
    index = retrieval.index_rows(library.load_cases(spark))
    one, other = (sorted((r.query_id, r.case_id, r.score) for r in retrieval.search(asked, index, held=held).collect()) for held in (False, True))
    assert one == other


def test_probability_reads_every_window_of_the_documents(spark, tmp_path):
    import collections
    import math

    from prosegauge import queries

    texts = {1: "One sentence of many words stands here. " * 20, 2: "x" * 600, 3: "short", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    windows = {(1, i): t for i, t in enumerate(chunks_of(texts[1]))} | {(2, i): texts[2][i * 128 : i * 128 + 256] for i in range(4)}
    n = collections.Counter((t[i - 1], t[i]) for t in windows.values() for i in range(1, len(t)))
    of, kinds = collections.Counter(), collections.Counter()
    for (p, _), k in n.items():
        of[p] += k
        kinds[p] += 1
    ll = {pc: math.log((k + 0.5) / (of[pc[0]] + 0.5 * kinds[pc[0]]) + 1e-10) for pc, k in n.items()}
    want = {k: math.exp(-sum(ll[t[i - 1], t[i]] for i in range(1, len(t))) / (len(t) - 1)) for k, t in windows.items()}
    got = {(r.doc_id, r.window_index): r.ppl for r in queries.QUERIES["document_window_ppl"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
    report = {r.doc_id: r for r in queries.QUERIES["probability_report"](spark, str(tmp_path)).collect()}
    assert set(report) == {1, 2, 3, 4} and report[1].min_ppl == round(min(want[k] for k in want if k[0] == 1), 2)
    assert {r.doc_id for r in queries.QUERIES["document_rank_distribution"](spark, str(tmp_path)).collect()} == {1, 2}
