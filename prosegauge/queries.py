"""Queries over the driver's tables and DuckDB SQL that gives the same rows.

SQL is put together from common table expressions that mirror the operators: corpus, paragraphs, features, hits and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import blocks as B
from .functions import fuzzy as Z
from .functions import lexicon as L
from .functions import rewriting as RW
from .functions import stats as S
from .functions.dialect import BREAK, WS, quoted, rounded, sql_occurrences, sql_rounded, sql_strip
from .operators import fusion, probability, retrieval, rules
from .operators.paragraphs import paragraphs, sentences
from .plans import analyze as plans
from .sources import library
from .sources.corpus import corpus, corpus_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- common table expressions ------------------------------------------------------------------------------------------------

NL = "chr(10)"
FRONT_END = f"(CASE WHEN starts_with(text, '---' || {NL}) AND strpos(text, {NL} || '---' || {NL}) > 0 THEN strpos(text, {NL} || '---' || {NL}) + 4 ELSE 0 END)"


def kept_sql(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {sql_strip('x')}), lambda x: x <> '')"


def stat_sentences_sql(text: str) -> str:
    return kept_sql(f"string_split_regex({text}, {quoted(B.STAT_BREAK)})")


def sentences_sql(text: str) -> str:
    t = sql_strip(text)
    found = kept_sql(f"regexp_extract_all({t}, {quoted(B.SENTENCE)})")
    return f"(CASE WHEN {t} = '' THEN []::VARCHAR[] WHEN starts_with({t}, '```') OR starts_with({t}, '#') OR starts_with({t}, '|') OR len({found}) = 0 THEN [{t}] ELSE {found} END)"


def lines_sql(text: str) -> str:
    return kept_sql(f"string_split_regex({text}, {quoted(B.LINE_BREAK)})")


BLOCK = (
    f"(CASE WHEN regexp_matches(text, '^{WS}*#') THEN 'heading' WHEN starts_with({sql_strip('text')}, '```') OR ends_with({sql_strip('text')}, '```') THEN 'code' "
    f"WHEN len({lines_sql('text')}) > 0 AND len(list_filter({lines_sql('text')}, lambda x: NOT starts_with(x, '|'))) = 0 THEN 'table' "
    f"WHEN len({lines_sql('text')}) > 0 AND len(list_filter({lines_sql('text')}, lambda x: NOT regexp_matches(x, {quoted(B.LIST_ITEM)}))) = 0 THEN 'list' ELSE 'prose' END)"
)
PLAIN = f"length(regexp_replace(text, '{WS}', '', 'g'))"
SPLIT = f"""{corpus_sql()},
split_ AS (SELECT doc_id, {kept_sql(f"string_split_regex(substr(text, {FRONT_END} + 1), {quoted(BREAK)})")} AS parts FROM corpus),
rows_ AS (SELECT doc_id, unnest(parts) AS text, unnest(range(len(parts))) AS paragraph_index FROM split_),
fences AS (SELECT *, {sql_occurrences('text', '```')} AS n FROM rows_),
paragraphs AS (SELECT doc_id, CAST(paragraph_index AS INTEGER) AS paragraph_index, text, (n > 0 OR coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1) AS in_code_fence FROM fences)"""
ELIGIBLE = f"(NOT in_code_fence AND {PLAIN} >= {B.MIN_CHARS} AND len({stat_sentences_sql('text')}) >= {B.MIN_SENTENCES} AND {BLOCK} = 'prose')"


def matches_sql(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, {quoted(p)}))" for p in patterns) + ")"


def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {sql_rounded(f'({a})::DOUBLE / {b}', 4)} ELSE 0.0 END)"


CONNECT = "(" + " + ".join(sql_occurrences("text", c) for c in L.CONNECTORS) + ")"


def features_sql(source: str) -> str:
    """CTE features: doc_id, paragraph_index, text of source and all features."""
    return f"""raw_ AS (SELECT doc_id, paragraph_index, text, list_transform({stat_sentences_sql('text')}, lambda s: length(s)) AS lengths, regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]+') AS words FROM {source}),
sums AS (SELECT *, len(lengths) AS n, coalesce(list_sum(lengths), 0) AS total, coalesce(list_sum(list_transform(lengths, lambda v: v * v)), 0) AS squares FROM raw_),
moments AS (SELECT *, CASE WHEN n > 0 THEN total::DOUBLE / n ELSE 0.0 END AS mean, CASE WHEN n > 0 THEN sqrt((squares * n - total * total)::DOUBLE / (n * n)) ELSE 0.0 END AS spread,
  [abs(lengths[i + 1] - lengths[i]) for i in range(1, n)] AS deltas FROM sums),
islands AS (SELECT doc_id, paragraph_index, count(*) AS groups FROM (
  SELECT doc_id, paragraph_index, island FROM (
    SELECT doc_id, paragraph_index, i, sum(brk) OVER (PARTITION BY doc_id, paragraph_index ORDER BY i) AS island FROM (
      SELECT doc_id, paragraph_index, i, CASE WHEN i > 1 AND abs(lengths[i] - lengths[i - 1]) <= {S.TOLERANCE} THEN 0 ELSE 1 END AS brk
      FROM (SELECT doc_id, paragraph_index, lengths, unnest(range(1, n + 1)) AS i FROM moments)))
  GROUP BY doc_id, paragraph_index, island HAVING count(*) >= 3) GROUP BY doc_id, paragraph_index),
features AS (SELECT m.doc_id, m.paragraph_index, text, CAST(length(text) AS BIGINT) AS char_count, CAST(len({kept_sql(f"string_split_regex(text, {quoted(BREAK)})")}) AS BIGINT) AS paragraph_count,
  CAST(n AS BIGINT) AS sentence_count, CAST(len(words) AS BIGINT) AS word_count, {sql_rounded('mean', 2)} AS sentence_length_mean, {sql_rounded('spread', 2)} AS sentence_length_std,
  CASE WHEN mean > 0 THEN {sql_rounded('spread / mean', 4)} ELSE 0.0 END AS sentence_length_cv,
  CASE WHEN n >= 2 THEN {sql_rounded('list_sum(deltas)::DOUBLE / (n - 1)', 4)} ELSE 0.0 END AS adjacent_length_delta_mean,
  {ratio_sql('len(list_filter(lengths, lambda v: 2 * v * n <= total OR 2 * v * n >= 3 * total))', 'n')} AS extreme_sentence_ratio,
  CAST(len(list_distinct(words)) AS BIGINT) AS unique_words, {ratio_sql('len(list_distinct(words))', 'len(words)')} AS lexical_diversity,
  CASE WHEN length(text) > 0 THEN {sql_rounded(f'{CONNECT}::DOUBLE / length(text) * 100', 4)} ELSE 0.0 END AS connector_density,
  {ratio_sql(matches_sql('text', L.PASSIVE), 'n')} AS passive_ratio, {ratio_sql(sql_occurrences('text', '，') + ' + ' + sql_occurrences('text', ','), 'n')} AS comma_density,
  {ratio_sql(matches_sql('text', L.DASH), 'n')} AS dash_density, CAST({matches_sql('text', L.THREE_PART)} AS BIGINT) AS three_part_enumeration_count,
  CAST({matches_sql('text', L.META)} AS BIGINT) AS meta_discourse_count, CAST(coalesce(groups, 0) AS BIGINT) AS uniform_sentence_group_count
  FROM moments m LEFT JOIN islands USING (doc_id, paragraph_index))"""


#: Predicate and score of each anomaly, in order.
ANOMALY_SQL = [
    ("sentence_length_cv < 0.3 AND sentence_count >= 3", sql_rounded("0.7::DOUBLE - sentence_length_cv", 2)),
    ("adjacent_length_delta_mean < 8 AND sentence_count >= 4", sql_rounded("least(0.75::DOUBLE, 0.82::DOUBLE - adjacent_length_delta_mean / 20)", 2)),
    ("extreme_sentence_ratio < 0.12 AND sentence_count >= 4", sql_rounded("least(0.7::DOUBLE, 0.5::DOUBLE + (0.12::DOUBLE - extreme_sentence_ratio) * 2)", 2)),
    ("uniform_sentence_group_count >= 1 AND sentence_count >= 5", sql_rounded("least(0.85::DOUBLE, 0.6::DOUBLE + uniform_sentence_group_count * 0.15::DOUBLE)", 2)),
    ("connector_density > 2.0", "least(0.9::DOUBLE, connector_density / 3)"),
    ("passive_ratio > 0.5", "least(0.8::DOUBLE, passive_ratio)"),
    ("lexical_diversity < 0.4 AND word_count > 50", sql_rounded("0.8::DOUBLE - lexical_diversity", 2)),
    ("dash_density > 0.3 AND sentence_count >= 3", sql_rounded("least(0.78::DOUBLE, 0.5::DOUBLE + dash_density * 0.3::DOUBLE)", 2)),
    ("three_part_enumeration_count >= 1", sql_rounded("least(0.82::DOUBLE, 0.7::DOUBLE + three_part_enumeration_count * 0.1::DOUBLE)", 2)),
    ("meta_discourse_count >= 1", sql_rounded("least(0.9::DOUBLE, 0.8::DOUBLE + meta_discourse_count * 0.05::DOUBLE)", 2)),
]
ANOMALIES = (
    f"{SPLIT},\neligible AS (SELECT * FROM paragraphs WHERE {ELIGIBLE}),\n{features_sql('eligible')},\nanomalies AS ("
    + " UNION ALL ".join(f"SELECT doc_id, paragraph_index, {i} AS seq, {quoted(r[0])} AS type, CAST({score} AS DOUBLE) AS score FROM features WHERE {when}" for i, (r, (when, score)) in enumerate(zip(S.RULES, ANOMALY_SQL)))
    + ")"
)


def matchers_sql() -> str:
    """CTE matchers: the library's phrases and regexes as values."""
    rows = []
    for case in library.cases():
        seq, case_id, label, severity, hint, dims = case[0], case[1], case[4], case[5], case[8], case[6]
        for place, (kind, pattern, weight) in enumerate(case[9]):
            if kind != "fuzzy":
                rows.append(f"({seq * 1000 + place}, {quoted(case_id)}, {quoted(label)}, {quoted(kind)}, {quoted(pattern)}, {sql_rounded(f'{severity}::DOUBLE * {weight}::DOUBLE', 4)}, {quoted(hint)}, [{', '.join(map(quoted, dims))}])")
    return "matchers(matcher_seq, case_id, label, type, pattern, confidence, rewrite_hint, dims) AS (VALUES " + ", ".join(rows) + ")"


MATCHED = "CASE WHEN m.type = 'regex' THEN regexp_extract(p.text, '(?m)' || m.pattern) WHEN contains(p.text, m.pattern) THEN m.pattern ELSE '' END"


def hits_sql(source: str = "paragraphs") -> str:
    return f"{matchers_sql()},\nall_hits AS (SELECT doc_id, paragraph_index, p.text, m.*, {MATCHED} AS matched_text FROM {source} p, matchers m),\nhits AS (SELECT * FROM all_hits WHERE matched_text <> '')"


PRODUCT = "list_reduce(list_prepend(1.0::DOUBLE, list_transform(list(confidence ORDER BY matcher_seq), lambda c: 1.0::DOUBLE - c)), lambda a, b: a * b)"
SCORE = sql_rounded(f"least(1.0::DOUBLE, (1 - {PRODUCT}) * (1 + 0.05::DOUBLE * greatest(0, len(list_distinct(flatten(list(dims)))) - 1)))", 4)
SCORES = f"scores AS (SELECT doc_id, paragraph_index, any_value(text) AS text, {SCORE} AS score, CAST(count(*) AS BIGINT) AS n_hits FROM hits GROUP BY doc_id, paragraph_index)"


def band_sql(x: str) -> str:
    return f"(CASE WHEN {x} >= 0.8 THEN 'high' WHEN {x} >= 0.6 THEN 'medium' ELSE 'low' END)"


FUSED = f"""{ANOMALIES},
{hits_sql()},
{SCORES},
stat AS (SELECT doc_id, paragraph_index, least(0.7::DOUBLE, list_reduce(list_prepend(0.0::DOUBLE, list(score ORDER BY seq)), lambda a, b: a + b) / count(*)) AS stat_score, count(*) AS n_anomalies FROM anomalies GROUP BY doc_id, paragraph_index),
segments AS (SELECT doc_id, paragraph_index, r.score AS rule_score, stat_score, {sql_rounded('greatest(r.score, stat_score)', 4)} AS risk_score,
  CASE WHEN r.score IS NOT NULL AND stat_score IS NOT NULL THEN 'rule+stat' WHEN r.score IS NOT NULL THEN 'rule' ELSE 'stat' END AS detection_method
  FROM (SELECT * FROM scores WHERE score >= 0.5) r FULL OUTER JOIN stat USING (doc_id, paragraph_index)),
top_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY confidence DESC, matcher_seq) AS place FROM hits) WHERE place <= 3),
signals AS (
  SELECT doc_id, paragraph_index, s.risk_score, place AS seq, case_id AS code, confidence AS score, {band_sql('s.rule_score')} AS severity, 'rule' AS source FROM top_hits JOIN segments s USING (doc_id, paragraph_index) WHERE s.rule_score IS NOT NULL
  UNION ALL
  SELECT doc_id, paragraph_index, s.risk_score, 100 + seq, type, a.score, {band_sql('s.stat_score')}, 'stat' FROM anomalies a JOIN segments s USING (doc_id, paragraph_index))"""


def in_list(x: str, values: list[str]) -> str:
    return f"{x} IN ({', '.join(map(quoted, values))})"


REVIEW = (
    f"(CASE WHEN {in_list('code', L.RHYTHM_CODES)} THEN ['uniform_sentence_length'] WHEN {in_list('code', L.FORCED_CODES)} THEN ['author_fit_low', 'forced_summary'] "
    f"WHEN code = {quoted(L.LADDER_CODE)} THEN ['author_fit_low', 'perfect_ladder'] WHEN starts_with(code, 'zh.fit.') THEN ['author_fit_low'] WHEN source = 'rule' THEN ['cliche_phrase'] "
    f"WHEN {in_list('code', L.CLICHE_STATS)} THEN ['cliche_phrase'] ELSE []::VARCHAR[] END)"
)
PRIMARY = f"list_filter([{', '.join(map(quoted, L.PRIORITY))}], lambda x: list_contains({REVIEW}, x))[1]"


# ---- blocks ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {corpus_sql()} SELECT doc_id, CAST({FRONT_END} AS INTEGER) AS front_chars, length(substr(text, {FRONT_END} + 1)) AS body_chars, md5(substr(text, {FRONT_END} + 1)) AS body_md5 FROM corpus")
def frontmatter_split(spark, sf_dir):
    """Front matter parted from the body."""
    docs = corpus(spark, sf_dir)
    return docs.select("doc_id", B.frontmatter_end(F.col("text")).cast("int").alias("front_chars"), F.length(B.body(F.col("text"))).cast("bigint").alias("body_chars"), F.md5(B.body(F.col("text"))).alias("body_md5"))


@query(f"WITH {SPLIT} SELECT doc_id, paragraph_index, text FROM paragraphs")
def paragraphs_explode(spark, sf_dir):
    """Paragraphs with their places."""
    return paragraphs(corpus(spark, sf_dir)).select("doc_id", "paragraph_index", "text")


@query(f"WITH {SPLIT} SELECT doc_id, paragraph_index, CAST(i AS INTEGER) AS sentence_index, s AS sentence FROM (SELECT doc_id, paragraph_index, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT doc_id, paragraph_index, {sentences_sql('text')} AS ss FROM paragraphs))")
def sentences_detect(spark, sf_dir):
    """Sentences with their ends, Markdown blocks whole."""
    return sentences(paragraphs(corpus(spark, sf_dir)), "detect")


@query(f"WITH {SPLIT} SELECT doc_id, paragraph_index, CAST(i AS INTEGER) AS sentence_index, s AS sentence FROM (SELECT doc_id, paragraph_index, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT doc_id, paragraph_index, {stat_sentences_sql('text')} AS ss FROM paragraphs))")
def sentences_stats(spark, sf_dir):
    """Sentences as statistics count them."""
    return sentences(paragraphs(corpus(spark, sf_dir)), "stats")


@query(f"WITH {SPLIT} SELECT doc_id, paragraph_index, {BLOCK} AS block_type FROM paragraphs")
def block_types(spark, sf_dir):
    """Heading, code, table, list or prose."""
    return paragraphs(corpus(spark, sf_dir)).select("doc_id", "paragraph_index", B.block_type(F.col("text")).alias("block_type"))


@query(f"WITH {SPLIT} SELECT doc_id, paragraph_index, in_code_fence FROM paragraphs")
def code_fence_state(spark, sf_dir):
    """Whether a paragraph is inside a code fence or has one."""
    return paragraphs(corpus(spark, sf_dir)).select("doc_id", "paragraph_index", "in_code_fence")


@query(f"WITH {SPLIT} SELECT doc_id, paragraph_index, CAST({PLAIN} AS BIGINT) AS plain_chars, {ELIGIBLE} AS eligible FROM paragraphs")
def stat_eligible(spark, sf_dir):
    """Plain length, and whether statistics mean anything."""
    rows = paragraphs(corpus(spark, sf_dir))
    return rows.select("doc_id", "paragraph_index", B.plain_length(F.col("text")).cast("bigint").alias("plain_chars"), (~F.col("in_code_fence") & B.eligible(F.col("text"))).alias("eligible"))


@query()
def spans_lookup(spark, sf_dir):
    """Paragraph spans of the body and the span of its middle position."""
    from .functions.spans import paragraph_spans

    rows = corpus(spark, sf_dir).select("doc_id", B.body(F.col("text")).alias("body")).withColumn("spans", paragraph_spans("body"))
    middle = F.floor(F.length("body") / 2).cast("int")
    return rows.select("doc_id", F.size("spans").alias("n_spans"), middle.alias("pos"), B.span_index(F.col("spans"), middle).alias("span"))


# ---- library -----------------------------------------------------------------------------------------------------------------


def _cases_sql() -> str:
    arr = lambda x: "[" + ", ".join(map(quoted, x)) + "]::VARCHAR[]"
    rows = [f"({c[0]}, {quoted(c[1])}, {arr(c[3])}, {quoted(c[4])}, {quoted(c[7])}, {quoted(c[10] or '')}, {arr(c[12])}, {quoted(c[8])})" for c in library.cases()]
    return "cases(case_seq, id, genres, label, description, why, examples, rewrite_hint) AS (VALUES " + ", ".join(rows) + ")"


@query(f"WITH {_cases_sql()} SELECT case_seq, id FROM cases WHERE list_has_any(genres, ['narrative', 'academic'])")
def genre_any_filter(spark, sf_dir):
    """Cases of any of the genres."""
    return library.load_cases(spark).where(library.any_genre(["narrative", "academic"])).select("case_seq", "id")


@query(f"WITH {_cases_sql()} SELECT id FROM cases WHERE list_contains(genres, 'narrative')")
def genre_first_filter(spark, sf_dir):
    """Index rows of the first genre only."""
    return retrieval.where(retrieval.index_rows(library.load_cases(spark)), "zh", ["narrative", "academic"]).select("id")


DOCUMENT_SQL = sql_strip("label || chr(10) || description || chr(10) || why || chr(10) || array_to_string(examples, ' ') || chr(10) || rewrite_hint")


@query(f"WITH {_cases_sql()} SELECT id, {DOCUMENT_SQL} AS document FROM cases")
def case_documents(spark, sf_dir):
    """The text under which each case is indexed."""
    return library.load_cases(spark).select("id", library.document().alias("document"))


@query(f"WITH {_cases_sql()} SELECT id, CASE WHEN list_contains(genres, 'narrative') THEN upper(id) ELSE {DOCUMENT_SQL} END AS document FROM cases UNION ALL SELECT 'zh.new.case', 'new'")
def index_upsert(spark, sf_dir):
    """The index after an upsert of changed and new rows."""
    rows = library.load_cases(spark).select("id", "genres", library.document().alias("document"))
    fresh = rows.where(F.array_contains("genres", "narrative")).select("id", F.upper("id").alias("document")).union(spark.createDataFrame([("zh.new.case", "new")], "id string, document string"))
    return rows.select("id", "document").join(fresh, "id", "left_anti").unionByName(fresh)


# ---- rules -------------------------------------------------------------------------------------------------------------------


def _hits(spark, sf_dir) -> DataFrame:
    return rules.rule_hits(paragraphs(corpus(spark, sf_dir)), library.matchers(library.load_cases(spark)), fuzzy_too=False)


def _hits_of(kinds: str) -> str:
    return f"WITH {SPLIT},\n{hits_sql()} SELECT doc_id, paragraph_index, matcher_seq, case_id, matched_text, confidence FROM hits WHERE type IN ({kinds})"


@query(_hits_of("'phrase', 'substring'"))
def phrase_hits(spark, sf_dir):
    """Hits of phrases, with confidence."""
    return _hits(spark, sf_dir).where("type IN ('phrase', 'substring')").select("doc_id", "paragraph_index", "matcher_seq", "case_id", "matched_text", "confidence")


@query(_hits_of("'regex'"))
def regex_hits(spark, sf_dir):
    """Hits of regular expressions, with what they match."""
    return _hits(spark, sf_dir).where("type = 'regex'").select("doc_id", "paragraph_index", "matcher_seq", "case_id", "matched_text", "confidence")


@query(f"WITH {SPLIT},\n{hits_sql()},\n{SCORES} SELECT doc_id, paragraph_index, score, {band_sql('score')} AS risk_level, n_hits FROM scores")
def paragraph_scores(spark, sf_dir):
    """Complement-product score and risk band of each paragraph with a hit."""
    scored = rules.paragraph_scores(_hits(spark, sf_dir))
    return scored.select("doc_id", "paragraph_index", "score", fusion.band(F.col("score")).alias("risk_level"), F.size("hits").cast("bigint").alias("n_hits"))


@query("SELECT item_id, array_to_string(list_sort(list_filter(string_split_regex(text, '[\\t-\\r ]+'), lambda x: x <> '')), ' ') AS sorted_tokens FROM benchmark")
def token_sort_keys(spark, sf_dir):
    """The key of the token-sort similarity."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select("item_id", F.array_join(F.array_sort(F.filter(F.split("text", "[\\t-\\r ]+"), lambda x: x != "")), " ").alias("sorted_tokens"))


def _fuzzy(spark, sf_dir, algorithm: str) -> DataFrame:
    """Each benchmark item against a phrase of its own, its reversed words, and its neighbour in order of number."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    pairs = items.join(other, "item_id").select("item_id", F.explode(F.array(F.substring("text", 20, 30), F.array_join(F.reverse(F.split("text", " ")), " "), F.col("other"))).alias("pattern"), "text")
    return pairs.select("item_id", F.md5("pattern").alias("pattern"), Z.score(algorithm)("pattern", "text").alias("score"))


@query()
def fuzzy_ratio(spark, sf_dir):
    """Normalised Indel similarity."""
    return _fuzzy(spark, sf_dir, "ratio")


@query()
def fuzzy_partial(spark, sf_dir):
    """Best window similarity."""
    return _fuzzy(spark, sf_dir, "partial_ratio")


@query()
def fuzzy_token_sort(spark, sf_dir):
    """Similarity of sorted tokens."""
    return _fuzzy(spark, sf_dir, "token_sort_ratio")


@query()
def fuzzy_token_set(spark, sf_dir):
    """Similarity of token sets."""
    return _fuzzy(spark, sf_dir, "token_set_ratio")


# ---- statistics --------------------------------------------------------------------------------------------------------------

#: Paragraphs of the corpus and whole documents, which have long sentences.
BOTH = f"{SPLIT},\nboth_ AS (SELECT doc_id, paragraph_index, text FROM paragraphs UNION ALL SELECT doc_id, -1, coalesce(text, '') FROM documents)"


def _features(spark, sf_dir, columns: list[str]) -> DataFrame:
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(-1).alias("paragraph_index"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paragraphs(corpus(spark, sf_dir)).select("doc_id", "paragraph_index", "text").union(whole)
    return rows.select("doc_id", "paragraph_index", S.features(F.col("text"), columns).alias("f"))


def _feature_query(name: str, doc: str, columns: list[str]) -> None:
    def run(spark, sf_dir):
        return _features(spark, sf_dir, columns).select("doc_id", "paragraph_index", *[F.col(f"f.{c}").alias(c) for c in columns])

    run.__name__, run.__doc__ = name, doc
    query(f"WITH {BOTH},\n{features_sql('both_')} SELECT doc_id, paragraph_index, {', '.join(columns)} FROM features")(run)


_feature_query("sentence_length_stats", "Counts, mean, deviation, variation, steps and extremes of sentence lengths.", ["char_count", "paragraph_count", "sentence_count", "sentence_length_mean", "sentence_length_std", "sentence_length_cv", "adjacent_length_delta_mean", "extreme_sentence_ratio"])
_feature_query("lexical_diversity", "Runs of Chinese characters and how many differ.", ["word_count", "unique_words", "lexical_diversity"])
_feature_query("connector_density", "Connectors for each hundred characters.", ["connector_density"])
_feature_query("passive_ratio", "Passive marks for each sentence.", ["passive_ratio"])
_feature_query("punctuation_density", "Commas and explaining dashes for each sentence.", ["comma_density", "dash_density"])
_feature_query("enumeration_meta_counts", "Three-part enumerations and talk about the text.", ["three_part_enumeration_count", "meta_discourse_count"])
_feature_query("uniform_groups", "Runs of sentences of like length; the SQL finds them as islands.", ["uniform_sentence_group_count"])


@query(f"WITH {ANOMALIES} SELECT doc_id, paragraph_index, type, score FROM anomalies")
def anomalies(spark, sf_dir):
    """Anomalies of eligible paragraphs."""
    found = fusion.anomalies(paragraphs(corpus(spark, sf_dir)))
    return found.select("doc_id", "paragraph_index", F.explode("anomalies").alias("a")).select("doc_id", "paragraph_index", F.col("a.type").alias("type"), F.col("a.score").alias("score"))


# ---- fusion and reports ------------------------------------------------------------------------------------------------------


def _segments(spark, sf_dir) -> DataFrame:
    return plans.segments(corpus(spark, sf_dir), fuzzy=False)


@query(f"WITH {FUSED} SELECT doc_id, paragraph_index, rule_score, stat_score, risk_score, {band_sql('risk_score')} AS risk_level, detection_method FROM segments")
def fused_segments(spark, sf_dir):
    """Paragraphs marked by rules or statistics."""
    return _segments(spark, sf_dir).select("doc_id", "paragraph_index", "rule_score", "stat_score", "risk_score", "risk_level", "detection_method")


@query(f"WITH {FUSED} SELECT doc_id, paragraph_index, code, score, severity FROM signals WHERE source = 'rule'")
def top3_signals(spark, sf_dir):
    """The three most confident rule hits of each marked paragraph."""
    signals = _segments(spark, sf_dir).select("doc_id", "paragraph_index", F.explode("signals").alias("s")).where("s.source = 'rule'")
    return signals.select("doc_id", "paragraph_index", F.col("s.code").alias("code"), F.col("s.score").alias("score"), F.col("s.severity").alias("severity"))


@query(f"WITH {FUSED} SELECT doc_id, paragraph_index, code, array_to_string({REVIEW}, ',') AS review_signals, {PRIMARY} AS review_signal FROM signals")
def review_signals(spark, sf_dir):
    """Review signals of each signal, and the primary one."""
    signals = _segments(spark, sf_dir).select("doc_id", "paragraph_index", F.explode("signals").alias("s"))
    return signals.select("doc_id", "paragraph_index", F.col("s.code").alias("code"), F.array_join("s.review_signals", ",").alias("review_signals"), F.col("s.review_signal").alias("review_signal"))


def _scores(spark, sf_dir) -> DataFrame:
    """Scores and summaries; basic info and statistics are those of sentence_length_stats and others."""
    return fusion.reports(corpus(spark, sf_dir), _segments(spark, sf_dir), statistics=False)


ORDERED = "PARTITION BY doc_id ORDER BY risk_score DESC, paragraph_index"


@query(f"""WITH {FUSED},
ranked AS (SELECT *, row_number() OVER ({ORDERED}) AS place FROM segments),
firsts AS (SELECT doc_id, paragraph_index, arg_min(code, seq) AS code FROM signals GROUP BY doc_id, paragraph_index),
issues AS (SELECT doc_id, string_agg(code, ',' ORDER BY place) AS top_issues FROM ranked JOIN firsts USING (doc_id, paragraph_index) WHERE place <= 3 GROUP BY doc_id),
primaries AS (SELECT doc_id, {PRIMARY} AS s, place, seq FROM signals JOIN ranked USING (doc_id, paragraph_index)),
first_of AS (SELECT doc_id, s, min(place * 1000 + seq) AS k FROM primaries WHERE s IS NOT NULL GROUP BY doc_id, s),
five AS (SELECT doc_id, string_agg(s, ',' ORDER BY k) AS top_review_signals FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM first_of) WHERE r <= 5 GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {band_sql('risk_score')} = 'high') AS high, count(*) FILTER (WHERE {band_sql('risk_score')} = 'medium') AS medium FROM segments GROUP BY doc_id)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS total_segments_checked, CAST(coalesce(n, 0) AS BIGINT) AS suspected_segments_count, CAST(coalesce(high, 0) AS BIGINT) AS high_risk_count, CAST(coalesce(medium, 0) AS BIGINT) AS medium_risk_count,
  coalesce(top_issues, '') AS top_issues, coalesce(top_review_signals, '') AS top_review_signals, CASE WHEN coalesce(high, 0) + coalesce(medium, 0) > 0 THEN 'retry' ELSE 'accept' END AS stop_or_retry
FROM split_ LEFT JOIN counts USING (doc_id) LEFT JOIN issues USING (doc_id) LEFT JOIN five USING (doc_id)""")
def doc_summary(spark, sf_dir):
    """Counts, top issues and review signals of each document."""
    s = _scores(spark, sf_dir).select("doc_id", "summary.*")
    return s.select("doc_id", "total_segments_checked", "suspected_segments_count", "high_risk_count", "medium_risk_count", F.array_join("top_issues", ",").alias("top_issues"), F.array_join("top_review_signals", ",").alias("top_review_signals"), "stop_or_retry")


@query(f"""WITH {FUSED},
best AS (SELECT doc_id, paragraph_index, risk_score, max(score) AS every, max(score) FILTER (WHERE starts_with(code, 'zh.fit.')) AS fit FROM signals GROUP BY ALL),
doc_sums AS (SELECT doc_id, list_reduce(list_prepend(0.0::DOUBLE, list(coalesce(every, 0.0) ORDER BY risk_score DESC, paragraph_index)), lambda a, b: a + b) AS every,
  list_reduce(list_prepend(0.0::DOUBLE, list(coalesce(fit, 0.0) ORDER BY risk_score DESC, paragraph_index)), lambda a, b: a + b) AS fit FROM best GROUP BY doc_id),
final AS (SELECT doc_id, {sql_rounded('coalesce(every, 0.0) / greatest(len(parts), 1)', 4)} AS overall_risk, {sql_rounded('coalesce(fit, 0.0) / greatest(len(parts), 1)', 4)} AS author_fit_risk, every IS NOT NULL AS any_segment FROM split_ LEFT JOIN doc_sums USING (doc_id))
SELECT doc_id, overall_risk, author_fit_risk, {sql_rounded('greatest(0.0::DOUBLE, 1 - author_fit_risk)', 4)} AS author_fit, CASE WHEN any_segment THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM final""")
def doc_scores(spark, sf_dir):
    """Risk, author fit and confidence of each document."""
    return _scores(spark, sf_dir).select("doc_id", "document_score.*")


@query(f"WITH {SPLIT} SELECT doc_id, paragraph_index, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS text_excerpt FROM paragraphs")
def excerpts(spark, sf_dir):
    """Long and short excerpts of paragraphs."""
    return paragraphs(corpus(spark, sf_dir)).select("doc_id", "paragraph_index", fusion.excerpt(F.col("text"), 200).alias("text"), fusion.excerpt(F.col("text"), 120).alias("text_excerpt"))


@query()
def full_reports(spark, sf_dir):
    """The whole report of each document, fuzzy matchers included, as JSON."""
    from .sources.texts import to_json_rows

    return to_json_rows(plans.analyze(corpus(spark, sf_dir)))


@query()
def legacy_detection(spark, sf_dir):
    """Paragraph scores with the plain detection's fuzzy settings."""
    found = plans.detect(corpus(spark, sf_dir))
    return found.select("doc_id", "paragraph_index", "score", F.size("hits").alias("n_hits"))


# ---- retrieval ---------------------------------------------------------------------------------------------------------------

#: Rows of these numbers are queries against all rows.
QUERY_EVERY = 20


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Queries and index: every row is indexed. The text of a vector is that of the document of its number, if there is one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("document"))
    index = rows.join(texts, "vec_id", "left").withColumnRenamed("vec_id", "id")
    return index.where(F.col("id") % QUERY_EVERY == 0).select(F.col("id").alias("query_id"), "vector", F.col("document").alias("text")), index


COSINE = "(list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(q) + 1), lambda i: q[i]::DOUBLE * v[i]::DOUBLE)), lambda a, b: a + b) / (sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)), lambda a, b: a + b)) * sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)), lambda a, b: a + b))))"
KNN = f"""pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.embedding AS q, b.embedding AS v FROM embeddings a, embeddings b WHERE a.vec_id % {QUERY_EVERY} = 0),
near AS (SELECT query_id, id, {sql_rounded(COSINE, 6)} AS similarity FROM pairs),
knn AS (SELECT * FROM (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM near) WHERE rank <= 5)"""


def _near(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.knn_in_blocks(rows.where(F.col("id") % QUERY_EVERY == 0).withColumnRenamed("id", "query_id"), rows)


@query(f"WITH {KNN} SELECT query_id, id, similarity, CAST(rank AS INTEGER) AS rank FROM knn")
def knn_topk(spark, sf_dir):
    """The five most similar of all vectors, for every twentieth."""
    return _near(spark, sf_dir).select("query_id", "id", "similarity", "rank")


HYBRID = f"""{KNN},
texts AS (SELECT vec_id AS id, text FROM embeddings JOIN documents ON vec_id = doc_id),
lex AS (SELECT * FROM (SELECT q.id AS query_id, d.id, row_number() OVER (PARTITION BY q.id ORDER BY d.id) AS rank FROM texts q JOIN texts d ON contains(d.text, substr(q.text, 1, {retrieval.LEAD})) WHERE q.id % {QUERY_EVERY} = 0) WHERE rank <= 5),
legs AS (SELECT query_id, id, rank FROM lex UNION ALL SELECT query_id, id, rank FROM knn),
fused AS (SELECT query_id, id, {sql_rounded('sum(1.0::DOUBLE / (60 + rank))', 8)} AS fused FROM legs GROUP BY query_id, id),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM fused) WHERE rank <= 5)"""


@query(f"WITH {HYBRID} SELECT query_id, id, fused, CAST(rank AS INTEGER) AS rank FROM hybrid")
def hybrid_rrf(spark, sf_dir):
    """The nearest vectors, and the documents that contain the query's first characters, fused by reciprocal ranks."""
    queries, index = _vectors(spark, sf_dir)
    return retrieval.fuse([retrieval.lexical_in_blocks(queries, index), retrieval.knn_in_blocks(queries, index)]).select("query_id", "id", "fused", "rank")


@query(f"""WITH {KNN}, scored AS (SELECT query_id // {10 * QUERY_EVERY} AS doc_id, CAST(query_id // {QUERY_EVERY} % 3 AS INTEGER) AS paragraph_index, query_id // {QUERY_EVERY} % 10 AS sentence, rank, id AS case_id, {sql_rounded('greatest(0.0::DOUBLE, similarity)', 4)} AS score FROM knn),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, paragraph_index, case_id ORDER BY score DESC, sentence, rank) AS n FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY score DESC, sentence, rank, case_id) AS place FROM best WHERE n = 1)
SELECT doc_id, paragraph_index, case_id, score FROM placed WHERE place <= 5""")
def retrieval_merge(spark, sf_dir):
    """Queries as sentences of paragraphs: the best score of each case, then the five best."""
    place = F.floor(F.col("query_id") / QUERY_EVERY)
    score = rounded(F.greatest(F.lit(0.0), F.col("similarity")), 4)
    rows = _near(spark, sf_dir).select(F.floor(place / 10).alias("doc_id"), (place % 3).cast("int").alias("paragraph_index"), (place % 10).cast("int").alias("sentence_index"), "rank", F.col("id").alias("case_id"), score.alias("score"))
    return retrieval.best_of_paragraph(rows).select("doc_id", "paragraph_index", "case_id", "score")


@query()
def case_search(spark, sf_dir):
    """All distinct sentences of the corpus against the case index, hybrid."""
    found = sentences(paragraphs(corpus(spark, sf_dir)))
    distinct = found.select("sentence").distinct().select(F.md5("sentence").alias("query_id"), F.col("sentence").alias("text"))
    return retrieval.search(distinct, retrieval.index_rows(library.load_cases(spark)), held=True).select("query_id", "case_id", "score", "rank")


# ---- probability -------------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS window_index, CAST(length(substr(text, i * 128 + 1, 256)) AS BIGINT) AS n_chars, md5(substr(text, i * 128 + 1, 256)) AS text_md5
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 256 THEN 1 ELSE CAST(ceil((length(text) - 256) / 128.0) AS BIGINT) + 1 END)) AS i FROM documents WHERE text IS NOT NULL)""")
def text_windows_sliding(spark, sf_dir):
    """Overlapping character windows of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    rows = docs.select("doc_id", F.posexplode(probability.sliding(F.col("text"))).alias("window_index", "w"))
    return rows.select("doc_id", "window_index", F.length("w").cast("bigint").alias("n_chars"), F.md5("w").alias("text_md5"))


FOLD = "{'done': CASE WHEN length(a.open || x.open) >= 256 THEN list_append(a.done, a.open || x.open) ELSE a.done END, 'open': CASE WHEN length(a.open || x.open) >= 256 THEN '' ELSE a.open || x.open END}"
WINDOWS = f"""pieces AS (SELECT row_number() OVER () AS r, doc_id, text, list_transform(regexp_extract_all(text, {quoted(probability.PIECE)}), lambda p: {{'done': []::VARCHAR[], 'open': p}}) AS p FROM documents WHERE length({sql_strip('text')}) >= 50),
folded AS (SELECT r, doc_id, text, list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': ''}}, p), lambda a, x: {FOLD}) AS f FROM pieces),
chunked AS (SELECT r, doc_id, text, CASE WHEN f.open <> '' THEN list_append(f.done, f.open) ELSE f.done END AS c FROM folded),
cut AS (SELECT r, doc_id, CASE WHEN len(c) >= 2 THEN c ELSE list_transform(range(CASE WHEN length(text) <= 256 THEN 1 ELSE CAST(ceil((length(text) - 256) / 128.0) AS BIGINT) + 1 END), lambda i: substr(text, i * 128 + 1, 256)) END AS c FROM chunked),
w AS MATERIALIZED (SELECT r, doc_id, CAST(unnest(range(len(c))) AS INTEGER) AS window_index, unnest(c) AS text FROM cut)"""


@query(f"WITH {WINDOWS}, placed AS (SELECT *, sum(length(text)) OVER (PARTITION BY r ORDER BY window_index) AS upto FROM w) SELECT doc_id, window_index, CAST(upto - length(text) AS INTEGER) AS start_pos, CAST(upto AS INTEGER) AS end_pos FROM placed")
def text_windows_chunks(spark, sf_dir):
    """Windows of whole sentences, or sliding ones where there are too few."""
    return probability.windows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "window_index", "start_pos", "end_pos")


#: Benchmark items are short, so each is one window; a scorer of characters reads them.
TOKENS = """chars AS MATERIALIZED (SELECT doc_id, window_index, i AS pos, substr(text, i, 1) AS c, substr(text, i - 1, 1) AS p FROM (SELECT doc_id, window_index, text, unnest(range(2, length(text) + 1)) AS i FROM w)),
counts AS (SELECT p, c, count(*) AS n FROM chars GROUP BY p, c),
model AS (SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY n DESC, c) AS rank, (n + 0.5::DOUBLE) / (sum(n) OVER (PARTITION BY p) + 0.5::DOUBLE * count(*) OVER (PARTITION BY p)) AS prob FROM counts),
tokens AS MATERIALIZED (SELECT doc_id, window_index, pos, ln(prob + 1e-10) AS ll, rank FROM chars JOIN model USING (p, c))"""
BIGRAMS = f"w AS (SELECT item_id AS doc_id, 0 AS window_index, text FROM benchmark WHERE length({sql_strip('text')}) >= 50),\n{TOKENS}"


def _tokens(spark, sf_dir) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    one = items.where(F.length(strip_(F.col("text"))) >= probability.SHORT).select("doc_id", F.lit(0).alias("window_index"), "text")
    return probability.bigram_tokens(one)


def strip_(c: Column) -> Column:
    from .functions.dialect import strip

    return strip(c)


@query(f"WITH {BIGRAMS} SELECT doc_id, CAST(count(*) AS BIGINT) AS token_count, {sql_rounded('exp(-avg(ll))', 4)} AS ppl, {sql_rounded('avg(ll) / avg(ln(rank + 1))', 4)} AS lrr, {sql_rounded('avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.0 END)', 4)} AS top1_ratio FROM tokens GROUP BY doc_id")
def bigram_window_ppl(spark, sf_dir):
    """Perplexity, likelihood-to-rank ratio and share of first ranks by the character bigram scorer."""
    w = probability.window_scores(_tokens(spark, sf_dir))
    return w.select("doc_id", "token_count", rounded(F.col("ppl"), 4).alias("ppl"), rounded(F.col("lrr"), 4).alias("lrr"), rounded(F.col("top1_ratio"), 4).alias("top1_ratio"))


def share_sql(x: str) -> str:
    return sql_rounded(f"avg(CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0.0 END)", 4)


RANKS = f"ranks AS (SELECT doc_id, {share_sql('rank = 1')} AS top1_ratio, {share_sql('rank <= 5')} AS top5_ratio, {share_sql('rank > 100')} AS rare_ratio, {sql_rounded('sum(rank)::DOUBLE / count(*)', 2)} AS mean_rank, CAST(list_sort(list(rank))[count(*) // 2 + 1] AS BIGINT) AS median_rank FROM tokens GROUP BY doc_id)"


@query(f"WITH {BIGRAMS}, {RANKS} SELECT * FROM ranks")
def rank_distribution(spark, sf_dir):
    """Shares of ranks, mean and upper median."""
    return probability.rank_distribution(_tokens(spark, sf_dir)).drop("n_tokens")


@query(f"""WITH {BIGRAMS}, {RANKS},
base AS (SELECT doc_id, exp(-avg(ll)) AS ppl, avg(ll) / avg(ln(rank + 1)) AS lrr FROM tokens GROUP BY doc_id),
f AS (SELECT doc_id, list_filter([CASE WHEN ppl < 35 THEN 0.8::DOUBLE WHEN ppl < 50 THEN 0.5::DOUBLE END, CASE WHEN lrr > -0.3 THEN 0.9::DOUBLE WHEN lrr > -0.5 THEN 0.6::DOUBLE END, CASE WHEN top1_ratio > 0.7 THEN 0.7::DOUBLE END, CASE WHEN rare_ratio < 0.02 THEN 0.5::DOUBLE END], lambda x: x IS NOT NULL) AS f FROM base JOIN ranks USING (doc_id)),
r AS (SELECT doc_id, CASE WHEN len(f) = 0 THEN 0.0 ELSE {sql_rounded('1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(f, lambda x: 1 - x)), lambda a, b: a * b)', 4)} END AS risk_score FROM f)
SELECT doc_id, risk_score, {band_sql('risk_score')} AS risk_level FROM r""")
def probability_risk(spark, sf_dir):
    """Risk from perplexity, ratio and ranks; each item is one window."""
    tokens = _tokens(spark, sf_dir)
    both = probability.window_scores(tokens).select("doc_id", "ppl", "lrr").join(probability.rank_distribution(tokens), "doc_id")
    risk = probability.risk(probability.factors(F.col("ppl"), F.col("lrr"), F.col("top1_ratio"), F.col("rare_ratio"), F.lit(1)))
    return both.select("doc_id", risk.alias("risk_score"), fusion.band(risk).alias("risk_level"))


def _whole_texts(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query(f"WITH {WINDOWS},\n{TOKENS} SELECT doc_id, window_index, CAST(count(*) AS BIGINT) AS token_count, {sql_rounded('exp(-avg(ll))', 4)} AS ppl, {sql_rounded('avg(ll) / avg(ln(rank + 1))', 4)} AS lrr, {sql_rounded('avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.0 END)', 4)} AS top1_ratio FROM tokens GROUP BY doc_id, window_index HAVING count(*) >= {probability.FEWEST - 1}")
def document_window_ppl(spark, sf_dir):
    """bigram_window_ppl for every window of the documents; the bigrams are those of all windows."""
    w = probability.window_scores(probability.bigram_tokens(probability.windows(_whole_texts(spark, sf_dir))))
    return w.select("doc_id", "window_index", "token_count", *[rounded(F.col(c), 4).alias(c) for c in ("ppl", "lrr", "top1_ratio")])


@query(f"WITH {WINDOWS},\n{TOKENS}, {RANKS} SELECT * FROM ranks")
def document_rank_distribution(spark, sf_dir):
    """rank_distribution over all windows of each document."""
    return probability.rank_distribution(probability.bigram_tokens(probability.windows(_whole_texts(spark, sf_dir)))).drop("n_tokens")


def _wide_sql(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), 2) AS DOUBLE)"


def _of_tokens(x: str) -> str:
    return sql_rounded(f"sum({x})::DOUBLE / sum(n)", 4)


FACTORS = "[CASE WHEN ppl < 35 THEN 0.8::DOUBLE WHEN ppl < 50 THEN 0.5::DOUBLE END, CASE WHEN lrr > -0.3 THEN 0.9::DOUBLE WHEN lrr > -0.5 THEN 0.6::DOUBLE END, CASE WHEN top1_ratio > 0.7 THEN 0.7::DOUBLE END, CASE WHEN rare_word_ratio < 0.02 THEN 0.5::DOUBLE END, CASE WHEN local >= 2 THEN 0.6::DOUBLE END]"
REPORT = f"""each AS (SELECT doc_id, window_index, count(*) AS n, sum(ll) AS ll, sum(ln(rank + 1)) AS lr, count(*) FILTER (WHERE rank = 1) AS n1, count(*) FILTER (WHERE rank <= 5) AS n5, count(*) FILTER (WHERE rank > 100) AS rare, sum(rank) AS of_ranks, list(rank) AS ranks
  FROM tokens GROUP BY doc_id, window_index HAVING count(*) >= {probability.FEWEST - 1}),
sums AS (SELECT doc_id, sum(exp(-ll / n)) / count(*) AS ppl, min(exp(-ll / n)) AS low, max(exp(-ll / n)) AS high, var_pop(exp(-ll / n)) AS var, count(*) FILTER (WHERE exp(-ll / n) < 25) AS local, min(window_index) AS first_window, sum(ll) / sum(n) AS avg_ll, sum(lr) / sum(n) AS avg_lr, sum(ll) / sum(lr) AS lrr,
  {_of_tokens('n1')} AS top1_ratio, {_of_tokens('n5')} AS top5_ratio, {_of_tokens('rare')} AS rare_word_ratio, {sql_rounded('sum(of_ranks)::DOUBLE / sum(n)', 2)} AS mean_rank, CAST(list_sort(flatten(list(ranks)))[CAST(sum(n) AS BIGINT) // 2 + 1] AS BIGINT) AS median_rank FROM each GROUP BY doc_id),
judged AS (SELECT *, list_filter({FACTORS}, lambda x: x IS NOT NULL) AS f FROM sums),
risks AS (SELECT *, CASE WHEN len(f) = 0 THEN 0.0::DOUBLE ELSE {sql_rounded('1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(f, lambda x: 1 - x)), lambda a, b: a * b)', 4)} END AS risk_score FROM judged)
SELECT doc_id, {_wide_sql('ppl')} AS overall_ppl, {_wide_sql('low')} AS min_ppl, {_wide_sql('high')} AS max_ppl, {_wide_sql('var')} AS ppl_variance, {sql_rounded('lrr', 4)} AS lrr_score, {sql_rounded('avg_ll', 4)} AS avg_log_likelihood, {sql_rounded('avg_lr', 4)} AS avg_log_rank,
  top1_ratio, top5_ratio, rare_word_ratio, mean_rank, median_rank, risk_score, {band_sql('risk_score')} AS risk_level FROM risks
UNION ALL SELECT doc_id, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 'low' FROM documents WHERE NOT coalesce(length({sql_strip('text')}) >= 50, false)"""


@query(f"WITH {WINDOWS},\n{TOKENS},\n{REPORT}")
def probability_report(spark, sf_dir):
    """The whole probability report of the documents, over all their windows; the ranks of short texts are 0."""
    report = probability.probability(_whole_texts(spark, sf_dir)).drop("reasons", "suggestions", "first_window")
    return report.withColumns({c: F.coalesce(c, F.lit(0).cast(report.schema[c].dataType)) for c in ("mean_rank", "median_rank")})


# ---- rewrites ----------------------------------------------------------------------------------------------------------------


def _simple_sql(text: str) -> str:
    return sql_strip(f"regexp_replace(replace(regexp_replace(regexp_replace({text}, {quoted(L.IMPORTANT)}, '', 'g'), {quoted(L.ESSENCE)}, '', 'g'), {quoted(L.ROOT)}, {quoted(L.KEY)}), '[ \\t]{{2,}}', ' ', 'g')")


@query(f"WITH {SPLIT} SELECT doc_id, paragraph_index, {_simple_sql('text')} AS rewritten FROM paragraphs")
def rewrite_simple(spark, sf_dir):
    """Replacements without a callback, with all gates open."""
    codes = F.array(F.lit("zh.arg.truly_important"), F.lit("zh.arg.meta_essence"))
    return paragraphs(corpus(spark, sf_dir)).select("doc_id", "paragraph_index", RW.simple(F.col("text"), codes).alias("rewritten"))


@query()
def rewrite_not_but(spark, sf_dir):
    """Documents with the rewrites that their signals call for."""
    docs = corpus(spark, sf_dir)
    return plans.rewritten(docs)
