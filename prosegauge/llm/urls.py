"""URL filters by a path-template tree, with DataFrame functions only.

Rules of host and path label the pages they fit. The paths of a host form a tree of segments (from the ``DEEPEST`` on one
segment), grown level by level; runs of digits are ``*`` from the start. At each node, whatever its depth, its children are
generalised:

- a child of at most 1 / ``MOST_CHILDREN`` of its node's pages is a variable segment;
- a labelled child whose pages go on below it (number and form of the further segments) as all of the node's pages do, within
  ``VARIATION`` of total variation, is like its siblings;
- label shares are held apart first: by a test of two shares (``DEVIATIONS``) a child has the share of its siblings, a higher or
  a lower one.

Variable and alike children of the same kind of share become one wildcard (``*``, ``*+``, ``*-``); a single one keeps its name, and so
do all others. Each child is held against its siblings taken together, never pair by pair. The tree goes on below the wildcards.

Purity is the smoothed share of blocked pages among the labelled ones:
P(host, node) = (blocked + k P(host, parent) + WEIGHT Q) / (labelled + k + WEIGHT), k = min(labelled pages of the parent, WEIGHT),
where Q is the mean, over the node's pages, of the share of the same literal path in all hosts, itself smoothed from parent to
child: Q(path) = (blocked + WEIGHT Q(parent)) / (labelled + WEIGHT), from ``PRIOR`` at the top. So labels reach pages without any,
through wildcards, parents and other hosts. A template of ``REJECT`` or more is rejected, and with it its pages that no rule fits.

Cases: a null url, or one without ``://``, has an empty host and path, no rule, and is judged as a template of the empty host;
repeated rows count each; of equally long rules the first by text wins; extra columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: The contract's rules, host and path, and verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEEPEST, MOST_CHILDREN = 16, 50
#: Prior share of blocked pages, the weight of what a share is smoothed to, and the purity at which a template is rejected.
PRIOR, WEIGHT, REJECT = 0.1, 5.0, 0.8
#: Most total variation between a child and its node to be alike; deviations from which two label shares differ.
VARIATION, DEVIATIONS = 0.15, 3.0
#: Shares are added up in whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitted(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r), reverse=False):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The path's segments with digits as wildcards; from the deepest level on they are one."""
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "*"), "/"))
    deep = F.concat(F.slice(parts, 1, DEEPEST - 1), F.array(F.array_join(F.slice(parts, DEEPEST, 1 << 30), "/")))
    return F.when(F.size(parts) > DEEPEST, deep).otherwise(parts)


def form(rest: Column) -> Column:
    """What a path is like below a child: its further segments with letters as one."""
    return F.regexp_replace(F.array_join(rest, "/"), "[^/.*]+", "a")


def smoothed(blocked: Column, labelled: Column, to: Column) -> Column:
    return (blocked + WEIGHT * to) / (labelled + WEIGHT)


def _sums(prefix: str = "") -> list[Column]:
    return [F.sum(x).alias(prefix + x) for x in ("n", "blocked", "labelled")]


def named(rows: DataFrame) -> DataFrame:
    """host, node, seg, name: what each child of a node is called in the tree. rows: host, node, seg, form, n, blocked, labelled."""
    forms = rows.groupBy("host", "node", "seg", "form").agg(*_sums())
    kids = forms.groupBy("host", "node", "seg").agg(*_sums())
    nodes = kids.groupBy("host", "node").agg(*_sums("all_"))
    pooled = forms.groupBy("host", "node", "form").agg(F.sum("n").alias("form_n"))
    both = forms.select("host", "node", "seg", "form", F.col("n").alias("own_n")).join(pooled, ["host", "node", "form"]).join(kids, ["host", "node", "seg"]).join(nodes, ["host", "node"])
    own, all_ = F.col("own_n") / F.col("n"), F.col("form_n") / F.col("all_n")
    # forms that a child lacks add the share of the node's pages that its own forms don't meet
    near = both.groupBy("host", "node", "seg", "n", "blocked", "labelled", "all_n", "all_blocked", "all_labelled").agg(F.sum(F.abs(own - all_)).alias("near"), F.sum(all_).alias("met"))
    others, share = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") / F.col("all_labelled")
    gap = F.col("blocked") / F.col("labelled") - (F.col("all_blocked") - F.col("blocked")) / others
    apart = F.abs(gap) > DEVIATIONS * F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / others)) + 1e-9
    side = F.when((F.col("labelled") == 0) | (others == 0), "").when(~apart, "").when(gap > 0, "+").otherwise("-")
    variable = F.col("n") * MOST_CHILDREN <= F.col("all_n")
    alike = (F.col("labelled") > 0) & ((F.col("near") + 1 - F.col("met")) / 2 <= VARIATION + 1e-9)
    general = near.select("host", "node", "seg", F.when(variable | alike, F.concat(F.lit("*"), side)).alias("general"))
    alone = general.where("general IS NOT NULL").groupBy("host", "node", "general").agg(F.min("seg").alias("least"), F.max("seg").alias("most")).where("least = most").select("host", "node", "general", F.lit(True).alias("alone"))
    return general.join(alone, ["host", "node", "general"], "left").select("host", "node", "seg", F.when(F.col("general").isNull() | F.col("alone"), F.col("seg")).otherwise(F.col("general")).alias("name"))


def templates(leaves: DataFrame) -> DataFrame:
    """host, segs, template, purity of each distinct path. leaves: host, segs, n, blocked, labelled."""
    top = leaves.agg(F.sum("blocked"), F.sum("labelled"), F.max(F.size("segs"))).first()
    share = ((top[0] or 0) + PRIOR * WEIGHT) / ((top[1] or 0) + WEIGHT)
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("known"), smoothed(F.sum("blocked"), F.sum("labelled"), F.lit(share)).alias("purity"))
    live = leaves.join(hosts, "host").select("*", F.lit("").alias("path"), F.lit("").alias("node"), F.lit(share).alias("pool"))
    done = [live.where(F.size("segs") == 0)]
    for d in range(top[2] or 0):
        rows = live.where(F.size("segs") > d).withColumn("seg", F.get("segs", F.lit(d))).withColumn("form", form(F.slice("segs", d + 2, 1 << 30))).withColumn("path", F.concat_ws("/", "path", "seg"))
        of_path = rows.groupBy("path").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
        rows = rows.join(of_path, "path").withColumn("pool", smoothed(F.col("b"), F.col("l"), F.col("pool"))).drop("b", "l")
        rows = stored(rows.join(named(rows), ["host", "node", "seg"]).withColumn("node", F.concat_ws("/", "node", "name")).drop("seg", "form", "name"), "url-level")
        pool = F.sum((F.col("n") * F.round(F.col("pool") * UNIT).cast("bigint")).cast("decimal(38,0)")).cast("double") / UNIT / F.sum("n")
        nodes = rows.groupBy("host", "node").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), pool.alias("q"))
        k = F.least(F.col("known").cast("double"), F.lit(WEIGHT))
        purity = (F.col("b") + k * F.col("purity") + WEIGHT * F.col("q")) / (F.col("l") + k + WEIGHT)
        live = stored(rows.join(nodes, ["host", "node"]).withColumn("purity", purity).withColumn("known", F.col("l")).drop("b", "l", "q"), "url-nodes")
        done.append(live.where(F.size("segs") == d + 1))
    kept = [x.select("host", "segs", F.concat("host", "node").alias("template"), "purity") for x in done]
    return reduce(DataFrame.union, kept)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, template, purity of each page."""
    host, path = parsed(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitted(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    blocked = F.sum((F.col("fit.verdict") == "block").cast("long"))
    leaves = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.coalesce(blocked, F.lit(0)).alias("blocked"), F.count("fit.verdict").alias("labelled"))
    found = templates(stored(leaves, "url-leaves"))
    method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    out = rows.join(found, ["host", "segs"])
    return out.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "template", "purity")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url, with its template and purity."""
    return judged(table(spark, sf_dir, "pages"), RULES).withColumn("purity", F.round(F.col("purity").cast("decimal(18,10)"), 6).cast("double"))


def _level_sql(d: int) -> str:
    """One level of the tree: the children of all nodes at depth d are named, then pooled."""
    sums = "sum(n) AS n, sum(blocked) AS blocked, sum(labelled) AS labelled"
    gap = "(blocked / labelled - (all_blocked - blocked) / (all_labelled - labelled))"
    share = "all_blocked / all_labelled"
    far = f"abs({gap}) > {DEVIATIONS} * sqrt({share} * (1 - {share}) * (1 / labelled + 1 / (all_labelled - labelled))) + 1e-9"
    return f"""
rows{d} AS MATERIALIZED (SELECT * EXCLUDE (path), segs[{d + 1}] AS seg, regexp_replace(array_to_string(segs[{d + 2}:], '/'), '[^/.*]+', 'a', 'g') AS form, path || '/' || segs[{d + 1}] AS path FROM live{d} WHERE len(segs) > {d}),
paths{d} AS (SELECT path, sum(blocked) AS b, sum(labelled) AS l FROM rows{d} GROUP BY path),
forms{d} AS MATERIALIZED (SELECT host, node, seg, form, {sums} FROM rows{d} GROUP BY ALL),
kids{d} AS MATERIALIZED (SELECT host, node, seg, {sums} FROM forms{d} GROUP BY ALL),
all{d} AS (SELECT host, node, sum(n) AS all_n, sum(blocked) AS all_blocked, sum(labelled) AS all_labelled FROM kids{d} GROUP BY ALL),
pooled{d} AS (SELECT host, node, form, sum(n) AS form_n FROM forms{d} GROUP BY ALL),
near{d} AS (SELECT host, node, seg, k.n, k.blocked, k.labelled, all_n, all_blocked, all_labelled, sum(abs(f.n / k.n - form_n / all_n)) AS near, sum(form_n / all_n) AS met
  FROM (SELECT host, node, seg, form, n FROM forms{d}) f JOIN pooled{d} USING (host, node, form) JOIN kids{d} k USING (host, node, seg) JOIN all{d} USING (host, node) GROUP BY ALL),
general{d} AS (SELECT host, node, seg, CASE WHEN n * {MOST_CHILDREN} <= all_n OR (labelled > 0 AND (near + 1 - met) / 2 <= {VARIATION} + 1e-9)
  THEN '*' || CASE WHEN labelled = 0 OR all_labelled = labelled THEN '' WHEN NOT ({far}) THEN '' WHEN {gap} > 0 THEN '+' ELSE '-' END END AS general FROM near{d}),
names{d} AS (SELECT host, node, seg, CASE WHEN general IS NULL OR count(*) OVER (PARTITION BY host, node, general) = 1 THEN seg ELSE general END AS name FROM general{d}),
placed{d} AS MATERIALIZED (SELECT host, segs, n, blocked, labelled, known, purity, path, node || '/' || name AS node, (b + {WEIGHT} * pool) / (l + {WEIGHT}) AS pool FROM rows{d} JOIN paths{d} USING (path) JOIN names{d} USING (host, node, seg)),
totals{d} AS (SELECT host, node, sum(blocked) AS b, sum(labelled) AS l, CAST(sum(n * CAST(round(pool * {UNIT}) AS BIGINT)) AS DOUBLE) / {UNIT} / sum(n) AS q FROM placed{d} GROUP BY ALL),
live{d + 1} AS MATERIALIZED (SELECT host, segs, n, blocked, labelled, l AS known, (b + least(known, {WEIGHT}) * purity + {WEIGHT} * q) / (l + least(known, {WEIGHT}) + {WEIGHT}) AS purity, path, node, pool FROM placed{d} JOIN totals{d} USING (host, node)),"""


def _op4_sql() -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: (len(r[0] + r[1]), r), reverse=True)]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    parts = "string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '*', 'g'), '/')"
    fields = "host, segs, n, blocked, labelled, known, purity, path, node, pool"
    return f"""
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
split_ AS (SELECT *, {case(1)} AS rule, {case(2)} AS told, CASE WHEN path = '' THEN []::VARCHAR[] ELSE {parts} END AS parts FROM urls),
judged AS MATERIALIZED (SELECT * EXCLUDE (parts), CASE WHEN len(parts) > {DEEPEST} THEN list_append(parts[1:{DEEPEST - 1}], array_to_string(parts[{DEEPEST}:], '/')) ELSE parts END AS segs FROM split_),
leaves AS MATERIALIZED (SELECT host, segs, count(*) AS n, count(*) FILTER (WHERE told = 'block') AS blocked, count(told) AS labelled FROM judged GROUP BY host, segs),
top AS (SELECT (sum(blocked) + {PRIOR * WEIGHT}::DOUBLE) / (sum(labelled) + {WEIGHT}::DOUBLE) AS share FROM leaves),
hosts AS (SELECT host, sum(labelled) AS known, (sum(blocked) + {WEIGHT} * any_value(share)) / (sum(labelled) + {WEIGHT}::DOUBLE) AS purity FROM leaves, top GROUP BY host),
live0 AS MATERIALIZED (SELECT host, segs, n, blocked, labelled, known, purity, '' AS path, '' AS node, share AS pool FROM leaves JOIN hosts USING (host), top),{"".join(_level_sql(d) for d in range(DEEPEST))}
done AS ({" UNION ALL ".join(f"SELECT {fields} FROM live{d} WHERE len(segs) = {d}" for d in range(DEEPEST + 1))})
SELECT page_id, j.host, j.path, rule, coalesce(told, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, j.host || node AS template, CAST(round(CAST(purity AS DECIMAL(18,10)), 6) AS DOUBLE) AS purity
FROM judged j JOIN done USING (host, segs)
"""


OP4_SQL = _op4_sql()
