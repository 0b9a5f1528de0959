"""Document fingerprints by winnowing, with DataFrame functions only.

A text is lower-cased and split at white space; each character of a script written without spaces is a word of its own. Every run
of ``GRAM`` words has a rolling hash (a cyclic polynomial: the words' hashes, rotated by their distance from the run's end, by
exclusive or); of every ``WINDOW`` adjacent hashes the least is chosen, on ties the rightmost, with its position. Any run of
GRAM + WINDOW - 1 words that two texts share gives a common hash; a shared run of fewer than GRAM words never does.

Hashes and minima of all places are made at once: those of runs of n words from those of shorter runs beside each other.

A chosen entry is one long: 39 bits of hash, then 2**24 - 1 less the word position (modulo 2**24), so that the least entry of
a window is the least hash at its rightmost place. The fingerprint string joins the entries in hex. Likeness is the Jaccard
index of the chosen hashes.

Cases: null counts as empty; a text without words has an empty fingerprint, and two of these are alike (1.0); fewer words than
GRAM are one gram; repeated ids come in the order of their texts, null ids last; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, partitions, stored, table

GRAM, WINDOW = 5, 6
_POSITIONS = (1 << 24) - 1
#: Edges of key ranges at most (each is cut into even parts where more buckets are needed), and the size of a coarse step among them.
EDGES, STEP = 1024, 64
#: Buckets for each shuffle partition: buckets fall to partitions by hash, so several even out.
SPREAD = 24
#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = "[\\x{e00}-\\x{eff}\\x{1000}-\\x{109f}\\x{1780}-\\x{17ff}\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{3ffff}]"


def tokens(text: Column) -> Column:
    """The words of a text."""
    low = F.lower(text)
    apart = F.when(low.rlike(UNSPACED), F.regexp_replace(low, UNSPACED, " $0 ")).otherwise(low)
    return F.filter(F.split(apart, "[ \\t-\\r]+"), lambda w: w != "")


def _beside(a: Column, b: Column, skip: int, join) -> Column:
    """join of each element of a with the one of b that lies skip places on."""
    n = F.size(b) - skip
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(skip + 1), n), join)


def rolled(ones: Column, size: int) -> Column:
    """The hashes of all runs of size words from the words' own: of runs twice as long, or longer by one, step by step."""
    turned = lambda n: lambda a, b: F.shiftleft(a, n).bitwiseOR(F.shiftrightunsigned(a, 64 - n)).bitwiseXOR(b)

    def grown(now: Column, n: int, more: str) -> Column:
        if not more:
            return now
        longer = lambda x: _let(_beside(x, ones, 2 * n, turned(1)), lambda y: grown(y, 2 * n + 1, more[1:]))
        return _let(_beside(now, now, n, turned(n)), lambda x: longer(x) if more[0] == "1" else grown(x, 2 * n, more[1:]))

    return grown(ones, 1, f"{size:b}"[1:])


def minima(ones: Column, size: int, n: int = 1) -> Column:
    """The least of all runs of size elements, from those of runs of n."""
    if n == size:
        return ones
    skip = min(n, size - n)
    return _let(_beside(ones, ones, skip, lambda a, b: F.least(a, b)), lambda x: minima(x, size, n + skip))


def entries(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The chosen entries of a text, in order of position."""
    hashes = F.transform(tokens(text), lambda w: F.xxhash64(w))
    grams = lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < gram, F.array(F.xxhash64(h))).otherwise(rolled(h, gram))
    packed = lambda g: F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 25), 24).bitwiseOR(_POSITIONS - i.cast("bigint").bitwiseAND(F.lit(_POSITIONS))))
    chosen = lambda e: F.when(F.size(e) == 0, e).when(F.size(e) < window, F.array(F.array_min(e))).otherwise(F.array_distinct(minima(e, window)))
    return _let(_let(_let(hashes, grams), packed), chosen)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 24)))


def shown(chosen: Column) -> Column:
    return F.array_join(F.transform(chosen, lambda x: F.hex(x)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.lit(1.0), F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """key, entries (array of long) and fingerprint (string) of each document."""
    chosen = docs.select(F.col(key), entries(F.coalesce(F.col(text), F.lit("")), gram, window).alias("entries"))
    return chosen.withColumn("fingerprint", shown(F.col("entries")))


def _part(key: Column, edges: list[int], fine: int) -> Column:
    """The bucket of a key: the range between edges that it lies in, cut into even parts; null keys are in the first."""
    if len(edges) < 2:
        return F.lit(0).cast("bigint")
    arr = F.array(*[F.lit(x).cast("bigint") for x in edges])
    coarse = F.array(*[F.lit(x).cast("bigint") for x in edges[STEP - 1 :: STEP]]) if len(edges) >= STEP else F.array().cast("array<bigint>")
    base = F.size(F.filter(coarse, lambda x: x <= key)) * STEP  # sought in coarse steps, then in one
    at = F.least(F.greatest(base + F.size(F.filter(F.slice(arr, base + 1, STEP), lambda x: x <= key)) - 1, F.lit(0)), F.lit(len(edges) - 2))
    low, high = F.get(arr, at).cast("double"), F.get(arr, at + 1).cast("double")
    part = F.floor((key.cast("double") - low) / (high - low) * fine) if fine > 1 else F.lit(0)
    return F.coalesce(at.cast("bigint") * fine + F.least(F.greatest(part, F.lit(0)), F.lit(fine - 1)), F.lit(0).cast("bigint"))


def with_next(docs: DataFrame, prepare, key: str = "doc_id", text: str = "text", edges: int = EDGES) -> DataFrame:
    """Rows of prepare(key, text) with ``next``, a struct of the row that follows in descending order of the key; the last is followed by the first.

    Rows are dealt by ranges of the key to as many buckets as the cluster's partitions ask for; each bucket also gets the first row of
    the following one.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wanted = SPREAD * partitions(spark)
    n = min(wanted, edges)
    found = given.agg(F.percentile_approx("key", [i / n for i in range(n + 1)], 40 * n)).first()[0]
    bucket = _part(F.col("key"), sorted(set(found or [])), -(-wanted // n))
    heads = given.groupBy(bucket.alias("bucket")).agg(F.struct(F.max("key").alias("key")).alias("top"))  # a row for each bucket
    w = Window.orderBy("bucket")
    after = stored(heads.select("bucket", F.coalesce(F.lag("top").over(w), F.last("top").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))["key"].alias("first")), "winnow-heads")
    rows = given.select(bucket.alias("bucket"), F.lit(0).alias("extra"), "key", "text")
    extra = given.join(F.broadcast(after), F.col("key").eqNullSafe(F.col("first"))).select("bucket", F.lit(1).alias("extra"), "key", "text")
    dealt = rows.union(extra).repartition(partitions(spark), "bucket")
    ready = dealt.select("bucket", "extra", *prepare(F.col("key"), F.col("text")))
    w = Window.partitionBy("bucket").orderBy("extra", F.col("key").desc_nulls_last(), "text")
    kept = [c for c in ready.columns if c not in ("bucket", "extra", "key")]
    return ready.select("*", F.lead(F.struct(*kept)).over(w).alias("next")).where("extra = 0").drop("bucket", "extra").withColumnRenamed("key", key)


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness."""
    docs = with_next(table(spark, sf_dir, "documents"), lambda key, text: [key, text, F.char_length(text).cast("bigint").alias("n_chars"), entries(text).alias("own")])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = docs.select("doc_id", "n_chars", "own", F.col("next.own").alias("other"), F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr(F.col("next.text"), F.lit(1), half)).alias("edited"))
    marked = edited.select("doc_id", "n_chars", "own", "other", F.sha2("edited", 256).alias("edited_sha256"), entries(F.col("edited")).alias("new"))
    near = lambda x: _let(hashes(F.col("own")), lambda a: likeness(a, hashes(F.col(x))))
    out = marked.select("doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("new")).alias("edited_fingerprint"), near("new").alias("near_edited"), near("other").alias("near_next"))
    return gathered(out, table(spark, sf_dir, "documents"))
