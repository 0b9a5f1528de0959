"""Near-dedup by similarity: two texts are linked if the Jaccard similarity of their five-word shingles is at least ``SIMILARITY``.

A text is the set of its shingles' hashes. Covering LSH over the SimHashes of the sets (``simhash.links``) comes first: it names nodes
(distinct sets) that differ in at most ``RADIUS`` of the first 64 bits, their exact similarity decides, and the links are joined to
components. A similarity of 0.8 leaves about 10 of 64 bits apart, for which no table is selective; links beyond the radius, and those
inside it that the forest of the LSH leaves out, are found by prefixes among nodes of different components.

Sets are in one order: shingles that a sample of the documents shows to be frequent come last, else by hash. Sets of a similarity of
t or more share one of the first n - ceil(t n) + 1 hashes of each (the prefix), whatever the order, so the pairs that meet at a hash
of both prefixes hold every link; a passage that many documents share is in few prefixes.

1. Every hash that several nodes have names one of them: the one that has the least of its set before the hash, as an
   original has before what all its copies share. A node is a candidate with each node that its hashes name: at most one pair for
   each hash of a prefix, so a large group of near copies joins in linear time. Pairs of one component by the LSH are left out.
2. Candidates are decided by the exact similarity of the two whole sets, and all links are joined to components.
3. A hash whose nodes are of several components is not settled: all its pairs of different components are candidates too, by a join
   of the hash with itself whose condition has all that is known of a pair. So no link is missed.

Pairs are no candidates if their sizes rule the link out; if their 128-bit SimHashes differ in more than ``FAR`` bits (five deviations
beyond what a similarity of 0.8 gives; small sets aren't held to it); or if too little of a set is left from the hash on: where two
sets first meet, no more than that is common to both. Copies that differ from their original by too much are so told apart from each
other without being compared. In step 3 a pair is skipped at a hash if the one before it is the same in both sets.

Cases: as for the plain operator; texts without words are one group, and of fewer words than the shingle one shingle; a null id
comes last; a document is known by its id and a hash of its text, so rows alike in both are one, and other texts of the same (or a
null) id are documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, RangeHash, among, fresh, gathered, mixed, slices, stored, tidy, utf8, words
from .components import components
from .simhash import fingerprint, signed, xxhash
from .simhash import links as covering_links

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of the first 64 up to which the covering LSH finds a pair, in 2 ** (RADIUS + 1) - 1 tables.
RADIUS = 5
#: Differing bits of 128 beyond which a pair is no candidate, where both sets have FEW shingles or more (bits of fewer say little).
FAR, FEW = 40, 32
#: Frequent shingles are those that so many documents of a sample have: at most the share of the documents, and the bytes.
SEEN, SHARE, SAMPLE_BYTES = 24, 1 / 16, 256 << 20
#: Rows up to which a table is broadcast.
BROADCAST = 200_000
LAST = (1 << 63) - 1


def shingles_of(data: np.ndarray, offs: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The distinct shingles of each row of a slice, as ascending hashes."""
    data = LOWER[data]
    s, e, first = words(data, offs, NON_SPACE)
    n = np.diff(first)
    if not len(s):
        return [np.zeros(0, np.uint64)] * len(n)
    size = e - s
    to = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    word_of = np.repeat(np.arange(len(s)), size)
    joined[np.arange(len(word_of)) + word_of] = data[NON_SPACE[data]]
    k = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    row = np.repeat(np.arange(len(n)), k)
    cuts = np.append(0, np.cumsum(k))
    begin = np.arange(len(row)) - cuts[row] + first[row]
    last = np.minimum(begin + shingle, first[row + 1]) - 1
    h = RangeHash(joined)(to[begin], to[last] + size[last])
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def node_of(grams: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(grams.tobytes()))


def prefix(n: int, similarity: float) -> int:
    """How many of the least hashes of a set of n one of a link must share."""
    return n - math.ceil(round(similarity * n, 6)) + 1 if n else 0


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending sets."""
    if not len(a) + len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc (null keys last), mark (a hash of the text) and text."""
    return docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))


def small(rows: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has few rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def frequent_shingles(read: DataFrame, shingle: int) -> np.ndarray:
    """The shingles that SEEN documents of a sample have, in order; the sample and the list are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for i, j in slices(offs):
                found = shingles_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["gram"])

    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(SHARE, SAMPLE_BYTES / max(1, size))
    some = read.where(F.pmod(F.xxhash64(F.lit(4), "doc", "mark"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = some.select("text").mapInArrow(tidy(run), "gram bigint").groupBy("gram").count().where(F.col("count") >= SEEN)
    return np.sort(np.array([r[0] for r in counts.select("gram").collect()], np.int64).view(np.uint64))


def lead(grams: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a set: frequent shingles come last."""
    late = among(grams, frequent)
    return np.concatenate([grams[~late], grams[late]])[: prefix(len(grams), similarity)]


def with_signature(read: DataFrame, frequent, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc, mark, node (the set), n (its size) and, at a node's first document in a task, one, two (its SimHash) and lead (its prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            data, offs = utf8(batch.column(2))
            for i, j in slices(offs):
                out = []
                for g in shingles_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle):
                    node = node_of(g)
                    if node in seen:
                        out.append((node, len(g), None, None, None))
                    else:
                        seen.add(node)
                        out.append((node, len(g), signed(fingerprint(g)), signed(fingerprint(mixed(g, 21))), lead(g, frequent.value, similarity).view(np.int64)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names=["doc", "mark", "node", "n", "one", "two", "lead"])

    return read.mapInArrow(tidy(run), "doc bigint, mark bigint, node bigint, n bigint, one bigint, two bigint, lead array<bigint>")


def near(x: str, y: str) -> Column:
    """Whether the SimHashes of two nodes (columns n, one and two of two tables) leave a link possible."""
    a, b = ([F.col(f"{t}.{c}") for c in ("n", "one", "two")] for t in (x, y))
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in (1, 2)), F.lit(0))
    return (F.least(a[0], b[0]) < FEW) | (apart <= FAR)


def enough(n: Column, m: Column, left: Column, other: Column, similarity: float) -> Column:
    """Whether sets of n and m, of which left and other are left where they first meet, can be so similar."""
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (F.least(left, other) >= similarity / (1 + similarity) * (n + m) - 1e-6)


def _sets(shingle: int):
    """node, grams (its whole set, once a task) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for i, j in slices(offs):
                out = [(node_of(g), g.tobytes()) for g in shingles_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)]
                out = [x for x in dict(out).items() if x[0] not in seen]
                seen.update(n for n, _ in out)
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([g for _, g in out], pa.binary())], names=["node", "grams"])

    return run


def _decide(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(g, np.uint64) for g in batch.column(k).to_pylist()] for k in (2, 3)]
            ok = pa.array([jaccard(x, y) >= similarity - 1e-9 for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1)], names=["a", "b"])

    return run


def _decide(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(g, np.uint64) for g in batch.column(k).to_pylist()] for k in (2, 3)]
            ok = pa.array([jaccard(x, y) >= similarity - 1e-9 for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1)], names=["a", "b"])

    return run


def decided(pairs: DataFrame, read: DataFrame, marked: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: the stored pairs of the exact similarity or more. Whole sets are made anew, of the nodes of the pairs only."""
    nodes = stored(gathered(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), read), "similar-asked")
    # exact copies of a document needn't all be read again: the least stands for all
    least = marked.join(small(nodes), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc", "mark")).alias("m"))
    least = stored(gathered(least.select("m.doc", "m.mark"), read), "similar-least")
    texts = read.join(small(least), ["doc", "mark"], "left_semi").select("text")
    sets = stored(gathered(texts.mapInArrow(tidy(_sets(shingle)), "node bigint, grams binary").dropDuplicates(["node"]), read), "similar-sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    return stored(gathered(both.select("a", "b", "x", "y").mapInArrow(tidy(_decide(similarity)), "a bigint, b bigint"), read), "similar-links")


def covered(known: DataFrame, source: DataFrame, radius: int) -> DataFrame:
    """a, b: nodes whose first SimHashes are within the radius, by covering LSH; the least node of a SimHash stands for all that have it."""
    least = stored(gathered(known.groupBy("one").agg(F.min("node").alias("least")), source), "similar-sketches")
    same = known.join(least, "one").where("node <> least").select(F.col("least").alias("a"), "node")
    found = covering_links(least.select(F.col("one").alias("fp")), radius)
    of = lambda c, to: least.select(F.col("one").alias(c), F.col("least").alias(to))
    across = found.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    return same.union(across).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def likely(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs that their sizes and SimHashes leave possible."""
    sketch = F.struct("n", "one", "two")
    both = pairs.join(known.select(F.col("node").alias("b"), sketch.alias("y")), "b").join(known.select(F.col("node").alias("a"), sketch.alias("x")), "a")
    sizes = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6
    return both.where(sizes & near("x", "y")).select("a", "b")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc, mark, component_id and its_mark (the least doc and mark reachable over links) of each document."""
    read = _documents(docs, key, text)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(read, shingle))
    marked = stored(with_signature(read, frequent, shingle, similarity), "similar-docs")
    firsts = marked.where("lead IS NOT NULL")
    known = stored(gathered(firsts.select("node", "n", "one", "two").dropDuplicates(["node"]), docs), "similar-nodes")
    close = stored(gathered(likely(covered(known, docs, RADIUS), known, similarity), docs), "similar-close")
    links = decided(close, read, marked, shingle, similarity)
    group = components(links, docs, "similar-covered")
    places = F.transform("lead", lambda h, i: F.struct(h.alias("hash"), F.get("lead", i - 1).alias("before"), (F.col("n") - i).alias("left")))
    entries = firsts.select(F.explode(places).alias("e"), "node", "n").select("e.*", "node", "n")
    top = F.max(F.struct((F.col("left") / F.col("n")).alias("share"), F.col("node").alias("pivot"), F.col("left").alias("pivot_left"), F.col("n").alias("pivot_n"))).alias("top")
    named = entries.groupBy("hash").agg(F.min("node").alias("least"), F.max("node").alias("most"), top).where("least <> most").select("hash", "top.pivot", "top.pivot_left", "top.pivot_n")
    named = stored(gathered(named, docs), "similar-hashes")
    members = stored(gathered(entries.join(small(named), "hash"), docs), "similar-members")
    met = members.where((F.col("node") != F.col("pivot")) & enough(F.col("n"), F.col("pivot_n"), F.col("left"), F.col("pivot_left"), similarity))
    met = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    of = lambda c, to: group.select(F.col("node").alias(c), F.col("component").alias(to))
    met = met.join(of("a", "c"), "a", "left").join(of("b", "d"), "b", "left").where(F.coalesce("c", "a") != F.coalesce("d", "b")).select("a", "b")
    pairs = stored(gathered(likely(met, known, similarity), docs), "similar-pairs")
    links, pairs = links.union(decided(pairs, read, marked, shingle, similarity)), pairs.union(close)
    joined = components(links, docs, "similar-groups")

    group = joined.select(F.col("node").alias("of"), "component")
    placed = members.join(group.select(F.col("of").alias("node"), F.col("component").alias("c")), "node", "left").join(group.select(F.col("of").alias("pivot"), F.col("component").alias("d")), "pivot", "left")
    placed = placed.select("hash", "node", "left", "before", F.coalesce("c", "node").alias("c"), F.coalesce("d", "pivot").alias("d"))
    placed = stored(gathered(placed, docs), "similar-placed")
    unsettled = stored(gathered(placed.where("c <> d").select("hash").distinct(), docs), "similar-unsettled")
    if not unsettled.isEmpty():
        loose = placed.join(small(unsettled), "hash", "left_semi").select("hash", "node", "left", "before", "c").join(known, "node")
        loose = stored(gathered(loose.distinct(), docs), "similar-loose")
        earlier = F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
        across = (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & ~earlier & enough(F.col("x.n"), F.col("y.n"), F.col("x.left"), F.col("y.left"), similarity) & near("x", "y")
        met = loose.alias("x").join(loose.alias("y"), (F.col("x.hash") == F.col("y.hash")) & across).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        more = stored(gathered(met.join(pairs, ["a", "b"], "left_anti"), docs), "similar-more")
        if not more.isEmpty():
            joined = components(links.union(decided(more, read, marked, shingle, similarity)), docs, "similar-groups")
    nodes = marked.groupBy("node").agg(F.min(F.struct("doc", "mark")).alias("least"))
    found = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = stored(gathered(found, docs), "similar-known")
    least = found.groupBy("component").agg(F.min("least").alias("least"))
    named = found.select("node", "component").join(least, "component").select("node", F.col("least.doc").alias("component_id"), F.col("least.mark").alias("its_mark"))
    return marked.select("doc", "mark", "node").join(named, "node").select("doc", "mark", "component_id", "its_mark")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, with all its columns: of the least key in it the one whose text has the least hash.

    A document is known by its key and its text, so other texts of the same (or a null) key go with their own groups.
    """
    doc, mark, one, its = fresh(docs, "__doc", "__mark", "__one", "__its")
    least = groups(docs, key, text, shingle, similarity).where("doc = component_id AND mark = its_mark")
    stay = least.select(F.col("doc").alias(one), F.col("mark").alias(its)).distinct()
    rows = docs.withColumn(doc, F.coalesce(F.col(key).cast("bigint"), F.lit(LAST))).withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = rows.join(stay, (rows[doc] == stay[one]) & (rows[mark] == stay[its]), "left_semi")
    return gathered(kept.dropDuplicates([doc, mark]).drop(doc, mark), docs)
