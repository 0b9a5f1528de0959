"""SimHash near-dedup with covering locality-sensitive hashing.

Each document has a 64-bit fingerprint of its word shingles. Every bit position has a random vector of radius + 1 bits; each
of the 2**(radius + 1) - 1 non-zero vectors v gives a mask of the positions whose vector has an odd product with v. At most
radius differing positions span at most radius dimensions, so some v is orthogonal to all of them: its mask shows none of
them, and the pair collides in that table. So no pair within the radius is missed, whatever the random vectors are.

Equal fingerprints are one node. A bucket of more than ``hot`` nodes is dealt out again by radius + 1 blocks of the positions
outside its mask: of at most radius differences one block has none. Sub-buckets are sorted and compared in tiles, and only a
spanning forest of a partition's links leaves it; components follow from these links.

Cases: null and empty texts, or white space only, have no words and fingerprint zero, linked like any other; fewer words than
the shingle are one shingle; repeated rows share a node; an empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, gathered, partitions, slices, stored, table, tidy, utf8, words
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Nodes of a bucket beyond which it is dealt out again.
HOT = 2000
#: Positions of a nibble table: the bits of each byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(shingles: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    n = len(shingles)
    if not n:
        return 0
    raw = shingles.astype(">u8").view(np.uint8).reshape(n, 8)
    if n < 256:
        ones = np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(raw[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints_of(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """The fingerprint of each row of a slice of texts."""
    data = LOWER[data]
    s, e, first = words(data, offs, NON_SPACE)
    # the words of a row with one space between them: keep word bytes and, after each word, one more
    size = e - s
    to = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inside = NON_SPACE[data]
    word_of = np.repeat(np.arange(len(s)), size)
    joined[np.arange(len(word_of)) + word_of] = data[inside]
    flat = joined.tobytes()
    out = []
    digest = xxhash.xxh64_intdigest
    begins, stops, first = to.tolist(), (to + size).tolist(), first.tolist()
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n <= 0:
            out.append(0)
            continue
        k = max(1, n - shingle + 1)
        parts = [flat[x:y] for x, y in zip(begins[a : a + k], stops[a + min(shingle, n) - 1 : b])]
        out.append(fingerprint(np.fromiter(map(digest, parts, repeat(seed)), np.uint64, k)))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key and fp (the fingerprint as a signed long) of each document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for i, j in slices(offs):
                fps = fingerprints_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(map(signed, fps), pa.int64())], names=["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, fp bigint").withColumnRenamed("key", key)


def masks(radius: int = RADIUS, seed: int = 20160901) -> list[int]:
    """The covering masks of 64 positions, as signed longs."""
    rng = random.Random(seed)
    vectors = [rng.randrange(1, 1 << (radius + 1)) for _ in range(64)]
    out = []
    for v in range(1, 1 << (radius + 1)):
        out.append(signed(sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1)))
    return out


def block_masks(radius: int = RADIUS) -> list[list[int]]:
    """For each covering mask radius + 1 disjoint blocks of the positions outside it."""
    out = []
    for m in masks(radius):
        rest = [i for i in range(64) if not (m >> i) & 1]
        out.append([signed(sum(1 << i for i in rest[b :: radius + 1])) for b in range(radius + 1)])
    return out


class Forest:
    """Union-find over the nodes that occur in a partition's links."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = p = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _close(values: np.ndarray, radius: int, tile: int = 512) -> Iterator[tuple[int, int]]:
    """Pairs of distinct values of a bucket within the radius, found tile by tile."""
    for i in range(0, len(values), tile):
        for j in range(i, len(values), tile):
            x = values[i : i + tile, None] ^ values[None, j : j + tile]
            a, b = np.nonzero(np.bitwise_count(x) <= radius)
            for p, q in zip((a + i).tolist(), (b + j).tolist()):
                if p < q:
                    yield p, q


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def work(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch | None:
            links = []
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            begin = np.flatnonzero(first)
            size = np.diff(np.append(begin, len(keys)))
            two = begin[size == 2]
            near = two[np.bitwise_count((values[two] ^ values[two + 1]).view(np.uint64)) <= radius]
            pairs = [(int(values[i]), int(values[i + 1])) for i in near]
            for b, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
                group = values[b : b + n]
                pairs += [(int(group[p]), int(group[q])) for p, q in _close(group.view(np.uint64), radius) if forest.root(int(group[p])) != forest.root(int(group[q])) and (forest.join(int(group[p]), int(group[q])) or True)]
            for a, b in pairs:
                links.append((a, b))
            if links:
                return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # sorted by key: the last bucket may go on
            if cut and (out := work(keys[:cut], values[:cut])) is not None:
                yield out
            held_key, held = keys[cut:], values[cut:]
        if len(held) and (out := work(held_key, held)) is not None:
            yield out

    return run


def links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """a, b: links that connect every pair of distinct fingerprints within the radius. nodes: distinct fp."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for t, m in enumerate(masks(radius))])
    dealt = nodes.select("fp", F.explode(tables).alias("k")).select(F.xxhash64("k.t", "k.v").alias("bucket"), F.col("k.t").alias("t"), "fp")
    crowded = dealt.groupBy("bucket").count().where(F.col("count") > hot).select("bucket", F.lit(True).alias("crowded"))
    crowded = stored(gathered(crowded, nodes), "simhash-hot")
    n = crowded.count()
    if n:
        blocks = [F.when(F.col("t") == t, F.array(*[F.struct(F.lit(b).alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for b, m in enumerate(bs)])) for t, bs in enumerate(block_masks(radius))]
        both = dealt.join(crowded, "bucket", "left")
        again = F.when(F.col("crowded"), F.transform(F.coalesce(*blocks), lambda s: F.xxhash64(F.col("bucket"), s["b"], s["v"]))).otherwise(F.array(F.col("bucket")))
        dealt = both.select(F.explode(again).alias("bucket"), "fp")
    dealt = dealt.select("bucket", "fp").repartition(partitions(nodes.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(_links(radius)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """key, fp and component_id (the least key reachable over links of at most radius differing bits) of each document."""
    marked = stored(with_fingerprint(docs, key, text, shingle), "simhash-docs")
    nodes = stored(gathered(marked.groupBy("fp").agg(F.min(key).alias("least")), docs), "simhash-nodes")
    groups = components(links(nodes.select("fp"), radius), docs, "simhash-groups")
    known = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    known = stored(gathered(known, docs), "simhash-known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(least, "component").select("fp", "component_id")
    return gathered(marked.join(named, "fp").select(key, "fp", "component_id"), docs)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
