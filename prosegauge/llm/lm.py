"""LM scoring with a log-frequency Bloom filter of quantised bigram counts.

Texts are read once into batches: each document's tokens as numbers of the batch's own vocabulary, written to shared storage.
Unigram counts are exact: each batch sends its distinct tokens, with their counts in training texts, to buckets of the hash
space; a bucket adds them up and answers every batch. Distinct bigrams with counts go the same way, and each bucket makes its
own segment of the filter: a bigram seen c times is entered at levels 1 to 1 + floor(log2(c)), one 64-bit word and ``PROBES``
bits for each level. A reader probes level after level until one fails; the last one gives the count.

A filter that the number of training tokens bounds by ``FILTER_BYTES`` is broadcast to the workers. Beyond that it stays where it is made: each batch sends its
distinct bigrams to the buckets, which probe their own segments and answer with a level each, one byte. Both ways give the same
scores; the second costs one more exchange and grows in proportion to the corpus.

log10 P(w | u) = log10((count(u, w) + WEIGHT * P(w)) / (count(u) + WEIGHT)), where P(w) is the smoothed unigram share: the more often a
context was seen, the more its own counts say, and one never seen in training leaves P(w) alone. The context of a text's first
token is the end of a text.

Cases: a null or empty text has the end token only; repeated rows count and score each; a null id is neither held out nor
learned; with nothing learned every share is 1; tokens are told apart by 64-bit hashes; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, RangeHash, gathered, mixed, partitions, slices, stored, table, tidy, utf8, words

BATCH_BYTES = 8 << 20
FILTER_BYTES = 192 << 20
BITS, PROBES = 12, 4
#: Tokens for each bucket.
BUCKET_TOKENS = 4_000_000
#: Tokens that a reader scores at a time.
STEP = 1 << 18
#: Occurrences of a context that weigh as much as the unigram share does.
WEIGHT = 200.0
END = np.uint64(0x5851F42D4C957F2D)
_K = np.uint64(0xC2B2AE3D27D4EB4F)

BATCHES = "batch bigint, keys array<bigint>, held array<boolean>, sizes array<int>, learn array<boolean>, vocabulary binary, trained binary, tokens binary"


def pack(x: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers, compressed byte plane by byte plane."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _batch(batch: int, rows: list[tuple]) -> pa.RecordBatch:
    hashes = np.concatenate([r[0] for r in rows])
    sizes = np.concatenate([r[1] for r in rows])
    keys, held, learn = (pa.concat_arrays([r[i] for r in rows]) for i in (2, 3, 4))
    vocabulary, where, count = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    tokens = rank[where]
    learned = np.repeat(np.asarray(learn.to_numpy(zero_copy_only=False), bool), sizes)
    trained = np.bincount(tokens[learned], minlength=len(order))
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if not isinstance(x, pa.Array) else x)
    return pa.RecordBatch.from_arrays(
        [pa.array([batch], pa.int64()), one(keys, pa.int64()), one(held, pa.bool_()), one(sizes.astype(np.int32), pa.int32()), one(learn, pa.bool_()), pa.array([vocabulary[order].tobytes()], pa.binary()), pa.array([pack(trained)], pa.binary()), pa.array([pack(tokens)], pa.binary())],
        names=["batch", "keys", "held", "sizes", "learn", "vocabulary", "trained", "tokens"],
    )


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size, n = [], 0, 0
    task = TaskContext.get().partitionId() << 24
    for batch in batches:
        data, offs = utf8(batch.column(1))
        for i, j in slices(offs):
            part = LOWER[data[offs[i] : offs[j]]]
            s, e, first = words(part, offs[i : j + 1] - offs[i], NON_SPACE)
            h = RangeHash(part)(s, e) if len(s) else np.zeros(0, np.uint64)
            rows.append((np.insert(h, first[1:], END), np.diff(first) + 1, *(batch.column(k).slice(i, j - i) for k in (0, 2, 3))))
            size += len(part) + 64 * (j - i)
            if size >= BATCH_BYTES:
                yield _batch(task | n, rows)
                rows, size, n = [], 0, n + 1
    if rows:
        yield _batch(task | n, rows)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _parts(h: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket in use and the places of its hashes."""
    b = bucket_of(h, n)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(b[part[0]]), part


def _requests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["vocabulary"], np.uint64)
                c = unpack(r["trained"], len(v))
                rows = [(b, r["batch"], v[at].tobytes(), pack(c[at])) for b, at in _parts(v, n)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "batch", "hashes", "counts"])

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Totals for every request of a bucket, and a row of the bucket's tokens and kinds."""
    bucket = group.column("bucket")[0].as_py()
    asked = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    counts = np.concatenate([unpack(x, len(a)) for x, a in zip(group.column("counts").to_pylist(), asked)])
    kinds, where = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(where, counts, len(kinds)).astype(np.int64)
    answers = np.split(total[where], np.cumsum([len(a) for a in asked])[:-1])
    wide = lambda x: pa.compress(x.astype("<i8").tobytes(), codec="zstd", asbytes=True)
    n = len(asked)
    return pa.table(
        {
            "bucket": pa.array([bucket] * (n + 1), pa.int32()),
            "batch": pa.array([*group.column("batch").to_pylist(), -1], pa.int64()),
            "totals": pa.array([*map(wide, answers), None], pa.binary()),
            "n": pa.array([None] * n + [int(total.sum())], pa.int64()),
            "v": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
        }
    )


def _bigrams(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token with the one before it, and the place of that one (-1: the end of a text)."""
    first = np.cumsum(sizes) - sizes
    before = np.arange(len(h)) - 1
    before[first] = -1
    u = np.where(before < 0, END, h[before])
    return mixed(u * _K ^ (h << np.uint64(1)) ^ (h >> np.uint64(63)), 3), before


def _pairs(n: int, every: bool):
    """Distinct bigrams of a batch by bucket, with counts in training texts; every: those of other texts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                h = np.frombuffer(r["vocabulary"], np.uint64)[unpack(r["tokens"], int(sizes.sum()))]
                g, _ = _bigrams(h, sizes)
                learn = np.repeat(np.array(r["learn"], bool), sizes)
                if every:
                    g, where = np.unique(g, return_inverse=True)
                    c = np.bincount(where, learn, len(g)).astype(np.int64)
                else:
                    g, c = np.unique(g[learn], return_counts=True)
                rows = [(b, r["batch"], g[at].tobytes(), pack(c[at])) for b, at in _parts(g, n)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "batch", "hashes", "counts"])

    return run


def _probe(g: np.ndarray, level: int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word within a segment, and the bits, of a bigram at a level."""
    x = mixed(g, 100 + level)
    bits = np.zeros(len(g), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    word = ((x >> np.uint64(32)) * np.asarray(size, np.uint64)) >> np.uint64(32)
    return word.astype(np.int64), bits


def _bits(asked: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """The filter segment of a bucket's bigrams."""
    g, where = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts), len(g))
    g, total = g[total > 0], total[total > 0]
    level = 1 + np.floor(np.log2(total)).astype(np.int64)
    size = max(1, -(-int(level.sum()) * BITS // 64))
    bits = np.zeros(size, np.uint64)
    for q in range(1, int(level.max(initial=0)) + 1):
        word, mask = _probe(g[level >= q], q, size)
        np.bitwise_or.at(bits, word, mask)
    return bits


def _opened(group: pa.Table) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    asked = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    return group.column("bucket")[0].as_py(), asked, [unpack(x, len(a)) for x, a in zip(group.column("counts").to_pylist(), asked)]


def _segment(group: pa.Table) -> pa.Table:
    bucket, asked, counts = _opened(group)
    bits = _bits(asked, counts)
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})


def _levels(n: int):
    def run(group: pa.Table) -> pa.Table:
        """A level for each bigram that a batch asks for, from the bucket's own segment."""
        bucket, asked, counts = _opened(group)
        own = Filter(n, [(bucket, _bits(asked, counts).tobytes())])
        packed = [pa.compress(own.levels(g).astype(np.uint8).tobytes(), codec="zstd", asbytes=True) for g in asked]
        return pa.table({"bucket": pa.array([bucket] * len(asked), pa.int32()), "batch": group.column("batch").combine_chunks(), "levels": pa.array(packed, pa.binary())})

    return run


class Filter:
    """Segments of a run of buckets."""

    def __init__(self, buckets: int, segments: list[tuple[int, bytes]]):
        self.buckets = buckets
        self.size = np.zeros(buckets, np.int64)
        for b, raw in segments:
            self.size[b] = len(raw) // 8
        self.base = np.cumsum(self.size) - self.size
        self.bits = np.frombuffer(b"".join(raw for _, raw in sorted(segments)), np.uint64)

    def levels(self, g: np.ndarray) -> np.ndarray:
        """The last level that answers, 0 if none does."""
        level = np.zeros(len(g), np.int64)
        b = bucket_of(g, self.buckets)
        live = np.flatnonzero(self.size[b] > 0)
        q = 0
        while len(live):
            q += 1
            word, mask = _probe(g[live], q, self.size[b[live]])
            live = live[(self.bits[self.base[b[live]] + word] & mask) == mask]
            level[live] = q
        return level

    def counts(self, g: np.ndarray) -> np.ndarray:
        return estimate(self.levels(g))


def estimate(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(level > 0, 1.5 * np.exp2(level - 1.0) - 0.5, 0.0)


def _gathered(answers: list[dict], values: str, width: str, h: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets' answers in the order of the hashes that were asked for."""
    b = bucket_of(h, buckets)
    asked = np.bincount(b, minlength=buckets)
    out = np.zeros(len(h), np.int64)
    size = np.dtype(width).itemsize
    out[np.argsort(b, kind="stable")] = np.concatenate([np.frombuffer(pa.decompress(x[values], size * int(asked[x["bucket"]]), codec="zstd", asbytes=True), width) for x in answers])
    return out


def _score(shared, buckets: int, n: int, v: int, weight: float):
    """shared: the filter, or None where each batch comes with its levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                vocabulary = np.frombuffer(r["vocabulary"], np.uint64)
                tokens = unpack(r["tokens"], int(sizes.sum()))
                count = _gathered(r["answers"], "totals", "<i8", vocabulary, buckets)
                share = (count + 0.1) / (n + 0.1 * (v + 1))
                first = np.cumsum(sizes) - sizes
                g, before = _bigrams(vocabulary[tokens], sizes)
                if shared is None:
                    kinds, where = np.unique(g, return_inverse=True)
                    told = estimate(_gathered(r["levels"], "levels", "u1", kinds, buckets))
                ended = int(count[vocabulary == END].sum())
                part = np.zeros(len(tokens))
                for i in range(0, len(tokens), STEP):
                    at = slice(i, min(i + STEP, len(tokens)))
                    head = before[at]
                    context = np.where(head < 0, ended, count[tokens[head]])
                    p = share[tokens[at]]
                    known = context > 0
                    c = told[where[at][known]] if shared is None else shared.value.counts(g[at][known])
                    p[known] = (np.minimum(c, context[known]) + weight * p[known]) / (context[known] + weight)
                    part[at] = np.log10(p)
                add = lambda x: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["keys"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(sizes), pa.array(add((count > 0)[tokens].astype(np.int64))), pa.array(add(np.log10(share)[tokens])), pa.array(add(part))],
                    names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def scores(docs: DataFrame, learn, held, key: str = "doc_id", text: str = "text", weight: float = WEIGHT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each document; learn and held: boolean columns."""
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), held.alias("held"), learn.alias("learn"))
    batches = stored(given.mapInArrow(tidy(_tokenize), BATCHES), "lm-batches")
    # tokens bound the entries of both exchanges
    tokens = batches.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(partitions(spark), -(-tokens // BUCKET_TOKENS))

    requests = batches.select("batch", "vocabulary", "trained").mapInArrow(tidy(_requests(buckets)), "bucket int, batch bigint, hashes binary, counts binary")
    answers = requests.groupBy("bucket").applyInArrow(_answer, "bucket int, batch bigint, totals binary, n bigint, v bigint")
    answers = stored(gathered(answers, docs), "lm-unigrams")
    n, v = answers.where("batch < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    asked = answers.where("batch >= 0").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "totals"))).alias("answers"))
    ready = batches.select("batch", "keys", "held", "sizes", "vocabulary", "tokens").join(asked, "batch")
    columns, schema = ("batch", "sizes", "learn", "vocabulary", "tokens"), "bucket int, batch bigint, hashes binary, counts binary"
    shared = None
    # a bigram seen c times takes at most c entries, so n training tokens bound the filter before it is made
    if n * BITS // 8 + 8 * buckets <= filter_bytes:
        pairs = batches.select(*columns).mapInArrow(tidy(_pairs(buckets, False)), schema)
        segments = stored(gathered(pairs.groupBy("bucket").applyInArrow(_segment, "bucket int, bits binary"), docs), "lm-filter")
        shared = spark.sparkContext.broadcast(Filter(buckets, [(r[0], bytes(r[1])) for r in segments.toLocalIterator()]))
    else:
        pairs = batches.select(*columns).mapInArrow(tidy(_pairs(buckets, True)), schema)
        levels = pairs.groupBy("bucket").applyInArrow(_levels(buckets), "bucket int, batch bigint, levels binary")
        ready = ready.join(levels.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "levels"))).alias("levels")), "batch")
    out = ready.mapInArrow(tidy(_score(shared, buckets, n, v, weight)), "key bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    out = gathered(out, docs)
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the model learned from nine tenths of them."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    return scores(table(spark, sf_dir, "documents"), F.coalesce(fold != 0, F.lit(False)), F.coalesce(fold == 0, F.lit(False)))
