"""Exact removal of repeated passages by a sparse suffix array, range-partitioned by sampled splitters.

A byte goes if a string of ``length`` bytes over it also starts earlier in the corpus (a smaller document, or the same one at
an earlier place). Strings of that length are compared through suffixes that start at anchors: of each string the k-gram with
the least hash, on ties the rightmost. Equal strings have the same anchor at the same offset, so only about one suffix in
(length - k) / 2 is kept, and no match is missed.

1. Each batch of documents finds its anchors and, for each, the ``context``: all strings that share it. Repeats of a context
   within a batch are settled there; one of each goes, as hashes, to a bucket of the hash space.
2. A bucket keeps what occurs twice. Later occurrences of a whole context go at once; contexts that share the k-gram but
   differ are open. Buckets are of k-grams; those of k-grams that a sample shows to be frequent are dealt out by context, and all
   their contexts are open, so that a line which many documents share is no one bucket's.
3. Open suffixes, with the bytes on both sides of the anchor, are range-partitioned by splitters sampled from them: by the
   bytes from the anchor on, then by those before it. Each bucket sorts them by multikey quicksort, and for each offset groups
   strings by their common prefix and what stands before the anchor.
4. Only the first and last group of a bucket can go on in a neighbour. Their strings are compared across boundaries by a
   128-bit digest and the least place, with map-side minima, so that no hot group meets in one task.

Cases: null and empty texts, and ones shorter than length, lose nothing; a document is known by its id and a hash of its text,
so rows repeated with both alike are one document; null ids come last; removed runs that touch are one span; bytes are removed,
so a character may be cut; extra columns are carried by ``kept_text`` only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, among, arrow_column, fresh, gathered, mixed, partitions, slices, spans_union, stored, table, tidy, utf8

LENGTH, KGRAM = 100, 32
#: Bytes of text that a task settles at once, and those for each bucket; open suffixes for each range.
BATCH_BYTES, BUCKET_BYTES, RANGE_ROWS = 16 << 20, 16 << 20, 200_000
#: Frequent k-grams are those seen so often in a sample: at most the share of the documents, and the bytes.
SEEN, SHARE, SAMPLE_BYTES = 24, 1 / 16, 1 << 30
_PLACE = np.uint64((1 << 31) - 1)
LAST = (1 << 63) - 1

#: Columns of anchors: hash of the k-gram, hash of the context, document id, its text's hash, first start, offsets of the anchor in the last and first string.
ANCHOR = [("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("start", "<i8"), ("lo", "<i4"), ("hi", "<i4")]


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """Row, k-gram hash, context hash, first start within the row, and the anchor's offset in the last and the first string."""
    n = len(data)
    ends = np.repeat(offs[1:], np.diff(offs))
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return none
    starts = np.flatnonzero(ends - np.arange(n) >= length)
    if not len(starts):
        return none
    at = np.arange(n - k + 1)
    first, second = RangeHash(data, 0), RangeHash(data, 1)
    gram = first(at, at + k)
    low = (gram & ~_PLACE) | (_PLACE - at.astype(np.uint64))
    width, span = length - k + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (_PLACE - (low[starts] & _PLACE)).astype(np.int64)
    row = np.searchsorted(offs, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(row) != 0)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(starts)) - 1
    a, s, t = anchor[begin], starts[begin], starts[last]
    context = second(s, t + length) ^ mixed((a - s).astype(np.uint64), 5)
    return row[begin], gram[a], context, s - offs[row[begin]], a - t, a - s


def pack(columns: list[np.ndarray]) -> bytes:
    parts = [np.ascontiguousarray(x.astype(t)) for x, (_, t) in zip(columns, ANCHOR)]
    return pa.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in parts), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> list[np.ndarray]:
    size = sum(np.dtype(t).itemsize for _, t in ANCHOR)
    flat = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8)
    out, i = [], 0
    for _, t in ANCHOR:
        w = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(flat[i : i + n * w].reshape(w, n).T).view(t).ravel())
        i += n * w
    return out


#: What goes to the buckets: n packed anchors, or (n below zero) packed spans that a batch has settled.
SENT = "bucket int, n bigint, packed binary"
#: Settled spans (kind 0: start, stop) and open anchors (kind 1: the anchor's place, offsets lo and hi).
FOUND = "kind int, doc bigint, mark bigint, start bigint, stop bigint, lo int, hi int"


def _merged(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Spans joined within each document."""
    if not len(doc):
        return [doc, mark, start, stop]
    order = np.lexsort((start, mark, doc))
    doc, mark, start, stop = (x[order] for x in (doc, mark, start, stop))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(mark) != 0)
    group = np.cumsum(new) - 1
    shift = group * (int(stop.max()) + 2)
    s, e = spans_union(start + shift, stop + shift)
    g = np.searchsorted(shift, s, "right") - 1
    return [doc[g], mark[g], s - shift[g], e - shift[g]]


def _settle(cols: list[np.ndarray], length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The least place of each (k-gram, context), and the spans of all others."""
    gram, context, doc, mark, start, lo, hi = cols
    order = np.lexsort((start, mark, doc, context, gram))
    g, c = gram[order], context[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    # a row of the same place is the same document again: it stays with the first
    at = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    head = order[at]
    same = (doc[order] == doc[head]) & (mark[order] == mark[head]) & (start[order] == start[head])
    later = order[~new & ~same]
    return order[new], _merged(doc[later], mark[later], start[later], start[later] + (hi - lo)[later] + length)


def _find(buckets: int, length: int, k: int, frequent):
    """frequent: a broadcast of the ordered frequent k-grams."""

    def flush(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*parts)]
        # only k-grams that occur twice in the batch need the sort
        _, inverse, count = np.unique(cols[0], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[inverse] > 1)
        kept, spans = _settle([x[twice] for x in cols], length)
        rest = np.sort(np.concatenate([np.flatnonzero(count[inverse] == 1), twice[kept]]))
        cols = [x[rest] for x in cols]
        to = np.where(among(cols[0], frequent.value), cols[0] ^ cols[1], cols[0])
        b = (((mixed(to, 9) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
            if len(part):
                yield _sent(int(b[part[0]]), len(part), pack([x[part] for x in cols]))
        if len(spans[0]):
            yield _sent(int(spans[0][0]) % buckets, -len(spans[0]), pa.compress(np.stack(spans).astype("<i8").tobytes(), codec="zstd", asbytes=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            data, offs = utf8(batch.column(2))
            doc, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, j in slices(offs):
                row, gram, context, start, lo, hi = anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length, k)
                if len(row):
                    parts.append([gram, context, doc[i:j][row], mark[i:j][row], start, lo, hi])
                size += int(offs[j] - offs[i])
                if size >= BATCH_BYTES and parts:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return run


def _sent(bucket: int, n: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([n], pa.int64()), pa.array([packed], pa.binary())], names=["bucket", "n", "packed"])


def _found(kind: int, doc, mark, start, stop, lo=None, hi=None) -> pa.Table:
    n = len(doc)
    low, high = (pa.nulls(n, pa.int32()) if x is None else pa.array(x.astype(np.int32)) for x in (lo, hi))
    return pa.table({"kind": pa.array(np.full(n, kind, np.int32)), "doc": pa.array(doc, pa.int64()), "mark": pa.array(mark, pa.int64()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64()), "lo": low, "hi": high})


def _compare(length: int, frequent):
    def run(group: pa.Table) -> pa.Table:
        """Settled spans and open anchors of a bucket."""
        out = []
        here = group.filter(pa.compute.greater(group.column("n"), 0))
        spans = group.filter(pa.compute.less(group.column("n"), 0))
        for raw, n in zip(spans.column("packed").to_pylist(), spans.column("n").to_pylist()):
            out.append(_found(0, *np.frombuffer(pa.decompress(raw, -32 * n, codec="zstd", asbytes=True), "<i8").reshape(4, -n)))
        if here.num_rows:
            cols = [unpack(p, n) for p, n in zip(here.column("packed").to_pylist(), here.column("n").to_pylist())]
            grams = np.concatenate([x[0] for x in cols])
            ordered = np.sort(grams)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            del ordered
            pick = np.flatnonzero(among(grams, twice) | among(grams, frequent.value))
            cols = [np.concatenate([x[i] for x in cols])[pick] for i in range(len(ANCHOR))]
            first, later = _settle(cols, length)
            out.append(_found(0, *later))
            gram, _, doc, mark, start, lo, hi = (x[first] for x in cols)
            differ = among(gram, frequent.value)
            if len(gram) > 1:
                same = gram[1:] == gram[:-1]
                differ[1:] |= same
                differ[:-1] |= same
            out.append(_found(1, doc[differ], mark[differ], (start + hi)[differ], (start + hi)[differ], lo[differ], hi[differ]))
        return pa.concat_tables(out) if out else _found(0, *[np.zeros(0, np.int64)] * 4)

    return run


def _suffixes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = []
                for r in part.to_pylist():
                    raw = (r["text"] or "").encode("utf-8", "surrogatepass")
                    for o in r["open"]:
                        a, lo, hi = o["start"], o["lo"], o["hi"]
                        rows.append((r["doc"], r["mark"], a, lo, hi, raw[a : a + length - lo], raw[a - hi : a][::-1]))
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["doc", "mark", "anchor", "lo", "hi", "after", "before"])

    return run


def multikey_quicksort(words: np.ndarray, small: int = 48) -> np.ndarray:
    """The order of rows of big words: three-way partition by one word, equal rows go on with the next."""
    out = []
    todo = [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) < 2 or depth == words.shape[1]:
            out.append(rows)
            continue
        if len(rows) <= small:
            out.append(rows[np.lexsort(words[rows, depth:].T[::-1])])
            continue
        col = words[rows, depth]
        pivot = np.sort(col[[0, len(col) // 2, -1]])[1]
        less, more = col < pivot, col > pivot
        todo += [(rows[more], depth), (rows[~less & ~more], depth + 1), (rows[less], depth)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _matrix(column: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in column), np.uint8).reshape(len(column), width)


#: Settled spans, and n packed strings of a bucket's ends (digest, document, mark, start) for a bucket of digests.
SORTED = "doc bigint, mark bigint, start bigint, stop bigint, bucket int, n bigint, packed binary"


def _sort(length: int, k: int, buckets: int):
    wide, back = -(-length // 8) * 8, -(-(length - k) // 8) * 8

    def bucket(t: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, mark, anchor = (t.column(c).to_numpy() for c in ("doc", "mark", "anchor"))
        lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
        after, before = _matrix(t.column("after").to_pylist(), wide), _matrix(t.column("before").to_pylist(), back)
        order = multikey_quicksort(np.concatenate([after, before], axis=1).view(">u8").astype(np.uint64))
        doc, mark, anchor, lo, hi, after, before = (x[order] for x in (doc, mark, anchor, lo, hi, after, before))
        m = len(doc)
        unlike = after[1:, :length] != after[:-1, :length]
        lcp = np.where(unlike.any(1), unlike.argmax(1), length)
        by_place = np.lexsort((anchor, mark, doc))
        gone = np.zeros((m, length - k + 2), bool)
        left = np.zeros(m, np.uint64)
        ends: list[tuple[int, np.ndarray]] = []
        for o in range(length - k + 1):
            if o:
                left = mixed(left * np.uint64(257) + before[:, o - 1].astype(np.uint64) + np.uint64(1), 11)
            group = np.concatenate([[0], np.cumsum(lcp < length - o)])
            fits = (lo <= o) & (o <= hi)
            rows = by_place[fits[by_place]]
            if not len(rows):
                continue
            key = mixed(left[rows] ^ mixed(group[rows].astype(np.uint64), 12), 13)
            _, head, which = np.unique(key, return_index=True, return_inverse=True)
            first = rows[head[which]]
            gone[rows, o] = (doc[rows] != doc[first]) | (mark[rows] != mark[first]) | (anchor[rows] != anchor[first])
            edge = rows[head]  # all but the first place of a string are settled here
            edge = edge[(group[edge] == 0) | (group[edge] == group[-1])]
            if len(edge):
                ends.append((o, edge))
        # runs of offsets are runs of starts: the string at offset o starts at anchor - o
        step = np.diff(np.concatenate([np.zeros((m, 1), np.int8), gone.astype(np.int8)], axis=1), axis=1)
        r, a = np.nonzero(step == 1)
        r2, b = np.nonzero(step == -1)
        spans = _merged(doc[r], mark[r], anchor[r] - (b - 1), anchor[r] - a + length)
        yield _sorted(spans, [], [], [])
        if not ends:
            return
        places = np.concatenate([np.stack([doc[rows], mark[rows], anchor[rows] - o], 1) for o, rows in ends])
        digests = b"".join(hashlib.blake2b(before[i, :o][::-1].tobytes() + after[i, : length - o].tobytes(), digest_size=16).digest() for o, rows in ends for i in rows)
        digests = np.frombuffer(digests, "<u8").reshape(-1, 2)
        to = (((digests[:, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(to[order])) + 1)
        packed = [pa.compress(np.concatenate([digests[x].view(np.int64), places[x]], axis=1).astype("<i8").tobytes(), codec="zstd", asbytes=True) for x in parts]
        yield _sorted([np.zeros(0, np.int64)] * 4, [int(to[x[0]]) for x in parts], [len(x) for x in parts], packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from bucket(pa.Table.from_batches(held))

    return run


def _sorted(spans: list[np.ndarray], buckets: list[int], sizes: list[int], packed: list[bytes]) -> pa.RecordBatch:
    n, m = len(spans[0]), len(packed)
    four = [pa.array([*x.tolist(), *[None] * m], pa.int64()) for x in spans]
    rest = (buckets, pa.int32()), (sizes, pa.int64()), (packed, pa.binary())
    return pa.RecordBatch.from_arrays([*four, *(pa.array([None] * n + x, t) for x, t in rest)], names=["doc", "mark", "start", "stop", "bucket", "n", "packed"])


def _ends(length: int):
    def run(group: pa.Table) -> pa.Table:
        """Spans of all but the least place of each string of a bucket of digests."""
        raw = [np.frombuffer(pa.decompress(p, 40 * n, codec="zstd", asbytes=True), "<i8").reshape(n, 5) for p, n in zip(group.column("packed").to_pylist(), group.column("n").to_pylist())]
        one, two, doc, mark, start = np.concatenate(raw).T
        order = np.lexsort((start, mark, doc, two, one))
        new = np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = order[(doc[order] != doc[head]) | (mark[order] != mark[head]) | (start[order] != start[head])]
        spans = _merged(doc[later], mark[later], start[later], start[later] + length)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("doc", "mark", "start", "stop"), spans)})

    return run


def _keyed(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"), *more)


def _grams(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for i, j in slices(offs):
                row, gram = anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length, k)[:2]
                gram = np.unique(np.stack([row.astype(np.uint64), gram]), axis=1)[1] if len(row) else gram  # once a document
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], names=["gram"])

    return run


def frequent_grams(given: DataFrame, size: int, length: int = LENGTH, k: int = KGRAM) -> np.ndarray:
    """The k-grams that SEEN documents of a sample have at an anchor. size: bytes of all texts, so the sample and the list are bounded."""
    share = min(SHARE, SAMPLE_BYTES / max(1, size))
    some = given.where(F.pmod(F.xxhash64(F.lit(3), "doc", "mark"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = some.select("text").mapInArrow(tidy(_grams(length, k)), "gram bigint").groupBy("gram").count().where(F.col("count") >= SEEN)
    return np.sort(np.array([r[0] for r in counts.select("gram").collect()], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """doc, mark, spans (array of start, stop in bytes; they may overlap) of each document that repeats earlier text."""
    spark = docs.sparkSession
    given = _keyed(docs, key, text)
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // BUCKET_BYTES))
    frequent = spark.sparkContext.broadcast(frequent_grams(given, size, length, k))
    sent = given.mapInArrow(tidy(_find(n, length, k, frequent)), SENT)
    found = stored(gathered(sent.groupBy("bucket").applyInArrow(_compare(length, frequent), FOUND), docs), "suffix-found")

    open_ = found.where("kind = 1").groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "lo", "hi")).alias("open"))
    picked = given.join(open_, ["doc", "mark"])
    records = picked.mapInArrow(tidy(_suffixes(length)), "doc bigint, mark bigint, anchor bigint, lo int, hi int, after binary, before binary")
    suffixes = stored(gathered(records, docs), "suffix-open")

    ranged = suffixes.repartitionByRange(max(partitions(spark), -(-suffixes.count() // RANGE_ROWS)), "after", "before")
    settled = stored(gathered(ranged.mapInArrow(tidy(_sort(length, k, n)), SORTED), docs), "suffix-sorted")

    four = "doc bigint, mark bigint, start bigint, stop bigint"
    later = settled.where("n IS NOT NULL").select("bucket", "n", "packed").groupBy("bucket").applyInArrow(_ends(length), four)
    spans = found.where("kind = 0").select("doc", "mark", "start", "stop").union(settled.where("n IS NULL").select("doc", "mark", "start", "stop")).union(later)
    return spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.schema.get_field_index("text")
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            kept, sizes, spans = [], [], []
            for t, given in zip(part.column(text).to_pylist(), part.column(part.schema.get_field_index("spans")).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                s, e = spans_union(np.array([x["start"] for x in given or []], np.int64), np.array([x["stop"] for x in given or []], np.int64))
                pieces, to = [], 0
                for a, b in zip(s.tolist(), e.tolist()):
                    pieces.append(raw[to:a])
                    to = b
                kept.append(b"".join([*pieces, raw[to:]]))
                sizes.append(len(raw))
                spans.append([{"start": a, "stop": b} for a, b in zip(s.tolist(), e.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            rest = [(part.column(i), f.name) for i, f in enumerate(part.schema) if f.name not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*(x for x, _ in rest), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[*(x for _, x in rest), "n_bytes", "removed", "kept"])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """key, n_bytes, removed (spans), kept (the remaining bytes) of each document."""
    kind = docs.schema[key].dataType.simpleString()
    spans = repeated_spans(docs, key, text, length, k)
    given = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    given = _keyed(given, "__key", "__text", "__key")
    joined = given.join(spans, ["doc", "mark"], "left").select(F.col("__key").alias("key"), "text", "spans")
    out = joined.mapInArrow(tidy(_cut), f"key {kind}, n_bytes bigint, removed array<struct<start:bigint,stop:bigint>>, kept binary")
    return gathered(out.withColumnRenamed("key", key), docs)


def _text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, spans in batches:
        kept, removed = [], []
        for t, given in zip(text.to_pylist(), spans.to_pylist()):
            if not given:
                kept.append(t)
                removed.append(0)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            s, e = spans_union(np.array([x["start"] for x in given], np.int64), np.array([x["stop"] for x in given], np.int64))
            edges = np.stack([np.append(0, e), np.append(s, len(raw))], 1).tolist()
            kept.append(b"".join(raw[a:b] for a, b in edges).decode("utf-8", "ignore"))
            removed.append(int((e - s).sum()))
        yield pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(removed, pa.int64())], names=["kept", "n_removed"])


def kept_text(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = KGRAM, into: str | None = None) -> DataFrame:
    """All columns of docs, and last a struct of kept (the text without its repeated passages; cut characters go too) and n_removed.

    The struct is named into (else __kept, or a name like it that docs doesn't have).
    """
    into = into or fresh(docs, "__kept")[0]
    doc, mark, found = fresh(docs, "__doc", "__mark", "__spans")
    spans = repeated_spans(docs, key, text, length, k).select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("spans").alias(found))
    rows = docs.withColumn(doc, F.coalesce(F.col(key).cast("bigint"), F.lit(LAST))).withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = rows.join(spans, [doc, mark], "left")
    cut = arrow_column(_text, "struct<kept:string,n_removed:bigint>", 2)(F.col(text), F.col(found))
    return gathered(joined.select("*", cut.alias(into)).drop(doc, mark, found), docs)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans, and the digest of what remains of every document."""
    out = dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of the length by itself, in hex; the later ones of equal strings cover what goes.
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT r, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT r, h, unnest(range(greatest(0, len(h) // 2 - {LENGTH - 1}))) AS i FROM d)),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS n FROM strings) WHERE n > 1),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g),
ordered AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM runs),
kept AS (SELECT r, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k, sum(b - a) AS n_removed, count(*) AS n_spans FROM ordered JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
