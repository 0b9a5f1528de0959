"""Benchmark decontamination by suffix arrays of the training text.

The training words are cut into shards of whole documents. In each shard the suffixes that begin with benchmark words are
sorted by their leading words; every suffix of the benchmark is looked up by binary search, which narrows a range of the
suffix array word by word and so finds its longest match up to the window length and all places of it. Adjacent windows of
an item join to the longest verbatim matches, with their places. Nothing is shuffled; the benchmark goes round in blocks
of a fixed size, each broadcast by itself, so its size has no bound but the broadcast has.

Cases: an item with a null id is looked for like any other, and its matches have a null item_id; null or empty texts have no words; an item of fewer words than the window is one window, one without words none;
repeated rows are judged each; overlapping hits count once; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, RangeHash, arrow_column, byte_class, slices, stored, table, tidy, utf8, words

#: Words: digits, a-z and all code points from U+0080 on, after A-Z are lower-cased.
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
WINDOW = 10
#: Bytes of benchmark text in one block, at four a character.
BLOCK_BYTES = 16 << 20

MATCH = "item_id bigint, doc_word bigint, item_word bigint, n_words bigint"


class Block:
    """Word ids and windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        data, offs = utf8(pa.array([(t or "") for _, t in items], pa.string()))
        data = LOWER[data]
        s, e, first = words(data, offs, WORD)
        h = RangeHash(data)(s, e)
        self.vocabulary = np.unique(h)
        self.ids = np.searchsorted(self.vocabulary, h) + 1
        n = np.diff(first)
        item = np.repeat(np.arange(len(items)), n)
        left = (first[1:][item] - np.arange(len(h))) if len(h) else np.zeros(0, np.int64)
        size = np.minimum(window, n)
        self.starts = np.flatnonzero(left >= size[item]) if len(h) else np.zeros(0, np.int64)
        self.item = item[self.starts]
        self.length = size[self.item]
        self.word = self.starts - first[:-1][self.item] if len(h) else np.zeros(0, np.int64)
        self.item_ids = [i for i, _ in items]
        self.shortest = int(self.length.min()) if len(self.starts) else 0


class Shard:
    """The suffix array of a slice of training documents, of the suffixes that can match."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, block: Block):
        n, w = len(ids), block.window
        stop = np.zeros(n + 1, bool)
        stop[first] = True
        stop[n] = True
        alien = np.flatnonzero((ids == 0) | stop[:-1])
        # the end of the run of benchmark words at i: the next alien word or document start after it
        nxt = np.append(alien, n)[np.searchsorted(alien, np.arange(n), "right")]
        at = np.flatnonzero((ids > 0) & (nxt - np.arange(n) >= max(1, block.shortest)))
        run = nxt[at] - at
        keys = np.zeros((w, len(at)), np.int64)
        for j in range(w):
            ok = run > j
            keys[j, ok] = ids[at[ok] + j]
        order = np.lexsort(keys[::-1]) if len(at) else at
        self.suffix, self.keys = at[order], keys[:, order]

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix the range of training suffixes that begin with its window."""
        m = len(block.starts)
        lo, hi = np.zeros(m, np.int64), np.full(m, len(self.suffix), np.int64)
        for j in range(block.window):
            live = np.flatnonzero((block.length > j) & (lo < hi))
            if not len(live):
                break
            want = block.ids[block.starts[live] + j]
            col = self.keys[j]
            for right in (False, True):
                a, b = lo[live].copy(), hi[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    v = col[np.minimum(mid, len(col) - 1)]
                    go = open_ & ((v <= want) if right else (v < want))
                    a = np.where(go, mid + 1, a)
                    b = np.where(open_ & ~go, mid, b)
                if right:
                    new_hi = a
                else:
                    new_lo = a
            lo[live], hi[live] = new_lo, new_hi
        return lo, hi


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each range and every place in it, one after the other."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def scan(data: np.ndarray, offs: np.ndarray, block: Block) -> Iterator[tuple[int, int, list[dict]]]:
    """Words, hit words and longest matches of each document of a slice."""
    data = LOWER[data]
    s, e, first = words(data, offs, WORD)
    n_words = np.diff(first)
    hit = np.zeros(len(s) + 1, np.int64)
    rows: list[list[dict]] = [[] for _ in n_words]
    if len(block.starts) and len(s):
        h = RangeHash(data)(s, e)
        at = np.searchsorted(block.vocabulary, h)
        ids = np.where(block.vocabulary[np.minimum(at, len(block.vocabulary) - 1)] == h, at + 1, 0)
        shard = Shard(ids, first, block)
        window, place = spread(*shard.search(block))
        if len(window):
            pos, size = shard.suffix[place], block.length[window]
            np.add.at(hit, pos, 1)
            np.add.at(hit, pos + size, -1)
            item, word = block.item[window], block.word[window]
            doc = np.searchsorted(first, pos, "right") - 1
            order = np.lexsort((pos, pos - word, item, doc))
            doc, item, word, pos, size = doc[order], item[order], word[order], pos[order], size[order]
            new = np.ones(len(pos), bool)
            new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(pos - word) != 0) | (np.diff(pos) != 1)
            begin = np.flatnonzero(new)
            last = np.append(begin[1:] - 1, len(pos) - 1)
            for b, l in zip(begin.tolist(), last.tolist()):
                rows[doc[b]].append({"item_id": block.item_ids[item[b]], "doc_word": int(pos[b] - first[doc[b]]), "item_word": int(word[b]), "n_words": int(pos[l] + size[l] - pos[b])})
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
    n_hit = covered[first[1:]] - covered[first[:-1]]
    yield from zip(n_words.tolist(), n_hit.tolist(), rows)


def blocks(bench: DataFrame, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks; one partition at a time is on the driver."""
    rows: list[tuple[int, str]] = []
    held = 0
    for r in bench.toLocalIterator():
        rows.append((r[0], r[1]))
        held += 4 * len(r[1] or "") + 16
        if held >= size:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def matches(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_hit, matches (array of item_id, doc_word, item_word, n_words) of every document.

    With more than one block of benchmark text the rows are numbered and stored, and read once a block; then n_hit of each row comes
    from the union of its matches.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    fields = "n_words bigint, n_hit bigint, matches array<struct<item_id:bigint,doc_word:bigint,item_word:bigint,n_words:bigint>>"
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = [spark.sparkContext.broadcast(items) for items in blocks(bench.select(item, text))] if bench is not None else []
    if len(shared) < 2:
        return given.mapInArrow(tidy(_runner(shared[0] if shared else spark.sparkContext.broadcast([]), window)), f"key {kind}, {fields}").withColumnRenamed("key", key)
    # keys may be null or repeated, so the parts of a row meet by its number
    given = stored(given.select(F.struct(F.monotonically_increasing_id().alias("row"), "key").alias("key"), "text"), "numbered-docs")
    parts = [given.mapInArrow(tidy(_runner(x, window)), f"key struct<row:bigint,key:{kind}>, {fields}") for x in shared]
    both = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    ranges = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"].alias("s"), (m["doc_word"] + m["n_words"]).alias("e"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    add = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["to"], r["s"]))).cast("bigint").alias("n"), F.greatest(a["to"], r["e"]).alias("to"))
    return both.select(F.col("key.key").alias(key), "n_words", F.aggregate(ranges, zero, add)["n"].alias("n_hit"), "matches")


def _runner(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            block = block or Block(shared.value, window)
            data, offs = utf8(batch.column(1))
            for i, j in slices(offs):
                rows = list(scan(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], block))
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind)], names=["key", "n_words", "n_hit", "matches"])

    return run


def _hits(shared, window: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = None
        for column in batches:
            block = block or Block(shared.value, window)
            data, offs = utf8(column)
            yield pa.array([n for i, j in slices(offs) for _, n, _ in scan(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], block)], pa.int64())

    return run


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with all their columns; each block of the benchmark is a filter."""
    for items in blocks(bench.select(item, text)):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.where(arrow_column(_hits(shared, window), "bigint")(F.col(text)) == 0)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words, items and contamination of every document. Items with a null id count as one, which the digest of ids leaves out."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM documents),
b AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
items AS (SELECT item_id, least({WINDOW}, len(w)) AS size, unnest(list_transform(range(greatest(1, len(w) - {WINDOW - 1})), lambda i: array_to_string(w[i + 1 : i + {WINDOW}], ' '))) AS words FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT size, words FROM items),
places AS (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
met AS (SELECT r, i, size, words FROM (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS words FROM places) JOIN windows USING (size, words)),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS j FROM met) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM met JOIN items USING (size, words) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""
