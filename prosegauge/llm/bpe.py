"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

For every word the ranks of its adjacent pairs are the leaves of a segment tree. The root holds the lowest rank and, on ties,
the leftmost position; a merge changes at most three leaves, each in logarithmic time, until no mergeable pair is left. Words whose
tree is one node (most are) are merged together, each a row of a matrix.

The file is the public ``word_bpe_49k.json``: NFC, white space collapsed, lower case, words by pattern, bytes as printable
characters, ``</w>`` at word ends. White space parts all words, so what stands between white space is encoded once and kept in
bounded tables of each worker; texts are never cut.

Cases: a null or empty text (or one of white space only) has no tokens and an empty decoded text; very long words take
O(n log n); repeated rows are encoded each; the strings of special tokens give their ids, as in the library; extra columns
are not carried, so their names can't clash. Code points that only Unicode 16 gives a category or a lower case may differ.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, kept_by, slices, table, tidy, utf8

#: Code points that str.split() parts at but the library's \s doesn't.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = re.compile(f"[{SPACE}]+")
#: Chunks that a worker keeps in each of two generations, and the longest that it keeps: at most some 60 MB a worker, for stages that
#: share it with others; and tables of some 200 MB for a job of its own.
KEPT, KEPT_CHARS = 90_000, 32
ALONE = 300_000
#: Bytes of text whose words are merged together, and the least words of a length for that.
LEARNT, MANY = 1 << 20, 16
INF = 1 << 62
#: Children of a node of the segment tree.
WIDE = 24


def category_ranges(major: str) -> str:
    """The code points whose general category starts with a letter, as ranges of a character class."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


def word_pattern() -> re.Pattern:
    """The pattern of the vocabulary file's pre-tokenizer."""
    letters, digits = category_ranges("L"), category_ranges("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{SPACE}{letters}{digits}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for i, b in enumerate(x for x in range(256) if not out[x]):
        out[b] = chr(256 + i)
    return out


class Vocabulary:
    """Ids and pair ranks from a tokenizer file's text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        known = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = [known.get(i, "") for i in range(max(known) + 1)]
        self.names = [str(i) for i in range(len(self.tokens))]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(ids[a] << 20 | ids[b], rank)
            self.made.append(ids[a + b])
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + self.suffix] for c in letters]


def merge(ids: list[int], pairs: dict[int, int], made: list[int]) -> list[int]:
    """Merge the leftmost pair of lowest rank, again and again, by a segment tree over rank << 32 | position.

    A node has WIDE children, as min() of a short list is quicker than a path of two-way choices; most words are one node.
    """
    n = len(ids)
    if n < 2:
        return ids
    get = pairs.get
    leaves = [INF if (r := get(a << 20 | b)) is None else r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:]))]
    levels = [leaves]
    while len(levels[-1]) > WIDE:
        below = levels[-1]
        levels.append([min(below[i : i + WIDE]) for i in range(0, len(below), WIDE)])
    top, deep = levels[-1], len(levels) > 1
    root = min(top)
    if root == INF:
        return ids
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while root < INF:
        i = root & 0xFFFFFFFF
        j = after[i]
        x = ids[i] = made[root >> 32]
        ids[j] = -1
        k = after[i] = after[j]
        h = before[i]
        leaves[i] = INF
        if k < n:
            before[k] = i
            leaves[j] = INF  # the pair that the right part began
            if (r := get(x << 20 | ids[k])) is not None:
                leaves[i] = r << 32 | i
        if h >= 0:
            leaves[h] = INF if (r := get(ids[h] << 20 | x)) is None else r << 32 | h
        if deep:
            for at in (i, j, h):
                for below, level in zip(levels, levels[1:]):
                    if at < 0 or at >= len(below):
                        break
                    at //= WIDE
                    least = min(below[at * WIDE : at * WIDE + WIDE])
                    if level[at] == least:
                        break
                    level[at] = least
        root = min(top)
    return [x for x in ids if x >= 0]


class Ranks:
    """Pair ranks in an open-addressed table, for many pairs at once; pairs that don't merge rank as INF."""

    BITS = 20

    def __init__(self, pairs: dict[int, int], made: list[int]):
        self.keys = np.array([*pairs, -1], np.int64)
        self.ranks = np.array([*pairs.values(), INF], np.int64)
        self.made = np.array([*made, 0], np.int64)
        self.slots = np.full(1 << self.BITS, len(pairs), np.int32)
        at, todo = self._slot(self.keys[:-1]), np.arange(len(pairs))
        while len(todo):  # of those that want a free slot one gets it; the others go on
            free = self.slots[at] == len(pairs)
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            at, todo = (at[left] + 1) & ((1 << self.BITS) - 1), todo[left]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 20 | b).ravel()
        at = self._slot(keys)
        found = self.slots[at]
        open_ = np.flatnonzero((self.keys[found] != keys) & (found != len(self.keys) - 1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.BITS) - 1)
            found[open_] = self.slots[at[open_]]
            open_ = open_[(self.keys[found[open_]] != keys[open_]) & (found[open_] != len(self.keys) - 1)]
        return self.ranks[found].reshape(a.shape)


def merge_rows(ids: np.ndarray, ranks: Ranks) -> list[list[int]]:
    """merge() of many words of one length whose trees are one node: a row each, the root being the first least leaf of a row."""
    out: list[list[int]] = [[]] * len(ids)
    row = np.arange(len(ids))
    leaves = ranks(ids[:, :-1], ids[:, 1:])
    while len(row):
        n = ids.shape[1]
        root = leaves.argmin(1) if n > 1 else np.zeros(len(row), np.int64)
        least = leaves[np.arange(len(row)), root] if n > 1 else np.full(len(row), INF)
        live = least < INF
        for i, x in zip(row[~live].tolist(), ids[~live].tolist()):
            out[i] = x
        ids, leaves, row, root, least = ids[live], leaves[live], row[live], root[live], least[live]
        if not len(row):
            break
        # the right part goes, and so does the merged pair's leaf; those of its neighbours are new
        k = np.arange(len(row))
        after = np.arange(n - 1)
        ids = np.take_along_axis(ids, after + (after > root[:, None]), 1)
        ids[k, root] = x = ranks.made[least]
        after = np.arange(n - 2)
        leaves = np.take_along_axis(leaves, after + (after >= root[:, None]), 1)
        left, right = root > 0, root < n - 2
        leaves[k[left], root[left] - 1] = ranks(ids[k[left], root[left] - 1], x[left])
        leaves[k[right], root[right]] = ranks(x[right], ids[k[right], root[right] + 1])
    return out


def joined(parts: list[tuple[str, str]]) -> tuple[str, str]:
    return parts[0] if len(parts) == 1 else (" ".join([a for a, _ in parts]), " ".join([b for _, b in parts]))


class Encoder:
    """Encodes and decodes whole texts."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT):
        self.v, self.kept = vocabulary, kept
        self.find = word_pattern().findall
        self.parts = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
        self.chunks: dict[str, tuple[str, str]] = {}
        self.old_chunks: dict[str, tuple[str, str]] = {}
        self.ranks = Ranks(vocabulary.pairs, vocabulary.made)
        self.inner, self.last = np.array(vocabulary.inner), np.array(vocabulary.last)

    def words_of(self, chunk: str) -> list[str]:
        """The words of what stands between white space."""
        if chunk.isascii():
            low = chunk.lower()
            return [low] if low.isalpha() else self.ascii(low)
        # the library lowers each character by itself
        return self.find(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def strings(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """The ids and the tokens of each word, each joined by one space."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            by_size.setdefault(len(raw), []).append((w, raw))
        names, tokens, out = self.v.names, self.v.tokens, {}
        for n, some in by_size.items():
            raw = np.frombuffer(b"".join([r for _, r in some]), np.uint8).reshape(-1, n)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            rows = merge_rows(ids, self.ranks) if n <= WIDE + 1 and len(some) >= MANY else [merge(x, self.v.pairs, self.v.made) for x in ids.tolist()]
            for (w, _), x in zip(some, rows):
                out[w] = " ".join([names[i] for i in x]), " ".join([tokens[i] for i in x])
        return out

    def keep(self, chunk: str, out: tuple[str, str]) -> tuple[str, str]:
        if len(chunk) <= KEPT_CHARS:
            if len(self.chunks) >= self.kept:
                self.old_chunks, self.chunks = self.chunks, {}
            self.chunks[chunk] = out
        return out

    def learn(self, texts: list[str]) -> None:
        """Keeps all chunks that the texts have and the tables don't; their words are merged together."""
        todo: set[str] = set()
        for t in texts:
            todo.update(t.split())
        todo.difference_update(self.chunks)
        of = {c: self.words_of(c) for c in todo if len(c) <= KEPT_CHARS and c not in self.old_chunks}
        made = self.strings({w for ws in of.values() for w in ws})
        for c, ws in of.items():
            self.keep(c, joined([made[w] for w in ws]))

    def chunk(self, chunk: str) -> tuple[str, str]:
        """The ids and the tokens of what stands between white space."""
        if (out := self.old_chunks.get(chunk)) is None:
            words = self.words_of(chunk)
            made = self.strings(set(words))
            out = joined([made[w] for w in words])
        return self.keep(chunk, out)

    def plain(self, text: str) -> list[tuple[str, str]]:
        odd = any(c in text for c in ODD_SPACE)
        made, out = self.chunk, []
        pieces = [x for x in WHITE.split(text) if x] if odd else text.split()
        for at in range(0, len(pieces), 4096):  # the young table may be another one after a miss
            get = self.chunks.get
            out += [get(c) or made(c) for c in pieces[at : at + 4096]]
        return out

    def __call__(self, text: str) -> tuple[str, str]:
        if self.parts is not None and "<|" in text:
            found: list[tuple[str, str]] = []
            for x in self.parts.split(text):
                found += [(str(self.v.special[x]), x)] if x in self.v.special else self.plain(x)
        else:
            found = self.plain(text)
        if not found:
            return "", ""
        ids, tokens = zip(*found)
        return " ".join(ids), " ".join(tokens)


def encoder_of(vocabulary: str, kept: int = KEPT) -> Encoder:
    """The encoder of a worker, by its vocabulary and tables: it outlives the task, until another operator works there."""
    have, name = kept_by("bpe"), (hash(vocabulary), kept)
    if name not in have:
        have.clear()
        have[name] = Encoder(Vocabulary(vocabulary), kept)
    return have[name]


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def learnt(rows, column: pa.Array, encode: Encoder) -> Iterator[tuple]:
    """Slices of rows with their texts, whose words the encoder has learnt."""
    _, offs = utf8(column)
    for i, j in slices(offs, LEARNT):
        texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
        encode.learn(texts)
        yield rows.slice(i, j - i), texts


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", kept: int = ALONE) -> DataFrame:
    """key, n_tokens, ids_text (decimal ids joined by one space) and decoded of every whole text.

    vocabulary is the text of the tokenizer file (under 2 MB; it is broadcast); kept: chunks that a worker keeps.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shared.value, kept)
        for batch in batches:
            for part, texts in learnt(batch, batch.column(1), encode):
                ids, decoded = zip(*map(encode, texts))
                counts = pa.array([a.count(" ") + 1 if a else 0 for a in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["key", "n_tokens", "ids_text", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run, "bpe"), f"key {kind}, n_tokens bigint, ids_text string, decoded string")
    return out.withColumnRenamed("key", key)


def with_tokens(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "bpe") -> DataFrame:
    """All columns of docs, and a struct of n_tokens, ids_text and decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder_of(shared.value)
        for column in batches:
            both = [x for _, texts in learnt(column, column, encode) for x in map(encode, texts)]
            cols = [a.count(" ") + 1 if a else 0 for a, _ in both], [a for a, _ in both], [b for _, b in both]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["n_tokens", "ids_text", "decoded"])

    return docs.withColumn(into, arrow_column(run, "struct<n_tokens:bigint,ids_text:string,decoded:string>", operator="bpe")(F.col(text)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    out = encode_decode(table(spark, sf_dir, "documents"), vocabulary_text(vocabulary_path or default_path()))
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
