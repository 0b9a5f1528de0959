"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

A model of four characters is fitted for each language on a bounded sample of labelled texts. All languages share one sorted
array of n-gram hashes for each order, with a column of log probabilities for each language, and one of contexts with the
back-off weights. A text gets the language of the lowest cross-entropy for each character. Runs of what isn't a letter count
as one space; letters are lower-cased.

Rejection is calibrated on sampled texts that the model was not fitted on: a text whose cross-entropy lies more than
``REJECT`` deviations above the mean of its language is marked ``rejected``; the deviation has a part that shrinks with the
root of the length, so short texts are not rejected for being short.

Cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; with nothing to learn from, so is every
text; ties go to the first language by name; repeated rows are predicted each; texts are scored whole; languages, sources and
ids are never inputs of a prediction; ``predict`` carries all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_column, fresh, slices, table, utf8

ORDER = 4
#: Bounds of the sample: the most frequent labels, documents of each, bytes of a sampled document, and bytes of all. Half of the
#: documents fit, half calibrate.
MOST_LANGS, SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TOTAL = 64, 800, 1 << 16, 32 << 20
REJECT = 12.0
#: Bytes of text that are scored at once.
SCORED_BYTES = 1 << 19
#: Turns differences of cross-entropy (nats for each character) into odds.
SHARPNESS = 12.0
DISCOUNT = 0.75
UNDETERMINED = "und"
_K = np.uint64(0x9E3779B97F4A7C15)
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of all texts, each text ending with one space, and the text of each."""
    flat = np.frombuffer("\n".join(texts + [""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    size = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    ok = letters()[flat]
    ends = np.cumsum(size) - 1
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # the first of a run of other characters after a letter
    doc = np.repeat(np.arange(len(texts)), size)
    keep[ends] = True
    # a text's closing character is its one space: an other character just before it with nothing but others between goes
    drop = np.flatnonzero(keep & ~ok)
    same = np.zeros(len(drop), bool)
    same[:-1] = (drop[1:] == ends[doc[drop[:-1]]]) & (doc[drop[:-1]] == doc[drop[1:]]) if len(drop) > 1 else False
    if same.any():
        letters_to = np.cumsum(ok)
        at = np.flatnonzero(same)
        none = letters_to[drop[at + 1]] == letters_to[drop[at]]
        keep[drop[at[none]]] = False
    chars = np.where(ok, flat, np.uint32(32))
    return chars[keep], doc[keep]


def grams(chars: np.ndarray, doc: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each character, for n = 0 (the empty one) to order; before a text there are spaces."""
    out = [np.zeros(len(chars), np.uint64)]
    power = np.uint64(1)
    c = chars.astype(np.uint64) + np.uint64(1)
    for s in range(order):
        if s == 0:
            x = c
        else:
            x = np.full(len(c), 33, np.uint64)
            if len(c) > s:
                x[s:] = np.where(doc[s:] == doc[:-s], c[:-s], np.uint64(33))
        out.append(out[-1] + x * power)
        with np.errstate(over="ignore"):
            power = power * _K
    return out


def contexts(chars: np.ndarray, doc: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the n characters before each character, for n = 0 to order - 1."""
    before = np.full(len(chars), 32, chars.dtype)
    if len(chars) > 1:
        before[1:] = np.where(doc[1:] == doc[:-1], chars[:-1], 32)
    shifted = grams(before, doc, order - 1)
    return shifted


def _lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of values in a sorted array, or -1."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _kneser_ney(texts: list[str], order: int = ORDER) -> list[tuple[np.ndarray, ...]]:
    """For n = 1 to order: n-gram hashes (sorted), their shorter n-grams, contexts, and counts: raw at the top, continuations below."""
    chars, doc = stream(texts)
    g, ctx = grams(chars, doc, order), contexts(chars, doc, order)
    out = []
    key, first = np.unique(g[order], return_index=True)
    count = np.unique(g[order], return_counts=True)[1]
    for n in range(order, 0, -1):
        out.append((key, g[n - 1][first], ctx[n - 1][first], count))
        if n > 1:
            # a shorter n-gram counts once for each distinct longer one that ends with it
            short = g[n - 1][first]
            key, inner, count = np.unique(short, return_index=True, return_counts=True)
            first = first[inner]
    return out[::-1]


class Model:
    """log_p[n] and log_gamma[n]: (sorted hashes, one column for each language), for n = 1 to order."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER, discount: float = DISCOUNT):
        self.order, self.langs = order, sorted(samples)
        if not samples:
            return
        raw = [_kneser_ney(samples[x], order) for x in self.langs]
        size = max(2, len(np.unique(np.concatenate([r[0][0] for r in raw]))) + 1)
        self.floor = -np.log(size * 4)  # an unseen character
        self.p: list[tuple[np.ndarray, np.ndarray]] = []
        self.gamma: list[tuple[np.ndarray, np.ndarray]] = []
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for n in range(1, order + 1):
            keys = np.unique(np.concatenate([r[n - 1][0] for r in raw]))
            heads = np.unique(np.concatenate([r[n - 1][2] for r in raw]))
            short = np.zeros(len(keys), np.uint64)
            head = np.zeros(len(keys), np.uint64)
            p = np.zeros((len(keys), len(raw)))
            gamma = np.ones((len(heads), len(raw)))
            for r in raw:
                at = np.searchsorted(keys, r[n - 1][0])
                short[at], head[at] = r[n - 1][1], r[n - 1][2]
            for l, r in enumerate(raw):
                key, _, ctx, count = r[n - 1]
                h = np.searchsorted(heads, ctx)
                total = np.bincount(h, count, len(heads))
                kinds = np.bincount(h, minlength=len(heads))
                seen = total > 0
                gamma[seen, l] = discount * kinds[seen] / total[seen]
                p[np.searchsorted(keys, key), l] = np.maximum(count - discount, 0) / total[h]
            if lower is None:
                below = np.full((len(keys), len(raw)), np.exp(self.floor))
            else:
                below = np.exp(lower[1][np.searchsorted(lower[0], short)])
            p += gamma[np.searchsorted(heads, head)] * below
            lower = keys, np.log(p)
            self.p.append((keys, np.log(p).astype(np.float32)))
            self.gamma.append((heads, np.log(gamma).astype(np.float32)))
        self.mean = np.zeros(len(raw))
        self.spread = np.zeros((len(raw), 2))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats for each character by text and language, and the characters (letters and spaces) of each text."""
        chars, doc = stream(texts)
        g = grams(chars, doc, self.order)
        total = np.zeros((len(chars), len(self.langs)), np.float32)
        open_ = np.arange(len(chars))
        ctx = None
        for n in range(self.order, 0, -1):
            keys, log_p = self.p[n - 1]
            at = _lookup(keys, g[n][open_])
            hit = at >= 0
            total[open_[hit]] += log_p[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            ctx = ctx if ctx is not None else contexts(chars, doc, self.order)
            heads, log_g = self.gamma[n - 1]
            at = _lookup(heads, ctx[n - 1][open_])
            hit = at >= 0
            total[open_[hit]] += log_g[at[hit]]
        total[open_] += self.floor
        first = np.searchsorted(doc, np.arange(len(texts)))
        sums = np.add.reduceat(total, first, axis=0, dtype=np.float64) if len(texts) else np.zeros((0, len(self.langs)))
        n = np.diff(np.append(first, len(chars)))
        return -sums / np.maximum(n, 1)[:, None], n

    def calibrate(self, held: dict[str, list[str]]) -> None:
        """Mean and deviations of each language's own cross-entropy on texts not fitted."""
        for l, lang in enumerate(self.langs):
            h, n = self.score(held.get(lang) or [])
            h, n = h[:, l], n.astype(float)
            if len(h):
                self.mean[l] = np.average(h, weights=n)
                scaled = np.sqrt(np.average((h - self.mean[l]) ** 2 * n, weights=None)) if len(h) > 1 else 1.0
                self.spread[l] = max(float(np.std(h[n >= np.median(n)])), 0.1), max(scaled, 1.0)
            else:
                self.mean[l], self.spread[l] = -self.floor, (1.0, 1.0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy and rejection of each text."""
        known = [i for i, t in enumerate(texts) if t and letters()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()] if self.langs else []
        out: list[tuple[str, float, float | None, bool]] = [(UNDETERMINED, 0.0, None, True)] * len(texts)
        if known:
            h, n = self.score([texts[i] for i in known])
            best = h.argmin(1)
            low = h[np.arange(len(h)), best]
            odds = 1 / np.exp(-SHARPNESS * (h - low[:, None])).sum(1)
            limit = self.mean[best] + REJECT * (self.spread[best, 0] + self.spread[best, 1] / np.sqrt(n))
            for k, i in enumerate(known):
                out[i] = self.langs[best[k]], float(odds[k]), float(low[k]), bool(low[k] > limit[k])
        return out


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES, total: int = SAMPLE_TOTAL, most: int = MOST_LANGS) -> Model:
    """A model of the most frequent labels, of at most docs texts of at most size bytes for each, picked by a hash of the key, and total bytes of all."""
    rank = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1 << 53))
    counts = {r[0]: r[1] for r in labelled.where(F.col(lang).isNotNull()).groupBy(lang).count().orderBy(F.col("count").desc(), lang).limit(most).collect()}
    if not counts:
        return Model({})
    wanted = [F.when(F.col(lang) == x, F.lit(int(min(1.0, 2.0 * docs / n) * (1 << 53)))) for x, n in counts.items()]
    picked = labelled.where(F.col(lang).isNotNull() & (rank < F.coalesce(*wanted, F.lit(0)))).where(F.octet_length(text).between(1, size)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), rank.alias("rank"))
    w = Window.partitionBy("lang").orderBy("rank", "text")
    placed = picked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= docs)
    held = F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    top = placed.withColumn("bytes", held).where(F.col("bytes") <= total // len(counts)).orderBy("lang", "place")
    parts: tuple[dict[str, list[str]], dict[str, list[str]]] = {}, {}
    for r in top.select("lang", "text").toLocalIterator():
        fitted = parts[0].setdefault(r[0], [])
        held = parts[1].setdefault(r[0], [])
        (fitted if len(fitted) <= len(held) else held).append(r[1])
    model = Model(parts[0])
    model.calibrate(parts[1])
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", into: str | None = None) -> DataFrame:
    """All columns of docs, and last a struct of lang, score, cross_entropy and rejected, named into (else __language, or a name like it that docs doesn't have)."""
    into = into or fresh(docs, "__language")[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "struct<lang:string,score:double,cross_entropy:double,rejected:boolean>"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            _, offs = utf8(column)
            rows = []
            for i, j in slices(offs, SCORED_BYTES):
                rows += shared.value.predict(column.slice(i, j - i).to_pylist())
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = pa.string(), pa.float64(), pa.float64(), pa.bool_()
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "score", "cross_entropy", "rejected"])

    return docs.select("*", arrow_column(run, schema)(F.col(text)).alias(into))


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the key as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def learned(docs: DataFrame) -> Model:
    """The model of the contract: all labelled documents but the held-out fold may be sampled."""
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learned(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("__language.lang").alias("lang_pred"), F.col("__language.score").alias("score"), F.col("__language.cross_entropy").alias("cross_entropy"), F.col("__language.rejected").alias("rejected"))
