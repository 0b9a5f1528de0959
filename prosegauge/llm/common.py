"""Helpers shared by the operators of this folder: tables, shared storage and byte-level numpy kernels."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text is handled by the vector kernels in slices of about this many bytes (one document is never cut).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; a machine's own only where Spark is that machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir() + "/prosegauge"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to shared storage and read it again: cuts the lineage and survives lost executors.

    The shuffle files of the write go at its end: nothing reads them again.
    """
    spark = df.sparkSession
    path, before = work_dir(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input for each task that writes, and the fewest such tasks.
WRITE_BYTES, FEWEST_WRITERS = 8 << 20, 12


def gathered(df: DataFrame, source: DataFrame) -> DataFrame:
    """df in no more partitions than the size of its source asks for, so that small inputs aren't written as many tiny files."""
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(min(max(FEWEST_WRITERS, -(-size // WRITE_BYTES)), 1 << 30))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, by which bucket counts follow the cluster's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is True in the given inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split at white space: all but 0x20 and 0x09-0x0D.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in a class, never across rows, and the index of each row's first word."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = np.zeros(n + 2, bool)
    m[1:-1] = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(m[1:-1] & (~m[:-2] | cut[:-1]))
    ends = np.flatnonzero(m[1:-1] & (~m[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    return _splitmix(x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))


#: Odd bases of the polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTES = [mixed(np.arange(256, dtype=np.uint64), 40 + i) for i in range(2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, kept for the longest slice so far."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES + 4096)
        base = BASES[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[which] = tuple(both)
        if n > 8 * SLICE_BYTES:
            _POWERS.pop(which)
    return have


class RangeHash:
    """64-bit hashes of any byte ranges of a slice, from one prefix sum."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which = which
        power, self.inverse = _powers(which, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * power[: len(data)], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 7 + self.which)


#: Bytes of a batch that a Python worker gets at once, and Spark's setting for it.
BATCH, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded() -> None:
    """Batches for Python workers are small in this session, unless the cluster has a bound of its own."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext.getConf().get(BATCH_SETTING) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH))


#: What a worker keeps from one task to the next, by operator; only the operator at work has anything here.
_KEPT: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """The tables that this worker keeps for an operator; those of others, whose stages are over, are dropped."""
    if operator not in _KEPT:
        _KEPT.clear()
        _KEPT[operator] = {}
        give_back()
    return _KEPT[operator]


def give_back() -> None:
    """Free memory goes back to the system, as workers outlive their tasks."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Iterator], Iterator], operator: str = "") -> Callable[[Iterator], Iterator]:
    """A task's function that drops other operators' tables before it begins and gives free memory back when it ends."""
    bounded()

    def tidied(batches):
        kept_by(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def arrow_column(run, schema: str, columns: int = 1, operator: str = ""):
    """A vectorised column function from an iterator over batches of Arrow arrays (tuples of them for more columns)."""
    from pyspark.sql.functions import arrow_udf

    run = tidy(run, operator)
    taken = Iterator[pa.Array] if columns == 1 else Iterator[tuple[(pa.Array,) * columns]]
    run.__annotations__ = {"batches": taken, "return": Iterator[pa.Array]}
    return arrow_udf(run, schema).asNondeterministic()  # else the optimizer may run it again for a filter


def binary(arrays: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([x if isinstance(x, bytes) else x.tobytes() for x in arrays], pa.binary())


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which elements are in an ordered array."""
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x if len(ordered) else np.zeros(len(x), bool)


def spans_union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching half-open ranges."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(s), bool)
    first[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(first)
    return s[at], e[np.append(at[1:] - 1, len(s) - 1)]
