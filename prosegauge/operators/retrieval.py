"""Index of cases, vector and hybrid retrieval, and the merge of hits into paragraphs.

Vectors are hashed character bigrams, unless the caller has others. The index is the small side: it is broadcast behind a check
of its rows, and queries are held against all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import rounded
from ..sources import library

DIMENSIONS, TOP_K, RRF, LEAD = 64, 5, 60, 64
MOST_ROWS = 20_000
#: Queries, or index rows, that are held as one matrix; rows held against it at once.
BLOCK, TILE = 4096, 1024
#: Beginnings of queries that are held as one automaton.
LEADS = 20_000


class IndexUnavailableError(RuntimeError):
    """No index at the path."""


class IndexRuntimeError(RuntimeError):
    """The index can't be read or written."""


def bigram_counts(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed character bigrams, a row for each text; a single character is a bigram of its own, a null has none."""
    texts = [t or "" for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    one = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two, keep, last = np.append(one[1:], np.uint64(0)), np.ones(len(one), bool), (np.cumsum(size) - 1)[size > 0]
    two[last] = 0
    keep[last] = size[size > 0] == 1
    h = (one << np.uint64(32) | two) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    place = np.repeat(np.arange(len(texts)), size) * dimensions + (h % np.uint64(dimensions)).astype(np.int64)
    return np.bincount(place[keep], minlength=len(texts) * dimensions).reshape(len(texts), dimensions).astype(float)


def embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of hashed character bigrams, as a vectorised function."""

    @F.pandas_udf("array<double>")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(list(bigram_counts(texts.tolist(), dimensions)), dtype=object)

    return counted(text)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def index_rows(cases: DataFrame) -> DataFrame:
    """id, document, metadata (the whole record) and vector of each case."""
    return cases.select("id", library.document().alias("document"), F.struct(*cases.columns).alias("metadata")).withColumn("vector", embedding(F.col("document")))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of an index that were written to the end."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version=*/_SUCCESS")
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    except Exception as e:
        raise IndexUnavailableError(str(e)) from e
    return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found or [])


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The last version of an index."""
    versions = _versions(spark, path)
    if not versions:
        raise IndexUnavailableError(f"no index at {path}")
    try:
        return spark.read.parquet(f"{path.rstrip('/')}/version={versions[-1]}")
    except Exception as e:
        raise IndexRuntimeError(str(e)) from e


def upsert(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The index with rows added or replaced by id, written as a new version beside the old ones, which stay readable."""
    versions = _versions(spark, path)
    try:
        if versions:
            old = spark.read.parquet(f"{path.rstrip('/')}/version={versions[-1]}")
            rows = old.join(rows, "id", "left_anti").unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={versions[-1] + 1 if versions else 0}")
    except Exception as e:
        raise IndexRuntimeError(str(e)) from e
    return open_index(spark, path)


def where(rows: DataFrame, lang: str | None = None, genres: list[str] | None = None) -> DataFrame:
    """Rows of a language and of the first genre only."""
    if lang:
        rows = rows.where(F.col("metadata.lang") == lang)
    return rows.where(F.array_contains("metadata.genres", genres[0])) if genres else rows


def _small(index: DataFrame) -> DataFrame:
    if index.count() > MOST_ROWS:
        raise IndexRuntimeError(f"an index of more than {MOST_ROWS} rows; query it in blocks")
    return F.broadcast(index)


def knn(queries: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, id, rank, similarity: the k most similar rows of the index. queries: query_id, vector; index: id, vector."""
    pairs = queries.select("query_id", F.col("vector").alias("q")).crossJoin(_small(index.select("id", F.col("vector").alias("v"))))
    scored = pairs.select("query_id", "id", rounded(cosine(F.col("q"), F.col("v")), 6).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Unit vectors; a null, one of another length, and one of no length are zero, which is similar to nothing."""
    out = np.zeros((len(column), dimensions))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dimensions and None not in v:
            out[i] = v
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _nearest(shared, k: int, turned: bool):
    """Pairs of rows and the held block that may be among a query's k best; ties of the last place stay. turned: the block is the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, TILE):
                part = batch.slice(i, TILE)
                like = _matrix(part.column(1), held.shape[1]) @ held.T
                like = like.T if turned else like  # a row for each query
                last = np.partition(like, like.shape[1] - k, axis=1)[:, -k] if like.shape[1] > k else np.full(len(like), -2.0)
                q, v = np.nonzero(like >= last[:, None] - 1e-6)
                of, to = (ids, part.column(0)) if turned else (part.column(0), ids)
                yield pa.RecordBatch.from_arrays([of.take(pa.array(q)), to.take(pa.array(v)), pa.array(like[q, v])], names=["query_id", "id", "similarity"])

    return run


def knn_in_blocks(queries: DataFrame, index: DataFrame, k: int = TOP_K, hold_index: bool = False) -> DataFrame:
    """As knn, for an index of any size: the queries (or the index, where that is the small side) are held in blocks, and all rows of the other side pass each."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, id {kind(index, 'id')}, similarity double"
    held, name = (index, "id") if hold_index else (queries, "query_id")
    rows = index.select("id", "vector") if not hold_index else queries.select("query_id", "vector")
    blocks = max(1, -(-held.count() // BLOCK))
    parts = []
    for b in range(blocks):
        one = held.select(name, "vector").where(F.pmod(F.xxhash64(name), F.lit(blocks)) == b).toArrow().combine_chunks()
        if one.num_rows:
            vectors = one.column("vector").combine_chunks()
            shared = queries.sparkSession.sparkContext.broadcast((_matrix(vectors, max(len(v or []) for v in vectors.to_pylist())), pa.concat_arrays(one.column(name).chunks)))
            parts.append(rows.mapInArrow(_nearest(shared, k, not hold_index), schema))
    found = parts[0] if parts else queries.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        found = found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("similarity", rounded(F.col("similarity"), 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _containing(shared, k: int):
    """For each text that documents are searched for, the k least ids of a task's documents that contain it, in one pass over each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        leads = shared.value
        found: list[list] = [[] for _ in leads]
        machine = ahocorasick.Automaton()
        for i, lead in enumerate(leads):
            if lead:
                machine.add_word(lead, i)
        machine.make_automaton()
        every = [i for i, lead in enumerate(leads) if not lead]  # all documents contain an empty text
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is not None:
                    for i in {i for _, i in machine.iter(text)} | set(every) if len(machine) else every:
                        found[i].append(key)
                        if len(found[i]) > 64 * k:
                            found[i] = sorted(found[i], key=_nulls_first)[:k]
        rows = [(leads[i], x) for i, ids in enumerate(found) for x in sorted(ids, key=_nulls_first)[:k]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], kind)], names=["lead", "id"])

    return run


def _nulls_first(x):
    return x is not None, x


def lexical_in_blocks(queries: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """As lexical, for an index of any size: distinct first characters are held in blocks, and all documents pass each once.

    A task gives the k least ids for each at most, so a beginning that many documents share makes no more rows. A null text is contained in nothing.
    """
    spark = queries.sparkSession
    kind = index.schema["id"].dataType.simpleString()
    asked = queries.select("query_id", F.left("text", F.lit(LEAD)).alias("lead")).where("lead IS NOT NULL")
    leads = asked.select("lead").distinct()
    blocks = max(1, -(-leads.count() // LEADS))
    parts = []
    for b in range(blocks):
        held = [r[0] for r in leads.where(F.pmod(F.xxhash64("lead"), F.lit(blocks)) == b).collect()]
        parts.append(index.select("id", "document").mapInArrow(_containing(spark.sparkContext.broadcast(held), k), f"lead string, id {kind}"))
    found = reduce(DataFrame.unionByName, parts)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("lead").orderBy("id"))).where(F.col("rank") <= k)
    return asked.join(best, "lead").select("query_id", "id", "rank")


def lexical(queries: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, id, rank of documents that contain the first characters of the query."""
    hit = F.contains(F.col("document"), F.left("text", F.lit(LEAD)))
    pairs = queries.select("query_id", "text").join(_small(index.select("id", "document")), hit).select("query_id", "id")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("rank") <= k)


def fuse(legs: list[DataFrame], k: int = TOP_K, constant: int = RRF) -> DataFrame:
    """query_id, id, fused, rank by reciprocal ranks."""
    rows = legs[0].select("query_id", "id", "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("query_id", "id", "rank"))
    sums = rows.groupBy("query_id", "id").agg(rounded(F.sum(F.lit(1.0) / (constant + F.col("rank"))), 8).alias("fused"))
    w = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "id")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hits(ranked: DataFrame, index: DataFrame, queries: DataFrame, mode: str) -> DataFrame:
    """Ranked ids with label, hint, dimensions and score, 1 less the distance and not below 0."""
    rows = ranked.select("query_id", "id", "rank").join(queries.select("query_id", F.col("vector").alias("q")), "query_id").join(F.broadcast(index), "id")
    score = rounded(F.greatest(F.lit(0.0), cosine(F.col("q"), F.col("vector"))), 4)
    return rows.select("query_id", F.col("id").alias("case_id"), F.coalesce("metadata.label", "id").alias("label"), F.lit(mode).alias("query_mode"), score.alias("score"), "document", F.coalesce("metadata.diagnostic_dimensions", F.array().cast("array<string>")).alias("diagnostic_dimensions"), F.coalesce("metadata.rewrite_hint", F.lit("")).alias("rewrite_hint"), "rank")


def search(queries: DataFrame, index: DataFrame, mode: str = "hybrid", k: int = TOP_K, lang: str | None = None, genres: list[str] | None = None, held: bool = False) -> DataFrame:
    """Hits of each query; mode: vector or hybrid. queries: query_id, text. held: the index is held as a matrix, for many queries."""
    rows = where(index, lang, genres)
    asked = queries.withColumn("vector", embedding(F.col("text")))
    near = knn_in_blocks(asked, rows, k, hold_index=True) if held else knn(asked, rows, k)
    ranked = fuse([lexical(asked, rows, k), near], k) if mode == "hybrid" else near
    return hits(ranked, rows, asked, mode)


def best_of_paragraph(found: DataFrame, k: int = TOP_K) -> DataFrame:
    """The best hit of each case over the sentences of a paragraph, then the k best cases. found: doc_id, paragraph_index, sentence_index, rank, case_id, score, ..."""
    key = F.struct("score", (-F.col("sentence_index")).alias("s"), (-F.col("rank")).alias("r"))
    rest = [c for c in found.columns if c not in ("doc_id", "paragraph_index", "case_id")]
    one = found.groupBy("doc_id", "paragraph_index", "case_id").agg(F.max_by(F.struct(*rest), key).alias("h")).select("doc_id", "paragraph_index", "case_id", "h.*")
    w = Window.partitionBy("doc_id", "paragraph_index").orderBy(F.col("score").desc(), "sentence_index", "rank", "case_id")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def attach(segments: DataFrame, paragraphs: DataFrame, best: DataFrame) -> DataFrame:
    """Segments with retrieval_hits; paragraphs with hits only become segments whose risk is their best hit."""
    from .fusion import band

    row = F.struct("place", "case_id", "label", "query_mode", "score", "diagnostic_dimensions", "rewrite_hint")
    grouped = best.groupBy("doc_id", "paragraph_index").agg(F.array_sort(F.collect_list(row)).alias("retrieval_hits"))
    texts = grouped.join(paragraphs.select("doc_id", "paragraph_index", F.col("text").alias("whole")), ["doc_id", "paragraph_index"])
    both = segments.join(texts, ["doc_id", "paragraph_index"], "full_outer")
    top = F.get("retrieval_hits", F.lit(0))["score"]
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "paragraph_index", F.coalesce("text", "whole").alias("text"), F.coalesce("risk_score", top).alias("risk_score"), F.coalesce("risk_level", band(top)).alias("risk_level"),
        F.coalesce("reasons", none).alias("reasons"), F.coalesce("suggestions", none).alias("suggestions"), F.coalesce("detection_method", F.lit("seekdb")).alias("detection_method"),
        F.coalesce("signals", F.array().cast(segments.schema["signals"].dataType)).alias("signals"), "retrieval_hits",
    )
