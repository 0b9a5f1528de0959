"""The analysis over a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.analyze import analyze
from ..sources.texts import to_json_rows


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def analyze_stream(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Each micro-batch is analysed as a whole; the sink gets its reports (doc_id, json) and the batch's number.

    Documents don't depend on each other, so there is no state; a batch that runs again gives the same rows under the same number.
    """
    return docs.writeStream.foreachBatch(lambda batch, n: sink(to_json_rows(analyze(batch, **options)), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder for each batch, written over if the batch comes again."""
    return lambda reports, n: reports.write.mode("overwrite").parquet(f"{path}/batch={n}")
