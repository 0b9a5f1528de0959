"""Documents from text files and tables, and sinks of reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each UTF-8 file is a document, known by its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_table(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def to_json_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the other columns as one JSON string."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("json"))


def to_json(row: dict) -> str:
    """One report, indented."""
    return json.dumps(row, ensure_ascii=False, indent=2)
