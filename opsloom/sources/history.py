"""Change histories as batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from opsloom.schemas import history_schema


def read_history(spark: SparkSession, path: str, table: T.StructType) -> DataFrame:
    """All change rows of a table written so far."""
    return spark.read.schema(history_schema(table)).parquet(path)


def read_history_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    files_per_batch: int | None = None,
    file_pattern: str | None = None,
) -> DataFrame:
    """Change rows as they arrive. The schema is fixed, nothing is inferred."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if file_pattern:
        reader = reader.option("pathGlobFilter", file_pattern)
    return reader.parquet(path)
