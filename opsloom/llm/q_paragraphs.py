"""Query of the repeated passages over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm.paragraph_minhash import repeated_passages
from opsloom.llm.tables import read


def op5_paragraph_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of 30 words or more that repeats one of an earlier document."""
    return repeated_passages(read(spark, folder, "documents").select("doc_id", "text")).drop("doc_key")
