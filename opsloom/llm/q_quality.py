"""Query of the quality rules over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm.quality_divergence import judge, references
from opsloom.llm.tables import read


def op1_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's base counts, distances and verdict."""
    documents = read(spark, folder, "documents").select("doc_id", "lang", "text")
    return judge(documents, references(documents)).drop("lang", "text")
