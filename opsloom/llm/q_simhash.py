"""Query of the SimHash operator over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.simhash_embedding import simhash_groups
from opsloom.llm.tables import read


def op6_simhash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and component: 3-word shingles, 2 bits."""
    groups = simhash_groups(read(spark, folder, "documents"), shingle=3, max_bits=2)
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
