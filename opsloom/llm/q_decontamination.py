"""Query of the decontamination over `documents` and `benchmark`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.decontamination import with_items
from opsloom.llm.tables import read


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Each document and benchmark item that it contains at 0.8 or more of the item's 5-word shingles."""
    found = with_items(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))
    hits = found.select("doc_id", F.explode("found").alias("hit")).select("doc_id", "hit.*")
    return hits.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
