"""Query of the personal data finder over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.pii_boosting import KINDS, find
from opsloom.llm.spans import count_of, joined
from opsloom.llm.tables import read


def op2_pii_boosting(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's base spans by kind, their digest, and all spans."""
    found = find(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[count_of(F.col("base_spans"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
