"""Query of the secret scan over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.secret_ledger import BASE, scan
from opsloom.llm.spans import count_of, joined
from opsloom.llm.tables import read
from opsloom.session import scratch_path


def op9_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as versions of paths, against a new ledger."""
    documents = read(spark, folder, "documents").select("doc_id", "text")
    found = scan(documents, scratch_path(spark, "ledger"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select(
        "doc_id",
        *[count_of(base, r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "blob",
    )
