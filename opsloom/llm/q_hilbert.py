"""Query of the Hilbert sharding over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.hilbert import hilbert_shards
from opsloom.llm.tables import read, row_key

SHARDS = 16


def op3_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards by language, source and size; law `rows`: counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    documents = read(spark, folder, "documents").select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    dims = {"lang": F.col("lang"), "source": F.col("source"), "size": F.col("size")}
    sharded = hilbert_shards(documents, dims, SHARDS, row_key("doc_id", "text_crc32"))
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
