"""Query of the packing operator over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.tables import read
from opsloom.llm.token_packing import pack

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' pieces, with the checksum of each piece's ids."""
    pieces = pack(read(spark, folder, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
