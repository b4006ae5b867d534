"""Query of the language identification over `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.language_families import fit, identify
from opsloom.llm.tables import read


def held_out() -> Column:
    """Rows that nothing is learned from; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def op11_language_families(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language, predicted from its text alone."""
    documents = read(spark, folder, "documents")
    model = fit(documents.where(~held_out()).select("text", "lang"))
    return identify(documents.select("doc_id", held_out().alias("held_out"), "text"), model)
