"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: everything between the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(*values: str | Column) -> Column:
    """A key of a row by its content: equal rows share it, so it is the same in every scan.

    Nulls get a mark of their own, because xxhash64 passes over nulls.
    """
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    return F.xxhash64(*[part for c in columns for part in (c.isNull(), c)])


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The key of a document: rows equal in id and text are one document."""
    return row_key(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))


#: ASCII letters in lower case; what is neither letter, digit nor part of a longer UTF-8 character parts words.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: str) -> list[bytes]:
    """The words of a text without marks, in UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()
