"""Identifier expressions: uuid text, 32 hex digits, base64 of 16 bytes, raw bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns of the accepted identifier forms.
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HEX32_PATTERN = r"^[0-9a-f]{32}$"
BASE64_16_PATTERN = r"^[A-Za-z0-9+/]{22}(==)?$"


def id_hex(col: Column) -> Column:
    """Lower-case hex of a binary key."""
    return F.lower(F.hex(col))


def hex_to_uuid(col: Column) -> Column:
    """Dashed lower-case uuid from 32 hex digits."""
    h = F.lower(col)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
    )


def uuid_text(col: Column) -> Column:
    """Dashed uuid text of a 16-byte binary key."""
    return hex_to_uuid(F.hex(col))


def uuid_bytes(col: Column) -> Column:
    """The 16 bytes of a uuid text, dashes optional."""
    return F.unhex(F.replace(col, F.lit("-"), F.lit("")))


def normalise_id(col: Column) -> Column:
    """Lower-case uuid of any accepted identifier form, null for anything else."""
    trimmed = strip(col)
    lowered = F.lower(trimmed)
    packed = F.regexp_replace(trimmed, r"\s", "")
    decoded = F.try_to_binary(F.rpad(packed, 24, "="), F.lit("base64"))
    return (
        F.when(lowered.rlike(UUID_PATTERN), lowered)
        .when(lowered.rlike(HEX32_PATTERN), hex_to_uuid(lowered))
        .when(packed.rlike(BASE64_16_PATTERN), uuid_text(decoded))
    )


def key_bytes(col: Column) -> Column:
    """One binary form for keys that arrive as uuid, hex or base64 text, for plain equi joins."""
    return uuid_bytes(normalise_id(col))


def short_id(col: Column) -> Column:
    return F.substring(col, 1, 8)


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def id_text(df: DataFrame, name: str) -> Column:
    """A key column as text for display and search: uuid form for binary keys."""
    col = F.col(name)
    return uuid_text(col) if isinstance(df.schema[name].dataType, T.BinaryType) else col.cast("string")
