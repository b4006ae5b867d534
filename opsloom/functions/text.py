"""Text expressions: money, times, elapsed spans, search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom.functions.ids import normalise_id


def dollars(cents: Column) -> Column:
    return F.format_string("$%.2f", cents / F.lit(100.0))


def minute_stamp(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm")


def clock(col: Column) -> Column:
    return F.date_format(col, "HH:mm")


def _int_text(col: Column) -> Column:
    return col.cast("bigint").cast("string")


def time_ago(minutes: Column) -> Column:
    """'5m ago', '2h ago', '2h 5m ago', '3d ago', '3d 4h ago'."""
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    left_minutes, left_hours = minutes % 60, hours % 24
    return (
        F.when(minutes < 60, F.concat(_int_text(minutes), F.lit("m ago")))
        .when(
            hours < 24,
            F.concat(
                _int_text(hours),
                F.lit("h"),
                F.when(left_minutes > 0, F.concat(F.lit(" "), _int_text(left_minutes), F.lit("m"))).otherwise(""),
                F.lit(" ago"),
            ),
        )
        .otherwise(
            F.concat(
                _int_text(days),
                F.lit("d"),
                F.when(left_hours > 0, F.concat(F.lit(" "), _int_text(left_hours), F.lit("h"))).otherwise(""),
                F.lit(" ago"),
            )
        )
    )


def _hours_minutes(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.concat(_int_text(F.floor(minutes / 60)), F.lit("h "), _int_text(minutes % 60), F.lit("m"))


def elapsed(seconds: Column) -> Column:
    """'42s', '3m 5s', '2h 10m'."""
    return (
        F.when(seconds < 60, F.concat(_int_text(seconds), F.lit("s")))
        .when(
            seconds < 3600,
            F.concat(_int_text(F.floor(seconds / 60)), F.lit("m "), _int_text(seconds % 60), F.lit("s")),
        )
        .otherwise(_hours_minutes(seconds))
    )


def response_time(seconds: Column) -> Column:
    """'42 seconds', '1 minute', '5 minutes', '2h 10m'."""
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds < 60, F.concat(_int_text(seconds), F.lit(" seconds")))
        .when(minutes == 1, F.lit("1 minute"))
        .when(minutes < 60, F.concat(_int_text(minutes), F.lit(" minutes")))
        .otherwise(_hours_minutes(seconds))
    )


def lines(*parts: Column) -> Column:
    """Join lines; null parts are left out."""
    return F.concat_ws("\n", *parts)


def python_bool(col: Column) -> Column:
    return F.when(col, "True").otherwise("False")


def matches_search(query: str, id_columns: list[Column], text_columns: list[Column]) -> Column:
    """Case-insensitive substring search over several columns.

    A query that is an identifier in any accepted form also matches the equal id.
    An empty query matches everything.
    """
    wanted = F.lower(F.trim(F.lit(query)))
    exact = normalise_id(F.lit(query))
    found = F.lit(False)
    for col in id_columns:
        found = found | F.coalesce(F.lower(col) == exact, F.lit(False))
    for col in [*id_columns, *text_columns]:
        found = found | F.coalesce(F.contains(F.lower(col), wanted), F.lit(False))
    return (wanted == "") | found


def ends_with(col: Column, suffix: str) -> Column:
    return F.endswith(col, F.lit(suffix))


def same_code(col: Column, code: Column) -> Column:
    """Stored codes are upper case; the given code may have any case."""
    return col == F.upper(code)
