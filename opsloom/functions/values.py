"""Null handling, domains, bounds, money arithmetic and lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def sum_or_zero(col: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.sum(col if where is None else F.when(where, col)), F.lit(0)).cast("bigint")


def count_where(where: Column) -> Column:
    return F.count_if(where)


def first_time(col: Column, where: Column) -> Column:
    """Earliest value among the rows that satisfy `where`."""
    return F.min(F.when(where, col))


def amount(price: Column, quantity: Column) -> Column:
    """Price times quantity without integer overflow."""
    return price.cast("bigint") * quantity.cast("bigint")


def null_or_equal(col: Column, value: Column) -> Column:
    """A null column is a wildcard."""
    return col.isNull() | (col == F.coalesce(value, F.lit("")))


def under_cap(current: Column, cap: Column, strict: bool = False) -> Column:
    """A null cap is no cap. The plain form still admits current = cap."""
    return cap.isNull() | ((current < cap) if strict else (current <= cap))


def in_domain(col: Column, domain: Iterable[str]) -> Column:
    return F.coalesce(col.isin(*domain), F.lit(False))


def clamp(col: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, col))


def role(admin_id: Column) -> Column:
    return F.when(admin_id.isNotNull(), "admin").otherwise("customer")


def literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(mapping: Column, key: Column, default: object = 1.0) -> Column:
    """Map entry by text key, `default` where the key is absent."""
    return F.coalesce(F.try_element_at(mapping, key.cast("string")), F.lit(default))
