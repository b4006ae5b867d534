"""Keyed row selection, joins onto a spine, splits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest `order` per key.

    Written as rank 1: Spark keeps one row per key and task before the shuffle, so a hot key
    sends one row per task. `order` should end in a column that is unique within the key.
    """
    return top_n_per_key(df, keys, [F.desc(c) for c in order], 1)


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows per key.

    The rank filter lets Spark keep only n rows per key and task before the shuffle.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def agg_per_key(df: DataFrame, key: str, as_key: str | None = None, where: Column | None = None, **aggs: Column) -> DataFrame:
    """Aggregates per non-null key, with the key renamed for the join that follows."""
    rows = df.where(F.col(key).isNotNull()) if where is None else df.where(F.col(key).isNotNull() & where)
    return rows.groupBy(F.col(key).alias(as_key or key)).agg(*[c.alias(name) for name, c in aggs.items()])


def join_unique(big: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows whose key may be hot to a side with unique, non-null keys (any join of the left side).

    Adaptive execution can split a hot key only where both inputs come straight from a shuffle.
    A side that was just aggregated or joined by the same key would keep its partitioning and
    prevent that; the null-safe comparison makes both sides take a shuffle of their own. Null keys,
    which match nothing, are left out of inner and semi joins, so they are not gathered in one task.
    """
    if how in ("inner", "left_semi"):
        big = big.where(F.col(key).isNotNull())
    right = side.withColumnRenamed(key, "_side_key")
    return big.join(right, F.col(key).eqNullSafe(F.col("_side_key")), how).drop("_side_key")


def left_join_all(spine: DataFrame, parts: Iterable[tuple[DataFrame, str]], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left join parts with unique keys onto a spine; `defaults` fill what did not match."""
    out = spine
    for part, key in parts:
        out = out.join(part, key, "left")
    if defaults:
        out = out.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})
    return out


def measures_per_key(key: str, parts: Iterable[DataFrame], aggs: Mapping[str, Column]) -> DataFrame:
    """One aggregate over several sources that share a key: one shuffle instead of one per source.

    Each part holds the key and some measure columns; `aggs` reads the union of all of them.
    """
    rows = None
    for part in parts:
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy(key).agg(*[c.alias(name) for name, c in aggs.items()])


def unprocessed(df: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Rows whose key is not in `done`."""
    return df.join(done.select(F.col(done_key or key).alias(key)), key, "left_anti")


def split_valid(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the names of the failed checks.

    A check that evaluates to null counts as failed.
    """
    failed = F.concat_ws(",", *[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks.items()])
    marked = df.withColumn("reject_reason", failed)
    valid = marked.where(F.col("reject_reason") == "").drop("reject_reason")
    return valid, marked.where(F.col("reject_reason") != "")


def active_version(df: DataFrame, version: str, where: Column) -> DataFrame:
    """The row with the highest version among those that satisfy `where`; empty if none does."""
    best = df.where(where).agg(F.max_by(F.struct(*df.columns), F.col(version)).alias("_row"))
    return best.where(F.col("_row").isNotNull()).select("_row.*")


def flag_latest(df: DataFrame, key: str, order: Sequence[str], out: str) -> DataFrame:
    """Mark the latest row per key without gathering the key's rows in one task."""
    newest = df.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*order)).alias("_newest"))
    return (
        df.join(newest, F.col(key).eqNullSafe(F.col("_key")))
        .withColumn(out, F.struct(*order) == F.col("_newest"))
        .drop("_key", "_newest")
    )


def first_reply_after_last(df: DataFrame, key: str, ts: str, is_question: Column, is_reply: Column) -> DataFrame:
    """Per key with a question: the last question's time and the first later reply's time, if any."""
    marked = df.where(F.col(key).isNotNull())
    marked = marked.select(key, F.col(ts).alias("_ts"), is_question.alias("_q"), is_reply.alias("_r"))
    last = marked.where("_q").groupBy(key).agg(F.max("_ts").alias("last_question_at"))
    replies = (
        join_unique(marked.where("_r"), last, key)
        .where(F.col("_ts") > F.col("last_question_at"))
        .groupBy(key)
        .agg(F.min("_ts").alias("first_reply_at"))
    )
    return last.join(replies, key, "left")
