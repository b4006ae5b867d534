"""Order-dependent operators that stay distributed when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.session import stored


def range_chunks(df: DataFrame, order: Sequence[str], parts: int | None = None, out: str = "_chunk") -> DataFrame:
    """Number contiguous, evenly sized ranges of the given order and store the result.

    Without `parts` adaptive execution chooses ranges of its advisory size. The range bounds are
    sampled once; storing the rows fixes the numbering for every later use.
    """
    columns = [F.col(c) for c in order]
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return stored(ranged.withColumn(out, F.spark_partition_id()), "ranges")


#: Sampled rows for each piece that the rows are cut into.
SAMPLED = 20


def sampled_cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None) -> DataFrame:
    """(_k_<key>..., _cuts): for each key with a cut inside, where its later pieces begin.

    The rows, sorted by (keys, order), are cut into `parts` pieces at sampled rows, so only keys that reach over a
    cut are here: `parts` rows at most. A key with a large share of the rows has many cuts, most keys have none.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, *order]
    spread = F.xxhash64(*columns, F.monotonically_increasing_id())
    sampled = df.select(*columns, spread.alias("_spread")).orderBy("_spread").limit(SAMPLED * parts)
    # SAMPLED * parts rows, in one task
    numbered = sampled.withColumn("_n", F.row_number().over(Window.orderBy(*columns)))
    at = F.array_sort(F.collect_set(F.struct(*[F.col(c) for c in order])))
    cuts = numbered.where(F.col("_n") % SAMPLED == 0).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(at.alias("_cuts"))
    return stored(cuts, "cuts")


def with_piece(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: DataFrame, how: str) -> DataFrame:
    """df with `_piece`: how many of its key's cuts a row has reached."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    reached = F.size(F.filter("_cuts", lambda cut: cut <= F.struct(*[F.col(c) for c in order])))
    joined = df.join(F.broadcast(cuts), same, how)  # `parts` rows
    return joined.withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(reached)).select(*df.columns, "_piece")


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    step: int,
    parts: int | None = None,
) -> DataFrame:
    """Add columns of the next (step=1) or previous (step=-1) row of the same key.

    `values` maps new column names to source columns; the first and last rows get nulls.
    Rows with equal `order` are neighbours of each other. A key with a large share of the rows is cut into pieces at
    bounds that are sampled once (`parts` in all, the number of shuffle partitions by default), so the rows are shuffled once, by
    (keys, piece); neighbours are found inside each piece, and the first or last rows of the cut keys' pieces close the gaps.
    """
    keys, order = list(keys), list(order)
    pick = F.struct(*[F.col(src).alias(name) for name, src in values.items()])
    move = F.lead if step == 1 else F.lag
    columns = [*df.columns, *[F.col(f"_near.{name}").alias(name) for name in values]]
    cuts = sampled_cuts(df, keys, order, parts)
    edge_of = F.min_by if step == 1 else F.max_by
    narrow = df.select(*dict.fromkeys([*keys, *order, *values.values()]))
    edges = with_piece(narrow, keys, order, cuts, "inner").groupBy(*keys, "_piece").agg(edge_of(pick, F.struct(*order)).alias("_edge"))
    edges = edges.withColumn("_across", move("_edge", 1).over(Window.partitionBy(*keys).orderBy("_piece")))
    edges = edges.where(F.col("_across").isNotNull())
    # no more pieces of cut keys than twice the cuts
    edges = F.broadcast(edges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_piece").alias("_k_piece"), "_across"))
    cond = F.col("_piece") == F.col("_k_piece")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    numbered = with_piece(df, keys, order, cuts, "left")
    inside = numbered.withColumn("_near", move(pick, 1).over(Window.partitionBy(*keys, "_piece").orderBy(*order)))
    return inside.join(edges, cond, "left").withColumn("_near", F.coalesce("_near", "_across")).select(*columns)


def dense_index(
    df: DataFrame, order: Sequence[str], out: str, start: Column | int = 1, parts: int | None = None
) -> DataFrame:
    """Number all rows start, start+1, ... in the given (unique) order without a single-task sort."""
    chunked = range_chunks(df, order, parts)
    sizes = chunked.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    # one row per range partition
    offsets = F.broadcast(sizes.select("_chunk", F.coalesce(before, F.lit(0)).alias("_before")))
    within = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    first = F.lit(start) if isinstance(start, int) else start
    return (
        chunked.withColumn("_pos", within)
        .join(offsets, "_chunk")
        .withColumn(out, (F.col("_before") + F.col("_pos") - 1 + first).cast("bigint"))
        .drop("_chunk", "_pos", "_before")
    )
