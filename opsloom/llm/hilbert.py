"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2^bits cells of about equal row counts, the cells' coordinates give an
index on a Hilbert curve, rows are sorted by it and cut into runs. Neighbours on the curve
are neighbours in every dimension, so that each shard (and each file of it) covers a small range of all of
them and a filter on any one skips files by their minimum and maximum.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.ordered import range_chunks
from opsloom.session import stored

#: The sort key's runs that are numbered one by one; their table of counts is the only thing that one task holds.
RUNS = 512


def _tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """For each Gray code its rank; for each rank the entry corner and the direction of its cell.

    C. H. Hamilton, Compact Hilbert Indices, 2006.
    """
    gray = [i ^ (i >> 1) for i in range(1 << dims)]
    rank = [gray.index(g) for g in range(1 << dims)]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(1 << dims)]

    def ones(i: int) -> int:
        return 0 if i % 2 == 0 else 1 + ones(i >> 1)

    turn = [0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % dims for w in range(1 << dims)]
    return rank, entry, turn


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Index of the cell on the curve through the 2^bits cells of each of 2 to 6 dimensions."""
    dims = len(coordinates)
    mask = (1 << dims) - 1
    rank, entry, turn = (F.array(*[F.lit(v) for v in table]) for table in _tables(dims))

    def shift(x: Column, by: Column, left: bool) -> Column:
        """x rotated by a column within dims bits."""
        out = x
        for k in range(1, dims):
            a, b = (k, dims - k) if left else (dims - k, k)
            out = F.when(by == k, (F.shiftleft(x, a).bitwiseOR(F.shiftright(x, b))).bitwiseAND(F.lit(mask))).otherwise(out)
        return out

    def label(cell: Column, bit: Column) -> Column:
        """One bit of each coordinate, the first dimension lowest."""
        power = F.call_function("shiftleft", F.lit(1), bit)
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            F.lit(0),
            lambda acc, k: acc.bitwiseOR(F.when(F.get(cell, k).bitwiseAND(power) != 0, F.call_function("shiftleft", F.lit(1), k)).otherwise(0)),
        )

    def step(acc: Column, bit: Column) -> Column:
        turned = (acc["turn"] + 1) % dims
        found = F.get(rank, shift(label(acc["cell"], bit).bitwiseXOR(acc["entry"]), turned, left=False))
        return F.struct(
            (acc["index"] * (1 << dims) + found).cast("bigint").alias("index"),
            found.cast("int").alias("rank"),
            acc["entry"].alias("entry"),
            acc["turn"].alias("turn"),
            acc["cell"].alias("cell"),
        )

    def settle(acc: Column) -> Column:
        """The frame of the sub-cell just entered."""
        turned = (acc["turn"] + 1) % dims
        return F.struct(
            acc["index"].alias("index"),
            acc["rank"].alias("rank"),
            acc["entry"].bitwiseXOR(shift(F.get(entry, acc["rank"]), turned, left=True)).cast("int").alias("entry"),
            ((acc["turn"] + F.get(turn, acc["rank"]) + 1) % dims).cast("int").alias("turn"),
            acc["cell"].alias("cell"),
        )

    # The coordinates travel in the fold's state: named in the lambdas, they would be evaluated for each bit and dimension.
    zero = F.struct(
        F.lit(0).cast("bigint").alias("index"),
        F.lit(0).alias("rank"),
        F.lit(0).alias("entry"),
        F.lit(0).alias("turn"),
        F.array(*[c.cast("int") for c in coordinates]).alias("cell"),
    )
    # Each bit takes two folds, so that no expression repeats another within itself.
    twice = F.flatten(F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), lambda b: F.array(b, F.lit(-1))))
    return F.aggregate(twice, zero, lambda acc, b: F.when(b >= 0, step(acc, b)).otherwise(settle(acc)), lambda acc: acc["index"])


def text_cell(df: DataFrame, value: Column, bits: int) -> Column:
    """The cell of a text among 2^bits by the share of rows with smaller texts, compared as a whole; null: cell 0.

    Distinct texts are counted and sorted as a table of their own; the driver gets the least text of each cell.
    """
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    chunked = range_chunks(counts, ["value"])
    sizes = chunked.groupBy("_chunk").agg(F.sum("n").alias("_size"))
    ahead = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    starts = sizes.select("_chunk", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"), F.sum("_size").over(Window.partitionBy()).alias("_all"))
    before = Window.partitionBy("_chunk").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunked.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(starts), "_chunk")
    placed = placed.where(F.col("value").isNotNull()).withColumn("cell", F.expr(f"(_start + _before) * {1 << bits} div _all"))
    least = sorted(tuple(r) for r in placed.groupBy("cell").agg(F.min("value")).collect())  # 2^bits rows at most
    cuts = F.array(*[F.lit(text) for _, text in least]).cast("array<string>")
    of_cut = F.array(F.lit(0), *[F.lit(cell) for cell, _ in least])
    return F.coalesce(F.get(of_cut, F.size(F.filter(cuts, lambda cut: cut <= value))), F.lit(0)).cast("int")


def cells(df: DataFrame, dims: Mapping[str, Column], bits: int, accuracy: int = 10000) -> list[Column]:
    """For each dimension the cell of a row: how many of 2^bits - 1 quantiles are at or below it.

    Quantiles of numbers come from one aggregate over all rows, cells of texts from `text_cell`; both are bounded by 2^bits a dimension. Nulls are in
    cell 0. An empty table has no quantiles and one cell.
    """
    points = [i / (1 << bits) for i in range(1, 1 << bits)]
    texts = {name for name, kind in df.select(*[c.alias(name) for name, c in dims.items()]).dtypes if kind == "string"}
    numbers = [name for name in dims if name not in texts]
    quantiles = [F.percentile_approx(dims[name].cast("double"), points, accuracy).alias(f"d{i}") for i, name in enumerate(numbers)]
    bounds_of = dict(zip(numbers, df.agg(*quantiles).first(), strict=True)) if numbers else {}

    def cell(bounds: list[float] | None, value: Column) -> Column:
        cuts = F.array(*[F.lit(b) for b in sorted(set(bounds or []))]).cast("array<double>")
        return F.size(F.filter(cuts, lambda b: b <= value))

    lowest = F.lit(float("-inf"))
    return [
        text_cell(df, c, bits) if name in texts else cell(bounds_of[name], F.coalesce(c.cast("double"), lowest))
        for name, c in dims.items()
    ]


def hilbert_shards(df: DataFrame, dims: Mapping[str, Column], shards: int, tie: Column, bits: int = 5) -> DataFrame:
    """df with `curve`, `shard` (0 to shards - 1) and `slot` (gapless from 0 in its shard).

    The shards are runs of equal length along the curve: their row counts differ by one at most. `tie` is a
    number that orders rows of one cell and spreads them evenly (a hash), so that a cell with a third of all rows
    is cut like any other; rows equal in cell and tie are numbered in any order. Own columns named curve, shard or slot are replaced. The rows are stored once with their curve index;
    then quantiles of (curve, tie) cut them into `RUNS` runs, the runs are counted, and
    rows are numbered within their run. One shuffle.
    """
    df = df.drop("curve", "shard", "slot")
    index = hilbert_index(cells(df, dims, bits), bits)
    spread = 62 - bits * len(dims)
    # (curve, tie, any) as one number: the curve's bits above the tie's, the lowest tell equal rows apart.
    # The row number is used in the stored table only, so it need not be the same in another scan.
    low = min(16, spread // 2)
    equal = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - low)
    tied = F.shiftleft(F.shiftrightunsigned(tie, 64 - (spread - low)), low)
    order = F.shiftleft(F.col("curve"), spread).bitwiseOR(tied).bitwiseOR(equal)
    keyed = stored(df.withColumn("curve", index).withColumn("_order", order), "hilbert")
    points = [i / RUNS for i in range(1, RUNS)]
    cuts = sorted(set(keyed.agg(F.percentile_approx("_order", points, 10000)).first()[0] or []))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    # The run of a key: how many bounds are at or below it.
    run = F.size(F.filter(bounds, lambda b: b <= F.col("_order")))
    numbered = keyed.withColumn("_run", run)
    sizes = numbered.groupBy("_run").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_run", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), F.sum("_rows").over(Window.partitionBy()).alias("_all"))
    within = F.row_number().over(Window.partitionBy("_run").orderBy("_order")) - 1
    place = numbered.withColumn("_within", within).join(F.broadcast(starts), "_run")  # RUNS rows
    at = F.col("_start") + F.col("_within")
    # Row p of n is in shard floor(p * shards / n); the shard begins at the first such p.
    shard = F.expr("(_start + _within) * {0} div _all".format(shards))
    begin = F.expr("(shard * _all + {0}) div {1}".format(shards - 1, shards))
    return place.withColumn("shard", shard.cast("int")).withColumn("slot", (at - begin).cast("bigint")).drop("_order", "_run", "_within", "_start", "_all")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order, so that files and row groups cover short curve runs."""
    sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_ranges(sharded: DataFrame, dims: Mapping[str, Column]) -> DataFrame:
    """Rows and each dimension's least and greatest value per shard, what a reader prunes by."""
    ranges = [f(c).alias(f"{name}_{which}") for name, c in dims.items() for which, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ranges)
