from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from opsloom.llm.hilbert import hilbert_index, hilbert_shards, shard_ranges, text_cell, write_shards
from opsloom.llm.tables import row_key
from tests.llm.helpers import edges, empty


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_and_steps_to_neighbours(spark, dims, bits):
    cells = spark.range(1 << (dims * bits)).select(*[(F.shiftright("id", bits * k) % (1 << bits)).alias(f"x{k}") for k in range(dims)])
    rows = sorted((r["h"], r[:dims]) for r in cells.withColumn("h", hilbert_index([F.col(c) for c in cells.columns], bits)).collect())
    assert [h for h, _ in rows] == list(range(1 << (dims * bits)))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(rows, rows[1:], strict=False))


def test_coordinates_are_evaluated_once(spark):
    index = hilbert_index([F.xxhash64("id") % 8, F.xxhash64("id", "id") % 8], 3)
    plan = spark.range(9).select(index.alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 2


def test_whole_texts_are_ranked(spark):
    """Sources with a long common prefix, one of them with half of the rows, nulls and empty texts."""
    names = [None, "", *[f"https://example.org/crawl/2024/source_{i:02d}" for i in range(40)], "漢字", "zz"]
    rows = [(n,) for i, n in enumerate(names) for _ in range(1 + i % 3)] + [(names[20],)] * 80
    df = spark.createDataFrame(rows, "s string").repartition(5)
    got = {r["s"]: r["cell"] for r in df.withColumn("cell", text_cell(df, F.col("s"), 4)).distinct().collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()))
    assert got == {n: next(k for k, r in enumerate(ordered) if r[0] == n) * 16 // len(rows) if n is not None else 0 for n in names}


def shard(docs, shards=16):
    dims = {"lang": F.col("lang"), "source": F.col("source"), "n_chars": F.col("n_chars")}
    return hilbert_shards(docs, dims, shards, row_key("doc_id", "text"))


def check(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("shards", [1, 7, 16])
def test_counts_differ_by_one_at_most(spark, shards):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 9).alias("source"), (F.col("id") * 7 % 100).alias("n_chars"))
    check(shard(docs, shards).collect(), shards)


def test_a_hot_row_is_cut_like_any_other(spark):
    docs = spark.range(900).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    check(shard(docs).collect(), 16)


def test_shards_cover_short_ranges(spark, tmp_path):
    docs = spark.range(4096).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("https://example.org/s"), F.lpad((F.col("id") % 64).cast("string"), 2, "0")).alias("source"), F.shiftright("id", 6).alias("n_chars"))
    out = shard(docs)
    ranges = shard_ranges(out, {"n_chars": F.col("n_chars"), "source": F.col("source")}).collect()
    hit = sum(r["n_chars_min"] <= 5 <= r["n_chars_max"] for r in ranges)
    also = sum(r["source_min"] <= "https://example.org/s05" <= r["source_max"] for r in ranges)
    assert hit <= 6 and also <= 6  # of 16, for a filter on either dimension
    write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 4096 and back.select("shard").distinct().count() == 16


def test_edges(spark):
    docs = edges(spark).withColumn("slot", F.lit("mine")).withColumn("curve", F.lit(1))
    out = shard(docs)
    check(out.collect(), 16)
    assert sorted(out.columns) == sorted([*docs.columns, "shard"])
    assert shard(empty(spark)).count() == 0
