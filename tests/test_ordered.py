"""Order-dependent operators with keys forced over the split limit, against plain Python."""

import random

from pyspark.sql import functions as F

from opsloom.operators.ordered import dense_index, range_chunks, with_neighbour
from opsloom.operators import rows
from opsloom.operators.rows import first_reply_after_last, flag_latest, latest_per_key, split_valid, top_n_per_key


def skewed(n=300):
    rng = random.Random(5)
    # key 0 holds about two thirds of the rows, one key is null
    keys = [0 if rng.random() < 0.66 else rng.choice([1, 2, 3, None]) for _ in range(n)]
    return [(k, i, rng.choice(["a", "b", None])) for i, k in enumerate(keys)]


def test_neighbours_of_hot_keys(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k int, s int, v string").repartition(6)
    by_key = {}
    for k, s, v in sorted(data, key=lambda r: r[1]):
        by_key.setdefault(k, []).append((s, v))
    for step in (1, -1):
        want = set()
        for k, items in by_key.items():
            for i, (s, v) in enumerate(items):
                j = i + step
                near = items[j] if 0 <= j < len(items) else (None, None)
                want.add((k, s, v, near[0], near[1]))
        for parts in (None, 1, 7, 40):
            got = with_neighbour(df, ["k"], ["s"], {"ns": "s", "nv": "v"}, step, parts)
            assert got.columns == ["k", "s", "v", "ns", "nv"]
            assert {tuple(r) for r in got.collect()} == want
            assert got.count() == len(data)


def test_dense_index(spark):
    rng = random.Random(1)
    values = rng.sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    for parts in (None, 1, 6):
        got = {(r.v, r.n) for r in dense_index(df, ["v"], "n", 11, parts).collect()}
        assert got == {(v, i) for i, v in enumerate(sorted(values), 11)}


def test_range_chunks_are_contiguous(spark):
    df = spark.createDataFrame(skewed(), "k int, s int, v string")
    chunks = {}
    for r in range_chunks(df, ["s"], 5).collect():
        chunks.setdefault(r._chunk, []).append(r.s)
    spans = [(min(v), max(v)) for _, v in sorted(chunks.items())]
    assert len(spans) == 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_latest_and_top_n(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 9, "z"), (None, 4, "n")], "k int, s int, v string")
    assert {tuple(r) for r in latest_per_key(df, ["k"], ["s"]).collect()} == {(1, 3, "c"), (2, 9, "z"), (None, 4, "n")}
    top = top_n_per_key(df, ["k"], [F.desc("s")], 2, rank="r")
    assert {(x.k, x.v, x.r) for x in top.collect()} == {(1, "c", 1), (1, "b", 2), (2, "z", 1), (None, "n", 1)}


def test_flag_latest_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1)], "k int, s int")
    assert {tuple(r) for r in flag_latest(df, "k", ["s"], "last").collect()} == {(1, 1, False), (1, 2, True), (None, 1, True)}


def test_split_valid_names_the_failed_checks(spark):
    df = spark.createDataFrame([(1, "a"), (-1, "a"), (None, ""), (2, None)], "n int, s string")
    valid, rejected = split_valid(df, {"n": F.col("n") > 0, "s": F.length("s") > 0})
    assert [tuple(r) for r in valid.collect()] == [(1, "a")]
    assert {tuple(r) for r in rejected.collect()} == {(-1, "a", "n"), (None, "", "n,s"), (2, None, "s")}


def test_first_reply_after_last(spark):
    data = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 3, False), ("a", 5, False), ("a", 4, False), ("b", 1, True), ("c", 1, False)]
    df = spark.createDataFrame(data, "k string, t int, q boolean")
    got = first_reply_after_last(df, "k", "t", F.col("q"), ~F.col("q"))
    assert {tuple(r) for r in got.collect()} == {("a", 3, 4), ("b", 1, None)}


def test_join_unique(spark):
    big = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    side = spark.createDataFrame([(1, "x"), (3, "y")], "k int, w string")
    assert {tuple(r) for r in rows.join_unique(big, side, "k").collect()} == {(1, "a", "x"), (1, "b", "x")}
    left = rows.join_unique(big, side, "k", "left")
    assert {tuple(r) for r in left.collect()} == {(1, "a", "x"), (1, "b", "x"), (2, "c", None), (None, "d", None)}
    assert {r.v for r in rows.join_unique(big, side, "k", "left_anti").collect()} == {"c", "d"}
