from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsloom.llm import grid_codes
from opsloom.llm.grid_codes import CellCache, compressed

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Every part against every entry, with Python's whole numbers; rows are usable."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // parts
    vector_of = {}
    for i, v, _ in kept:
        vector_of[i] = min(v, vector_of.get(i, v))
    ids = sorted(vector_of, key=lambda i: (i is None, i or 0))[:entries]
    books = [[vector_of[i][p * width : (p + 1) * width] for i in ids] for p in range(parts)]

    def nearest(p, v):
        part = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[nearest(p, v)[1]].append(v[p * width : (p + 1) * width])
            new.append([[sum(x) // len(o) for x in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, label in kept:
        found = [nearest(p, v) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return sorted(((i, code, e, sums[label], digest) for i, code, e, label in out), key=repr)


def result(df, **settings):
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r[c] for c in columns) for r in compressed(df, **settings).collect()), key=repr)


def vectors(seed, n, dims=16, spread=0.1):
    rng = random.Random(seed)
    near = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(5)]
    return [(7 * i % 1000, [x + rng.gauss(0, spread / 8) for x in rng.choice(near)], None if i % 7 == 0 else 0 if i % 3 else i % 4) for i in range(n)]


@pytest.mark.parametrize("bits", [None, 0, 4, 30])
def test_same_as_every_entry(spark, bits):
    rows = vectors(3, 150)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(4), bits=bits) == brute(rows)


def test_small_caches_change_nothing(spark, monkeypatch):
    rows = vectors(4, 120)
    monkeypatch.setattr(grid_codes, "CELLS", 3)
    assert result(spark.createDataFrame(rows, SCHEMA), bits=5) == brute(rows)


def test_ties_repeats_and_few_rows(spark):
    same = [0.5, -0.25] * 8
    rows = [(1, same, 1), (1, same, 1), (2, same, None), (2, [-x for x in same], None), (None, same, 2), (3, [0.0] * 16, 2)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert result(spark.createDataFrame(rows[:1], SCHEMA)) == brute(rows[:1])


def test_unusable_rows_go(spark):
    good = vectors(5, 30, dims=8)
    bad = [
        (-1, None, 1),
        (-2, [], 1),
        (-3, [None] + [0.1] * 7, 1),
        (-4, [float("nan")] * 8, 1),
        (-5, [float("inf")] + [0.0] * 7, 1),
        (-6, [0.1] * 9, 1),
        (2000, [0.1] * 16, 1),
        (2001, [1e30] * 8, 1),
    ]
    df = spark.createDataFrame(good + bad, SCHEMA).selectExpr("*", "1 AS code", "2 AS numbers")  # clashing names
    assert result(df) == brute(good)
    assert compressed(spark.createDataFrame(bad, SCHEMA)).where("vec_id < 0").collect() == []
    for none in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(bad[:3], SCHEMA)):
        assert compressed(none).collect() == []
        assert compressed(none).columns == compressed(df).columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-40, 40)] * 2), min_size=1, max_size=30), st.lists(st.tuples(*[st.integers(-40, 40)] * 2), min_size=1, max_size=6), st.integers(0, 7))
def test_cells_keep_the_nearest(parts, book, bits):
    cache = CellCache(np.array(book, dtype=np.int64), bits)
    for _ in range(2):  # filled, then looked up
        entry, distance = cache.nearest(np.array(parts, dtype=np.int64))
        want = [min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate(book)) for p in parts]
        assert list(zip(distance.tolist(), entry.tolist(), strict=True)) == want


def test_fewer_entries_are_evaluated():
    rng = np.random.default_rng(1)
    book = rng.integers(-500, 500, (16, 2))
    cache = CellCache(book, 6)
    parts = rng.integers(-500, 500, (5000, 2))
    cache.nearest(parts)
    assert cache.evaluated < 5000 * 16 / 3
