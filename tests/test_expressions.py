"""Scalar expressions."""

import uuid

from pyspark.sql import functions as F

from opsloom.functions import ids, text, times, values


def column(spark, data, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_spans(spark):
    minutes = [0, 59, 60, 61, 1439, 1440, 1441, 1500, 3000]
    assert column(spark, minutes, "bigint", text.time_ago) == [
        "0m ago", "59m ago", "1h ago", "1h 1m ago", "23h 59m ago", "1d ago", "1d ago", "1d 1h ago", "2d 2h ago",
    ]
    assert column(spark, [0, 59, 60, 61, 3599, 3600, 7325], "bigint", text.elapsed) == ["0s", "59s", "1m 0s", "1m 1s", "59m 59s", "1h 0m", "2h 2m"]
    assert column(spark, [1, 60, 119, 120, 3600], "bigint", text.response_time) == ["1 seconds", "1 minute", "1 minute", "2 minutes", "1h 0m"]


def test_money(spark):
    assert column(spark, [0, 5, 100, 123456789, -250, None], "bigint", text.dollars)[:5] == ["$0.00", "$0.05", "$1.00", "$1234567.89", "$-2.50"]


def test_ids(spark):
    u = uuid.UUID("0f8fad5b-d9cb-469f-a165-70867728950e")
    junk = ["", "x", u.hex[:-1], "A" * 24, None, str(u) + "0"]
    import base64

    packed = base64.b64encode(u.bytes).decode()
    good = [str(u).upper(), u.hex, packed, packed.rstrip("="), f"\t{u}\n", " " + u.hex]
    assert column(spark, good, "string", ids.normalise_id) == [str(u)] * len(good)
    assert column(spark, junk, "string", ids.normalise_id) == [None] * len(junk)
    assert column(spark, [u.bytes], "binary", ids.uuid_text) == [str(u)]
    assert column(spark, [u.bytes], "binary", ids.id_hex) == [u.hex]
    assert [bytes(b) for b in column(spark, [str(u), u.hex], "string", ids.uuid_bytes)] == [u.bytes] * 2
    assert column(spark, [str(u)], "string", ids.short_id) == ["0f8fad5b"]


def test_minutes(spark):
    pairs = [("2024-01-01 00:00:00", "2024-01-01 00:01:59"), ("2024-01-01 00:00:00", "2024-01-01 00:02:30"), ("2024-01-01 00:01:30", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz"))
    got = df.select(times.whole_minutes(F.col("a"), F.col("b")).alias("w"), times.rounded_minutes(F.col("a"), F.col("b")).alias("r")).collect()
    assert [(r.w, r.r) for r in got] == [(1, 2), (2, 3), (-1, -2)]


def test_lookup_and_clamp(spark):
    table = values.literal_map({"1": 0.5})
    assert column(spark, [1, 2], "int", lambda c: values.lookup(table, c)) == [0.5, 1.0]
    assert column(spark, [-1, 5, 99], "int", lambda c: values.clamp(c, F.lit(0), F.lit(10))) == [0, 5, 10]


def test_null_rules(spark):
    assert column(spark, ["x", "y", None], "string", lambda c: values.null_or_equal(c, F.lit("x"))) == [True, False, True]
    assert column(spark, [None, 5, 4], "int", lambda c: values.under_cap(F.lit(5), c)) == [True, True, False]
    assert column(spark, [None, 5, 6], "int", lambda c: values.under_cap(F.lit(5), c, strict=True)) == [True, False, True]
    assert column(spark, ["a", "b", None], "string", lambda c: values.in_domain(c, ["a"])) == [True, False, False]
