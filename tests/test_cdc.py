"""Change histories: order independence, deletes, late rows, streams, intervals, change sets."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsloom.operators import cdc
from opsloom.schemas import struct
from opsloom.sources.history import read_history_stream
from opsloom.streaming import change_feed
from opsloom.streaming import current_state as cs

SCHEMA = struct("id:int v:text _change_type:text _lsn:long _xid:long _timestamp:ntz")
FLOW = cdc.Flow("t")
T0 = dt.datetime(2024, 1, 1)


def change(key, value, kind, lsn, xid=0):
    return (key, value, kind, lsn, xid, T0 + dt.timedelta(minutes=lsn))


def expected(history, at=None):
    latest = {}
    for row in history:
        if at is not None and row[3] > at:
            continue
        if row[0] not in latest or row[3] > latest[row[0]][3]:
            latest[row[0]] = row
    return sorted((k, r[1]) for k, r in latest.items() if r[2] != "delete")


def state(df):
    return sorted((r.id, r.v) for r in df.collect())


def random_history(seed, n=40, keys=6):
    rng = random.Random(seed)
    rows = [change(rng.randrange(keys), f"v{i}", rng.choice(["insert", "update", "update", "delete"]), i) for i in range(n)]
    rows += rng.sample(rows, 5)  # exact duplicates
    rng.shuffle(rows)
    return rows


CASES = [
    change(1, "a", "insert", 1),
    change(2, "a", "insert", 2),
    change(2, "b", "update", 5),
    change(3, "late", "insert", 3),
    change(3, "first", "update", 6),
    change(4, "x", "insert", 4),
    change(4, "x", "insert", 4),
    change(5, "x", "insert", 7),
    change(5, "x", "delete", 9),
    change(5, "old", "update", 8),
    change(6, "x", "insert", 10),
    change(6, "x", "delete", 11),
    change(6, "again", "insert", 12),
    change(7, "x", "delete", 13),
]


def test_minimum_cases(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    assert state(FLOW.current(df)) == [(1, "a"), (2, "b"), (3, "first"), (4, "x"), (6, "again")]
    assert FLOW.current(df).columns == ["id", "v"]


def test_deletes_are_applied_after_the_latest_row_is_chosen(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    wrong = cdc.apply_scd1(df.where("_change_type <> 'delete'"), ["id"], ["_lsn"])
    assert state(wrong) != state(FLOW.current(df))


def test_equal_sequence_is_ordered_by_transaction(spark):
    df = spark.createDataFrame([change(1, "a", "insert", 5, 1), change(1, "b", "update", 5, 2)], SCHEMA)
    assert state(cdc.apply_scd1(df, ["id"], ["_lsn", "_xid"])) == [(1, "b")]


def test_ignored_change_types(spark):
    flow = cdc.Flow("t", ignore_types=("noise",))
    df = spark.createDataFrame([change(1, "a", "insert", 1), change(1, "b", "noise", 2)], SCHEMA)
    assert state(flow.current(df)) == [(1, "a")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_any_order_gives_the_same_state(spark, seed):
    history = random_history(seed)
    df = spark.createDataFrame(history, SCHEMA).repartition(3)
    assert state(FLOW.current(df)) == expected(history)
    deleted = F.col("_change_type") == "delete"
    assert state(cdc.state_as_of(df, ["id"], ["_lsn"], 20, deleted)) == expected(history, 20)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), parts=st.integers(1, 5))
def test_stream_equals_batch(spark, tmp_path_factory, seed, parts):
    folder = tmp_path_factory.mktemp("stream")
    history = random_history(seed)
    for i in range(parts):
        spark.createDataFrame(history[i::parts], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/bronze")
    stream = read_history_stream(spark, f"{folder}/bronze", SCHEMA, files_per_batch=1)
    cs.start_current_state(stream, FLOW, f"{folder}/t").awaitTermination()
    assert state(cs.read_current_state(spark, f"{folder}/t", FLOW, SCHEMA)) == expected(history)


def test_late_row_after_delete_stays_deleted_across_batches_and_compaction(spark, tmp_path):
    bronze, path = str(tmp_path / "bronze"), str(tmp_path / "t")

    def push(*changes):
        spark.createDataFrame(list(changes), SCHEMA).coalesce(1).write.mode("append").parquet(bronze)
        stream = read_history_stream(spark, bronze, SCHEMA)
        cs.start_current_state(stream, FLOW, path).awaitTermination()
        return state(cs.read_current_state(spark, path, FLOW, SCHEMA))

    assert push(change(1, "a", "insert", 1), change(2, "b", "insert", 2)) == [(1, "a"), (2, "b")]
    assert push(change(1, "a", "delete", 9)) == [(2, "b")]
    cs.compact(spark, path, FLOW, SCHEMA, through=1)
    assert state(cs.read_current_state(spark, path, FLOW, SCHEMA)) == [(2, "b")]
    assert push(change(1, "late", "update", 5), change(2, "c", "update", 6)) == [(2, "c")]
    cs.compact(spark, path, FLOW, SCHEMA, through=2)
    assert push(change(1, "again", "insert", 10)) == [(1, "again"), (2, "c")]


def test_log_stays_bounded_and_replays_are_safe(spark, tmp_path):
    history = random_history(8, n=80)
    bronze, path = f"{tmp_path}/bronze", f"{tmp_path}/t"
    for i in range(20):
        spark.createDataFrame(history[i::20], SCHEMA).coalesce(1).write.mode("append").parquet(bronze)
    stream = read_history_stream(spark, bronze, SCHEMA, files_per_batch=1)
    cs.start_current_state(stream, FLOW, path, fold_every=4, age=dt.timedelta(0)).awaitTermination()
    assert state(cs.read_current_state(spark, path, FLOW, SCHEMA)) == expected(history)
    batches = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "t/changes").glob("batch_id=*"))
    assert batches == list(range(12, 20))  # those after the base before the last, which reaches 11
    assert len(list((tmp_path / "t/base/data").iterdir())) == 2 and len(list((tmp_path / "t/base/log").glob("*.json"))) == 2
    for _ in range(2):  # the last batch once more, as after a failure before its commit
        cs.compact(spark, path, FLOW, SCHEMA, 15, dt.timedelta(0))
        FLOW.winners(spark.read.schema(SCHEMA).parquet(f"{path}/changes/batch_id=19")).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/again")
    assert state(cs.read_current_state(spark, path, FLOW, SCHEMA)) == expected(history)
    cs.compact(spark, path, FLOW, SCHEMA, 19)
    assert state(cs.read_current_state(spark, path, FLOW, SCHEMA)) == expected(history)


def test_replayed_batch_replaces_itself(spark, tmp_path):
    batch = spark.createDataFrame(CASES, SCHEMA)
    for _ in range(2):
        FLOW.winners(batch).write.mode("overwrite").parquet(f"{tmp_path}/changes/batch_id=0")
    assert cs.read_winners(spark, str(tmp_path), FLOW, SCHEMA).count() == 7


def test_keyed_streaming_aggregate_emits_the_same_winners(spark, tmp_path):
    history = random_history(3)
    for i in range(3):
        spark.createDataFrame(history[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bronze")
    stream = read_history_stream(spark, f"{tmp_path}/bronze", SCHEMA, files_per_batch=1)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/changes/batch_id={batch_id}")

    query = (
        cs.keyed_state(stream, FLOW)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{tmp_path}/ckpt")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert state(cs.read_current_state(spark, f"{tmp_path}/out", FLOW, SCHEMA)) == expected(history)


def intervals(history):
    out = []
    for key in {r[0] for r in history}:
        versions = sorted({r for r in history if r[0] == key}, key=lambda r: r[3])
        for this, after in zip(versions, [*versions[1:], None]):
            if this[2] != "delete":
                out.append((key, this[1], this[5], after[5] if after else None, after is None))
    return sorted(out, key=repr)


def test_intervals_with_and_without_hot_keys(spark):
    history = random_history(11, n=200, keys=4)
    df = spark.createDataFrame(history, SCHEMA).repartition(5)
    deleted = F.col("_change_type") == "delete"
    for parts in (None, 1, 9):
        got = cdc.scd2_intervals(df, ["id"], ["_lsn"], "_timestamp", deleted, parts=parts)
        found = sorted(((r.id, r.v, r.valid_from, r.valid_to, r.is_current) for r in got.collect()), key=repr)
        assert found == intervals(history)


def test_change_feed_has_the_images_of_each_batch(spark, tmp_path):
    """Against the state after each batch, batch by batch."""
    schema = struct("id:long v:text amount:long key:id at:ts _change_type:text _lsn:long _xid:long _timestamp:ts")
    rng, big = random.Random(4), 2**60 + 1
    at = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    rows = [
        (rng.randint(1, 5), rng.choice(["a", "b", None]), rng.choice([big, None]), bytes([7, i % 3]), at, rng.choice(["insert", "update", "update", "delete"]), lsn, None if i % 9 == 0 else i, at)
        for i, lsn in enumerate(rng.sample(range(2**60, 2**60 + 500), 40))
    ]
    rows.append(rows[3])
    flow = cdc.Flow("t")
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bronze")
    stream = read_history_stream(spark, f"{tmp_path}/bronze", schema, files_per_batch=1)
    change_feed.start_change_feed(stream, flow, f"{tmp_path}/feed").awaitTermination()
    feed = spark.read.parquet(f"{tmp_path}/feed/changes")
    assert [f for f in feed.schema.fields if f.name != "batch_id"] == change_feed.feed_schema(schema, flow).fields
    files = sorted((tmp_path / "bronze").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    before, seen = {}, []
    for batch, file in enumerate(files):
        seen += [tuple(r) for r in spark.read.schema(schema).parquet(str(file)).collect()]
        after = {r["id"]: tuple(r) for r in flow.current(spark.createDataFrame(seen, schema)).collect()}
        want = {k: (before.get(k), after.get(k)) for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
        got = {}
        for r in feed.where(F.col("batch_id") == batch).collect():
            images = tuple((r["id"], *r[name]) if r[name] else None for name in change_feed.IMAGES)
            got[r["id"]] = images
            assert r["_change_type"] == ("insert" if images[0] is None else "delete" if images[1] is None else "update")
        assert got == want
        before = after
    empty = spark.createDataFrame([], flow.current(spark.createDataFrame(seen, schema)).schema)
    applied = change_feed.apply_feed(empty, feed.drop("batch_id"), flow)
    assert {r["id"]: tuple(r) for r in applied.collect()} == before


def test_change_feed_folds_its_state_and_runs_nothing_key_by_key(spark, tmp_path):
    history = random_history(7, n=120, keys=9) + [(None, "n", "update", 5000 + i, i, dt.datetime(2024, 1, 1)) for i in range(3)]
    flow, folder = cdc.Flow("t"), str(tmp_path / "feed")
    for i in range(6):
        spark.createDataFrame(history[i::6], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bronze")
    stream = read_history_stream(spark, f"{tmp_path}/bronze", SCHEMA, files_per_batch=1)
    query = change_feed.start_change_feed(stream, flow, folder, fold_every=2, age=dt.timedelta(0))
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)  # no Python call for each key
    assert len(list((tmp_path / "feed/state/changes").glob("batch_id=*"))) < 6
    feed = spark.read.parquet(f"{folder}/changes")
    empty = flow.current(spark.createDataFrame([], SCHEMA))
    got = change_feed.apply_feed(empty, feed.drop("batch_id"), flow)
    want = flow.current(spark.createDataFrame(history, SCHEMA))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_batch_goes_to_the_log_once_and_without_a_shuffle(spark, tmp_path):
    history = random_history(5, n=200, keys=7)
    spark.createDataFrame(history, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/bronze")
    cs.start_current_state(read_history_stream(spark, f"{tmp_path}/bronze", SCHEMA), FLOW, f"{tmp_path}/t").awaitTermination()
    # the reader reduces it; a reduction here would shuffle every row once more
    assert spark.read.parquet(f"{tmp_path}/t/changes").count() == len(history)
    assert all(f.name.endswith(".zstd.parquet") for f in (tmp_path / "t/changes").glob("*/*.parquet"))
    assert cs.read_winners(spark, f"{tmp_path}/t", FLOW, SCHEMA).count() == 7
    assert state(cs.read_current_state(spark, f"{tmp_path}/t", FLOW, SCHEMA)) == expected(history)


def test_equal_positions_are_decided_by_the_transaction(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "a", "insert", 5, 1, at), (1, "b", "update", 5, 2, at), (2, "x", "update", 7, 9, at), (2, "y", "insert", 7, 3, at)]
    for order in (rows, rows[::-1]):
        history = spark.createDataFrame(order, SCHEMA).coalesce(1)
        assert state(cdc.Flow("t").current(history)) == [(1, "b"), (2, "x")]
        folder = f"{tmp_path}/{order[0][1]}"
        history.write.parquet(f"{folder}/bronze")
        cs.start_current_state(read_history_stream(spark, f"{folder}/bronze", SCHEMA), cdc.Flow("t"), f"{folder}/t").awaitTermination()
        assert state(cs.read_current_state(spark, f"{folder}/t", cdc.Flow("t"), SCHEMA)) == [(1, "b"), (2, "x")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    old=st.dictionaries(st.integers(0, 9), st.sampled_from(["a", "b", None])),
    new=st.dictionaries(st.integers(0, 9), st.sampled_from(["a", "b", None])),
)
def test_change_set_turns_old_into_new(spark, old, new):
    def table(d):
        return spark.createDataFrame(sorted(d.items()), "id int, v string")

    changes = cdc.diff_changes(table(old), table(new), ["id"])
    kinds = {r.id: r._change_type for r in changes.collect()}
    assert kinds == {
        k: "insert" if k not in old else "delete" if k not in new else "update"
        for k in old.keys() | new.keys()
        if (k in old) != (k in new) or old[k] != new[k]
    }
    assert dict(state(cdc.apply_changes(table(old), changes, ["id"]))) == new


def test_flows_for_several_tables(spark, tmp_path):
    flows = cdc.build_flows(["a", "b"])
    streams = {}
    for name in flows:
        spark.createDataFrame(CASES, SCHEMA).write.parquet(f"{tmp_path}/bronze/{name}")
        streams[name] = read_history_stream(spark, f"{tmp_path}/bronze/{name}", SCHEMA)
    cs.run_flows(streams, flows, str(tmp_path / "silver"))
    for name in flows:
        assert len(state(cs.read_current_state(spark, f"{tmp_path}/silver/{name}", flows[name], SCHEMA))) == 5


def test_continuous_flow_picks_up_new_changes(spark, tmp_path):
    flows = cdc.build_flows(["t"])

    def push(*changes):
        spark.createDataFrame(list(changes), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bronze")

    def current():
        return state(cs.read_current_state(spark, f"{tmp_path}/silver/t", FLOW, SCHEMA))

    push(change(1, "a", "insert", 1))
    stream = read_history_stream(spark, f"{tmp_path}/bronze", SCHEMA)
    (query,) = cs.run_flows({"t": stream}, flows, f"{tmp_path}/silver", every="1 second")
    try:
        query.processAllAvailable()
        assert current() == [(1, "a")]
        push(change(1, "b", "update", 3), change(2, "x", "insert", 2))
        query.processAllAvailable()
        assert current() == [(1, "b"), (2, "x")]
    finally:
        query.stop()
