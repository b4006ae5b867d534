"""Refresh, insert-only append, checked snapshots, console copies."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from opsloom.plans import jobs
from opsloom.session import shared_folder
from opsloom.sources import feed, store
from opsloom.sources.commits import CommitLog, take_ids
from opsloom.sources.tables import Tables

NOW = dt.timedelta(0)


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_refresh_publishes_whole_versions(spark, tmp_path):
    path = str(tmp_path)
    store.materialize(spark.range(3).toDF("id"), path)
    store.write_version(spark.range(9).toDF("id"), path)  # written but never published, as after a failure
    assert store.read_materialized(spark, path).count() == 3
    store.materialize(store.read_materialized(spark, path).where("id > 0"), path)
    assert values(store.read_materialized(spark, path)) == [(1,), (2,)]


def test_insert_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, s int")
    assert values(store.insert_new(path, df, "id", ["s"])) == [(1, "b", 2), (2, "c", 1)]
    assert values(store.insert_new(path, df, "id", ["s"])) == [(1, "b", 2), (2, "c", 1)]
    more = spark.createDataFrame([(2, "changed", 9), (3, "d", 1)], "id int, v string, s int")
    assert values(store.insert_new(path, more, "id", ["s"])) == [(1, "b", 2), (2, "c", 1), (3, "d", 1)]


def test_snapshot_refuses_bad_keys(spark, tmp_path):
    path = str(tmp_path)
    store.sync_snapshot(spark.range(2).toDF("id"), ["id"], path)
    for bad in ([(1,), (1,)], [(None,)]):
        with pytest.raises(store.DuplicateKeyError):
            store.sync_snapshot(spark.createDataFrame(bad, "id long"), ["id"], path)
    assert store.read_materialized(spark, path).count() == 2


def test_sweep_keeps_two_versions(spark, tmp_path):
    path = str(tmp_path)
    for n in range(10):
        store.materialize(spark.range(n + 1).toDF("id"), path)
        store.sweep(spark, path, age=NOW)
    refused = spark.createDataFrame([(1,), (1,)], "id long")
    with pytest.raises(store.DuplicateKeyError):
        store.sync_snapshot(refused, ["id"], path)
    store.write_version(spark.range(5).toDF("id"), path)
    assert len(list(tmp_path.glob("data/*"))) == 4
    assert store.sweep(spark, path) == []  # both may belong to a writer at work
    assert len(store.sweep(spark, path, age=NOW)) == 2
    assert len(list(tmp_path.glob("data/*"))) == 2 and len(list(tmp_path.glob("log/*.json"))) == 2
    assert store.read_materialized(spark, path).count() == 10


def test_a_commit_number_is_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.append({"by": i}, 1), range(8)))
        numbers = list(pool.map(lambda i: log.add({"by": i}), range(60)))
    assert won.count(True) == 1 and log.read(1)["by"] == won.index(True)
    assert sorted(numbers) == list(range(2, 62)) and log.numbers() == list(range(1, 62))
    log.forget(range(1, 70))
    assert log.numbers() == [61]
    assert not log.append({}, 7)
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["000000000061.json"]


def test_id_blocks_never_overlap(spark, tmp_path):
    with ThreadPoolExecutor(4) as pool:
        firsts = list(pool.map(lambda n: (take_ids(spark, str(tmp_path), n), n), [3, 5, 1, 10, 2, 7] * 6))
    taken = [i for first, n in firsts for i in range(first, first + n)]
    assert sorted(taken) == list(range(1, 169))


def test_interleaved_writers_insert_each_key_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "one", 1), (2, "one", 1)], "id int, v string, s int")
    two = spark.createDataFrame([(2, "two", 1), (3, "two", 1)], "id int, v string, s int")
    commit, nested = feed.commit_batch, []

    def other_writer_first(spark, path, name, number):
        if not nested:  # the second writer begins and ends while the first is about to commit
            nested.append(True)
            store.insert_new(path, two, "id", ["s"])
        return commit(spark, path, name, number)

    monkeypatch.setattr(feed, "commit_batch", other_writer_first)
    assert values(store.insert_new(path, one, "id", ["s"])) == [(1, "one", 1), (2, "two", 1), (3, "two", 1)]
    assert feed.last_number(spark, path) == 2


def test_set_is_published_at_once(spark, tmp_path):
    def plans(fail):
        def third(t, as_of):
            if fail:
                raise RuntimeError("third table")
            return t["a"].join(t["b"], "id")

        return {
            "c": (third, ("a", "b")),
            "a": (lambda t, n: spark.range(n), ()),
            "b": (lambda t, n: t["a"].where("id > 0"), ("a",)),
        }

    folder, t = str(tmp_path), Tables(spark, {})
    assert store.read_set(spark, folder) == {}
    out = jobs.refresh_set(t, plans(False), folder, 4, NOW)
    assert out["c"].count() == 3
    with pytest.raises(RuntimeError):
        jobs.refresh_set(t, plans(True), folder, 9, NOW)
    assert {name: df.count() for name, df in store.read_set(spark, folder).items()} == {"a": 4, "b": 3, "c": 3}
    for n in range(5, 9):
        jobs.refresh_set(t, plans(False), folder, n, NOW)
    assert {name: df.count() for name, df in store.read_set(spark, folder).items()} == {"a": 8, "b": 7, "c": 7}
    assert all(len(list((tmp_path / name / "data").iterdir())) == 2 for name in "abc")


def test_snapshots_of_the_console_are_one_set(spark, tmp_path):
    def tables(ids, days):
        return {
            "support_case_context": spark.createDataFrame([(i,) for i in ids], "case_id int"),
            "user_support_profile": spark.createDataFrame([("u",)], "user_id string"),
            "support_overview": spark.createDataFrame([(d,) for d in days], "case_date string"),
        }

    jobs.sync_snapshots(tables([1, 2], ["a"]), str(tmp_path))
    with pytest.raises(store.DuplicateKeyError):  # the last of the three
        jobs.sync_snapshots(tables([1, 2, 3], ["a", "a"]), str(tmp_path))
    assert values(store.read_set(spark, str(tmp_path))["support_case_context"]) == [(1,), (2,)]


SCHEMA = "id int, v string"


def test_consumers_read_each_batch_once(spark, tmp_path):
    path, schema = str(tmp_path / "feed"), spark.createDataFrame([], SCHEMA).schema
    seen = {}

    def keep(rows, n):
        seen[n] = values(rows)  # replaces what the same read left

    def stop(rows, n):
        keep(rows, n)
        raise RuntimeError("stopped")

    def append(*rows):
        return feed.append_batch(spark.createDataFrame(list(rows), SCHEMA), path)

    assert feed.consume(spark, path, "c", schema, keep) == 0 and seen == {}
    append((1, "a"), (2, "b"))
    assert feed.consume(spark, path, "c", schema, keep) == 1 and seen == {1: [(1, "a"), (2, "b")]}
    append((3, "c"))
    with pytest.raises(RuntimeError):
        feed.consume(spark, path, "c", schema, stop)
    append((4, "d"))  # not part of the stopped read
    assert feed.consume(spark, path, "c", schema, keep) == 2 and seen[2] == [(3, "c")]
    assert feed.consume(spark, path, "c", schema, keep) == 3 and seen[3] == [(4, "d")]
    assert feed.consume(spark, path, "c", schema, keep) == 3 and len(seen) == 3
    assert feed.consume(spark, path, "late", schema, keep) == 3 and len(seen[1]) == 4


def test_feed_folds_what_all_consumers_have_read(spark, tmp_path):
    path, schema = str(tmp_path / "feed"), spark.createDataFrame([], SCHEMA).schema
    got = []
    for n in range(20):
        feed.append_batch(spark.createDataFrame([(n, "x")], SCHEMA), path)
        feed.consume(spark, path, "c", schema, lambda rows, _: got.extend(values(rows)))
        if n == 3:
            feed.consume(spark, path, "slow", schema, lambda rows, _: None)
        if n % 4 == 3:
            assert feed.fold_batches(spark, path, schema, NOW) == 4  # as far as the slow consumer
    everything = [(n, "x") for n in range(20)]
    assert values(feed.read_batches(spark, path, schema)) == everything == sorted(got)
    slow = []
    feed.consume(spark, path, "slow", schema, lambda rows, _: slow.extend(values(rows)))
    assert slow and sorted(slow)[0] == (4, "x")
    for n in range(20, 32):
        feed.append_batch(spark.createDataFrame([(n, "x")], SCHEMA), path)
        for c in ("c", "slow"):
            feed.consume(spark, path, c, schema, lambda rows, _: None)
        feed.fold_batches(spark, path, schema, NOW)
    assert len(list((tmp_path / "feed" / "data").iterdir())) <= 4 and len(list((tmp_path / "feed" / "log").glob("*.json"))) <= 5
    assert values(feed.read_batches(spark, path, schema)) == [(n, "x") for n in range(32)]


def test_shared_folder_is_the_checkpoint_folder(spark):
    assert shared_folder(spark).rstrip("/") == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_missing_table_is_empty_but_other_errors_are_not_hidden(spark, tmp_path):
    schema = spark.range(1).schema
    assert store.read_or_empty(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(Exception):
        store.read_or_empty(spark, str(tmp_path), schema, "no_such_format").where(F.col("id") > 0).count()


def test_tables_by_folder(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/numbers")
    t = Tables.from_parquet(spark, str(tmp_path), ["numbers"])
    assert "numbers" in t and "other" not in t
    assert t["numbers"].count() == 3
    assert t.with_tables(other=spark.range(1))["other"].count() == 1
