"""Current-state tables kept up to date from a stream of changes.

Each micro-batch is written as it comes, without a shuffle, to its own folder of an
append-only change log (`batch_id=N`), so the work per batch is proportional to the batch and
a replayed batch replaces itself. Deletes stay in the log: a late change with a lower
sequence can not bring a key back. Readers take the winner per key, of which a task sends one row a key, so
a batch need not be reduced before; every `fold_every` batches the finished ones are folded into one base, and what no reader names any more is removed, so the log stays bounded.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from opsloom.operators.cdc import Flow
from opsloom.sources.commits import CommitLog, entries_below, remove
from opsloom.sources.store import read_or_empty, write_version

#: Micro-batches between two folds of the log.
FOLD_EVERY = 100


def start_current_state(
    stream: DataFrame,
    flow: Flow,
    path: str,
    every: str | None = None,
    name: str | None = None,
    fold_every: int = FOLD_EVERY,
    age: dt.timedelta = dt.timedelta(hours=1),
) -> StreamingQuery:
    """Run the flow on a change stream: once over what is available, or `every` interval.

    The stream's checkpoint is kept with the table, since batch numbers tie the two together. Batches before the one
    at hand are finished, so each `fold_every`-th batch folds them first; done again, it folds nothing more.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % fold_every == 0:
            compact(batch.sparkSession, path, flow, batch.schema, batch_id - 1, age)
        flow.accepted(batch).write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{path}/_checkpoint")
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _log_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def _base(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame | None, int]:
    """The last base and the last batch in it; (None, -1) before the first fold."""
    _, commit = CommitLog(spark, f"{path}/base/log").last()
    if not commit:
        return None, -1
    return spark.read.schema(schema).parquet(f"{path}/base/data/{commit['version']}"), commit["through"]


def _since(spark: SparkSession, path: str, schema: T.StructType, after: int, through: int | None = None) -> DataFrame:
    rows = read_or_empty(spark, f"{path}/changes", _log_schema(schema)).where(F.col("batch_id") > after)
    return (rows if through is None else rows.where(F.col("batch_id") <= through)).drop("batch_id")


def read_winners(spark: SparkSession, path: str, flow: Flow, schema: T.StructType, through: int | None = None) -> DataFrame:
    """The winning change per key, deletes included: the compacted base and the batches after it, up to `through` if given."""
    base, after = _base(spark, path, schema)
    changes = _since(spark, path, schema, after, through)
    return flow.winners(changes if base is None else base.unionByName(changes))


def read_current_state(spark: SparkSession, path: str, flow: Flow, schema: T.StructType) -> DataFrame:
    """Current rows of a table fed by start_current_state."""
    return flow.live(read_winners(spark, path, flow, schema))


def compact(spark: SparkSession, path: str, flow: Flow, schema: T.StructType, through: int, age: dt.timedelta = dt.timedelta(hours=1)) -> None:
    """Fold all micro-batches up to `through`, which must be finished, into one base; deletes are kept.

    Readers switch to the new base when it is committed. The base before and the batches that it lacks stay for readers that
    have begun; older bases, bases that were never committed and batches folded earlier go once they are older than `age`.
    """
    log = CommitLog(spark, f"{path}/base/log")
    base, after = _base(spark, path, schema)
    if through > after:
        done = _since(spark, path, schema, after, through)
        version = write_version(flow.winners(done if base is None else base.unionByName(done)), f"{path}/base")
        log.add({"version": version, "through": through})
    numbers = log.numbers()
    kept = [log.read(n) for n in numbers[-2:]]
    named, unread = {c["version"] for c in kept}, kept[0]["through"] if len(kept) > 1 else -1
    before = dt.datetime.now(dt.timezone.utc) - age
    for version, changed in entries_below(spark, f"{path}/base/data").items():
        if version not in named and changed <= before:
            remove(spark, f"{path}/base/data/{version}")
    for folder, changed in entries_below(spark, f"{path}/changes").items():
        if int(folder.removeprefix("batch_id=")) <= unread and changed <= before:
            remove(spark, f"{path}/changes/{folder}")
    log.forget(numbers[:-2])


def keyed_state(stream: DataFrame, flow: Flow) -> DataFrame:
    """The same winners as a streaming aggregate, with the latest change per key held as state.

    Use update mode: each trigger emits the keys that changed. There is no watermark, late rows
    are ordered by sequence alone, and the state keeps one row for every key ever seen.
    """
    rest = [c for c in stream.columns if c not in flow.keys]
    best = F.max_by(F.struct(*rest), F.struct(*flow.seq)).alias("_row")
    winners = flow.accepted(stream).groupBy(*flow.keys).agg(best)
    return winners.select(*flow.keys, "_row.*").select(*stream.columns)


def run_flows(
    streams: dict[str, DataFrame], flows: dict[str, Flow], folder: str, every: str | None = None
) -> list[StreamingQuery]:
    """Start one query per table; with no interval, wait until all have caught up."""
    queries = [
        start_current_state(stream, flows[name], f"{folder}/{name}", every, name)
        for name, stream in streams.items()
    ]
    if every is None:
        wait_for(queries)
    return queries


def wait_for(queries: Iterable[StreamingQuery]) -> None:
    for query in queries:
        query.awaitTermination()
