"""Before and after images from a change stream: what each micro-batch changed in the current state.

Each micro-batch is reduced to its winning change per key, kept in a log as in `current_state`. The winners of the batches before are looked up
for the batch's keys alone, and where the batch brings a newer change, the row before and the row after are written. Late changes and
repeated ones write nothing. All of it is joins and ranks of Spark; nothing runs key by key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from opsloom.operators.cdc import Flow
from opsloom.operators.rows import latest_per_key
from opsloom.streaming.current_state import FOLD_EVERY, compact, read_winners

#: JSON forms that lose nothing: microseconds, and null fields left out.
_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

IMAGES = ("_before", "_after")


def _image_type(schema: T.StructType, flow: Flow) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in flow.drop and f.name not in flow.keys])


def changes(winners: DataFrame, held: DataFrame, flow: Flow) -> DataFrame:
    """(keys, sequence, `_change_type`, `_before`, `_after`) of a batch's winners against the winners held before, both unique on the keys.

    `_change_type` is insert, update or delete as seen by a reader of the current state, whatever the source calls it: an update of a key that is not
    there is an insert. The images hold the other columns; `_before` is null for an insert, `_after` for a delete. One row a key at most: the net
    change. Only the held rows of the batch's keys go into the join with the images; a batch that is small beside them is broadcast.
    """
    image = _image_type(winners.schema, flow).names
    names = [f"_key{i}" for i in range(len(flow.keys))]

    def row() -> Column:
        return F.when(~flow.delete_when, F.struct(*image))

    now = winners.select(*flow.keys, F.struct(*flow.seq).alias("_now"), row().alias("_after"))
    own = [F.col(k).alias(name) for k, name in zip(flow.keys, names, strict=True)]
    same = F.lit(True)
    for k, name in zip(flow.keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(name))  # a null key is a key
    touched = held.join(winners.select(*own), same, "left_semi").select(*own, F.struct(*flow.seq).alias("_held"), row().alias("_before"))
    met = now.join(touched, same, "left").where(F.col("_held").isNull() | (F.col("_now") > F.col("_held")))
    # texts, since structs that hold maps can't be compared
    changed = met.where(~F.to_json("_before", _FORMATS).eqNullSafe(F.to_json("_after", _FORMATS)))
    kind = F.when(F.col("_before").isNull(), "insert").when(F.col("_after").isNull(), "delete").otherwise("update")
    return changed.select(*flow.keys, "_now.*", kind.alias("_change_type"), *IMAGES)


def feed_schema(schema: T.StructType, flow: Flow) -> T.StructType:
    """The feed's columns for a stream of this schema."""
    image = _image_type(schema, flow)
    fields = [*[schema[c] for c in (*flow.keys, *flow.seq)], T.StructField("_change_type", T.StringType())]
    return T.StructType([*fields, *[T.StructField(name, image) for name in IMAGES]])


def start_change_feed(
    stream: DataFrame,
    flow: Flow,
    path: str,
    every: str | None = None,
    fold_every: int = FOLD_EVERY,
    age: dt.timedelta = dt.timedelta(hours=1),
) -> StreamingQuery:
    """Write the changes of each micro-batch to its own folder of `path`; a batch done again replaces itself.

    The winners are kept below `state`, folded every `fold_every` batches. Those held before a batch are read from the batches below it, so
    a batch done again meets what it met the first time.
    """
    state = f"{path}/state"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        if batch_id and batch_id % fold_every == 0:
            compact(spark, state, flow, schema, batch_id - 1, age)
        own = f"{state}/changes/batch_id={batch_id}"
        flow.winners(batch).write.mode("overwrite").parquet(own)
        winners, held = spark.read.schema(schema).parquet(own), read_winners(spark, state, flow, schema, batch_id - 1)
        changes(winners, held, flow).write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{path}/_checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def apply_feed(old: DataFrame, feed: DataFrame, flow: Flow) -> DataFrame:
    """The table `old` after the feed's changes: per key the last image, and no row where that is null."""
    keys = list(flow.keys)
    last = latest_per_key(feed, keys, flow.seq)
    kept = old.join(last.select(*keys), keys, "left_anti")
    rest = [c for c in old.columns if c not in keys]
    now = last.where(F.col("_change_type") != "delete").select(*keys, *[F.col(f"_after.`{c}`").alias(c) for c in rest])
    return kept.unionByName(now.select(*old.columns))
