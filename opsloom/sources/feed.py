"""A table of appended batches with a manifest, and consumers that each keep their own offset.

Batches are folders of parquet files; a commit names a folder, so a batch is seen whole or not at all, in the order of the
commits. A consumer reads the batches after its offset. It notes the range before it starts and its end afterwards: a
stopped read is done again over the same range and under the same number, and a handler that replaces what it wrote under that
number sees each row once. `fold_batches` gathers what all consumers have read into one base.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from opsloom.sources.commits import CommitLog, entries_below, remove

Handler = Callable[[DataFrame, int], None]


def batch_path(path: str, name: str) -> str:
    return f"{path}/data/{name}"


def _log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, f"{path}/log")


def last_number(spark: SparkSession, path: str) -> int:
    """The number of the last commit; 0 before the first."""
    return (_log(spark, path).numbers() or [0])[-1]


def write_batch(df: DataFrame, path: str) -> str:
    """Write a batch that readers do not see yet."""
    name = uuid.uuid4().hex
    df.write.parquet(batch_path(path, name))
    return name


def commit_batch(spark: SparkSession, path: str, name: str, number: int) -> bool:
    """Make a written batch visible under this number; False if another writer has taken it."""
    return _log(spark, path).append({"batch": name}, number)


def append_batch(df: DataFrame, path: str) -> int:
    """Append df as one batch and return its number."""
    return _log(df.sparkSession, path).add({"batch": write_batch(df, path)})


def _bases(commits: dict[int, dict]) -> list[tuple[int, dict]]:
    return [(n, c) for n, c in sorted(commits.items()) if "base" in c]


def read_batches(spark: SparkSession, path: str, schema: T.StructType, after: int = 0, through: int | None = None) -> DataFrame:
    """The rows of the batches numbered above `after` and up to `through` (the last one by default).

    From 0 on, folded batches are read from their base; ranges that begin later must not be folded yet.
    """
    log = _log(spark, path)
    numbers = [n for n in log.numbers() if through is None or n <= through]
    commits = {n: log.read(n) for n in numbers if n > after or after == 0}
    bases = _bases(commits) if after == 0 else []
    start, folders = after, []
    if bases:
        start = bases[-1][1]["through"]
        folders.append(bases[-1][1]["base"])
    folders += [c["batch"] for n, c in sorted(commits.items()) if n > start and "batch" in c]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[batch_path(path, name) for name in folders])


def _offsets(spark: SparkSession, path: str, consumer: str) -> tuple[CommitLog, CommitLog]:
    return CommitLog(spark, f"{path}/consumers/{consumer}/begun"), CommitLog(spark, f"{path}/consumers/{consumer}/done")


def offset_of(spark: SparkSession, path: str, consumer: str) -> int:
    """The number up to which a consumer has read."""
    return _offsets(spark, path, consumer)[1].last()[1].get("through", 0)


def consume(spark: SparkSession, path: str, consumer: str, schema: T.StructType, handle: Handler) -> int:
    """Hand the rows that came after the consumer's offset to `handle(rows, n)`; returns the new offset.

    n counts the consumer's reads from 1. After a stopped read the same rows come under the same n again, whatever was
    appended meanwhile; without new batches nothing is called. One process reads for a consumer at a time.
    """
    begun, done = _offsets(spark, path, consumer)
    read, before = done.last()
    n, plan = begun.last()
    if n <= read:
        plan = {"after": before.get("through", 0), "through": last_number(spark, path)}
        if plan["through"] == plan["after"]:
            return plan["after"]
        n = read + 1
        if not begun.append(plan, n):
            plan = begun.read(n)
    handle(read_batches(spark, path, schema, plan["after"], plan["through"]), n)
    done.append({"through": plan["through"]}, n)
    for log in (begun, done):
        log.forget(m for m in log.numbers() if m < n - 1)
    return plan["through"]


def fold_batches(spark: SparkSession, path: str, schema: T.StructType, age: dt.timedelta = dt.timedelta(days=1)) -> int:
    """Gather the batches that every consumer has read into one base; returns the number it reaches.

    The base and batches that the fold before left in use stay, for readers that have begun; what neither fold uses and is older than `age` goes, with its
    commits. So a feed holds two bases and the batches since the last fold but one.
    """
    log = _log(spark, path)
    consumers = entries_below(spark, f"{path}/consumers")
    last = last_number(spark, path)
    through = min([last, *[offset_of(spark, path, c) for c in consumers]])
    commits = {n: log.read(n) for n in log.numbers()}
    bases = _bases(commits)
    if through > (bases[-1][1]["through"] if bases else 0):
        base = write_batch(read_batches(spark, path, schema, 0, through), path)
        commits[log.add({"base": base, "through": through})] = {"base": base, "through": through}
        bases = _bases(commits)
    kept_bases = bases[-2:]
    start = kept_bases[0][1]["through"] if len(kept_bases) > 1 else 0
    named = {c["base"] for _, c in kept_bases} | {c["batch"] for n, c in commits.items() if "batch" in c and n > start}
    # a batch under way, or committed since, is young or still unnamed; the log is read again for the latter
    named |= {c["batch"] for c in (log.read(n) for n in log.numbers() if n not in commits) if "batch" in c}
    before = dt.datetime.now(dt.timezone.utc) - age
    for name, changed in entries_below(spark, f"{path}/data").items():
        if name not in named and changed <= before:
            remove(spark, batch_path(path, name))
    log.forget(n for n, c in commits.items() if ("batch" in c and n <= start) or ("base" in c and (n, c) not in kept_bases))
    return through
