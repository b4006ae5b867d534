"""Writing results: full refresh, insert-only append, checked snapshots.

Parquet has no MERGE, so every write here is either a new folder or an append. A refresh writes a new version
folder and then commits its name, alone or together with those of other tables; readers take the last commit, so a failed write is
never seen. `sweep` removes what no recent commit names.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.operators.rows import latest_per_key, unprocessed
from opsloom.session import stored
from opsloom.sources import feed
from opsloom.sources.commits import CommitLog, entries_below, remove

#: Commits whose versions are kept, for readers that have begun; younger folders may belong to a write under way.
KEEP = 2
AGE = dt.timedelta(days=1)


class DuplicateKeyError(ValueError):
    """A snapshot's declared primary key is null or repeated."""


def write_version(df: DataFrame, path: str, version: str | None = None, partition_by: Sequence[str] = ()) -> str:
    """Write df as a version folder that readers do not see yet."""
    version = version or f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/data/{version}")
    return version


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make a written version the one readers see."""
    CommitLog(spark, f"{path}/log").add({"version": version})


def published_version(spark: SparkSession, path: str) -> str | None:
    return CommitLog(spark, f"{path}/log").last()[1].get("version")


def materialize(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace the table at `path` by df and return the stored table."""
    version = write_version(df, path, partition_by=partition_by)
    publish(df.sparkSession, path, version)
    return df.sparkSession.read.parquet(f"{path}/data/{version}")


def read_materialized(spark: SparkSession, path: str) -> DataFrame:
    """The last published version."""
    return spark.read.parquet(f"{path}/data/{published_version(spark, path)}")


def _sweep(spark: SparkSession, folder: str, tables: Iterable[str], named: Callable[[dict], set[str]], keep: int, age: dt.timedelta) -> list[str]:
    """Remove the tables' version folders that the last `keep` commits do not name and that are older than `age`."""
    log = CommitLog(spark, f"{folder}/log")
    numbers = log.numbers()
    kept = {name for n in numbers[-keep:] for name in named(log.read(n))}
    before = dt.datetime.now(dt.timezone.utc) - age
    gone = []
    for table in tables:
        for version, changed in entries_below(spark, f"{folder}/{table}data").items():
            if f"{table}{version}" not in kept and changed <= before:
                remove(spark, f"{folder}/{table}data/{version}")
                gone.append(f"{table}{version}")
    log.forget(numbers[:-keep])
    return gone


def sweep(spark: SparkSession, path: str, keep: int = KEEP, age: dt.timedelta = AGE) -> list[str]:
    """Remove replaced, refused and never published versions of a table; returns their names."""
    return _sweep(spark, path, [""], lambda commit: {commit["version"]}, keep, age)


def publish_set(spark: SparkSession, folder: str, versions: Mapping[str, str]) -> None:
    """Make the written versions of several tables (folders below `folder`) visible at once."""
    CommitLog(spark, f"{folder}/log").add({"versions": dict(versions)})


def read_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last published set; none before the first."""
    versions = CommitLog(spark, f"{folder}/log").last()[1].get("versions", {})
    return {name: spark.read.parquet(f"{folder}/{name}/data/{version}") for name, version in versions.items()}


def sweep_set(spark: SparkSession, folder: str, tables: Iterable[str], keep: int = KEEP, age: dt.timedelta = AGE) -> list[str]:
    """Remove versions of the tables that the last `keep` sets do not name."""
    return _sweep(
        spark, folder, [f"{t}/" for t in tables], lambda commit: {f"{t}/{v}" for t, v in commit["versions"].items()}, keep, age
    )


def key_violations(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Primary key values that are null or occur more than once, with their counts."""
    has_null = F.lit(False)
    for c in pk:
        has_null = has_null | F.col(c).isNull()
    return df.groupBy(*pk).agg(F.count(F.lit(1)).alias("row_count")).where((F.col("row_count") > 1) | has_null)


def check_key(df: DataFrame, pk: Sequence[str], name: str) -> None:
    if not key_violations(df, pk).isEmpty():
        raise DuplicateKeyError(f"primary key {list(pk)} is null or repeated in {name}")


def sync_snapshot(df: DataFrame, pk: Sequence[str], path: str) -> DataFrame:
    """Replace the copy at `path` by df, but only if the primary key holds.

    The check reads the written version, so df is computed once.
    """
    spark = df.sparkSession
    version = write_version(df, path)
    written = spark.read.parquet(f"{path}/data/{version}")
    check_key(written, pk, path)
    publish(spark, path, version)
    return written


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
    """The table at `path`, or an empty one before the first write."""
    try:
        return spark.read.schema(schema).format(format).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def insert_new(path: str, df: DataFrame, key: str, order: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Append the rows whose key is not stored yet as one batch of a feed; running it twice changes nothing.

    Several writers may insert at a time: the batch is committed under the number that follows the batches it was compared with. If another
    writer has taken that number, the batch is compared with the batches in between only, and tried again.
    """
    spark = df.sparkSession
    schema = schema or df.schema
    batch = latest_per_key(stored(df.select(*schema.fieldNames()), "batch"), [key], order)
    seen = 0
    while True:
        last = feed.last_number(spark, path)
        there = feed.read_batches(spark, path, schema, seen, last).select(key).join(batch.select(key), key, "left_semi")
        name = feed.write_batch(unprocessed(batch, there, key), path)
        # what was written is what the next try compares, so nothing is computed twice
        batch, seen = spark.read.schema(schema).parquet(feed.batch_path(path, name)), last
        if batch.isEmpty() or feed.commit_batch(spark, path, name, last + 1):
            return feed.read_batches(spark, path, schema)
