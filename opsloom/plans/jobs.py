"""The scheduled jobs: gold refresh after the change streams, the agent batch, the console's copies."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from opsloom.plans import agent, gold
from opsloom.sources import feed, store
from opsloom.sources.commits import remove
from opsloom.sources.tables import Tables

RESPONSE_ORDER = ("generated_at", "message_id")

#: A table's plan, from the tables built before it and the day, and the tables of the set it reads.
Plan = tuple[Callable[[Tables, "dt.date | str"], DataFrame], Sequence[str]]

GOLD: dict[str, Plan] = {
    "daily_revenue": (lambda t, as_of: gold.daily_revenue(t), ()),
    "support_overview": (lambda t, as_of: gold.support_overview(t), ()),
    "user_support_profile": (gold.user_support_profile, ()),
    "support_case_context": (
        lambda t, as_of: gold.support_case_context(t, as_of, profile=t["user_support_profile"]),
        ("user_support_profile",),
    ),
}

#: Primary keys of the tables that the console copies as snapshots.
SNAPSHOT_KEYS = {"support_case_context": ("case_id",), "user_support_profile": ("user_id",), "support_overview": ("case_date",)}


def refresh_set(t: Tables, plans: Mapping[str, Plan], folder: str, as_of: dt.date | str, age: dt.timedelta = store.AGE) -> Tables:
    """Recompute the tables of a set in the order of their dependencies and publish them at once; adds them to the tables.

    Each table is computed once and read from its stored version by those that need it. Readers see the
    set before until all tables are written, so a failure in any of them leaves that set. Versions no longer named are swept.
    """
    versions: dict[str, str] = {}
    for name in TopologicalSorter({name: needs for name, (_, needs) in plans.items()}).static_order():
        plan, _ = plans[name]
        path = f"{folder}/{name}"
        versions[name] = store.write_version(plan(t, as_of), path)
        t = t.with_tables(**{name: t.spark.read.parquet(f"{path}/data/{versions[name]}")})
    store.publish_set(t.spark, folder, versions)
    store.sweep_set(t.spark, folder, plans, age=age)
    return t


def refresh_gold(t: Tables, folder: str, as_of: dt.date | str) -> Tables:
    """Recompute and publish the four gold tables from current state as one set."""
    return refresh_set(t, GOLD, folder, as_of)


def sync_snapshots(tables: Mapping[str, DataFrame], folder: str, age: dt.timedelta = store.AGE) -> dict[str, DataFrame]:
    """The console's snapshot tables, each with its primary key checked, as one set; nothing changes if a key fails."""
    spark = next(iter(tables.values())).sparkSession
    versions = {}
    for name, key in SNAPSHOT_KEYS.items():
        versions[name] = store.write_version(tables[name], f"{folder}/{name}")
        store.check_key(spark.read.parquet(f"{folder}/{name}/data/{versions[name]}"), key, name)
    store.publish_set(spark, folder, versions)
    store.sweep_set(spark, folder, versions, age=age)
    return store.read_set(spark, folder)


def sync_responses(spark: SparkSession, responses: str, schema: T.StructType, target: str, consumer: str = "console") -> int:
    """Copy the responses that came since the last call to `target`, a folder per read; returns the offset reached.

    Only new batches are read. A stopped copy is done again into the same folder, so no response is missed or doubled.
    """

    def copy(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/read_id={n}")

    return feed.consume(spark, responses, consumer, schema, copy)


def run_agent(
    t: Tables,
    responder: agent.Responder,
    model: str,
    as_of: dt.date | str,
    generated_at: Column,
    folder: str,
    schema: T.StructType,
) -> DataFrame:
    """One agent batch: answer what is unanswered, append new responses, keep the rejects.

    `schema` is the response table's schema. Running the batch again without new messages adds
    nothing, since answered messages are no longer selected and stored ones are not inserted twice. A batch after one that
    failed takes up the replies that it had; they go when the batch is stored, since rejected messages are asked for again.
    """
    path = f"{folder}/agent_responses"
    drafts = feed.read_batches(t.spark, path, schema)
    ledger = f"{folder}/reply_ledger"
    parsed = agent.agent_run(t.with_tables(drafts=drafts), responder, model, as_of, generated_at, ledger=ledger)
    # a rejected message stays unanswered and is tried again by later batches; every failure is kept
    agent.quarantined(parsed).write.mode("append").parquet(f"{folder}/agent_quarantine")
    out = store.insert_new(path, agent.accepted(parsed), "message_id", RESPONSE_ORDER, schema)
    remove(t.spark, ledger)
    return out


def open_quarantine(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The failures of messages that no later batch has answered."""
    answered = feed.read_batches(spark, f"{folder}/agent_responses", schema)
    return spark.read.parquet(f"{folder}/agent_quarantine").join(answered.select("message_id"), "message_id", "left_anti")
