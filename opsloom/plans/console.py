"""Case queue, detail, threads, decisions and dashboards, computed for all cases at once.

A caller that needs one case filters the result; the filter on the grouping key reaches the
scans below the aggregates.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions.ids import id_text, normalise_id
from opsloom.functions.text import dollars, elapsed, matches_search, response_time, time_ago
from opsloom.functions.times import ntz_literal, rounded_minutes, since_instant, whole_minutes, whole_seconds
from opsloom.functions.values import clamp, in_domain, or_zero, role
from opsloom.operators.ordered import dense_index
from opsloom.operators.rows import (
    first_reply_after_last,
    flag_latest,
    join_unique,
    left_join_all,
    split_valid,
)
from opsloom.plans.gold import USER_COUNTERS, WINDOW_DAYS, case_measures, case_spine, user_facts, user_measures
from opsloom.schemas import ACTIONS, CASE_STATUSES
from opsloom.session import stored
from opsloom.sources.commits import take_ids
from opsloom.sources.tables import Tables

CLOSED_SECTION = ("resolved", "closed")


def console_message_stats(t: Tables, compensation: bool = False) -> DataFrame:
    """Per case: message count, admin reply flag, minutes from the first message of any kind to
    the first admin message (rounded; this differs from the gold definition)."""
    stats = case_measures(t, compensation)
    waited = rounded_minutes(F.col("first_message_at"), F.col("first_reply_at")).alias("first_response_minutes")
    linked = ["linked_refund_cents", "linked_credit_cents"] if compensation else []
    return stats.select("case_id", F.col("message_count").cast("int").alias("message_count"), "has_admin_reply", waited, *linked)


def latest_suggestion(t: Tables, drafts: str = "drafts") -> DataFrame:
    """Per case: action, amount and summary of the newest draft."""
    newest = F.max_by(
        F.struct("suggested_action", "suggested_amount_cents", "case_summary"), F.struct("generated_at", "message_id")
    )
    return t[drafts].groupBy("case_id").agg(newest.alias("d")).select("case_id", "d.*")


def _users(t: Tables) -> DataFrame:
    return t["users"].select(F.col("id").alias("user_id"), F.col("name").alias("user_name"), F.col("email").alias("user_email"))


def case_queue(t: Tables, drafts: str = "drafts", ordered: bool = True) -> DataFrame:
    """All cases, newest first, with message stats and the latest suggestion.

    ordered=False leaves out the sort, for results that are filtered or stored further.
    """
    out = left_join_all(
        case_spine(t, _users(t)),
        [(console_message_stats(t), "case_id"), (latest_suggestion(t, drafts), "case_id")],
        {"message_count": 0, "has_admin_reply": False},
    )
    out = out.select(
        "case_id",
        "user_id",
        "user_name",
        "user_email",
        "subject",
        "status",
        "case_created_at",
        "message_count",
        "has_admin_reply",
        "first_response_minutes",
        "suggested_action",
        "suggested_amount_cents",
        "case_summary",
    )
    return out.orderBy(F.desc("case_created_at"), F.desc("case_id")) if ordered else out


def case_detail(t: Tables, as_of: dt.datetime | str, days: int = WINDOW_DAYS) -> DataFrame:
    """Case, user, message stats, linked compensation and user history (instant window)."""
    out = left_join_all(
        case_spine(t, user_facts(t, since_instant(F.col("created_at"), as_of, days))),
        [(console_message_stats(t, compensation=True), "case_id")],
        {"message_count": 0, "has_admin_reply": False},
    )
    return out.select(
        "case_id",
        "user_id",
        "user_name",
        "user_email",
        "user_region",
        "subject",
        "status",
        "case_created_at",
        "message_count",
        "has_admin_reply",
        "first_response_minutes",
        or_zero(F.col("linked_refund_cents")).alias("linked_refund_cents"),
        or_zero(F.col("linked_credit_cents")).alias("linked_credit_cents"),
        "user_lifetime_spend_cents",
        F.col("user_cases_90d").cast("int").alias("user_cases_90d"),
    )


def message_thread(t: Tables) -> DataFrame:
    """Role-labelled messages in thread order."""
    return (
        t["support_messages"]
        .select("case_id", "id", role(F.col("admin_id")).alias("role"), "content", "created_at")
        .orderBy("case_id", "created_at", "id")
    )


def draft_history(t: Tables, drafts: str = "drafts") -> DataFrame:
    """All drafts, newest first per case, with the latest one marked."""
    marked = flag_latest(t[drafts], "case_id", ["generated_at", "message_id"], "is_latest")
    return marked.select(
        "case_id",
        F.lower(F.hex("message_id")).alias("message_id"),
        "case_summary",
        "suggested_response",
        "suggested_action",
        "suggested_amount_cents",
        "reasoning",
        "model",
        "generated_at",
        "is_latest",
    ).orderBy("case_id", F.desc("generated_at"), F.desc("message_id"))


def user_profile_now(t: Tables, as_of: dt.datetime | str, days: int = WINDOW_DAYS) -> DataFrame:
    """The profile counters per user with the instant window."""
    users = t["users"].select(F.col("id").alias("user_id"))
    measures = user_measures(t, since_instant(F.col("created_at"), as_of, days))
    return left_join_all(users, [(measures, "user_id")], {name: 0 for name in USER_COUNTERS}).select("user_id", *USER_COUNTERS)


# --- decisions -------------------------------------------------------------------------------


def decision_checks() -> dict[str, Column]:
    return {
        "case_id": F.col("case_id").isNotNull(),
        "admin_action": in_domain(F.col("admin_action"), ACTIONS),
        "admin_amount_cents": F.col("admin_amount_cents") >= 0,
        "admin_response": F.length("admin_response") > 0,
    }


def status_checks() -> dict[str, Column]:
    return {"status": in_domain(F.col("status"), CASE_STATUSES)}


def decisions_applied(t: Tables, decisions: DataFrame, ids: str | None = None) -> dict[str, DataFrame]:
    """A batch of admin decisions turned into the rows to write.

    Input: case_id, admin_action, admin_amount_cents, admin_response, created_at. Output frames:
    `decisions` (numbered in order of created_at and case_id: from 1, or with `ids`, a folder that holds the next free number, by
    a block reserved there, which no other batch gets; no stored history is read),
    `messages`, `cases` (status transitions), `refunds` (never above the customer's newest
    order; none without an order), `credits` and `rejected`.
    """
    valid, rejected = split_valid(decisions, decision_checks())
    cases = t["support_cases"].select(F.col("id").alias("case_id"), "user_id", F.col("status").alias("old_status"))
    unknown = valid.join(cases.select("case_id"), "case_id", "left_anti").withColumn("reject_reason", F.lit("unknown case"))
    known = valid.join(cases, "case_id")
    admin = t["admins"].agg(F.min("id").alias("admin_id")).where(F.col("admin_id").isNotNull())

    start = 1
    if ids is not None:
        known = stored(known, "decisions")
        start = take_ids(t.spark, ids, known.count())
    # created_at alone may repeat; the other columns make the order of numbering total
    order = ["created_at", "case_id", "admin_action", "admin_amount_cents", "admin_response"]
    numbered = dense_index(known, order, "decision_id", start)

    admin_id = admin.select("admin_id").scalar()
    messages = numbered.withColumn("admin_id", admin_id).where(F.col("admin_id").isNotNull())
    moves = (
        messages.groupBy("case_id", "old_status")
        .agg(F.bool_or(F.col("admin_action") == "resolve").alias("resolves"), F.max("created_at").alias("updated_at"))
        .withColumn(
            "status",
            F.when(F.col("resolves"), "resolved").when(F.col("old_status") == "open", "in_progress").otherwise(F.col("old_status")),
        )
    )
    paying = numbered.where(F.col("admin_amount_cents") > 0)
    refunding = paying.where(F.col("admin_action") == "refund")
    orders = t["orders"].join(refunding.select("user_id").distinct(), "user_id", "left_semi")
    newest = orders.groupBy("user_id").agg(
        F.max_by(F.struct(F.col("id").alias("order_id"), "total_in_cents"), F.struct("created_at", "id")).alias("o")
    )
    refunds = join_unique(refunding, newest.select("user_id", "o.*"), "user_id").select(
        "user_id",
        "order_id",
        F.col("case_id").alias("support_case_id"),
        clamp(F.col("admin_amount_cents").cast("bigint"), F.lit(0), F.col("total_in_cents").cast("bigint")).alias("amount_in_cents"),
        F.col("admin_response").alias("reason"),
        F.lit("pending").alias("status"),
        "created_at",
    )
    credits = paying.where(F.col("admin_action") == "credit").select(
        "user_id",
        F.col("case_id").alias("support_case_id"),
        F.col("admin_amount_cents").cast("bigint").alias("amount_in_cents"),
        F.col("admin_response").alias("reason"),
        "created_at",
    )
    return {
        "decisions": numbered.select(
            F.col("decision_id").alias("id"), "case_id", "admin_action", "admin_amount_cents", "admin_response", "created_at"
        ),
        "messages": messages.select("case_id", "admin_id", F.col("admin_response").alias("content"), "created_at"),
        "cases": moves.select("case_id", "old_status", "status", "updated_at"),
        "refunds": refunds,
        "credits": credits,
        "rejected": rejected.unionByName(unknown),
    }


def decision_history(decisions: DataFrame) -> DataFrame:
    """Stored decisions, newest first per case."""
    return decisions.select(
        "id", "case_id", "admin_action", "admin_amount_cents", "admin_response", "created_at"
    ).orderBy("case_id", F.desc("created_at"), F.desc("id"))


# --- dashboards ------------------------------------------------------------------------------


def support_metrics(overview: DataFrame) -> DataFrame:
    """The daily support overview, rounded for display, newest day first."""
    return overview.select(
        "case_date",
        "total_cases",
        "open_cases",
        "resolved_cases",
        F.round("avg_messages_per_case", 1).alias("avg_messages_per_case"),
        F.round("avg_first_response_minutes", 0).alias("avg_first_response_minutes"),
        "cases_with_refund",
        "cases_with_credit",
        "total_refund_cents",
        "total_credit_cents",
    ).orderBy(F.desc("case_date"))


def agent_performance(t: Tables, drafts: str = "drafts") -> DataFrame:
    """Drafts and average amount per action, most frequent first."""
    return (
        t[drafts]
        .groupBy(F.col("suggested_action").alias("action"))
        .agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("suggested_amount_cents"), 0).alias("avg_amount_cents"))
        .orderBy(F.desc("count"), "action")
    )


def kpi_latest(metrics: DataFrame) -> DataFrame:
    """The newest day's figures as display texts."""
    newest = metrics.orderBy(F.desc("case_date")).limit(1)
    return newest.select(
        "case_date",
        F.col("total_cases").cast("string").alias("total_cases"),
        F.concat(F.col("open_cases").cast("string"), F.lit(" open")).alias("open_text"),
        F.concat(F.col("avg_first_response_minutes").cast("bigint").cast("string"), F.lit("m")).alias("response_text"),
        F.col("cases_with_refund").cast("string").alias("refund_cases"),
        F.concat(dollars(F.col("total_refund_cents")), F.lit(" total")).alias("refund_text"),
        # whole numbers are shown without a fraction
        F.regexp_replace(F.format_string("%.1f", F.col("avg_messages_per_case")), r"\.0$", "").alias("avg_messages"),
    )


# --- queue search, response times, activity --------------------------------------------------


#: Text columns that a search looks into, besides the ids.
SEARCHED = ("subject", "user_name", "user_email", "suggested_action")


def section(status: Column) -> Column:
    return F.when(status.isin(*CLOSED_SECTION), "resolved").otherwise("needs_attention")


def queue_search(queue: DataFrame, query: str = "", as_of: dt.datetime | str | None = None) -> DataFrame:
    """Queue rows that match the query, with their section and, given as_of, their age text."""
    ids = [id_text(queue, "case_id"), id_text(queue, "user_id")]
    texts = [F.col(c) for c in SEARCHED]
    out = queue.where(matches_search(query, ids, texts)).withColumn("section", section(F.col("status")))
    if as_of is not None:
        out = out.withColumn("age", time_ago(whole_minutes(F.col("case_created_at"), ntz_literal(as_of))))
    return out


# --- posting lists ---------------------------------------------------------------------------

GRAM = 3
#: Folders that the queue and its postings are written to; a search reads those it needs.
BLOCKS = 256


def _grams(text: Column) -> Column:
    """The distinct three-character pieces of a text in lower case; none of a shorter text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pieces = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) < GRAM, F.array().cast("array<string>")).otherwise(F.array_distinct(pieces))


def write_queue_index(queue: DataFrame, path: str) -> None:
    """Store a queue (one row per case) in blocks of cases, and for each gram of its searched texts the cases that hold it.

    Postings are (gram, block, case) rows, not lists, so a gram that most cases hold is many rows like any other data.
    """
    searched = [id_text(queue, "case_id"), id_text(queue, "user_id"), *[F.col(c) for c in SEARCHED]]
    block = F.pmod(F.xxhash64("case_id"), F.lit(BLOCKS)).cast("int")
    blocked = stored(queue.withColumn("block", block), "queue")
    blocked.repartitionByRange("block", "case_id").write.mode("overwrite").partitionBy("block").parquet(f"{path}/queue")
    grams = F.array_distinct(F.flatten(F.array(*[_grams(c) for c in searched])))
    postings = blocked.select(F.explode(grams).alias("gram"), F.col("block").alias("case_block"), "case_id")
    postings = postings.withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(BLOCKS)).cast("int"))
    postings.repartitionByRange("block", "gram", "case_block", "case_id").write.mode("overwrite").partitionBy("block").parquet(f"{path}/grams")


def search_index(spark: SparkSession, path: str, query: str = "", as_of: dt.datetime | str | None = None) -> DataFrame:
    """The rows of queue_search, read from the blocks that hold candidates.

    Candidates are the cases that hold every gram of the query, or of the id it may be; they are verified by the search itself. A query
    shorter than a gram has no candidates to look up and reads the whole queue.
    """
    queue = spark.read.parquet(f"{path}/queue").drop("block")
    wanted = F.trim(F.lit(query))
    texts = spark.range(1).select(_grams(wanted).alias("text"), _grams(normalise_id(F.lit(query))).alias("id")).first()
    if not texts["text"]:
        return queue_search(queue, query, as_of)
    postings = spark.read.parquet(f"{path}/grams")
    found = None
    for grams in {tuple(texts["text"]), tuple(texts["id"])} - {()}:
        blocks = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(BLOCKS)).cast("int")).distinct().collect()]
        held = postings.where(F.col("block").isin(blocks) & F.col("gram").isin(list(grams)))
        cases = held.groupBy("case_block", "case_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
        cases = cases.select("case_block", "case_id")
        found = cases if found is None else found.union(cases).distinct()
    found = stored(found, "candidates")
    blocks = [r[0] for r in found.select("case_block").distinct().collect()]  # BLOCKS at most
    rows = spark.read.parquet(f"{path}/queue").where(F.col("block").isin(blocks)).drop("block")
    return queue_search(rows.join(found.select("case_id"), "case_id", "left_semi").select(*queue.columns), query, as_of)


def queue_sections(queue: DataFrame, query: str = "") -> DataFrame:
    """Number of matching cases per section."""
    return queue_search(queue, query).groupBy("section").agg(F.count(F.lit(1)).alias("cases"))


def response_times(t: Tables, as_of: dt.datetime | str) -> DataFrame:
    """Per case with a customer message: the last one, the first admin reply after it, or the wait."""
    customer = F.col("admin_id").isNull()
    pairs = first_reply_after_last(t["support_messages"], "case_id", "created_at", customer, ~customer)
    asked, replied = F.col("last_question_at"), F.col("first_reply_at")
    milliseconds = F.timestamp_diff("MILLISECOND", asked, replied)
    seconds = F.greatest(F.lit(0), F.round(milliseconds / F.lit(1000.0), 0)).cast("bigint")
    waited = whole_seconds(asked, ntz_literal(as_of)).cast("bigint")
    return pairs.select(
        "case_id",
        asked.alias("last_customer_at"),
        replied.alias("first_reply_at"),
        replied.isNull().alias("is_waiting"),
        F.when(replied.isNotNull(), seconds).alias("response_seconds"),
        F.when(replied.isNotNull(), response_time(seconds)).alias("response_text"),
        F.when(replied.isNull(), waited).alias("waiting_seconds"),
        F.when(replied.isNull(), elapsed(waited)).alias("waiting_text"),
    )


def case_activity(
    t: Tables, fields: Sequence[str] = ("id", "user_id", "amount_in_cents", "reason", "created_at")
) -> DataFrame:
    """Refunds and credits linked to cases as one feed, with all their columns."""

    def part(table: str, kind: str, *extra: str) -> DataFrame:
        rows = t[table].where(F.col("support_case_id").isNotNull())
        return rows.select(F.col("support_case_id").alias("case_id"), F.lit(kind).alias("kind"), *fields, *extra)

    feed = part("refunds", "refund", "order_id", "status", "updated_at").unionByName(part("credits", "credit"), allowMissingColumns=True)
    return feed.withColumn("label", F.concat(dollars(F.col("amount_in_cents")), F.lit(" "), F.col("kind")))


