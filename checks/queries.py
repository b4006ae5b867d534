"""Every product and operator as a query over the check tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.sample_tables import AS_OF, AS_OF_TIME, HISTORIES, RAW, sample_tables
from opsloom.functions.ids import hex_to_uuid, key_bytes, normalise_id, short_id, uuid_text
from opsloom.functions.jsons import parse_replies, with_json
from opsloom.functions.times import ntz_literal
from opsloom.operators import cdc
from opsloom.operators.rows import split_valid
from opsloom.plans import agent, commerce, console, gold, jobs
from opsloom.schemas import AGENT_RESPONSE_SCHEMA, BASE_RATES, DISCOUNT_STRATEGY, ORDER_STATUSES
from opsloom.session import scratch_path, stored
from opsloom.sources import feed, store
from opsloom.sources.history import read_history_stream
from opsloom.sources.tables import Tables
from opsloom.streaming import change_feed
from opsloom.streaming.current_state import compact, keyed_state, read_current_state, start_current_state

Query = Callable[[SparkSession, str], DataFrame]
EVENTS = cdc.Flow("events")


def _over(plan: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: plan(sample_tables(spark, folder))


# --- change histories ------------------------------------------------------------------------


def _scd2(t: Tables) -> DataFrame:
    deleted = F.col("_change_type") == "delete"
    out = cdc.scd2_intervals(t["event_history"], ["id"], ["_lsn"], "_timestamp", deleted)
    return out.select("id", F.col("_lsn").alias("lsn"), "value", "valid_from", "valid_to", "is_current")


def _as_of(t: Tables) -> DataFrame:
    """The state halfway through the history."""
    deleted = F.col("_change_type") == "delete"
    half = t["event_history"].agg(F.floor(F.max("_lsn") / 2)).scalar()
    return cdc.state_as_of(t["event_history"], ["id"], ["_lsn"], half, deleted)


def _diff(t: Tables) -> DataFrame:
    return cdc.diff_changes(_as_of(t), EVENTS.current(t["event_history"]), ["id"]).withColumnRenamed("_change_type", "change")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events file as a stream of changes."""
    sample_tables(spark, folder)
    schema = T.StructType.fromDDL(RAW["events"])
    # a pattern, so that the table may be one file or a folder of files
    rows = read_history_stream(spark, f"{folder}/events.parque[t]", schema)
    kind = F.col("event_type")
    return rows.select(
        F.col("user_id").alias("id"),
        "value",
        "props",
        F.when(kind == "error", "delete").when(kind == "signup", "insert").otherwise("update").alias("_change_type"),
        F.col("event_id").alias("_lsn"),
        (F.col("event_id") % 7).alias("_xid"),
        F.col("ts").alias("_timestamp"),
    )


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """A current-state table fed from the stream and read back."""
    history = _event_stream(spark, folder)
    path = scratch_path(spark, "events-state")
    start_current_state(history, EVENTS, path).awaitTermination()
    return read_current_state(spark, path, EVENTS, history.schema)


def _keyed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the latest change per key held as streaming state."""
    history = _event_stream(spark, folder)
    path = scratch_path(spark, "events-keyed")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")

    query = keyed_state(history, EVENTS).writeStream.outputMode("update").foreachBatch(write)
    query.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read_current_state(spark, path, EVENTS, history.schema)


def _current(name: str) -> Query:
    flow = cdc.build_flows(HISTORIES)[name]
    return _over(lambda t: flow.current(t[f"{name}_history"]))


def _current_stream(name: str) -> Query:
    """The same table from a stream whose batches overlap in time: every batch holds late changes of the ones before."""
    flow = cdc.build_flows(HISTORIES)[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        history = sample_tables(spark, folder)[f"{name}_history"]
        bronze, path = scratch_path(spark, f"{name}-bronze"), scratch_path(spark, f"{name}-state")
        third = F.pmod(F.xxhash64("_lsn", *flow.keys), F.lit(3))
        for batch in range(3):
            history.where(third == batch).write.mode("append").parquet(bronze)
            stream = read_history_stream(spark, bronze, history.schema)
            start_current_state(stream, flow, path).awaitTermination()
            if batch == 1:
                compact(spark, path, flow, history.schema, batch)
        return read_current_state(spark, path, flow, history.schema)

    return run


def _change_feed(name: str) -> Query:
    """The same batches as before and after images from streaming state, applied to an empty table."""
    flow = cdc.build_flows(HISTORIES)[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        history = sample_tables(spark, folder)[f"{name}_history"]
        bronze, path = scratch_path(spark, f"{name}-bronze"), scratch_path(spark, f"{name}-feed")
        third = F.pmod(F.xxhash64("_lsn", *flow.keys), F.lit(3))
        for batch in range(3):
            history.where(third == batch).write.mode("append").parquet(bronze)
            change_feed.start_change_feed(read_history_stream(spark, bronze, history.schema), flow, path).awaitTermination()
        feed = spark.read.schema(change_feed.feed_schema(history.schema, flow)).parquet(f"{path}/changes")
        nothing = spark.createDataFrame([], history.drop(*flow.drop).schema)
        return change_feed.apply_feed(nothing, feed, flow)

    return run


# --- agent -----------------------------------------------------------------------------------


def _prompts(t: Tables) -> DataFrame:
    return agent.case_prompts(t, stored(agent.unanswered_messages(t), "selected"), AS_OF)


def _echo_responder() -> agent.Responder:
    """A stand-in responder: the subject line and the prompt length; refuses every seventh length.

    An inner function travels to the tasks with its code, so they need not import this module.
    """

    def echo(instructions: str, pieces: Iterator[str]) -> str:
        length, subject = -1, None  # a line end between pieces
        for piece in pieces:
            subject = piece.split("\n", 1)[0].removeprefix("Subject: ") if subject is None else subject
            length += 1 + len(piece)
        if length % 7 == 0:
            return "I can not help with that."
        return (
            f'```json\n{{"case_summary": "{subject}", "suggested_response": "ok", "suggested_action": "credit", '
            f'"suggested_amount_cents": {length}, "reasoning": "length"}}\n```'
        )

    return echo


def _echo_run(t: Tables) -> DataFrame:
    return agent.agent_run(t, _echo_responder(), "echo", AS_OF, ntz_literal(AS_OF_TIME))


def _echo_accepted(t: Tables) -> DataFrame:
    return agent.accepted(_echo_run(t))


def _echo_quarantined(t: Tables) -> DataFrame:
    return agent.quarantined(_echo_run(t))


def _parsed(t: Tables) -> DataFrame:
    return parse_replies(t["replies"], "raw_reply", "responder_error").withColumn("generated_at", ntz_literal(AS_OF_TIME))


def _publish(t: Tables) -> DataFrame:
    """Existing drafts, then every parsed reply, then the same again: each message once."""
    path = scratch_path(t.spark, "responses")
    order = ["generated_at", "message_id"]
    store.insert_new(path, t["drafts"].select(*agent.RESPONSE_COLUMNS), "message_id", order)
    for _ in range(2):
        out = store.insert_new(path, agent.accepted(_parsed(t)), "message_id", order)
    return out


def _response_feed(t: Tables) -> DataFrame:
    """Two appends, copied by a consumer whose second read is stopped after it wrote and then done again."""
    spark, path, target = t.spark, scratch_path(t.spark, "responses"), scratch_path(t.spark, "console")
    drafts, order = t["drafts"].select(*agent.RESPONSE_COLUMNS), ["generated_at", "message_id"]

    def stopped(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/read_id={n}")
        raise InterruptedError

    store.insert_new(path, drafts, "message_id", order)
    jobs.sync_responses(spark, path, drafts.schema, target)
    store.insert_new(path, agent.accepted(_parsed(t)), "message_id", order)
    try:
        feed.consume(spark, path, "console", drafts.schema, stopped)
    except InterruptedError:
        jobs.sync_responses(spark, path, drafts.schema, target)
    return spark.read.parquet(target).select(*drafts.columns)


def _typed(t: Tables) -> DataFrame:
    """Parsed replies in the response table's own types, with binary ids, and read back."""
    ids = {c: F.unhex(F.md5(F.col(c).cast("string"))) for c in ("message_id", "case_id")}
    typed = agent.accepted(_parsed(t)).withColumns(
        {**ids, "user_id": F.col("user_id").cast("string"), "generated_at": F.col("generated_at").cast("timestamp")}
    )
    path = scratch_path(t.spark, "responses")
    out = store.insert_new(path, typed, "message_id", ["generated_at", "message_id"], AGENT_RESPONSE_SCHEMA)
    shown = {c: F.lower(F.hex(c)) for c in ids}
    return out.withColumns({**shown, "generated_at": F.col("generated_at").cast("timestamp_ntz")})


def _policy(t: Tables) -> DataFrame:
    """Compensation rules on all unanswered messages, with subjects and closing thanks varied."""
    subjects = F.array(*[F.lit(s.capitalize()) for s in SUBJECTS])
    cases = t["support_cases"].withColumn("subject", F.get(subjects, (F.col("id") % len(SUBJECTS)).cast("int")))
    thanks = F.when(F.col("case_id") % 5 == 0, F.concat(F.lit("Many THANKS. "), "content")).otherwise(F.col("content"))
    t = t.with_tables(support_cases=cases, support_messages=t["support_messages"].withColumn("content", thanks))
    return agent.policy_suggestions(t, stored(agent.unanswered_messages(t), "selected"), AS_OF)


# The subjects with a rule of their own, and one without.
SUBJECTS = (*[s for s in agent.SUBJECT_POLICY if "," not in s], "something else")


# --- console ---------------------------------------------------------------------------------


def _decisions(part: str) -> Query:
    return _over(lambda t: console.decisions_applied(t, t["decisions"])[part])


def _decisions_after_history(t: Tables) -> DataFrame:
    """A second batch continues the numbering of the first."""
    ids = scratch_path(t.spark, "decision-ids")
    first = console.decisions_applied(t, t["decisions"].where(F.col("admin_action") != "credit"), ids)["decisions"]
    second = console.decisions_applied(t, t["decisions"].where(F.col("admin_action") == "credit"), ids)["decisions"]
    return console.decision_history(first.unionByName(second))


def _binary_join(t: Tables) -> DataFrame:
    """Cases keyed by uuid text joined to drafts keyed by hex or base64 of the same bytes."""
    digest = F.md5(F.col("case_id").cast("string"))
    forms = F.when(F.col("message_id") % 2 == 0, digest).otherwise(F.base64(F.unhex(digest)))
    drafts = t["drafts"].select(key_bytes(forms).alias("key"), "message_id")
    uuid = hex_to_uuid(F.md5(F.col("id").cast("string")))
    cases = t["support_cases"].select(uuid.alias("case_uuid"), key_bytes(uuid).alias("key"))
    joined = cases.join(drafts, "key")
    counted = joined.groupBy("key", "case_uuid").agg(F.count(F.lit(1)).alias("drafts"))
    return counted.select("case_uuid", short_id(F.col("case_uuid")).alias("short_id"), uuid_text(F.col("key")).alias("key_text"), "drafts")


def _normalised(t: Tables) -> DataFrame:
    """User ids in four written forms and one unusable form."""
    digest = F.md5(F.col("id").cast("string"))
    kind = F.col("id") % 5
    written = (
        F.when(kind == 0, F.upper(hex_to_uuid(digest)))
        .when(kind == 1, digest)
        .when(kind == 2, F.base64(F.unhex(digest)))
        .when(kind == 3, F.concat(F.lit("  "), hex_to_uuid(digest), F.lit("\n")))
        .otherwise(F.substring(digest, 1, 31))
    )
    return t["users"].select("id", normalise_id(written).alias("uuid"))


def _search(t: Tables) -> DataFrame:
    return console.queue_search(console.case_queue(t, ordered=False), " CASE 1", AS_OF_TIME)


def _indexed_search(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "queue-index")
    console.write_queue_index(console.case_queue(t, ordered=False), path)
    return console.search_index(t.spark, path, " CASE 1", AS_OF_TIME)


# --- commerce --------------------------------------------------------------------------------


def _checkout_items_left(t: Tables) -> DataFrame:
    """Checkout with the available menu only: carts of nothing else keep their items."""
    menu = commerce.available_menu(t)
    return commerce.checkout(t.with_tables(menu_items=menu), ntz_literal(AS_OF_TIME))["cart_items"]



def _local_time(t: Tables) -> DataFrame:
    """Orders by the local time of their users, whose zone follows the region."""
    region = F.col("region")
    zone = F.when(region == "AMERICA", "America/New_York").when(region == "EUROPE", "Europe/London").when(region == "ASIA", "Asia/Tokyo")
    return commerce.orders_by_local_time(t.with_tables(users=t["users"].withColumn("time_zone", zone)))


def _active_config(t: Tables) -> DataFrame:
    parsed = with_json(commerce.active_config(t), "base_rates", BASE_RATES)
    return parsed.select("id", "version", F.col("base_rates.signupsPerTick").alias("signups_per_tick"))


def _discounts(t: Tables) -> DataFrame:
    parsed = with_json(t["promotions"], "discount_strategy", DISCOUNT_STRATEGY)
    return parsed.select("code", F.col("discount_strategy.type").alias("type"), F.col("discount_strategy.percent").alias("percent"))


def _status_split(t: Tables) -> DataFrame:
    """Status rows checked against the order status domain and a value check, with the reasons."""
    rows = t["order_history"].withColumn("status", F.when(F.col("_lsn") % 9 == 0, F.lit(None)).otherwise(F.col("status")))
    checks = {"status": F.col("status").isin(*ORDER_STATUSES), "id": F.col("id") % 10 != 3}
    valid, rejected = split_valid(rows, checks)
    both = valid.withColumn("reject_reason", F.lit("")).unionByName(rejected)
    return both.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


def _snapshot(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "profile")
    return store.sync_snapshot(gold.user_support_profile(t, AS_OF), ["user_id"], path)


def _materialized(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "revenue")
    store.materialize(gold.daily_revenue(t), path)
    return store.read_materialized(t.spark, path)


def _gold_set(name: str) -> Query:
    """A table of the gold set, published together with the others."""

    def run(t: Tables) -> DataFrame:
        folder = scratch_path(t.spark, "gold")
        jobs.refresh_gold(t, folder, AS_OF)
        return store.read_set(t.spark, folder)[name]

    return _over(run)


def _console_snapshot(name: str) -> Query:
    """A table of the console's snapshot set, keys checked."""

    def run(t: Tables) -> DataFrame:
        tables = {
            "support_case_context": gold.support_case_context(t, AS_OF),
            "user_support_profile": gold.user_support_profile(t, AS_OF),
            "support_overview": gold.support_overview(t),
        }
        return jobs.sync_snapshots(tables, scratch_path(t.spark, "console"))[name]

    return _over(run)


def _key_violations(t: Tables) -> DataFrame:
    keys = t["deliveries"].select("id")
    return store.key_violations(keys, ["id"])


QUERIES: dict[str, Query] = {
    # gold
    "daily_revenue": _over(gold.daily_revenue),
    "daily_revenue_materialized": _over(_materialized),
    "support_overview": _over(gold.support_overview),
    "user_support_profile": _over(lambda t: gold.user_support_profile(t, AS_OF)),
    "support_case_context": _over(lambda t: gold.support_case_context(t, AS_OF)),
    **{f"{name}_materialized": _gold_set(name) for name in jobs.SNAPSHOT_KEYS},
    **{f"{name}_snapshot": _console_snapshot(name) for name in jobs.SNAPSHOT_KEYS},
    # change histories
    "cdc_current_state": _over(lambda t: EVENTS.current(t["event_history"])),
    "cdc_current_state_stream": _stream,
    "cdc_keyed_state_stream": _keyed_stream,
    "cdc_scd2": _over(_scd2),
    "cdc_as_of": _over(_as_of),
    "cdc_diff": _over(_diff),
    **{f"silver_{name}": _current(name) for name in HISTORIES},
    **{f"silver_{name}_stream": _current_stream(name) for name in HISTORIES},
    **{f"silver_{name}_change_feed": _change_feed(name) for name in ("orders", "support_cases")},
    # agent
    "unanswered_messages": _over(agent.unanswered_messages),
    "unanswered_messages_strict": _over(lambda t: agent.unanswered_messages(t, strict=True)),
    "case_prompts": _over(_prompts),
    "agent_responses": _over(_echo_accepted),
    "agent_responses_quarantine": _over(_echo_quarantined),
    "agent_responses_validated": _over(lambda t: agent.accepted(_parsed(t))),
    "agent_quarantine": _over(lambda t: agent.quarantined(_parsed(t))),
    "agent_publish_insert_only": _over(_publish),
    "response_feed": _over(_response_feed),
    "agent_responses_typed": _over(_typed),
    "policy_suggestions": _over(_policy),
    # console
    "case_queue": _over(console.case_queue),
    "case_detail": _over(lambda t: console.case_detail(t, AS_OF_TIME)),
    "message_thread": _over(console.message_thread),
    "draft_history": _over(console.draft_history),
    "user_profile_now": _over(lambda t: console.user_profile_now(t, AS_OF_TIME)),
    "decisions_applied": _decisions("decisions"),
    "decision_messages": _decisions("messages"),
    "decision_case_updates": _decisions("cases"),
    "decision_refunds": _decisions("refunds"),
    "decision_credits": _decisions("credits"),
    "decision_rejects": _decisions("rejected"),
    "decision_history": _over(_decisions_after_history),
    "support_metrics": _over(lambda t: console.support_metrics(gold.support_overview(t))),
    "agent_performance": _over(console.agent_performance),
    "kpi_latest": _over(lambda t: console.kpi_latest(console.support_metrics(gold.support_overview(t)))),
    "queue_search": _over(_search),
    "queue_search_indexed": _over(_indexed_search),
    "queue_sections": _over(lambda t: console.queue_sections(console.case_queue(t, ordered=False))),
    "response_time": _over(lambda t: console.response_times(t, AS_OF_TIME)),
    "case_activity": _over(console.case_activity),
    "binary_key_join": _over(_binary_join),
    "normalised_ids": _over(_normalised),
    # commerce
    "order_detail": _over(commerce.order_detail),
    "user_orders": _over(commerce.user_orders),
    "user_orders_top5": _over(lambda t: commerce.user_orders(t, 5)),
    "cart_pricing": _over(commerce.cart_pricing),
    "checkout_orders": _over(lambda t: commerce.checkout(t, ntz_literal(AS_OF_TIME))["orders"]),
    "checkout_order_items": _over(lambda t: commerce.checkout(t, ntz_literal(AS_OF_TIME))["order_items"]),
    "checkout_carts_left": _over(lambda t: commerce.checkout(t, ntz_literal(AS_OF_TIME))["carts"]),
    "checkout_cart_items_left": _over(_checkout_items_left),
    "cart_line_merge": _over(lambda t: commerce.cart_line_merge(t["cart_adds"])),
    "delivery_board": _over(commerce.delivery_board),
    "available_menu": _over(commerce.available_menu),
    "promos_for_users": _over(lambda t: commerce.promos_for_users(t, AS_OF_TIME)),
    "promotions_of_users": _over(lambda t: commerce.promotions_of_users(t, AS_OF_TIME)),
    "promo_check": _over(lambda t: commerce.promo_check(t, t["entered_codes"], AS_OF_TIME)),
    "promo_region_multipliers": _over(lambda t: commerce.promo_region_multipliers(t, AS_OF_TIME)),
    "promo_discounts": _over(_discounts),
    "stale_carts": _over(lambda t: commerce.stale_carts(t, AS_OF_TIME)),
    "stale_carts_kept": _over(lambda t: commerce.drop_stale_carts(t, AS_OF_TIME)["carts"]),
    "stale_cart_items_kept": _over(lambda t: commerce.drop_stale_carts(t, AS_OF_TIME)["cart_items"]),
    "auto_close": _over(lambda t: commerce.auto_close(t, AS_OF_TIME)),
    "orders_by_local_time": _over(_local_time),
    "users_by_email_end": _over(lambda t: commerce.users_by_email_end(t, "7")),
    "order_transition_audit": _over(lambda t: commerce.order_transition_audit(t["order_history"])),
    "order_transition_summary": _over(lambda t: commerce.audit_summary(commerce.order_transition_audit(t["order_history"]))),
    "recent_runs": _over(commerce.recent_runs),
    "run_health": _over(commerce.run_health),
    "active_config": _over(_active_config),
    # checks and sinks
    "status_domain_split": _over(_status_split),
    "snapshot_sync_check": _over(_snapshot),
    "snapshot_key_violations": _over(_key_violations),
}
