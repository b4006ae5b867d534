"""Aggregates refreshed from the current-state tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.times import day, since_day, whole_minutes
from opsloom.functions.values import amount, count_where, first_time, or_zero, sum_or_zero
from opsloom.operators.rows import agg_per_key, join_unique, left_join_all, measures_per_key
from opsloom.sources.tables import Tables

WINDOW_DAYS = 90


def order_days(t: Tables) -> DataFrame:
    """Order ids with their day. Used alike by several joins, so that its shuffle is reused."""
    days = t["orders"].select(F.col("id").alias("order_id"), day(F.col("created_at")).alias("order_date"))
    return days.where(F.col("order_date").isNotNull())


def item_measures_by_day(t: Tables) -> DataFrame:
    """Per order day: quantity sold, and the category with the highest revenue.

    Items are shuffled once, to their orders; summed up by day and menu item they are few, and these are
    joined to the menu and rolled up to categories. An item without a menu row counts as sold but belongs to no category. Equal
    revenues go to the first category by name.
    """
    menu = t["menu_items"].select(F.col("id").alias("menu_item_id"), "category", F.lit(True).alias("on_menu"))
    items = t["order_items"].select(
        "order_id", "menu_item_id", "quantity", amount(F.col("price_in_cents"), F.col("quantity")).alias("cents")
    )
    dated = items.join(order_days(t), "order_id")
    by_item = dated.groupBy("order_date", "menu_item_id").agg(F.sum("quantity").alias("quantity"), F.sum("cents").alias("cents"))
    by_category = by_item.join(menu, "menu_item_id", "left").groupBy("order_date", "on_menu", "category").agg(
        F.sum("quantity").alias("quantity"), F.sum("cents").alias("cents")
    )
    best = F.min_by(F.col("category"), F.when(F.col("on_menu"), F.struct(-F.col("cents"), F.col("category"))))
    return by_category.groupBy("order_date").agg(F.sum("quantity").alias("items_sold"), best.alias("top_category"))


def daily_revenue(t: Tables, refund_statuses: Sequence[str] = ("approved",)) -> DataFrame:
    """Per order day: orders, gross, refunds, credits, net, average order, items, top category.

    Refunds count on their order's day, credits on their own day; days without orders do not
    appear. Orders of every status count.
    """
    orders = t["orders"].select("id", day(F.col("created_at")).alias("order_date"), "total_in_cents")
    # ids are unique (store.key_violations checks that), so orders are counted as they are
    placed = orders.select(
        "order_date", F.col("total_in_cents").cast("bigint").alias("gross"), F.lit(1).alias("placed"), F.when(F.col("id").isNotNull(), 1).alias("order")
    )
    refunded = agg_per_key(
        t["refunds"],
        "order_id",
        where=F.col("status").isin(*refund_statuses),
        refunds=F.sum(F.col("amount_in_cents").cast("bigint")),
    )
    refunded = refunded.join(order_days(t), "order_id")
    credited = t["credits"].select(day(F.col("created_at")).alias("order_date"), F.col("amount_in_cents").alias("credits"))
    credited = credited.where(F.col("order_date").isNotNull())
    totals = measures_per_key(
        "order_date",
        [placed, refunded.select("order_date", "refunds"), credited],
        {
            "days_orders": F.count("placed"),
            "total_orders": F.count("order"),
            "gross_revenue_cents": F.sum("gross"),
            "total_refunds_cents": sum_or_zero(F.col("refunds")),
            "total_credits_cents": sum_or_zero(F.col("credits")),
        },
    ).where(F.col("days_orders") > 0)
    out = left_join_all(totals, [(item_measures_by_day(t), "order_date")], {"items_sold": 0})
    gross = F.col("gross_revenue_cents")
    return out.select(
        "order_date",
        "total_orders",
        "gross_revenue_cents",
        "total_refunds_cents",
        "total_credits_cents",
        (gross - F.col("total_refunds_cents") - F.col("total_credits_cents")).alias("net_revenue_cents"),
        (gross / F.col("total_orders")).cast("bigint").alias("avg_order_value_cents"),
        "items_sold",
        "top_category",
    )


def case_measures(t: Tables, compensation: bool = True) -> DataFrame:
    """Per case: message count and times, first admin reply and, on request, refunds and credits.

    Messages, refunds and credits are aggregated together, with one shuffle by case.
    """
    is_admin = F.col("admin_id").isNotNull()
    messages = t["support_messages"].where(F.col("case_id").isNotNull()).select(
        "case_id",
        F.lit(1).alias("message"),
        F.col("created_at").alias("sent_at"),
        is_admin.alias("is_admin"),
    )
    aggs = {
        "message_count": F.count("message"),
        "first_message_at": F.min("sent_at"),
        "last_message_at": F.max("sent_at"),
        "first_reply_at": first_time(F.col("sent_at"), F.col("is_admin")),
        "has_admin_reply": F.coalesce(F.bool_or("is_admin"), F.lit(False)),
    }
    if not compensation:
        return measures_per_key("case_id", [messages], aggs)

    def part(table: str, kind: str) -> DataFrame:
        cents = F.coalesce(F.col("amount_in_cents").cast("bigint"), F.lit(0))
        rows = t[table].where(F.col("support_case_id").isNotNull())
        return rows.select(F.col("support_case_id").alias("case_id"), cents.alias(f"{kind}_cents"))

    aggs |= {
        "refund_count": F.count("refund_cents"),
        "credit_count": F.count("credit_cents"),
        "linked_refund_cents": sum_or_zero(F.col("refund_cents")),
        "linked_credit_cents": sum_or_zero(F.col("credit_cents")),
    }
    return measures_per_key("case_id", [messages, part("refunds", "refund"), part("credits", "credit")], aggs)


def support_overview(t: Tables) -> DataFrame:
    """Per day of case creation: cases by status, messages per case, first response, compensation.

    Averages leave out cases without messages or replies; days with none report 0.
    """
    cases = t["support_cases"].select(F.col("id").alias("case_id"), day(F.col("created_at")).alias("case_date"), "status", "created_at")
    per_case = left_join_all(cases, [(case_measures(t), "case_id")])
    minutes = whole_minutes(F.col("created_at"), F.col("first_reply_at"))
    return per_case.groupBy("case_date").agg(
        F.count(F.lit(1)).alias("total_cases"),
        count_where(F.col("status") == "open").alias("open_cases"),
        count_where(F.col("status") == "resolved").alias("resolved_cases"),
        F.coalesce(F.avg(F.when(F.col("message_count") > 0, F.col("message_count"))), F.lit(0.0)).alias("avg_messages_per_case"),
        F.coalesce(F.avg(minutes), F.lit(0.0)).alias("avg_first_response_minutes"),
        count_where(F.col("refund_count") > 0).alias("cases_with_refund"),
        count_where(F.col("credit_count") > 0).alias("cases_with_credit"),
        sum_or_zero(F.col("linked_refund_cents")).alias("total_refund_cents"),
        sum_or_zero(F.col("linked_credit_cents")).alias("total_credit_cents"),
    )


def user_measures(t: Tables, recent: Column) -> DataFrame:
    """Per user: order, case, refund and credit measures, lifetime and within the window.

    `recent` is the window predicate on created_at. The four sources are aggregated together,
    so there is one shuffle by user and a hot user is combined before it.
    """

    def cents(name: str) -> Column:
        return F.col(name).cast("bigint")

    orders = t["orders"].select(
        "user_id",
        F.col("created_at").alias("order_at"),
        cents("total_in_cents").alias("spend"),
        F.lit(1).alias("orders"),
        F.when(recent, 1).alias("recent_orders"),
        F.when(recent, cents("total_in_cents")).alias("recent_spend"),
    )
    cases = t["support_cases"].select(
        "user_id", F.col("created_at").alias("case_at"), F.lit(1).alias("cases"), F.when(recent, 1).alias("recent_cases")
    )
    refunds = t["refunds"].where(recent).select("user_id", cents("amount_in_cents").alias("recent_refunds"))
    credits = t["credits"].where(recent).select("user_id", cents("amount_in_cents").alias("recent_credits"))
    return measures_per_key(
        "user_id",
        [orders, cases, refunds, credits],
        {
            "total_orders_90d": F.count("recent_orders"),
            "total_spend_90d_cents": sum_or_zero(F.col("recent_spend")),
            "lifetime_order_count": F.count("orders"),
            "lifetime_spend_cents": sum_or_zero(F.col("spend")),
            "support_cases_90d": F.count("recent_cases"),
            "support_cases_lifetime": F.count("cases"),
            "total_refunds_90d_cents": sum_or_zero(F.col("recent_refunds")),
            "total_credits_90d_cents": sum_or_zero(F.col("recent_credits")),
            "last_order_date": F.max("order_at"),
            "last_support_case_date": F.max("case_at"),
        },
    )


USER_COUNTERS = (
    "total_orders_90d",
    "total_spend_90d_cents",
    "lifetime_order_count",
    "lifetime_spend_cents",
    "support_cases_90d",
    "support_cases_lifetime",
    "total_refunds_90d_cents",
    "total_credits_90d_cents",
)


def user_support_profile(t: Tables, as_of: dt.date | str, days: int = WINDOW_DAYS) -> DataFrame:
    """Per user: identity, lifetime and calendar-window measures, recency."""
    users = t["users"].select(F.col("id").alias("user_id"), "name", "email", "region")
    measures = user_measures(t, since_day(F.col("created_at"), as_of, days))
    return left_join_all(users, [(measures, "user_id")], {name: 0 for name in USER_COUNTERS}).select(
        "user_id", "name", "email", "region", *USER_COUNTERS, "last_order_date", "last_support_case_date"
    )


def user_facts(t: Tables, recent: Column) -> DataFrame:
    """Per user: identity, lifetime spend and cases in the window, unique on user_id."""
    orders = t["orders"].select("user_id", F.col("total_in_cents").cast("bigint").alias("spend"))
    cases = t["support_cases"].where(recent).select("user_id", F.lit(1).alias("recent_case"))
    measures = measures_per_key(
        "user_id",
        [orders, cases],
        {"user_lifetime_spend_cents": sum_or_zero(F.col("spend")), "user_cases_90d": F.count("recent_case")},
    )
    users = t["users"].select(
        F.col("id").alias("user_id"),
        F.col("name").alias("user_name"),
        F.col("email").alias("user_email"),
        F.col("region").alias("user_region"),
    )
    return left_join_all(users, [(measures, "user_id")], {"user_lifetime_spend_cents": 0, "user_cases_90d": 0})


def case_spine(t: Tables, facts: DataFrame) -> DataFrame:
    """Cases with their user's facts: one join on the possibly hot user, before the joins on the case."""
    cases = t["support_cases"].select(
        F.col("id").alias("case_id"), "user_id", "subject", "status", F.col("created_at").alias("case_created_at")
    )
    return join_unique(cases, facts, "user_id")


def profile_facts(profile: DataFrame) -> DataFrame:
    """user_facts from a stored user_support_profile of the same day and window."""
    renamed = {"name": "user_name", "email": "user_email", "region": "user_region"}
    renamed |= {"lifetime_spend_cents": "user_lifetime_spend_cents", "support_cases_90d": "user_cases_90d"}
    return profile.select("user_id", *[F.col(c).alias(name) for c, name in renamed.items()])


def support_case_context(t: Tables, as_of: dt.date | str, days: int = WINDOW_DAYS, profile: DataFrame | None = None) -> DataFrame:
    """Per case: user, message measures, first response from case creation, compensation, history.

    `profile` takes the stored profiles of the same day, so that the users' facts are not computed twice.
    """
    facts = user_facts(t, since_day(F.col("created_at"), as_of, days)) if profile is None else profile_facts(profile)
    out = left_join_all(
        case_spine(t, facts),
        [(case_measures(t), "case_id")],
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
        "first_message_at",
        "last_message_at",
        "has_admin_reply",
        whole_minutes(F.col("case_created_at"), F.col("first_reply_at")).cast("bigint").alias("first_response_minutes"),
        or_zero(F.col("linked_refund_cents")).alias("linked_refund_cents"),
        or_zero(F.col("linked_credit_cents")).alias("linked_credit_cents"),
        "user_lifetime_spend_cents",
        "user_cases_90d",
    )
