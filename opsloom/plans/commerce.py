"""Orders, carts, deliveries, promotions, upkeep, local times and audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.jsons import with_json
from opsloom.functions.text import ends_with, same_code
from opsloom.functions.times import local_hour, local_weekday, ntz_literal, older_than, valid_at
from opsloom.functions.values import amount, literal_map, lookup, under_cap
from opsloom.operators.ordered import with_neighbour
from opsloom.operators.rows import active_version, join_unique, left_join_all, top_n_per_key
from opsloom.schemas import RUN_COUNTERS
from opsloom.session import stored
from opsloom.sources.tables import Tables

# --- orders, carts, deliveries ---------------------------------------------------------------


def order_detail(t: Tables) -> DataFrame:
    """Order lines with menu names, next to their order."""
    menu = t["menu_items"].select(F.col("id").alias("menu_item_id"), "name")
    orders = t["orders"].select(
        F.col("id").alias("order_id"), "user_id", "status", "total_in_cents", F.col("created_at").alias("ordered_at")
    )
    items = t["order_items"].join(menu, "menu_item_id")
    return items.join(orders, "order_id").select(
        "order_id", "user_id", "status", "total_in_cents", "ordered_at", "menu_item_id", "name", "quantity", "price_in_cents"
    )


def user_orders(t: Tables, n: int | None = None) -> DataFrame:
    """Orders per user, newest first; with n only the n newest per user."""
    orders = t["orders"].select("user_id", F.col("id").alias("order_id"), "status", "total_in_cents", "created_at")
    newest = [F.desc("created_at"), F.desc("order_id")]
    if n is None:
        return orders.orderBy("user_id", *newest)
    return top_n_per_key(orders, ["user_id"], newest, n, rank="order_rank")


def cart_lines(t: Tables) -> DataFrame:
    """Cart items at the current menu price; items without a menu row are left out."""
    menu = t["menu_items"].select(F.col("id").alias("menu_item_id"), "name", "price_in_cents")
    lines = t["cart_items"].join(menu, "menu_item_id")
    return lines.select("cart_id", "menu_item_id", "name", "quantity", "price_in_cents")


def cart_totals(lines: DataFrame, t: Tables) -> DataFrame:
    """Total per cart of priced lines."""
    carts = t["carts"].select(F.col("id").alias("cart_id"), "user_id")
    totals = lines.groupBy("cart_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("quantity"),
        F.sum(amount(F.col("price_in_cents"), F.col("quantity"))).alias("total_in_cents"),
    )
    return totals.join(carts, "cart_id").select("cart_id", "user_id", "lines", "quantity", "total_in_cents")


def cart_pricing(t: Tables) -> DataFrame:
    """Total per cart at current menu prices. Promotions do not change the total."""
    return cart_totals(cart_lines(t), t)


def checkout(t: Tables, created_at: Column) -> dict[str, DataFrame]:
    """Every non-empty cart as an order and its items, and the carts and items that remain.

    The priced lines are stored once and summed up, so that totals and items tell the same prices.
    """
    lines = stored(cart_lines(t), "priced-lines")
    priced = cart_totals(lines, t)
    done = priced.select("cart_id")
    return {
        "orders": priced.select(
            F.col("cart_id").alias("id"),
            "user_id",
            F.lit("pending").alias("status"),
            "total_in_cents",
            created_at.alias("created_at"),
        ),
        "order_items": lines.join(t["carts"].select(F.col("id").alias("cart_id")), "cart_id", "left_semi").select(
            F.col("cart_id").alias("order_id"), "menu_item_id", "quantity", "price_in_cents"
        ),
        "carts": t["carts"].join(done, F.col("id") == F.col("cart_id"), "left_anti"),
        "cart_items": t["cart_items"].join(done, "cart_id", "left_anti"),
    }


def cart_line_merge(adds: DataFrame) -> DataFrame:
    """Repeated adds of an item to a cart as one line; a missing or non-positive quantity counts as 1."""
    quantity = F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(1)
    return adds.groupBy("cart_id", "menu_item_id").agg(F.sum(quantity).alias("quantity"))


def delivery_board(t: Tables) -> DataFrame:
    """Deliveries with their driver's name."""
    drivers = t["drivers"].select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    return t["deliveries"].join(drivers, "driver_id").select(
        "id", "order_id", "driver_id", "status", "started_at", "delivered_at", "driver_name"
    )


def available_menu(t: Tables) -> DataFrame:
    return t["menu_items"].where(F.col("available"))


# --- promotions ------------------------------------------------------------------------------


def active_promotions(t: Tables, as_of: dt.datetime | str) -> DataFrame:
    return t["promotions"].where(valid_at(F.col("starts_at"), F.col("ends_at"), as_of))


def open_promotions(t: Tables, as_of: dt.datetime | str, strict_cap: bool = False) -> DataFrame:
    """Active promotions whose redemption cap is not used up."""
    uncapped = under_cap(F.col("current_redemptions"), F.col("max_redemptions"), strict_cap)
    return active_promotions(t, as_of).where(uncapped)


PROMOTION_COLUMNS = ("id", "code", "name", "description", "discount_strategy", "region", "category", "starts_at", "ends_at")


def _offers_by_region(t: Tables, promos: DataFrame) -> DataFrame:
    """(user_region, promotion) rows: the region's own promotions, and those without a region once per region.

    Users without a region have the empty one. The regions that users have are few, whatever the number of users.
    """
    regions = t["users"].select(F.coalesce("region", F.lit("")).alias("user_region")).distinct()
    # a promotion without a region is looked up under null, and so is every region besides its own name
    wanted = regions.select("user_region", F.explode(F.array("user_region", F.lit(None))).alias("_of"))
    return wanted.join(promos, F.col("_of").eqNullSafe(F.col("region"))).drop("_of")


def promotions_of_users(t: Tables, as_of: dt.datetime | str, strict_cap: bool = False) -> DataFrame:
    """One row per user and open promotion of the user's region or of none, with all its columns."""
    offers = _offers_by_region(t, open_promotions(t, as_of, strict_cap).select(*PROMOTION_COLUMNS))
    users = t["users"].select(F.col("id").alias("user_id"), F.coalesce("region", F.lit("")).alias("user_region"))
    return users.join(offers, "user_region").select("user_id", *PROMOTION_COLUMNS)


def promos_for_users(t: Tables, as_of: dt.datetime | str, strict_cap: bool = False) -> DataFrame:
    """Open promotions per user: those of the user's region and those without a region.

    One row per user with the codes in order. The lists are built per region, not per user:
    users are joined to their region's list by equality, so no user x promotion pairs arise. Every user appears, also with an empty list.
    """
    offers = _offers_by_region(t, open_promotions(t, as_of, strict_cap).select("code", "region"))
    listed = offers.groupBy("user_region").agg(F.sort_array(F.collect_list("code")).alias("_codes"))
    users = t["users"].select(F.col("id").alias("user_id"), F.coalesce("region", F.lit("")).alias("user_region"))
    out = join_unique(users, listed, "user_region", "left").withColumn("_codes", F.coalesce("_codes", F.array().cast("array<string>")))
    return out.select(
        "user_id",
        F.col("user_region").alias("region"),
        F.size("_codes").alias("promo_count"),
        F.array_join("_codes", ",").alias("promo_codes"),
    )


def promo_check(t: Tables, entered: DataFrame, as_of: dt.datetime | str, strict_cap: bool = False) -> DataFrame:
    """Entered codes (any case) with the promotion they unlock, or the problem with them.

    Input: user_id, code. Codes are unique among promotions; a customer needs a cart.
    """
    promos = open_promotions(t, as_of, strict_cap).select(
        F.col("code").alias("_code"), F.col("id").alias("promotion_id"), "name", "discount_strategy"
    )
    carts = t["carts"].where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("_carts"))
    out = entered.join(promos, same_code(F.col("_code"), F.col("code")), "left")
    out = join_unique(out, carts, "user_id", "left")
    problem = F.when(F.col("_carts").isNull(), "no active cart").when(F.col("promotion_id").isNull(), "invalid or expired")
    found = [
        F.when(F.col("problem").isNull(), F.col(column)).alias(name)
        for column, name in (("promotion_id",) * 2, ("name", "promotion_name"), ("discount_strategy",) * 2)
    ]
    return out.withColumn("problem", problem).select(
        "user_id", "code", F.col("problem").isNull().alias("valid"), "problem", *found
    )


def promo_region_multipliers(t: Tables, as_of: dt.datetime | str) -> DataFrame:
    """Highest active traffic multiplier per region, at least 1; no region counts as 'global'."""
    factor = F.coalesce("traffic_multiplier", F.lit(100)) / F.lit(100.0)
    return (
        active_promotions(t, as_of)
        .groupBy(F.coalesce("region", F.lit("global")).alias("region"))
        .agg(F.greatest(F.lit(1.0), F.max(factor)).alias("multiplier"))
    )


# --- upkeep ----------------------------------------------------------------------------------


def stale_carts(t: Tables, as_of: dt.datetime | str, idle_minutes: int = 120) -> DataFrame:
    """Carts untouched for longer than the idle time."""
    return t["carts"].where(older_than(F.col("updated_at"), as_of, idle_minutes))


def drop_stale_carts(t: Tables, as_of: dt.datetime | str, idle_minutes: int = 120) -> dict[str, DataFrame]:
    """Carts and cart items without the stale carts."""
    stale = stale_carts(t, as_of, idle_minutes).select(F.col("id").alias("cart_id"))
    return {
        "carts": t["carts"].where(~F.coalesce(older_than(F.col("updated_at"), as_of, idle_minutes), F.lit(False))),
        "cart_items": t["cart_items"].join(stale, "cart_id", "left_anti"),
    }


def auto_close(t: Tables, as_of: dt.datetime | str, idle_minutes: int = 24 * 60) -> DataFrame:
    """Cases with resolved ones closed after the idle time."""
    due = (F.col("status") == "resolved") & older_than(F.col("updated_at"), as_of, idle_minutes)
    return t["support_cases"].withColumns(
        {
            "status": F.when(due, "closed").otherwise(F.col("status")),
            "updated_at": F.when(due, ntz_literal(as_of)).otherwise(F.col("updated_at")),
        }
    )


# --- orders by local time --------------------------------------------------------------------

# Names of the weekdays, 0 = Sunday.
WEEKDAYS = {"0": "Sun", "1": "Mon", "2": "Tue", "3": "Wed", "4": "Thu", "5": "Fri", "6": "Sat"}


def orders_by_local_time(t: Tables) -> DataFrame:
    """Orders per local hour and weekday of the user's time zone (UTC where none is known)."""
    users = t["users"].select(F.col("id").alias("user_id"), "time_zone")
    zone = F.coalesce("time_zone", F.lit("UTC"))
    local = t["orders"].select("user_id", "created_at").join(users, "user_id", "left").select(
        local_hour(F.col("created_at"), zone).alias("local_hour"),
        lookup(literal_map(WEEKDAYS), local_weekday(F.col("created_at"), zone), "?").alias("local_weekday"),
    )
    return local.groupBy("local_hour", "local_weekday").agg(F.count(F.lit(1)).alias("orders"))


def users_by_email_end(t: Tables, suffix: str) -> DataFrame:
    """Users whose e-mail address ends with `suffix`."""
    return t["users"].where(ends_with(F.col("email"), suffix)).select(F.col("id").alias("user_id"), "email")


# --- audits, runs, configurations ------------------------------------------------------------

# Status steps of an order that its rules allow.
ORDER_STEPS = (
    ("pending", "preparing"),
    ("preparing", "ready"),
    ("ready", "out_for_delivery"),
    ("out_for_delivery", "delivered"),
    ("pending", "cancelled"),
)
# Steps to these statuses skip the rules when a delivery is entered or completed by hand.
UNCHECKED_TARGETS = ("out_for_delivery", "delivered")


def transition_verdict(previous: Column, current: Column) -> Column:
    allowed = F.lit(False)
    for a, b in ORDER_STEPS:
        allowed = allowed | ((previous == a) & (current == b))
    return (
        F.when(previous.isNull(), "start")
        .when(previous == current, "unchanged")
        .when(allowed, "ok")
        .when(current.isin(*UNCHECKED_TARGETS), "warning")
        .otherwise("violation")
    )


def order_transition_audit(
    history: DataFrame, key: str = "id", seq: str = "_lsn", parts: int | None = None
) -> DataFrame:
    """Each status row of a history with the status before it and a verdict on the step."""
    rows = with_neighbour(history, [key], [seq], {"previous_status": "status"}, -1, parts)
    verdict = transition_verdict(F.col("previous_status"), F.col("status")).alias("verdict")
    return rows.select(key, seq, "previous_status", "status", verdict)


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("previous_status", "status", "verdict").agg(F.count(F.lit(1)).alias("steps"))


def recent_runs(t: Tables, n: int = 10) -> DataFrame:
    """The n newest runs with their counters read from JSON."""
    newest = t["runs"].orderBy(F.desc("started_at"), F.desc("id")).limit(n)
    parsed = with_json(newest, "counters", RUN_COUNTERS)
    return parsed.select("id", "status", "started_at", "counters.*")


def run_health(t: Tables, n: int = 10) -> DataFrame:
    """Over the n newest runs: the newest one and whether any is still running."""
    newest = t["runs"].orderBy(F.desc("started_at"), F.desc("id")).limit(n)
    running = F.count_if(F.col("status") == "running")
    return newest.agg(
        F.max_by(F.struct("id", "status"), F.struct("started_at", "id")).alias("latest"),
        F.count(F.lit(1)).alias("runs"),
        running.alias("running"),
    ).select("latest.id", "latest.status", "runs", "running", (F.col("running") > 0).alias("has_running"))


def active_config(t: Tables) -> DataFrame:
    """The active configuration with the highest version."""
    return active_version(t["configs"], "version", F.col("active") == "active")
