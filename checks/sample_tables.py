"""The check tables renamed into the shapes the plans expect (integer ids stand in for uuids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.sources.tables import Tables

AS_OF = "2001-08-01"
AS_OF_TIME = "2001-07-30 12:00:00"
START = "2001-04-20 00:00:00"


def _cents(col: Column) -> Column:
    return F.round(col * 100).cast("bigint")


def _case_start(conv: Column) -> Column:
    return F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(days=(conv % 100).cast("int"))


def _case_user(conv: Column) -> Column:
    """Three cases a user; the users spread over the customers at every size."""
    return (conv - conv % 3) * 7


def _case_of(order_key: Column) -> Column:
    """Orders of a case; at every size they reach all or the first half of the cases."""
    return F.floor(order_key / 150)


def _line_number() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


# The files' schemas, so that opening a table runs no job.
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class _Build:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    def users(self) -> DataFrame:
        nation = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.lower("c_name").alias("email"),
            F.col("r_name").alias("region"),
        )

    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("status"),
            _cents(F.col("o_totalprice")).alias("total_in_cents"),
            F.col("o_orderdate").alias("created_at"),
        )

    def order_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("menu_item_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            _cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_in_cents"),
        )

    def menu_items(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            _cents(F.col("p_retailprice")).alias("price_in_cents"),
            (F.col("p_size") <= 40).alias("available"),
        )

    def _compensation(self, flag: str) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        lines = self.raw("lineitem").where(F.col("l_returnflag") == flag)
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def refunds(self) -> DataFrame:
        key = F.col("l_orderkey")
        return self._compensation("R").select(
            F.col("o_custkey").alias("user_id"),
            key.alias("order_id"),
            F.when(key % 3 == 0, _case_of(key)).alias("support_case_id"),
            _cents(F.col("l_extendedprice") * F.col("l_discount")).alias("amount_in_cents"),
            F.when(F.col("l_linestatus") == "F", "approved").otherwise("pending").alias("status"),
            F.col("l_shipdate").alias("created_at"),
            _line_number().alias("id"),
            F.concat(F.lit("returned by "), F.col("l_suppkey").cast("string")).alias("reason"),
            (F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_linenumber"))).alias("updated_at"),
        )

    def credits(self) -> DataFrame:
        key = F.col("l_orderkey")
        return self._compensation("A").select(
            F.col("o_custkey").alias("user_id"),
            F.when(key % 4 == 0, _case_of(key)).alias("support_case_id"),
            _cents(F.col("l_extendedprice") * F.col("l_tax")).alias("amount_in_cents"),
            F.col("l_shipdate").alias("created_at"),
            _line_number().alias("id"),
            F.concat(F.lit("goodwill for "), F.col("l_partkey").cast("string")).alias("reason"),
        )

    def support_cases(self) -> DataFrame:
        conv = F.col("conv_id")
        step = conv % 4
        return self.raw("conversations").select("conv_id").distinct().select(
            conv.alias("id"),
            _case_user(conv).alias("user_id"),
            F.concat(F.lit("case "), conv.cast("string")).alias("subject"),
            F.when(step == 0, "open").when(step == 1, "in_progress").when(step == 2, "resolved").otherwise("closed").alias("status"),
            _case_start(conv).alias("created_at"),
            (_case_start(conv) + F.make_dt_interval(hours=(conv % 60).cast("int"))).alias("updated_at"),
        )

    def support_messages(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        later = F.make_dt_interval(mins=(turn * 7 + 3).cast("int"), secs=(conv % 60).cast("decimal(18,6)"))
        # who is not the customer speaks for the shop: replies and the turns of the system
        customer = F.coalesce(F.col("role") == "user", F.lit(False))
        return self.raw("conversations").select(
            (conv * 100 + turn).alias("id"),
            conv.alias("case_id"),
            F.when(customer, _case_user(conv)).alias("user_id"),
            F.when(~customer, conv % 3).alias("admin_id"),
            F.col("text").alias("content"),
            (_case_start(conv) + later).alias("created_at"),
        )

    def drafts(self) -> DataFrame:
        step = F.col("id") % 5
        action = F.when(step == 0, "refund").when(step == 1, "credit").when(step == 2, "no_action").when(step == 3, "escalate")
        rows = self.support_messages().where(F.col("admin_id").isNull() & (F.col("id") % 3 == 0))
        return rows.select(
            F.col("id").alias("message_id"),
            "case_id",
            "user_id",
            F.concat(F.lit("summary "), F.col("id").cast("string")).alias("case_summary"),
            F.concat(F.lit("reply "), F.col("id").cast("string")).alias("suggested_response"),
            action.otherwise("resolve").alias("suggested_action"),
            F.when(step < 2, (F.col("case_id") % 7) * 100).otherwise(0).cast("int").alias("suggested_amount_cents"),
            F.concat(F.lit("because "), F.col("id").cast("string")).alias("reasoning"),
            F.lit("rules").alias("model"),
            F.col("created_at").alias("generated_at"),
        )


    def admins(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lower("s_name").alias("email")
        )

    def drivers(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))

    def deliveries(self) -> DataFrame:
        done = F.col("l_linestatus") == "F"
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_suppkey").alias("driver_id"),
            F.when(done, "delivered").otherwise("in_transit").alias("status"),
            F.col("l_shipdate").alias("started_at"),
            F.when(done, F.col("l_shipdate") + F.make_dt_interval(hours=F.lit(2))).alias("delivered_at"),
        )

    def carts(self) -> DataFrame:
        idle = F.make_dt_interval(mins=(F.col("o_orderkey") % 240).cast("int"))
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("created_at"),
            (F.lit(AS_OF_TIME).cast("timestamp_ntz") - idle).alias("updated_at"),
        )

    def cart_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("cart_id"),
            F.col("l_partkey").alias("menu_item_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
        )

    def cart_adds(self) -> DataFrame:
        line = F.col("l_linenumber")
        quantity = F.when(line == 1, F.lit(None)).when(line == 2, 0).when(line == 3, -1).otherwise(F.col("l_quantity").cast("int"))
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("cart_id"), F.col("l_partkey").alias("menu_item_id"), quantity.alias("quantity")
        )

    def promotions(self) -> DataFrame:
        n, now = F.col("n"), F.lit(AS_OF_TIME).cast("timestamp_ntz")
        region = F.lit(None).cast("string")
        for i, name in enumerate(PROMO_REGIONS, 1):
            region = F.when(n % 10 == i, name).otherwise(region)
        brands = self.raw("part").groupBy("p_brand").agg(F.min("p_partkey").alias("id"), F.count(F.lit(1)).alias("uses"))
        return brands.withColumn("n", F.substring_index("p_brand", "#", -1).cast("int")).select(
            "id",
            F.upper("p_brand").alias("code"),
            F.col("p_brand").alias("name"),
            F.concat(F.lit("All of "), "p_brand").alias("description"),
            F.when(n % 2 == 0, F.concat(F.lit("size "), n.cast("string"))).alias("category"),
            F.concat(F.lit('{"type":"percentage_off","percent":'), n.cast("string"), F.lit("}")).alias("discount_strategy"),
            region.alias("region"),
            (n * 10 + 80).alias("traffic_multiplier"),
            F.when(n % 4 != 0, n * 20).alias("max_redemptions"),
            F.col("uses").cast("int").alias("current_redemptions"),
            (now - F.make_dt_interval(days=n)).alias("starts_at"),
            (now + F.make_dt_interval(days=n % 5 - 1)).alias("ends_at"),
        )

    def entered_codes(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(key.alias("user_id"), F.concat(F.lit("brand#"), (key % 30).cast("string")).alias("code"))

    def runs(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.when(kind == "error", "failed").when(kind == "signup", "running").otherwise("completed").alias("status"),
            F.col("ts").alias("started_at"),
            F.replace("props", F.lit('"k"'), F.lit('"signups"')).alias("counters"),
        )

    def configs(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("id"),
            (key * 2 + 1).alias("version"),
            F.concat(F.lit('{"signupsPerTick":'), F.col("p_size").cast("string"), F.lit("}")).alias("base_rates"),
            F.when(key % 3 == 0, "active").otherwise("inactive").alias("active"),
        )

    def decisions(self) -> DataFrame:
        return self.drafts().select(
            "case_id",
            F.when(F.col("message_id") % 11 == 0, "unheard_of").otherwise(F.col("suggested_action")).alias("admin_action"),
            F.when(F.col("message_id") % 13 == 0, -1)
            .when(F.col("suggested_action") == "refund", F.col("suggested_amount_cents") * 100_000)
            .otherwise(F.col("suggested_amount_cents"))
            .alias("admin_amount_cents"),
            F.col("suggested_response").alias("admin_response"),
            F.col("generated_at").alias("created_at"),
        )

    def replies(self) -> DataFrame:
        """Raw reply texts in every form a responder may produce, one per customer message."""
        key = F.col("id")
        kind, n = key % 12, key.cast("string")

        def reply(action: str, cents: str) -> Column:
            return F.concat(
                F.lit('{"case_summary":"s'), n, F.lit('","suggested_response":"r'), n, F.lit(f'","suggested_action":"{action}",'),
                F.lit(f'"suggested_amount_cents":{cents},"reasoning":"w'), n, F.lit('"}'),
            )

        raw = (
            F.when(kind == 0, reply("refund", "1250"))
            .when(kind == 1, F.concat(F.lit("```json\n"), reply("credit", "300"), F.lit("\n```")))
            .when(kind == 2, F.concat(F.lit("```\n"), reply("escalate", "0"), F.lit("\n```  ")))
            .when(kind == 3, reply("give_up", "5"))
            .when(kind == 4, F.lit("{}"))
            .when(kind == 5, reply("refund", '"12"'))
            .when(kind == 6, reply("refund", '"abc"'))
            .when(kind == 7, F.substring(reply("credit", "1"), 1, 40))
            .when(kind == 8, F.concat(F.lit("["), reply("credit", "1"), F.lit("]")))
            .when(kind == 9, F.concat(reply("credit", "1"), F.lit(" done")))
            .when(kind == 10, reply("resolve", "99.9"))
            .otherwise(reply("no_action", "null"))
        )
        messages = self.support_messages().where(F.col("admin_id").isNull())
        return messages.select(
            key.alias("message_id"),
            "case_id",
            "user_id",
            raw.alias("raw_reply"),
            F.lit(None).cast("string").alias("responder_error"),
            F.lit("sample").alias("model"),
        )

    # --- histories ---------------------------------------------------------------------------

    def event_history(self) -> DataFrame:
        """events as a change history: key user_id, ordered by event_id, 'error' deletes."""
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("user_id").alias("id"),
            "value",
            "props",
            F.when(kind == "error", "delete").when(kind == "signup", "insert").otherwise("update").alias("_change_type"),
            F.col("event_id").alias("_lsn"),
            (F.col("event_id") % 7).alias("_xid"),
            F.col("ts").alias("_timestamp"),
        )

    def order_history(self) -> DataFrame:
        """events as status changes of orders."""
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("user_id").alias("id"),
            F.col("event_id").alias("_lsn"),
            F.when(kind == "signup", "pending")
            .when(kind == "view", "preparing")
            .when(kind == "click", "ready")
            .when((kind == "purchase") & (F.col("value") < 10), "delivered")
            .when(kind == "purchase", "out_for_delivery")
            .otherwise("cancelled")
            .alias("status"),
        )

    def _line_id(self) -> Column:
        parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
        return F.concat_ws("-", *parts, F.date_format("l_shipdate", "yyyyMMdd"))

    def current_rows(self, name: str) -> tuple[DataFrame, str, Column]:
        """Rows of one table, the column an update changes, and a number per row."""
        lines = self.raw("lineitem").withColumn("id", self._line_id())
        line_number = F.col("l_orderkey") + F.col("l_partkey")
        simple = {
            "users": ("name", self.users),
            "orders": ("status", self.orders),
            "menu_items": ("name", self.menu_items),
            "support_cases": ("status", self.support_cases),
            "support_messages": ("content", self.support_messages),
            "admins": ("name", self.admins),
        }
        if name in simple:
            column, build = simple[name]
            return build(), column, F.col("id")
        cents = _cents(F.col("l_extendedprice")).alias("amount_in_cents")
        if name == "order_items":
            kept = ["id", "l_orderkey", "l_partkey", "l_returnflag"]
            return lines.select(*kept, cents), "l_returnflag", line_number
        flag = "R" if name == "refunds" else "A"
        kept = ["id", "l_orderkey", "l_partkey", "l_linestatus"]
        return lines.where(F.col("l_returnflag") == flag).select(*kept, cents), "l_linestatus", line_number

    def table_history(self, name: str) -> DataFrame:
        """A change history whose current state is known: per row an insert, a late older update
        (must lose), sometimes a newer update, sometimes a delete, and an exact duplicate."""
        rows, column, k = self.current_rows(name)
        k7, k6, k5, k3 = (F.col("_k") % n == 0 for n in (7, 6, 5, 3))

        def change(kind: str, step: int, on: Column) -> Column:
            return F.struct(F.lit(kind).alias("_change_type"), F.lit(step).alias("step"), on.alias("on"))

        changes = F.array(
            change("insert", 1, F.lit(True)),
            change("update", 0, k5),
            change("update", 2, k3),
            change("update", 2, k6),
            change("delete", 3, k7),
        )
        text = F.col(column)
        changed = F.when(F.col("step") == 0, "late").when(F.col("step") == 2, F.concat(text, F.lit(" (changed)"))).otherwise(text)
        exploded = rows.withColumn("_k", k).select("*", F.inline(changes)).where("on")
        return exploded.withColumns(
            {
                column: changed,
                "_lsn": F.col("_k") * 10 + F.col("step"),
                "_xid": F.col("_k"),
                "_timestamp": F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("step")),
            }
        ).drop("_k", "step", "on")


PROMO_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "us_east", "us_central", "us_west", "eu_west")
NAMES = (
    "users",
    "orders",
    "order_items",
    "menu_items",
    "refunds",
    "credits",
    "support_cases",
    "support_messages",
    "drafts",
    "admins",
    "drivers",
    "deliveries",
    "carts",
    "cart_items",
    "cart_adds",
    "promotions",
    "entered_codes",
    "runs",
    "configs",
    "decisions",
    "replies",
    "event_history",
    "order_history",
)
HISTORIES = ("users", "orders", "order_items", "menu_items", "support_cases", "support_messages", "refunds", "credits", "admins")


def sample_tables(spark: SparkSession, folder: str) -> Tables:
    build = _Build(spark, folder)
    sources = {name: getattr(build, name) for name in NAMES}
    sources |= {f"{name}_history": (lambda name=name: build.table_history(name)) for name in HISTORIES}
    return Tables(spark, sources)
