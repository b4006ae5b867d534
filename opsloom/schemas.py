"""Table schemas, value domains and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains the source applications write.
ORDER_STATUSES = ("pending", "preparing", "ready", "out_for_delivery", "delivered", "cancelled")
DELIVERY_STATUSES = ("assigned", "picked_up", "in_transit", "delivered", "failed")
DRIVER_STATUSES = ("available", "on_delivery", "offline")
CASE_STATUSES = ("open", "in_progress", "resolved", "closed")
REFUND_STATUSES = ("pending", "processed", "failed")
OPEN_CASE_STATUSES = ("open", "in_progress")
ACTIONS = ("refund", "credit", "no_action", "escalate", "resolve")

# Change metadata written next to every history row.
CHANGE_COLUMNS = ("_change_type", "_lsn", "_xid", "_timestamp")

_TYPES = {
    "id": T.BinaryType(),
    "text": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "bool": T.BooleanType(),
    "double": T.DoubleType(),
    "ntz": T.TimestampNTZType(),
    "ts": T.TimestampType(),
    "date": T.DateType(),
}


def struct(spec: str) -> T.StructType:
    """Build a StructType from 'name:type' words; a trailing '!' means not null."""
    fields = []
    for word in spec.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


USERS = struct(
    "id:text! name:text! email:text! email_verified:bool! image:text time_zone:text region:text locale:text "
    "created_at:ntz! updated_at:ntz!"
)
ORDERS = struct(
    "id:id! user_id:text! status:text! total_in_cents:int! promotion_id:id promo_snapshot:text created_at:ntz! "
    "updated_at:ntz!"
)
ORDER_ITEMS = struct("id:id! order_id:id! menu_item_id:id! quantity:int! price_in_cents:int! created_at:ntz!")
MENU_ITEMS = struct(
    "id:id! name:text! description:text price_in_cents:int! category:text! image_url:text available:bool! "
    "created_at:ntz! updated_at:ntz!"
)
SUPPORT_CASES = struct("id:id! user_id:text! subject:text! status:text! created_at:ntz! updated_at:ntz!")
SUPPORT_MESSAGES = struct("id:id! case_id:id! user_id:text admin_id:id content:text! created_at:ntz!")
REFUNDS = struct(
    "id:id! user_id:text! order_id:id support_case_id:id amount_in_cents:int! reason:text! status:text! "
    "created_at:ntz! updated_at:ntz!"
)
CREDITS = struct("id:id! user_id:text! support_case_id:id amount_in_cents:int! reason:text! created_at:ntz!")
ADMINS = struct("id:id! name:text! email:text! created_at:ntz!")
CARTS = struct("id:id! user_id:text! created_at:ntz! updated_at:ntz!")
CART_ITEMS = struct("id:id! cart_id:id! menu_item_id:id! quantity:int! created_at:ntz!")
DELIVERIES = struct(
    "id:id! order_id:id! driver_id:id! status:text! started_at:ntz delivered_at:ntz created_at:ntz! updated_at:ntz!"
)
DRIVERS = struct("id:id! name:text! phone:text! status:text! created_at:ntz! updated_at:ntz!")
PROMOTIONS = struct(
    "id:id! code:text! name:text! description:text discount_strategy:text! region:text category:text "
    "traffic_multiplier:int! max_redemptions:int current_redemptions:int! starts_at:ntz! ends_at:ntz! "
    "created_at:ntz! updated_at:ntz!"
)
PROMOTION_REDEMPTIONS = struct("id:id! promotion_id:id! user_id:text! order_id:id! redeemed_at:ntz!")
RUN_CONFIGS = struct(
    "id:id! version:int! base_rates:text! diurnal_profile:text! weekday_profile:text! geo_profile:text! "
    "safety_caps:text! active:text! created_at:ntz! updated_at:ntz!"
)
RUNS = struct(
    "id:id! config_id:id status:text! computed_multipliers:text counters:text error_summary:text started_at:ntz! "
    "finished_at:ntz"
)
ADMIN_DECISIONS = struct(
    "id:int! case_id:id! admin_action:text! admin_amount_cents:int! admin_response:text! created_at:ts!"
)
AGENT_RESPONSE_SCHEMA = struct(
    "message_id:id! case_id:id! user_id:text! case_summary:text! suggested_response:text! suggested_action:text! "
    "suggested_amount_cents:int! reasoning:text! model:text! generated_at:ts!"
)

# The nine tables kept as current state, by name.
CURRENT_STATE_TABLES = {
    "users": USERS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "menu_items": MENU_ITEMS,
    "support_cases": SUPPORT_CASES,
    "support_messages": SUPPORT_MESSAGES,
    "refunds": REFUNDS,
    "credits": CREDITS,
    "admins": ADMINS,
}


def history_schema(table: T.StructType) -> T.StructType:
    """The schema of a table's change history: its columns and the change metadata."""
    return T.StructType(list(table.fields) + list(struct("_change_type:text! _lsn:long! _xid:long _timestamp:ts").fields))


# Shapes carried as JSON text.
DISCOUNT_STRATEGY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("percent", T.DoubleType()),
        T.StructField("amountInCents", T.LongType()),
    ]
)
NUMBER_MAP = T.MapType(T.StringType(), T.DoubleType())
GEO_PROFILE = T.MapType(
    T.StringType(),
    T.StructType([T.StructField("weight", T.DoubleType()), T.StructField("timezone", T.StringType())]),
)
BASE_RATES = T.StructType(
    [
        T.StructField(name, T.DoubleType())
        for name in (
            "signupsPerTick",
            "activeUsersPerTick",
            "cartAddsPerTick",
            "checkoutsPerTick",
            "cancellationRate",
            "supportCaseRate",
        )
    ]
)
SAFETY_CAPS = T.StructType(
    [T.StructField("maxActionsPerTick", T.DoubleType()), T.StructField("maxSignupsPerDay", T.DoubleType())]
)
COMPUTED_MULTIPLIERS = T.StructType(
    [
        T.StructField("diurnal", NUMBER_MAP),
        T.StructField("weekday", T.DoubleType()),
        T.StructField("promo", NUMBER_MAP),
        T.StructField("geo", NUMBER_MAP),
    ]
)
RUN_COUNTERS = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in (
            "signups",
            "signIns",
            "cartAdds",
            "checkouts",
            "cancellations",
            "supportCases",
            "supportMessages",
            "ordersProgressed",
            "driversAssigned",
            "deliveriesProgressed",
            "adminReplies",
            "cleanups",
        )
    ]
)
REPLY_FIELDS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("case_summary", "suggested_response", "suggested_action", "suggested_amount_cents", "reasoning")
    ]
)
