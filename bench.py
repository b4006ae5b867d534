"""Time the headline queries once each, after a warm-up, and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks.queries import QUERIES
from opsloom.session import local_session

HEADLINE = (
    "daily_revenue",
    "support_overview",
    "user_support_profile",
    "support_case_context",
    "cdc_current_state",
    "cdc_current_state_stream",
    "cdc_scd2",
    "cdc_diff",
    "silver_orders",
    "silver_order_items",
    "unanswered_messages",
    "case_prompts",
    "agent_responses",
    "agent_publish_insert_only",
    "policy_suggestions",
    "case_queue",
    "case_detail",
    "draft_history",
    "user_profile_now",
    "decisions_applied",
    "queue_search",
    "response_time",
    "case_activity",
    "order_detail",
    "user_orders_top5",
    "cart_pricing",
    "cart_line_merge",
    "delivery_board",
    "promos_for_users",
    "promo_check",
    "stale_cart_items_kept",
    "orders_by_local_time",
    "order_transition_audit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cores, shuffle_partitions=cores)
    QUERIES["daily_revenue"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall clock of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
