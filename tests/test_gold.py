"""Gold aggregates on hand-made rows."""

import datetime as dt

from opsloom.plans import console, gold
from tests.helpers import at, case, key, message, one, order, rows, tables, user

AS_OF = "2024-06-01"


def items(*triples):
    return [{"id": key(i), "order_id": key(o), "menu_item_id": key(m), "quantity": q, "price_in_cents": p} for i, (o, m, q, p) in enumerate(triples)]


def menu(n, category):
    return {"id": key(n), "name": f"dish {n}", "category": category}


def refund(n, cents, order_id=None, case_id=None, status="approved", when="2024-01-09 00:00:00", user_id="u1"):
    return {
        "id": key(n),
        "user_id": user_id,
        "order_id": key(order_id) if order_id else None,
        "support_case_id": key(case_id) if case_id else None,
        "amount_in_cents": cents,
        "status": status,
        "created_at": at(when),
    }


def test_daily_revenue(spark):
    t = tables(
        spark,
        orders=[
            order(1, "u1", 1000, "2024-01-01 10:00:00"),
            order(2, "u1", 501, "2024-01-01 23:59:59", "cancelled"),
            order(3, "u2", 700, "2024-01-02 00:00:00"),
        ],
        # equal revenue of a and b on the first day; the third item is not on the menu
        order_items=items((1, 11, 2, 100), (1, 12, 1, 200), (2, 99, 5, 1)),
        menu_items=[menu(11, "b"), menu(12, "a")],
        refunds=[refund(1, 100, order_id=1), refund(2, 50, order_id=1, status="pending"), refund(3, 9, order_id=None)],
        credits=[
            {"id": key(1), "user_id": "u1", "amount_in_cents": 30, "created_at": at("2024-01-02 12:00:00")},
            {"id": key(2), "user_id": "u1", "amount_in_cents": 30, "created_at": at("2024-01-05 12:00:00")},
        ],
    )
    by_day = {r["order_date"].day: r for r in rows(gold.daily_revenue(t))}
    assert set(by_day) == {1, 2}
    assert by_day[1] == {
        "order_date": dt.date(2024, 1, 1),
        "total_orders": 2,
        "gross_revenue_cents": 1501,
        "total_refunds_cents": 100,
        "total_credits_cents": 0,
        "net_revenue_cents": 1401,
        "avg_order_value_cents": 750,
        "items_sold": 8,
        "top_category": "a",
    }
    second = by_day[2]
    assert (second["items_sold"], second["top_category"], second["total_credits_cents"]) == (0, None, 30)
    pending = rows(gold.daily_revenue(t, refund_statuses=("pending",)))
    assert {r["order_date"].day: r["total_refunds_cents"] for r in pending} == {1: 50, 2: 0}


def support(spark):
    return tables(
        spark,
        users=[user(1), user(2, None), user(3)],
        orders=[order(1, "u1", 1000, "2024-01-01 10:00:00"), order(2, "u1", 500, "2024-05-20 10:00:00")],
        support_cases=[
            case(1, "u1", "2024-05-01 10:00:00", "open"),
            case(2, "u1", "2024-05-01 12:00:00", "resolved"),
            case(3, "u2", "2024-01-05 12:00:00", "closed"),
        ],
        support_messages=[
            message(1, 1, "2024-05-01 10:00:30"),
            message(2, 1, "2024-05-01 10:04:29", admin=7),
            message(3, 1, "2024-05-01 10:09:00", admin=7),
            message(4, 2, "2024-05-01 12:00:00"),
        ],
        refunds=[refund(1, 300, case_id=1, when="2024-05-02 00:00:00"), refund(2, 40, when="2024-05-02 00:00:00")],
        credits=[{"id": key(1), "user_id": "u1", "support_case_id": key(1), "amount_in_cents": 70, "created_at": at("2024-01-02 12:00:00")}],
    )


def test_support_overview(spark):
    by_day = {r["case_date"]: r for r in rows(gold.support_overview(support(spark)))}
    day = by_day[dt.date(2024, 5, 1)]
    # one of the two cases has no reply: it is left out of the response average
    assert (day["total_cases"], day["open_cases"], day["resolved_cases"]) == (2, 1, 1)
    assert (day["avg_messages_per_case"], day["avg_first_response_minutes"]) == (2.0, 4.0)
    assert (day["cases_with_refund"], day["cases_with_credit"], day["total_refund_cents"], day["total_credit_cents"]) == (1, 1, 300, 70)
    quiet = by_day[dt.date(2024, 1, 5)]
    assert (quiet["avg_messages_per_case"], quiet["avg_first_response_minutes"], quiet["total_refund_cents"]) == (0.0, 0.0, 0)


def test_user_support_profile(spark):
    by_user = {r["user_id"]: r for r in rows(gold.user_support_profile(support(spark), AS_OF))}
    u1 = by_user["u1"]
    assert (u1["total_orders_90d"], u1["total_spend_90d_cents"], u1["lifetime_order_count"], u1["lifetime_spend_cents"]) == (1, 500, 2, 1500)
    assert (u1["support_cases_90d"], u1["support_cases_lifetime"], u1["total_refunds_90d_cents"], u1["total_credits_90d_cents"]) == (2, 2, 340, 0)
    assert u1["last_support_case_date"] == at("2024-05-01 12:00:00")
    u2, u3 = by_user["u2"], by_user["u3"]
    assert (u2["region"], u2["support_cases_90d"], u2["support_cases_lifetime"]) == (None, 0, 1)
    assert (u3["lifetime_order_count"], u3["last_order_date"], u3["total_refunds_90d_cents"]) == (0, None, 0)


def test_calendar_and_instant_windows_differ(spark):
    t = tables(spark, users=[user(1)], orders=[order(1, "u1", 100, "2024-03-03 08:00:00")])
    assert one(gold.user_support_profile(t, "2024-06-01"))["total_orders_90d"] == 1
    assert one(console.user_profile_now(t, "2024-06-01 12:00:00"))["total_orders_90d"] == 0


def test_support_case_context(spark):
    by_case = {bytes(r["case_id"]): r for r in rows(gold.support_case_context(support(spark), AS_OF))}
    first = by_case[key(1)]
    assert (first["message_count"], first["has_admin_reply"], first["first_response_minutes"]) == (3, True, 4)
    assert (first["linked_refund_cents"], first["linked_credit_cents"]) == (300, 70)
    assert (first["user_lifetime_spend_cents"], first["user_cases_90d"]) == (1500, 2)


def test_two_definitions_of_first_response(spark):
    """Gold counts from case creation in whole minutes, the console from the first message, rounded."""
    t = support(spark)
    gold_minutes = {bytes(r["case_id"]): r["first_response_minutes"] for r in rows(gold.support_case_context(t, AS_OF))}
    queue_minutes = {bytes(r["case_id"]): r["first_response_minutes"] for r in rows(console.case_queue(t))}
    # 10:00:00 -> 10:04:29 is 4 whole minutes; 10:00:30 -> 10:04:29 is 3.98 minutes
    assert (gold_minutes[key(1)], queue_minutes[key(1)]) == (4, 4)
    assert (gold_minutes[key(2)], queue_minutes[key(2)]) == (None, None)
    early = tables(
        spark,
        users=[user(1)],
        support_cases=[case(1, "u1", "2024-05-01 10:01:30")],
        support_messages=[message(1, 1, "2024-05-01 10:02:30"), message(2, 1, "2024-05-01 10:00:00", admin=7)],
    )
    # the reply precedes the case: minus one whole minute in gold, zero in the console
    assert one(gold.support_case_context(early, AS_OF))["first_response_minutes"] == -1
    assert one(console.case_queue(early))["first_response_minutes"] == 0
