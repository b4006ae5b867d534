"""Carts, promotions, upkeep, demand, audits and runs on hand-made rows."""

from opsloom.plans import commerce
from opsloom.plans.commerce import transition_verdict
from pyspark.sql import functions as F
from tests.helpers import at, case, key, one, order, rows, tables, user

NOW = "2024-05-10 12:00:00"


def menu(n, cents, available=True):
    return {"id": key(n), "name": f"dish {n}", "category": "c", "price_in_cents": cents, "available": available}


def cart(n, user_id="u1", updated="2024-05-10 11:00:00"):
    return {"id": key(n), "user_id": user_id, "updated_at": at(updated)}


def cart_item(n, cart_id, item, quantity):
    return {"id": key(n), "cart_id": key(cart_id), "menu_item_id": key(item), "quantity": quantity}


def shop(spark):
    return tables(
        spark,
        menu_items=[menu(1, 250), menu(2, 1000, False)],
        carts=[cart(1), cart(2, "u2"), cart(3, "u3", "2024-05-10 09:59:59"), cart(4, "u4", "2024-05-10 10:00:00")],
        cart_items=[cart_item(1, 1, 1, 2), cart_item(2, 1, 2, 1), cart_item(3, 2, 77, 5), cart_item(4, 3, 1, 1)],
    )


def number(b):
    return int.from_bytes(b, "big")


def test_checkout(spark):
    t = shop(spark)
    assert {number(r["cart_id"]): r["total_in_cents"] for r in rows(commerce.cart_pricing(t))} == {1: 1500, 3: 250}
    out = commerce.checkout(t, F.lit(NOW).cast("timestamp_ntz"))
    assert {number(r["id"]): (r["status"], r["total_in_cents"]) for r in rows(out["orders"])} == {1: ("pending", 1500), 3: ("pending", 250)}
    assert len(rows(out["order_items"])) == 3
    assert {number(r["id"]) for r in rows(out["carts"])} == {2, 4}
    assert {number(r["cart_id"]) for r in rows(out["cart_items"])} == {2}


def test_cart_lines_merge(spark):
    adds = spark.createDataFrame([(1, 1, 2), (1, 1, None), (1, 1, 0), (1, 2, -4), (2, 1, 3)], "cart_id int, menu_item_id int, quantity int")
    assert {(r.cart_id, r.menu_item_id): r.quantity for r in commerce.cart_line_merge(adds).collect()} == {(1, 1): 4, (1, 2): 1, (2, 1): 3}


def test_upkeep(spark):
    t = shop(spark).with_tables(
        support_cases=tables(
            spark,
            support_cases=[
                {**case(1, "u1", "2024-05-01 00:00:00", "resolved"), "updated_at": at("2024-05-09 11:59:59")},
                {**case(2, "u1", "2024-05-01 00:00:00", "resolved"), "updated_at": at("2024-05-09 12:00:00")},
                {**case(3, "u1", "2024-05-01 00:00:00", "open"), "updated_at": at("2024-05-01 12:00:00")},
            ],
        )["support_cases"]
    )
    assert {number(r["id"]) for r in rows(commerce.stale_carts(t, NOW))} == {3}
    left = commerce.drop_stale_carts(t, NOW)
    assert {number(r["id"]) for r in rows(left["carts"])} == {1, 2, 4}
    assert {number(r["cart_id"]) for r in rows(left["cart_items"])} == {1, 2}
    closed = {number(r["id"]): (r["status"], r["updated_at"]) for r in rows(commerce.auto_close(t, NOW))}
    assert closed[1] == ("closed", at(NOW))
    assert (closed[2][0], closed[3][0]) == ("resolved", "open")


def promo(n, code, region=None, cap=None, used=0, starts="2024-05-01 00:00:00", ends="2024-06-01 00:00:00", traffic=100):
    return {
        "id": key(n), "code": code, "name": code, "discount_strategy": "{}", "region": region, "max_redemptions": cap,
        "current_redemptions": used, "starts_at": at(starts), "ends_at": at(ends), "traffic_multiplier": traffic,
    }


def offers(spark):
    return tables(
        spark,
        users=[user(1, "us_east"), user(2, "eu_west"), user(3, None)],
        carts=[cart(1, "u1"), cart(2, "u1"), cart(3, "u2")],
        promotions=[
            promo(1, "ALL"),
            promo(2, "EAST", "us_east", traffic=150),
            promo(3, "EAST2", "us_east", cap=5, used=5, traffic=120),
            promo(4, "FULL", cap=5, used=6, traffic=50),
            promo(5, "OLD", ends="2024-05-10 11:59:59", traffic=900),
            promo(6, "LAST", ends=NOW),
            promo(7, "SOON", "eu_west", starts="2024-05-10 12:00:01"),
        ],
    )


def test_promos(spark):
    t = offers(spark)
    assert {r["user_id"]: r["promo_codes"] for r in rows(commerce.promos_for_users(t, NOW))} == {
        "u1": "ALL,EAST,EAST2,LAST", "u2": "ALL,LAST", "u3": "ALL,LAST",
    }
    listed = rows(commerce.promotions_of_users(t, NOW))
    assert sorted((r["user_id"], r["code"]) for r in listed) == [
        ("u1", "ALL"), ("u1", "EAST"), ("u1", "EAST2"), ("u1", "LAST"), ("u2", "ALL"), ("u2", "LAST"), ("u3", "ALL"), ("u3", "LAST"),
    ]
    assert all(set(r) == {"user_id", *commerce.PROMOTION_COLUMNS} for r in listed)
    strict = {r["user_id"]: r["promo_codes"] for r in rows(commerce.promos_for_users(t, NOW, strict_cap=True))}
    assert strict["u1"] == "ALL,EAST,LAST"
    entered = spark.createDataFrame([("u1", "east"), ("u2", "East"), ("u2", "full"), ("u1", "none"), ("u3", "all")], "user_id string, code string")
    assert {(r["user_id"], r["code"]): (r["valid"], r["problem"], r["promotion_name"]) for r in rows(commerce.promo_check(t, entered, NOW))} == {
        ("u1", "east"): (True, None, "EAST"),
        ("u2", "East"): (True, None, "EAST"),
        ("u2", "full"): (False, "invalid or expired", None),
        ("u1", "none"): (False, "invalid or expired", None),
        ("u3", "all"): (False, "no active cart", None),
    }
    assert {r["region"]: r["multiplier"] for r in rows(commerce.promo_region_multipliers(t, NOW))} == {"global": 1.0, "us_east": 1.5}


def test_no_open_promotions(spark):
    t = offers(spark)
    got = rows(commerce.promos_for_users(t, "2020-01-01 00:00:00"))
    assert [(r["promo_count"], r["promo_codes"]) for r in got] == [(0, "")] * 3


def test_orders_by_local_time(spark):
    t = tables(
        spark,
        users=[user(1) | {"time_zone": "Europe/London"}, user(2) | {"time_zone": "America/Los_Angeles"}, user(3) | {"time_zone": None}],
        # Sunday 03:30 UTC: 04:30 in London's summer time, Saturday 20:30 in the west
        orders=[order(i, f"u{1 + i % 3}", 1, "2024-05-12 03:30:00") for i in range(7)] + [order(9, "gone", 1, "2024-05-12 03:30:00")],
    )
    got = {(r["local_hour"], r["local_weekday"]): r["orders"] for r in rows(commerce.orders_by_local_time(t))}
    assert got == {(4, "Sun"): 3, (20, "Sat"): 2, (3, "Sun"): 3}
    assert [r["user_id"] for r in rows(commerce.users_by_email_end(t, "1@example.org"))] == ["u1"]


def test_transitions(spark):
    pairs = [(None, "ready"), ("pending", "preparing"), ("pending", "cancelled"), ("ready", "cancelled"), ("pending", "delivered"),
             ("ready", "ready"), ("delivered", "pending"), ("ready", "out_for_delivery"), ("pending", "out_for_delivery")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", transition_verdict(F.col("a"), F.col("b")).alias("v"))
    assert [r.v for r in df.collect()] == ["start", "ok", "ok", "violation", "warning", "unchanged", "violation", "ok", "warning"]
    history = spark.createDataFrame([(1, 2, "preparing"), (1, 1, "pending"), (1, 9, "cancelled"), (2, 5, "pending")], "id int, _lsn int, status string")
    for parts in (None, 3):
        audit = commerce.order_transition_audit(history, parts=parts)
        assert {(r.id, r._lsn): (r.previous_status, r.verdict) for r in audit.collect()} == {
            (1, 1): (None, "start"), (1, 2): ("pending", "ok"), (1, 9): ("preparing", "violation"), (2, 5): (None, "start"),
        }


def test_runs_and_configs(spark):
    runs = [{"id": key(i), "status": "running" if i == 1 else "completed", "started_at": at(f"2024-05-{i:02d} 00:00:00"),
             "counters": '{"signups": %d}' % i if i % 2 else "{broken"} for i in range(1, 13)]
    configs = [{"id": key(i), "version": v, "base_rates": "{}", "diurnal_profile": "{}", "weekday_profile": "{}", "geo_profile": "{}",
                "safety_caps": "{}", "active": a} for i, (v, a) in enumerate([(1, "active"), (3, "inactive"), (2, "active")])]
    t = tables(spark, runs=runs, configs=configs)
    health = one(commerce.run_health(t))
    assert (number(health["id"]), health["runs"], health["has_running"]) == (12, 10, False)
    assert one(commerce.run_health(t, 12))["has_running"] is True
    assert {number(r["id"]): r["signups"] for r in rows(commerce.recent_runs(t, 2))} == {12: None, 11: 11}
    assert one(commerce.active_config(t))["version"] == 2
    assert rows(commerce.active_config(tables(spark, configs=configs[1:2]))) == []


def test_available_menu_and_orders(spark):
    t = shop(spark).with_tables(orders=tables(spark, orders=[order(i, "u1", i, f"2024-05-{i:02d} 00:00:00") for i in range(1, 8)])["orders"])
    assert [number(r["id"]) for r in rows(commerce.available_menu(t))] == [1]
    assert [number(r["order_id"]) for r in rows(commerce.user_orders(t))] == [7, 6, 5, 4, 3, 2, 1]
    assert {number(r["order_id"]): r["order_rank"] for r in rows(commerce.user_orders(t, 2))} == {7: 1, 6: 2}
