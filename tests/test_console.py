"""Queue, threads, decisions, search and response times on hand-made rows."""

import base64
import random
import re
import uuid

from opsloom import schemas
from opsloom.operators.rows import split_valid
from opsloom.plans import console
from opsloom.session import stored
from tests.helpers import at, case, frame, key, message, one, order, rows, tables, user
from tests.test_agent import draft


def ids(df, column):
    return [int.from_bytes(r[column], "big") for r in rows(df)]


def desk(spark, drafts=(), admins=(1, 2), **more):
    return tables(
        spark,
        users=[user(1), user(2)],
        support_cases=[
            case(1, "u1", "2024-05-01 10:00:00", "open", "Late delivery"),
            case(2, "u2", "2024-05-02 10:00:00", "resolved", "Missing items"),
            case(3, "u1", "2024-05-03 10:00:00", "in_progress", "Cold food"),
        ],
        support_messages=[
            message(1, 1, "2024-05-01 10:00:00"),
            message(2, 1, "2024-05-01 10:02:30", admin=9),
            message(3, 2, "2024-05-02 10:00:00"),
            message(4, 2, "2024-05-02 10:00:20", admin=9),
            message(5, 2, "2024-05-02 11:00:00"),
        ],
        admins=[{"id": key(n), "name": "a", "email": "e"} for n in admins],
        drafts=list(drafts),
        **more,
    )


def test_case_queue(spark):
    t = desk(spark, [draft(1, 1, "2024-05-01 11:00:00", "credit", 10), draft(2, 1, "2024-05-01 12:00:00", "refund", 20)])
    queue = rows(console.case_queue(t))
    assert [int.from_bytes(r["case_id"], "big") for r in queue] == [3, 2, 1]
    by_case = {int.from_bytes(r["case_id"], "big"): r for r in queue}
    assert (by_case[1]["suggested_action"], by_case[1]["suggested_amount_cents"]) == ("refund", 20)
    # 2.5 minutes round up to 3
    assert (by_case[1]["message_count"], by_case[1]["first_response_minutes"]) == (2, 3)
    assert (by_case[3]["message_count"], by_case[3]["has_admin_reply"], by_case[3]["first_response_minutes"]) == (0, False, None)
    assert by_case[3]["suggested_action"] is None


def test_thread_and_draft_history(spark):
    t = desk(spark, [draft(1, 1, "2024-05-01 11:00:00"), draft(2, 1, "2024-05-01 12:00:00"), draft(3, 2)])
    thread = rows(console.message_thread(t))
    assert [r["role"] for r in thread] == ["customer", "admin", "customer", "admin", "customer"]
    history = rows(console.draft_history(t))
    assert [(r["message_id"][-1], r["is_latest"]) for r in history] == [("2", True), ("1", False), ("3", True)]


def test_search(spark):
    t = desk(spark)
    queue = console.case_queue(t)
    raw = key(2)
    text = str(uuid.UUID(bytes=raw))
    for query in (text, text.upper(), raw.hex(), base64.b64encode(raw).decode(), " MISSING ", "user 2", "U2@EX"):
        assert ids(console.queue_search(queue, query), "case_id") == [2], query
    assert len(ids(console.queue_search(queue, "u1"), "case_id")) == 2
    assert ids(console.queue_search(queue, "nothing like it"), "case_id") == []
    assert len(rows(console.queue_search(queue, "  "))) == 3
    assert {r["section"]: r["cases"] for r in rows(console.queue_sections(queue))} == {"needs_attention": 2, "resolved": 1}
    aged = {int.from_bytes(r["case_id"], "big"): r["age"] for r in rows(console.queue_search(queue, "", "2024-05-03 10:45:00"))}
    assert aged == {1: "2d ago", 2: "1d ago", 3: "45m ago"}


WORDS = ("late", "Cold food", "missing", "ÉTÉ", "x", "a b", "refund 50%", "o'neil", "_", "latté")


def test_indexed_search_finds_what_the_search_finds(spark, tmp_path):
    rng = random.Random(6)
    people = [{**user(n), "name": rng.choice(WORDS) + str(n)} for n in range(12)]
    cases = [case(n, f"u{rng.randrange(12)}", "2024-05-01 10:00:00", subject=" ".join(rng.choices(WORDS, k=3))) for n in range(1, 80)]
    queue = stored(console.case_queue(tables(spark, users=people, support_cases=cases), ordered=False), "queue")
    path = str(tmp_path)
    console.write_queue_index(queue, path)
    for query in ("LATE c", "été", "x", " 50%", "o'neil late", key(7).hex(), "nothing"):
        want = rows(console.queue_search(queue, query, "2024-05-03 10:45:00"))
        got = rows(console.search_index(spark, path, query, "2024-05-03 10:45:00"))
        assert sorted(got, key=repr) == sorted(want, key=repr), query
    plan = console.search_index(spark, path, key(7).hex())._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[block#\d+ (=|IN)", plan) or "PartitionFilters: [isnotnull(block" in plan


def test_batches_of_decisions_never_share_an_id(spark, tmp_path):
    ids = str(tmp_path / "ids")
    batch = [decision(n, "credit", 5, f"2024-05-05 1{n}:00:00") for n in (1, 2, 3)]
    first, second = apply(spark, batch, ids), apply(spark, batch[:2], ids)  # both from the same state
    found = sorted(r["id"] for out in (first, second) for r in rows(out["decisions"]))
    assert found == [1, 2, 3, 4, 5]
    again = apply(spark, [], ids)
    assert rows(again["decisions"]) == []


def decision(n, action, cents, when, text="done"):
    return {"id": 0, "case_id": key(n), "admin_action": action, "admin_amount_cents": cents, "admin_response": text, "created_at": at(when)}


def apply(spark, decisions, ids=None, **kw):
    t = desk(spark, orders=[order(1, "u1", 1000, "2024-04-01 00:00:00"), order(2, "u1", 400, "2024-04-02 00:00:00")], **kw)
    return console.decisions_applied(t, frame(spark, schemas.ADMIN_DECISIONS, decisions).drop("id"), ids)


def test_decisions(spark, tmp_path):
    out = apply(
        spark,
        [
            decision(1, "refund", 900, "2024-05-05 10:00:00"),
            decision(1, "no_action", 0, "2024-05-05 11:00:00"),
            decision(2, "refund", 50, "2024-05-05 12:00:00"),
            decision(3, "credit", 70, "2024-05-05 13:00:00"),
            decision(3, "resolve", 0, "2024-05-05 14:00:00"),
            decision(3, "credit", 0, "2024-05-05 15:00:00"),
            decision(3, "explode", 1, "2024-05-05 16:00:00"),
            decision(3, "credit", -1, "2024-05-05 17:00:00"),
            decision(3, "credit", 1, "2024-05-05 18:00:00", text=""),
            decision(99, "credit", 1, "2024-05-05 19:00:00"),
        ],
        str(tmp_path),
    )
    assert [(r["id"], r["admin_action"]) for r in sorted(rows(out["decisions"]), key=lambda r: r["id"])] == [
        (1, "refund"), (2, "no_action"), (3, "refund"), (4, "credit"), (5, "resolve"), (6, "credit"),
    ]
    assert {int.from_bytes(r["case_id"], "big"): r["status"] for r in rows(out["cases"])} == {1: "in_progress", 2: "resolved", 3: "resolved"}
    # cut to the newest order; the other customer has no order
    refund = one(out["refunds"])
    assert (refund["amount_in_cents"], refund["order_id"], refund["status"]) == (400, key(2), "pending")
    assert one(out["credits"])["amount_in_cents"] == 70
    messages = rows(out["messages"])
    assert len(messages) == 6 and all(r["admin_id"] == key(1) for r in messages)
    assert sorted(r["reject_reason"] for r in rows(out["rejected"])) == ["admin_action", "admin_amount_cents", "admin_response", "unknown case"]
    again = apply(spark, [decision(1, "escalate", 0, "2024-05-06 10:00:00")], str(tmp_path))
    assert one(again["decisions"])["id"] == 7
    newest_first = rows(console.decision_history(out["decisions"]))
    assert [r["id"] for r in newest_first] == [2, 1, 3, 6, 5, 4]


def test_decisions_without_admins_write_no_message_and_move_no_case(spark):
    out = apply(spark, [decision(1, "credit", 5, "2024-05-05 10:00:00")], admins=())
    assert (rows(out["messages"]), rows(out["cases"])) == ([], [])
    assert one(out["credits"])["amount_in_cents"] == 5


def test_status_domain(spark):
    df = spark.createDataFrame([("open",), ("gone",), (None,)], "status string")
    valid, rejected = split_valid(df, console.status_checks())
    assert (valid.count(), rejected.count()) == (1, 2)


def test_response_times(spark):
    t = tables(
        spark,
        support_messages=[
            message(1, 1, "2024-05-01 10:00:00"),
            message(2, 1, "2024-05-01 10:00:30", admin=9),
            message(3, 1, "2024-05-01 10:10:00", admin=9),
            message(4, 2, "2024-05-01 10:00:00", admin=9),
            message(5, 2, "2024-05-01 10:00:00"),
            message(6, 3, "2024-05-01 10:00:00"),
            message(7, 3, "2024-05-01 11:01:00", admin=9),
            message(8, 4, "2024-05-01 11:01:00", admin=9),
        ],
    )
    got = {int.from_bytes(r["case_id"], "big"): r for r in rows(console.response_times(t, "2024-05-01 12:05:09"))}
    assert set(got) == {1, 2, 3}
    assert (got[1]["response_seconds"], got[1]["response_text"], got[1]["is_waiting"], got[1]["waiting_text"]) == (30, "30 seconds", False, None)
    # an answer at the very same time does not count as a reply
    assert (got[2]["is_waiting"], got[2]["waiting_seconds"], got[2]["waiting_text"]) == (True, 7509, "2h 5m")
    assert got[3]["response_text"] == "1h 1m"


def test_dashboards(spark):
    t = desk(spark, [draft(1, 1, cents=10), draft(2, 1, cents=21), draft(3, 2, action="resolve", cents=0)])
    assert [(r["action"], r["count"], r["avg_amount_cents"]) for r in rows(console.agent_performance(t))] == [("credit", 2, 16.0), ("resolve", 1, 0.0)]


def test_activity(spark):
    t = desk(
        spark,
        refunds=[{"id": key(1), "user_id": "u1", "support_case_id": key(1), "amount_in_cents": 1250, "status": "failed"},
                 {"id": key(2), "user_id": "u1", "amount_in_cents": 1, "status": "pending"}],
        credits=[{"id": key(3), "user_id": "u1", "support_case_id": key(1), "amount_in_cents": 5}],
    )
    assert sorted((r["kind"], r["label"], r["status"]) for r in rows(console.case_activity(t))) == [
        ("credit", "$0.05 credit", None), ("refund", "$12.50 refund", "failed"),
    ]
