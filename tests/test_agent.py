"""Selection, prompts, replies and publication on typed tables (binary ids)."""

import datetime as dt
import json
import random

import pytest

from pyspark.sql import functions as F

from opsloom import schemas
from opsloom.functions.jsons import parse_replies
from opsloom.plans import agent, gold, jobs
from opsloom.session import stored
from tests.helpers import at, case, frame, key, message, order, rows, tables, user

AS_OF = "2024-06-01"


def now():
    return F.lit(dt.datetime(2024, 6, 1, 12)).cast("timestamp")


def draft(n, case_id, when="2024-05-01 11:00:00", action="credit", cents=100):
    return {
        "message_id": key(n),
        "case_id": key(case_id),
        "user_id": "u1",
        "case_summary": "s",
        "suggested_response": "r",
        "suggested_action": action,
        "suggested_amount_cents": cents,
        "reasoning": "w",
        "model": "m",
        "generated_at": at(when),
    }


def desk(spark, drafts=()):
    return tables(
        spark,
        users=[user(1), user(2, None)],
        orders=[order(i, "u1", 1000 + i, f"2024-05-{i:02d} 10:30:00", "delivered") for i in range(1, 8)]
        + [order(9, "u9", 77, "2024-05-01 10:30:00")],
        support_cases=[
            case(1, "u1", "2024-05-01 10:00:00", "open"),
            case(2, "u2", "2024-05-02 10:00:00", "in_progress", "Missing items"),
            case(3, "u1", "2024-05-03 10:00:00", "resolved"),
            case(4, "u1", "2024-05-04 10:00:00", "open"),
            # a customer who is not (yet) among the users, with an order
            case(5, "u9", "2024-05-05 10:00:00", "open"),
        ],
        support_messages=[
            message(11, 1, "2024-05-01 10:01:00", text="first"),
            message(12, 1, "2024-05-01 10:03:00", text="second"),
            message(13, 1, "2024-05-01 10:09:00", admin=9, text="answer"),
            message(21, 2, "2024-05-02 10:01:00", text="line one\nline two"),
            message(31, 3, "2024-05-03 10:01:00"),
            message(51, 5, "2024-05-05 10:01:00"),
        ],
        drafts=list(drafts),
    )


def selected_ids(t, **kw):
    return sorted(int.from_bytes(r["message_id"], "big") for r in rows(agent.unanswered_messages(t, **kw)))


def test_unanswered(spark):
    assert selected_ids(desk(spark)) == [12, 21, 51]
    assert selected_ids(desk(spark), strict=True) == [21, 51]
    drafted = desk(spark, [draft(12, 1)])
    # the drafted message is removed before the latest is taken
    assert selected_ids(drafted) == [11, 21, 51]
    assert selected_ids(drafted, strict=True) == [21, 51]
    assert selected_ids(desk(spark, [draft(12, 1), draft(11, 1), draft(21, 2)])) == [51]


def by_case(df, column="case_id"):
    return {int.from_bytes(r[column], "big"): r for r in rows(df)}


def texts(prompts):
    """Each message's whole prompt from its pieces."""
    pieces = sorted(rows(prompts), key=lambda r: (r["sent_at"] is not None, r["sent_at"] or 0, r["line_id"] or b""))
    out = {}
    for r in pieces:
        out.setdefault(int.from_bytes(r["case_id"], "big"), []).append(r["text"])
    return {case_id: "\n".join(parts) for case_id, parts in out.items()}


PROMPT_1 = """Subject: Late delivery
Status: open
Customer: User 1 (u1@example.org), region: us_east
Messages so far: 3
Admin has replied: True
First response time: 9 minutes
Linked refunds: $0.00
Linked credits: $0.00

Customer Profile:
  Lifetime orders: 7, spend: $70.28
  Last 90 days: 7 orders, $70.28 spent
  Support cases (90d): 3
  Refunds (90d): $0.00
  Credits (90d): $0.00

Recent Orders (newest first):
  [2024-05-07 10:30] $10.07 — delivered
  [2024-05-06 10:30] $10.06 — delivered
  [2024-05-05 10:30] $10.05 — delivered
  [2024-05-04 10:30] $10.04 — delivered
  [2024-05-03 10:30] $10.03 — delivered
  Most recent order total: $10.07

Message Thread:
  [10:01] CUSTOMER: first
  [10:03] CUSTOMER: second
  [10:09] ADMIN: answer"""

PROMPT_5 = """Subject: Late delivery
Status: open

Recent Orders (newest first):
  [2024-05-01 10:30] $0.77 — delivered
  Most recent order total: $0.77

Message Thread:
  [10:01] CUSTOMER: hello"""


def test_prompts(spark):
    t = desk(spark)
    picked = stored(agent.unanswered_messages(t), "picked")
    prompts = texts(agent.case_prompts(t, picked, AS_OF))
    assert prompts[1] == PROMPT_1 and prompts[5] == PROMPT_5
    assert prompts[2].endswith("CUSTOMER: line one\nline two")
    # stored gold tables give the same prompts
    again = agent.case_prompts(
        t, picked, AS_OF, context=gold.support_case_context(t, AS_OF), profile=gold.user_support_profile(t, AS_OF)
    )
    assert texts(again) == prompts


def test_a_case_with_most_messages_is_answered(spark):
    rng = random.Random(2)
    long = [message(100 + i, 1, f"2024-05-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", text=f"text {i} " * 5) for i in range(3000)]
    t = tables(spark, users=[user(1)], support_cases=[case(1, "u1", "2024-05-01 00:00:00"), case(2, "u1", "2024-05-01 00:00:00")],
               support_messages=[*long, message(1, 2, "2024-05-01 10:00:00")])
    prompts = agent.case_prompts(t, stored(agent.unanswered_messages(t), "p"), AS_OF)

    def read(instructions, pieces):
        stamps = [p.split("]")[0] for p in pieces if p.startswith("  [")]
        assert instructions == "be kind" and stamps == sorted(stamps)
        return agent.Reply(str(len(stamps)), "long-model") if len(stamps) > 1 else str(len(stamps))

    got = by_case(agent.respond(prompts.repartition(5), read, "m", "be kind"))
    assert {c: (r["raw_reply"], r["model"], r["responder_error"]) for c, r in got.items()} == {1: ("3000", "long-model", None), 2: ("1", "m", None)}


REPLIES = {
    '{"case_summary":"a","suggested_response":"b","suggested_action":"refund","suggested_amount_cents":5,"reasoning":"c"}': ("a", "b", "refund", 5, "c"),
    '  {"suggested_action":"resolve"}\n': ("", "", "resolve", 0, ""),
    '```json\n{"suggested_amount_cents": "12"}\n```': ("", "", "no_action", 12, ""),
    '```\n{"suggested_amount_cents": " 1_000 "}```': ("", "", "no_action", 1000, ""),
    '```{"suggested_action":"credit"}```': ("", "", "credit", 0, ""),
    '{"suggested_action":"shout","suggested_amount_cents":-7.9}': ("", "", "no_action", -7, ""),
    '{"suggested_action":null,"suggested_amount_cents":true}': ("", "", "no_action", 1, ""),
    '{"case_summary":12,"reasoning":false}': ("12", "", "no_action", 0, "False"),
    '{"suggested_amount_cents":"abc"}': "bad amount",
    '{"suggested_amount_cents":"12.5"}': "bad amount",
    '{"suggested_amount_cents":null}': "bad amount",
    '{"suggested_amount_cents":[1]}': "bad amount",
    '{"suggested_amount_cents":3000000000}': "bad amount",
    '{"suggested_action":["refund"]}': "bad action",
    '{"case_summary":"cut': "not json",
    '{"a":1} and more': "not json",
    '{"a":1},{"b":2}': "not json",
    '{"a":1}\n```': "not json",
    "": "not json",
    "[1]": "not an object",
    '"text"': "not an object",
    "null": "not an object",
}


def test_reply_rules(spark):
    df = spark.createDataFrame([(r,) for r in REPLIES], "raw string")
    for r in rows(parse_replies(df, "raw")):
        want = REPLIES[r["raw"]]
        if isinstance(want, str):
            assert r["reject_reason"] == want, r
        else:
            got = (r["case_summary"], r["suggested_response"], r["suggested_action"], r["suggested_amount_cents"], r["reasoning"])
            assert (got, r["reject_reason"]) == (want, None), r


def test_valid_replies_agree_with_the_json_module(spark):
    rng = random.Random(4)
    texts = []
    for i in range(200):
        doc = {"case_summary": rng.choice(["a", "ü\n\"q\"", "", "😀"]), "suggested_action": rng.choice([*schemas.ACTIONS, "x", ""]),
               "suggested_amount_cents": rng.choice([0, 7, 12.7, "30", -1]), "reasoning": f"w{i}"}
        texts.append(json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])))
    df = spark.createDataFrame([(x,) for x in texts], "raw string")
    for r in rows(parse_replies(df, "raw")):
        doc = json.loads(r["raw"])
        assert r["reject_reason"] is None
        assert r["case_summary"] == doc["case_summary"]
        assert r["suggested_amount_cents"] == int(doc["suggested_amount_cents"])


def test_a_failing_prompt_does_not_spoil_others(spark):
    t = desk(spark)

    def moody(instructions, pieces):
        if "Missing items" in next(pieces):
            raise ValueError("no")
        return "{}"

    got = by_case(agent.respond(agent.case_prompts(t, agent.unanswered_messages(t), AS_OF).coalesce(1), moody, "m"))
    assert (got[1]["raw_reply"], got[1]["responder_error"]) == ("{}", None)
    assert (got[2]["raw_reply"], got[2]["responder_error"]) == (None, "ValueError: no")
    parsed = agent.validated(agent.respond(agent.case_prompts(t, agent.unanswered_messages(t), AS_OF), moody, "m"), now())
    listed = rows(agent.quarantined(parsed))
    assert [(r["reject_reason"], r["responder_error"]) for r in listed] == [("responder error", "ValueError: no")]


def test_a_run_that_stops_halfway_asks_for_each_message_once(spark, tmp_path):
    """The task is killed while it asks for the last message; the job is run again."""
    cases = [case(n, "u1", "2024-05-01 00:00:00") for n in range(1, 9)]
    t = tables(spark, users=[user(1)], support_cases=cases, support_messages=[message(n, n, "2024-05-01 10:00:00") for n in range(1, 9)])
    prompts = stored(agent.case_prompts(t, stored(agent.unanswered_messages(t), "p"), AS_OF), "prompts").coalesce(1)
    calls, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")

    def responder(stop_at):
        def reply(instructions, pieces):
            with open(calls, "a+") as log:
                log.seek(0)
                if len(log.readlines()) == stop_at:
                    raise SystemExit  # not an error of the message: the worker ends
                log.write(next(pieces).split("\n")[0] + "\n")
            return agent.Reply("{}", "told")

        return reply

    with pytest.raises(Exception):
        agent.respond(prompts, responder(3), "m", ledger=ledger).collect()
    assert len(open(calls).readlines()) == 3
    got = rows(agent.respond(prompts, responder(None), "m", ledger=ledger))
    assert len(got) == 8 and {(r["raw_reply"], r["model"], r["responder_error"]) for r in got} == {("{}", "told", None)}
    assert len(open(calls).readlines()) == 8
    rows(agent.respond(prompts, responder(None), "m", ledger=ledger))
    assert len(open(calls).readlines()) == 8


def test_agent_job_is_idempotent(spark, tmp_path):
    t = jobs.refresh_gold(desk(spark), str(tmp_path / "gold"), AS_OF)

    def reply(instructions, pieces):
        return '{"case_summary":"s","suggested_action":"credit","suggested_amount_cents":50}'

    def run():
        return jobs.run_agent(t, reply, "rules", AS_OF, now(), str(tmp_path), schemas.AGENT_RESPONSE_SCHEMA)

    first = run()
    assert [f.dataType for f in first.schema] == [f.dataType for f in schemas.AGENT_RESPONSE_SCHEMA]
    assert selected_of(first) == [12, 21, 51]
    # the newest message has a draft now, so the older one of case 1 is next; then nothing is left
    assert selected_of(run()) == [11, 12, 21, 51]
    assert selected_of(run()) == [11, 12, 21, 51]
    assert spark.read.parquet(f"{tmp_path}/agent_quarantine").count() == 0


def selected_of(df):
    return sorted(int.from_bytes(r["message_id"], "big") for r in rows(df))


def policy(spark, subject="Late delivery", status="open", text="hello", cases=1, orders=(), refund=0, admin=False):
    t = tables(
        spark,
        users=[user(1)],
        orders=[order(i, "u1", c, f"2024-05-{i + 1:02d} 00:00:00") for i, c in enumerate(orders)],
        support_cases=[case(i + 1, "u1", "2024-05-01 00:00:00", status, subject) for i in range(cases)],
        support_messages=[message(1, 1, "2024-05-01 10:00:00", text=text)] + ([message(2, 1, "2024-05-01 09:00:00", admin=9)] if admin else []),
        refunds=[{"id": key(1), "user_id": "u1", "support_case_id": key(1), "amount_in_cents": refund, "status": "pending"}] if refund else [],
    )
    picked = frame(spark, PICKED, [{"message_id": key(1), "case_id": key(1), "user_id": "u1", "subject": subject, "status": status}])
    r = rows(agent.policy_suggestions(t, picked, AS_OF))[0]
    return r["suggested_action"], r["suggested_amount_cents"]


PICKED = schemas.struct("message_id:id case_id:id user_id:text subject:text status:text")


def test_policy(spark):
    assert policy(spark, orders=[999]) == ("credit", 149)
    assert policy(spark, orders=[25_000, 999]) == ("credit", 249)  # high-value customer
    assert policy(spark, cases=2, orders=[1000]) == ("credit", 300)  # repeat
    assert policy(spark, cases=3, orders=[1000]) == ("escalate", 0)
    assert policy(spark, "Wrong order received", orders=[1000]) == ("refund", 1000)
    assert policy(spark, "Overcharged", orders=[1000]) == ("no_action", 0)
    assert policy(spark, "Missing items") == ("refund", 0)
    assert policy(spark, status="resolved", refund=5, orders=[1000]) == ("no_action", 0)
    assert policy(spark, text="ok, Thank you very much", admin=True, orders=[1000]) == ("resolve", 0)
    assert policy(spark, text="I appreciate that", refund=5, orders=[1000]) == ("resolve", 0)
    assert policy(spark, text="ok, thank you", orders=[1000]) == ("credit", 150)
    assert policy(spark, text="no, still cold", admin=True, orders=[1000]) == ("credit", 150)


def test_rejected_messages_are_tried_again_and_every_failure_is_kept(spark, tmp_path):
    t = desk(spark)
    schema = schemas.AGENT_RESPONSE_SCHEMA

    def run(reply):
        return jobs.run_agent(t, lambda instructions, pieces: reply, "m", AS_OF, now(), str(tmp_path), schema)

    assert run("no json").count() == run("[1]").count() == 0
    rejected = jobs.open_quarantine(spark, str(tmp_path), schema)
    assert selected_of(rejected) == [12, 12, 21, 21, 51, 51]
    assert {r["reject_reason"] for r in rows(rejected)} == {"not json", "not an object"}
    assert selected_of(run("{}")) == [12, 21, 51]
    assert jobs.open_quarantine(spark, str(tmp_path), schema).count() == 0
