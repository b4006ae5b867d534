from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from opsloom.llm.pii_boosting import KINDS, Fit, cells, find, fit, redact
from opsloom.llm.spans import joined
from tests.llm.helpers import edges, empty, prose, table


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(v // 10 + v % 10 for v in values) % 10 == 0


RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
)


def base(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TRICKY = [
    "x@y.z a@b.c@d.e a@b.com_x@y.z .@-.- a@b @c.d é.x@y.org",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8.9 0000255.1.1.1 1.2.3 1.2.3.4.5",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 4  111 \U0001f600 5500005555555559",
    "+1 (555) 010-9999 +1 2 +123456789012345 +1234567890123456 ++49 30 1234567. +1(",
    "+1 (269) 555-3296 4524132264652876 and",
]


def test_base_spans_are_those_of_the_rules(spark):
    texts = TRICKY + [prose(i, 50) + " " + t for i, t in enumerate(TRICKY)]
    rows = find(table(spark, texts)).select("doc_id", joined(F.col("base_spans")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in rows} == {i: base(t) for i, t in enumerate(texts)}


def test_trees_add_what_a_base_pattern_ran_past(spark):
    good, bad = "4524132264652876", "4524132264652875"
    assert luhn(good) and not luhn(bad)
    texts = [f"{prose(i, 20)} card {good} {prose(i + 500, 5)} call +1 (269) 555-3{i:03} end mail me{i}@x{i}.org" for i in range(60)]
    texts += [f"{prose(i, 20)} number {bad} and 12{i} and version 2.0.{i} end" for i in range(60)]
    texts.append(f"{prose(7, 20)} call +1 (269) 555-3296 {good} {prose(8, 20)}")
    rows = {r["doc_id"]: r for r in find(table(spark, texts)).collect()}
    last = texts[-1]
    assert not rows[120]["base_spans"]
    assert (last.index(good), last.index(good) + 16) in {(s["start"], s["stop"]) for s in rows[120]["spans"]}
    for i in range(60, 120):  # nothing is added to documents without personal data
        assert rows[i]["spans"] == []
    for r in rows.values():
        assert set(r["base_spans"]) <= set(r["spans"])


def test_all_labelled_candidates_count(spark):
    """More candidates of a label than any sample of some thousand, and every one in the counts that trees and thresholds are made from."""
    hits = F.when(F.col("id") % 2 == 0, F.format_string("4111 1111 1111 %04d", F.col("id") % 10000)).otherwise(F.format_string("+1 (269) 555-%04d", F.col("id") % 10000))
    kind = F.when(F.col("id") % 2 == 0, 2).otherwise(3)
    rows = spark.range(18000).select(
        F.col("id").alias("doc_key"), F.lit(0).cast("bigint").alias("start"), F.lit(19).cast("bigint").alias("stop"), kind.alias("order"),
        F.when(kind == 2, "card").otherwise("phone").alias("kind"), hits.alias("hit"), F.lit("call ").alias("before"), F.lit(" end").alias("after"),
        F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, 0.0).alias("label"),
    )
    counted = cells(rows)
    assert {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.sum("weight").alias("n")).collect()} == {0.0: 6000.0, 1.0: 6000.0}
    model, limits = fit(rows.withColumn("label", (F.col("order") - 2).cast("double")), Fit())
    assert limits["phone"] <= 1 and limits["card"] == 2.0 and model.getNumTrees == Fit().rounds
    assert fit(rows.withColumn("label", F.lit(1.0)), Fit()) is None


def test_edges(spark):
    docs = edges(spark).withColumnRenamed("lang", "spans")
    rows = find(docs).select("doc_id", joined(F.col("base_spans")).alias("s")).collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, base(r["text"])) for r in docs.collect() if len(r["text"] or "") < 50_000 or r["doc_id"] == 7)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["s"]) for r in rows)
    assert len(got) == docs.count() and set(want) <= set(got)
    assert find(empty(spark)).count() == 0


def test_redaction(spark):
    docs = table(spark, ["mail a@b.org or 1.2.3.4 now", "none"])
    rows = find(docs).join(docs, "doc_id").select("doc_id", redact(F.col("text"), F.col("spans")).alias("out")).collect()
    assert {r["doc_id"]: r["out"] for r in rows} == {0: "mail [email] or [ip] now", 1: "none"}


def test_no_spans_digest_is_of_the_empty_string(spark):
    out = spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    assert out == hashlib.sha256(b"").hexdigest() and KINDS == ("email", "ip", "card", "phone")
