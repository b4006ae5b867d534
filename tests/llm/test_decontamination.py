from __future__ import annotations

import random

from pyspark.sql import functions as F

from opsloom.llm import decontamination as d
from opsloom.llm.tables import plain_words
from tests.llm.helpers import edges, empty, prose, table

ITEM = "item_id bigint, text string"


def shingles(text):
    words = plain_words(text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def contained(docs, items, least=0.8):
    out = {}
    for i, text in docs:
        own = shingles(text)
        for k, item in items:
            wanted = shingles(item)
            shared = len(wanted & own)
            if wanted and shared >= least * len(wanted):
                out[(i, k)] = (shared, len(wanted))
    return out


def corpus():
    rng = random.Random(8)
    items = [(k, prose(5000 + k, rng.choice((8, 14, 25, 40, 70, 130)))) for k in range(40)]
    docs = []
    for i in range(120):
        words = prose(i, rng.choice((30, 300, 3000))).split(" ")
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items)[1].split(" ")
            if rng.random() < 0.4:  # an edited word
                passage[rng.randrange(len(passage))] = "edited"
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words)))
    return docs, items


def test_finds_what_brute_force_finds(spark):
    docs, items = corpus()
    out = d.with_items(table(spark, [t for _, t in docs]), spark.createDataFrame(items, ITEM))
    got = {(r["doc_id"], f["item_id"]): (f["n_shared"], f["n_shingles"]) for r in out.collect() for f in r["found"]}
    want = contained(docs, items)
    assert len(want) > 60 and got == want


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_SHINGLES", 100)
    docs, items = corpus()
    out = d.with_items(table(spark, [t for _, t in docs[:40]]), spark.createDataFrame(items, ITEM))
    got = {(r["doc_id"], f["item_id"]) for r in out.collect() for f in r["found"]}
    assert got == set(contained(docs[:40], items))


def test_edges(spark):
    docs = edges(spark).withColumn("found", F.lit("mine")).withColumnRenamed("lang", "item_id")
    items = [(1, docs.filter("doc_id = 9").first()["text"][:400]), (1, None), (None, "a b c d e f g"), (2, "too short"), (3, ""), (4, "the " * 6)]
    items.append(items[0])
    out = d.with_items(docs, spark.createDataFrame(items, ITEM))
    rows = out.collect()
    assert len(rows) == docs.count() and set(out.columns) == set(docs.columns)
    got = {(r["doc_id"], f["item_id"]) for r in rows for f in r["found"]}
    assert got == {(9, 1), (7, 4)}
    assert d.with_items(empty(spark), spark.createDataFrame(items, ITEM)).count() == 0
    assert d.with_items(docs, spark.createDataFrame([], ITEM)).filter(F.size("found") > 0).count() == 0


def test_items_of_five_to_eight_words_in_long_texts(spark):
    rng = random.Random(84)
    items = [(k, " ".join(f"item{k}word{i}" for i in range(5 + k % 4))) for k in range(200)]
    docs = []
    for i in range(50):
        words = prose(i, 2000).split(" ")
        for _, item in items[4 * i : 4 * i + 4]:
            at = rng.randrange(len(words))
            words[at:at] = item.split(" ")
        docs.append((i, " ".join(words)))
    out = d.with_items(table(spark, [t for _, t in docs]), spark.createDataFrame(items, ITEM))
    got = {(r["doc_id"], f["item_id"]): (f["n_shared"], f["n_shingles"]) for r in out.collect() for f in r["found"]}
    want = contained(docs, items)
    assert len(want) > 190 and got == want
