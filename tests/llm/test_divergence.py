from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from opsloom.llm import source_divergence
from opsloom.llm.source_divergence import audit, terms
from tests.llm.helpers import SCHEMA, edges, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, least, ranks):
    """Every group with every kept term."""
    times, docs_of, langs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source, found = r["lang"] or "", r["source"] or "", plain(r["text"])
        groups.add((lang, source))
        times[lang, source].update(found)
        langs[lang].update(found)
        docs_of[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = [w for w, n in docs_of[lang].items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 2) // (total + 2 * len(kept)) for w in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        own, whole = shares(times[lang, source]), shares(langs[lang])
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                q = shares(times[lang, other])
                pairs.append((other, sum(f(own[w], q[w]) for w in kept)))
        over = [(w, f(own[w], whole[w])) for w in kept if times[lang, source][w] and own[w] > whole[w]]
        for part, found in (("pair", pairs), ("term", over)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            for rank, (item, v) in enumerate(found, 1):
                if part == "pair" or rank <= ranks:
                    out.add((lang, source, part, item, v, rank))
    return out


def corpus(seed, rows, words):
    """Documents with a hot source, frequent words, many ties and null groups."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 6)}"
        lang = rng.choice(["en", "en", "de", None, ""])
        text = " ".join(rng.choice(words) if rng.random() < 0.7 else words[min(3, len(words) - 1)] for _ in range(rng.randint(0, 40)))
        out.append((i, None if rng.random() < 0.05 else text, lang, None if rng.random() < 0.05 else source, 0))
    return out


WORDS = ["The", "the", "Straße", "ÉTÉ", "été", "a1b", "don't", "漢字", "x", "y_z", "w w", "[k]"] + [f"t{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(6)]


@pytest.mark.parametrize("least,ranks", [(1, 10), (4, 3), (25, 10), (10_000, 10)])
def test_same_as_every_group_with_every_term(spark, least, ranks):
    docs = spark.createDataFrame(corpus(least, 250, WORDS), SCHEMA).repartition(5)
    got = [tuple(r) for r in audit(docs, least, ranks).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs.collect(), least, ranks)


def test_pieces_and_flushes_change_nothing(spark, monkeypatch):
    text = "Ab cd\x00ÉÉ, ef_gh漢 " * 30
    whole = [w for part in terms(text.encode()) for w in part]
    assert whole == [w.encode() for w in plain(text)]
    monkeypatch.setattr(source_divergence, "PIECE", 7)
    assert [w for part in terms(text.encode()) for w in part] == whole


def test_edges(spark):
    docs = edges(spark).withColumnRenamed("n_chars", "term")  # a clashing name
    assert {tuple(r) for r in audit(docs, 1).collect()} == brute(docs.collect(), 1, 10)
    assert audit(empty(spark)).collect() == []


def test_counts_beyond_64_bit_products(spark):
    """Shares are exact where 10^9 times a count passes 2^63."""
    rows = spark.createDataFrame([(10**13 + 7, 3 * 10**13 + 11, 12345)], "n bigint, total bigint, kinds bigint")
    n, total, kinds, p = rows.select("*", source_divergence.share("n", "total").alias("p")).first()
    assert p == 1 + 10**9 * (n + 2) // (total + 2 * kinds)
