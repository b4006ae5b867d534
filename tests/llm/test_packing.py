from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opsloom.llm.q_packing import tokenizer_path
from opsloom.llm.token_packing import END_ID, Costs, WordCache, cuts, pack, places, tail_cost, tail_cuts
from tests.llm.helpers import edge_rows, edges, empty, prose, table


@given(st.lists(st.integers(1, 9), min_size=1, max_size=7), st.booleans(), st.data())
@settings(max_examples=80, deadline=None)
def test_cuts_are_the_cheapest(sizes, last, data):
    costs = Costs(window=8, sentence=1, hard=4, grain=2)
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    soft = np.array(sorted(data.draw(st.sets(st.integers(1, total)))), dtype=np.int64)
    at, penalty = places(total, soft, ends, costs)
    price = dict(zip(at.tolist(), penalty.tolist(), strict=True))
    best = {0: 0}
    for i in at.tolist():
        best[i] = min(best[j] + costs.window - (i - j) + price[i] for j in best if 0 < i - j <= costs.window)
    rest = {i: tail_cost(total - i, costs) if last else 0 for i in best if 0 < total - i <= costs.window}
    chosen = cuts(at, penalty, costs, last)
    assert all(0 < b - a <= 8 for a, b in zip([0, *chosen], chosen, strict=False))
    if last:
        assert chosen[-1] == total
        end = next(i for i in sorted(rest) if i in (0, *chosen) and chosen == [c for c in chosen if c <= i] + tail_cuts(i, total, costs))
        found = [c for c in chosen if c <= end]
    else:
        found, end = chosen, chosen[-1] if chosen else 0
    spent = sum(costs.window - (b - a) + price[b] for a, b in zip([0, *found], found, strict=False))
    assert min(best[i] + rest[i] for i in rest) == spent + rest[end]


def test_tail_is_cut_into_powers_of_two_only_where_it_pays():
    assert tail_cuts(100, 100 + 2048 + 4, Costs()) == [2148, 2152]
    assert tail_cuts(0, 4095, Costs()) == [4095]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


TEXTS = ["It's the DOG's 42nd day... we'll go!", "Grüße, ÀÉ ß ÿ × ÷", "漢字 ok \U0001f600", "a<|endoftext|>b <|startoftext|>", "é İ ΣΑΣ ª²", "", " \t\x0b\x0c\x1c\x85\xa0x　y"]


@given(st.text(max_size=40))
@settings(max_examples=150, deadline=None)
def test_cached_ids_equal_the_tokenizers(text):
    cache = test_cached_ids_equal_the_tokenizers.cache = getattr(test_cached_ids_equal_the_tokenizers, "cache", None) or WordCache(tokenizer_path(), limit=50)
    for t in (text, *TEXTS, prose(len(text), 30)):
        assert np.frombuffer(cache.encode(t), dtype="<u4").tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids


def read_back(rows):
    """Each sequence's ids, and each document's pieces by start."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        documents[(r["doc_id"], r["doc_tokens"])].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert sum(r["length"] for r in pieces) <= 4096
    return sequences, documents


def test_round_trip_and_padding(spark, tokenizer):
    texts = [prose(i, 30 + 37 * (i % 40)) for i in range(200)] + [prose(777, 9000)]
    rows = pack(table(spark, texts), tokenizer_path(), Costs(horizon=20_000), block_bytes=1 << 30).collect()
    sequences, documents = read_back(rows)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [END_ID]
        pieces = sorted(documents[(i, len(ids))], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in pieces), dtype="<u4").tolist() == ids
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
    sizes = [sum(r["length"] for r in s) for s in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes)
    assert padding < 0.02 * sum(sizes)
    order = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    assert [(r["doc_id"], r["start"]) for r in order] == sorted((r["doc_id"], r["start"]) for r in rows)


def test_edges(spark, tokenizer):
    docs = edges(spark).withColumnRenamed("lang", "ids")
    rows = pack(docs, tokenizer_path()).collect()
    read_back(rows)
    want = sorted((-1 if r[0] is None else r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in edge_rows())
    assert sum(r["length"] for r in rows) == sum(n for _, n in want)
    got = {(-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]) for r in rows}
    assert got == set(want)
    assert pack(empty(spark), tokenizer_path()).count() == 0
