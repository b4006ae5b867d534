from __future__ import annotations

from opsloom.llm.paragraph_minhash import bands, repeated_passages, uncompared, verified
from opsloom.llm.q_paragraphs import op5_paragraph_minhash
from tests.llm.helpers import edges, empty, prose, table


def test_planted_passages_are_found_wherever_they_stand(spark):
    passages = [prose(9000 + k, 60, line=1000) for k in range(5)]
    texts = []
    for i in range(60):
        host = prose(i, 150).split(". ")
        if i % 2:
            host.insert(i % len(host), passages[i % 5].rstrip("."))
        texts.append(". ".join(host))
    rows = repeated_passages(table(spark, texts)).collect()
    first = {k: min(i for i in range(1, 60, 2) if i % 5 == k) for k in range(5)}
    assert {r["doc_id"] for r in rows} == {i for i in range(1, 60, 2) if i != first[i % 5]}
    for r in rows:
        assert r["kept_doc_id"] % 5 == r["doc_id"] % 5 and r["kept_doc_id"] < r["doc_id"]
        words = texts[r["doc_id"]].split()[r["first_word"] : r["first_word"] + r["n_words"]]
        assert len(words) >= 30 and " ".join(words[1:-1]) in " ".join(texts[r["kept_doc_id"]].split())


def test_edited_lines_are_found(spark):
    line = prose(1, 80, line=1000)
    edited = line.split(" ")
    edited[40] = "edited"
    texts = [prose(2, 60), f"{prose(3, 60)}\n{line}\n{prose(4, 60)}", f"{prose(5, 60)}\n{' '.join(edited)}"]
    rows = repeated_passages(table(spark, texts)).collect()
    assert [(r["doc_id"], r["kept_doc_id"]) for r in rows] == [(2, 1)]


def test_copies_and_repeats_within_a_document(spark):
    a, b = prose(1, 120), prose(2, 60)
    rows = repeated_passages(table(spark, [a, a, a, f"{b}\n{b}\n{b}", prose(3, 200)])).collect()
    assert {(r["doc_id"], r["kept_doc_id"], r["first_word"]) for r in rows} == {(1, 0, 0), (2, 0, 0)}
    assert all(r["n_words"] == 120 for r in rows)


def test_edges(spark):
    docs = edges(spark).withColumnRenamed("lang", "start").withColumnRenamed("source", "root")
    rows = repeated_passages(docs).collect()
    assert all(r["n_words"] >= 30 for r in rows)
    assert {(r["doc_id"], r["kept_doc_id"]) for r in rows} == {(0, None), (4, 0)}
    assert repeated_passages(empty(spark)).count() == 0


def test_runs_of_sentences_at_the_limit_are_found(spark):
    texts = []
    for k in range(300):
        # Two runs a line: the first is new in each copy, the second has one word edited, 41 of 51 shingles are shared.
        run = [f"p{k}w{i}" for i in range(50)]
        edited = [*run[:25], "edited", *run[26:]]
        for n, own in enumerate((run, edited)):
            texts.append(" ".join([f"p{k}n{n}h{i}" for i in range(40)]) + ". " + " ".join(own) + ".")
    rows = repeated_passages(table(spark, texts)).collect()
    assert {(r["doc_id"], r["kept_doc_id"]) for r in rows} == {(2 * k + 1, 2 * k) for k in range(300)}


def test_lines_that_differ_by_a_sentence_mark_are_found(spark):
    texts = []
    for k in range(20):
        line = [f"p{k}w{i}" for i in range(60)]
        texts.append(" ".join(line) + ".")
        texts.append(" ".join([*line[:20], f"{line[20]}.", *line[21:]]) + ".")
    rows = repeated_passages(table(spark, texts)).collect()
    assert {(r["doc_id"], r["kept_doc_id"], r["n_words"]) for r in rows} == {(2 * k + 1, 2 * k, 60) for k in range(20)}


def words_of(seed: str, n: int) -> list[str]:
    return [f"{seed}w{i}" for i in range(n)]


SHAPES = {
    "no marks": (lambda w: w, lambda w: w),
    "marked host": (lambda w: w, lambda w: [x + "." if i % 12 == 11 else x for i, x in enumerate(w)]),
    "short sentences": (lambda w: [x + "." if i % 5 == 4 else x for i, x in enumerate(w)],) * 2,
    "quoted ends": (lambda w: [x + '."' if i % 12 == 11 else x for i, x in enumerate(w)],) * 2,
    "ideographic stops": (lambda w: [x + "。" if i % 12 == 11 else x for i, x in enumerate(w)],) * 2,
    "plain sentences": (lambda w: [x + "." if i % 12 == 11 else x for i, x in enumerate(w)],) * 2,
}


def test_passages_inside_a_line_are_found_in_every_shape(spark):
    texts, planted, clean = [], {}, set()
    for name, (passage_of, host_of) in SHAPES.items():
        for k in range(40):
            seed = f"{name[:2]}{k}"
            passage = passage_of(words_of(seed + "p", 51))
            for n in range(2):
                head, tail = (host_of(words_of(f"{seed}{n}{part}", 31 + k + n)) for part in "ht")
                if n:
                    planted[len(texts)] = (len(texts) - 1, len(head), name)
                texts.append(" ".join([*head, *passage, *tail]))
            clean.add(len(texts))
            texts.append(" ".join(host_of(words_of(seed + "c", 120))))
    rows = repeated_passages(table(spark, texts)).collect()
    assert not {r["doc_id"] for r in rows} & clean
    found = {r["doc_id"] for r in rows}
    missed = [name for doc, (_, _, name) in planted.items() if doc not in found]
    assert len(missed) <= 0.02 * len(planted), missed
    for r in rows:
        kept, at, name = planted[r["doc_id"]]
        # what goes lies inside the passage; runs of sentences are compared by 0.8 and may differ by two words
        more = 2 if name in ("marked host", "plain sentences") else 0
        assert r["kept_doc_id"] == kept and at - more <= r["first_word"] and r["first_word"] + r["n_words"] <= at + 51 + more


def repeated_words(a: list[str], b: list[str], least: int) -> bool:
    """By brute force: whether the texts share `least` words in a row."""
    own = {tuple(a[i : i + least]) for i in range(len(a) - least + 1)}
    return any(tuple(b[i : i + least]) in own for i in range(len(b) - least + 1))


def test_brute_force_on_random_overlaps(spark):
    import random

    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    texts: list[str] = []
    for _ in range(160):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", "", ",", "."]) for _ in range(rng.randrange(20, 160))]
        if texts and rng.random() < 0.6:
            other = rng.choice(texts).split()
            size = rng.randrange(10, 90)
            start = rng.randrange(max(len(other) - size, 0) + 1)
            place = rng.randrange(len(words) + 1)
            words[place:place] = other[start : start + size]
        texts.append("".join(w + rng.choice([" "] * 19 + ["\n"]) for w in words))
    split = [t.split() for t in texts]
    must = {j for j in range(len(texts)) if any(repeated_words(split[i], split[j], 50) for i in range(j))}
    may = {j for j in range(len(texts)) if any(repeated_words(split[i], split[j], 12) for i in range(j))}
    found = {r["doc_id"] for r in repeated_passages(table(spark, texts)).collect()}
    assert found <= may
    assert len(must - found) <= 0.02 * len(must), (sorted(must - found), len(must))


def test_a_changed_word_parts_a_passage_inside_a_line(spark):
    texts = []
    for k in range(30):
        passage = words_of(f"p{k}", 91)
        for n in range(2):
            passage[45] = f"changed{n}"
            texts.append(" ".join([*words_of(f"{k}h{n}", 40), *passage, *words_of(f"{k}t{n}", 40)]))
    rows = repeated_passages(table(spark, texts)).collect()
    assert {(r["doc_id"] % 2, r["doc_id"] - r["kept_doc_id"]) for r in rows} == {(1, 1)}
    assert all(40 <= r["first_word"] and r["first_word"] + r["n_words"] <= 131 and r["n_words"] <= 45 for r in rows)
    assert len(rows) >= 58


def test_a_passage_that_most_documents_hold(spark):
    passage = words_of("p", 60)
    texts = [" ".join([*words_of(f"{k}h", 35), *passage, *words_of(f"{k}t", 35)]) for k in range(600)]
    rows = repeated_passages(table(spark, texts)).collect()
    assert {(r["doc_id"], r["kept_doc_id"]) for r in rows} == {(k, 0) for k in range(1, 600)} and len(rows) == 599


def test_similar_lines_in_a_crowded_band(spark):
    # all lines share 24 of 64 words, so they crowd some bands; pairs differ by one word, others are far apart
    shared, texts = words_of("shared", 24), []
    for k in range(400):
        line = [*shared, *words_of(f"own{k}", 40)]
        texts.append(" ".join(line))
        texts.append(" ".join([*line[:44], "changed", *line[45:]]))
    rows = repeated_passages(table(spark, texts)).collect()
    whole = {(r["doc_id"], r["kept_doc_id"]) for r in rows if r["n_words"] == 64}
    assert len(whole & {(2 * k + 1, 2 * k) for k in range(400)}) >= 399


def test_query_against_brute_force_on_the_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    found = {r["doc_id"] for r in op5_paragraph_minhash(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    first: dict[tuple, int] = {}
    long, some = set(), set()
    for r in docs:
        words = (r["text"] or "").lower().split()
        for least, out in ((50, long), (25, some)):
            own = {tuple(words[i : i + least]) for i in range(len(words) - least + 1)}
            if any(w in first for w in own):
                out.add(r["doc_id"])
            for w in own:
                first.setdefault(w, r["doc_id"])
    assert long and long <= found <= some


def test_a_crowded_band_of_dissimilar_lines_loses_no_similar_pair(spark):
    """Lines that share 60 of 72 words, and with them bands, are not similar; each has one partner in which a single word differs."""
    common, texts = words_of("common", 60), []
    for k in range(400):
        own = words_of(f"p{k}", 12)
        texts += [" ".join([*common, *own]), " ".join([*common, *own[:-1], "edited"])]
    rows = repeated_passages(table(spark, texts)).collect()
    assert set(range(1, 800, 2)) <= {r["doc_id"] for r in rows if r["n_words"] == 72}


def test_band_keys_are_short_and_those_of_windows_whole(spark):
    rows = bands(table(spark, [prose(k, 200, line=60) for k in range(40)])).collect()
    of_bands = {r["key"] for r in rows if r["key"] != r["id"]}
    windows = {r["key"] for r in rows if r["key"] == r["id"]}
    assert all(key % (1 << 24) == 0 for key in of_bands) and len(of_bands) > 1000
    assert any(key % (1 << 24) for key in windows)


def test_uncompared_sets_hold_every_similar_pair(spark):
    import random

    rng, sets = random.Random(3), []
    for _ in range(400):
        own = {rng.randrange(2000) for _ in range(rng.randrange(4, 40))}
        if sets and rng.random() < 0.6:
            own = set(rng.sample(sets[rng.randrange(len(sets))], 4)) | set(rng.choice(sets))
        sets.append(sorted(own))
    rows = [(i, ["line"], i, one) for i, one in enumerate(sets)]
    df = spark.createDataFrame(rows, "id bigint, kinds array<string>, root bigint, shingles array<bigint>")
    got = {(r["a"], r["b"]) for r in verified(uncompared(df, 0.8), df, 0.8).collect()}
    each = [set(one) for one in sets]
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if 10 * len(each[i] & each[j]) >= 8 * len(each[i] | each[j])}
    assert want and got == want
