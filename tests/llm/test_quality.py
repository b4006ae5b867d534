from __future__ import annotations

import re

from hypothesis import given
from hypothesis import strategies as st

from opsloom.llm.quality_divergence import Limits, base_counts, js_distance, judge, references
from opsloom.llm.tables import WORD
from tests.llm.helpers import edges, empty, prose, table

WORDS = re.compile(WORD)


def counted(text):
    """The base counts, position by position."""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    again = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


@given(st.text(alphabet="ab \n\t#%é", max_size=60))
def test_base_counts(text):
    assert base_counts(text, WORDS) == counted(text)


def test_distance_is_a_bounded_metric():
    assert js_distance([1, 0], [0, 1]) == 1
    assert js_distance([0.5, 0.5], [0.5, 0.5]) == 0
    assert abs(js_distance([0.2, 0.8], [0.6, 0.4]) - js_distance([0.6, 0.4], [0.2, 0.8])) < 1e-12


def test_references_hold_exact_shares(spark):
    docs = table(spark, [prose(i, 200) for i in range(30)]).repartition(5)
    words = " ".join(r["text"] for r in docs.select("text").collect()).lower().replace(".", " ").split()
    known = references(docs)["en"]
    assert abs(known.words[b"the"] - words.count("the") / len(words)) < 1e-12
    assert abs(sum(known.classes) - 1) < 1e-9


def test_clean_stays_and_junk_goes(spark):
    clean = [prose(i, 60 + 20 * i) for i in range(40)]
    junk = [" ".join(w.upper() + "!!" for w in prose(900 + i, 150).split()) for i in range(3)]
    junk += [" | ".join(f"{w}%%%" for w in prose(950 + i, 200).split() if w not in ("the", "of", "and", "to")) for i in range(3)]
    docs = table(spark, clean + junk)
    kept = {r["doc_id"] for r in judge(docs, references(docs)).filter("kept").collect()}
    assert kept == set(range(len(clean)))


def test_edges(spark):
    docs = edges(spark).withColumnRenamed("source", "kept")  # a clashing name
    rows = judge(docs, references(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))[:2] == counted(r["text"] or "")[:2] if len(r["text"] or "") < 5000 else True
        if not r["text"]:
            assert r["n_words"] == 0 and r["base_failed"] and not r["kept"] and r["class_distance"] is None
    assert next(r for r in rows if r["doc_id"] == 7)["n_repeat_words"] == 20_000
    assert judge(empty(spark), references(empty(spark))).count() == 0


def test_clean_documents_of_a_language_of_one_percent_stay(spark):
    to_cyrillic = str.maketrans("abdefghijklmnoprstuvc", "абдефгхийклмнопрстувц")
    rows = [(i, prose(i, 300), "en") for i in range(198)] + [(198 + i, prose(500 + i, 300).lower().translate(to_cyrillic), "ru") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = references(docs)
    judged = {r["doc_id"]: r for r in judge(docs, known).collect()}
    assert set(known) == {"en"} and all(judged[i]["kept"] for i in range(200))
    assert all(judged[i]["class_distance"] is None and judged[i]["word_distance"] is None for i in (198, 199))
    small = Limits(language_words=500)
    known = references(docs, small)
    judged = {r["doc_id"]: r for r in judge(docs, known, small).collect()}
    assert set(known) == {"en", "ru"} and all(judged[i]["kept"] and judged[i]["nearest"] == "ru" for i in (198, 199))
