from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from opsloom.llm import language_families
from opsloom.llm.language_families import DIMS, Limits, fit, grouped, has_letter, identify, letters, machine, profile
from opsloom.llm.q_language import op11_language_families
from tests.llm.helpers import edges, empty

FOLDER = "/root/testdata/sf0.01"
#: Two families of closely related invented languages: syllables of the family, small words of the language.
FAMILIES = {
    "north": (("an", "berg", "ck", "dal", "eng", "fir"), {"aa": ("the", "of", "and"), "ab": ("den", "af", "og")}),
    "south": (("lo", "mia", "nu", "ora", "pe", "ri"), {"ba": ("el", "que", "por"), "bb": ("il", "che", "per")}),
}


def sentence(rng, lang, words):
    syllables, small = next((s, langs[lang]) for s, langs in FAMILIES.values() if lang in langs)
    return " ".join(rng.choice(small) if rng.random() < 0.35 else "".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(words))


def rows(seed, n, words=40):
    rng = random.Random(seed)
    return [(sentence(rng, lang, words), lang) for _ in range(n) for lang in ("aa", "ab", "ba", "bb")]


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.createDataFrame(rows(1, 60), "text string, lang string").repartition(5))


def test_families_and_related_languages(spark, model):
    assert model.families == (("aa", "ab"), ("ba", "bb"))
    assert model.pairs == (("aa", "ab"), ("ba", "bb")) and model.weights.shape == (4, DIMS + 1)
    found = identify(spark.createDataFrame(rows(2, 50), "text string, lang string"), model).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 and r["lang"] in r["family"].split("+") for r in found)


def test_how_rows_are_spread_changes_nothing(spark, model):
    data = rows(1, 60)
    again = fit(spark.createDataFrame(data[::-1] + data[:40], "text string, lang string").repartition(2))
    assert again.families == model.families and np.allclose(again.weights, model.weights)


def test_marks_and_long_texts(spark, model):
    rng = random.Random(5)
    text = sentence(rng, "ab", 60)
    noisy = "!! ".join(text.upper().split()) + " $$$ 123 ~~~ 99 " * 50
    long = "\n".join(sentence(rng, "bb", 30) for _ in range(4000))
    late = "7 " * 200_000 + sentence(rng, "ba", 50)  # letters at the end only
    found = identify(spark.createDataFrame([(1, noisy), (2, long), (3, late)], "id bigint, text string"), model).collect()
    assert [r["lang_pred"] for r in sorted(found)] == ["ab", "bb", "ba"]


def test_profile_counts_each_ngram_once(monkeypatch):
    text = "Ça va, été? 漢字 and so on; " * 9
    whole = profile(text)
    body = letters(text)
    grams = sum(max(0, len(body) - n + 1) for n in language_families.GRAMS)
    assert abs((whole**2).sum() - 1) < 1e-9
    assert np.allclose(np.round(whole**2 * grams), whole**2 * grams)
    for size in (8, 13, 64):
        monkeypatch.setattr(language_families, "PIECE", size)
        assert np.allclose(profile(text), whole)
    assert letters("A1b, C") == b" a b c " and profile("")[:].sum() == profile("1 2").sum()


def test_machine_separates():
    rng = np.random.default_rng(3)
    sides = np.array([1.0] * 30 + [-1.0] * 90)
    vectors = rng.normal(0, 1, (120, 5)) + np.outer(sides, [2, -1, 0, 0, 1])
    w = machine(vectors, sides, 50, 10.0)
    assert (np.sign(vectors @ w[:-1] + w[-1]) == sides).mean() > 0.97


def test_groups_are_bounded():
    alike = np.eye(6) + 0.1
    assert all(len(g) <= 2 for g in grouped(list("abcdef"), np.vstack([alike[0]] * 6) + np.eye(6) * 1e-3, 2))
    assert grouped(["x"], np.ones((1, 3)), 5) == (("x",),) and grouped([], np.ones((0, 3)), 5) == ()


def test_wrong_labels_and_copies_do_not_lead(spark):
    data = rows(7, 60)
    data += [(t, "aa") for t, lang in rows(8, 2) if lang != "aa"] + [data[1]] * 500  # noise, and a text copied often
    found = identify(spark.createDataFrame(rows(9, 40), "text string, lang string"), fit(spark.createDataFrame(data, "text string, lang string")))
    assert found.where("lang = lang_pred").count() >= 0.97 * 160


def test_edges(spark, model):
    docs = edges(spark).withColumnRenamed("n_chars", "score")  # a clashing name
    found = identify(docs, model).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in docs.collect())
    for d, r in zip(docs.collect(), found, strict=True):
        blank = d["text"] is None or not has_letter(d["text"])
        assert (r["lang_pred"] == "und") == blank and (r["score"] == 0 or not blank) and r["lang"] == d["lang"]
    assert {r["lang_pred"] for r in identify(docs, None).collect()} == {"und"}
    assert identify(empty(spark), model).collect() == [] and fit(empty(spark)) is None
    only = fit(docs.where("lang = 'en'").select("text", "lang"))
    assert {(r["lang_pred"], r["score"]) for r in identify(docs, only).collect()} == {("en", 1.0), ("und", 0.0)}


def test_held_out_accuracy(spark):
    found = op11_language_families(spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(truth, "doc_id")
    n = held.count()
    assert n > 200 and held.where("lang = lang_pred").count() >= 0.98 * n


def test_few_languages_are_learned_by_size(spark):
    data = rows(1, 20) + [("zzz qqq", "rare")]
    assert fit(spark.createDataFrame(data, "text string, lang string"), Limits(languages=4)).families == (("aa", "ab"), ("ba", "bb"))
