from __future__ import annotations

import importlib
import sys

import pytest

import __spark_entry__
import corpus_pipeline
from checks.compare import duck
from opsloom.llm import stages
from opsloom.llm.queries import ORACLE, QUERIES
from opsloom.llm.tables import plain_words
from tests.llm.helpers import SCHEMA, edges, empty, prose

FOLDER = "/root/testdata/sf0.001"


def test_registered_once_each():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck(FOLDER).execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(result.fetchall())


def test_entry_works_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("corpus_pipeline")
    try:
        alone = importlib.reload(__spark_entry__)
        assert alone.queries() and not any(n == "pipeline" or n.startswith("op1_") for n in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_pipeline_stages_take_effect(spark, tmp_path):
    item = prose(700, 40)
    texts = [prose(i, 200) for i in range(20)]
    texts += [texts[3], texts[4].replace("the", "of", 1)]  # copies
    texts += [texts[5] + "\n" + item, " ".join(w.upper() + "!!" for w in prose(900, 150).split()), "too short"]
    texts += [f"{prose(50, 120)}\n{texts[6].splitlines()[0]}"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["quality"] == set(range(26)) - {23, 24}
    assert ids["line_dedup"] == ids["quality"]
    left = {r["doc_id"]: r for r in seen["line_dedup"].collect()}
    assert left[20]["text"] == "" and left[20]["n_chars"] == 0
    assert texts[6].splitlines()[0] not in left[25]["text"]
    assert 20 in ids["simhash"] and 22 in ids["simhash"]
    assert ids["decontamination"] == ids["simhash"] - {22}
    assert ids["packing"] == ids["decontamination"]
    assert all(len(plain_words(left[i]["text"])) > 50 for i in range(20))


@pytest.mark.parametrize("make", [edges, empty])
@pytest.mark.parametrize("stage", [stages.quality, stages.line_dedup, stages.simhash, stages.decontamination])
def test_stages_on_edges(spark, stage, make):
    docs = make(spark)
    out = stage(spark, docs, FOLDER)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


@pytest.mark.parametrize("make", [edges, empty])
def test_packing_stage_on_edges(spark, make):
    docs = make(spark)
    assert stages.packing(spark, docs, FOLDER).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
