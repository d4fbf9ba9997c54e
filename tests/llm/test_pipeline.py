from __future__ import annotations

import pytest

from provena.llm import jaccard, registry, secrets, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    step = dict(corpus_pipeline.STAGES)
    kept = step[names[0]](spark, docs, SF).cache()
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5} and kept.columns == docs.columns
    single = step[names[1]](spark, kept, SF).cache()
    found = jaccard.link(kept.select("doc_id", "text"), 5, 8, 10).collect()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["component_id"] for r in found}) and single.columns == docs.columns
    cut = step[names[2]](spark, single, SF).cache()
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (single, cut))
    assert before.keys() == after.keys() and cut.columns == docs.columns
    for i, r in after.items():
        assert r["text"] == secrets.redact(before[i]["text"], secrets.scan(before[i]["text"])[1]) and r["n_chars"] == len(r["text"])
    mixed = step[names[3]](spark, cut, SF).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= after.keys()
    assert all(r["text"] == after[r["doc_id"]]["text"] for r in mixed.collect())
    ids = step[names[4]](spark, mixed, SF)
    assert ids.columns == ["doc_id", "n_ids", "ids"] and ids.count() == mixed.count()


def test_odd_tables_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words here", "en", None, 15), (3, "same text twice " * 9, "en", "s", 9), (4, "same text twice " * 9, "en", "s", 9)]
    odd = spark.createDataFrame(rows, docs.schema)
    for start in (odd, docs.limit(0), odd.withColumns({c: odd["lang"] for c in ("spans", "ids", "uid", "toxicity", "component_id", "taken", "target", "copies")})):
        for name, stage in corpus_pipeline.STAGES:
            before, start = start, stage(spark, start, SF)
            assert start.columns == before.columns or name == corpus_pipeline.STAGES[-1][0]
            if name == corpus_pipeline.STAGES[2][0]:
                assert sorted(map(str, start.drop("text", "n_chars").collect())) == sorted(map(str, before.drop("text", "n_chars").collect()))
        start.collect()


def test_registry_names_every_operator():
    queries, sql = registry.load()
    assert sorted(int(n[2:].split("_")[0]) for n in queries) == list(range(1, 14)) and set(sql) <= set(queries)
