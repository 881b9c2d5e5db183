"""The registered queries over the smallest data, and the pipeline stage by stage."""


import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check_sql import compare
from tollgate.llm import lsh_forest, queries, quality_kn, secret_cnn, store, wu_manber
from tollgate.plans import catalog


@pytest.mark.parametrize("name", list(queries.CHECK_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name, monkeypatch):
    monkeypatch.setitem(catalog.QUERIES, name, queries.QUERIES[name])
    monkeypatch.setitem(catalog.CHECK_SQL, name, queries.CHECK_SQL[name])
    good, text = compare(spark, sf_dir, name)
    assert good, text


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(store.written(stage(spark, steps[-1], sf_dir), f"test-{name}"))
    held = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    assert all(s.columns == columns for s in steps[:-1])
    assert set(held[1]) == {r["doc_id"] for r in quality_kn.judge(steps[0]).where("kept").collect()}
    assert set(held[2]) == {r["doc_id"] for r in lsh_forest.join(steps[1]).collect() if r["doc_id"] == r["class_id"]}
    clean = wu_manber.scan(steps[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert set(held[3]) == {r["doc_id"] for r in clean.where("NOT contaminated").collect()}
    assert set(held[4]) == set(held[3]) == set(held[5])
    assert all(not secret_cnn.base_spans(r["text"]) for r in held[4].values())
    assert any(held[3][i]["text"] != held[4][i]["text"] for i in held[4])
    library = Tokenizer.from_file(queries.tokenizer_path())
    for i, row in held[5].items():
        assert row["ids"] == library.encode(held[4][i]["text"], add_special_tokens=False).ids == list(row["ids"])
        assert row["n_tokens"] == len(row["ids"])


