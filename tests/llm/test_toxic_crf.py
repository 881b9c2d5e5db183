"""The field against sums over all label sequences, and scores on held-out documents."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tollgate.llm import toxic_crf
from tollgate.llm.toxic_crf import Tokens

SCHEMA = "doc_id long, text string, lang string, toxic string, score string, held_out string"


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def test_marginals_equal_sums_over_all_labellings(monkeypatch):
    monkeypatch.setattr(toxic_crf, "BLOCK", 4)
    rng = np.random.default_rng(1)
    moves, begin = rng.random((2, 2)) + 0.1, rng.random(2) + 0.1
    sizes = [1, 5, 3, 9, 2]
    scores = [rng.normal(0, 2, n) for n in sizes]
    want = []
    for e in scores:
        total, inside = 0.0, np.zeros(len(e))
        for y in itertools.product((0, 1), repeat=len(e)):
            weight = begin[y[0]] * np.prod([moves[a, b] for a, b in itertools.pairwise(y)]) * np.exp(sum(x * v for x, v in zip(e, y, strict=True)))
            total += weight
            inside += weight * np.array(y)
        want.append(inside / total)
    head = np.concatenate([np.arange(n) == 0 for n in sizes])
    found = toxic_crf.marginals(np.concatenate(scores), head, moves, begin)
    assert np.allclose(found, np.concatenate(want), atol=1e-9)


def test_marginals_of_extreme_and_long_input():
    e = np.concatenate([np.full(5_000, 800.0), np.full(5_000, -800.0)])
    found = toxic_crf.marginals(e, np.arange(len(e)) == 0, np.ones((2, 2)), np.ones(2))
    assert np.allclose(found, e > 0)


def test_tokens_and_spans():
    texts = ["Ça va, IDIOT! x", None, "", "日本 idiot_idiot", "-- ..."]
    tokens = Tokens(pa.array(texts))
    hot = np.zeros(len(tokens.starts))
    raw = tokens.chunk.bytes.tobytes()
    words = [raw[a:b].decode() for a, b in zip(tokens.starts, tokens.ends, strict=True)]
    assert words == ["ça", "va", "idiot", "x", "日本", "idiot", "idiot"]
    hot[[w == "idiot" for w in words]] = 1
    assert toxic_crf.spans_of(tokens, hot) == ["7:12", "", "", "3:14", ""]


def table_of(n, rng):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = rng.choice(["zounds", "knave", "gutte" + rng.choice(["rat", "rs", "ring", "red"])])
        docs.append((i, " ".join(text), "en", "clash", "clash", "clash"))
        if i % 3 != 2:
            labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def made():
    return table_of(1800, random.Random(12))


def run(spark, docs, labels):
    docs = spark.createDataFrame(docs, SCHEMA).repartition(4)
    return toxic_crf.score(docs, toxic_crf.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))


def test_held_out_documents_are_told_apart(spark, made):
    docs, labels = made
    rows = {r["doc_id"]: r for r in run(spark, docs, labels).collect()}
    assert len(rows) == len(docs) and all(r["held_out"] == held(i) for i, r in rows.items())
    test = [r for i, r in rows.items() if held(i) or i % 3 == 2]
    right = [r["predicted"] == (r["doc_id"] % 6 == 0) for r in test]
    assert sum(right) / len(right) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows.values())
    texts = {d[0]: d[1] for d in docs}
    marked = [texts[i][int(a) : int(b)] for i, r in rows.items() for a, _, b in (s.partition(":") for s in r["spans"].split(",") if s)]
    assert sum(any(m.startswith(("zounds", "knave", "gutte")) for m in part.split()) for part in marked) / len(marked) > 0.95


def test_held_out_labels_are_never_read(spark, made):
    docs, labels = made
    turned = [(i, 1 - t) if held(i) else (i, t) for i, t in labels]
    one = run(spark, docs, labels).select("doc_id", "score").collect()
    other = run(spark, [(*d[:2], "xx", "1", "1", "1") for d in docs], turned).select("doc_id", "score").collect()
    assert sorted(one) == sorted(other)


def test_awkward_rows(spark, made):
    docs, labels = made
    odd = [(None, "knave " * 30_000, None, None, None, None), (5000, None, "", "", "", ""), (5001, "", "", "", "", ""), (5002, "\x00 . -", "", "", "", ""), docs[0], docs[0]]
    rows = run(spark, docs[:600] + odd, [*labels, (0, 0), (0, None), (None, 1), (10**9, 1)]).collect()
    assert len(rows) == 606
    of = {r["doc_id"]: r for r in rows}
    assert of[None]["predicted"] == 1 and of[None]["held_out"]
    assert of[5000]["score"] == of[5001]["score"] == of[5002]["score"] < 0.5
    assert len({tuple(r) for r in rows if r["doc_id"] == 0}) == 1


def test_without_labels_or_rows(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxic_crf.score(nothing, toxic_crf.fit(nothing, none)).count() == 0
    docs = spark.createDataFrame([(1, "some words", "", "", "", "")], SCHEMA)
    assert toxic_crf.score(docs, toxic_crf.fit(docs, none)).first()["score"] == 0.5
    one = spark.createDataFrame([(i, 1) for i in range(1, 4)], "doc_id long, toxic int")
    assert toxic_crf.score(docs, toxic_crf.fit(docs, one)).first()["score"] > 0.9


def test_tables(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxic_crf.score(docs, toxic_crf.fit(docs, labels)).join(labels, "doc_id").where("held_out").agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right")
    )
    assert rows.first()["right"] > 0.93
