"""The automaton for long lists, against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from tollgate.functions import patterns, text
from tollgate.operators import audit


@pytest.mark.parametrize("lane, table, chunk", [(1, 1, 1), (7, 500, 50), (1024, 32 << 20, 1 << 20)])
def test_automaton_equals_plain_search(monkeypatch, lane, table, chunk):
    monkeypatch.setattr(patterns, "LANE_BYTES", lane)
    monkeypatch.setattr(patterns, "TABLE_BYTES", table)
    monkeypatch.setattr(patterns, "CHUNK_BYTES", chunk)
    rng = random.Random(lane)
    for _ in range(40):
        listed = ["".join(rng.choice("abcé日") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 40))]
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("abcdé日") for _ in range(rng.randint(0, 60))) for _ in range(30)]
        want = [[] if t is None else [i for i, p in enumerate(listed) if p in t] for t in texts]
        assert patterns.Patterns(listed).in_texts(texts) == want


def test_patterns_inside_patterns_and_very_long_texts():
    listed = ["a" * n for n in range(1, 60)] + ["b" + "a" * 3000]
    found = patterns.Patterns(listed).in_texts(["a" * 40, "b" + "a" * 300_000, ""])
    assert found == [list(range(40)), list(range(60)), []]


def test_ten_thousand_patterns_in_one_pass(spark, monkeypatch):
    rng = random.Random(4)
    listed = ["".join(rng.choice("abcdeFGH ") for _ in range(rng.randint(2, 9))) for _ in range(10_000)]
    texts = [(i, None if i == 3 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300)))) for i in range(60)]
    df = spark.createDataFrame(texts, "id int, body string")
    got = {r["id"]: r["w"] for r in df.select("id", text.words_found(F.lower("body"), listed).alias("w")).collect()}
    assert got == {i: [] if t is None else [p for p in listed if p.lower() in t] for i, t in texts}
    short = listed[:200]
    by_automaton = sorted(audit.matched_patterns(df, "body", short).collect())
    monkeypatch.setattr(text, "NATIVE_WORDS", 1000)
    assert by_automaton == sorted(audit.matched_patterns(df, "body", short).collect())
