"""Spelling variants against plain Python."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.llm import spelling_fst

SCHEMA = "doc_id long, text string, word string, n int, key string, c long"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def first_unlike(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905


@pytest.mark.parametrize("minimise", [True, False])
def test_composition_accepts_each_near_pair_once(monkeypatch, minimise):
    if not minimise:
        monkeypatch.setattr(spelling_fst.Acceptor, "_equivalent", staticmethod(lambda *a: False))
    rng = random.Random(2)
    for _ in range(120):
        width, at_end = rng.choice([1, 2, 3, 5, 9]), rng.random() < 0.5
        rows = list({(rng.randrange(4), "".join(rng.choice("abc") for _ in range(width + rng.randrange(2)))) for _ in range(rng.choice([2, 5, 30, 120]))})
        rng.shuffle(rows)
        names = sorted({g for g, _ in rows})
        middles = np.zeros((len(rows), width + 1), np.uint8)
        for i, (_, word) in enumerate(rows):
            middles[i, : len(word)] = list(word.encode())
        longer = np.array([len(w) > width for _, w in rows])
        one, other = spelling_fst.near_pairs(middles, longer, np.array([names.index(g) for g, _ in rows]), at_end)
        found = sorted(tuple(sorted(p)) for p in zip(one.tolist(), other.tolist(), strict=True))
        assert found == [
            (i, j)
            for (i, (g, a)), (j, (h, b)) in itertools.combinations(enumerate(rows), 2)
            if g == h and near(a, b) and not (longer[i] and longer[j]) and (at_end or first_unlike(a, b) < width)
        ]


def test_minimised_acceptor_shares_endings():
    words = [a + b for a in "abcdefgh" for b in ("nation", "motion")]
    codes = np.array([list(w.encode() + b"\0") for w in words], np.uint8)
    a = spelling_fst.Acceptor(codes, np.zeros(len(words), bool), np.zeros(len(words), int))
    assert len(a.accepts) == 1 + 1 + 2 + 5  # start, after the first letter, two stems, then one shared ending
    assert sorted(a.row_of.tolist()) == list(range(len(words)))


def test_checksums():
    rng = random.Random(3)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 63, 64, 65, 300)]
    prefixes = [b":", b"12:", b"-123456789:"]
    rows, which = np.repeat(np.arange(3), 7), np.tile(np.arange(7), 3)
    found = spelling_fst.checksums(prefixes, rows, words, which)
    assert found.tolist() == [zlib.crc32(prefixes[r] + words[w]) for r, w in zip(rows, which, strict=True)]


def plain(rows):
    counts = {}
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, n_near = {}, {}
    for word, n in counts.items():
        found = sorted((-counts[o], o) for o in counts if o != word and near(word, o))
        n_near[word] = len(found)
        form[word] = found[0][1] if found and -found[0][0] >= 10 * n else None
    out = []
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n, n_near[word], counts[form[word]] if form[word] else None))
    return sorted(out, key=str)


def awkward():
    rng = random.Random(5)
    texts = [None, "", "short words", "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 29_999 + " " + "x" * 29_999]
    texts += ["chained " * 1000 + "chaineds " * 50 + "chainedsx " * 3 + "chainedsy " * 4 + "chainez " * 101, "Éternité éternité ÉTERNITÉ eternité eternité ×÷×÷×÷× ×÷×÷×÷×"]
    for _ in range(150):
        stem = "".join(rng.choice("abé") for _ in range(rng.choice([7, 8, 9])))
        texts.append(" ".join([stem, stem.upper(), stem[:3] + rng.choice("abß") + stem[3:], stem[1:] + "z", stem] * rng.choice([1, 2, 12])))
    texts += ["common" + "".join(rng.choice("abcdefg") for _ in range(2)) for _ in range(300)]  # a hot start of words
    rows = [(None if i == 7 else i, t, "clash", 1, "clash", 2) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9]]


@pytest.mark.parametrize("crowd", [2000, 4])
def test_variants_equal_plain_python(spark, crowd):
    rows = awkward()
    found = spelling_fst.variants(spark.createDataFrame(rows, SCHEMA).repartition(4), crowd)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows)
    assert sum(r[1] is not None for r in want) > 5 and any(r[1] != r[2] for r in want if r[1])
    assert sorted(map(tuple, found.collect()), key=str) == want


def test_keys_that_collide_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling_fst, "window_key", lambda c, low, high: F.lit(1).cast("long"))
    rows = [r for r in awkward() if r[1] and len(r[1]) < 5_000]
    found = spelling_fst.variants(spark.createDataFrame(rows, SCHEMA), 10**9)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_no_words(spark):
    assert spelling_fst.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling_fst.variants(spark.createDataFrame([(1, "only short ones", "", 1, "", 1)], SCHEMA)).count() == 0
