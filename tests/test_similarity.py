"""Block similarity against brute force in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.functions import vectors
from tollgate.operators import similarity
from tollgate.operators.embedding import TrigramEmbedder, classify_texts, embed_text, embed_tokens


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    docs = similarity.unit_rows(rng.normal(size=(300, 8)))
    docs[10:20] = docs[0]  # equal vectors: the id decides
    asked = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "id long, embedding array<double>").repartition(6)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    return docs, asked, df, q


@pytest.mark.parametrize("limit", [similarity.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_top_k(data, limit, k):
    docs, asked, df, q = data
    found = similarity.top_k(q, df, k, broadcast_bytes=limit).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    scores = np.round(similarity.unit_rows(asked) @ docs.T, 10)
    for i in range(len(asked)):
        expected = sorted(range(len(docs)), key=lambda d: (-scores[i, d], d))[:k]
        assert got[i] == expected


def test_nearest_returns_all_when_k_is_large(data):
    docs, asked, df, _ = data
    assert similarity.nearest(df, asked[0], 1000).count() == len(docs)


@pytest.mark.parametrize("limit", [similarity.BROADCAST_BYTES, 0])
def test_maxsim_and_classes(spark, limit):
    rng = np.random.default_rng(2)
    tokens = [(d, t, rng.normal(size=5).tolist()) for d in range(30) for t in range(1 + d % 7)]
    asked = [(q, t, rng.normal(size=5).tolist()) for q in range(3) for t in range(4)]
    examples = [(f"c{c}", c, e, t, rng.normal(size=5).tolist()) for c in range(3) for e in range(2) for t in range(3)]

    def matrix(rows, *key):
        return similarity.unit_rows(np.array([r[-1] for r in rows if r[: len(key)] == key]))

    docs = spark.createDataFrame(tokens, "doc_id long, token_no long, vector array<double>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, token_no long, vector array<double>")
    for agg, combine in (("mean", np.mean), ("sum", np.sum)):
        got = similarity.maxsim(queries, docs, agg, broadcast_bytes=limit).collect()
        assert len(got) == 90
        for r in got:
            best = (matrix(asked, r["query_id"]) @ matrix(tokens, r["doc_id"]).T).max(axis=1)
            assert abs(r["score"] - combine(best)) < 1e-9
    texts = docs.withColumnRenamed("doc_id", "text_id")
    known = spark.createDataFrame(examples, "class string, class_no int, example_no int, token_no int, vector array<double>")
    scores = similarity.class_scores(texts, known, broadcast_bytes=limit)
    for r in scores.collect():
        per_example = [
            (matrix(tokens, r["text_id"]) @ matrix(examples, r["class"], r["class_no"], e).T).max(axis=1).mean() for e in range(2)
        ]
        assert abs(r["score"] - max(per_example)) < 1e-9
    chosen = similarity.predicted(scores).collect()
    for r in chosen:
        assert r["confidence"] == max(r["class_scores"].values())
        assert r["class_scores"][r["predicted_class"]] == r["confidence"]


def test_worked_example_sums_token_maxima(spark):
    """Two query tokens against ten document tokens: 0.95 + 0.92."""
    rows = [
        ("q1", [0.1, 0.0, 0.95, 0.3, 0.0, 0.0, 0.2, 0.0, 0.8, 0.85]),
        ("q2", [0.2, 0.0, 0.1, 0.6, 0.0, 0.0, 0.92, 0.0, 0.05, 0.1]),
    ]
    # vectors whose cosines are the given similarities: d = s * q + sqrt(1 - s^2) * other
    asked, docs = [], []
    for axis, (_, sims) in enumerate(rows):
        q = np.zeros(24)
        q[axis] = 1.0
        asked.append((0, axis, q.tolist()))
    for token in range(10):
        d = np.zeros(24)
        d[0], d[1] = rows[0][1][token], rows[1][1][token]
        d[2 + token] = np.sqrt(1 - d[0] ** 2 - d[1] ** 2)
        docs.append((0, token, d.tolist()))
    q = spark.createDataFrame(asked, "query_id long, token_no long, vector array<double>")
    d = spark.createDataFrame(docs, "doc_id long, token_no long, vector array<double>")
    assert round(similarity.maxsim(q, d, "sum").first()["score"], 9) == 1.87
    assert round(similarity.maxsim(q, d, "mean").first()["score"], 9) == 0.935


def test_text_scores_itself_one(spark):
    texts = ["Meeting notes", "internal memo about phoenix", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "text_id long, text string")
    for i, text in enumerate(texts):
        found = classify_texts(df, "text", "r", {"same": [text], "none": []}).filter(f"text_id = {i}").first()["r"]
        assert abs(found["class_scores"]["same"] - 1) < 1e-9
        assert found["class_scores"]["none"] == 0 and found["predicted_class"] == "same"


def test_classify_matches_token_brute_force(spark):
    text = "Press notes about ssn: 4111 and the the release " * 30
    model = TrigramEmbedder()
    examples = {"x": ["SSN: 123", "Press release"], "y": ["Draft document"]}
    words = similarity.unit_rows(model.embed(text.lower().split()))

    def score(phrase):
        return (words @ similarity.unit_rows(model.embed(phrase.lower().split())).T).max(axis=1).mean()

    df = spark.createDataFrame([(1, text), (2, "   "), (3, None)], "id int, text string")
    got = {r["id"]: r["r"] for r in classify_texts(df, "text", "r", examples).collect()}
    assert abs(got[1]["class_scores"]["x"] - max(score("SSN: 123"), score("Press release"))) < 1e-9
    assert abs(got[1]["class_scores"]["y"] - score("Draft document")) < 1e-9
    for blank in (2, 3):
        assert got[blank]["predicted_class"] == "Class 5: Unknown" and got[blank]["confidence"] == 0.0 and got[blank]["error"]


def test_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([("Hello World",), ("",), (None,), ("\U0001f600 x",)], "t string")
    rows = df.select(embed_text(F.col("t")).alias("v"), embed_tokens(F.col("t")).alias("w")).collect()
    lengths = [round(sum(x * x for x in r["v"]), 9) for r in rows]
    assert lengths == [1.0, 0.0, 0.0, 1.0]
    assert len(rows[0]["w"]) == 2 and rows[3]["w"] is not None


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>, s array<double>")
    r = df.select(
        vectors.norm(F.col("a")).alias("n"),
        vectors.cosine(F.col("a"), F.col("b")).alias("zero"),
        vectors.cosine(F.col("a"), F.col("a")).alias("one"),
        vectors.softmax(F.col("s")).alias("p"),
        vectors.best_of(F.col("s")).alias("best"),
        vectors.unit(F.col("a")).alias("u"),
    ).first()
    assert r["n"] == 5 and r["zero"] == 0 and abs(r["one"] - 1) < 1e-12
    assert abs(sum(r["p"]) - 1) < 1e-12 and r["best"]["index"] == 2 and r["u"] == [0.6, 0.8]


@pytest.mark.parametrize("limit", [similarity.BROADCAST_BYTES, 3000])
def test_searches_move_no_vectors(data, limit):
    """Also with queries in many waves, only ids and scores are shuffled."""
    docs, asked, df, q = data
    found = similarity.top_k(q, df, 3, broadcast_bytes=limit)
    plan = found._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("Exchange" in line and ("vector" in line or "embedding" in line)), line
    assert plan.count("hashpartitioning") == 1 and plan.count("hashpartitioning(query_id") == 1


def test_top_k_of_text_ids_and_few_documents(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None)], "id string, embedding array<double>")
    q = spark.createDataFrame([("x", [2.0, 0.0]), ("y", [0.0, 0.0])], "query_id string, vector array<double>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in similarity.top_k(q, df, 2).orderBy("query_id", "rank").collect()]
    assert got == [("x", "a", 1), ("x", "b", 2), ("y", "a", 1), ("y", "b", 2)]
    assert similarity.top_k(q.limit(0), df, 2).count() == 0 and similarity.top_k(q, df.limit(0), 2).count() == 0


def make_tokens(spark, seed, n, most, groups, name):
    """Documents whose tokens lie near one of a few directions."""
    rng = np.random.default_rng(seed)
    centres = similarity.unit_rows(np.random.default_rng(0).normal(size=(groups, 12)))
    rows = []
    for d in range(n):
        base = centres[d % groups]
        rows += [(d, t, (base + 0.15 * rng.normal(size=12)).tolist()) for t in range(1 + int(rng.integers(most)))]
    return rows, spark.createDataFrame(rows, f"{name} long, token_no long, vector array<double>").repartition(5)


@pytest.mark.parametrize(("limit", "part", "agg"), [(similarity.BROADCAST_BYTES, 4096, "mean"), (2000, 4096, "sum"), (similarity.BROADCAST_BYTES, 7, "mean")])
def test_maxsim_top_is_exact_and_skips(spark, limit, part, agg):
    rows, docs = make_tokens(spark, 3, 240, 12, 8, "doc_id")
    asked, queries = make_tokens(spark, 4, 11, 5, 8, "query_id")

    def matrix(found, key):
        return similarity.unit_rows(np.array([r[-1] for r in found if r[0] == key]))

    work = similarity.Work(spark)
    got = {}
    for r in similarity.maxsim_top(queries, docs, 5, agg, limit, work, part).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    combine = np.mean if agg == "mean" else np.sum
    for q in range(11):
        scores = {d: round(combine((matrix(asked, q) @ matrix(rows, d).T).max(axis=1)), 10) for d in range(240)}
        want = sorted(scores, key=lambda d: (-scores[d], d))[:5]
        assert [d for d, _ in got[q]] == want
        assert np.allclose([s for _, s in got[q]], [scores[d] for d in want])
    assert work.met.value > 0 and (part == 7 or work.skipped() > 0.5)


def test_rerank_scores_the_candidates_only(spark, monkeypatch):
    rows, docs = make_tokens(spark, 5, 60, 9, 6, "doc_id")
    asked, queries = make_tokens(spark, 6, 7, 4, 6, "query_id")
    seen = []
    plain = similarity.score_pairs
    monkeypatch.setattr(similarity, "score_pairs", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    monkeypatch.setattr(similarity.token_rows, "__defaults__", (4,))  # long documents come in parts
    found = similarity.rerank(queries, docs, 8).collect()
    assert seen == [56] and len(found) == 56
    for r in found:
        mine = similarity.unit_rows(np.array([x[-1] for x in asked if x[0] == r["query_id"]]))
        theirs = similarity.unit_rows(np.array([x[-1] for x in rows if x[0] == r["doc_id"]]))
        assert abs(r["score"] - (mine @ theirs.T).max(axis=1).mean()) < 1e-9
    for q in range(7):
        ranked = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["score"] for r in ranked] == sorted((r["score"] for r in ranked), reverse=True)


def test_balls_hold_all_tokens():
    tokens = similarity.unit_rows(np.random.default_rng(7).normal(size=(50, 6)))
    for some in (tokens, tokens[:1], np.repeat(tokens[:1], 5, axis=0)):
        centres, radii = similarity.balls(some)
        for probe in tokens:
            assert (some @ probe).max() <= (centres @ probe + radii).max() + 1e-9


def test_python_sees_few_rows_of_a_batch(spark):
    """A model is given slices of a batch, by bytes and by rows; results stay at their rows."""
    import pyarrow as pa

    from tollgate.functions.runs import RUN_BYTES, RUN_ROWS, runs

    class Counting(TrigramEmbedder):
        def embed(self, texts):
            assert len(texts) <= RUN_ROWS and (len(texts) == 1 or sum(map(len, texts)) <= RUN_BYTES), len(texts)
            return super().embed(texts)

    df = spark.range(4000, numPartitions=1).withColumn("t", F.when(F.col("id") % 7 > 0, F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 200)))
    rows = df.withColumn("v", embed_text(F.col("t"), Counting)).orderBy("id").collect()
    for row in rows[::97]:
        want = similarity.unit_rows(TrigramEmbedder().embed([row["t"] or ""]))[0]
        assert np.allclose(row["v"], want)
    lists = pa.array([["a" * 10] * 3, None, [], ["b" * 50], ["c"] * 90])
    assert pa.concat_arrays(list(runs(lists, 60))).equals(lists) and len(list(runs(lists, 60))) > 1


def test_single_precision_loses_no_document(monkeypatch, spark):
    """Blocks after the first take no whole score table, and near ties beyond single precision keep their order."""
    rng = np.random.default_rng(5)
    base = similarity.unit_rows(rng.normal(size=(40, 64)))
    docs = similarity.unit_rows(np.repeat(base, 60, axis=0) + rng.normal(size=(2400, 64)) * 1e-7)
    probe = similarity.unit_rows(rng.normal(size=(30, 64)))
    best, rough, full = similarity.Best(30, 5), probe.astype(np.float32), []
    real = similarity._full_block
    monkeypatch.setattr(similarity, "_full_block", lambda *a: full.append(1) or real(*a))
    order = rng.permutation(2400)
    for at in range(0, 2400, 300):
        part = order[at : at + 300]
        if np.isfinite(best.least).all():
            row, col, score = similarity._better(probe, rough, docs[part], best.least, 5)
        else:
            row, col, score = similarity._full_block(probe, docs[part], best.least, 5)
        best.add(row, score, part[col])
        best.settle()
    scores = np.round(probe @ docs.T, 10)
    want = np.sort(scores, axis=1)[:, :-6:-1]
    assert np.allclose(best.score.reshape(30, 5), want, atol=2e-10, rtol=0)
    assert len(full) < 8
