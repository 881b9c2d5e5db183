"""Exact similarity of many vectors to many vectors.

Searches for the k best send the queries out in waves of bounded size; documents stay where
they are, and a task keeps k per query through all its batches. Full score tables (token maxima,
class scores) pack each side into blocks (one row per block): every document block
meets every query block once, as a dense matrix product inside an Arrow task, and only
the reduced result leaves the task: one maximum per query token, or one sum per example.
Pairs are rows only where they are given.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.functions.vectors import mean_vectors, unit
from tollgate.session import cut_lineage, small_side

QUERY_BLOCK = 1024
DOC_BLOCK = 2048
LEAST_WAVE = 8
BROADCAST_BYTES = 64 << 20
#: Tokens in one row of a document, and balls that bound them.
PART_TOKENS = 4096
BALLS = 4


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _pack(df: DataFrame, ids: Sequence[str], vector: str) -> DataFrame:
    """One row per Arrow batch: an array per id column, all vectors as bytes. No shuffle."""
    rows = df.select(*ids, F.col(vector).cast("array<double>").alias("_vector")).filter(F.size("_vector") > 0)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} array<{types[c]}>" for c in ids) + ", rows int, vectors binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            whole = pa.array([0, n], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, batch.column(i)) for i in range(len(ids))]
            flat = batch.column(len(ids)).flatten().to_numpy(zero_copy_only=False)
            data = [*lists, pa.array([n], pa.int32()), pa.array([flat.astype("<f8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names=[*ids, "rows", "vectors"])

    return rows.mapInArrow(pack, schema)


def _query_blocks(queries: DataFrame, ids: Sequence[str], vector: str, blocks: int) -> DataFrame:
    """Query rows gathered by a hash of their unique id: about ``QUERY_BLOCK`` rows each."""
    rows = queries.select(*ids, F.col(vector).cast("array<double>").alias("vector")).filter(F.size("vector") > 0)
    at = F.pmod(F.xxhash64(*ids), F.lit(blocks)).cast("int")
    return rows.groupBy(at.alias("_block")).agg(F.collect_list(F.struct(*ids, "vector")).alias("queries"))


def _place(packed: DataFrame, held: DataFrame, blocks: int, fits: bool) -> DataFrame:
    """Every document block next to every query block.

    ``held`` is broadcast when its measured size fits. Otherwise the documents are
    sharded and each query block is copied once per shard, so no query block
    meets all documents in one task.
    """
    spread = packed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if fits:
        return spread.join(F.broadcast(held), "_block")
    shards = 4 * int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = F.pmod(F.xxhash64("vectors"), F.lit(shards)).cast("int")
    copies = held.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return spread.withColumn("_shard", placed).join(copies, ["_block", "_shard"])


def _meet(
    documents: DataFrame,
    doc_ids: Sequence[str],
    doc_vector: str,
    queries: DataFrame,
    query_ids: Sequence[str],
    query_vector: str,
    reduce: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray], pd.DataFrame],
    schema: str,
    broadcast_bytes: int,
) -> DataFrame:
    # The query side is measured and then used: work it out once.
    queries = cut_lineage(queries.select(*query_ids, query_vector))
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(query_vector)).alias("dim")).first()
    count, dim = size["n"], size["dim"] or 1
    blocks = max(1, math.ceil(count / QUERY_BLOCK))
    packed = _pack(documents, doc_ids, doc_vector)
    held = _query_blocks(queries, query_ids, query_vector, blocks)
    pairs = _place(packed, held, blocks, count * (dim + 8) * 8 <= broadcast_bytes)
    doc_names, query_names = list(doc_ids), list(query_ids)

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                values = row._asdict()
                docs = pd.DataFrame({c: values[c] for c in doc_names})
                matrix = np.frombuffer(values["vectors"], dtype="<f8").reshape(values["rows"], -1)
                asked = values["queries"]
                names = pd.DataFrame({c: [q[c] for q in asked] for c in query_names})
                probe = np.array([q["vector"] for q in asked], dtype=np.float64)
                yield reduce(docs, matrix, names, probe)

    chosen = pairs.select(*doc_names, F.col("rows").alias("rows"), "vectors", "queries")
    return chosen.mapInPandas(compute, schema)


class Best:
    """The k best documents of each query so far: a bounded pool that a task carries through all its batches."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.doc: np.ndarray = np.zeros(0, object)
        self.least = np.full(queries, -np.inf)  # the score that a document must reach, per query

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        if not len(query):
            return
        self.query = np.concatenate([self.query, query])
        self.score = np.concatenate([self.score, score])
        self.doc = np.concatenate([self.doc, doc]) if len(self.doc) else doc
        if len(self.query) > 2 * self.k * self.queries + 4096:
            self.settle()

    def settle(self) -> None:
        """Keep k per query: larger scores first, then smaller ids."""
        if not len(self.query):
            return
        codes, distinct = pd.factorize(self.doc)  # far fewer documents than entries
        place = np.empty(len(distinct), np.int64)
        place[np.argsort(distinct, kind="stable")] = np.arange(len(distinct))
        rank = place[codes]
        order = np.lexsort((rank, -self.score, self.query))
        query = self.query[order]
        starts = np.searchsorted(query, np.arange(self.queries + 1))
        keep = np.arange(len(query)) - starts[query] < self.k
        order = order[keep]
        self.query, self.score, self.doc = self.query[order], self.score[order], self.doc[order]
        starts = np.searchsorted(self.query, np.arange(self.queries + 1))
        full = np.flatnonzero(np.diff(starts) == self.k)
        self.least[full] = self.score[starts[full] + self.k - 1]


def _full_block(probe: np.ndarray, matrix: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the pairs that may count: at most k documents a query, and those that tie with the last."""
    # rounded, so equal vectors tie exactly and the id decides
    scores = np.round(probe @ matrix.T, 10)
    edge = least
    if k < len(matrix):
        edge = np.maximum(edge, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
    row, col = np.nonzero(scores >= edge[:, None])
    return row, col, scores[row, col]


def _better(probe: np.ndarray, rough: np.ndarray, matrix: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_full_block` for queries that have k documents: single precision finds the few pairs that may reach ``least``.

    ``rough`` is the probe in single precision. Its product is off by no more than ``slack``, so no pair is lost; the chosen ones are
    scored in double.
    """
    length = float(np.sqrt((matrix * matrix).sum(axis=1).max(initial=0.0)))
    slack = (matrix.shape[1] + 4) * 2.0**-22 * max(length, 1.0)
    row, col = np.nonzero(rough @ matrix.T.astype(np.float32) >= (least - slack).astype(np.float32)[:, None])
    if len(row) > 4 * k * len(probe):  # the scores known so far say little here
        return _full_block(probe, matrix, least, k)
    score = np.round(np.einsum("ij,ij->i", probe[row], matrix[col]), 10)
    good = score >= least[row]
    return row[good], col[good], score[good]


def _values(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as the ids do."""
    if pa.types.is_integer(column.type):
        return np.asarray(column)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _waves(queries: DataFrame, per_query: float, limit: int) -> Iterator[pa.Table]:
    """The stored queries in parts of about ``limit`` bytes, by a hash of their id: what one broadcast holds.

    A wave is never meant for fewer than ``LEAST_WAVE`` queries, since each one reads all documents.
    """
    count = queries.count()
    waves = max(1, min(math.ceil(count / LEAST_WAVE), math.ceil(count * per_query / max(1, limit))))
    for wave in range(waves):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(waves)) == wave).toArrow()
        if part.num_rows:
            yield part


def _unit_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long vectors as rows of length one."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(whole.flatten(), dtype=np.float64)
    return unit_rows(flat.reshape(len(whole), -1)) if len(whole) else np.zeros((0, 1))


def _ranked(parts: list[DataFrame], k: int, query_id: str, doc_id: str, empty: DataFrame) -> DataFrame:
    """The k best of what the tasks kept."""
    found = parts[0] if parts else empty
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    queries: DataFrame,
    documents: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "vector",
    doc_id: str = "id",
    doc_vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` documents with the largest dot product per query: ``rank`` from 1, ties by id.

    Documents hold unit vectors; queries are normalised here, so the score is a cosine.
    Documents stay where they are. Queries go out in waves of at most about ``broadcast_bytes``, results
    held by a task included; a task keeps k documents per query through all its batches and sends nothing else.
    """
    types = dict(documents.dtypes) | {f"asked {c}": t for c, t in queries.dtypes}
    schema = f"{query_id} {types['asked ' + query_id]}, {doc_id} {types[doc_id]}, score double"
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("vector"))
    asked = cut_lineage(asked.filter(F.size("vector") > 0))  # met once per wave
    dim = asked.agg(F.max(F.size("vector"))).first()[0] or 1
    held = documents.select(F.col(doc_id).alias("id"), F.col(doc_vector).cast("array<double>").alias("vector")).filter(F.size("vector") > 0)
    context = documents.sparkSession.sparkContext
    per_query = 8 * dim + 32 * k + 16
    if asked.count() * per_query > broadcast_bytes:
        held = cut_lineage(held)  # read once per wave: vectors may be the work of a model

    def search(wave: pa.Table) -> DataFrame:
        shared = context.broadcast((wave.column("query_id").combine_chunks(), _unit_matrix(wave.column("vector"))))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, probe = shared.value
            rough = probe.astype(np.float32)
            best = Best(len(probe), k)
            kind = None
            for batch in batches:
                kind = batch.column(0).type
                for at in range(0, batch.num_rows, DOC_BLOCK):
                    part = batch.slice(at, DOC_BLOCK)
                    keys = _values(part.column(0))
                    matrix = np.asarray(part.column(1).flatten(), np.float64).reshape(len(keys), -1)
                    for low in range(0, len(probe), QUERY_BLOCK):
                        own = slice(low, low + QUERY_BLOCK)
                        if np.isfinite(best.least[own]).all():
                            row, col, score = _better(probe[own], rough[own], matrix, best.least[own], k)
                        else:
                            row, col, score = _full_block(probe[own], matrix, best.least[own], k)
                        best.add(row + low, score, keys[col])
                    if not np.isfinite(best.least).all():
                        best.settle()  # the first k documents of a query are what the next ones have to reach
            best.settle()
            if len(best.query):
                data = [names.take(pa.array(best.query)), pa.array(best.doc.tolist(), kind), pa.array(best.score)]
                yield pa.RecordBatch.from_arrays(data, names=[query_id, doc_id, "score"])

        return held.mapInArrow(task, schema)

    parts = [search(wave) for wave in _waves(asked, per_query, broadcast_bytes)]
    return _ranked(parts, k, query_id, doc_id, documents.sparkSession.createDataFrame([], schema))


def nearest(documents: DataFrame, query: Sequence[float], k: int, doc_id: str = "id", doc_vector: str = "embedding") -> DataFrame:
    """Top k for one query vector; all documents when ``k`` exceeds their number."""
    from tollgate.functions.vectors import dot

    vector = np.asarray(query, dtype=np.float64)
    length = float(np.sqrt((vector * vector).sum())) or 1.0
    asked = F.array(*[F.lit(float(x)) for x in vector / length])
    scored = documents.withColumn("score", dot(F.col(doc_vector), asked))
    return scored.orderBy(F.desc("score"), doc_id).limit(k)


def _segments(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    values, starts = np.unique(codes[order], return_index=True)
    return order, values, starts


def token_maxima(
    query_tokens: DataFrame, doc_tokens: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Largest cosine of each query token over the tokens of each document.

    Inputs hold ``(query_id, token_no, vector)`` and ``(doc_id, token_no, vector)``.
    """
    q_type = dict(query_tokens.dtypes)["query_id"]
    d_type = dict(doc_tokens.dtypes)["doc_id"]
    asked = query_tokens.select("query_id", F.col("token_no").cast("long").alias("query_token"), "vector")

    def reduce(docs, matrix, names, probe):
        similar = unit_rows(matrix) @ unit_rows(probe).T
        codes, uniques = pd.factorize(docs["doc_id"])
        order, values, starts = _segments(codes)
        best = np.maximum.reduceat(similar[order], starts, axis=0)
        n_docs, n_tokens = best.shape
        return pd.DataFrame(
            {
                "query_id": np.tile(names["query_id"].to_numpy(), n_docs),
                "query_token": np.tile(names["query_token"].to_numpy(), n_docs),
                "doc_id": np.repeat(np.asarray(uniques)[values], n_tokens),
                "best": best.ravel(),
            }
        )

    partial = _meet(
        doc_tokens, ["doc_id"], "vector", asked, ["query_id", "query_token"], "vector", reduce,
        f"query_id {q_type}, query_token bigint, doc_id {d_type}, best double", broadcast_bytes,
    )
    return partial.groupBy("query_id", "doc_id", "query_token").agg(F.max("best").alias("best"))


def maxsim(query_tokens: DataFrame, doc_tokens: DataFrame, agg: str = "mean", **options) -> DataFrame:
    """MaxSim score of every (query, document): mean or sum of the token maxima."""
    combine = {"mean": F.avg, "sum": F.sum}[agg]
    best = token_maxima(query_tokens, doc_tokens, **options)
    return best.groupBy("query_id", "doc_id").agg(combine("best").alias("score"))


def token_rows(tokens: DataFrame, key: str, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``key``, ``parts``, ``n`` and all token vectors of a document in one row, as bytes of unit vectors.

    A document of more than ``part_tokens`` tokens has several rows (``parts``), so that none is unbounded.
    """
    rows = tokens.select(key, F.col("vector").cast("array<double>").alias("vector"), F.xxhash64("token_no").alias("_at"))
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    long = cut_lineage(sizes.filter(F.col("_n") > part_tokens).select(key, F.ceil(F.col("_n") / part_tokens).cast("int").alias("parts")))
    placed = rows.join(small_side(long), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("_part", F.pmod("_at", F.col("parts")))
    grouped = placed.groupBy(key, "parts", "_part").agg(F.collect_list("vector").alias("vectors"))
    kind = dict(tokens.dtypes)[key]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, counts = [], []
            for row in batch.column(2):
                counts.append(len(row.values))
                packed.append(_unit_matrix(row.values).tobytes())
            data = [batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names=[key, "parts", "n", "tokens"])

    return grouped.select(key, "parts", "vectors").mapInArrow(pack, f"{key} {kind}, parts int, n int, tokens binary")


class Work:
    """How many (query, document) pairs were met, and how many of them had to be scored."""

    def __init__(self, spark):
        self.met, self.scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def skipped(self) -> float:
        return 1 - self.scored.value / max(1, self.met.value)


def balls(tokens: np.ndarray, count: int = BALLS) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of a few balls that hold all token vectors; ``count`` at most."""
    seeds = [0]
    far = 1 - tokens @ tokens[0]
    while len(seeds) < min(count, len(tokens)) and far.max() > 1e-12:
        seeds.append(int(far.argmax()))
        far = np.minimum(far, 1 - tokens @ tokens[seeds[-1]])
    own = (tokens @ tokens[seeds].T).argmax(axis=1)
    centres = np.stack([tokens[own == i].mean(axis=0) if (own == i).any() else tokens[s] for i, s in enumerate(seeds)])
    distance = np.sqrt(np.maximum(((tokens - centres[own]) ** 2).sum(axis=1), 0))
    radii = np.array([distance[own == i].max(initial=0.0) for i in range(len(seeds))])
    return centres, radii


def maxsim_top(
    query_tokens: DataFrame,
    doc_tokens: DataFrame,
    k: int,
    agg: str = "mean",
    broadcast_bytes: int = BROADCAST_BYTES,
    work: Work | None = None,
    part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """The ``k`` documents of largest MaxSim per query, ``rank`` from 1, ties by id; exact.

    All tokens of a document lie in one row. A few balls hold them, and a query token is no nearer to
    any token than to a ball's centre plus its radius, so their mean bounds the score from above. Documents whose
    bound does not reach the k-th score that the task has seen are skipped. Queries go out in waves, and k documents a query
    leave a task. Documents of more than ``part_tokens`` tokens are scored from the maxima of their parts.
    """
    kinds = dict(query_tokens.dtypes)["query_id"], dict(doc_tokens.dtypes)["doc_id"]
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    spark = doc_tokens.sparkSession
    asked = cut_lineage(token_rows(query_tokens, "query_id", 1 << 30).select("query_id", "n", "tokens"))
    rows = token_rows(doc_tokens, "doc_id", part_tokens)
    width = asked.agg(F.max(F.octet_length("tokens"))).first()[0] or 8

    def search(wave: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast((wave.column("query_id").combine_chunks(), wave.column("n").to_pylist(), wave.column("tokens").to_pylist()))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, counts, packed = shared.value
            probe = np.concatenate([np.frombuffer(p, np.float64).reshape(n, -1) for n, p in zip(counts, packed, strict=True)])
            first = np.concatenate([[0], np.cumsum(counts)])
            weights = 1 / np.asarray(counts, float) if agg == "mean" else np.ones(len(counts))
            best = Best(len(counts), k)
            met = scored = 0
            kind = None
            for batch in batches:
                kind = batch.column(0).type
                keys = _values(batch.column(0))
                docs = [np.frombuffer(p, np.float64).reshape(n, -1) for n, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                held = [balls(d) for d in docs]
                edge = np.concatenate([[0], np.cumsum([len(r) for _, r in held])])
                centres, radii = np.concatenate([c for c, _ in held]), np.concatenate([r for _, r in held])
                for q in range(len(counts)):
                    own = probe[first[q] : first[q + 1]]
                    near = np.maximum.reduceat(own @ centres.T + radii, edge[:-1], axis=1)
                    # a hair above the exact value, so that rounding never skips a document
                    bound = np.minimum(near, 1.0).sum(axis=0) * weights[q] + 1e-9
                    order = np.argsort(-bound, kind="stable")
                    met += len(order)
                    at, step = 0, max(16, 2 * k)
                    while at < len(order) and bound[order[at]] >= best.least[q]:
                        chosen = order[at : at + step]
                        chosen = chosen[bound[chosen] >= best.least[q]]
                        score = np.array([np.round((own @ docs[d].T).max(axis=1).sum() * weights[q], 10) for d in chosen])
                        scored += len(chosen)
                        good = score >= best.least[q]
                        best.add(np.full(int(good.sum()), q), score[good], keys[chosen[good]])
                        mine = best.score[best.query == q]
                        if len(mine) >= k:
                            best.least[q] = max(best.least[q], -np.partition(-mine, k - 1)[k - 1])
                        at += step
            best.settle()
            if work is not None:
                work.met.add(met)
                work.scored.add(scored)
            if len(best.query):
                data = [names.take(pa.array(best.query)), pa.array(best.doc.tolist(), kind), pa.array(best.score)]
                yield pa.RecordBatch.from_arrays(data, names=["query_id", "doc_id", "score"])

        return rows.filter("parts = 1").select("doc_id", "n", "tokens").mapInArrow(task, schema)

    parts = [search(wave) for wave in _waves(asked, width + 32 * k + 16, broadcast_bytes)]
    cut = rows.filter("parts > 1").select("doc_id").distinct()
    long = cut_lineage(doc_tokens.join(cut, "doc_id", "left_semi"))
    if long.limit(1).count():
        parts.append(maxsim(query_tokens, long, agg, broadcast_bytes=broadcast_bytes).withColumn("score", F.round("score", 10)).select("query_id", "doc_id", "score"))
    return _ranked(parts, k, "query_id", "doc_id", spark.createDataFrame([], schema))


def score_pairs(pairs: DataFrame, query_rows: DataFrame, doc_rows: DataFrame, agg: str = "mean") -> DataFrame:
    """MaxSim of given ``(query_id, doc_id)`` pairs only: each pair fetches both token blocks and is scored in its row.

    ``query_rows`` and ``doc_rows`` come from :func:`token_rows`; the parts of a long document are put together by
    the largest value of each query token.
    """
    kinds = dict(pairs.dtypes)
    asked = query_rows.select("query_id", F.col("n").alias("asked_n"), F.col("tokens").alias("asked"))
    met = pairs.join(doc_rows, "doc_id").join(asked, "query_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for n, tokens, m, own in zip(*[batch.column(c).to_pylist() for c in ("n", "tokens", "asked_n", "asked")], strict=True):
                similar = np.frombuffer(own, np.float64).reshape(m, -1) @ np.frombuffer(tokens, np.float64).reshape(n, -1).T
                best.append(similar.max(axis=1).tolist())
            data = [batch.column("query_id"), batch.column("doc_id"), batch.column("parts"), pa.array(best, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(data, names=["query_id", "doc_id", "parts", "best"])

    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, parts int, best array<double>"
    found = met.select("query_id", "doc_id", "parts", "n", "tokens", "asked_n", "asked").mapInArrow(task, schema)
    single = found.filter("parts = 1").select("query_id", "doc_id", "best")
    pieces = found.filter("parts > 1").select("query_id", "doc_id", F.posexplode("best").alias("at", "x"))
    whole = pieces.groupBy("query_id", "doc_id", "at").agg(F.max("x").alias("x")).groupBy("query_id", "doc_id").agg(F.collect_list("x").alias("best"))
    total = F.aggregate("best", F.lit(0.0), lambda a, x: a + x)
    score = total / F.size("best") if agg == "mean" else total
    return single.unionByName(whole).select("query_id", "doc_id", score.alias("score"))


def rerank(query_tokens: DataFrame, doc_tokens: DataFrame, candidates: int, agg: str = "mean", decimals: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``candidates`` documents per query by the cosine of mean vectors, put in MaxSim order: ``score`` and ``rank``.

    No more than ``candidates`` pairs a query are scored.
    """
    means = mean_vectors(doc_tokens, ["doc_id"], "vector", "embedding").withColumn("embedding", unit(F.col("embedding")))
    asked = mean_vectors(query_tokens, ["query_id"], "vector")
    first = cut_lineage(top_k(asked, means, candidates, doc_id="doc_id", broadcast_bytes=broadcast_bytes).select("query_id", "doc_id"))
    wanted = doc_tokens.join(small_side(first.select("doc_id").distinct()), "doc_id", "left_semi")
    scores = score_pairs(first, token_rows(query_tokens, "query_id", 1 << 30), token_rows(wanted, "doc_id"), agg)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", decimals)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order))


def class_scores(
    text_tokens: DataFrame, example_tokens: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Score of each text for each class: the best MaxSim over the class's examples.

    Inputs hold ``(text_id, token_no, vector)`` and ``(class, class_no, example_no, token_no, vector)``.
    The text is the query side. Tasks send one partial sum per text and example.
    """
    t_type = dict(text_tokens.dtypes)["text_id"]
    c_type = dict(example_tokens.dtypes)["class"]
    # All tokens of one example travel together, so its maximum is complete in one block.
    # one group holds the tokens of one example text
    gathered = cut_lineage(
        example_tokens.groupBy("class", "class_no", "example_no").agg(
            F.collect_list("vector").alias("vectors"), F.max(F.size("vector")).alias("dim")
        )
    )
    flat = gathered.select("class", "class_no", "example_no", "dim", F.flatten("vectors").alias("vector"))
    dims = text_tokens.select(F.size("vector").alias("d")).limit(1).first()
    dim = dims["d"] if dims else 1

    def compute_rows(docs, matrix, names, probe_rows):
        unit = unit_rows(matrix)
        codes, uniques = pd.factorize(docs["text_id"])
        order, values, starts = _segments(codes)
        counts = np.diff(np.append(starts, len(codes)))
        out = []
        for position, vector in enumerate(probe_rows):
            tokens = unit_rows(np.asarray(vector, dtype=np.float64).reshape(-1, dim))
            best = (unit @ tokens.T).max(axis=1)
            out.append(
                pd.DataFrame(
                    {
                        "text_id": np.asarray(uniques)[values],
                        "class": names["class"].iloc[position],
                        "class_no": names["class_no"].iloc[position],
                        "example_no": names["example_no"].iloc[position],
                        "total": np.add.reduceat(best[order], starts),
                        "tokens": counts,
                    }
                )
            )
        return pd.concat(out)

    size = gathered.agg(F.count("*").alias("n"), F.sum(F.size("vectors") * F.col("dim")).alias("cells")).first()
    blocks = max(1, math.ceil((size["n"] or 0) / QUERY_BLOCK))
    held = flat.groupBy(F.pmod(F.xxhash64("class", "example_no"), F.lit(blocks)).cast("int").alias("_block")).agg(
        F.collect_list(F.struct("class", "class_no", "example_no", "vector")).alias("queries")
    )
    packed = _pack(text_tokens, ["text_id"], "vector")
    pairs = _place(packed, held, blocks, (size["cells"] or 0) * 8 <= broadcast_bytes)

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                values = row._asdict()
                docs = pd.DataFrame({"text_id": values["text_id"]})
                matrix = np.frombuffer(values["vectors"], dtype="<f8").reshape(values["rows"], -1)
                asked = values["queries"]
                names = pd.DataFrame({c: [q[c] for q in asked] for c in ("class", "class_no", "example_no")})
                yield compute_rows(docs, matrix, names, [q["vector"] for q in asked])

    partial = pairs.select("text_id", "rows", "vectors", "queries").mapInPandas(
        compute,
        f"text_id {t_type}, class {c_type}, class_no int, example_no int, total double, tokens bigint",
    )
    per_example = partial.groupBy("text_id", "class", "class_no", "example_no").agg(
        (F.sum("total") / F.sum("tokens")).alias("score")
    )
    return per_example.groupBy("text_id", "class", "class_no").agg(F.max("score").alias("score"))


def predicted(scores: DataFrame) -> DataFrame:
    """Best class per text, the first listed one on ties, with its score and all scores as a map.

    The group of a text holds one row per class.
    """
    rank = F.struct("score", -F.col("class_no"))
    return scores.groupBy("text_id").agg(
        F.max_by("class", rank).alias("predicted_class"),
        F.max("score").alias("confidence"),
        F.map_from_entries(F.collect_list(F.struct(F.col("class").cast("string"), "score"))).alias("class_scores"),
    )
