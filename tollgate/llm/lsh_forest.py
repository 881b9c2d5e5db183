"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more.

Candidates come from fixed-depth bands, not from an LSH forest: the similarity is fixed,
so the depth at which two documents at the threshold share a prefix in at least one of
``TREES`` trees with probability ``TARGET`` is worked out once, from ``LONGEST`` down, and
only that many MinHash values are computed. Texts with the same prefix in a tree, called a
subtrie, are a set of candidates; there are no sorted tries and no shortening level by level. Documents with the same words are one text. Within a subtrie, pairs
whose whole signatures agree clearly less than the threshold are put aside, and the
others join texts into candidate groups; the groups then get their shingles, once, and
all pairs of a group are verified exactly.

Nothing is emitted per pair. Subtries and groups of more than ``BLOCK`` texts are cut
into blocks, and each pair of blocks is a piece of work of its own, so that a group
that holds a third of all documents spreads over the cluster. A piece gives the number
of links per text and one edge per text towards its group.

Words are ``[^\\x20\\x09-\\x0D]+``, case kept. Defined cases: a null text or one without
words is in no group; a text of fewer than five words has one shingle, all its words; a
null doc_id is in no group; repeated rows and equal texts share class and links; only
``doc_id`` and ``text`` are read, other columns may have any name. Shingles and texts
are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm import store
from tollgate.llm import wordbytes as wb
from tollgate.llm.components import components

SHINGLE_WORDS = 5
#: The similarity, as a fraction of whole numbers: links are exact.
SIMILARITY = (4, 5)
TREES = 20
LONGEST = 8
TARGET = 0.999
#: How far the agreement of signatures may fall below the similarity, in standard deviations.
DEVIATIONS = 4.5
BLOCK = 512
COLUMNS = 4096


def depth_for(similarity: float, trees: int = TREES, longest: int = LONGEST, target: float = TARGET) -> int:
    """The longest prefix that pairs at the similarity share in some tree with the target probability."""
    for depth in range(longest, 0, -1):
        if 1 - (1 - similarity**depth) ** trees >= target:
            return depth
    raise ValueError("the forest has too few trees for the target")


DEPTH = depth_for(SIMILARITY[0] / SIMILARITY[1])
HASHES = TREES * DEPTH
MULTIPLIERS = wb.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * wb.U(0x9E3779B97F4A7C15)) | wb.U(1)


def least_agreement() -> int:
    s = SIMILARITY[0] / SIMILARITY[1]
    return int(HASHES * s - DEVIATIONS * (HASHES * s * (1 - s)) ** 0.5)


def shingles(column: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all shingles, first shingle of each text, key of each text, words of each text)."""
    chunk = wb.Chunk(column)
    starts, ends, firsts = chunk.words()
    words = chunk.hashes(starts, ends)
    counts = np.diff(firsts)
    row = wb.row_of(firsts)
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(firsts[:-1], counts).astype(np.uint64)
    terms = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(wb.mix(words ^ wb.mix(place)), out=terms[1:])
    keys = wb.mix(terms[firsts[1:]] - terms[firsts[:-1]] + counts.astype(np.uint64))
    sizes = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    at = wb.ranges(firsts[:-1], sizes)
    out = words[at]
    last = len(words) - 1
    for i in range(1, size):
        to = np.minimum(at + i, max(last, 0))
        inside = (at + i <= last) & (row[to] == row[at]) if len(at) else np.zeros(0, bool)
        out = wb.mix(out * wb.U(3)) + np.where(inside, words[to], wb.U(0)) if len(at) else out
    return wb.mix(out), np.concatenate([[0], np.cumsum(sizes)]), keys, counts


def signatures(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """MinHash values, one row per text that has a shingle."""
    filled = firsts[:-1][np.diff(firsts) > 0]
    out = np.empty((len(filled), HASHES), np.uint32)
    product, high = np.empty_like(values), np.empty(len(values), np.uint32)
    for k in range(HASHES if len(filled) else 0):
        np.multiply(values, MULTIPLIERS[k], out=product)
        np.right_shift(product, wb.U(32), out=product)
        np.copyto(high, product, casting="unsafe")
        out[:, k] = np.minimum.reduceat(high, filled)
    return out


def labels(signature: np.ndarray) -> np.ndarray:
    """The key of each text's subtrie in each tree."""
    out = np.repeat(wb.mix(np.arange(TREES, dtype=np.uint64))[None, :], len(signature), 0)
    prefixes = signature.reshape(-1, TREES, DEPTH).astype(np.uint64)
    for level in range(DEPTH):
        out = wb.mix(out + prefixes[:, :, level])
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, the key of the text (null without words), its signature, and a digest of the text as it stands."""

    @wb.sparing
    def task(batches):
        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                part = batch.slice(first, rows)
                values, firsts, keys, counts = shingles(part.column("text"))
                some = counts > 0
                packed: list = [None] * rows
                for i, s in zip(np.flatnonzero(some).tolist(), signatures(values, firsts), strict=True):
                    packed[i] = s.tobytes()
                columns = [part.column("doc_id"), pa.array(keys.view(np.int64), mask=~some), pa.array(packed, pa.binary()), part.column("digest")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "signature", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(task, "doc_id long, key long, signature binary, digest long")


def tree_rows(texts: DataFrame) -> DataFrame:
    """(label, key): one row per tree."""

    @wb.sparing
    def task(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                signature = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
                found = labels(signature).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.repeat(np.asarray(part.column("key")), TREES))], names=["label", "key"])

    return texts.select("key", "signature").mapInArrow(task, "label long, key long")


def in_block_pairs(members: DataFrame, group: str, node: str) -> DataFrame:
    """Rows with a group size ``n``, repeated for every pair of blocks (low, high) that their block is in."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(7)), blocks).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "n")
    return rows.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", node)


def pieces(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The runs of rows that agree in ``names``, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(c)) for c in names]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[low] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def stars(near: np.ndarray) -> np.ndarray:
    """For a symmetric yes/no matrix, the lowest row that each row is connected to."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def crossing(own: np.ndarray, low: int, high: int) -> np.ndarray:
    """Pairs that this pair of blocks answers for."""
    if low == high:
        return ~np.eye(len(own), dtype=bool)
    return own[:, None] != own[None, :]


def candidate_links(texts: DataFrame) -> DataFrame:
    """(a, b): edges that join texts with similar signatures within a subtrie."""
    rows = tree_rows(texts)
    shared = store.written(rows.groupBy("label").agg(F.count("*").alias("n")).where("n > 1"), "subtries")
    members = store.written(rows.join(shared, "label"), "subtrie-members")
    joined = in_block_pairs(members.join(texts, "key"), "label", "key")
    least = least_agreement()

    @wb.sparing
    def task(batches):
        a, b = [], []
        for piece in pieces(batches, ["label", "low", "high"]):
            if len(piece) < 2:
                continue
            keys, own = np.asarray(piece["key"]), np.asarray(piece["own"])
            signature = np.frombuffer(b"".join(piece["signature"].to_pylist()), np.uint32).reshape(-1, HASHES)
            agree = np.zeros((len(keys), len(keys)), np.int16)
            for k in range(HASHES):
                agree += signature[:, k, None] == signature[None, :, k]
            near = (agree >= least) & crossing(own, piece["low"][0].as_py(), piece["high"][0].as_py())
            label = stars(near)
            moved = label != np.arange(len(keys))
            a.append(keys[moved])
            b.append(keys[label[moved]])
            if len(a) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return joined.select("label", "low", "high", "own", "key", "signature").mapInArrow(task, "a long, b long")


def intersections(values: np.ndarray, sizes: np.ndarray, keep_rows: np.ndarray, keep_columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets, given one after the other, between two selections of them."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, heads, which = wb.groups(values)
    often = np.bincount(which, minlength=len(heads)) > 1
    number = np.cumsum(often) - 1
    chosen = often[which]
    row, column = row[chosen], number[which[chosen]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(keep_rows), len(keep_columns)), np.float32)
    total = int(often.sum())
    for at in range(0, total, COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sizes), COLUMNS), np.float32)
        part[row[low:high], column[low:high] - at] = 1
        out += part[keep_rows] @ part[keep_columns].T
    return out.astype(np.int64)


def verified(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, links, root): per text and pair of blocks the number of exact links, and the text it is joined to.

    ``groups`` has doc_id, key, label and n (the size of the group) for one document per text.
    """

    @wb.sparing
    def sets(batches):
        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                part = batch.slice(first, rows)
                values, firsts, keys, _ = shingles(part.column("text"))
                same = keys.view(np.int64) == np.asarray(part.column("key"))
                packed = [np.unique(values[a:b]).tobytes() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
                columns = [part.column("label"), part.column("key"), part.column("n"), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "key", "n", "shingles"]).filter(pa.array(same))

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(groups.hint("shuffle_hash"), "doc_id")
    rows = in_block_pairs(held.select("label", "key", "n", "text").mapInArrow(sets, "label long, key long, n long, shingles binary"), "label", "key")

    @wb.sparing
    def task(batches):
        out: list[list[np.ndarray]] = []
        for piece in pieces(batches, ["label", "low", "high"]):
            keys, first = np.unique(np.asarray(piece["key"]), return_index=True)
            if len(keys) < 2:
                continue
            piece = piece.take(pa.array(first))
            own = np.asarray(piece["own"])
            held_sets = [np.frombuffer(x, np.uint64) for x in piece["shingles"].to_pylist()]
            sizes = np.asarray(list(map(len, held_sets)))
            low, high = piece["low"][0].as_py(), piece["high"][0].as_py()
            left, right = (np.flatnonzero(own == low), np.flatnonzero(own == high)) if low != high else (np.arange(len(keys)),) * 2
            common = np.zeros((len(keys), len(keys)), np.int64)
            found = intersections(np.concatenate(held_sets), sizes, left, right)
            common[np.ix_(left, right)] = found
            common[np.ix_(right, left)] = found.T
            top, bottom = SIMILARITY
            near = bottom * common >= top * (sizes[:, None] + sizes[None, :] - common)
            near &= crossing(own, low, high)
            links = near.sum(1)
            some = links > 0
            out.append([keys[some], links[some], keys[stars(near)][some]])
            if len(out) >= 2000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True)], names=["key", "links", "root"])

    return rows.select("label", "low", "high", "own", "key", "shingles").mapInArrow(task, "key long, links long, root long")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and per text its key, smallest doc_id, label of its group and number of links."""
    rows = store.written(signed(docs), "forest-signed")
    known = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    texts = store.written(known.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "forest-texts")
    links = store.written(candidate_links(texts.select("key", "signature")), "forest-links")
    groups = components(links)
    sizes = store.written(groups.groupBy("label").agg(F.count("*").alias("n")), "forest-sizes")
    placed = groups.withColumnRenamed("node", "key").join(sizes, "label").join(texts.select("key", "doc_id"), "key")
    found = store.written(verified(docs, placed.select("doc_id", "key", "label", "n")), "forest-verified")
    joined = components(found.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    texts = texts.select("key", "doc_id").join(joined.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left")
    texts = texts.select("key", "doc_id", F.coalesce("label", "key").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows, store.written(texts, "forest-labelled")


def join(docs: DataFrame) -> DataFrame:
    """One row per document: class_id, the smallest doc_id of its group, and n_links, the other texts within reach.

    A group is what links and equal texts connect; a document without any is its own class.
    """
    rows, texts = grouped(docs)
    known = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    lowest = store.written(texts.groupBy("label").agg(F.min("doc_id").alias("class_id")), "forest-lowest")
    classes = store.written(texts.join(lowest, "label").select("key", "class_id", "n_links"), "forest-classes")
    out = known.select("doc_id", "key").join(classes, "key").select("doc_id", "class_id", "n_links")
    alone = rows.where("key IS NULL OR doc_id IS NULL")
    return out.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group with all its columns: the one of the smallest doc_id.

    Rows are told apart by doc_id and text, so ids may repeat: of the texts under one id each is
    kept or dropped for itself, and where one group has several texts of its smallest id, the one
    of the smallest digest stays. Rows equal in both are copies, of which one stays, whatever
    their other columns hold. Documents without a doc_id or without words are in no group and stay.
    """
    rows, texts = grouped(docs)
    known = rows.where("key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest", "key")
    placed = store.written(known.join(texts.select("key", "label"), "key").select("label", F.struct("doc_id", "digest").alias("row")), "forest-placed")
    best = store.written(placed.groupBy("label").agg(F.min("row").alias("best")), "forest-best")
    losers = placed.join(best, "label").where("row != best").select("row.doc_id", "row.digest").distinct()
    losers = store.written(losers, "forest-losers")
    place, digest, number = (free_name(n, docs) for n in ("place", "digest", "number"))
    marked = docs.withColumns({place: F.col("doc_id").cast("long"), digest: F.xxhash64("text")})
    # the documents move once: the anti-join finds them dealt by the columns of the window
    copies = Window.partitionBy(place, digest).orderBy(place)
    single = marked.withColumn(number, F.row_number().over(copies)).where(F.col(number) == 1)
    dropped = losers.select(F.col("doc_id").alias(place), F.col("digest").alias(digest))
    return single.join(dropped, [place, digest], "left_anti").select(docs.columns)


def free_name(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
texts AS (SELECT w, min(doc_id) AS id FROM words WHERE len(w) > 0 GROUP BY w),
shingles AS (
  SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM texts, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (
  SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT id AS a, id AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN words w ON w.doc_id = d.doc_id LEFT JOIN texts t ON t.w = w.w
LEFT JOIN classes c ON c.a = t.id LEFT JOIN counts k ON k.a = t.id
"""
