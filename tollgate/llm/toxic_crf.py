"""Toxic spans by a linear-chain conditional random field; documents are scored by its marginals.

A text is a sequence of words: runs of ASCII letters, digits and all code points beyond ASCII, in lower case. The field has
two labels, inside and outside of a toxic span. Its features are the word, its starts
of 3 to 6 and its endings of 3 and 4 characters, and the words on both sides, hashed into one weight table.

The labels of the tables are per document, so tokens are labelled first. A word, or a
start of words, is a toxic unit if toxic training documents hold it in far more different
surroundings than others do, by a likelihood-ratio test that allows for the number of
units. A pair of neighbours counts once per unit, so copies of a document add nothing.
Tokens with a toxic unit in a toxic document are inside; all others are outside.

Forward-backward gives each token's marginal. A document's score is a logistic function
of its largest marginal and of the expected number of toxic words, fitted on training
documents that the field has not seen. Spans are runs of tokens with a marginal of 0.5 or more.

Training uses a bounded sample: at most ``MOST_TOXIC`` toxic and ``MOST_CLEAN`` other
labelled documents, those of smallest hash, and of each kind as many as fit into
``SAMPLE_BYTES``, always whole. Rows whose crc32 of the id is divisible by ``FOLDS`` are
never looked at. Scoring reads nothing but the text.

Defined cases: a null or empty text has no words and gets the score of the smallest
marginals; a null doc_id counts as an empty text in the checksum; null labels are no
labels; if an id has several labels, one toxic label is enough; without labels of both
kinds the score is the share of toxic ones (one half without any); an empty table gives no row; only
``doc_id``, ``text`` and ``toxic`` are read; repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm import wordbytes as wb

FOLDS = 5
MOST_TOXIC = 2_000
MOST_CLEAN = 2_000
SAMPLE_BYTES = 4 << 20
BITS = 18
STARTS = (3, 4, 5, 6)
ENDINGS = (3, 4)
#: Units of the token labels: the word itself (0) and these starts.
UNIT_STARTS = (0, 4, 5, 6)
RATIO = 8.0
ROUNDS = 40
RATE = 0.3
PRIOR = 0.02
BLOCK = 64
U = np.uint64

WORD = wb.table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
SCORED = "doc_id long, held_out boolean, score double, predicted int, n_spans long, spans string"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Tokens:
    """Words of a column of texts: distinct words with their features, and what stands where."""

    def __init__(self, column: pa.Array):
        self.chunk = chunk = wb.Chunk(pc.utf8_lower(column.cast(pa.large_string())))
        self.starts, self.ends, self.firsts = chunk.words(WORD)
        hashes = chunk.hashes(self.starts, self.ends)
        order, heads, self.word = wb.groups(hashes)
        first = order[heads]
        begin, end = self.starts[first], self.ends[first]
        self.hash = hashes[first]
        lead = (chunk.bytes & 0xC0) != 0x80
        self.places = np.flatnonzero(lead)
        at = np.searchsorted(self.places, begin)
        to = np.searchsorted(self.places, end)
        self.sizes = to - at
        places = np.append(self.places, len(chunk.bytes))
        start = {n: chunk.hashes(begin, places[np.minimum(at + n, to)]) for n in STARTS}
        units = [self.hash, *(start[n] for n in STARTS), *(chunk.hashes(places[np.maximum(to - n, at)], end) for n in ENDINGS)]
        self.units = np.stack([self.hash if n == 0 else start[n] for n in UNIT_STARTS], 1) if len(first) else np.zeros((0, len(UNIT_STARTS)), U)
        self.own = np.stack([slot(u, kind) for kind, u in enumerate(units)], 1) if len(first) else np.zeros((0, len(units)), np.int64)
        self.before, self.after = slot(self.hash, 90), slot(self.hash, 91)
        head = np.zeros(len(self.starts) + 1, bool)
        head[self.firsts[:-1]] = True
        self.head = head[:-1]  # the first word of its text
        self.tail = np.append(self.head[1:], True) if len(self.starts) else self.head
        self.left = np.flatnonzero(~self.head)  # tokens with a neighbour on the left
        self.right = np.flatnonzero(~self.tail)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """The weight of being inside, for every token."""
        scores = weights[self.own].sum(1)[self.word] + weights[-1]
        scores[self.left] += weights[self.before][self.word[self.left - 1]]
        scores[self.right] += weights[self.after][self.word[self.right + 1]]
        return scores

    def gradient(self, error: np.ndarray, size: int) -> np.ndarray:
        """Sums of the tokens' errors per weight."""
        n = len(self.own)
        out = np.zeros(size)
        own = np.bincount(self.word, error, n)
        out += np.bincount(self.own.ravel(), np.repeat(own, self.own.shape[1]), size)
        out += np.bincount(self.before, np.bincount(self.word[self.left - 1], error[self.left], n), size)
        out += np.bincount(self.after, np.bincount(self.word[self.right + 1], error[self.right], n), size)
        out[-1] = error.sum()
        return out

    def surroundings(self) -> np.ndarray:
        """A number for the words on both sides of every token."""
        words = self.hash[self.word]
        out = np.full(len(words), 7, U)
        out[self.left] ^= wb.mix(words[self.left - 1] + U(1))
        out[self.right] ^= wb.mix(words[self.right + 1] * U(3) + U(2))
        return out


def slot(hashes: np.ndarray, kind: int) -> np.ndarray:
    """The weight of a feature; the last weight is the bias."""
    return (wb.mix(hashes ^ wb.mix(np.array([kind + 1], U))) >> U(64 - BITS)).astype(np.int64)


def chain(inside: np.ndarray, head: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors (2 x n), and the factors of each step (2 x 2 x n), over texts laid end to end.

    A step is a 2 x 2 matrix; that of the first word of a text has equal rows, so nothing passes
    from text to text. Blocks of steps are multiplied side by side, the block products one after the
    other, and then every block goes on from what came before it.
    """
    n = len(inside)
    blocks = -(-n // BLOCK)
    p = np.empty((2, n))
    p[1] = 0.5 * (1 + np.tanh(0.5 * inside))
    np.subtract(1, p[1], out=p[0])
    np.maximum(p, 1e-300, out=p)
    step = np.empty((2, 2, n))
    for i in range(2):
        for j in range(2):
            np.multiply(np.where(head, begin[j], moves[i, j]), p[j], out=step[i, j])
    side = np.zeros((2, 2, blocks * BLOCK))
    side[0, 0, n:] = side[1, 1, n:] = 1
    side[:, :, :n] = step
    side = np.ascontiguousarray(side.reshape(2, 2, blocks, BLOCK).transpose(3, 0, 1, 2))  # by place in the block
    whole = side[0].copy()
    for j in range(1, BLOCK):
        a, b, c, d = whole[0, 0], whole[0, 1], whole[1, 0], whole[1, 1]
        s = side[j]
        whole = np.stack([a * s[0, 0] + b * s[1, 0], a * s[0, 1] + b * s[1, 1], c * s[0, 0] + d * s[1, 0], c * s[0, 1] + d * s[1, 1]])
        whole /= whole.sum(0)
        whole = whole.reshape(2, 2, blocks)
    before, after = np.empty((2, blocks)), np.empty((2, blocks))
    products = list(zip(*whole.reshape(4, blocks).tolist(), strict=True))
    x = y = 0.5
    for i, (a, b, c, d) in enumerate(products):
        before[0, i], before[1, i] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    x = y = 0.5
    for i in range(blocks - 1, -1, -1):
        after[0, i], after[1, i] = x, y
        a, b, c, d = products[i]
        x, y = a * x + b * y, c * x + d * y
        x, y = x / (x + y), y / (x + y)
    forward, backward = np.empty((2, blocks, BLOCK)), np.empty((2, blocks, BLOCK))
    x, y = before
    for j in range(BLOCK):
        s = side[j]
        x, y = x * s[0, 0] + y * s[1, 0], x * s[0, 1] + y * s[1, 1]
        total = x + y
        x /= total
        y /= total
        forward[0, :, j], forward[1, :, j] = x, y
    x, y = after
    for j in range(BLOCK - 1, -1, -1):
        backward[0, :, j], backward[1, :, j] = x, y
        s = side[j]
        x, y = s[0, 0] * x + s[0, 1] * y, s[1, 0] * x + s[1, 1] * y
        total = x + y
        x /= total
        y /= total
    return forward.reshape(2, -1)[:, :n], backward.reshape(2, -1)[:, :n], step


def marginals(inside: np.ndarray, head: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The probability of each token to be inside a toxic span."""
    if not len(inside):
        return np.zeros(0)
    forward, backward, _ = chain(inside, head, moves, begin)
    both = forward * backward
    return both[1] / both.sum(0)


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray
    begin: np.ndarray
    logistic: tuple[float, float, float]

    def tag(self, tokens: Tokens) -> np.ndarray:
        return marginals(tokens.emissions(self.weights), tokens.head, self.moves, self.begin)

    def scores(self, tokens: Tokens, inside: np.ndarray) -> np.ndarray:
        a, b, c = self.logistic
        top, many = evidence(tokens, inside)
        return 0.5 * (1 + np.tanh(0.5 * (a + b * top + c * many)))


def evidence(tokens: Tokens, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the largest marginal as log odds, and the logarithm of the expected number of toxic words."""
    rows = len(tokens.firsts) - 1
    top = np.zeros(rows)
    np.maximum.at(top, wb.row_of(tokens.firsts), inside)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.log(top / (1 - top)), np.log(np.maximum(wb.per_row(inside, tokens.firsts), 0) + 0.01)


def toxic_units(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Which distinct words are toxic units or begin with one; ``toxic`` says it of each token's document."""
    around = tokens.surroundings()
    flagged = np.zeros(len(tokens.hash), bool)
    for kind in range(tokens.units.shape[1]):
        unit = tokens.units[:, kind]
        different, which = np.unique(unit, return_inverse=True)
        mine = which[tokens.word]
        counts = []
        for side in (toxic, ~toxic):
            seen = np.unique(wb.mix(different[mine[side]]) ^ around[side], return_index=True)[1]
            counts.append(np.bincount(mine[side][seen], minlength=len(different)).astype(float))
        a, b = counts
        share = a.sum() / max(a.sum() + b.sum(), 1)
        total = a + b
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 2 * (np.where(a > 0, a * np.log(a / (total * share)), 0) + np.where(b > 0, b * np.log(b / (total * (1 - share))), 0))
        often = a / max(a.sum(), 1) > RATIO * b / max(b.sum(), 1)
        flagged |= (often & (gain > 2 * np.log(len(different)) + 6))[which]
    return flagged


def fit_field(tokens: Tokens, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, moves and first-word factors of the field, by gradient steps on the likelihood of the labels."""
    size = (1 << BITS) + 1
    y = inside.astype(float)
    weights, moves, begin = np.zeros(size), np.zeros((2, 2)), np.zeros(2)
    one, two = [np.zeros(size + 6) for _ in range(2)]
    label = inside.astype(np.int64)
    linked = tokens.left
    seen = np.bincount(label[linked - 1] * 2 + label[linked], minlength=4).reshape(2, 2)
    first = np.bincount(label[tokens.head], minlength=2)
    values = np.zeros(size + 6)
    for k in range(1, ROUNDS + 1):
        weights, moves, begin = values[:size], values[size : size + 4].reshape(2, 2), values[size + 4 :]
        forward, backward, step = chain(tokens.emissions(weights), tokens.head, np.exp(moves), np.exp(begin))
        p = forward * backward
        p /= p.sum(0)
        joint = forward[:, None, linked - 1] * step[:, :, linked] * backward[None, :, linked]
        joint /= joint.sum((0, 1))
        slope = np.concatenate([tokens.gradient(y - p[1], size), (seen - joint.sum(2)).ravel(), first - p[:, tokens.head].sum(1)])
        slope -= PRIOR * values
        one = 0.9 * one + 0.1 * slope
        two = 0.99 * two + 0.01 * slope * slope
        values = values + RATE * (1 - k / (ROUNDS + 20)) * (one / (1 - 0.9**k)) / (np.sqrt(two / (1 - 0.99**k)) + 1e-8)
    return values[:size].copy(), np.exp(values[size : size + 4]).reshape(2, 2), np.exp(values[size + 4 :])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression with a weak prior, by Newton's steps."""
    design = np.column_stack([np.ones(len(x)), x])
    prior = np.diag([1e-3] + [1e-1] * x.shape[1])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 0.5 * (1 + np.tanh(0.5 * design @ beta))
        slope = design.T @ (y - p) - prior @ beta
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + prior
        move = np.linalg.solve(curve, slope)
        beta = beta + np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-8:
            break
    return beta


def train(texts: list[str], toxic: list[bool], fold: list[int]) -> Model:
    """Texts of an even fold teach the field, the others the logistic function (all of them both, if a side lacks a kind)."""
    y = np.array(toxic, bool)
    if y.all() or not y.any():
        share = 0.5 if not len(y) else min(max(y.mean(), 1e-3), 1 - 1e-3)
        return Model(np.zeros((1 << BITS) + 1), np.ones((2, 2)), np.ones(2), (float(np.log(share / (1 - share))), 0.0, 0.0))
    first = np.array(fold) % 2 == 0
    if not all(y[side].any() and not y[side].all() for side in (first, ~first)):
        first = np.ones(len(y), bool)
        second = first
    else:
        second = ~first
    column = pa.array(texts, pa.large_string())
    tokens = Tokens(column.filter(pa.array(first)))
    ours = np.repeat(y[first], np.diff(tokens.firsts))
    field = fit_field(tokens, toxic_units(tokens, ours)[tokens.word] & ours)
    model = Model(*field, (0.0, 0.0, 0.0))
    tokens = Tokens(column.filter(pa.array(second)))
    x = np.column_stack(evidence(tokens, model.tag(tokens)))
    use = np.ones(2, bool)
    while True:  # more evidence never lowers a score: a measure with a negative weight is left out
        beta = np.zeros(3)
        beta[np.append(True, use)] = fit_logistic(x[:, use], y[second].astype(float))
        if (beta[1:] >= 0).all():
            return Model(*field, tuple(map(float, beta)))
        use &= beta[1:] >= 0


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[bool], list[int]]:
    """Texts, labels and folds of the bounded training sample, in a fixed order."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.withColumn("place", F.xxhash64("doc_id"))
    few = None
    for kind, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        part = known.where(F.col("toxic") == kind).orderBy("place", "doc_id").limit(most)
        few = part if few is None else few.unionByName(part)
    rows = few.collect()
    if not rows:
        return [], [], []
    spark = docs.sparkSession
    chosen = spark.createDataFrame(rows, few.schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.octet_length("text")).alias("bytes")).collect()
    size = {r["doc_id"]: r["bytes"] for r in sizes}
    wanted = []
    for kind in (1, 0):
        left = SAMPLE_BYTES
        for row in sorted((r for r in rows if r["toxic"] == kind and r["doc_id"] in size), key=lambda r: (r["place"], r["doc_id"])):
            if size[row["doc_id"]] <= left:
                left -= size[row["doc_id"]]
                wanted.append((row["doc_id"], size[row["doc_id"]]))
    if not wanted:
        return [], [], []
    wanted = spark.createDataFrame(wanted, "doc_id long, bytes int")
    found = texts.join(F.broadcast(wanted), "doc_id").where(F.octet_length("text") == F.col("bytes")).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    of = {r["doc_id"]: r for r in rows}
    found = sorted(found, key=lambda r: (of[r["doc_id"]]["place"], r["doc_id"]))
    return [r["text"] for r in found], [of[r["doc_id"]]["toxic"] > 0 for r in found], [of[r["doc_id"]]["place"] >> 7 for r in found]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*sample(docs, labels))


def spans_of(tokens: Tokens, inside: np.ndarray) -> list[str]:
    """Per text: start:end (code points) of each run of inside tokens, comma-joined."""
    rows = len(tokens.firsts) - 1
    out = [""] * rows
    hot = inside >= 0.5
    if not hot.any():
        return out
    begins = np.flatnonzero(hot & (tokens.head | ~np.append(False, hot[:-1])))
    ends = np.flatnonzero(hot & (tokens.tail | ~np.append(hot[1:], False)))
    row = np.searchsorted(tokens.firsts, begins, "right") - 1
    origin = np.searchsorted(tokens.places, tokens.chunk.offsets[row])
    a = np.searchsorted(tokens.places, tokens.starts[begins]) - origin
    b = np.searchsorted(tokens.places, tokens.ends[ends]) - origin
    found: dict[int, list[str]] = {}
    for r, x, y in zip(row.tolist(), a.tolist(), b.tolist(), strict=True):
        found.setdefault(r, []).append(f"{x}:{y}")
    for r, parts in found.items():
        out[r] = ",".join(parts)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans and spans of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @wb.sparing
    def task(batches):
        field = shared.value
        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                part = batch.slice(first, rows)
                tokens = Tokens(part.column("text"))
                inside = field.tag(tokens)
                scores = field.scores(tokens, inside)
                spans = spans_of(tokens, inside)
                count = [s.count(":") for s in spans]
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(count, pa.int64()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_spans", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, SCORED)
