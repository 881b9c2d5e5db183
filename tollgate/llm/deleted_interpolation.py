"""LM scoring by deleted interpolation of word n-gram estimates.

P(w | h) = a2 f(w | h) + a1 f(w) + a0 / (V + 1), where f are maximum-likelihood estimates
from the training documents and the weights depend on the bucket of the count of h (one
bucket per power of two). The weights come from expectation-maximisation on deleted
documents: the training documents of fold ``DELETED_FOLD``, seen against the counts of
the other ones. The history of the first token is the end token.

Work goes in blocks. A task turns about ``BLOCK_TOKENS`` tokens of whole documents into
a sorted list of their distinct word and bigram keys (hashes of 64 and 56 bits), and sends each
slice of that list to the bucket of its leading bits. A bucket sums the counts of all
blocks and answers every slice with the sums; a block then scores its documents from
the answers. What is shuffled is a few bytes per distinct key of a block, whatever the
frequency of a word: a word that makes a third of all text is one key per block. The
number of buckets grows with the text. Tokens of a block wait in a file of the shared
folder whose name is part of the committed rows. Only sums, the weights and a
histogram of bounded size (buckets x bins x bins) reach the driver.

Defined cases: a null or empty text is one end token; a null doc_id is in training and
not held out; without training documents every count is 0, V is 0 and the weights fall
on the uniform part; repeated rows count as often as they occur; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import store
from tollgate.llm import wordbytes as wb
from tollgate.session import scratch_path

FOLDS = 10
HELD_FOLD = 0
DELETED_FOLD = 1
BLOCK_TOKENS = 2_000_000
BUCKET_KEYS = 2_000_000
ADD = 0.1
ROUNDS = 60
CONTEXT_BUCKETS = 64
BINS_PER_OCTAVE = 4
BINS = 256
LEAST_UNIFORM = 1e-6

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: The end token, as a key no word is likely to have.
END = wb.mix(np.array([0x656E64], np.uint64))[0]
ONE = wb.U(1)

KEYS = "block string, bucket int, deleted boolean, n long, keys binary, counts binary"
ANSWERS = "block string, bucket int, deleted boolean, total binary, retained binary, n_tokens long, n_words long, n_retained long, n_retained_words long"


def word_keys(words: np.ndarray) -> np.ndarray:
    """Keys of words are odd."""
    return words | ONE


def bigram_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of bigrams are even: 56 bits, with the low byte empty."""
    return wb.mix(wb.mix(before * wb.U(3)) + words) & ~wb.U(0xFF)


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as zstd-compressed byte planes, in as few bytes as the largest one needs."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    data = np.ascontiguousarray(planes).tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[9:], width * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.uint64)


def squeezed_keys(keys: np.ndarray) -> bytes:
    """Ascending distinct keys, as differences; those with an empty low byte apart, without it."""
    empty = (keys & wb.U(0xFF)) == 0
    first = squeezed(np.diff(keys[~empty], prepend=wb.U(0)))
    return len(first).to_bytes(8, "little") + first + squeezed(np.diff(keys[empty] >> wb.U(8), prepend=wb.U(0)))


def unsqueezed_keys(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    first, second = (np.cumsum(unsqueezed(x), dtype=np.uint64) for x in (data[8 : 8 + size], data[8 + size :]))
    return np.sort(np.concatenate([first, second << wb.U(8)]))


class Block:
    """The tokens of some documents, and their distinct keys in ascending order."""

    def __init__(self, words: np.ndarray, firsts: np.ndarray):
        """``words``: hashes of all tokens with end tokens; ``firsts``: first token of each document (one more than documents)."""
        self.firsts = firsts
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[firsts[:-1]] = END
        n = len(words)
        all_keys = np.concatenate([word_keys(words), bigram_keys(before, words)])
        del before
        order, heads, which = wb.groups(all_keys)
        self.keys = all_keys[order[heads]]
        del all_keys, order
        self.word, self.pair = which[:n], which[n:]
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[firsts[:-1]] = self.word[firsts[1:] - 1]

    def counts(self, training: np.ndarray) -> np.ndarray:
        """Occurrences of each key in the documents marked as training."""
        weight = np.repeat(training, np.diff(self.firsts)).astype(np.float64)
        n = len(self.keys)
        return (np.bincount(self.word, weight, n) + np.bincount(self.pair, weight, n)).astype(np.int64)


def chunk_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of each text and one end token, and the first token of each text."""
    chunk = wb.Chunk(column)
    chunk.bytes = LOWER[chunk.bytes]
    starts, ends, firsts = chunk.words()
    words = np.insert(chunk.hashes(starts, ends), firsts[1:], END)
    return words, firsts + np.arange(len(firsts))


def pack_tokens(words: np.ndarray, sizes: np.ndarray, doc_ids: list, folds: np.ndarray) -> bytes:
    """The tokens of a block, as numbers of its distinct words."""
    order, heads, which = wb.groups(words)
    known = np.asarray([d is not None for d in doc_ids], np.uint8)
    numbers = np.asarray([d or 0 for d in doc_ids], np.int64).view(np.uint64)
    parts = [squeezed_keys(words[order[heads]]), *map(squeezed, (which, sizes, numbers, known, folds))]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    vocabulary = unsqueezed_keys(parts[0])
    which, sizes, numbers, known, folds = map(unsqueezed, parts[1:])
    firsts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    return vocabulary[which.astype(np.int64)], firsts, numbers.view(np.int64), known.astype(bool), folds.astype(np.int64)


def gather(docs: DataFrame, root: str, buckets: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The key slices of all blocks; their tokens go to files below ``root``."""
    bits = buckets.bit_length() - 1

    @wb.sparing
    def task(batches):
        held = {True: [[], [], [], [], 0], False: [[], [], [], [], 0]}

        def flush(deleted):
            words, sizes, ids, folds, _ = held[deleted]
            held[deleted] = [[], [], [], [], 0]
            words, sizes, folds = np.concatenate(words), np.concatenate(sizes), np.concatenate(folds)
            address = store.temporary(root, "tokens")
            with store.create(address) as out:
                out.write(pack_tokens(words, sizes, ids, folds))
            block = Block(words, np.concatenate([[0], np.cumsum(sizes)]))
            counts = block.counts(folds != HELD_FOLD)
            edges = np.arange(buckets, dtype=np.uint64) << wb.U(64 - bits) if bits else np.zeros(1, np.uint64)
            cuts = np.append(np.searchsorted(block.keys, edges), len(block.keys))
            spans = [(b, low, high) for b, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if high > low]
            for at in range(0, len(spans), 256):
                own = spans[at : at + 256]
                values = [
                    [address] * len(own),
                    [b for b, _, _ in own],
                    [deleted] * len(own),
                    [high - low for _, low, high in own],
                    [squeezed_keys(block.keys[low:high]) for _, low, high in own],
                    [squeezed(counts[low:high]) for _, low, high in own],
                ]
                kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in KEYS.split(", ")])

        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                part = batch.slice(first, rows)
                words, firsts = chunk_tokens(part.column("text"))
                fold = np.asarray(part.column("fold"))
                ids = part.column("doc_id").to_pylist()
                sizes = np.diff(firsts)
                for deleted in (True, False):
                    mine = np.flatnonzero((fold == DELETED_FOLD) == deleted)
                    if not len(mine):
                        continue
                    keep = held[deleted]
                    keep[0].append(words[wb.ranges(firsts[mine], sizes[mine])])
                    keep[1].append(sizes[mine])
                    keep[2].extend(ids[i] for i in mine.tolist())
                    keep[3].append(fold[mine].astype(np.int64))
                    keep[4] += int(sizes[mine].sum())
                    if keep[4] >= block_tokens:
                        yield from flush(deleted)
        for deleted in (True, False):
            if held[deleted][2]:
                yield from flush(deleted)

    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    fold = F.coalesce(remainder, F.lit(FOLDS)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.alias("fold")).mapInArrow(task, KEYS)


def answer(slices: DataFrame) -> DataFrame:
    """For every slice of keys the counts over all blocks, and for every bucket its sums."""
    names = [x.split()[0] for x in ANSWERS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 4]

    def task(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unsqueezed_keys(r["keys"]) for r in rows]
        counts = np.concatenate([unsqueezed(r["counts"]) for r in rows]).astype(np.float64)
        deleted = np.repeat([r["deleted"] for r in rows], list(map(len, keys)))
        order, heads, which = wb.groups(np.concatenate(keys))
        total = np.bincount(which, counts, len(heads)).astype(np.int64)
        retained = np.bincount(which, np.where(deleted, 0.0, counts), len(heads)).astype(np.int64)
        is_word = (np.concatenate(keys)[order[heads]] & ONE).astype(bool)
        out, at = [], 0
        for row, own in zip(rows, keys, strict=True):
            mine = which[at : at + len(own)]
            at += len(own)
            out.append((row["block"], row["bucket"], row["deleted"], squeezed(total[mine]), squeezed(retained[mine]) if row["deleted"] else None, 0, 0, 0, 0))
        sums = total[is_word], retained[is_word]
        out.append((None, rows[0]["bucket"], None, None, None, *(int(f) for s in sums for f in (s.sum(), (s > 0).sum()))))
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return slices.groupBy("bucket").applyInArrow(task, ANSWERS)


def block_counts(table: pa.Table) -> tuple[Block, np.ndarray, np.ndarray | None, tuple]:
    """One block from its file, with the counts of its keys (all, and of retained documents)."""
    rows = sorted(table.select(["block", "bucket", "total", "retained"]).to_pylist(), key=lambda r: r["bucket"])
    with store.reopen(rows[0]["block"]) as file:
        words, firsts, numbers, known, folds = unpack_tokens(file.read())
    total = np.concatenate([unsqueezed(r["total"]) for r in rows]).astype(np.float64)
    retained = None
    if rows[0]["retained"] is not None:
        retained = np.concatenate([unsqueezed(r["retained"]) for r in rows]).astype(np.float64)
    return Block(words, firsts), total, retained, (numbers, known, folds)


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the whole part of log2 of the count."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def bins_of(ratio: np.ndarray) -> np.ndarray:
    """0 for no estimate, else the bin of the estimate over the uniform one."""
    logs = np.round(BINS_PER_OCTAVE * np.log2(np.maximum(ratio, 1e-30))).astype(np.int64) + BINS // 4
    return np.where(ratio > 0, np.clip(logs, 1, BINS - 1), 0)


def ratio_of(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > 0, np.exp2((bins - BINS // 4) / BINS_PER_OCTAVE), 0.0)


def held_out_counts(answers: DataFrame, n_tokens: int, n_words: int) -> DataFrame:
    """(code, n): how often deleted tokens meet each combination of context bucket and estimates."""

    def task(table: pa.Table) -> pa.Table:
        block, _, retained, _ = block_counts(table)
        before, single, pair = retained[block.before], retained[block.word], retained[block.pair]
        uniform = 1.0 / (n_words + 1)
        ml2 = bins_of(np.where(before > 0, pair / np.maximum(before, 1), 0) / uniform)
        ml1 = bins_of(single / max(n_tokens, 1) / uniform)
        codes, n = np.unique((context_bucket(before) * BINS + ml2) * BINS + ml1, return_counts=True)
        return pa.table({"code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})

    found = answers.where("block IS NOT NULL AND deleted").groupBy("block").applyInArrow(task, "code long, n long")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def fit_weights(codes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, word, uniform) per context bucket, by expectation-maximisation."""
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXT_BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    bucket = codes // (BINS * BINS)
    ratio = np.stack([ratio_of(codes // BINS % BINS), ratio_of(codes % BINS), np.ones(len(codes))], 1)
    for _ in range(rounds if len(codes) else 0):
        share = weights[bucket] * ratio
        share *= (counts / np.maximum(share.sum(1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, j], CONTEXT_BUCKETS) for j in range(3)], 1)
        seen = sums.sum(1) > 0
        weights[seen] = sums[seen] / sums[seen].sum(1, keepdims=True)
    if len(codes):
        seen = np.bincount(bucket, minlength=CONTEXT_BUCKETS) > 0
        near = np.abs(np.arange(CONTEXT_BUCKETS)[:, None] - np.flatnonzero(seen)[None, :]).argmin(1)
        weights[1:] = weights[np.flatnonzero(seen)[near]][1:]
    weights[:, 2] = np.maximum(weights[:, 2], LEAST_UNIFORM)
    return weights / weights.sum(1, keepdims=True)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_blocks(answers: DataFrame, weights: np.ndarray, n_tokens: int, n_words: int) -> DataFrame:
    names = [x.split()[0] for x in RESULT.split(", ")]

    def task(table: pa.Table) -> pa.Table:
        block, total, _, (numbers, known, folds) = block_counts(table)
        before, single, pair = total[block.before], total[block.word], total[block.pair]
        base = np.log10((single + ADD) / (n_tokens + ADD * (n_words + 1)))
        mix = weights[context_bucket(before)]
        chance = mix[:, 0] * np.where(before > 0, pair / np.maximum(before, 1), 0.0)
        chance += mix[:, 1] * single / max(n_tokens, 1) + mix[:, 2] / (n_words + 1)
        columns = [
            pa.array(numbers, pa.int64(), mask=~known),
            pa.array(folds == HELD_FOLD),
            pa.array(np.diff(block.firsts), pa.int64()),
            pa.array(np.add.reduceat((single > 0).astype(np.int64), block.firsts[:-1]), pa.int64()),
            pa.array(np.add.reduceat(base, block.firsts[:-1])),
            pa.array(np.add.reduceat(np.log10(chance), block.firsts[:-1])),
        ]
        return pa.Table.from_arrays(columns, names=names)

    return answers.where("block IS NOT NULL").groupBy("block").applyInArrow(task, RESULT)


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Base score and model score of every document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1
    while buckets * bucket_keys * 5 < size:
        buckets *= 2
    root = store.work_folder(spark, "lm-tokens")
    place = scratch_path(spark, "lm-keys")
    slices = store.written(gather(docs, root, buckets, block_tokens), "lm-keys", place)
    answers = store.written(answer(slices), "lm-answers")
    store.discard(spark, place)
    sums = answers.where("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_words", "n_retained", "n_retained_words")]).first()
    n_tokens, n_words, n_retained, n_retained_words = map(int, sums)
    found = held_out_counts(answers, n_retained, n_retained_words).toArrow()
    weights = fit_weights(np.asarray(found["code"], np.int64), np.asarray(found["n"], np.float64))
    scored = score_blocks(answers, weights, n_tokens, n_words)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
