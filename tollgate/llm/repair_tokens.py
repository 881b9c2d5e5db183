"""Token-id files compressed by Re-Pair grammars, with random access.

Texts are range-partitioned and sorted by doc_id. Each task encodes its texts with the
tokenizers library, ends each document with ``END_ID``, cuts its ids into shards of
about ``SHARD_IDS`` ids (whole documents), compresses each shard and writes it under a
temporary name; the manifest of the committed shards then gives the final names and,
by a running sum over shards, the place of each document in the whole stream.

Re-Pair replaces frequent pairs of symbols by new symbols until none is left that can be
replaced ``LEAST_COUNT`` times. The limit falls from an eighth of the highest count to
``LEAST_COUNT`` by eighths; at each limit, rounds go on until no pair reaches it, and
after the first round only pairs with a symbol of the last round need counting. Where
occurrences overlap, the leftmost goes first. Symbols are the ids of the vocabulary, then
the rules of the shard, with no bound on their number but 32 bits. A shard file holds
the rules, the expansion length of each rule, the symbols (each in as many bits as the
shard needs), the expanded position of every ``STEP``-th symbol, and the start of each
document: any range of ids is decoded from the symbols that cover it.

Defined cases: a null or empty text is one end id; null doc_ids come first; equal
doc_ids are ordered by a hash of the text, then the text, so that the rows of one id
spread over tasks; an id outside the vocabulary is an error; an empty table gives no shard and no row; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm import store
from tollgate.llm import wordbytes as wb
from tollgate.llm.trie_bpe import PIECE, PLAIN
from tollgate.llm.wordcache import WordCache

END_ID = 1
SHARD_IDS = 4_000_000
TASK_BYTES = 16 << 20
#: A rule costs two symbols and its expansion length, some three symbols: it pays from four uses.
LEAST_COUNT = 4
#: From one limit of the counts to the next lower one.
COARSENESS = 8
#: Fewer pairs are sorted without a look at the counts of their slots.
FEW_PAIRS = 1 << 16
STEP = 1024
#: Rules that expand to more ids are expanded through their parts.
LONG_RULE = 4096
MAGIC = b"RPTOK002"
HEADER = struct.Struct("<8sIIIIqqq")
#: Numbers that go through the bit arrays at a time, a multiple of eight.
BIT_BLOCK = 1 << 18
JOINED_WORDS = 4000
#: Words that a Python worker holds from task to task, some 40 bytes each.
KEEP_WORDS = 3_000_000


class LibraryEncoder:
    """The tokenizers library over distinct words, many words per call.

    The ids of a word are told apart by its number of pieces: every piece ends with an id
    that carries the end-of-word mark. Words with other characters than ``PLAIN`` are
    encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        mark = self.library.model.end_of_word_suffix
        self.ends_piece = np.zeros(self.vocabulary, bool)
        self.ends_piece[[i for s, i in self.library.get_vocab(with_added_tokens=False).items() if s.endswith(mark)]] = True
        self.cache = WordCache(self.encode_words, KEEP_WORDS)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.zeros(len(words), np.int64)
        # a word of ASCII letters is one piece
        letters = [w.isascii() and w.isalpha() for w in words]
        plain = [i for i, w in enumerate(words) if letters[i] or ("<|" not in w and PLAIN.fullmatch(w))]
        flat = [np.zeros(0, np.int32)]
        calls = [plain[at : at + JOINED_WORDS] for at in range(0, len(plain), JOINED_WORDS)]
        joined = [" ".join([words[i] for i in own]) for own in calls]
        for own, found in zip(calls, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, np.int32)
            pieces = np.cumsum([1 if letters[i] else len(PIECE.findall(words[i].lower())) for i in own])
            ends = np.flatnonzero(self.ends_piece[ids])
            if len(ends) != pieces[-1]:
                raise ValueError("the tokenizer splits words in another way")
            lengths[own] = np.diff(ends[pieces - 1] + 1, prepend=0)
            flat.append(ids)
        rest = np.concatenate(flat)
        if len(plain) == len(words):
            return lengths, rest
        odd = np.ones(len(words), bool)
        odd[plain] = False
        odd = np.flatnonzero(odd)
        singly = [e.ids for e in self.library.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)]
        lengths[odd] = [len(x) for x in singly]
        out = np.empty(int(lengths.sum()), np.int32)
        starts = np.cumsum(lengths) - lengths
        out[wb.ranges(starts[plain], lengths[plain])] = rest
        out[wb.ranges(starts[odd], lengths[odd])] = np.asarray([x for ids in singly for x in ids], np.int32)
        return lengths, out


def _slots(pair: np.ndarray) -> np.ndarray:
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)


def _frequent(pair: np.ndarray, slot: np.ndarray, limit: int) -> np.ndarray:
    """The pairs that occur ``limit`` times or more, sorted."""
    if len(pair) > FEW_PAIRS:
        often = np.bincount(slot, minlength=1 << 20) >= limit
        pair = pair[often[slot]]
    keys = np.sort(pair)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edges[np.diff(np.append(edges, len(keys))) >= limit]]


def _replaced(pair: np.ndarray, slot: np.ndarray, where: np.ndarray | None, chosen: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where chosen pairs are replaced, and by which; pairs that overlaps leave too few places are put aside."""
    own = _slots(chosen)
    number = np.full(1 << 20, -1, np.int32)
    number[own] = np.arange(len(chosen))
    at = number[slot]
    maybe = np.flatnonzero(at >= 0)
    at = at[maybe]
    # chosen pairs that share a slot are told apart by search
    order = np.sort(own)
    shared = np.zeros(1 << 20, bool)
    shared[order[1:][order[1:] == order[:-1]]] = True
    unsure = np.flatnonzero(shared[slot[maybe]])
    at[unsure] = np.minimum(np.searchsorted(chosen, pair[maybe[unsure]]), len(chosen) - 1)
    same = chosen[at] == pair[maybe]
    maybe, at = maybe[same], at[same]
    if where is not None:
        maybe = where[maybe]
    # of overlapping occurrences take every second one, from the left
    begin = np.concatenate([[True], np.diff(maybe) > 1])[: len(maybe)]
    run = np.maximum.accumulate(np.where(begin, np.arange(len(maybe)), 0))
    take = (np.arange(len(maybe)) - run) % 2 == 0
    maybe, at = maybe[take], at[take]
    enough = (np.bincount(at, minlength=len(chosen)) >= least)[at]
    return maybe[enough], at[enough]


def compress(ids: np.ndarray, first_rule: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, sizes, symbols): rule r is the symbol first_rule + r, the two symbols ``rules[r]``, and ``sizes[r]`` ids."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < first_rule:
        raise ValueError(f"an id is not below {first_rule}")
    symbols = ids.astype(np.uint32)
    rules, sizes = [np.zeros((0, 2), np.uint32)], np.ones(first_rule, np.int64)
    made, limit, where = 0, 0, None
    while len(symbols) > 1:
        left, right = (symbols[:-1], symbols[1:]) if where is None else (symbols[where], symbols[where + 1])
        pair = (left.astype(np.uint64) << np.uint64(32)) | right
        slot = _slots(pair)
        if not limit:
            limit = max(least, int(np.bincount(slot, minlength=1 << 20).max()) // COARSENESS)
        chosen = _frequent(pair, slot, limit)
        at, number = _replaced(pair, slot, where, chosen, least) if len(chosen) else (chosen, chosen)
        if not len(at):
            if limit == least and where is None:
                break
            limit, where = max(least, limit // COARSENESS), None
            continue
        used = np.flatnonzero(np.bincount(number, minlength=len(chosen)))
        rank = np.empty(len(chosen), np.uint32)
        rank[used] = np.arange(len(used))
        both = np.stack([chosen[used] >> np.uint64(32), chosen[used] & np.uint64(0xFFFFFFFF)], 1)
        rules.append(both.astype(np.uint32))
        sizes = np.concatenate([sizes, sizes[both.astype(np.int64)].sum(1)])
        symbols[at] = rank[number] + np.uint32(first_rule + made)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        made += len(used)
        # no older pair is left at this limit: the next round counts the pairs beside the new symbols
        place = at - np.arange(len(at))
        where = np.stack([place - 1, place], 1).ravel()
        where = where[(np.diff(where, prepend=-2) > 0) & (where >= 0) & (where < len(symbols) - 1)]
    return np.concatenate(rules), sizes[first_rule:], symbols


def bits_of(values: np.ndarray) -> int:
    return max(1, int(values.max()).bit_length()) if len(values) else 1


def to_bits(values: np.ndarray, width: int) -> bytes:
    """Each number in ``width`` bits, lowest bit first, one after the other."""
    out = []
    for at in range(0, len(values), BIT_BLOCK):
        rows = values[at : at + BIT_BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes())
    return b"".join(out)


def from_bits(data: np.ndarray, width: int, count: int) -> np.ndarray:
    out = [np.zeros(0, np.uint32)]
    for at in range(0, count, BIT_BLOCK):
        own = min(BIT_BLOCK, count - at)
        flat = np.unpackbits(data[at * width // 8 : -(-(at + own) * width // 8)], bitorder="little")[: own * width]
        rows = np.zeros((own, 32), np.uint8)
        rows[:, :width] = flat.reshape(-1, width)
        out.append(np.packbits(rows, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(out)


class Grammar:
    """The rules of one shard, with the expansion length of each."""

    def __init__(self, rules: np.ndarray, sizes: np.ndarray, first_rule: int):
        self.rules = rules.astype(np.int64).reshape(-1, 2)
        self.first = first_rule
        self.sizes = np.concatenate([np.ones(first_rule, np.int64), sizes.astype(np.int64)])
        number = np.arange(first_rule, len(self.sizes))[:, None]
        if (self.rules >= number).any() or (self.sizes[self.rules].sum(1) != sizes).any():
            raise ValueError("expansion lengths do not match the rules")
        self._flat: np.ndarray | None = None

    def _tables(self) -> None:
        """The expansions of all ids and short rules, one after the other, parts before wholes."""
        level = np.zeros(len(self.sizes), np.int64)
        while True:
            deeper = level[self.rules].max(1, initial=0) + 1
            if np.array_equal(deeper, level[self.first :]):
                break
            level[self.first :] = deeper
        self._short = np.where(self.sizes <= LONG_RULE, self.sizes, 0)
        self._at = np.cumsum(self._short) - self._short
        flat = np.empty(int(self._short.sum()), np.int32)
        flat[: self.first] = np.arange(self.first)
        level[self._short == 0] = -1
        order = np.argsort(level, kind="stable")
        edges = np.searchsorted(level[order], np.arange(1, int(level.max(initial=0)) + 2))
        for begin, end in zip(edges, edges[1:], strict=False):
            own = order[begin:end]
            left, right = self.rules[own - self.first].T
            size = self._short[left]
            flat[wb.ranges(self._at[own], size)] = flat[wb.ranges(self._at[left], size)]
            flat[wb.ranges(self._at[own] + size, self._short[right])] = flat[wb.ranges(self._at[right], self._short[right])]
        self._flat = flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._flat is None:
            self._tables()
        symbols = symbols.astype(np.int64)
        while (long := self.sizes[symbols] > LONG_RULE).any():
            twice = np.where(long, 2, 1)
            first = np.cumsum(twice) - twice
            out = np.repeat(symbols, twice)
            pair = self.rules[symbols[long] - self.first]
            out[first[long]], out[first[long] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return self._flat[wb.ranges(self._at[symbols], self._short[symbols])]


def pack(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None], first_rule: int) -> bytes:
    """One shard file: ``starts`` has the first id of each document."""
    rules, sizes, symbols = compress(ids, first_rule)
    spans = np.concatenate([np.ones(first_rule, np.int64), sizes])[symbols]
    places = np.cumsum(spans) - spans
    known = np.asarray([d is not None for d in doc_ids], np.uint8)
    numbers = np.asarray([d or 0 for d in doc_ids], "<i8")
    width, size_width = bits_of(np.asarray([first_rule + len(rules) - 1])), bits_of(sizes)
    parts = [
        HEADER.pack(MAGIC, first_rule, len(rules), width, size_width, len(symbols), len(doc_ids), len(ids)),
        to_bits(rules.ravel(), width),
        to_bits(sizes, size_width),
        to_bits(symbols, width),
        places[::STEP].astype("<i8").tobytes(),
        starts.astype("<i8").tobytes(),
        numbers.tobytes(),
        known.tobytes(),
    ]
    return b"".join(parts)


class Shard:
    """Reads a shard file."""

    def __init__(self, data: bytes):
        magic, first_rule, n_rules, self.width, size_width, self.n_symbols, n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        rules = from_bits(array("u1", -(-2 * n_rules * self.width // 8)), self.width, 2 * n_rules)
        sizes = from_bits(array("u1", -(-n_rules * size_width // 8)), size_width, n_rules)
        self.packed = array("u1", -(-self.n_symbols * self.width // 8))
        self.places = array("<i8", -(-self.n_symbols // STEP))
        self.starts = array("<i8", n_docs)
        self.numbers = array("<i8", n_docs)
        self.known = array("u1", n_docs).astype(bool)
        self.grammar = Grammar(rules, sizes, first_rule)

    def symbols(self, low: int, high: int) -> np.ndarray:
        """The symbols of the blocks [low, high) of ``STEP`` symbols each, which begin at whole bytes."""
        first, last = low * STEP, min(high * STEP, self.n_symbols)
        return from_bits(self.packed[first * self.width // 8 : -(-last * self.width // 8)], self.width, max(0, last - first))

    def slice(self, start: int, length: int) -> np.ndarray:
        """The ids [start, start + length), decoded from the symbols that cover them."""
        if length <= 0:
            return np.zeros(0, np.int32)
        low = max(0, int(np.searchsorted(self.places, start, "right")) - 1)
        high = int(np.searchsorted(self.places, start + length, "left"))
        ids = self.grammar.expand(self.symbols(low, high))
        begin = start - int(self.places[low])
        return ids[begin : begin + length]

    def ids(self) -> np.ndarray:
        return self.grammar.expand(self.symbols(0, len(self.places)))


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


MANIFEST = "part int, seq int, temporary string, name string, docs long, ids long, bytes long"


def write(docs: DataFrame, root: str, tokenizer: str, shard_ids: int = SHARD_IDS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Write the ids of all texts as shard files below ``root``; returns the manifest, in stream order by (part, seq)."""
    spark = docs.sparkSession
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))

    @wb.sparing
    def task(batches):
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        ids, sizes, names, count, seq = [], [], [], 0, 0

        def flush():
            nonlocal ids, sizes, names, count, seq
            lengths = np.concatenate(sizes)
            data = pack(np.concatenate(ids), np.cumsum(lengths) - lengths, names, enc.vocabulary)
            name = f"ids-{part:06d}-{seq:06d}.rp"
            address = store.temporary(root, name)
            with store.create(address) as out:
                out.write(data)
            row = [[part], [seq], [address], [name], [len(names)], [count], [len(data)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            ids, sizes, names, count, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                rest = batch.slice(first, rows)
                flat, edges = enc.cache.ids(rest.column("text"))
                flat = np.insert(flat, edges[1:], END_ID)
                ids.append(flat)
                sizes.append(np.diff(edges) + 1)
                names.extend(rest.column("doc_id").to_pylist())
                count += len(flat)
                if count >= shard_ids:
                    yield flush()
        if names:
            yield flush()

    shards = held.repartitionByRange(int(pieces), "doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text").mapInArrow(task, MANIFEST)
    manifest = store.written(shards, "token-manifest")

    def commit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store.move(row["temporary"], f"{root}/{row['name']}")
            yield batch

    return store.written(manifest.mapInArrow(commit, MANIFEST), "token-manifest")


def read(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Every document of the shard files: doc_id, start in the whole stream, number of ids, and their crc32."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("part", "seq", "name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    spread = placed.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "name")

    @wb.sparing
    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with store.reopen(f"{root}/{row['name']}") as file:
                    shard = Shard(file.read())
                ids = shard.ids().astype("<u4")
                edges = np.append(shard.starts, shard.n_ids).tolist()
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                columns = [
                    pa.array(shard.numbers, pa.int64(), mask=~shard.known),
                    pa.array(shard.starts + row["base"], pa.int64()),
                    pa.array(np.diff(edges), pa.int64()),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")
