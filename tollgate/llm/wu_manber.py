"""Benchmark decontamination: Wu-Manber search for all benchmark windows in all texts.

Texts and benchmark items are reduced to lower-case words (A-Z folded) with one space
after each word. A pattern is the bytes of ``WINDOW_WORDS`` consecutive words of an
item, or the whole item when it has fewer words. Patterns of similar length share one
set of tables: with m the shortest of them, the last ``block`` bytes before offset m
give the shift table and the suffix-hash buckets. The search moves many positions of a
chunk at once, each by its own shift; where the shift is zero, the bucket's patterns
are compared byte by byte.

The benchmark never passes through the driver. Its distinct rows are dealt by hash to slices
of about ``SLICE_BYTES``; a task builds the tables of one slice and writes them to a file of
the shared folder, and the driver keeps the names only. A task over documents takes blocks of
about ``BLOCK_BYTES`` of text, loads slice after slice (the last ones stay in the worker, up to
``KEEP_BYTES`` of files), and adds up the hits of each block, so that a task holds a few
slices and a block, whatever the sizes of both tables.

Defined cases: a null or empty text has no words and is not contaminated; a null or
empty item, or one without words, has no windows; a null item_id is ignored; items with
equal windows are all reported; repeated rows give repeated results; only ``doc_id``,
``text`` and ``item_id``, ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import store
from tollgate.llm import wordbytes as wb

WINDOW_WORDS = 10
SLICE_BYTES = 2 << 20
#: Text that a task searches slice after slice, and files of slices that a worker keeps loaded.
BLOCK_BYTES = 8 << 20
KEEP_BYTES = 64 << 20
BLOCK = 8
LANE_BYTES = 512
TABLE_BITS = 18

#: Bytes to lower-case word bytes, everything else to a space.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
SPACE, END = 0x20, 0x0A


class Folded:
    """Texts as words with one space after each, and an end mark after each text."""

    def __init__(self, column: pa.Array):
        chunk = wb.Chunk(column, tail=" \n")
        raw = FOLD[chunk.bytes]
        raw[chunk.offsets[1:] - 1] = END
        before = np.empty_like(raw)
        before[0:1] = END
        before[1:] = raw[:-1]
        space = raw == SPACE
        at_gap = (before == SPACE) | (before == END)
        keep = ~(space & at_gap)
        self.bytes = raw[keep]
        starts = ~space & at_gap & (raw != END)
        self.word_starts = np.flatnonzero(starts[keep])
        kept = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        self.offsets = kept[chunk.offsets]
        self.firsts = np.searchsorted(self.word_starts, self.offsets)
        self.rows = chunk.rows


def item_windows(text: str | None, window: int = WINDOW_WORDS) -> list[bytes]:
    """The windows of one benchmark item."""
    folded = Folded(pa.array([text], pa.string()))
    words = folded.bytes.tobytes().rstrip(b"\n").split()
    if not words:
        return []
    last = max(1, len(words) - window + 1)
    return [b" ".join(words[i : i + window]) + b" " for i in range(last)]


def _block_values(data: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """The ``block`` bytes that end at each position, as one number."""
    rows = np.lib.stride_tricks.sliding_window_view(data, block)[ends - block + 1]
    if block < 8:
        rows = np.concatenate([rows, np.zeros((len(rows), 8 - block), np.uint8)], axis=1)
    return np.ascontiguousarray(rows).view("<u8").ravel()


def _slots(values: np.ndarray) -> np.ndarray:
    return ((values * wb.U(0x9E3779B97F4A7C15)) >> wb.U(64 - TABLE_BITS)).astype(np.int64)


class Tables:
    """Shift table and suffix-hash buckets for patterns of similar length."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.m = min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, np.int32)
        flat = np.ascontiguousarray(heads).ravel()
        base = np.arange(len(patterns)) * self.m
        for end in range(self.block - 1, self.m):
            slots = _slots(_block_values(flat, base + end, self.block))
            np.minimum.at(self.shift, slots, self.m - 1 - end)
        suffix = _slots(_block_values(flat, base + self.m - 1, self.block))
        order = np.argsort(suffix, kind="stable")
        self.patterns = [patterns[i] for i in order]
        self.numbers = np.asarray(numbers)[order]
        self.bucket = np.searchsorted(suffix[order], np.arange((1 << TABLE_BITS) + 1))
        self.head = _block_values(flat, base[order] + self.block - 1, self.block)

    def search(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and pattern numbers of all occurrences, each at the start of a word."""
        n, m = len(data), self.m
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, LANE_BYTES)
        stop = np.minimum(at + LANE_BYTES, n)
        found = []
        while len(at):
            slots = _slots(_block_values(data, at, self.block))
            move = self.shift[slots]
            hit = move == 0
            if hit.any():
                found.append((at[hit] - m + 1, slots[hit]))
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, slots = (np.concatenate(x) for x in zip(*found, strict=True))
        begins = (starts == 0) | (data[starts - 1] == SPACE) | (data[starts - 1] == END)
        starts, slots = starts[begins], slots[begins]
        sizes = self.bucket[slots + 1] - self.bucket[slots]
        which = wb.ranges(self.bucket[slots], sizes)
        starts = np.repeat(starts, sizes)
        same = _block_values(data, starts + self.block - 1, self.block) == self.head[which]
        starts, which = starts[same], which[same]
        text = data.tobytes()
        good = [text.startswith(self.patterns[w], s) for s, w in zip(starts.tolist(), which.tolist(), strict=True)]
        good = np.asarray(good, bool)
        return starts[good], self.numbers[which[good]]


class Search:
    """All windows of one benchmark slice."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW_WORDS):
        owners: dict[bytes, set] = {}
        for item, text in items:
            for pattern in item_windows(text, window):
                owners.setdefault(pattern, set()).add(str(item))
        self.patterns = sorted(owners)
        self.owners = [sorted(owners[p]) for p in self.patterns]
        self.words = np.asarray([p.count(b" ") for p in self.patterns], np.int64)
        groups: dict[int, list[int]] = {}
        for number, pattern in enumerate(self.patterns):
            groups.setdefault(len(pattern).bit_length(), []).append(number)
        self.tables = [Tables([self.patterns[i] for i in own], own) for _, own in sorted(groups.items())]

    def occurrences(self, folded: Folded) -> tuple[np.ndarray, np.ndarray]:
        """First word (in the chunk) and pattern number of every occurrence."""
        parts = [t.search(folded.bytes) for t in self.tables]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
        return np.searchsorted(folded.word_starts, starts), numbers


SLICES = "number long, temporary string, name string, bytes long"


def slices(items: DataFrame, window: int = WINDOW_WORDS, limit: int = SLICE_BYTES) -> list[tuple[str, int]]:
    """Address and size of each slice file: the tables over about ``limit`` bytes of distinct items."""
    spark = items.sparkSession
    held = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).where("item IS NOT NULL")
    size = F.sum(F.octet_length(F.coalesce("body", F.lit(""))) + 64)
    count = max(1, -(-(held.agg(size).first()[0] or 0) // limit))
    root = store.work_folder(spark, "benchmark-slices")

    @wb.sparing
    def build(batches):
        own: dict[int, list] = {}
        for batch in batches:
            for number, item, body in zip(*(batch.column(c).to_pylist() for c in ("number", "item", "body")), strict=True):
                own.setdefault(number, []).append((item, body))
        for number in sorted(own):
            data = pickle.dumps(Search(own.pop(number), window), protocol=5)
            name = f"slice-{number:08d}.pickle"
            address = store.temporary(root, name)
            with store.create(address) as out:
                out.write(data)
            row = [pa.array([number]), pa.array([address]), pa.array([name]), pa.array([len(data)])]
            yield pa.RecordBatch.from_arrays(row, names=["number", "temporary", "name", "bytes"])

    dealt = held.distinct().withColumn("number", F.pmod(F.xxhash64("item", "body"), F.lit(count)))
    made = store.written(dealt.repartition(int(count), "number").mapInArrow(build, SLICES), "benchmark-slices")
    return [(r["temporary"], r["bytes"]) for r in made.orderBy("number").select("temporary", "bytes").toLocalIterator()]


_loaded: OrderedDict[str, tuple[Search, int]] = OrderedDict()


def loaded(address: str, size: int) -> Search:
    """The tables of one slice; the worker keeps those used last."""
    if address in _loaded:
        _loaded.move_to_end(address)
        return _loaded[address][0]
    while _loaded and size + sum(n for _, n in _loaded.values()) > KEEP_BYTES:
        _loaded.popitem(last=False)
    with store.reopen(address) as file:
        search = pickle.loads(file.read())
    _loaded[address] = (search, size)
    return search


class Hits:
    """Words inside an occurrence and items found, for the texts of one chunk, slice by slice."""

    def __init__(self, folded: Folded):
        self.folded = folded
        self.edge = np.zeros(len(folded.word_starts) + 1, np.int64)
        self.found: dict[int, set] = {}

    def add(self, search: Search) -> None:
        at, number = search.occurrences(self.folded)
        np.add.at(self.edge, at, 1)
        np.add.at(self.edge, at + search.words[number], -1)
        doc = np.searchsorted(self.folded.firsts, at, "right") - 1
        for pair in np.unique(np.stack([doc, number], 1), axis=0) if len(at) else ():
            self.found.setdefault(int(pair[0]), set()).update(search.owners[pair[1]])

    def words(self) -> np.ndarray:
        return wb.per_row((np.cumsum(self.edge)[:-1] > 0).astype(np.int64), self.folded.firsts)


def hits_of(folded: Folded, searches: list[Search]) -> tuple[np.ndarray, dict[int, set]]:
    """Words inside an occurrence per text, and the items found per text."""
    hits = Hits(folded)
    for search in searches:
        hits.add(search)
    return hits.words(), hits.found


def searched(batches, parts: list[tuple[str, int]]) -> Iterator[tuple[pa.RecordBatch, Hits]]:
    """Rows and their hits, block by block; all slices are searched in a block before it leaves."""
    block: list[tuple[pa.RecordBatch, Hits]] = []
    held = 0

    def finish():
        for address, size in parts if block else ():
            search = loaded(address, size)
            for _, hits in block:
                hits.add(search)

    for batch in batches:
        for first, rows in wb.row_runs(batch.column("text")):
            part = batch.slice(first, rows)
            hits = Hits(Folded(part.column("text")))
            block.append((part, hits))
            held += len(hits.folded.bytes)
            if held >= BLOCK_BYTES:
                finish()
                yield from block
                block, held = [], 0
    finish()
    yield from block


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, limit: int = SLICE_BYTES) -> DataFrame:
    """Words, hit words and matching items of every document."""
    parts = slices(items, window, limit)

    @wb.sparing
    def task(batches):
        for part, hits in searched(batches, parts):
            hit = hits.words()
            names = [sorted(hits.found.get(i, ())) for i in range(part.num_rows)]
            columns = [
                part.column("doc_id"),
                pa.array(np.diff(hits.folded.firsts)),
                pa.array(hit),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                pa.array(hit > 0),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=RESULT_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, RESULT)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, limit: int = SLICE_BYTES) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    parts = slices(items, window, limit)

    @wb.sparing
    def task(batches):
        for part, hits in searched(batches, parts):
            yield part.filter(pa.array(hits.words() == 0))

    return docs.mapInArrow(task, docs.schema)


SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
patterns AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k,
         array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS p
  FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM patterns),
occurrences AS (
  SELECT r, i, s.k, item_id
  FROM words, sizes s, unnest(range(1, len(w) - s.k + 2)) AS t(i), patterns p
  WHERE p.k = s.k AND p.p = array_to_string(list_slice(w, i, i + s.k - 1), ' ')),
hits AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM occurrences, unnest(range(0, k)) AS t(o) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM occurrences) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""
