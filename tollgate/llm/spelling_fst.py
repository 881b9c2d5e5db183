"""Spelling variants by composing the vocabulary acceptor with a one-edit transducer and the acceptor again.

Words and their numbers of occurrences are counted by Spark over whole texts. Two words
are near if one inserted, deleted or replaced code point turns one into the other. Such
a pair agrees before its first unlike position and after the edit, so words are dealt by
what they share: for a class (the length of the shorter word) and a window of positions,
the words with equal text before and after the window are one partition. Its composition
starts in the state after the shared prefix and ends in the states before the shared
suffix; only edits inside the window remain. Each pair has one first unlike position, so
it is accepted in exactly one window and no pair is found twice.

Within a task the middles of many partitions form one trie with an initial state each,
which is minimised by right languages. The composition with the edit transducer is made
on pairs of minimal states, trimmed to those that can still accept, and then accepted
pairs are enumerated along it: words are numbered by the counts of accepted strings, so
a path adds up to the places of both words.

A partition with more than ``CROWD`` words is dealt again with each half of its window;
a window of one position holds no more words than the square of the alphabet. Pairs never
leave a task: each word gets a count and its best neighbour, and those are combined.

Defined cases: null and empty texts have no words; a null doc_id is an empty text before
the colon of the checksum; very long runs are words like others; repeated rows count
again; an empty table has no words; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm import crc_sql, store
from tollgate.llm import wordbytes as wb
from tollgate.session import small_side

LEAST_LENGTH = 7
LEAST_USES = 2
TYPO_EVERY = 31
FORM_RATIO = 10
CROWD = 2_000
BATCH_ROWS = 60_000
BATCH_CELLS = 1 << 24
SHIFTED = 64
U = np.uint64

LETTER = wb.table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def checksums(prefixes: list[bytes], rows: np.ndarray, words: list[bytes], which: np.ndarray) -> np.ndarray:
    """CRC-32 of prefixes[rows] + words[which]: the checksum of a prefix moves past the word by zero bytes."""
    shifted = np.empty((SHIFTED + 1, len(prefixes)), np.uint32)
    shifted[0] = [zlib.crc32(p) for p in prefixes]
    for n in range(SHIFTED):
        shifted[n + 1] = (shifted[n] >> 8) ^ CRC[shifted[n] & 255]
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))[which]
    found = shifted[np.minimum(lengths, SHIFTED), rows] ^ own[which]
    for at in np.flatnonzero(lengths > SHIFTED).tolist():
        found[at] = zlib.crc32(words[which[at]], int(shifted[0, rows[at]]))
    return found


def counted(docs: DataFrame) -> DataFrame:
    """word and n: all words of at least ``LEAST_LENGTH`` code points with ``LEAST_USES`` occurrences."""

    def count(ids: list, column: pa.Array) -> pa.RecordBatch | None:
        chunk = wb.Chunk(column)
        raw = chunk.bytes.copy()
        lead = raw == 0xC3  # with the byte after it: U+00C0 to U+00FF
        inside = LETTER[raw] | lead
        inside[1:] |= lead[:-1]
        raw[(raw >= 0x41) & (raw <= 0x5A)] += 32
        chunk.bytes = raw
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        wide = np.concatenate([[0], np.cumsum(lead)])
        points = ends - starts - (wide[ends] - wide[starts])
        keep = points >= LEAST_LENGTH
        starts, ends, points = starts[keep], ends[keep], points[keep]
        if not len(starts):
            return None
        rows = np.searchsorted(chunk.offsets, starts, "right") - 1
        order, heads, which = wb.groups(chunk.hashes(starts, ends))
        first = order[heads]
        whole = raw.tobytes()
        words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        prefixes = [(b"" if i is None else b"%d" % i) + b":" for i in ids]
        h = checksums(prefixes, rows, words, which)
        typo = h % TYPO_EVERY == 0
        counts = np.bincount(which[~typo], minlength=len(words)).tolist()
        shorter: dict[bytes, int] = {}
        for at in np.flatnonzero(typo & (points > LEAST_LENGTH)).tolist():
            word = words[which[at]].decode()
            place = int(h[at]) % len(word)
            word = (word[:place] + word[place + 1 :]).encode()
            shorter[word] = shorter.get(word, 0) + 1
        found = [(w, n) for w, n in zip(words, counts, strict=True) if n]
        found.extend(shorter.items())
        if not found:
            return None
        words, counts = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    @wb.sparing
    def task(batches):
        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                part = batch.slice(first, rows)
                found = count(part.column("doc_id").to_pylist(), part.column("text"))
                if found is not None:
                    yield found

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_USES)


class Acceptor:
    """The minimised acceptor of the middles of many partitions, and the trie it was made from.

    ``middles`` has a row per word (zero behind a shorter one) and one column more than the
    window; ``group`` numbers the partitions; no two rows of a group are equal.
    """

    def __init__(self, middles: np.ndarray, longer: np.ndarray, group: np.ndarray):
        width = middles.shape[1] - 1
        self.width = width
        at = group.astype(np.int64)
        self.sizes = [int(group.max()) + 1]
        self.parents: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.symbols: list[np.ndarray] = [np.zeros(0, np.int64)]
        for d in range(width + 1):
            active = slice(None) if d < width else np.flatnonzero(longer)
            code = at[active] * 256 + middles[active, d]
            edges, place = np.unique(code, return_inverse=True)
            at[active] = place
            self.parents.append(edges >> 8)
            self.symbols.append(edges & 255)
            self.sizes.append(len(edges))
        self.end = at
        short_end = np.zeros(self.sizes[width], bool)
        short_end[at[~longer]] = True
        self.final = [np.zeros(s, bool) for s in self.sizes[:width]] + [short_end, np.ones(self.sizes[width + 1], bool)]
        self._minimise()
        self._number(longer)

    def _children(self, d: int) -> np.ndarray:
        """The first child of every node of level ``d``, and the end of the last one's."""
        return np.searchsorted(self.parents[d + 1], np.arange(self.sizes[d] + 1)) if d <= self.width else np.zeros(self.sizes[d] + 1, np.int64)

    def _minimise(self) -> None:
        first = [self._children(d) for d in range(self.width + 2)]
        mark = wb.mix(np.arange(1, 257, dtype=U))
        language = [np.zeros(0, U)] * (self.width + 2)
        for d in range(self.width + 1, -1, -1):
            sums = np.zeros(self.sizes[d + 1] + 1 if d <= self.width else 1, U)
            if d <= self.width:
                np.cumsum(wb.mix(language[d + 1] ^ mark[self.symbols[d + 1]]), out=sums[1:])
            language[d] = wb.mix(sums[first[d][1:]] - sums[first[d][:-1]] + self.final[d].astype(U))
        offset = np.concatenate([[0], np.cumsum(self.sizes)])
        child = np.concatenate([f[:-1] + offset[min(d + 1, self.width + 1)] for d, f in enumerate(first)])
        degree = np.concatenate([np.diff(f) for f in first])
        symbols, final = np.concatenate(self.symbols[1:]), np.concatenate(self.final)
        _, head, state = np.unique(np.concatenate(language), return_index=True, return_inverse=True)
        below = state[offset[1] :]  # the state after each edge: edges are the nodes behind the first level
        if not self._equivalent(state, head, child - offset[1], degree, final, symbols, below):
            head = state = np.arange(len(degree))  # two right languages share a digest: the trie itself is an acceptor too
            below = state[offset[1] :]
        edges = wb.ranges((child - offset[1])[head], degree[head])
        self.from_ = np.repeat(np.arange(len(head)), degree[head])
        self.symbol, self.to = symbols[edges], below[edges]
        self.key = self.from_ * 256 + self.symbol
        self.first = np.concatenate([[0], np.cumsum(degree[head])])
        self.accepts = final[head]
        self.states = [state[offset[d] : offset[d + 1]] for d in range(self.width + 2)]
        self.heads = head

    @staticmethod
    def _equivalent(state, head, child, degree, final, symbols, below) -> bool:
        """Whether every node has the end mark and the edges of the node that stands for its state."""
        like = head[state]
        if (degree != degree[like]).any() or (final != final[like]).any():
            return False
        mine, theirs = wb.ranges(child, degree), wb.ranges(child[like], degree)
        return bool((symbols[mine] == symbols[theirs]).all() and (below[mine] == below[theirs]).all())

    def _number(self, longer: np.ndarray) -> None:
        """Number words: ``before`` counts the words that an edge leaves behind, ``base`` those before a node."""
        counts = [np.zeros(0, np.int64)] * (self.width + 2)
        for d in range(self.width + 1, -1, -1):
            sums = np.zeros(self.sizes[d + 1] + 1 if d <= self.width else 1, np.int64)
            if d <= self.width:
                np.cumsum(counts[d + 1], out=sums[1:])
            first = self._children(d)
            counts[d] = sums[first[1:]] - sums[first[:-1]] + self.final[d]
        words = np.concatenate(counts)[self.heads]
        run = np.concatenate([[0], np.cumsum(words[self.to])])
        self.before = run[:-1] - run[self.first[:-1]][self.from_] + self.accepts[self.from_]
        base = np.cumsum(counts[0]) - counts[0]
        self.base = [base]
        for d in range(self.width + 1):
            edge = np.searchsorted(self.key, self.states[d][self.parents[d + 1]] * 256 + self.symbols[d + 1])
            base = base[self.parents[d + 1]] + self.before[edge]
            self.base.append(base)
        self.row_of = np.empty(len(self.end), np.int64)
        rank = np.where(longer, 0, 0)
        rank[~longer] = self.base[self.width][self.end[~longer]]
        rank[longer] = self.base[self.width + 1][self.end[longer]]
        self.row_of[rank] = np.arange(len(self.end))

    def edge(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edge, whether there is one) by symbol from each state."""
        want = state * 256 + symbol
        at = np.searchsorted(self.key, want)
        at[at == len(self.key)] = 0
        return at, self.key[at] == want

    def both(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, edge of p, edge of q) for every symbol that both states of a pair read."""
        n = self.first[p + 1] - self.first[p]
        place, one = np.repeat(np.arange(len(p)), n), wb.ranges(self.first[p], n)
        other, good = self.edge(q[place], self.symbol[one])
        return place[good], one[good], other[good]


class Edits:
    """One-edit transitions of the states of a level: pairs of target states, and what each word's place gains."""

    def __init__(self, a: Acceptor, states: np.ndarray, d: int, at_end: bool):
        if d == a.width:  # the longer word ends in one more symbol
            ending = states[a.accepts[states]] if at_end else states[:0]
            n = a.first[ending + 1] - a.first[ending]
            edge = wb.ranges(a.first[ending], n)
            self.origin = np.repeat(ending, n)
            self.p, self.q = a.to[edge], self.origin
            self.gain_p, self.gain_q = a.before[edge], np.zeros(len(edge), np.int64)
            return
        n = a.first[states + 1] - a.first[states]
        origin, edge = np.repeat(states, n), wb.ranges(a.first[states], n)
        # replace: two unlike symbols from one state
        later = a.first[origin + 1] - edge - 1
        one, two = np.repeat(edge, later), wb.ranges(edge + 1, later)
        # insert: one word reads a symbol alone, then both read another one
        place, far, near = a.both(a.to[edge], origin)
        unlike = a.symbol[edge[place]] != a.symbol[near]
        place, far, near = place[unlike], far[unlike], near[unlike]
        self.origin = np.concatenate([np.repeat(origin, later), origin[place]])
        self.p = np.concatenate([a.to[one], a.to[far]])
        self.q = np.concatenate([a.to[two], a.to[near]])
        self.gain_p = np.concatenate([a.before[one], a.before[edge[place]] + a.before[far]])
        self.gain_q = np.concatenate([a.before[two], a.before[near]])


def near_pairs(middles: np.ndarray, longer: np.ndarray, group: np.ndarray, at_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs of near words whose first unlike position lies in the window, each pair once."""
    a = Acceptor(middles, longer, group)
    n_states = len(a.accepts)
    # The composition, position by position: pairs of states after an edit, then what both read.
    edits: list[Edits | None] = []
    layers: list[np.ndarray] = []
    steps: list[tuple[np.ndarray, ...]] = []
    sources: list[np.ndarray] = []
    pairs = np.zeros(0, np.int64)
    for position in range(a.width + 1):
        found = [pairs]
        last = []
        if position:
            p, q = layers[-1] // n_states, layers[-1] % n_states
            place, one, other = a.both(p, q)
            found = [a.to[one] * n_states + a.to[other]]
            steps.append((place, one, other))
            last.append(Edits(a, np.unique(a.states[position - 1]), position - 1, at_end))
        if position == a.width:
            last.append(Edits(a, np.unique(a.states[a.width]), a.width, at_end))
        found += [e.p * n_states + e.q for e in last]
        layer, where = np.unique(np.concatenate(found), return_inverse=True)
        cuts = np.cumsum([len(f) for f in found])
        parts = np.split(where, cuts[:-1])
        sources.append(parts[0])
        for e, target in zip(last, parts[1:], strict=True):
            e.target = target
        edits.append(last)
        layers.append(layer)
    # Trim: keep pairs from which both words can still end together.
    live = [np.zeros(0, bool)] * len(layers)
    live[-1] = a.accepts[layers[-1] // n_states] & a.accepts[layers[-1] % n_states]
    for position in range(a.width - 1, -1, -1):
        place, _, _ = steps[position]
        good = live[position + 1][sources[position + 1]]
        live[position] = np.zeros(len(layers[position]), bool)
        live[position][place[good]] = True
    # Enumerate: paths of the trie up to the edit, then along the trimmed composition.
    item = one_place = other_place = np.zeros(0, np.int64)
    for position in range(a.width + 1):
        if position:
            place, one, other = steps[position - 1]
            target = sources[position]
            good = np.flatnonzero(live[position][target])
            starts = np.searchsorted(place[good], item)
            n = np.searchsorted(place[good], item, "right") - starts
            step = good[wb.ranges(starts, n)]
            one_place = np.repeat(one_place, n) + a.before[one[step]]
            other_place = np.repeat(other_place, n) + a.before[other[step]]
            item = target[step]
        for e, d in zip(edits[position], (position - 1, position), strict=False):
            if position == 0:
                d = 0
            good = np.flatnonzero(live[position][e.target])
            good = good[np.argsort(e.origin[good], kind="stable")]
            origin = e.origin[good]
            state = a.states[d]
            starts = np.searchsorted(origin, state)
            n = np.searchsorted(origin, state, "right") - starts
            step = good[wb.ranges(starts, n)]
            base = np.repeat(a.base[d], n)
            item = np.concatenate([item, e.target[step]])
            one_place = np.concatenate([one_place, base + e.gain_p[step]])
            other_place = np.concatenate([other_place, base + e.gain_q[step]])
    return a.row_of[one_place], a.row_of[other_place]


def exact_groups(codes: np.ndarray, lengths: np.ndarray, key: np.ndarray, low: int, tail: int) -> np.ndarray:
    """Numbers of partitions by key; rows of one key with unlike surroundings are told apart."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group]
    unlike = (codes[:, :low] != codes[head, :low]).any()
    if tail and not unlike:
        from_end = lengths[:, None] - tail + np.arange(tail)
        mine = np.take_along_axis(codes, from_end, 1)
        unlike = (mine != mine[head]).any()
    if unlike:
        rows = [(g, r[:low].tobytes(), r[n - tail : n].tobytes()) for g, r, n in zip(group.tolist(), codes, lengths.tolist(), strict=True)]
        number = {k: i for i, k in enumerate(dict.fromkeys(rows))}
        group = np.array([number[k] for k in rows])
    return group


def neighbours(dealt: DataFrame) -> DataFrame:
    """word, near (how many), best_n and best (the neighbour of largest n, the smallest of equal ones) per partition."""

    def window(part: pa.RecordBatch, c: int, low: int, high: int) -> pa.RecordBatch | None:
        words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
        codes = np.frombuffer(b"".join(w.ljust(c + 1, b"\0") for w in words), np.uint8).reshape(len(words), c + 1)
        longer = codes[:, c] != 0
        group = exact_groups(codes, c + longer.astype(np.int64), np.asarray(part.column("key")), low, c - high)
        sizes = np.bincount(group)
        keep = np.flatnonzero(sizes[group] > 1)
        if not len(keep):
            return None
        codes, longer, group = codes[keep], longer[keep], np.unique(group[keep], return_inverse=True)[1]
        middles = codes[:, low : high + 1].copy()
        middles[~longer, high - low] = 0
        one, other = near_pairs(middles, longer, group, high == c)
        if not len(one):
            return None
        n = np.asarray(part.column("n"))[keep]
        rank = np.empty(len(keep), np.int64)
        rank[np.argsort(np.ascontiguousarray(codes).view(f"S{c + 1}").ravel(), kind="stable")] = np.arange(len(keep))
        mine, theirs = np.concatenate([one, other]), np.concatenate([other, one])
        order = np.lexsort((rank[theirs], -n[theirs], mine))
        mine, theirs = mine[order], theirs[order]
        heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        near = np.diff(np.append(heads, len(mine)))
        best = theirs[heads]
        column = part.column("word")
        return pa.RecordBatch.from_arrays([column.take(pa.array(keep[mine[heads]])), pa.array(near), pa.array(n[best]), column.take(pa.array(keep[best]))], names=["word", "near", "best_n", "best"])

    def windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Consecutive rows of one class and window, a bounded number of cells (and whole partitions) at a time."""
        place = np.stack([np.asarray(batch.column(x)) for x in ("c", "low", "high")], 1)
        cut = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
        for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
            c, low, high = place[begin].tolist()
            key = np.asarray(batch.column("key"))[begin:end]
            borders = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, end - begin)
            at = 0
            while at < end - begin:
                to = int(borders[max(np.searchsorted(borders, at + max(1, BATCH_CELLS // (c + 1)), "right") - 1, np.searchsorted(borders, at, "right"))])
                found = window(batch.slice(begin + at, to - at), c, low, high)
                if found is not None:
                    yield found
                at = to

    @wb.sparing
    def task(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                key = np.asarray(whole.column("key"))
                border = np.flatnonzero(key[1:] != key[:-1])
                if len(border):  # what follows the last border may go on in the next batch
                    yield from windows(whole.slice(0, int(border[-1]) + 1))
                    whole = whole.slice(int(border[-1]) + 1)
                held, rows = [whole], whole.num_rows
        if rows:
            yield from windows(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return dealt.mapInArrow(task, "word string, near long, best_n long, best string")


def window_key(c: Column, low: Column, high: Column) -> Column:
    """What the words of a partition share: class, window, and the text before and after it."""
    tail = c - high
    return F.xxhash64(c, low, high, F.substring("word", F.lit(1), low), F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise(""))


def placed(rows: DataFrame, windows: Column) -> DataFrame:
    """A row per window of each word, with its key."""
    rows = rows.select("word", "n", F.explode(windows).alias("w")).select("word", "n", "w.c", "w.low", "w.high")
    return rows.withColumn("key", window_key(F.col("c"), F.col("low"), F.col("high")))


def halves(c: Column, low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(*[F.struct(c.alias("c"), a.alias("low"), b.alias("high")) for a, b in ((low, middle), (middle, high))])


def deal(words: DataFrame, crowd: int) -> DataFrame:
    """Words by partition: each stands in two halves as the shorter and in two as the longer word of a pair."""
    length, zero = F.length("word"), F.lit(0)
    longer = F.when(length > LEAST_LENGTH, halves(length - 1, zero, length - 1)).otherwise(F.array().cast("array<struct<c:int,low:int,high:int>>"))
    rows = placed(words, F.concat(halves(length, zero, length), longer))
    settled = []
    while True:
        sizes = rows.where(F.col("high") - F.col("low") > 1).groupBy("key").count().where(F.col("count") > crowd).select("key")
        crowded = store.written(sizes, "crowded")
        if not crowded.limit(1).count():
            settled.append(rows)
            break
        few = small_side(crowded)
        wide = F.col("high") - F.col("low") > 1
        settled.append(rows.join(few, "key", "left_anti").unionByName(rows.where(~wide).join(few, "key", "left_semi")))
        rows = placed(rows.where(wide).join(few, "key", "left_semi"), halves(F.col("c"), F.col("low"), F.col("high")))
        rows = store.written(rows, "halved")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more.select(*out.columns))
    return out.select("c", "low", "high", "key", "word", "n").repartition("key").sortWithinPartitions("c", "low", "high", "key")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: forms followed to the last one; each round doubles the steps taken."""
    found = store.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        found = store.written(step, "roots")
        if not found.where("moved").limit(1).count():
            return found.select("word", "root")


def variants(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = store.written(counted(docs), "words")
    near = neighbours(deal(words, crowd))
    found = near.select("word", F.lit(None).cast("long").alias("n"), "near", F.struct((-F.col("best_n")).alias("less"), "best").alias("best"))
    every = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less:bigint,best:string>").alias("best"))
    rows = every.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    good = -F.col("best.less") >= FORM_RATIO * F.col("n")
    rows = rows.select("word", F.when(good, F.col("best.best")).alias("form"), "n", "n_near", F.when(good, -F.col("best.less")).alias("form_n"))
    rows = store.written(rows, "variants")
    named = roots(rows.where("form IS NOT NULL"))
    return rows.join(named, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE {crc_sql.TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
distinct_runs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {crc_sql.of_text("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM distinct_runs, crc),
changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL
  SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION ALL
  SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'other': other}}) AS best FROM near GROUP BY word),
found AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best.less >= 10 * w.n THEN b.best.other END AS form,
         CASE WHEN -b.best.less >= 10 * w.n THEN -b.best.less END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
follow AS (
  SELECT word, coalesce(form, word) AS root, form FROM found
  UNION ALL
  SELECT f.word, g.form, g.form FROM follow f JOIN found g ON g.word = f.root WHERE f.form IS NOT NULL AND g.form IS NOT NULL),
last AS (SELECT f.word, f.root FROM follow f JOIN found g ON g.word = f.root WHERE g.form IS NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM found f JOIN last l ON l.word = f.word
"""
