"""Secret scans: fixed patterns, and a character convolutional network over further candidates.

Patterns give the base findings. A run is one of ``[A-Za-z0-9+/_.=-]`` of ``LEAST_RUN``
characters or more. What the base findings leave of a run are its open stretches, each a
candidate of its own, also a short one; one longer than ``INSIDE`` is seen through windows
that start every ``STEP`` characters, the last one at its end, so no character of a run goes
unscored. The network sees the characters of a window and those around it; windows that
pass are findings, and those of a stretch that overlap are one finding. It is trained with numpy on labelled findings: base findings of a sample of at most
about ``FIT_DOCUMENTS`` documents are positive, other candidates of the sample negative,
and ``MADE`` seeded random keys in sampled surroundings stand for kinds that have no
pattern. On findings held out from training, scores are calibrated (Platt) and the
threshold is the highest one that keeps a recall of ``RECALL``. The sample bounds
training only: every window of every whole text is scored.

Defined cases: a null or empty text has no findings; base findings stay whatever the
network says, and their characters are not reported again; equal
spans of two kinds are both reported; repeated rows give repeated results; without any
labelled finding the random keys alone are positive; only ``doc_id`` and ``text``
(and ``n_chars`` when redacting) are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import wordbytes as wb

#: Fixed patterns of the base findings, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "cnn"]
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
MARK = "[SECRET]"

#: The length of the shortest value that a base pattern labels.
LEAST_RUN = 12
FIT_DOCUMENTS = 20_000
FIT_FINDINGS = 4_000
MADE = 600
RECALL = 0.99
BEFORE, INSIDE, AFTER = 16, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
STEP = 10
#: Windows that are built at a time.
BLOCK = 16_384
EMBED, FILTERS, REACH = 8, 24, 5
EPOCHS, BATCH, RATE = 10, 64, 0.005
SEED = 11

RUN_BYTE = wb.table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
HEX_BYTE = wb.table(b"0123456789abcdef")
SETTING = wb.table(b":=")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings of a text."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(found)


class Candidates:
    """Base findings, and the windows of all runs, of one chunk of texts."""

    def __init__(self, column: pa.Array):
        chunk = wb.Chunk(column)
        self.data, self.offsets = data, offsets = chunk.bytes, chunk.offsets
        starts, ends, _ = chunk.words(RUN_BYTE)
        long = ends - starts >= LEAST_RUN
        starts, ends = starts[long], ends[long]
        hex_starts, hex_ends, _ = chunk.words(HEX_BYTE)
        marks = [hex_starts[hex_ends - hex_starts >= LEAST_HEX], np.flatnonzero(SETTING[data])]
        raw = data.tobytes()
        marks.append(np.asarray([m.start() for m in re.finditer(b"AKIA", raw)], np.int64))
        suspects = np.unique(np.searchsorted(offsets, np.concatenate(marks), "right") - 1)
        self.base: dict[int, list[tuple[int, int, int]]] = {}
        for row in suspects.tolist():
            text = raw[offsets[row] : offsets[row + 1] - 1].decode("utf-8", "replace")
            if found := base_spans(text):
                self.base[row] = found
        row = np.searchsorted(offsets, starts, "right") - 1
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        shift = starts - (points[starts] - points[offsets[row]])  # from characters of the text to bytes of the chunk, within a run
        based = np.isin(row, np.asarray(sorted(self.base), np.int64))
        plain = ~based
        parts = [np.stack([row, starts, ends, shift, np.zeros_like(row), np.zeros_like(row)], 1)[plain]]
        for own, a, b, move in np.stack([row, starts, ends, shift], 1)[based].tolist():
            parts.append(np.asarray([(own, low, high, move, *kinds) for low, high, *kinds in pieces(a, b, [(x + move, k, y + move) for x, k, y in self.base[own]])], np.int64))
        row, low, high, shift, covered, named = np.concatenate(parts).T
        counts = -(-np.maximum(high - low - INSIDE, 0) // STEP) + 1
        self.piece = np.repeat(np.arange(len(low)), counts)
        number = np.arange(len(self.piece)) - (np.cumsum(counts) - counts)[self.piece]
        last = np.maximum(high - INSIDE, low)[self.piece]
        self.first = np.minimum(low[self.piece] + STEP * number, last)
        self.last = np.minimum(self.first + INSIDE, high[self.piece])
        self.row, self.covered = row[self.piece], covered[self.piece] > 0
        self.start, self.end = self.first - shift[self.piece], self.last - shift[self.piece]
        others = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data < 0x30) | (data > 0x39), out=others[1:])
        # digits only are a number, for the network no secret
        self.label = self.covered & ((named[self.piece] > 0) | (others[self.last] > others[self.first]))

    def windows_of(self, which: np.ndarray) -> np.ndarray:
        return windows(self.data, self.offsets, self.row[which], self.first[which], self.last[which])

    @property
    def windows(self) -> np.ndarray:
        return self.windows_of(np.arange(len(self.row)))


def pieces(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, bool]]:
    """(start, end, covered, by a named pattern) of the stretches of a run inside and outside of base findings."""
    out: list[tuple[int, int, bool, bool]] = []
    at = start
    for low, kind, high in base:
        low, high = max(low, start), min(high, end)
        if low >= high:
            continue
        if low > at:
            out.append((at, low, False, False))
        if out and out[-1][2] and low < at:
            out[-1] = (out[-1][0], max(at, high), True, out[-1][3] or kind < 2)
        else:
            out.append((low, high, True, kind < 2))
        at = max(at, high)
    return [*out, (at, end, False, False)] if at < end else out


def windows(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes before, inside (at most INSIDE) and after each window; 0 where the text or the window ends."""
    out = np.zeros((len(starts), WIDTH), np.uint8)
    low, high = offsets[row], offsets[row + 1] - 1

    def put(column: int, at: np.ndarray, good: np.ndarray) -> None:
        out[good, column] = data[at[good]]

    for i in range(BEFORE):
        at = starts - BEFORE + i
        put(i, at, at >= low)
    for i in range(INSIDE):
        put(BEFORE + i, starts + i, starts + i < ends)
    for i in range(AFTER):
        at = ends + i
        put(BEFORE + INSIDE + i, at, at < high)
    return out


class CharNet:
    """Embedding, one convolution, maxima over candidate and surroundings, and a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (256, EMBED))
        self.kernel = rng.normal(0, (2 / (EMBED * REACH)) ** 0.5, (EMBED * REACH, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.2, 2 * FILTERS)
        self.shift = np.zeros(1)
        self.scale = (1.0, 0.0)
        self.threshold = 0.5

    def _forward(self, x: np.ndarray):
        embedded = self.embed[x]
        padded = np.pad(embedded, ((0, 0), (REACH // 2, REACH // 2), (0, 0)))
        columns = np.lib.stride_tricks.sliding_window_view(padded, REACH, axis=1)
        columns = np.ascontiguousarray(columns.swapaxes(2, 3)).reshape(len(x), WIDTH, REACH * EMBED)
        active = np.maximum(columns @ self.kernel + self.bias, 0)
        inside = np.zeros(WIDTH, bool)
        inside[BEFORE : BEFORE + INSIDE] = True
        inner = np.where(inside[None, :, None] & (x > 0)[:, :, None], active, 0)
        outer = np.where(~inside[None, :, None], active, 0)
        pooled = np.concatenate([inner.max(1), outer.max(1)], 1)
        return columns, inner, outer, pooled, pooled @ self.out + self.shift[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x) + b, -50, 50)))

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        columns, inner, outer, pooled, logit = self._forward(x)
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / weight.sum()
        back = error[:, None] * self.out[None, :]
        active = np.zeros((len(x), WIDTH, FILTERS))
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for part, slot in ((inner, slice(0, FILTERS)), (outer, slice(FILTERS, 2 * FILTERS))):
            at = part.argmax(1)
            np.add.at(active, (rows, at, filters), back[:, slot] * (pooled[:, slot] > 0))
        flat = active.reshape(-1, FILTERS)
        to_columns = (flat @ self.kernel.T).reshape(len(x), WIDTH, REACH, EMBED)
        embed = np.zeros((len(x), WIDTH + REACH - 1, EMBED))
        for i in range(REACH):
            embed[:, i : i + WIDTH] += to_columns[:, :, i]
        embed = embed[:, REACH // 2 : REACH // 2 + WIDTH]
        table = np.stack([np.bincount(x.ravel(), embed[:, :, j].ravel(), 256) for j in range(EMBED)], 1)
        return [table, columns.reshape(-1, REACH * EMBED).T @ flat, flat.sum(0), pooled.T @ error, np.array([error.sum()])]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> None:
        """Train on four fifths (Adam), then calibrate and choose the threshold on the rest."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, own = order[::5], np.setdiff1d(order, order[::5])
        weight = np.where(y > 0, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum())))
        values = [self.embed, self.kernel, self.bias, self.out, self.shift]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        steps = EPOCHS * -(-len(own) // BATCH) + 1
        for _ in range(EPOCHS):
            for at in range(0, len(own), BATCH):
                batch = own[rng.permutation(len(own))[:BATCH]] if at else own[:BATCH]
                step += 1
                rate = RATE * (1 - step / steps)
                for i, g in enumerate(self._gradients(x[batch], y[batch], weight[batch])):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    values[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self._calibrate(self.logits(x[held]), y[held])

    def _calibrate(self, logit: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps with smoothed targets, and the threshold for the recall."""
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        scale = np.array([1.0, 0.0])
        basis = np.stack([logit, np.ones_like(logit)], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(basis @ scale, -50, 50)))
            hessian = (basis * (p * (1 - p) + 1e-9)[:, None]).T @ basis + 1e-3 * np.eye(2)
            scale = scale - np.clip(np.linalg.solve(hessian, basis.T @ (p - target) + 1e-3 * (scale - [1, 0])), -2, 2)
        self.scale = (float(scale[0]), float(scale[1]))
        good = np.sort(1 / (1 + np.exp(-np.clip(basis @ scale, -50, 50)))[y > 0])
        self.threshold = float(good[int(len(good) * (1 - RECALL))]) if len(good) else 0.5


def made_findings(surroundings: np.ndarray, count: int = MADE, seed: int = SEED) -> np.ndarray:
    """Windows with seeded random keys in place of the candidates of other windows."""
    rng = np.random.default_rng(seed)
    mixed = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    sets = [mixed, np.append(mixed, [0x2B, 0x2F]), np.append(mixed, [0x5F, 0x2D]), mixed[26:]]
    out = surroundings[rng.integers(0, len(surroundings), count)].copy()
    for n in range(count):
        size = int(rng.integers(20, INSIDE + 1))
        out[n, BEFORE : BEFORE + INSIDE] = 0
        out[n, BEFORE : BEFORE + size] = rng.choice(sets[n % len(sets)], size)
        if n % 3 == 0:
            out[n, BEFORE + 3 + n % 2] = 0x5F
    return out


def joined(surroundings: np.ndarray, count: int = MADE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows along long runs, and labels: each run joins plain words of other windows, every second one also a random key."""
    rng = np.random.default_rng(seed)
    mixed = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    sets = [mixed, np.append(mixed, [0x2B, 0x5F]), mixed[26:]]
    words = [w for row in surroundings[rng.integers(0, len(surroundings), count)] for w in re.findall(rb"[A-Za-z0-9_-]{2,16}", row[: BEFORE + INSIDE].tobytes())] or [b"path", b"file"]
    out, label = np.zeros((count, WIDTH), np.uint8), np.arange(count) % 2
    for n in range(count):

        def plain() -> bytes:
            line = b""
            while len(line) < WIDTH:
                word = words[int(rng.integers(len(words)))]
                line += [word, word.lower(), word.title(), b"%d" % rng.integers(10_000)][int(rng.integers(4))] + b"///.-_="[(at := int(rng.integers(7))) : at + 1]
            return line

        before, after, key = plain(), plain(), b""
        start = len(before)
        if label[n]:
            key = rng.choice(sets[n // 2 % len(sets)], int(rng.integers(20, INSIDE + 1))).tobytes()
            after = b"/.-_="[(at := int(rng.integers(5))) : at + 1] + after
            # of the windows along a run, one holds a short key whole, and all but half a step of a long one
            low, high = len(key) - INSIDE, 0
            start += int(rng.integers(low, high + 1)) if high - low >= STEP else int(rng.integers((low + high - STEP) // 2, (low + high + STEP) // 2 + 1))
        line = before + key + after
        out[n] = np.frombuffer(line[start - BEFORE : start - BEFORE + WIDTH], np.uint8)
    return out, label.astype(float)


def capitals(plain: np.ndarray) -> np.ndarray:
    """Every second window in capitals: words in capitals are no secrets either."""
    out = plain[::2].copy()
    out[(out >= 0x61) & (out <= 0x7A)] -= 0x20
    return out


def train(docs: DataFrame) -> CharNet:
    """The network for these documents, from a bounded sample of them."""
    total = docs.count()
    share = min(1.0, FIT_DOCUMENTS / max(1, total))
    highest = min((1 << 63) - 1, int((2 * share - 1) * (1 << 63)))
    sample = docs.select("text").where(F.xxhash64("text", F.lit(SEED)) <= F.lit(highest))

    @wb.sparing
    def task(batches):
        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                found = Candidates(batch.column("text").slice(first, rows))
                for at in range(0, len(found.row), BLOCK):
                    own = found.windows_of(np.arange(at, min(at + BLOCK, len(found.row))))
                    columns = [pa.array([w.tobytes() for w in own], pa.binary()), pa.array(found.label[at : at + BLOCK])]
                    yield pa.RecordBatch.from_arrays(columns, names=["window", "label"])

    rows = sample.mapInArrow(task, "window binary, label boolean").distinct()
    x, y = [], []
    for label in (True, False):
        for row in rows.where(F.col("label") == label).orderBy(F.xxhash64("window"), "window").limit(FIT_FINDINGS // 2).collect():
            x.append(np.frombuffer(bytes(row["window"]), np.uint8))
            y.append(float(label))
    plain = np.stack(x) if x else np.full((1, WIDTH), 0x20, np.uint8)
    made = made_findings(plain)
    shouted = capitals(plain[np.asarray(y if x else [0.0]) == 0])
    long, of_long = joined(plain[np.asarray(y if x else [0.0]) == 0] if 0.0 in y or not x else plain)
    net = CharNet()
    net.fit(np.concatenate([plain, shouted, made, long]), np.concatenate([y if x else [0.0], np.zeros(len(shouted)), np.ones(len(made)), of_long]))
    return net


def spans_of(found: Candidates, net: CharNet) -> dict[int, list[tuple[int, int, int]]]:
    """All findings of a chunk by row, each row in order of start, then kind."""
    out = {row: list(spans) for row, spans in found.base.items()}
    open_ = np.flatnonzero(~found.covered)
    last = -1
    for at in range(0, len(open_), BLOCK):
        own = open_[at : at + BLOCK]
        for n in own[net.probabilities(found.windows_of(own)) >= net.threshold].tolist():
            spans = out.setdefault(int(found.row[n]), [])
            if last == found.piece[n] and found.start[n] < spans[-1][2]:
                spans[-1] = (spans[-1][0], 3, int(found.end[n]))
            else:
                spans.append((int(found.start[n]), 3, int(found.end[n])))
            last = found.piece[n]
    return {row: sorted(spans) for row, spans in out.items()}


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """Findings of every document: base counts and digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(net or train(docs))
    names = [x.split()[0] for x in RESULT.split(", ")]
    nothing = hashlib.sha256(b"").hexdigest()

    @wb.sparing
    def task(batches):
        model = shared.value
        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                part = batch.slice(first, rows)
                found = Candidates(part.column("text"))
                spans = spans_of(found, model)
                counts = np.zeros((3, rows), np.int64)
                digest = [nothing] * rows
                for row, base in found.base.items():
                    for _, kind, _ in base:
                        counts[kind, row] += 1
                    digest[row] = hashlib.sha256(listed(base).encode()).hexdigest()
                texts = [listed(spans.get(i, [])) for i in range(rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts), pa.array(digest), pa.array(texts)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, RESULT)


def covered(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    low = high = None
    for a, _, b in [*spans, (len(text) + 1, 0, len(text) + 1)]:
        if high is None or a >= high:
            if high is not None:
                out += [text[at:low], MARK]
                at = high
            low, high = a, b
        else:
            high = max(high, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """The documents with secrets replaced in ``text`` and ``n_chars`` brought up to date; other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(net or train(docs))

    @wb.sparing
    def task(batches):
        model = shared.value
        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                part = batch.slice(first, rows)
                spans = spans_of(Candidates(part.column("text")), model)
                if spans:
                    texts = part.column("text").to_pylist()
                    sizes = part.column("n_chars").to_pylist() if "n_chars" in part.schema.names else None
                    for row, own in spans.items():
                        texts[row] = covered(texts[row], own)
                        if sizes is not None:
                            sizes[row] = len(texts[row])
                    part = part.set_column(part.schema.names.index("text"), "text", pa.array(texts, part.column("text").type))
                    if sizes is not None:
                        at = part.schema.names.index("n_chars")
                        part = part.set_column(at, "n_chars", pa.array(sizes, part.column("n_chars").type))
                yield part

    return docs.mapInArrow(task, docs.schema)
