"""BPE encoding and decoding by a depth-first walk over the prefix trie of distinct words.

The encoding of a prefix is known by its last token alone: the tokens before it are the
encoding of the shorter prefix. Sorted pieces are walked as a trie; for every new node
the last token is the vocabulary entry that ends there and forms a valid pair with the
last token of the prefix before it, where a pair is valid when merging its two strings
by rank gives exactly that pair. Pieces that share a prefix share its states, and the
cost is linear in the characters of the trie, also for one very long piece. The end of
a word is a leaf of its own, for its last symbol carries the end mark.

Defined cases: a null text is empty; an empty text has no ids and decodes to the empty
text; only ``doc_id``, ``text`` and the columns named in ``extra`` are read; repeated
rows give repeated results; a null doc_id stays null.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import wordbytes as wb
from tollgate.llm.wordcache import WordCache

KEEP_PIECES = 100_000
KEEP_PAIRS = 300_000

#: ASCII and the letters U+00C0 to U+017F are the same before and after composition, and
#: fold one by one; other characters go through the tokenizer's own normaliser and splitter.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ſ]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    code = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
    return [chr(code[b]) for b in range(256)]


def ends_trie(tokens: dict[str, int]) -> dict:
    """A trie over the entries read backwards; the empty key holds the id."""
    root: dict = {}
    for text, token in tokens.items():
        node = root
        for character in reversed(text):
            node = node.setdefault(character, {})
        node[""] = token
    return root


class TrieBpe:
    """Encoder for one tokenizer file (byte-level BPE with an end-of-word mark)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in {**self.vocab, **self.special}.items()}
        self.rank = {tuple(p if isinstance(p, list) else p.split(" ")): r for r, p in enumerate(model["merges"])}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.symbol = byte_symbols()
        #: Proper prefixes use entries without the mark, leaves those with it.
        self.inner = {s: i for s, i in self.vocab.items() if not s.endswith(self.end)}
        self.leaf = {s[: -len(self.end)]: i for s, i in self.vocab.items() if s.endswith(self.end)}
        self.inner_ends = ends_trie(self.inner)
        self.leaf_ends = ends_trie(self.leaf)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.cache = WordCache(self.encode_words)
        self.texts = [b""] * (max(self.strings) + 1)
        for i, s in self.strings.items():
            self.texts[i] = s.encode("utf-8")

    def symbols(self, token: int) -> list[str]:
        text = self.strings[token]
        if text.endswith(self.end) and len(text) > len(self.end):
            text = text[: -len(self.end)]
            return [*text[:-1], text[-1] + self.end]
        return list(text)

    def merged(self, parts: list[str]) -> list[str]:
        """Merges by rank, the leftmost of equal ones first: only for strings of one or two tokens."""
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        return parts

    def valid_pair(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > KEEP_PAIRS:
                self.pairs.clear()
            found = self.merged(self.symbols(left) + self.symbols(right)) == [self.strings[left], self.strings[right]]
            self.pairs[left, right] = found
        return found

    def valid_alone(self, token: int) -> bool:
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self.merged(self.symbols(token)) == [self.strings[token]]
        return found

    def _last_token(self, piece: str, to: int, last: list[int], node: dict) -> int:
        """The last token of ``piece[:to]``, given those of all shorter prefixes.

        ``node`` is the root of the backward trie of the entries that may end here.
        """
        found = []
        for at in range(to - 1, -1, -1):
            node = node.get(piece[at])
            if node is None:
                break
            token = node.get("")
            if token is not None:
                found.append((at, token))
        pairs = self.pairs
        for at, token in reversed(found):
            if at == 0:
                if self.valid_alone(token):
                    return token
                continue
            good = pairs.get((last[at], token))
            if good is None:
                good = self.valid_pair(last[at], token)
            if good:
                return token
        raise ValueError(f"no token ends {piece[:to]!r}")

    def walk(self, pieces: list[str]) -> None:
        """Encode distinct new pieces, given as byte symbols, and keep their ids."""
        last: list[int] = [-1]
        before = ""
        length = {}
        for piece in sorted(pieces):
            shared = 0
            stop = min(len(before), len(piece), len(last)) - 1
            while shared < stop and before[shared] == piece[shared]:
                shared += 1
            del last[shared + 1 :]
            for to in range(shared + 1, len(piece)):
                last.append(self._last_token(piece, to, last, self.inner_ends))
            token = self._last_token(piece, len(piece), last, self.leaf_ends)
            ids = [token]
            at = len(piece) - (len(self.strings[token]) - len(self.end))
            while at > 0:
                token = last[at]
                ids.append(token)
                size = length.get(token)
                if size is None:
                    size = length[token] = len(self.strings[token])
                at -= size
            ids.reverse()
            self.pieces[piece] = ids
            before = piece

    def split(self, word: str) -> list[str]:
        """The pieces of one word without special tokens, as byte symbols."""
        if word.isascii() and word.isprintable():
            return PIECE.findall(word.lower())
        if PLAIN.fullmatch(word):
            symbol = self.symbol
            found = PIECE.findall(word.lower())
            return [p if p.isascii() else "".join([symbol[b] for b in p.encode()]) for p in found]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        gc.disable()  # many small lists and no cycles: collections would only walk the vocabulary
        try:
            return self._encode_words(words)
        finally:
            gc.enable()

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > KEEP_PIECES:
            self.pieces.clear()
        parts: list[list] = []
        new = set()
        for word in words:
            if "<|" in word and self.split_special.search(word):
                found = []
                for bit in self.split_special.split(word):
                    if bit in self.special:
                        found.append(self.special[bit])
                    elif bit:
                        found.extend(self.split(bit))
            else:
                found = self.split(word)
            parts.append(found)
            for p in found:
                if p not in self.pieces and p.__class__ is str:
                    new.add(p)
        self.walk(list(new))
        pieces = self.pieces
        flat: list[int] = []
        lengths = np.empty(len(words), np.int64)
        for n, found in enumerate(parts):
            before = len(flat)
            for p in found:
                if p.__class__ is str:
                    flat += pieces[p]
                else:
                    flat.append(p)
            lengths[n] = len(flat) - before
        return lengths, np.asarray(flat, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and the first id of each text (one more than texts)."""
        return self.cache.ids(column)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as the tokenizer gives it: token strings with a space between."""
        return b" ".join(map(self.texts.__getitem__, ids.tolist()))


_encoders: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    """The encoder of the running task; tasks drop it at their end."""
    if path not in _encoders:
        _encoders[path] = TrieBpe(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``extra`` and the ids of every text.

    ``path`` is the tokenizer file, readable on every node.
    """

    @wb.sparing
    def task(batches):
        bpe = encoder(path)
        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                part = batch.slice(first, rows)
                flat, edges = bpe.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32)))
                columns = [part.column("doc_id"), *(part.column(c) for c in extra), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *extra, "ids"])
        _encoders.clear()

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra]
    schema = ", ".join(["doc_id long", *kinds, "ids array<int>"])
    return docs.select(*dict.fromkeys(["doc_id", "text", *extra])).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(task, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; per document the number of ids and the digests of ids and decoded text."""

    @wb.sparing
    def task(batches):
        bpe = encoder(path)
        for batch in batches:
            for first, rows in wb.row_runs(batch.column("text")):
                part = batch.slice(first, rows)
                flat, edges = bpe.encode(part.column("text"))
                little = flat.astype("<u4")
                id_digest, text_digest = [], []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    id_digest.append(hashlib.sha256(little[a:b]).hexdigest())
                    text_digest.append(hashlib.sha256(bpe.decode(flat[a:b])).hexdigest())
                columns = [part.column("doc_id"), pa.array(np.diff(edges)), pa.array(id_digest), pa.array(text_digest)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        _encoders.clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, schema)
