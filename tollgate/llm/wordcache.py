"""Token ids of distinct words, kept per Python worker up to a bound.

A text is encoded as the ids of its white-space separated words, one after the other:
the tokenizer normalises, splits and merges within such words only. Each worker holds
the ids of words it has met; when more than ``KEEP_WORDS`` words, or
``KEEP_IDS_PER_WORD`` times as many ids, are held, it starts again with the words at
hand. This bounds memory only: a word that was dropped is encoded again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tollgate.llm import wordbytes as wb

KEEP_WORDS = 700_000
KEEP_IDS_PER_WORD = 6

#: Bytes that surely end a word for the tokenizer, whatever stands beside them.
TOKENIZER_WORD = wb.table(b" \t\n\r", inverse=True)


#: Words met last are kept apart until they are one in so many of the others.
LATE_SHARE = 8


def _with_room(array: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """The array with room for ``wanted`` numbers; it grows by a quarter at least, so few calls copy it."""
    if wanted <= len(array):
        return array
    out = np.empty(max(wanted, used + used // 4), array.dtype)
    out[:used] = array[:used]
    return out


class WordCache:
    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep_words: int | None = None):
        """``encode`` maps distinct words to (ids per word, all ids). Keys are kept in ascending order, late ones apart."""
        self.encode = encode
        self.keep_words = keep_words or KEEP_WORDS
        self.clear()

    def clear(self) -> None:
        """Forget all words: at the bound, and at the end of a task, since workers live on."""
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.late_keys, self.late_slot = self.keys, self.slot
        self._starts, self._flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.words = self.held = 0

    def _add(self, keys: np.ndarray, words: list[str], bounded: bool = True) -> None:
        if bounded and (self.words + len(keys) > self.keep_words or self.held > KEEP_IDS_PER_WORD * self.keep_words):
            self.clear()
        lengths, flat = self.encode(words)
        words_now, held_now = self.words + len(keys), self.held + len(flat)
        self._starts = _with_room(self._starts, self.words + 1, words_now + 1)
        self._starts[self.words + 1 : words_now + 1] = self.held + np.cumsum(lengths)
        self._flat = _with_room(self._flat, self.held, held_now)
        self._flat[self.held : held_now] = flat
        at = np.searchsorted(self.late_keys, keys)
        self.late_keys = np.insert(self.late_keys, at, keys)
        self.late_slot = np.insert(self.late_slot, at, np.arange(self.words, words_now))
        self.words, self.held = words_now, held_now
        # late words join the others when there are many: most calls then move few keys
        if len(self.late_keys) * LATE_SHARE > len(self.keys):
            at = np.searchsorted(self.keys, self.late_keys)
            self.keys, self.slot = np.insert(self.keys, at, self.late_keys), np.insert(self.slot, at, self.late_slot)
            self.late_keys, self.late_slot = self.late_keys[:0], self.late_slot[:0]

    @staticmethod
    def _look(held: np.ndarray, slots: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(held):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        return slots[at], held[at] == keys

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot, known = self._look(self.keys, self.slot, keys)
        if len(self.late_keys) and not known.all():
            rest = np.flatnonzero(~known)
            slot[rest], known[rest] = self._look(self.late_keys, self.late_slot, keys[rest])
        return slot, known

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column, and the first id of each text (one more than texts)."""
        chunk = wb.Chunk(column)
        starts, ends, firsts = chunk.words(TOKENIZER_WORD)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(firsts), np.int64)
        hashes = chunk.hashes(starts, ends)
        order, heads, which = wb.groups(hashes)
        first = order[heads]
        unique = hashes[first]
        slot, known = self._find(unique)
        if not known.all():
            new = np.flatnonzero(~known)
            data = chunk.bytes.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            words = [data[a:b].decode("utf-8", "replace") for a, b in spans]
            self._add(unique[new], words)
            slot, known = self._find(unique)
            if not known.all():  # the cache has just been emptied: encode what is at hand once more
                back = np.flatnonzero(~known)
                spans = zip(starts[first[back]].tolist(), ends[first[back]].tolist(), strict=True)
                self._add(unique[back], [data[a:b].decode("utf-8", "replace") for a, b in spans], bounded=False)
                slot, known = self._find(unique)
        lengths = (self._starts[slot + 1] - self._starts[slot])[which]
        flat = self._flat[wb.ranges(self._starts[slot][which], lengths)]
        edges = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=edges[1:])
        return flat, edges[firsts]
