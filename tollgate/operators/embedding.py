"""Embedding and token-level classification of texts.

``Embedder`` is the plug for a model: any object with ``dim`` and ``embed(list of
texts) -> matrix``. The built-in one counts hashed character trigrams. It is
deterministic and needs no weights; its scores are not those of a language model.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.runs import in_runs, list_rows, runs
from tollgate.functions.text import words
from tollgate.functions.vectors import best_of
from tollgate.operators.similarity import unit_rows
from tollgate.sources.policies import DEFAULT_EXAMPLES

UNKNOWN_CLASS = "Class 5: Unknown"
#: Texts of which a vocabulary is made, and its words that are embedded at once.
VOCABULARY_BYTES = 8 << 20
WORDS_AT_ONCE = 8192


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class TrigramEmbedder:
    """Counts of ``(961 a + 31 b + c) mod dim`` over the trigrams of ``' ' + text + ' '``."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            if not text:
                continue
            # at most 993 times the largest code point, which fits 32 bits
            codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
            grams = (codes[:-2] * np.uint32(961) + codes[1:-1] * np.uint32(31) + codes[2:]) % np.uint32(self.dim)
            out[row] = np.bincount(grams, minlength=self.dim)
        return out


def embed_text(col: Column, make: Callable[[], Embedder] = TrigramEmbedder) -> Column:
    """Unit vector of the lower-cased text. ``make`` runs once per task."""

    def each() -> Callable[[pa.Array], pa.Array]:
        model = make()
        return lambda texts: list_rows(unit_rows(model.embed([t or "" for t in texts.to_pylist()])))

    return in_runs(each, "array<double>")(F.lower(col))


def embed_tokens(col: Column, make: Callable[[], Embedder] = TrigramEmbedder) -> Column:
    """One unit vector per word of the whole text."""

    def each() -> Callable[[pa.Array], list]:
        model = make()
        return lambda lists: [None if w is None else list(unit_rows(model.embed(w))) for w in lists.to_pylist()]

    # a word of some bytes becomes a vector
    return in_runs(each, "array<array<double>>", 1 << 16)(words(F.lower(col)))


def example_scores(
    text: Column, examples: Mapping[str, Sequence[str]], make: Callable[[], Embedder] = TrigramEmbedder
) -> Column:
    """MaxSim (mean) of the text against each example, in class and example order.

    The distinct words of about ``VOCABULARY_BYTES`` of text are scored once. Null for blank text.
    """
    phrases = [phrase.lower().split() for texts in examples.values() for phrase in texts]

    def each() -> Callable[[pa.Array], pa.Array]:
        model = make()
        tokens = unit_rows(model.embed([w for p in phrases for w in p]))
        starts = np.cumsum([0] + [len(p) for p in phrases[:-1]])

        def score(lists: pa.Array) -> pa.Array:
            given = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)) > 0
            coded = lists.flatten().dictionary_encode()
            best = np.zeros((len(coded.dictionary), len(phrases)))
            for at in range(0, len(best), WORDS_AT_ONCE):
                similar = unit_rows(model.embed(coded.dictionary.slice(at, WORDS_AT_ONCE).to_pylist())) @ tokens.T
                best[at : at + WORDS_AT_ONCE] = np.maximum.reduceat(similar, starts, axis=1)
            means, first = [np.zeros((0, len(phrases)))], 0
            for part in runs(lists):
                sizes = np.asarray(pc.fill_null(pc.list_value_length(part), 0), np.int64)
                filled = sizes[sizes > 0]
                if len(filled):
                    codes = np.asarray(coded.indices.slice(first, int(filled.sum())))
                    ends = np.concatenate([[0], np.cumsum(filled)[:-1]])
                    means.append(np.add.reduceat(best[codes], ends, axis=0) / filled[:, None])
                first += int(filled.sum())
            return list_rows(np.concatenate(means), given)

        return score

    return in_runs(each, "array<double>", VOCABULARY_BYTES, 1 << 16, once=False)(words(F.lower(text)))


def classify_texts(
    df: DataFrame,
    text: str,
    name: str,
    examples: Mapping[str, Sequence[str]] | None = None,
    make: Callable[[], Embedder] = TrigramEmbedder,
) -> DataFrame:
    """Adds struct ``name``: ``predicted_class``, ``confidence``, ``class_scores``, ``error``.

    No shuffle. A class without examples scores 0, a blank text is an error row
    with the unknown class.
    """
    given = dict(examples if examples is not None else DEFAULT_EXAMPLES)
    raw = df.withColumn("_scores", example_scores(F.col(text), given, make))
    at = 0
    per_class = []
    for texts in given.values():
        part = F.array_max(F.slice(F.col("_scores"), at + 1, len(texts))) if texts else F.lit(0.0)
        per_class.append(part)
        at += len(texts)
    ready = raw.withColumn("_classes", F.array(*per_class) if per_class else F.lit(None).cast("array<double>"))
    best = best_of(F.col("_classes"))
    names = F.array(*[F.lit(c) for c in given]) if given else F.lit(None).cast("array<string>")
    blank = F.col("_scores").isNull()
    result = F.struct(
        F.when(blank, F.lit(UNKNOWN_CLASS)).otherwise(F.element_at(names, best["index"] + 1)).alias("predicted_class"),
        F.when(blank, 0.0).otherwise(best["score"]).alias("confidence"),
        F.when(~blank, F.map_from_arrays(names, F.col("_classes"))).alias("class_scores"),
        F.when(blank, F.lit("'text' field required.")).alias("error"),
    )
    return ready.withColumn(name, result).drop("_scores", "_classes")
