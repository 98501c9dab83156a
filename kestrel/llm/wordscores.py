"""Scores that are sums over a text's words: shared by language ID and toxicity.

A batch's distinct words are found by Arrow's dictionary encoding; a worker remembers
the values of words it has seen, within a bound of memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Memory that remembered values may take (the words themselves take about as much again).
CACHE_BYTES = 32 << 20
MAX_CACHED = 800_000


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of every word of every text in a row, where each text begins and the last ends).

    The empty word can be among them (white space at an end of a text); ``word_lists`` leaves it out.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    bounds = lists.offsets.to_numpy()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds - bounds[0]


class WordValues:
    """Remembers one row of numbers per word; ``compute`` gives the rows of new words."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int):
        self.compute, self.width = compute, width
        self.room = max(1000, min(MAX_CACHED, CACHE_BYTES // (8 * width)))
        self.rows: dict[str, int] = {"": 0}
        self.table = np.zeros((self.room + 1, width))

    def __call__(self, words: list[str]) -> np.ndarray:
        at = np.fromiter((self.rows.get(w, -1) for w in words), np.int64, len(words))
        out = self.table[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            out[new] = values = self.compute(fresh)
            if len(self.rows) + len(fresh) > self.room:
                self.rows = {"": 0}
            for word, row in zip(fresh[:self.room - 1], values, strict=False):
                self.rows[word] = k = len(self.rows)
                self.table[k] = row
        return out


_REMEMBERED: dict[str, WordValues] = {}


def remembered(model: str, compute: Callable[[list[str]], np.ndarray], width: int) -> WordValues:
    """The worker's memory for the model of this name: it outlives a task, and goes when another model comes."""
    if model not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[model] = WordValues(compute, width)
    return _REMEMBERED[model]


def text_sums(values: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the words' rows, one row a text; memory for one text at a time."""
    return np.stack([values[index[a:b]].sum(axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
