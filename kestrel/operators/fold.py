"""Sequential fold of an update rule over per-window sums of products.

The Gram frame is read in key order with ``toLocalIterator`` (one partition at a
time, so driver memory is bounded by a partition of *summaries*, never rows).
Windows depend on each other (warm start, T3), which is why this loop is
sequential; its cost is O(windows x iterations x d^2), independent of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from kestrel.operators.gram import settled, unpack
from kestrel.operators.rules import SGD


def window_sums(rule, s, p: int):
    """(G, c, yy) of one window, settled where the rule asks for it."""
    s = np.asarray(s, dtype=float)
    digits = getattr(rule, "digits", None)
    return settled(s, p, digits) if digits else unpack(s, p)


def iter_sorted(df: DataFrame, keys) -> Iterator:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.orderBy(*keys).toLocalIterator(prefetchPartitions=True)


def fold_grams(g: DataFrame, rule, w0, keys="block") -> Iterator[tuple]:
    """Yield ``(key, n, weights)`` after each window, in key order.

    ``keys`` may be a list (e.g. ``["day", "source_rank"]``); then ``key`` is a tuple.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = np.array(w0, dtype=float)
    p = len(w) + 1
    for r in iter_sorted(g, keys):
        G, c, _ = window_sums(rule, r["s"], p)
        w = rule.apply(w, G, c, float(r["n"]))
        k = r[keys[0]] if len(keys) == 1 else tuple(r[x] for x in keys)
        yield k, int(r["n"]), w.copy()


def fold_sampled_grams(g: DataFrame, rule: SGD, w0, keys="block", every=None) -> Iterator[tuple]:
    """As :func:`fold_grams` for per-iteration mini-batch Grams (columns keys, t, n, s).

    Iterations whose sample is empty have no row and leave the weights as they are.
    ``every`` lists all keys in order (default: those with a row), so a key none of whose iterations
    drew a row still gives its (unchanged) version.  Yields ``(key, 0, weights)``; the
    callers know how many rows a key has.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = np.array(w0, dtype=float)
    p = len(w) + 1
    waiting = list(every) if every is not None else None
    current = None

    def skipped(upto):
        while waiting and waiting[0] != upto:
            yield waiting.pop(0), 0, w.copy()
        if waiting:
            waiting.pop(0)
    for r in iter_sorted(g, [*keys, "t"]):
        key = r[keys[0]] if len(keys) == 1 else tuple(r[x] for x in keys)
        if key != current:
            if current is not None:
                yield current, 0, w.copy()
            if waiting is not None:
                yield from skipped(key)
            current = key
        G, c, _ = unpack(np.asarray(r["s"], dtype=float), p)
        w = rule.apply_iter(w, int(r["t"]), G, c, float(r["n"]))
    if current is not None:
        yield current, 0, w.copy()
    if waiting:
        yield from skipped(None)
