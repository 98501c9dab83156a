"""Batch trainers for online GLMs over a bounded table.

* :func:`train_count_windows` — V1 jobs (M1, M2): tumbling windows of B rows in
  order-key order, warm-started rule per closed window.
* :func:`train_batches` — V2 jobs (M4-M6, M7, T7): one update per micro-batch key
  (e.g. the day of ``ts``), optionally several sources per batch in rank order.

Both run one distributed aggregation (sums of products per window).  Count windows are then folded on the
executors (``operators.relay``) and their weights written from there; where a window has fewer rows than
dimensions its rows are smaller than its sums, and it is folded from the rows.  Micro-batches, one
update each, are folded on the driver.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.fold import fold_grams, fold_sampled_grams
from kestrel.operators.gram import gram, sampled_gram
from kestrel.operators.ordinal import count_windows
from kestrel.operators.relay import fold_points, fold_sums
from kestrel.operators.rules import SGD
from kestrel.session import scratch_path
from kestrel.streaming.modelstore import ModelStore


def _store(spark, store: ModelStore | None, model_id: str | None) -> ModelStore:
    if store is not None:
        return store
    return ModelStore(spark, scratch_path(spark, "models"), model_id or uuid.uuid4().hex)


def window_grams(points: DataFrame, dim: int, window: int, order_col="seq",
                 dense: bool = False) -> DataFrame:
    """Closed count windows -> per-block sums of products (lazy)."""
    framed = count_windows(points, order_col, window, dense=dense)
    return gram(framed.filter(F.col("closed")), "block", dim)


def train_count_windows(points: DataFrame, rule, dim: int, window: int,
                        order_col="seq", w0=None, dense: bool = False,
                        store: ModelStore | None = None, model_id: str | None = None) -> ModelStore:
    """V1 online training: version k = weights after closed window k (version -1 = w0)."""
    spark = points.sparkSession
    store = _store(spark, store, model_id)
    w0 = np.zeros(dim) if w0 is None else np.asarray(w0, dtype=float)
    n_windows = points.count() // window
    if window < dim:
        closed = count_windows(points, order_col, window, dense=dense).filter(F.col("closed"))
        folded = fold_points(closed, w0, rule, dim, window, n_windows)
    else:
        folded = fold_sums(window_grams(points, dim, window, order_col, dense), w0, rule, dim, n_windows)
    store.write_folded(w0, folded, window)
    return store


def train_batches(points: DataFrame, rule, dim: int, batch_keys="day", w0=None,
                  sample_col: str = "seq", seed: int = 42, hash_fn=None,
                  store: ModelStore | None = None, model_id: str | None = None) -> ModelStore:
    """V2 streaming SGD over stored micro-batches: one update per distinct batch key.

    ``batch_keys`` may list several columns (e.g. ``["day", "source_rank"]`` for
    several training streams updating one model in turn, T7).  Version k is the
    model after the k-th batch in key order; version -1 is ``w0``.
    """
    spark = points.sparkSession
    store = _store(spark, store, model_id)
    if w0 is None:
        raise ValueError("initial weights must be set before training")
    w0 = np.asarray(w0, dtype=float)
    keys = [batch_keys] if isinstance(batch_keys, str) else list(batch_keys)
    if isinstance(rule, SGD) and rule.fraction < 1.0:
        g = sampled_gram(points, keys, dim, rule.iterations, rule.fraction, sample_col, seed,
                         hash_fn=hash_fn)
        counts = {tuple(r[k] for k in keys): r["n"] for r in
                  points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}
        every = [k if len(keys) > 1 else k[0] for k in sorted(counts)]
        folded = ((key, counts[key if len(keys) > 1 else (key,)], w)
                  for key, _, w in fold_sampled_grams(g, rule, w0, keys, every))
    else:
        folded = fold_grams(gram(points, keys, dim), rule, w0, keys)

    def rows():
        seen = 0
        for version, (key, n, w) in enumerate(folded):
            seen += n
            yield version, key if isinstance(key, tuple) else (key,), n, seen, w

    store.write_training(w0, rows())
    return store


def weights_long(versions: DataFrame, digits: int = 6) -> DataFrame:
    """Model versions -> long form (version, idx, weight) rounded, for reports and SQL checks."""
    return (versions.select("version", F.posexplode("weights").alias("idx", "w"))
            .select("version", F.col("idx").cast("long").alias("idx"),
                    F.round("w", digits).alias("weight")))
