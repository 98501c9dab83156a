"""Quality and volume metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def set_summary(ratings: DataFrame, by: list[str] | None = None,
                approx: bool = False) -> DataFrame:
    """Ratings, distinct users, distinct items, optionally per group.

    Exact distinct counts by default (two-phase distinct aggregation);
    ``approx=True`` uses HyperLogLog++ sketches (one pass, fixed-size state)."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    aggs = [F.count(F.lit(1)).alias("n_ratings"),
            distinct("user").alias("n_users"),
            distinct("item").alias("n_items")]
    return ratings.groupBy(*(by or [])).agg(*aggs)


# The set-summary log line.
SUMMARY_FORMAT = "{name} set got {n_ratings} ratings from {n_users} users on {n_items} movies."


def summary_line(row, name: str = "Initial") -> str:
    """S5 report line for one :func:`set_summary` row."""
    return SUMMARY_FORMAT.format(name=name, n_ratings=row["n_ratings"], n_users=row["n_users"],
                                 n_items=row["n_items"])


def _errors_full(rows, truth, weights, max_cells: int):
    """(errors per version, cells scored) of a block of hold-out rows, by matrix products."""
    import numpy as np
    miss, tile = np.zeros(len(weights), dtype=np.int64), max(1, max_cells // len(rows))
    for k in range(0, len(weights), tile):
        pred = np.where(rows @ weights[k:k + tile].T > 0, 1.0, -1.0)
        miss[k:k + tile] += (pred != truth[:, None]).sum(axis=0)
    return miss, len(rows) * len(weights)


#: Versions in a leaf of their tree (a row is a leaf of its own), and pairs of nodes that are looked at together.
LEAF, PAIRS = 8, 200_000
#: Hold-out rows that a task prunes together.
BLOCK_ROWS = 100_000


class _Boxes:
    """Points halved along their widest side, level by level, and the box around every node.

    Level k has 2^k nodes of equal size; copies of the last point fill the leaves up (``real`` tells which are none).
    """

    def __init__(self, points, leaf: int):
        import numpy as np
        n, dim = points.shape
        self.leaf, self.depth = leaf, (max(1, -(-n // leaf)) - 1).bit_length()
        order = np.minimum(np.arange(leaf << self.depth), n - 1)
        real = np.arange(leaf << self.depth) < n
        for level in range(self.depth):
            nodes = points[order].reshape(1 << level, -1, dim)
            side = (nodes.max(axis=1) - nodes.min(axis=1)).argmax(axis=1)
            keys = np.take_along_axis(nodes, side[:, None, None], axis=2)[:, :, 0]
            by = np.argsort(keys, axis=1, kind="stable")
            order = np.take_along_axis(order.reshape(1 << level, -1), by, axis=1).ravel()
            real = np.take_along_axis(real.reshape(1 << level, -1), by, axis=1).ravel()
        self.order, self.real = order, real
        self.leaves = points[order].reshape(1 << self.depth, leaf, dim)
        self.low, self.high = [self.leaves.min(axis=1)], [self.leaves.max(axis=1)]
        for _ in range(self.depth):
            self.low.insert(0, np.minimum(self.low[0][0::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][0::2], self.high[0][1::2]))

    def totals(self, per_point) -> list:
        """Sums of a number per point over the nodes of every level."""
        import numpy as np
        out = [np.where(self.real, per_point[self.order], 0).reshape(-1, self.leaf).sum(axis=1)]
        for _ in range(self.depth):
            out.insert(0, out[0][0::2] + out[0][1::2])
        return out


def _errors_pruned(rows, truth, weights, max_cells: int, boxes: _Boxes | None = None):
    """The same counts, scoring fewer cells.

    Rows and versions are halved by where they lie, so that a node holds rows, or weights, that are close together
    (weights of versions far apart in time often are).  If no weights in the box of one node and no row in the
    box of another have a score of the other sign, all their cells have one decision.  Else both are halved, down to
    a row and a few versions, whose cells are scored.  Rounding is allowed for, so counts are exact.  ``boxes`` are those of the weights.
    """
    import numpy as np
    if not (np.isfinite(weights).all() and np.isfinite(rows).all()):
        good, fine = np.isfinite(rows).all(axis=1), np.isfinite(weights).all(axis=1)
        miss, cells = np.zeros(len(weights), dtype=np.int64), 0
        for own, versions, count in ((good, fine, _errors_pruned), (~good, fine, _errors_full), (good | ~good, ~fine, _errors_full)):
            if own.any() and versions.any():
                found, scored = count(rows[own], truth[own], weights[versions], max_cells)
                miss[versions] += found
                cells += scored
        return miss, cells
    versions, held = boxes or _Boxes(weights, LEAF), _Boxes(rows, 1)
    # rows that a positive, and a negative, decision gets wrong
    wrong = [(truth != 1.0).astype(np.int64), (truth != -1.0).astype(np.int64)]
    if_up, if_down = (held.totals(v) for v in wrong)
    n_versions = versions.real.reshape(-1, LEAF).sum(axis=1)
    sure = [np.zeros(1 << k, dtype=np.int64) for k in range(versions.depth + 1)]
    miss, cells, per_leaf = np.zeros((1 << versions.depth, LEAF), dtype=np.int64), 0, max(1, max_cells // LEAF)
    todo = [(0, 0, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while todo:
        i, j, a, b = todo.pop()
        if len(a) > PAIRS:
            todo += [(i, j, a[k:k + PAIRS], b[k:k + PAIRS]) for k in range(0, len(a), PAIRS)]
            continue
        low, high, size = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
        for d in range(weights.shape[1]):
            wl, wh, xl, xh = versions.low[i][a, d], versions.high[i][a, d], held.low[j][b, d], held.high[j][b, d]
            ends = (wl * xl, wl * xh, wh * xl, wh * xh)
            least, most = np.minimum.reduce(ends), np.maximum.reduce(ends)
            low, high, size = low + least, high + most, size + np.maximum(-least, most)
        positive, negative = low > 1e-12 * size, high <= -1e-12 * size
        np.add.at(sure[i], a[positive], if_up[j][b[positive]])
        np.add.at(sure[i], a[negative], if_down[j][b[negative]])
        open_ = ~(positive | negative)
        a, b = a[open_], b[open_]
        if i < versions.depth or j < held.depth:
            if i < versions.depth:
                a, b = np.concatenate([2 * a, 2 * a + 1]), np.concatenate([b, b])
            if j < held.depth:
                a, b = np.concatenate([a, a]), np.concatenate([2 * b, 2 * b + 1])
            if len(a):
                todo.append((min(i + 1, versions.depth), min(j + 1, held.depth), a, b))
            continue
        for k in range(0, len(a), per_leaf):
            own, its = a[k:k + per_leaf], b[k:k + per_leaf]
            score = np.zeros((len(own), LEAF))
            for d in range(weights.shape[1]):
                score += versions.leaves[own, :, d] * held.leaves[its, :, d]
            np.add.at(miss, own, np.where(score > 0, if_up[-1][its][:, None], if_down[-1][its][:, None]))
            cells += int((n_versions[own] * held.real[its]).sum())
    total = sum(np.repeat(s, (LEAF << versions.depth) // len(s)) for s in sure) + miss.ravel()
    out = np.zeros(len(weights), dtype=np.int64)
    out[versions.order[versions.real]] = total[versions.real]
    return out, min(len(rows) * len(weights), len(rows) + cells)


def error_trace(holdout: DataFrame, versions: DataFrame, x: str = "x", y: str = "y",
                max_weights: int = 1_000_000, max_cells: int = 2_000_000, digits: int = 6,
                pruned: bool = False) -> DataFrame:
    """Misclassification rate of each model version on a fixed hold-out.

    ``versions`` is a table (version, weights) of any length.  Its versions are taken in ranges
    of at most ``max_weights`` numbers, stored in a folder each; a range's weight matrix is what the driver holds and
    broadcasts at one time.  Each hold-out partition scores a range with matrix
    products of at most ``max_cells`` cells (rows x versions) and sends one partial error count per
    version, which Spark adds up.  The hold-out is read once and kept, and results of a range are stored before the
    next.  The work is versions x hold-out rows; with ``pruned``, rows whose decision cannot
    change over versions of like weights are not scored again for them, and the column ``scored`` tells how many cells were.
    """
    from itertools import chain

    import numpy as np
    import pandas as pd

    from kestrel.session import remove_scratch, scratch_path

    spark = holdout.sparkSession
    schema = "version long, n_test long, n_err long, error_rate double, scored long"
    out_cols = ["version", "n_test", "n_err", "error_rate"] + (["scored"] if pruned else [])
    low, high, dim = versions.agg(F.min("version"), F.max("version"), F.max(F.size("weights"))).first()
    if low is None:
        return spark.createDataFrame([], schema).select(*out_cols)
    per_range = max(1, max_weights // max(dim, 1))
    stage = scratch_path(spark, "trace-versions")
    (versions.select("version", "weights", F.floor((F.col("version") - low) / per_range).cast("long").alias("_range"))
     .write.partitionBy("_range").parquet(stage))
    staged = spark.read.parquet(stage)
    hold = holdout.select(x, y).persist()
    out = scratch_path(spark, "error-trace")
    count = _errors_pruned if pruned else _errors_full
    for k in range((high - low) // per_range + 1):
        own = staged.filter(F.col("_range") == k).select("version", "weights").orderBy("version").toPandas()
        if own.empty:
            continue
        shared = spark.sparkContext.broadcast((own["version"].to_numpy(), np.stack(own["weights"].to_numpy())))

        def score(batches, shared=shared):
            ids, weights = shared.value
            miss, n, cells = np.zeros(len(ids), dtype=np.int64), 0, 0
            more, waiting = {}, []
            if pruned and np.isfinite(weights).all():
                more["boxes"] = _Boxes(weights, LEAF)
            for pdf in chain(batches, [None]):
                if pdf is not None and not pdf.empty:
                    waiting.append((np.stack(pdf[x].to_numpy()), pdf[y].to_numpy(dtype=float)))
                held = sum(len(v) for _, v in waiting)
                # with pruned, many rows at a time share the boxes of the versions
                if held and (pdf is None or not pruned or held >= BLOCK_ROWS):
                    rows, truth = (np.concatenate(v) for v in zip(*waiting))
                    usable = more if np.isfinite(rows).all() else {}
                    found, scored = count(rows, truth, weights, max_cells, **usable)
                    miss, n, cells, waiting = miss + found, n + held, cells + scored, []
            # a task's cells go with its first version
            yield pd.DataFrame({"version": ids, "n_err": miss, "n_test": np.full(len(ids), n),
                                "scored": np.r_[cells, np.zeros(len(ids) - 1, dtype=np.int64)]})

        (hold.mapInPandas(score, "version long, n_err long, n_test long, scored long").groupBy("version")
         .agg(F.sum("n_test").alias("n_test"), F.sum("n_err").alias("n_err"), F.sum("scored").alias("scored"))
         .select("version", "n_test", "n_err", F.round(F.col("n_err") / F.col("n_test"), digits).alias("error_rate"),
                 "scored")
         .write.mode("append").parquet(out))
        shared.unpersist()
    hold.unpersist()
    remove_scratch(spark, stage)
    return spark.read.schema(schema).parquet(out).select(*out_cols)


def distinct_growth(rows: DataFrame, interval: str, keys: list[str]) -> DataFrame:
    """T10 with C2 / C3: per interval, and so far, how many values of each key were seen for the first time.

    A value counts in its first interval (a minimum per value, combined before the shuffle), so cumulative
    distinct counts are running totals over intervals and exact; no set of values is carried along.
    """
    out = rows.select(interval).distinct()
    for key in keys:
        first = rows.groupBy(key).agg(F.min(interval).alias(interval))
        out = out.join(first.groupBy(interval).agg(F.count(F.lit(1)).alias(f"new_{key}s")), interval, "left").fillna(
            0, [f"new_{key}s"])
    for key in keys:
        out = running_total(out, interval, f"new_{key}s", f"total_{key}s")
    return out


def running_total(per_interval: DataFrame, interval: str, count_col: str,
                  out: str = "n_total") -> DataFrame:
    """Cumulative rows per interval.  Runs on the per-interval aggregate (one
    row per interval), so the un-partitioned running window sees few rows."""
    w = Window.orderBy(interval).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_interval.withColumn(out, F.sum(count_col).over(w))


def rmse_from_sums(pred_sums: DataFrame, truth_sums: DataFrame, keys=("user", "item"),
                   n_test: int | None = None) -> DataFrame:
    """RMSE from per-pair sums: ``pred_sums`` (keys, kp, sp, spp) and ``truth_sums``
    (keys, kr, sr, srr).  A pair contributes ``kr*spp - 2*sp*sr + kp*srr`` (the sum
    over its ``kp * kr`` joined rows) — no joined rows are materialised.  The
    reference denominator is all test rows (``n_test``, default: the sum of kr)."""
    keys = list(keys)
    return rmse_of_pairs(truth_sums.join(pred_sums, keys, "left"), n_test)


def rmse_of_pairs(pairs: DataFrame, n_test: int | None = None, scored: bool = False) -> DataFrame:
    """The same from one row per pair with the sums of both sides (``kp`` is null without predictions); ``scored``
    adds ``n_scored``, the number of predictions."""
    matched = F.col("kp").isNotNull()
    sse_key = F.when(matched, F.col("kr") * F.col("spp") - F.lit(2.0) * F.col("sp") * F.col("sr")
                     + F.col("kp") * F.col("srr")).otherwise(F.lit(0.0))
    sums = pairs.agg(F.sum(sse_key).alias("sse"),
                     F.sum(F.when(matched, F.col("kp") * F.col("kr")).otherwise(F.lit(0)))
                     .alias("n_joined"),
                     F.sum("kr").alias("n_all"), F.coalesce(F.sum("kp"), F.lit(0)).cast("long").alias("n_scored"))
    return rmse_of_sums(sums, n_test, ["n_scored"] if scored else [])


def rmse_of_sums(sums: DataFrame, n_test: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """The same from one row per model with its sums over pairs (sse, n_joined; n_all unless ``n_test`` is given);
    the columns ``keep`` follow."""
    n = F.lit(float(n_test)) if n_test is not None else F.col("n_all").cast("double")
    sse = F.greatest(F.coalesce(F.col("sse"), F.lit(0.0)), F.lit(0.0))
    return sums.select(
        F.round(F.sqrt(sse / n), 6).alias("rmse_ref"),
        F.round(F.sqrt(sse / F.col("n_joined")), 6).alias("rmse_scored"),
        F.coalesce(F.col("n_joined"), F.lit(0)).cast("long").alias("n_joined"),
        (F.lit(n_test) if n_test is not None else F.col("n_all")).cast("long").alias("n_test"),
        *(keep or []))


def pair_sums(df: DataFrame, value: str, prefix: str, keys=("user", "item")) -> DataFrame:
    """(keys, k<prefix>, s<prefix>, s<prefix><prefix>) per pair, partial aggregation map-side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"k{prefix}"),
                                 F.sum(value).alias(f"s{prefix}"),
                                 F.sum(F.col(value) * F.col(value)).alias(f"s{prefix}{prefix}"))


def rmse_fixed_n(predictions: DataFrame, truth: DataFrame, n_test: int | None = None,
                 keys=("user", "item"), pred: str = "prediction",
                 label: str = "rating") -> DataFrame:
    """RMSE with the reference's denominator (all test rows, Q10).

    Semantics are those of an inner equi-join of predictions and truth on
    (user, item) where duplicate pairs multiply (Q11): a pair with ``k_p``
    predictions and ``k_r`` truths contributes ``k_p * k_r`` squared errors.  Those
    pairs are never materialised: each side is reduced to one row per pair first,
    so a hot (user, item) pair costs one row, not ``k^2``.  Also reports the RMSE
    over the scored rows only.
    """
    return rmse_from_sums(pair_sums(predictions, pred, "p", keys),
                          pair_sums(truth, label, "r", keys), keys, n_test)
