"""Sequential folds over windows, run on the executors.

Online training is a chain: window k + 1 starts from the weights that window k ended with.  Here the chain runs in
one barrier stage.  Consecutive windows form runs; a run lies in one task, which reads it batch by batch (it holds one
window at a time), folds it and hands its last weights to the others.  Nothing but finished weights leaves the
stage, as rows of a frame that can be written where they are.  It is one Spark job, however many windows and
iterations there are; a lost executor makes Spark repeat the stage, with the same result.

The weights change hands by ``allGather``, which takes a second whatever it carries (Spark's barrier looks for the
answer once a second).  So there are no more runs than tasks, and none of fewer than ``LEAST_ROWS`` rows or ``LEAST_SUMS``
sums, which one task sorts and reads in less time than two tasks take to speak (it streams them; Spark's sort spills);
with one run there is no barrier at all.  For the same reason windows too large for a task (:func:`shared_windows`) are
not gathered: every iteration is a distributed sum, and a job takes the sums of many iterations.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.fold import window_sums
from kestrel.session import remove_scratch, scratch_path

#: Rows, and sums of windows, that a run has at least.
LEAST_ROWS, LEAST_SUMS = 1_000_000, 50_000
#: Rows of one window that one task holds at most.
ROWS_PER_TASK = 1_000_000
#: Sums of shares that a round of :func:`shared_windows` brings to the driver at most (8 bytes each).
SUMS_PER_ROUND = 1_000_000
FOLDED = "block long, n long, weights array<double>, sums array<double>"


def relay_tasks(spark: SparkSession) -> int:
    """Tasks of a barrier stage: they must all run at once, and leave room for other jobs."""
    return max(1, spark.sparkContext.defaultParallelism // 2)


class Windows:
    """The windows of a task's sorted batches, one at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch], key: str):
        self.batches, self.key = batches, key
        self.left: pa.RecordBatch | None = None
        self._fill()

    def _fill(self) -> None:
        while self.left is None or not self.left.num_rows:
            self.left = next(self.batches, None)
            if self.left is None:
                return

    def next(self) -> int | None:
        """Number of the next window; None at the end."""
        return None if self.left is None else self.left.column(self.key)[0].as_py()

    def take(self) -> pa.Table:
        """All rows of the next window that this task holds."""
        own, parts = self.next(), []
        while self.left is not None:
            keys = self.left.column(self.key).to_numpy(zero_copy_only=False)
            n = int(np.searchsorted(keys, own, side="right"))
            parts.append(self.left.slice(0, n))
            if n < self.left.num_rows:
                self.left = self.left.slice(n)
                break
            self.left = None
            self._fill()
        return pa.Table.from_batches(parts)


def points_of(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(X, y) of a window's points."""
    x = rows.column("x").combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), rows.column("y").to_numpy()


def _out(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64())),
         pa.array(cols[3], pa.list_(pa.float64()))], names=["block", "n", "weights", "sums"])


#: (weights, window, its rows) -> (n, weights after it or None if it is not closed, sums to report or None)
Fold = Callable[[np.ndarray, int, pa.Table], tuple[int, np.ndarray | None, np.ndarray | None]]


def relay(windows: DataFrame, start, fold: Fold, n_blocks: int, least: int, order: list[str],
          first_block: int = 0) -> DataFrame:
    """``FOLDED``: the windows of a frame with a ``block`` column, folded in block order from ``start``.

    There are about ``n_blocks`` windows from ``first_block`` on; a run has at least ``least`` of them.
    """
    tasks, first = relay_tasks(windows.sparkSession), [float(v) for v in start]
    per_run = max(least, -(-n_blocks // tasks), 1)
    several = n_blocks > per_run
    run = F.floor((F.col("block") - F.lit(first_block)) / F.lit(per_run)).cast("long") if several else F.lit(0).cast("long")
    dealt = (windows.withColumn("_run", run).repartition(tasks if several else 1, "_run")
             .sortWithinPartitions("_run", "block", *order))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed, w = Windows(batches, "block"), np.array(first)
        context = BarrierTaskContext.get() if several else None

        def at() -> int | None:
            return None if feed.left is None else feed.left.column("_run")[0].as_py()

        said: list = [at(), None]
        while True:
            heard = [json.loads(m) for m in context.allGather(json.dumps(said))] if several else [said]
            w = next((np.array(h[1]) for h in heard if h[1] is not None), w)
            waiting = [h[0] for h in heard if h[0] is not None]
            if not waiting:
                return
            now = min(waiting)
            if at() != now:
                said = [at(), None]
                continue
            out = []
            while at() == now:
                block, rows = feed.next(), feed.take()
                n, after, sums = fold(w, block, rows)
                w = w if after is None else after
                out.append((block, n, None if after is None else after.tolist(), None if sums is None else sums.tolist()))
                if len(out) >= 1000:
                    yield _out(out)
                    out = []
            if out:
                yield _out(out)
            said = [at(), w.tolist()]

    return dealt.mapInArrow(task, FOLDED, barrier=several)


def in_shares(points: DataFrame, window: int, rows_per_task: int) -> DataFrame:
    """Windows cut into shares of ``rows_per_task`` rows in order; no two shares of a window lie in one partition."""
    shares = -(-window // rows_per_task)
    tasks = max(shares, points.sparkSession.sparkContext.defaultParallelism)
    share = F.floor(F.pmod("ordinal", F.lit(window)) / F.lit(rows_per_task)).cast("long")
    at = F.pmod(F.col("block") * F.lit(shares) + share, F.lit(tasks)).cast("int")
    return (points.withColumn("share", share).repartitionById(tasks, at)
            .sortWithinPartitions("block", "ordinal"))


def _expanded(held: DataFrame, rule, dim: int, at: dict[int, np.ndarray]) -> dict[int, tuple]:
    """Per window (n, rows in its sums, longest row, sums of the gradient, sums of its derivative) at the weights
    ``at[window]``: every share sums its own rows, the shares' sums are added in order."""
    names = ["block", "share", "n", "used", "longest", "gradient", "slope"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed = Windows(batches, "block")
        while (block := feed.next()) is not None:
            rows = feed.take()
            x, y = points_of(rows.filter(rows.column("complete")), dim)
            longest, gradient, slope = rule.expand(at[block], x, y)
            yield pa.RecordBatch.from_pylist([dict(zip(names, (
                block, rows.column("share")[0].as_py(), rows.num_rows, len(y), longest, gradient.ravel(), slope.ravel()),
                strict=True))], schema=pa.schema([(c, pa.int64()) for c in names[:4]] + [("longest", pa.float64())]
                                                 + [(c, pa.list_(pa.float64())) for c in names[5:]]))

    parts = held.where(F.col("block").between(min(at), max(at))).mapInArrow(
        task, "block long, share long, n long, used long, longest double, gradient array<double>, slope array<double>")
    out: dict[int, tuple] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["block"], r["share"])):
        n, used, longest, gradient, slope = out.get(r["block"], (0, 0, 0.0, 0.0, 0.0))
        out[r["block"]] = (n + r["n"], used + r["used"], max(longest, r["longest"]), gradient + np.array(r["gradient"]),
                           slope + np.array(r["slope"]))
    return out


def _fold_shared(held: DataFrame, start: np.ndarray, rule, dim: int, blocks: list[int], ahead: int) -> list[tuple]:
    """(block, n, weights after it, None) of consecutive windows in shares, by rounds of at most ``ahead`` iterations.

    A round supposes the weights of many iterations to come, of this window and the next ones, and takes the sums of all of
    them in one job, with their derivatives.  Then the chain is gone through from the last iteration that is settled.  An
    iteration is settled if all before it are and its sums were taken at its own weights, but for a distance over
    which sum and derivative give the gradient to the last bit (``rule.settles``).  The others' weights, now better
    known, are supposed in the next round; each round settles one iteration at least.
    """
    span, out = rule.iterations, []
    supposed, w, done = np.tile(start, (len(blocks) * span, 1)), start, 0
    while done < len(supposed):
        until, at = min(done + ahead, len(supposed)), {}
        for k in range(done // span, (until - 1) // span + 1):
            own = supposed[max(done, k * span):min(until, (k + 1) * span)]
            at[blocks[k]] = own[:1] if (own == own[0]).all() else own
        sums, settled, v = _expanded(held, rule, dim, at), True, w
        for k in range(done // span, (until - 1) // span + 1):
            low, high, block = max(done, k * span), min(until, (k + 1) * span), blocks[k]
            n, used, longest, gradient, slope = sums.get(block, (0, 0, 0.0, 0.0, 0.0))
            if used:
                gradient, slope = gradient.reshape(-1, dim) / n, slope.reshape(-1, dim, dim) / n
            else:
                gradient, slope = np.full((1, dim), np.nan), np.zeros((1, dim, dim))
            for i in range(low, high):
                own, moved = i - low if len(gradient) > 1 else 0, v - supposed[i]
                same = np.array_equal(v, supposed[i], equal_nan=True)
                settled = settled and (same or rule.settles(longest, moved))
                supposed[i] = v
                v, _ = rule.step_along(v, gradient[own] if same else gradient[own] + slope[own] @ moved)
                if settled:
                    w, done = v, i + 1
            if done == (k + 1) * span:
                out.append((block, n, w.tolist(), None))
        supposed[until:] = v
    return out


def shared_windows(points: DataFrame, start, rule, dim: int, window: int = ROWS_PER_TASK,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``FOLDED``: windows of points (block, ordinal, x, y) that no single task holds.

    ``rule`` gives gradient sums with derivatives (``expand``), ``settles`` and ``step_along``; every iteration sums over all
    rows of its window, a share of the window in a task.  The rows are stored once and read by runs of windows; a run
    takes a few jobs, not one an iteration (:func:`_fold_shared`).  A row with a null counts but adds nothing.
    """
    spark = points.sparkSession
    stage, out = scratch_path(spark, "shared-windows"), scratch_path(spark, "folded")
    run = max(1, LEAST_ROWS // window)
    ahead = max(1, SUMS_PER_ROUND // ((dim + dim * dim) * -(-window // rows_per_task)))
    complete = F.col("x").isNotNull() & F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull())
    rows = points.select("block", "ordinal", "x", "y", F.coalesce(complete, F.lit(False)).alias("complete"),
                         F.floor(F.col("block") / F.lit(run)).cast("long").alias("run"))
    rows.write.partitionBy("run").parquet(stage)
    staged = spark.read.schema(rows.schema).parquet(stage)
    low, high = staged.agg(F.min("block"), F.max("block")).first()
    w = np.asarray(start, dtype=float)
    for first in range(low // run * run, high + 1, run) if low is not None else ():
        held = in_shares(staged.where(F.col("run") == first // run).drop("run"), window, rows_per_task).persist()
        done = _fold_shared(held, w, rule, dim, list(range(max(low, first), min(high + 1, first + run))), ahead)
        held.unpersist()
        w = np.array(done[-1][2])
        spark.createDataFrame(done, FOLDED).coalesce(1).write.mode("append").parquet(out)
    remove_scratch(spark, stage)
    return spark.createDataFrame([], FOLDED) if low is None else spark.read.schema(FOLDED).parquet(out)


def fold_points(points: DataFrame, start, rule, dim: int, window: int, n_windows: int, first_block: int = 0,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Closed windows of points (block, ordinal, x, y) folded by ``rule.apply_rows``."""
    if window > rows_per_task:
        return shared_windows(points, start, rule, dim, window, rows_per_task)

    def fold(w: np.ndarray, block: int, rows: pa.Table):
        x, y = points_of(rows, dim)
        return len(y), rule.apply_rows(w, x, y), None

    return relay(points.select("block", "ordinal", "x", "y"), start, fold, n_windows, LEAST_ROWS // window, ["ordinal"],
                 first_block)


def fold_sums(sums: DataFrame, start, rule, dim: int, n_windows: int, n_closed: int | None = None, open_block: int = 0,
              open_n: int = 0, open_sums=None) -> DataFrame:
    """Windows given by their sums of products (block, n, s: see ``gram``) folded by ``rule.apply``.

    ``open_sums`` of ``open_n`` earlier rows are added to the first window, ``open_block``; windows from ``n_closed``
    on are not folded but come back as sums.
    """
    left = None if open_sums is None else np.asarray(open_sums, dtype=float)

    def fold(w: np.ndarray, block: int, rows: pa.Table):
        n, s = rows.column("n")[0].as_py(), rows.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if block == open_block and left is not None:
            n, s = n + open_n, s + left
        if n_closed is not None and block >= n_closed:
            return n, None, s
        g, c, _ = window_sums(rule, s, dim + 1)
        return n, rule.apply(w, g, c, float(n)), None

    return relay(sums.select("block", "n", "s"), start, fold, n_windows, LEAST_SUMS, [], open_block)
