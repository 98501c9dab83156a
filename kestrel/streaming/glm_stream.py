"""Online GLMs on Structured Streaming.

``StreamingGLM.process_batch`` is a ``foreachBatch`` body; all state (weights,
rows seen, the open count window) is in the model store's newest commit, so a
restarted query resumes from the last committed batch.  Commits are
keyed by training stream and batch, so several streams can train one model in turn.
Rejects, predictions, versions and metrics are written per stream and batch,
replacing what a failed attempt left; the commit comes last, so a replay repeats
the batch from the same state and leaves every table as if it had run once.  Modes:

* count windows (``window=B``, V1): rows are numbered from the stored ``n_seen``; windows are folded on the executors;
  the first rows complete the open window; each closed window is one version;
  the incomplete tail is stored, never flushed;
* micro-batch (``window=None``, V2): one update per non-empty batch, or one per
  ``source_rank`` present (several sources in one stream, in rank order, T7).

Rows are taken in the order of ``order_col``; without that column, in arrival order:
file time, file, place in the file (the columns that this package's text sources
add), or else the position that the source gives.
"""

from __future__ import annotations

import hashlib
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kestrel.functions.linalg import decision, dot
from kestrel.operators.fold import fold_sampled_grams, window_sums
from kestrel.operators.gram import gram, packed_len, sampled_gram
from kestrel.operators.identity import with_identity
from kestrel.operators.ordinal import count_windows
from kestrel.operators.relay import fold_points, fold_sums
from kestrel.operators.rules import LogisticGD
from kestrel.sources.text import ARRIVAL
from kestrel.streaming.modelstore import ModelStore, State, remove_path, write_part

ORDERS = ("train_then_predict", "predict_then_train")


def part_name(stream_id: str, batch_id: int) -> str:
    return f"{stream_id}-{batch_id:09d}"


def with_order(batch: DataFrame, order_col: str) -> tuple[DataFrame, list[str]]:
    """The batch and its order columns."""
    if order_col in batch.columns:
        return batch, [order_col]
    placed = batch.withColumn("_row", F.monotonically_increasing_id())
    return placed, [c for c in ARRIVAL if c in batch.columns] + ["_row"]


def predictions(batch: DataFrame, weights, version: int, batch_id: int, keep: list[str]) -> DataFrame:
    """B9 on every row; the weights are one array value, so plans of all batches are alike."""
    w = F.lit([float(v) for v in weights])
    return batch.select(F.lit(batch_id).cast("long").alias("batch_id"), *keep,
                        dot(F.col("x"), w).alias("prediction"), F.lit(version).cast("long").alias("version"))


def write_predictions(preds: DataFrame, path: str | None, show: int, part: str) -> None:
    """The sink, and the first elements of the batch on the console."""
    if path is not None:
        write_part(preds, path, part)
    if show:
        preds.show(show)


class StreamingGLM:
    def __init__(self, store: ModelStore, rule, dim: int, w0=None, window: int | None = None,
                 order: str = "train_then_predict", order_col: str = "seq",
                 predictions_path: str | None = None, rejects_path: str | None = None,
                 holdout: DataFrame | None = None, metrics_path: str | None = None,
                 show_predictions: int = 0, seed: int = 42, stream_id: str = "stream", hash_fn=None):
        if order not in ORDERS:
            raise ValueError(f"order must be one of {ORDERS}")
        if window is None and isinstance(rule, LogisticGD):
            raise ValueError("the logistic rule needs count windows")
        if window is not None and (predictions_path or show_predictions):
            raise ValueError("count-window training writes no predictions; use predict_on")
        self.store, self.rule, self.dim = store, rule, dim
        self.window, self.order, self.order_col = window, order, order_col
        self.w0 = None if w0 is None else np.asarray(w0, dtype=float)
        self.predictions_path, self.rejects_path = predictions_path, rejects_path
        # The hold-out is read once, not once per batch
        self.holdout = None if holdout is None else holdout.select("x", "y").persist()
        self.metrics_path = metrics_path
        self.show_predictions, self.seed, self.stream_id = show_predictions, seed, stream_id
        #: M7: hash of (row, iteration) in [0, 1) instead of the built-in one
        self.hash_fn = hash_fn

    def latest_weights(self):
        return self.store.start(self.w0).weights

    # ---- foreachBatch body -------------------------------------------------
    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        with self.store.lock:
            state = self.store.start(self.w0)
            if batch_id <= state.committed.get(self.stream_id, -1):
                return  # replayed micro-batch: already applied
            self._train(batch, batch_id, state)

    def _train(self, batch: DataFrame, batch_id: int, state: State) -> None:
        part = part_name(self.stream_id, batch_id)
        batch, order = with_order(batch, self.order_col)
        batch = batch.persist()
        t0 = time.perf_counter()
        self.missed: dict[int, int] = {}
        try:
            if "reject" in batch.columns:
                if self.rejects_path is not None:
                    write_part(batch.filter(F.col("reject").isNotNull())
                               .withColumn("batch_id", F.lit(batch_id).cast("long")), self.rejects_path, part)
                batch = batch.filter(F.col("reject").isNull())
            if self.window is None:
                new, rows = self._micro_batch(batch, batch_id, state, order)
            elif isinstance(self.rule, LogisticGD) or self.window < self.dim:
                new, rows = self._row_windows(batch, part, state, order)
            else:
                new, rows = self._count_windows(batch, state, order)
            if rows:
                new.added.append(self.store.write_versions(
                    [(v, self.stream_id, batch_id, [batch_id, *key], n, seen, w) for v, key, n, seen, w in rows], part))
                self._report(rows, batch_id, part, time.perf_counter() - t0)
            new.seq, new.committed = state.seq, {**state.committed, self.stream_id: batch_id}
            self.store.commit(new)
            if state.open_path is not None:
                # the window that it held is closed, or held by the new state
                remove_path(self.store.spark, state.open_path)
        finally:
            batch.unpersist()

    def _report(self, rows, batch_id: int, part: str, seconds: float) -> None:
        """Rows seen and training time of the batch's versions, for micro-batch updates how many of
        their rows the model before them decided wrongly, and with a hold-out the error rate of each."""
        if self.metrics_path is None:
            return
        spark = self.store.spark
        base = spark.createDataFrame(
            [(v, int(seen), int(n), self.missed.get(v), int(seconds * 1000)) for v, _, n, seen, _ in rows],
            "version long, n_seen long, n_rows long, n_missed long, train_ms long").withColumn("batch_id", F.lit(batch_id).cast("long"))
        if self.holdout is not None:
            from kestrel.operators.metrics import error_trace
            new = spark.createDataFrame([(v, [float(x) for x in w]) for v, _, _, _, w in rows],
                                        "version long, weights array<double>")
            base = base.join(error_trace(self.holdout, new), "version")
        write_part(base.coalesce(1), self.metrics_path, part)

    def _micro_batch(self, batch, batch_id, state, order):
        keys = ["source_rank"] if "source_rank" in batch.columns else []
        w, version, n_seen, rows = state.weights, state.version, state.n_seen, []
        fraction = getattr(self.rule, "fraction", 1.0)
        # Rows, and errors of the model before the update, counted by the scan that trains
        miss = (decision(dot(F.col("x"), F.lit([float(v) for v in w]))) != F.col("y")).cast("long")
        n_and_miss = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(miss), F.lit(0)).alias("miss")]
        one, seen = batch.withColumn("_one", F.lit(0)), Observation()
        counts = None
        if keys or fraction < 1.0:
            counts = {(0, *[r[k] for k in keys]): r for r in one.groupBy("_one", *keys).agg(*n_and_miss).collect()}
        else:
            one = one.observe(seen, *n_and_miss)
        if fraction < 1.0:
            # M7: the per-iteration mini-batch Grams of every source of this micro-batch, one pass
            same = order[-1]
            if same == "_row":
                one, same = with_identity(one, ["x", "y", *keys], "_same"), "_same"
            g = sampled_gram(one, ["_one", *keys], self.dim, self.rule.iterations, fraction, same,
                             self.seed + batch_id, hash_fn=self.hash_fn)
            updates = ((key if keys else (key,), new) for key, _, new in fold_sampled_grams(
                g, self.rule, w, ["_one", *keys], every=sorted(counts) if keys else [k for k, in counts]))
        else:
            def full(w=w):
                # a row for each source
                for r in gram(one, ["_one", *keys], self.dim).orderBy("_one", *keys).collect():
                    G, c, _ = window_sums(self.rule, r["s"], self.dim + 1)
                    w = self.rule.apply(w, G, c, float(r["n"]))
                    yield (0, *[r[k] for k in keys]), w
            updates = full()
        for key, new in list(updates):
            found = seen.get if counts is None else counts[key]
            n, missed = int(found["n"]), int(found["miss"])
            if n:
                w, version, n_seen = new, version + 1, n_seen + n
                rows.append((version, key[1:], n, n_seen, np.array(w)))
                self.missed[version] = missed
        if rows:
            # an empty batch keeps the model and writes neither version nor predictions (Q16)
            before = self.order == "predict_then_train"
            keep = [c for c in order if c != "_row"]
            write_predictions(
                predictions(batch, state.weights if before else w, state.version if before else version, batch_id, keep),
                self.predictions_path, self.show_predictions, part_name(self.stream_id, batch_id))
        return State(version=version, weights=w, n_seen=n_seen), rows

    def _count_windows(self, batch, state, order):
        """Windows folded from their sums on the executors; the open window's sums go into the state."""
        size, p = self.window, self.dim + 1
        total = state.n_seen + batch.count()
        n_closed, open_block = total // size, state.n_seen // size
        left = np.zeros(packed_len(p)) if state.open_sums is None else state.open_sums
        framed = count_windows(batch, order, size, n_seen=state.n_seen)
        folded = fold_sums(gram(framed, "block", self.dim), state.weights, self.rule, self.dim,
                           total // size - open_block + 1, n_closed, open_block, state.open_n, left).collect()
        rows, new = [], State(version=state.version, weights=state.weights, n_seen=total)
        if total == state.n_seen:
            new.open_n, new.open_sums = state.open_n, left
        for r in sorted(folded, key=lambda r: r["block"]):
            if r["weights"] is None:
                new.open_n, new.open_sums = r["n"], np.array(r["sums"])
            else:
                new.weights, new.version = np.array(r["weights"]), r["block"]
                rows.append((r["block"], (r["block"],), r["n"], (r["block"] + 1) * size, new.weights))
        return new, rows

    def _row_windows(self, batch, part, state, order):
        """Windows folded from their rows (M3, and windows shorter than the vectors): the open window keeps its
        rows (fewer than B) in a table of this attempt's own; the next batch reads them back."""
        size = self.window
        total = state.n_seen + batch.count()
        n_closed = total // size
        rows = count_windows(batch, order, size, n_seen=state.n_seen).select("ordinal", "block", "x", "y")
        if state.open_n:
            old = self.store.spark.read.parquet(state.open_path).select(
                "ordinal", (F.col("ordinal") / F.lit(size)).cast("long").alias("block"), "x", "y")
            rows = old.unionByName(rows)
        out, w = [], state.weights
        if n_closed > state.n_seen // size:
            folded = fold_points(rows.filter(F.col("block") < n_closed), w, self.rule, self.dim, size,
                                 n_closed - state.n_seen // size, state.n_seen // size).collect()
            for r in sorted(folded, key=lambda r: r["block"]):
                w = np.array(r["weights"])
                out.append((r["block"], (r["block"],), r["n"], (r["block"] + 1) * size, w))
        open_path = f"{self.store.root}/open/attempt={part}.{uuid.uuid4().hex[:12]}"
        rows.filter(F.col("block") >= n_closed).select("ordinal", "x", "y").write.parquet(open_path)
        return State(version=out[-1][0] if out else state.version, weights=w, n_seen=total,
                     open_n=total - n_closed * size, open_path=open_path), out

    # ---- wiring --------------------------------------------------------------
    def train_on(self, stream: DataFrame, checkpoint_location: str,
                 processing_time: str | None = None, available_now: bool = False):
        """T4: start a query that updates the model on every micro-batch (T1 trigger)."""
        self.store.start(self.w0)
        return started(stream, self.process_batch, checkpoint_location, processing_time, available_now)


def stream_name(checkpoint_location: str) -> str:
    """A training stream is known by its checkpoint, which a restart gives again."""
    return hashlib.md5(checkpoint_location.rstrip("/").encode()).hexdigest()[:12]


def started(stream: DataFrame, body, checkpoint_location: str, processing_time: str | None,
            available_now: bool):
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def scorer(store: ModelStore, sink_path: str, stream_id: str, order_col: str = "seq", show: int = 0):
    """T5: a batch body that scores rows with the model current at each batch.

    It reads the newest commit of the model's log, so the model may be trained meanwhile, here or elsewhere.  Rows
    keep their order column, or what the source tells of their arrival."""
    def score(batch: DataFrame, batch_id: int) -> None:
        state = store.state()
        if state is None:
            raise ValueError("initial weights must be set before prediction")
        placed, order = with_order(batch, order_col)
        keep = order + [c for c in ("value",) if c in batch.columns]
        write_predictions(predictions(placed, state.weights, state.version, batch_id, keep), sink_path, show,
                          part_name(stream_id, batch_id))

    return score


def predict_on(stream: DataFrame, store: ModelStore, sink_path: str, checkpoint_location: str,
               order_col: str = "seq", processing_time: str | None = None,
               available_now: bool = False, show: int = 0):
    """T5: score a (different) stream with the model current at each of its batches."""
    return started(stream, scorer(store, sink_path, stream_name(checkpoint_location), order_col, show),
                   checkpoint_location, processing_time, available_now)
