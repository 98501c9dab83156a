"""Versioned model table (S3, T3, M10) with an append-only commit log.

Two things live below a model's folder ``<path>/model=<id>``:

* ``versions/attempt=<name>``: one row per model version, written by one attempt of a unit (a
  micro-batch of one stream, or a batch training).  An attempt has a folder of its own and is never changed;
* ``commits``: a :class:`~kestrel.streaming.commitlog.CommitLog`.  A record holds the state a trainer continues from
  (newest weights, rows seen, the open count window as sums, the last batch of every training
  stream) and names the attempts that it adds to the model.  Appending it is the commit, and comes last.

Nothing is overwritten or removed under a reader: attempts that no record names (of a crashed unit) are not part of
the model.  Reading the state or the newest model opens one small file, however many versions there are.  Scoring
jobs read while a trainer commits; a second trainer of the same model gets ``CommitConflict`` and changes nothing.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.streaming.commitlog import CommitConflict, CommitLog

_L, _S, _D = T.LongType(), T.StringType(), T.DoubleType()
#: batch_key is the full key of the update (day, source, ...) as text; block its first part.
MODEL_SCHEMA = T.StructType([
    T.StructField("model_id", _S, False), T.StructField("version", _L, False),
    T.StructField("stream_id", _S, True), T.StructField("batch_id", _L, True),
    T.StructField("batch_key", T.ArrayType(_L), True), T.StructField("n_rows", _L, True),
    T.StructField("n_seen", _L, True), T.StructField("weights", T.ArrayType(_D), False),
])
_CHUNK = 10_000
_LOCKS: dict[str, threading.RLock] = {}


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def remove_path(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def write_part(df: DataFrame, path: str, part: str) -> None:
    """One unit of a table: replaces what an earlier attempt of the same unit left."""
    df.write.mode("overwrite").parquet(f"{path}/part={part}")


class State:
    """What a trainer continues from."""

    def __init__(self, seq=-1, version=-1, weights=(), n_seen=0, open_n=0, open_sums=None,
                 open_path=None, committed=None, added=None):
        self.seq, self.version, self.n_seen, self.open_n = int(seq), int(version), int(n_seen), int(open_n)
        self.weights = np.asarray(weights, dtype=float)
        self.open_sums = None if open_sums is None else np.asarray(open_sums, dtype=float)
        self.open_path, self.committed = open_path, dict(committed or {})
        #: attempts that this commit makes part of the model
        self.added = list(added or [])

    def record(self, seq: int) -> dict:
        return {"seq": seq, "version": self.version, "weights": [float(x) for x in self.weights],
                "n_seen": self.n_seen, "open_n": self.open_n,
                "open_sums": None if self.open_sums is None else [float(x) for x in self.open_sums],
                "open_path": self.open_path, "committed": self.committed, "added": self.added}


class ModelStore:
    def __init__(self, spark: SparkSession, path: str, model_id: str = "model"):
        self.spark, self.path, self.model_id = spark, path.rstrip("/"), model_id
        self.root = f"{self.path}/model={model_id}"
        self.log = CommitLog(spark, f"{self.root}/commits")
        #: streams of one process that train one model take turns
        self.lock = _LOCKS.setdefault(self.root, threading.RLock())

    # ---- versions ------------------------------------------------------------
    def write_versions(self, rows: Iterable[tuple], part: str) -> str:
        """Rows (version, stream_id, batch_id, batch_key, n_rows, n_seen, weights) of one attempt; its name."""
        clean = [(self.model_id, int(v), s, b, None if k is None else [int(x) for x in k], int(n), int(seen),
                  [float(x) for x in w]) for v, s, b, k, n, seen, w in rows]
        return self.write_frame(self.spark.createDataFrame(clean, MODEL_SCHEMA).coalesce(1), part)

    def write_frame(self, versions: DataFrame, part: str) -> str:
        """An attempt from a frame of ``MODEL_SCHEMA``, written where its rows are; its name."""
        attempt = f"{part}.{uuid.uuid4().hex[:12]}"
        versions.select(*MODEL_SCHEMA.fieldNames()).write.parquet(f"{self.root}/versions/attempt={attempt}")
        return attempt

    def write_training(self, w0, rows: Iterable[tuple]) -> None:
        """A whole batch training: version -1 is ``w0``, then rows (version, batch_key, n_rows, n_seen,
        weights) in order, in chunks of bounded size; one commit."""
        buf, names = [(-1, None, None, None, 0, 0, w0)], []
        state = State(weights=w0)
        for version, key, n, seen, w in rows:
            buf.append((version, None, None, key, n, seen, w))
            state = State(version=version, weights=w, n_seen=seen)
            if len(buf) >= _CHUNK:
                names.append(self.write_versions(buf, "training"))
                buf = []
        if buf:
            names.append(self.write_versions(buf, "training"))
        state.added = names
        self.commit(state)

    def write_folded(self, w0, folded: DataFrame, window: int) -> None:
        """A whole count-window training from a frame (block, n, weights), written by the tasks that hold it."""
        first = self.write_versions([(-1, None, None, None, 0, 0, w0)], "initial")
        size, text = F.lit(window).cast("long"), F.lit(None).cast("string")
        name = self.write_frame(folded.select(
            F.lit(self.model_id).alias("model_id"), F.col("block").alias("version"), text.alias("stream_id"),
            F.lit(None).cast("long").alias("batch_id"), F.array("block").alias("batch_key"), F.col("n").alias("n_rows"),
            ((F.col("block") + 1) * size).alias("n_seen"), "weights"), "training")
        last = (self.spark.read.schema(MODEL_SCHEMA).parquet(f"{self.root}/versions/attempt={name}")
                .orderBy(F.desc("version")).select("version", "weights", "n_seen").first())
        self.commit(State(added=[first, name], **({"weights": w0} if last is None else last.asDict())))

    def versions(self) -> DataFrame:
        """Every committed version, one row each; version -1 is the initial weights."""
        # the log first: what it names is complete
        added = self.log.records("added array<string>").select(F.explode("added").alias("attempt"))
        if not path_exists(self.spark, f"{self.root}/versions"):
            return self.spark.createDataFrame([], MODEL_SCHEMA)
        rows = self.spark.read.schema(T.StructType([*MODEL_SCHEMA.fields, T.StructField("attempt", _S)])).parquet(f"{self.root}/versions")
        return rows.join(added, "attempt", "left_semi").select(*MODEL_SCHEMA.fieldNames())

    # ---- state -----------------------------------------------------------------
    def state(self) -> State | None:
        """The committed state; None before the initial weights are set."""
        found = self.log.newest()
        return None if found is None else State(**found[1])

    def commit(self, state: State) -> None:
        """Make ``state`` the newest; fails if another trainer committed after ``state.seq``."""
        with self.lock:
            before = self.log.newest()
            now = -1 if before is None else before[0]
            if state.seq >= 0 and state.seq != now:
                raise CommitConflict(f"{self.root}: state {state.seq} is no longer the newest ({now})")
            self.log.append(now + 1, state.record(now + 1))

    def history(self) -> DataFrame:
        """Every commit: seq, version, n_seen, committed (last batch by stream), added (attempts)."""
        return self.log.records("version long, n_seen long, committed map<string,long>, added array<string>")

    def start(self, w0) -> State:
        """The state; sets the initial weights first if there is none."""
        with self.lock:
            found = self.state()
            if found is None:
                if w0 is None:
                    raise ValueError("initial weights must be set before training")
                self.commit(State(weights=w0, added=[self.write_versions([(-1, None, None, None, 0, 0, w0)], "initial")]))
                found = self.state()
            return found

    def latest(self) -> DataFrame:
        """The newest version (one row: model_id, version, n_seen, weights), from the head."""
        s = self.state()
        rows = [] if s is None else [(self.model_id, s.version, s.n_seen, [float(x) for x in s.weights])]
        return self.spark.createDataFrame(rows, "model_id string, version long, n_seen long, weights array<double>")

    def latest_row(self):
        return self.latest().first()


def preview(weights, limit: int = 100):
    """The logged form of a weight vector, cut to the first ``limit`` entries."""
    vals = list(weights)
    shown = ",".join(repr(float(a)) for a in vals[:limit])
    return "[" + shown + ("..." if len(vals) > limit else "]")
