"""Folds on the executors: handing weights on, windows shorter than their vectors, windows larger than a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import relay as R
from kestrel.operators.asof import last_at
from kestrel.operators.identity import with_identity
from kestrel.operators.metrics import _errors_full, _errors_pruned, distinct_growth
from kestrel.operators.rules import LogisticGD, NormalizedGD


def points(spark, n, dim, window, seed=0):
    rng = np.random.default_rng(seed)
    X, y = rng.normal(size=(n, dim)), np.where(rng.random(n) < 0.5, -1.0, 1.0)
    df = spark.createDataFrame([(i, i // window, X[i].tolist(), float(y[i])) for i in range(n)],
                               "ordinal long, block long, x array<double>, y double")
    return X, y, df.repartition(7)


def plain(rule, X, y, window):
    w, out = np.zeros(X.shape[1]), []
    for k in range(len(y) // window):
        s = slice(k * window, (k + 1) * window)
        w = rule.apply_rows(w, X[s], y[s])
        out.append(w)
    return out


@pytest.mark.parametrize("least", [10_000, 3])
def test_weights_pass_from_task_to_task(spark, least, monkeypatch):
    """One run in one task, and several runs over the tasks of a barrier stage, give the same weights."""
    monkeypatch.setattr(R, "LEAST_ROWS", least * 10)
    X, y, df = points(spark, 120, 4, 10)
    rule = LogisticGD(step=0.05, iterations=7)
    got = R.fold_points(df, np.zeros(4), rule, 4, 10, 12).orderBy("block").collect()
    assert [(r["block"], r["n"]) for r in got] == [(k, 10) for k in range(12)]
    assert [r["weights"] for r in got] == [w.tolist() for w in plain(rule, X, y, 10)]


def test_no_windows(spark):
    _, _, df = points(spark, 5, 3, 10)
    assert R.fold_points(df.where("block > 5"), np.zeros(3), LogisticGD(), 3, 10, 0).collect() == []
    assert R.shared_windows(df.where("block > 5"), np.zeros(3), LogisticGD(), 3).collect() == []


def test_large_windows_are_distributed_sums(spark):
    X, y, df = points(spark, 90, 3, 30)
    rule = LogisticGD(step=0.05, iterations=6)
    got = R.fold_points(df, np.zeros(3), rule, 3, 30, 3, rows_per_task=10).orderBy("block").collect()
    assert np.allclose([r["weights"] for r in got], plain(rule, X, y, 30), atol=1e-12)


def test_large_windows_take_fewer_jobs_than_iterations(spark):
    X, y, df = points(spark, 240, 3, 40, seed=4)
    rule, sc = LogisticGD(step=0.05, iterations=50), spark.sparkContext
    sc.setJobGroup("shared windows", "")
    try:
        got = R.shared_windows(df, np.zeros(3), rule, 3, 40, 10).orderBy("block").collect()
        jobs = len(sc.statusTracker().getJobIdsForGroup("shared windows"))
    finally:
        sc._jsc.clearJobGroup()
    assert [(r["block"], r["n"]) for r in got] == [(k, 40) for k in range(6)]
    assert np.allclose([r["weights"] for r in got], plain(rule, X, y, 40), atol=1e-10)
    assert jobs < 50                                             # of 300 iterations


@pytest.mark.parametrize("sums", [1, 500])
def test_large_windows_by_short_rounds_and_runs(spark, sums, monkeypatch):
    """One iteration or a few a round, one window a run, steps too long to be foreseen: the same weights."""
    monkeypatch.setattr(R, "SUMS_PER_ROUND", sums)
    monkeypatch.setattr(R, "LEAST_ROWS", 30)
    X, y, df = points(spark, 60, 3, 30, seed=2)
    rule = LogisticGD(step=1.5, iterations=5)
    got = R.shared_windows(df, np.zeros(3), rule, 3, 30, 7).orderBy("block").collect()
    assert np.allclose([r["weights"] for r in got], plain(rule, X, y, 30), atol=1e-10)


def test_large_windows_with_nulls_and_no_gradient(spark):
    """A row with a null counts but adds nothing; rows that cancel leave the weights as they are."""
    X, y, _ = points(spark, 20, 3, 20)
    rows = [(i, 0, X[i].tolist(), float(y[i])) for i in range(20)]
    odd = [(20, 0, [1.0, None, 2.0], 1.0), (21, 0, None, 1.0), (22, 0, [1.0, 1.0, 1.0], None)]
    schema = "ordinal long, block long, x array<double>, y double"
    rule = LogisticGD(step=0.05, iterations=6)
    got = R.shared_windows(spark.createDataFrame(rows + odd, schema), np.zeros(3), rule, 3, 23, 5).collect()
    w = np.zeros(3)
    for _ in range(6):
        w, _ = rule.step_along(w, X.T @ ((1.0 / (1.0 + np.exp(-y * (X @ w))) - 1.0) * y) / 23)
    assert got[0]["n"] == 23 and np.allclose(got[0]["weights"], w, atol=1e-12)
    none = [(k, 0, [1.0, 2.0, 3.0], 1.0 if k % 2 else -1.0) for k in range(8)]
    assert R.shared_windows(spark.createDataFrame(none, schema), np.zeros(3), rule, 3, 8, 2).first()["weights"] == [0.0] * 3


def test_no_task_holds_more_of_a_window_than_its_share(spark):
    _, _, df = points(spark, 90, 3, 30)
    held = R.in_shares(df, 30, 7).groupBy("block", F.spark_partition_id()).agg(F.count("y").alias("n"))
    assert held.agg(F.max("n"), F.sum("n")).first() == (7, 90)


@pytest.mark.parametrize("penalty", ["l2", "none", "huber"])
def test_rows_and_sums_of_a_window_give_the_same_weights(penalty):
    """Fewer rows than dimensions: the inner-product form against the sums of products."""
    rng = np.random.default_rng(3)
    rule = NormalizedGD(step=0.05, iterations=40, reg=0.05, penalty=penalty)
    X, y, w = rng.normal(size=(9, 30)), rng.normal(size=9), rng.normal(size=30)
    assert np.allclose(rule.apply_rows(w, X, y), rule.apply(w, X.T @ X, X.T @ y, 9.0), atol=1e-9)
    zero = rule.apply_rows(np.zeros(30), np.zeros((4, 30)), np.zeros(4))
    assert np.all(np.isfinite(zero))


def test_identity_does_not_depend_on_the_cut(spark):
    rows = [(i % 5, float(i % 3)) for i in range(400)] + [(7, 1.0)] * 300
    ids = []
    for parts in (1, 4, 13):
        df = spark.createDataFrame(rows, "a int, b double").repartition(parts)
        got = with_identity(df, ["a", "b"], "same").collect()
        assert len({r["same"] for r in got}) == len(rows)
        ids.append(sorted((r["a"], r["b"], r["same"]) for r in got))
    assert ids[0] == ids[1] == ids[2]


def test_sampled_stream_without_keys_does_not_depend_on_files(spark, scratch):
    from kestrel.operators.rules import SGD
    from kestrel.streaming.glm_stream import StreamingGLM
    from kestrel.streaming.modelstore import ModelStore
    _, _, df = points(spark, 200, 3, 10)
    out = []
    for parts in (2, 9):
        path = f"{scratch}/p{parts}"
        df.select("x", "y").unionByName(df.select("x", "y").where("ordinal < 20")).repartition(parts).write.parquet(path)
        store = ModelStore(spark, f"{scratch}/m{parts}", "m")
        glm = StreamingGLM(store, SGD(step=0.1, iterations=6, fraction=0.4), 3, w0=[0.0] * 3)
        glm.process_batch(spark.read.parquet(path), 0)
        out.append(store.state().weights)
    assert np.allclose(*out, atol=1e-12)


def test_pruned_trace_counts_exactly_and_scores_less():
    rng = np.random.default_rng(5)
    X, y = rng.normal(size=(500, 4)), np.where(rng.random(500) < 0.5, -1.0, 1.0)
    X[:20] = 0.0                                     # on every plane
    W = np.cumsum(rng.normal(scale=0.01, size=(300, 4)), axis=0) + 1.0
    W[100:110] = W[100]                              # versions that do not move
    full, cells = _errors_full(X, y, W, 1000)
    pruned, fewer = _errors_pruned(X, y, W, 1000)
    assert (full == pruned).all() and fewer < cells / 3
    W = rng.normal(size=(50, 4))                     # nothing can be pruned
    assert (_errors_full(X, y, W, 1000)[0] == _errors_pruned(X, y, W, 1000)[0]).all()
    assert _errors_pruned(X, y, W, 1000)[1] <= 50 * 500


def test_last_version_at_a_time(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(t)) for i, t in enumerate(rng.integers(0, 60, 300))] + [(1000 + i, 30) for i in range(200)] + [(5000, None)]
    versions = [(k, int(t)) for k, t in enumerate(rng.integers(5, 55, 25))] + [(99, 30), (98, 30), (97, None)]
    want = {}
    for i, t in rows:
        found = [(vt, k) for k, vt in versions if vt is not None and t is not None and vt <= t]
        want[i] = max(found)[1] if found else None
    got = last_at(spark.createDataFrame(rows, "i long, t int").repartition(5), "t",
                  spark.createDataFrame(versions, "version long, vt int"), "vt").collect()
    assert len(got) == len(rows) and {r["i"]: r["version"] for r in got} == want
    none = last_at(spark.createDataFrame(rows[:3], "i long, t int"), "t", spark.createDataFrame([], "version long, vt int"), "vt")
    assert [r["version"] for r in none.collect()] == [None] * 3


def test_distinct_growth(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "a"), (1, "a")]
    out = distinct_growth(spark.createDataFrame(rows, "t int, user string"), "t", ["user"]).orderBy("t").collect()
    assert [tuple(r) for r in out] == [(1, 2, 2), (2, 0, 2), (3, 1, 3)]


def test_buffer_stream_restarts_at_its_offset(spark, scratch):
    import os

    from kestrel.sources.buffers import BufferSource
    spark.dataSource.register(BufferSource)
    folder, got = f"{scratch}/sent", []
    os.makedirs(folder)

    def send(name, lines, tail=b""):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(b"".join(x.encode().ljust(20, b"\0") for x in lines) + tail)

    def run():
        stream = spark.readStream.format("buffers").option("path", folder).option("bufferBytes", 20).option(
            "maxBuffersPerTrigger", 3).load()
        q = stream.writeStream.foreachBatch(lambda b, k: got.extend((r["offset"], r["value"].strip("\0")) for r in b.collect())) \
            .option("checkpointLocation", f"{scratch}/ck").trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()

    send("a", ["1::2::3", "line\ntwo", "x", "y", "z"], b"half")      # a buffer still being written
    run()
    assert sorted(got) == [(20 * k, v) for k, v in enumerate(["1::2::3", "line\ntwo", "x", "y", "z"])]
    send("b", ["rest".ljust(16, "\0")[:16]])
    with open(f"{folder}/b", "wb") as f:
        f.write(b"-done".ljust(16, b"\0") + b"last".ljust(20, b"\0"))
    run()
    assert sorted(got)[5:] == [(100, "half-done"), (120, "last")] and len(got) == 7


def test_buffer_stream_reads_gzipped_files(spark, scratch):
    """Offsets count unpacked bytes: the same batches as from plain files, a buffer across two files among them."""
    import gzip
    import os

    from kestrel.sources.buffers import BufferSource
    spark.dataSource.register(BufferSource)
    folder, got = f"{scratch}/packed", []
    os.makedirs(folder)
    sent = b"".join(f"{k}::2::3".encode().ljust(20, b"\0") for k in range(9))
    for name, part in (("a.gz", sent[:70]), ("b.gz", sent[70:90]), ("c.gz", b""), ("d", sent[90:])):
        with gzip.open(f"{folder}/{name}", "wb") if name.endswith("gz") else open(f"{folder}/{name}", "wb") as f:
            f.write(part)
    stream = spark.readStream.format("buffers").option("path", folder).option("bufferBytes", 20).option(
        "maxBuffersPerTrigger", 2).load()
    q = stream.writeStream.foreachBatch(lambda b, k: got.append([(r["offset"], r["value"].strip("\0")) for r in b.collect()])) \
        .option("checkpointLocation", f"{scratch}/ck").trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    assert [len(b) for b in got] == [2, 2, 2, 2, 1]
    assert [r for b in got for r in b] == [(20 * k, f"{k}::2::3") for k in range(9)]


def test_sent_buffers_take_little_disk(spark, monkeypatch):
    """The stored buffers are mostly padding: packed, they take less than a tenth of the bytes that were sent."""
    import __spark_entry__ as E
    from kestrel.plans import text_queries as X
    kept = []
    monkeypatch.setattr(X, "remove_scratch", lambda spark, path: kept.append(path))
    n = E.queries()["stream_lines_clean"](spark, "/root/testdata/sf0.001").count()
    size = spark.read.format("binaryFile").load(kept[0]).agg(F.sum("length")).first()[0]
    assert n > 0 and size < n * X.BUFFER_BYTES / 10


def test_narrow_windows_fold_as_wide_ones_do(monkeypatch):
    """Plain floats and arrays give the same weights, bit by bit."""
    from kestrel.operators import rules
    rng = np.random.default_rng(8)
    for penalty in ("l2", "none", "huber"):
        for unit in (1.0, 1e-200):
            rule, X, y = NormalizedGD(penalty=penalty), rng.normal(size=(20, 3)) * unit, rng.normal(size=20)
            G, c, w = X.T @ X, X.T @ y, rng.normal(size=3)
            narrow = rule.apply(w, G, c, 20)
            with monkeypatch.context() as m:
                m.setattr(rules, "NARROW", 0)
                assert narrow.tolist() == rule.apply(w, G, c, 20).tolist()


def test_a_batch_of_a_stream_is_one_run(spark):
    """Under a million rows, or 50,000 sums, are folded by one task: no barrier, whose tasks speak once a second."""
    _, _, df = points(spark, 120, 3, 10)
    rule = LogisticGD(step=0.05, iterations=2)
    told = R.fold_points(df, np.zeros(3), rule, 3, 10, 99_000)._jdf.queryExecution().toString()
    assert "MapInArrow" in told and "_run" in told and "SinglePartition" in told


def test_pruned_trace_finds_like_versions_far_apart():
    """Versions that come back to like weights: few cells are scored, however often; odd numbers count as before."""
    rng = np.random.default_rng(11)
    X, y = np.c_[rng.normal(size=(3000, 2)), np.ones(3000)], np.where(rng.random(3000) < 0.3, -1.0, 1.0)
    W = rng.normal(scale=0.3, size=(2000, 3)) + [0.0, 0.0, -0.6]
    full, cells = _errors_full(X, y, W, 1_000_000)
    pruned, fewer = _errors_pruned(X, y, W, 1_000_000)
    assert (full == pruned).all() and fewer < cells / 5
    X[3, 0], X[5, 1], W[7, 0], y[9] = np.nan, np.inf, np.nan, 0.0
    assert (_errors_full(X, y, W, 1_000_000)[0] == _errors_pruned(X, y, W, 1_000_000)[0]).all()
