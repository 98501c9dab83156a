"""Structured Streaming: stream = batch, batch replay, train/predict order,
directory and socket sources, ALS retraining."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators.glm import train_batches, train_count_windows
from kestrel.operators.rules import SGD, NormalizedGD
from kestrel.sources.tables import events_points, ratings_from_orders
from kestrel.sources.replay import replay_groups, replay_rows
from kestrel.sources.text import read_lines_stream, read_points_stream
from kestrel.streaming.als_stream import StreamingALS
from kestrel.streaming.glm_stream import StreamingGLM
from kestrel.streaming.modelstore import ModelStore, preview

SF = "/root/testdata/sf0.001"

def _train(spark):
    return events_points(spark, SF).filter(~F.col("holdout")).select("seq", "day", "y", "x")


def _replayed(spark, scratch, rows_per_file, name="replay"):
    """The training points as a stream of files, in order."""
    path = f"{scratch}/{name}"
    pts = _train(spark).orderBy("seq").toPandas()
    for k in range(0, len(pts), rows_per_file):
        one = spark.createDataFrame(pts[k:k + rows_per_file], "seq long, day long, y double, x array<double>")
        one.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("per_batch", [120, 307])
def test_count_window_stream_equals_batch(spark, scratch, per_batch):
    rule = NormalizedGD(step=0.05, iterations=50, reg=0.01)
    batch = train_count_windows(_train(spark), rule, 3, 50)
    want = [(r["version"], r["weights"]) for r in
            batch.versions().filter("version >= 0").orderBy("version").collect()]
    store = ModelStore(spark, f"{scratch}/models", "stream")
    glm = StreamingGLM(store, rule, 3, w0=[0.0] * 3, window=50)
    replay = replay_rows(_train(spark), "seq")
    assert replay.units == 900
    replay.start(glm.process_batch, f"{scratch}/ckpt", per_batch).awaitTermination()
    got = [(r["version"], r["weights"]) for r in
           store.versions().filter("version >= 0").orderBy("version").collect()]
    assert got == want      # bit-identical: window sums are settled before folding
    state = store.state()
    assert state.n_seen == 900 and state.open_n == 900 % 50


def test_replay_by_row_and_group_gives_every_row_once_in_order(spark, scratch):
    pts = _train(spark).where("seq < 300")
    for name, replay, per in (("rows", replay_rows(pts, "seq"), 70), ("days", replay_groups(pts.withColumn("k", F.col("seq") % 7), "k"), 2)):
        got = []
        for units in (replay.units // 2, replay.units):     # stopped half way and started again
            whole, replay.units = replay.units, units
            replay.start(lambda rows, k, got=got: got.append((k, sorted(r["seq"] for r in rows.select("seq").collect()))),
                         f"{scratch}/{name}", per).awaitTermination()
            replay.units = max(whole, units)
        by_batch = {}
        for k, seqs in got:
            by_batch.setdefault(k, []).extend(seqs)
        order = [by_batch[k] for k in sorted(by_batch)]
        all_rows = sorted(r["seq"] for r in pts.select("seq").collect())
        assert sorted(set(x for b in order for x in b)) == all_rows
        if name == "rows":
            assert all(a[-1] < b[0] for a, b in zip(order, order[1:], strict=False))
        else:
            assert [sorted({x % 7 for x in b}) for b in order][:2] == [[0, 1], [2, 3]]
        replay.remove()


def test_replayed_batch_is_idempotent(spark, scratch):
    rule = SGD(step=0.1, iterations=5)
    store = ModelStore(spark, f"{scratch}/models", "m")
    glm = StreamingGLM(store, rule, 3, w0=[0.0] * 3)
    day = _train(spark).filter(F.col("day") == F.lit(19723))
    glm.process_batch(day, 0)
    glm.process_batch(day, 0)
    assert store.versions().filter("version >= 0").count() == 1


def test_training_requires_initial_weights(spark, scratch):
    store = ModelStore(spark, f"{scratch}/models", "m")
    with pytest.raises(ValueError):
        StreamingGLM(store, SGD(), 3).train_on(_train(spark), f"{scratch}/ck")
    with pytest.raises(ValueError):
        train_batches(_train(spark), SGD(), 3, "day", w0=None)


@pytest.mark.parametrize("order", ["train_then_predict", "predict_then_train"])
def test_micro_batch_stream_equals_batch_and_order(spark, scratch, order):
    rule = SGD(step=0.1, iterations=10)
    pts = _train(spark).filter(F.col("day") < F.lit(19727))   # first four days
    batch = train_batches(pts, rule, 3, "day", w0=[0.0] * 3)
    want = [r["weights"] for r in batch.versions().filter("version >= 0").orderBy("version").collect()]
    store = ModelStore(spark, f"{scratch}/models", "m")
    preds = f"{scratch}/preds"
    glm = StreamingGLM(store, rule, 3, w0=[0.0] * 3, order=order, predictions_path=preds)
    days = sorted(r["day"] for r in pts.select("day").distinct().collect())
    for i, d in enumerate(days):
        glm.process_batch(pts.filter(F.col("day") == d), i)
    got = [r["weights"] for r in store.versions().filter("version >= 0").orderBy("version").collect()]
    assert np.allclose(got, want, atol=1e-12)
    first = spark.read.parquet(preds).filter("batch_id = 0").select("prediction").collect()
    if order == "predict_then_train":
        assert all(r["prediction"] == 0.0 for r in first)   # model before the first update
    else:
        assert any(r["prediction"] != 0.0 for r in first)


def test_tuple_point_directory_stream(spark, scratch):
    src = f"{scratch}/points"
    os.makedirs(src)
    with open(f"{src}/a.txt", "w") as fh:
        fh.write("(1.0,[2.0,3.0])\n(2.0,[1.0,1.0])\nbad\n")
    stream = read_points_stream(spark, src, num_features=2)
    assert stream.isStreaming
    q = stream.writeStream.format("memory").queryName("pts").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM pts").collect()
    assert sum(r["reject"] is None for r in rows) == 2
    assert sum(r["reject"] is not None for r in rows) == 1


def test_socket_source_is_lazy(spark):
    df = read_lines_stream(spark, "localhost", 9999)
    assert df.isStreaming and df.columns == ["value"]


def test_preview_cuts_to_100():
    assert preview(range(150)).endswith("...")
    assert preview([1.0, 2.0]) == "[1.0,2.0]"


def test_streaming_als_retrains_on_history(spark, scratch):
    r = ratings_from_orders(spark, SF)
    test = r.filter("is_test").select("user", "item", "rating")
    initial = r.filter("NOT is_test AND month < DATE '1997-01-01'").select("user", "item", "rating")
    later = r.filter("NOT is_test AND month >= DATE '1997-01-01'")
    lines = later.select(F.concat(F.lit("\u0000 "), F.concat_ws("::", "user", "item",
                                                               F.col("rating").cast("int")),
                                  F.lit("\nab\u0000")).alias("value"))
    als = StreamingALS(spark, test, f"{scratch}/hist", f"{scratch}/metrics", initial=initial,
                       rank=4, max_iter=3)
    als.process_batch(lines, 0)
    als.process_batch(lines, 0)   # replay: skipped
    m = als.metrics().collect()
    m = {r["interval"]: r for r in m}
    assert set(m) == {-1, 0}
    assert m[-1]["n_new"] == m[-1]["n_total"] == initial.count()
    assert m[0]["n_new"] == later.count()
    assert m[0]["n_total"] == initial.count() + later.count()
    assert m[0]["rmse_ref"] > 0 and 0 < m[0]["n_scored"] <= m[0]["n_test"]
    assert als.summaries()[0].startswith("Initial set got")
    again = StreamingALS(spark, test, f"{scratch}/hist", f"{scratch}/metrics", initial=initial, rank=4, max_iter=3)
    again.start()
    again.process_batch(lines, 0)   # restart on the same tables: nothing is added
    assert spark.read.parquet(f"{scratch}/hist").count() == m[0]["n_total"] and again.metrics().count() == 2


def test_builder_trains_and_predicts_on_streams(spark, scratch):
    from kestrel.streaming.builder import streaming_linear_regression
    stream = _replayed(spark, scratch, 300)
    model = streaming_linear_regression(spark).set_step_size(0.1).set_num_iterations(5)
    with pytest.raises(ValueError):
        model.latest_model()
    model.set_initial_weights([0.0, 0.0, 0.0])
    q = model.train_on(stream, f"{scratch}/ck1", available_now=True)
    q.awaitTermination()
    w = model.latest_model()
    assert np.any(w != 0.0)
    n = model.store.state().n_seen
    second = _replayed(spark, scratch, 450, "second")
    model.train_on(second, f"{scratch}/ck1b", available_now=True).awaitTermination()
    assert model.store.state().n_seen == n + 900     # a second stream trains the same model
    assert sorted(model.store.state().committed.values()) == [1, 2]
    stream2 = _replayed(spark, scratch, 450, "third")
    q2 = model.predict_on(stream2, f"{scratch}/preds", f"{scratch}/ck2", available_now=True)
    q2.awaitTermination()
    assert spark.read.parquet(f"{scratch}/preds").count() == 900


def test_stream_reports_holdout_error_per_update(spark, scratch):
    rule = NormalizedGD(step=0.05, iterations=50, reg=0.01)
    hold = events_points(spark, SF).filter("holdout").select("x", "y")
    store = ModelStore(spark, f"{scratch}/models", "m")
    glm = StreamingGLM(store, rule, 3, w0=[0.0] * 3, window=50, holdout=hold,
                       metrics_path=f"{scratch}/metrics")
    glm.process_batch(_train(spark).filter("seq < 300"), 0)
    m = spark.read.parquet(f"{scratch}/metrics").orderBy("version").collect()
    assert [r["version"] for r in m] == [0, 1, 2, 3, 4]
    assert all(r["n_test"] == 100 for r in m)


def test_logistic_stream_equals_batch(spark, scratch):
    from kestrel.operators.logistic import train_logistic_windows
    from kestrel.operators.rules import LogisticGD
    rule = LogisticGD(step=0.05, iterations=20, reg=0.1)
    pts = _train(spark).filter("seq < 500")
    batch = train_logistic_windows(pts, 3, 50, rule)
    want = [r["weights"] for r in batch.versions().filter("version >= 0").orderBy("version").collect()]
    store = ModelStore(spark, f"{scratch}/models", "lg")
    glm = StreamingGLM(store, rule, 3, w0=[0.0] * 3, window=50)
    for i, (lo, hi) in enumerate([(0, 130), (130, 140), (140, 390), (390, 500)]):
        glm.process_batch(pts.filter(f"seq >= {lo} AND seq < {hi}"), i)
    got = [r["weights"] for r in
           store.versions().filter("version >= 0").orderBy("version").collect()]
    assert len(got) == len(want) == 9
    assert np.allclose(got, want, atol=1e-12)


def test_multi_source_stream_equals_batch(spark, scratch):
    rule = SGD(step=0.1, iterations=10)
    pts = (_train(spark).filter(F.col("day") < F.lit(19726))
           .join(events_points(spark, SF).select("seq", "ts"), "seq")
           .withColumn("source_rank", F.when(F.hour("ts") < 12, 0).otherwise(1)).drop("ts"))
    batch = train_batches(pts, rule, 3, ["day", "source_rank"], w0=[0.0] * 3)
    want = [r["weights"] for r in batch.versions().filter("version >= 0").orderBy("version").collect()]
    store = ModelStore(spark, f"{scratch}/models", "ms")
    glm = StreamingGLM(store, rule, 3, w0=[0.0] * 3)
    days = sorted(r["day"] for r in pts.select("day").distinct().collect())
    for i, d in enumerate(days):
        glm.process_batch(pts.filter(F.col("day") == d), i)
    got = [r["weights"] for r in store.versions().filter("version >= 0").orderBy("version").collect()]
    assert len(got) == len(want) == 2 * len(days)
    assert np.allclose(got, want, atol=1e-12)


def test_points_line_stream_trains_count_windows(spark, scratch):
    from kestrel.sources.text import points_from_lines
    src = f"{scratch}/lines"
    os.makedirs(src)
    pts = events_points(spark, SF).filter("NOT holdout AND seq < 400").orderBy("seq").collect()
    lines = [f"{1 if r['y'] > 0 else 0},{r['x'][0]!r},{r['x'][1]!r}" for r in pts]
    for k in range(0, len(lines), 90):
        with open(f"{src}/part-{k:05d}.txt", "w") as fh:
            fh.write("\x00 " + "\n".join(lines[k:k + 90]) + "\x00\n")
        os.utime(f"{src}/part-{k:05d}.txt", (1_000_000 + k, 1_000_000 + k))
    stream = points_from_lines(
        spark.readStream.option("maxFilesPerTrigger", 1).format("text").load(src), 2)
    rule = NormalizedGD(step=0.05, iterations=20, reg=0.01)
    store = ModelStore(spark, f"{scratch}/models", "lines")
    glm = StreamingGLM(store, rule, 3, w0=[0.0] * 3, window=50)
    glm.train_on(stream, f"{scratch}/ck", available_now=True).awaitTermination()
    batch = train_count_windows(_train(spark).filter("seq < 400"), rule, 3, 50)
    want = [r["weights"] for r in batch.versions().filter("version >= 0").orderBy("version").collect()]
    got = [r["weights"] for r in
           store.versions().filter("version >= 0").orderBy("version").collect()]
    assert len(got) == len(want) == len(lines) // 50
    assert np.allclose(got, want, atol=1e-9)


def test_rejects_go_to_the_reject_sink(spark, scratch):
    from kestrel.sources.text import points_from_lines
    src = f"{scratch}/lines"
    os.makedirs(src)
    with open(f"{src}/a.txt", "w") as fh:
        fh.write("1,0.5,0.25\n0,0.1,0.2\n1,0.3,oops\n1,1,2,3,4\n0,0.7,0.1\n")
    lines = read_lines_stream(spark, fmt="text", path=src)
    store = ModelStore(spark, f"{scratch}/models", "rj")
    glm = StreamingGLM(store, SGD(step=0.1, iterations=3), 3, w0=[0.0] * 3,
                       rejects_path=f"{scratch}/rejects")
    glm.train_on(points_from_lines(lines, 2), f"{scratch}/ck", available_now=True) \
        .awaitTermination()
    rejects = sorted(r["reject"] for r in spark.read.parquet(f"{scratch}/rejects").collect())
    assert rejects == ["bad_feature", "too_many_fields"]
    assert store.versions().filter("version >= 0").first()["n_rows"] == 3


class Crash(Exception):
    pass


@pytest.mark.parametrize("fails_at", range(5))
@pytest.mark.parametrize("mode", ["windows", "sgd"])
def test_crash_between_any_two_writes_then_replay(spark, scratch, monkeypatch, fails_at, mode):
    """Every write of a batch is the last one that succeeds, once; a replay leaves each table as if
    nothing had happened."""
    import kestrel.streaming.glm_stream as G
    pts = _train(spark).filter("seq < 260").withColumn(
        "reject", F.when(F.col("seq") % 50 == 7, F.lit("bad")))

    def trained(name, crash):
        store = ModelStore(spark, f"{scratch}/{name}", "m")
        out = {k: f"{scratch}/{name}-{k}" for k in ("rejects", "metrics")}
        if mode == "windows":
            glm = StreamingGLM(store, NormalizedGD(step=0.05, iterations=5, reg=0.01), 3, w0=[0.0] * 3, window=50,
                               rejects_path=out["rejects"], metrics_path=out["metrics"])
        else:
            out["preds"] = f"{scratch}/{name}-preds"
            glm = StreamingGLM(store, SGD(step=0.1, iterations=5), 3, w0=[0.0] * 3, rejects_path=out["rejects"],
                               metrics_path=out["metrics"], predictions_path=out["preds"])
        for k, (lo, hi) in enumerate([(0, 120), (120, 260)]):
            batch = pts.filter(f"seq >= {lo} AND seq < {hi}")
            if crash and k == 1:
                left = [fails_at]

                def guarded(fn):
                    def call(*a, **b):
                        if left[0] == 0:
                            raise Crash
                        left[0] -= 1
                        return fn(*a, **b)
                    return call
                with monkeypatch.context() as m:
                    m.setattr(G, "write_part", guarded(G.write_part))
                    m.setattr(ModelStore, "write_versions", guarded(ModelStore.write_versions))
                    m.setattr(ModelStore, "commit", guarded(ModelStore.commit))
                    try:
                        glm.process_batch(batch, k)
                    except Crash:
                        pass
                assert store.versions().groupBy("version").count().filter("count > 1").count() == 0
            glm.process_batch(batch, k)
        drop = ("train_ms", "model_id", "part")
        tables = [store.versions(), *[spark.read.parquet(p) for p in out.values()]]
        return [sorted(str(r) for r in t.drop(*drop).collect()) for t in tables]
    assert trained("a", True) == trained("b", False)


def test_sampled_sources_and_tiny_samples(spark, scratch):
    """The fraction counts with several sources; a batch whose sample is empty is still scored."""
    pts = _train(spark).filter("seq < 60").withColumn("source_rank", (F.col("seq") % 2).cast("int"))
    weights = {}
    for fraction in (1.0, 0.3):
        store = ModelStore(spark, f"{scratch}/m{fraction}", "m")
        glm = StreamingGLM(store, SGD(step=0.1, iterations=8, fraction=fraction), 3, w0=[0.0] * 3,
                           predictions_path=f"{scratch}/p{fraction}")
        glm.process_batch(pts, 0)
        rows = store.versions().filter("version >= 0").orderBy("version").collect()
        assert [(r["version"], r["batch_key"][1]) for r in rows] == [(0, 0), (1, 1)]
        assert [r["n_seen"] for r in rows][-1] == pts.count()
        weights[fraction] = rows[-1]["weights"]
    assert weights[1.0] != weights[0.3]
    store = ModelStore(spark, f"{scratch}/tiny", "m")
    glm = StreamingGLM(store, SGD(step=0.1, iterations=3, fraction=1e-9), 3, w0=[0.0] * 3,
                       predictions_path=f"{scratch}/tinyp")
    glm.process_batch(pts, 0)
    assert store.versions().filter("version >= 0").count() == 2
    assert spark.read.parquet(f"{scratch}/tinyp").count() == pts.count()


def test_lines_of_a_batch_come_in_arrival_order(spark, scratch):
    from kestrel.sources.text import points_from_lines
    src = f"{scratch}/lines"
    os.makedirs(src)
    pts = events_points(spark, SF).filter("NOT holdout AND seq < 400").orderBy("seq").collect()
    lines = [f"{1 if r['y'] > 0 else 0},{r['x'][0]!r},{r['x'][1]!r}" for r in pts]
    # the older file is the smaller one, and comes later by name
    for name, part, t in (("z.txt", lines[:60], 1_000_000), ("a.txt", lines[60:], 2_000_000)):
        with open(f"{src}/{name}", "w") as fh:
            fh.write("\n".join(part) + "\n")
        os.utime(f"{src}/{name}", (t, t))
    stream = points_from_lines(read_lines_stream(spark, fmt="text", path=src), 2)
    rule = NormalizedGD(step=0.05, iterations=20, reg=0.01)
    store = ModelStore(spark, f"{scratch}/models", "lines")
    StreamingGLM(store, rule, 3, w0=[0.0] * 3, window=50).train_on(stream, f"{scratch}/ck", available_now=True).awaitTermination()
    want = train_count_windows(_train(spark).filter("seq < 400"), rule, 3, 50).versions().orderBy("version").collect()
    got = store.versions().orderBy("version").collect()
    assert [r["weights"] for r in got] == [r["weights"] for r in want]


def test_large_logistic_window_runs_distributed(spark):
    from kestrel.operators.logistic import train_logistic_windows
    from kestrel.operators.rules import LogisticGD
    rule, pts = LogisticGD(step=0.05, iterations=4, reg=0.1), _train(spark).filter("seq < 400")
    small, large = (train_logistic_windows(pts, 3, 100, rule, rows_per_task=n).versions().orderBy("version").collect()
                    for n in (100_000, 10))
    assert len(small) == len(large) == 4
    assert np.allclose([r["weights"] for r in small], [r["weights"] for r in large], atol=1e-12)


def test_error_trace_of_many_versions(spark):
    from kestrel.operators.metrics import error_trace
    hold = events_points(spark, SF).filter("holdout").select("x", "y")
    versions = spark.range(50_000).select(F.col("id").alias("version"), F.array(
        (F.col("id") % 7 - 3).cast("double"), (F.col("id") % 5 - 2).cast("double"), F.lit(0.25)).alias("weights"))
    out = error_trace(hold, versions, max_weights=60_000, max_cells=100_000)
    assert out.count() == 50_000
    X, y = (np.array([r[c] for r in hold.collect()]) for c in ("x", "y"))
    for r in out.filter("version % 9973 = 1").collect():
        w = np.array([r["version"] % 7 - 3, r["version"] % 5 - 2, 0.25])
        assert r["n_err"] == int((np.where(X @ w > 0, 1.0, -1.0) != y).sum()) and r["n_test"] == len(y)
