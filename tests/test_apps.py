"""The reference's applications, run end to end on small derived inputs."""

import os


from kestrel.apps import count_window_job, online_als_job, streaming_sgd_job
from kestrel.sources.tables import events_points, text_rating_lines

SF = "/root/testdata/sf0.001"


def test_streaming_sgd_job(spark, scratch):
    tr, te = f"{scratch}/train", f"{scratch}/test"
    os.makedirs(tr)
    os.makedirs(te)
    pts = events_points(spark, SF).orderBy("seq").collect()
    with open(f"{tr}/a.txt", "w") as fh:
        fh.write("\n".join(f"({r['y']},[{r['x'][0]},{r['x'][1]}])" for r in pts[:600]) + "\nbad\n")
    with open(f"{te}/b.txt", "w") as fh:
        fh.write("\n".join(f"({r['y']},[{r['x'][0]},{r['x'][1]}])" for r in pts[600:]))
    state = {k: f"{scratch}/{k}" for k in ("model_path", "train_checkpoint", "predict_checkpoint", "predictions_path")}
    train_q, pred_q, model = streaming_sgd_job(spark, tr, te, 2, iterations=5, show=3, available_now=True, **state)
    train_q.awaitTermination()
    pred_q.awaitTermination()
    w = model.latest_model()
    assert any(v != 0.0 for v in w)
    # a restart trains on nothing twice and scores a new file with the trained model
    with open(f"{te}/c.txt", "w") as fh:
        fh.write("\n".join(f"({r['y']},[{r['x'][0]},{r['x'][1]}])" for r in pts[:50]))
    train_q, pred_q, model = streaming_sgd_job(spark, tr, te, 2, iterations=5, show=0, available_now=True, **state)
    train_q.awaitTermination()
    pred_q.awaitTermination()
    assert list(model.latest_model()) == list(w) and model.store.state().n_seen == 600
    out = spark.read.parquet(state["predictions_path"])
    assert out.count() == len(pts[600:]) + 50
    scored = {r["value"]: r["prediction"] for r in out.filter("version = 0 AND batch_id = 1").collect()}
    for r in pts[:50]:
        line = f"({r['y']},[{r['x'][0]},{r['x'][1]}])"
        assert abs(scored[line] - (r["x"][0] * w[0] + r["x"][1] * w[1])) < 1e-12


def test_streaming_sgd_job_with_a_timed_trigger(spark, scratch):
    tr, te = f"{scratch}/train", f"{scratch}/test"
    os.makedirs(tr)
    os.makedirs(te)
    queries = streaming_sgd_job(spark, tr, te, 2, show=0, processing_time="1 second")[:2]
    for q in queries:
        assert q.isActive
        q.processAllAvailable()
        q.stop()


def test_count_window_job_resumes(spark, scratch):
    src = f"{scratch}/lines"
    os.makedirs(src)
    pts = events_points(spark, SF).orderBy("seq").collect()[:240]
    for k in (0, 1):
        with open(f"{src}/{k}.txt", "w") as fh:
            fh.write("\n".join(f"1,{r['x'][0]},{r['x'][1]}" for r in pts[120 * k:120 * k + 120]))
        os.utime(f"{src}/{k}.txt", (1_000_000 + k, 1_000_000 + k))
        _, glm = job = count_window_job(spark, spark.readStream.format("text").load(src), 2, window=60, iterations=3,
                                        model_path=f"{scratch}/m", checkpoint_location=f"{scratch}/ck", available_now=True)
        job[0].awaitTermination()
    assert (glm.store.state().version, glm.store.state().n_seen) == (3, 240)


def test_count_window_job_with_holdout(spark, scratch):
    src = f"{scratch}/lines"
    os.makedirs(src)
    pts = events_points(spark, SF).orderBy("seq").collect()
    train = [r for r in pts if not r["holdout"]]
    with open(f"{src}/a.txt", "w") as fh:
        fh.write("\n".join(f"{1 if r['y'] > 0 else 0},{r['x'][0]},{r['x'][1]}" for r in train))
    hold = f"{scratch}/hold.txt"
    with open(hold, "w") as fh:
        fh.write("\n".join(f"{1 if r['y'] > 0 else 0},{r['x'][0]},{r['x'][1]}"
                           for r in pts if r["holdout"]))
    lines = spark.readStream.format("text").load(src)
    q, glm = count_window_job(spark, lines, 2, kind="lasso", window=100, step=0.05,
                              iterations=10, holdout_path=hold, available_now=True)
    q.awaitTermination()
    metrics = spark.read.parquet(f"{glm.store.path}_metrics").collect()
    assert len(metrics) == len(train) // 100
    assert all(m["n_test"] == 100 for m in metrics)


def test_online_als_job(spark, scratch):
    lines = text_rating_lines(spark, SF)
    init, test = f"{scratch}/initial", f"{scratch}/test"
    lines.filter("NOT is_test AND month < DATE '1998-01-01'").select("value").write.text(init)
    lines.filter("is_test").select("value").write.text(test)
    src = f"{scratch}/stream"
    lines.filter("NOT is_test AND month >= DATE '1998-01-01'").select("value").write.text(src)
    q, als = online_als_job(spark, init, test, spark.readStream.format("text").load(src),
                            rank=4, max_iter=3, available_now=True)
    q.awaitTermination()
    m = als.metrics().collect()
    m = {r["interval"]: r for r in m}
    assert set(m) == {-1, 0} and m[0]["rmse_ref"] > 0 and m[-1]["rmse_ref"] > 0
    assert m[0]["n_total"] == lines.filter("NOT is_test").count()
