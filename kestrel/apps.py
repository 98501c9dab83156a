"""Ready-to-run streaming jobs: the reference's applications, wired from the
library's sources, trainers and sinks (keyword arguments instead of a CLI).

* :func:`count_window_job` — lines ``label,f1..fd`` -> ridge / lasso / logistic over
  count windows, hold-out error after every window (the V1 jobs);
* :func:`streaming_sgd_job` — ``(y,[x1..xn])`` files in a training directory update
  the model each micro-batch; files in a test directory are scored (the V2 demo);
* :func:`online_als_job` — initial and test ratings files, then a ratings line
  stream; every interval appends and retrains (the ALS job).

Each returns the started ``StreamingQuery`` objects.  State lives below ``spark.checkpoint.dir`` unless
paths are given; a job that is to resume after a restart takes the same ``model_path`` (or
``history_path`` and ``metrics_path``) and checkpoint locations again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.operators.rules import LogisticGD, lasso_rule, ridge_rule
from kestrel.session import prepare, scratch_path
from kestrel.sources.text import (
    points_from_lines, read_points_csv, read_points_stream, read_ratings)
from kestrel.streaming.als_stream import StreamingALS
from kestrel.streaming.builder import streaming_linear_regression
from kestrel.streaming.glm_stream import StreamingGLM, started
from kestrel.streaming.modelstore import ModelStore

# The reference jobs' batch intervals.
GLM_INTERVAL = "3 seconds"
SGD_INTERVAL = "5 seconds"
ALS_INTERVAL = "10 seconds"


def _trigger(kw: dict, default: str) -> dict:
    if kw.get("available_now"):
        return {"available_now": True}
    return {"processing_time": kw.get("processing_time", default)}


def count_window_job(spark: SparkSession, lines: DataFrame, d: int, kind: str = "ridge",
                     window: int = 50, step: float = 0.1, iterations: int = 50,
                     reg: float | None = None, epsilon: float = 0.01,
                     holdout_path: str | None = None, min_length: int | None = None,
                     model_path: str | None = None, model_id: str = "count-window",
                     checkpoint_location: str | None = None,
                     **trigger):
    """V1: ``lines`` is a streaming frame with a ``value`` column (socket or files)."""
    prepare(spark)
    if kind == "ridge":
        rule = ridge_rule(step=step, iterations=iterations, **({} if reg is None else {"reg": reg}))
    elif kind == "lasso":
        rule = lasso_rule(step=step, iterations=iterations, epsilon=epsilon,
                          **({} if reg is None else {"reg": reg}))
    elif kind == "logistic":
        rule = LogisticGD(step=step, iterations=iterations, reg=0.1 if reg is None else reg)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    store = ModelStore(spark, model_path or scratch_path(spark, "models"), model_id)
    holdout = read_points_csv(spark, holdout_path, d) if holdout_path else None
    glm = StreamingGLM(store, rule, d + 1, w0=[0.0] * (d + 1), window=window, holdout=holdout,
                       metrics_path=f"{store.path}_metrics", rejects_path=f"{store.path}_rejects")
    points = points_from_lines(lines, d, min_length=min_length)
    query = glm.train_on(points, checkpoint_location or scratch_path(spark, "ckpt"),
                         **_trigger(trigger, GLM_INTERVAL))
    return query, glm


def streaming_sgd_job(spark: SparkSession, train_dir: str, test_dir: str, num_features: int,
                      predictions_path: str | None = None, step: float | None = None,
                      iterations: int | None = None, show: int = 10,
                      model_path: str | None = None, model_id: str = "streaming-sgd",
                      train_checkpoint: str | None = None, predict_checkpoint: str | None = None,
                      **trigger):
    """V2 demo: train on one directory stream, predict on another with the current model."""
    prepare(spark)
    model = streaming_linear_regression(spark, model_root=model_path)
    if step is not None:
        model.set_step_size(step)
    if iterations is not None:
        model.set_num_iterations(iterations)
    model.resume(model_id, [0.0] * num_features)
    trig = _trigger(trigger, SGD_INTERVAL)
    train_q = model.train_on(read_points_stream(spark, train_dir, num_features),
                             train_checkpoint or scratch_path(spark, "ckpt"), **trig)
    preds = predictions_path or scratch_path(spark, "predictions")
    pred_q = model.predict_on(read_points_stream(spark, test_dir, num_features)
                              .filter("reject IS NULL"),
                              preds, predict_checkpoint or scratch_path(spark, "ckpt"), show=show, **trig)
    return train_q, pred_q, model


def online_als_job(spark: SparkSession, initial_path: str, test_path: str, lines: DataFrame,
                   rank: int = 200, max_iter: int = 50, reg: float = 0.1,
                   history_path: str | None = None, metrics_path: str | None = None,
                   checkpoint_location: str | None = None, **trigger):
    """ALS job: train on the initial file, then retrain on every interval's new lines."""
    prepare(spark)
    als = StreamingALS(spark, read_ratings(spark, test_path),
                       history_path or scratch_path(spark, "ratings-history"),
                       metrics_path or scratch_path(spark, "als-metrics"),
                       initial=read_ratings(spark, initial_path),
                       rank=rank, max_iter=max_iter, reg=reg).start()
    for line in als.summaries():
        print(line)
    query = started(lines, als.process_batch, checkpoint_location or scratch_path(spark, "ckpt"),
                    **{"processing_time": None, "available_now": False, **_trigger(trigger, ALS_INTERVAL)})
    return query, als


__all__ = ["count_window_job", "streaming_sgd_job", "online_als_job"]
