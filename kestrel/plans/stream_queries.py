"""Registered queries that replay ``events`` through real streams.

Each replays the table through the rate source, runs the streaming query to its end, and returns what the
stream left in its tables; the oracles are those of the batch queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.linalg import dot
from kestrel.operators.glm import train_batches, weights_long
from kestrel.operators.rules import SGD, LogisticGD, NormalizedGD
from kestrel.operators.score import predict_with_versions
from kestrel.plans import params as P
from kestrel.plans.glm_queries import arithmetic_hash
from kestrel.session import scratch_path
from kestrel.sources.replay import batch_rows, replay_groups, replay_rows
from kestrel.sources.tables import events_points
from kestrel.streaming.glm_stream import StreamingGLM, scorer
from kestrel.streaming.modelstore import ModelStore


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_points(spark, sf_dir).filter(~F.col("holdout")).select("seq", "ts", "day", "y", "x")


def _source_rank():
    return F.when(F.hour("ts") < 12, F.lit(0)).otherwise(F.lit(1))


def _store(spark) -> ModelStore:
    return ModelStore(spark, scratch_path(spark, "models"))


def _windows(spark, sf_dir, rule) -> DataFrame:
    """Count windows over a replayed stream whose batches cut windows."""
    replay = replay_rows(_points(spark, sf_dir).select("seq", "y", "x"), "seq")
    glm = StreamingGLM(_store(spark), rule, P.POINTS_DIM, w0=[0.0] * P.POINTS_DIM, window=P.WINDOW)
    replay.start(glm.process_batch, scratch_path(spark, "ckpt"), batch_rows(replay.units)).awaitTermination()
    replay.remove()
    return weights_long(glm.store.versions().filter(F.col("version") >= 0))


def stream_ridge_replay_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, NormalizedGD(step=P.STEP, iterations=P.ITERATIONS, reg=P.RIDGE_REG))


def stream_logistic_replay_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, LogisticGD(step=P.STEP, iterations=P.ITERATIONS, reg=P.LOGISTIC_REG))


def stream_rate_replay_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the stream is stopped half way and started again from its checkpoint; nothing is lost or repeated."""
    replay = replay_rows(_points(spark, sf_dir).select("seq", "y", "x"), "seq")
    glm = StreamingGLM(_store(spark), NormalizedGD(step=P.STEP, iterations=P.ITERATIONS, reg=P.RIDGE_REG), P.POINTS_DIM,
                       w0=[0.0] * P.POINTS_DIM, window=P.WINDOW)
    checkpoint, rows = scratch_path(spark, "ckpt"), replay.units
    for units in (rows // 2, rows):
        replay.units = units
        replay.start(glm.process_batch, checkpoint, batch_rows(rows)).awaitTermination()
    replay.remove()
    return weights_long(glm.store.versions().filter(F.col("version") >= 0))


def _daily(spark, sf_dir, pts: DataFrame, rule=None, **kw) -> ModelStore:
    """Streaming SGD, one micro-batch a day."""
    replay = replay_groups(pts, "day")
    rule = rule or SGD(step=P.SGD_STEP, iterations=P.SGD_ITERATIONS)
    glm = StreamingGLM(_store(spark), rule, P.POINTS_DIM, w0=[0.0] * P.POINTS_DIM, **kw)
    replay.start(glm.process_batch, scratch_path(spark, "ckpt"), 1).awaitTermination()
    replay.remove()
    return glm.store


def stream_predict_while_training_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 beside T4: one stream trains while another, live at the same time, scores the hold-out with the model
    current at each of its batches.

    The models do not depend on when they are read.  ``n_scored`` hold-out rows were scored once; ``n_wrong`` of
    their predictions are not what their version gives, or were scored twice.
    """
    store, sink = _store(spark), scratch_path(spark, "predictions")
    glm = StreamingGLM(store, NormalizedGD(step=P.STEP, iterations=P.ITERATIONS, reg=P.RIDGE_REG), P.POINTS_DIM,
                       w0=[0.0] * P.POINTS_DIM, window=P.WINDOW)
    store.start(glm.w0)
    hold = events_points(spark, sf_dir).filter("holdout").select("seq", "y", "x")
    train, test = replay_rows(_points(spark, sf_dir).select("seq", "y", "x"), "seq"), replay_rows(hold, "seq")
    running = [train.start(glm.process_batch, scratch_path(spark, "ckpt"), batch_rows(train.units)),
               test.start(scorer(store, sink, "test"), scratch_path(spark, "ckpt"), max(1, -(-test.units // 8)))]
    for r in running:
        r.awaitTermination()
    versions = store.versions()
    predictions = spark.read.parquet(sink)
    # a version for each scored batch at most: few rows, which go to the predictions, so that none wait for one version's task
    used = versions.join(F.broadcast(predictions.select("version").distinct()), "version", "left_semi")
    scored = predictions.join(hold.select("seq", "x"), "seq").join(
        F.broadcast(used.select("version", "weights")), "version", "left")
    right = F.coalesce(F.col("prediction") == dot(F.col("x"), F.col("weights")), F.lit(False))
    told = scored.agg(F.count_distinct("seq").alias("n_scored"),
                      (F.count(F.lit(1)) - F.count_distinct("seq") + F.count_if(~right)).alias("n_wrong"))
    return weights_long(versions.filter(F.col("version") >= 0)).crossJoin(F.broadcast(told))


def stream_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream reports of every update: rows seen, and how many of its rows the model before it got wrong."""
    path = scratch_path(spark, "metrics")
    _daily(spark, sf_dir, _points(spark, sf_dir).drop("ts"), metrics_path=path)
    return spark.read.parquet(path).where("train_ms >= 0").select(
        "version", "n_seen", F.col("n_missed").alias("n_err"))


def stream_sampled_sources_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 with T7 on a stream: two sources a day, every iteration on its own half of the rows."""
    pts = _points(spark, sf_dir).withColumn("source_rank", _source_rank()).drop("ts")
    rule = SGD(step=P.SGD_STEP, iterations=P.SGD_ITERATIONS, fraction=P.SAMPLE_FRACTION)
    store = _daily(spark, sf_dir, pts, rule, hash_fn=arithmetic_hash)
    return weights_long(store.versions().filter(F.col("version") >= 0))


def stream_two_sources_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 on a stream: both sources of a day update the model in turn."""
    pts = _points(spark, sf_dir).withColumn("source_rank", _source_rank()).drop("ts")
    return weights_long(_daily(spark, sf_dir, pts).versions().filter(F.col("version") >= 0))


def stream_train_predict_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's rows scored by the model just trained on them."""
    sink = scratch_path(spark, "predictions")
    _daily(spark, sf_dir, _points(spark, sf_dir).drop("ts"), predictions_path=sink)
    return spark.read.parquet(sink).select("seq", F.round("prediction", 6).alias("prediction"))


def predict_multi_stream_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 with T7: two updates a day, every row scored once, by the day's last model."""
    pts = _points(spark, sf_dir).withColumn("source_rank", _source_rank())
    store = train_batches(pts, SGD(step=P.SGD_STEP, iterations=P.SGD_ITERATIONS), P.POINTS_DIM,
                          ["day", "source_rank"], w0=[0.0] * P.POINTS_DIM)
    scored = predict_with_versions(pts, store.versions(), "day")
    return scored.select("seq", F.round("prediction", 6).alias("prediction"))
