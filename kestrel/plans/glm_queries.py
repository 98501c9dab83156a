"""Registered GLM queries over the driver's tables (events, embeddings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.linalg import dot
from kestrel.operators.asof import last_at
from kestrel.operators.glm import train_batches, train_count_windows, weights_long, window_grams
from kestrel.operators.gram import gram_long
from kestrel.operators.logistic import train_logistic_windows
from kestrel.operators.metrics import error_trace
from kestrel.operators.ordinal import count_windows
from kestrel.operators.rules import LogisticGD, NormalizedGD, SGD
from kestrel.operators.score import predict_with_versions
from kestrel.plans import params as P
from kestrel.sources.tables import embedding_points, events_points


def _train_points(spark, sf_dir) -> DataFrame:
    return events_points(spark, sf_dir).filter(~F.col("holdout"))


def _ridge():
    return NormalizedGD(step=P.STEP, iterations=P.ITERATIONS, reg=P.RIDGE_REG, penalty="l2")


def _lasso():
    return NormalizedGD(step=P.STEP, iterations=P.ITERATIONS, reg=P.LASSO_REG,
                        penalty="huber", epsilon=P.LASSO_EPS)


def _trained(store) -> DataFrame:
    return store.versions().filter(F.col("version") >= 0)


def count_windows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = count_windows(_train_points(spark, sf_dir), "seq", P.WINDOW)
    return framed.groupBy("block").agg(
        F.count(F.lit(1)).alias("n_rows"), F.first("closed").alias("closed"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def window_gram_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = window_grams(_train_points(spark, sf_dir), P.POINTS_DIM, P.WINDOW)
    return gram_long(g, "block", P.POINTS_DIM).select(
        "block", "n", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
        F.round("value", 8).alias("value"))


def online_ridge_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = train_count_windows(_train_points(spark, sf_dir), _ridge(), P.POINTS_DIM, P.WINDOW)
    return weights_long(_trained(store))


def online_ridge_small_scale_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and bias times 1e-11, no penalty: nothing in the fold may depend on their units."""
    pts = _train_points(spark, sf_dir).withColumn(
        "x", F.transform("x", lambda v: v * F.lit(10.0 ** P.SMALL_SCALE)))
    rule = NormalizedGD(step=P.STEP, iterations=P.ITERATIONS, reg=0.0, penalty="l2")
    return weights_long(_trained(train_count_windows(pts, rule, P.POINTS_DIM, P.WINDOW)))


def online_lasso_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = train_count_windows(_train_points(spark, sf_dir), _lasso(), P.POINTS_DIM, P.WINDOW)
    return weights_long(_trained(store))


def ridge_holdout_trace_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = events_points(spark, sf_dir)
    store = train_count_windows(pts.filter(~F.col("holdout")), _ridge(), P.POINTS_DIM, P.WINDOW)
    return error_trace(pts.filter(F.col("holdout")), _trained(store).select("version", "weights"))


def ridge_holdout_trace_pruned_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trace, scoring only rows near the plane again; ``fewer``: less than versions x rows cells were scored."""
    pts = events_points(spark, sf_dir)
    store = train_count_windows(pts.filter(~F.col("holdout")), _ridge(), P.POINTS_DIM, P.WINDOW)
    trace = error_trace(pts.filter(F.col("holdout")), _trained(store).select("version", "weights"), pruned=True)
    cells = trace.agg((F.sum("scored") < F.sum("n_test")).alias("fewer"))
    return trace.drop("scored").crossJoin(F.broadcast(cells))


def latest_model_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = train_count_windows(_train_points(spark, sf_dir), _ridge(), P.POINTS_DIM, P.WINDOW)
    return weights_long(store.latest())


def online_logistic_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = LogisticGD(step=P.STEP, iterations=P.ITERATIONS, reg=P.LOGISTIC_REG)
    store = train_logistic_windows(_train_points(spark, sf_dir), P.POINTS_DIM, P.WINDOW, rule)
    return weights_long(_trained(store))


def online_logistic_shared_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 with windows that no single task holds: every iteration is a distributed sum."""
    rule = LogisticGD(step=P.STEP, iterations=P.ITERATIONS, reg=P.LOGISTIC_REG)
    store = train_logistic_windows(_train_points(spark, sf_dir), P.POINTS_DIM, P.LARGE_WINDOW, rule,
                                   rows_per_task=P.LARGE_SHARE)
    return weights_long(_trained(store))


def _wide_store(spark, sf_dir):
    return train_count_windows(embedding_points(spark, sf_dir), _ridge(), P.WIDE_DIM, P.WINDOW)


def wide_ridge_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights_long(_trained(_wide_store(spark, sf_dir)))


def model_preview_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest wide model as logged: first 100 weights at most."""
    latest = _wide_store(spark, sf_dir).latest()
    return weights_long(latest.select("version", F.slice("weights", 1, 100).alias("weights")))


def model_preview_cut_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 with more than 100 weights: the newest model over the embeddings and their squares, cut."""
    pts = embedding_points(spark, sf_dir)
    both = F.concat(F.slice("x", 1, P.WIDE_DIM - 1), F.transform(F.slice("x", 1, P.WIDE_DIM - 1), lambda v: v * v),
                    F.array(F.lit(1.0)))
    store = train_count_windows(pts.withColumn("x", both), _ridge(), 2 * P.WIDE_DIM - 1, P.WINDOW)
    return weights_long(store.latest().select("version", F.slice("weights", 1, 100).alias("weights")))


def predict_other_stream_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: models trained on one half of the events score the other half, each row by the last model
    whose window had ended at the row's time."""
    pts = events_points(spark, sf_dir)
    train = pts.where("seq % 2 = 0")
    ended = (count_windows(train, "seq", P.WINDOW).where("closed").groupBy(F.col("block").alias("version"))
             .agg(F.max("ts").alias("ended")))
    versions = _trained(train_count_windows(train, _ridge(), P.POINTS_DIM, P.WINDOW)).select("version", "weights")
    scored = last_at(pts.where("seq % 2 = 1").select("seq", "ts", "x"), "ts", versions.join(ended, "version"), "ended")
    return scored.where("version IS NOT NULL").select(
        "seq", "version", F.round(dot("x", "weights"), 6).alias("prediction"))


# ---- V2: one update per day of ts (micro-batch stand-in) ----------------------

def _sgd(updater: str, reg: float = 0.0, fraction: float = 1.0) -> SGD:
    return SGD(step=P.SGD_STEP, iterations=P.SGD_ITERATIONS, fraction=fraction, reg=reg,
               updater=updater)


def _day_store(spark, sf_dir, rule, **kw):
    return train_batches(_train_points(spark, sf_dir), rule, P.POINTS_DIM, "day",
                         w0=[0.0] * P.POINTS_DIM, **kw)


def linear_sgd_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights_long(_trained(_day_store(spark, sf_dir, _sgd("none"))))


def ridge_sgd_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights_long(_trained(_day_store(spark, sf_dir, _sgd("l2", P.SGD_L2_REG))))


def lasso_sgd_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights_long(_trained(_day_store(spark, sf_dir, _sgd("l1", P.SGD_L1_REG))))


def arithmetic_hash(seq, t):
    return F.pmod(seq * F.lit(P.HASH_A) + t * F.lit(P.HASH_B), F.lit(P.HASH_M)) / F.lit(
        float(P.HASH_M))


def linear_sgd_sampled_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = _sgd("none", fraction=P.SAMPLE_FRACTION)
    return weights_long(_trained(_day_store(spark, sf_dir, rule, hash_fn=arithmetic_hash)))


def _predict(spark, sf_dir, order):
    pts = _train_points(spark, sf_dir)
    store = train_batches(pts, _sgd("none"), P.POINTS_DIM, "day", w0=[0.0] * P.POINTS_DIM)
    versions = store.versions()
    scored = predict_with_versions(pts, versions, "day", order)
    return scored.select("seq", F.round("prediction", 6).alias("prediction"))


def predict_after_train_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predict(spark, sf_dir, "train_then_predict")


def predict_prequential_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predict(spark, sf_dir, "predict_then_train")


def multi_stream_train_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A morning and an evening stream train one model, in turn, each day."""
    pts = _train_points(spark, sf_dir).withColumn(
        "source_rank", F.when(F.hour("ts") < 12, F.lit(0)).otherwise(F.lit(1)))
    store = train_batches(pts, _sgd("none"), P.POINTS_DIM, ["day", "source_rank"],
                          w0=[0.0] * P.POINTS_DIM)
    return weights_long(_trained(store))
