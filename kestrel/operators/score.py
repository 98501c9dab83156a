"""Scoring with model versions.

Every row is scored with the model current at its batch: after the last update of
that batch (train then predict), or before its first (predict then train,
prequential).  A batch may have several updates (one per source) or none; then the
last update before it counts.  Rows meet their version through an equi-join on the
batch key, after the versions were matched to the distinct keys, so every row
comes out once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.linalg import decision, dot

ORDERS = ("train_then_predict", "predict_then_train")


def versions_by_key(versions: DataFrame, keys: DataFrame, order: str = "train_then_predict") -> DataFrame:
    """(key, weights) for every distinct ``key`` of ``keys``; the first part of a version's
    ``batch_key`` is the key it was trained on."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}")
    trained = (versions.filter(F.col("version") >= 0).groupBy(F.col("batch_key")[0].alias("key"))
               .agg(F.max("version").alias("last")))
    # one row per batch key: the window has no partition key but sees no data rows
    upto = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    span = upto if order == "train_then_predict" else before
    current = (keys.select("key").distinct().join(trained, "key", "full")
               .withColumn("_v", F.coalesce(F.max("last").over(span), F.lit(-1))))
    return current.join(versions.select(F.col("version").alias("_v"), "weights"), "_v").select("key", "weights")


def predict_with_versions(points: DataFrame, versions: DataFrame, key: str,
                          order: str = "train_then_predict", x: str = "x") -> DataFrame:
    """Attach ``prediction = w . x`` (V2 predictOn: intercept 0) and ``decision``.

    The versions side is left to Catalyst, which broadcasts it only when it is small."""
    by_key = versions_by_key(versions, points.select(F.col(key).alias("key")), order).withColumnRenamed("key", key)
    return (points.join(by_key, key, "inner")
            .withColumn("prediction", dot(F.col(x), F.col("weights")))
            .withColumn("decision", decision(F.col("prediction")))
            .drop("weights"))
