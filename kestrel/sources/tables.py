"""Bindings of the engine's data model to the driver's parquet tables.

* points       <- ``events``:     seq = event_id, x = [(user_id % 10)/10, value/100, 1.0],
                                  y = +1 for purchases, else -1; hold-out = event_id % 10 = 0
* wide points  <- ``embeddings``: x = embedding (64 floats as doubles) + bias, y = parity of label
* ratings      <- ``lineitem`` joined to ``orders``: user = o_custkey, item = l_partkey,
                                  rating = least(5, 1 + floor((l_quantity - 1) / 10));
                                  test set = l_orderkey % 10 = 0

Only the columns a query needs are selected, so parquet scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.parse import label_pm1, with_bias

# The hold-out / test split rule shared with the SQL oracles.
HOLDOUT_MOD = 10


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points (seq, ts, day, y, x, holdout) from ``events``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.unix_date(F.to_date("ts")).cast("long").alias("day"),
        F.when(F.col("event_type") == "purchase", F.lit(1.0)).otherwise(F.lit(-1.0)).alias("y"),
        F.array((F.col("user_id") % 10) / 10, F.col("value") / 100, F.lit(1.0)).alias("x"),
        (F.col("event_id") % HOLDOUT_MOD == 0).alias("holdout"),
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide labelled points (seq, y, x) from ``embeddings``: 64 features plus bias."""
    em = read_table(spark, sf_dir, "embeddings")
    return em.select(
        F.col("vec_id").alias("seq"),
        label_pm1(F.col("label").cast("double")).alias("y"),
        with_bias(F.transform("embedding", lambda v: v.cast("double"))).alias("x"),
    )


def ratings_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings (user, item, rating, month, is_test, orderkey) from lineitem joined to orders.

    A shuffle join on the order key; both sides are large at scale, so no
    broadcast is forced (AQE may still pick one when orders turns out small).
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        F.col("o_custkey").cast("int").alias("user"),
        F.col("l_partkey").cast("int").alias("item"),
        F.least(F.lit(5.0), F.lit(1.0) + F.floor((F.col("l_quantity") - 1) / 10)).alias("rating"),
        F.date_trunc("month", F.col("o_orderdate")).cast("date").alias("month"),
        (F.col("l_orderkey") % HOLDOUT_MOD == 0).alias("is_test"),
        F.col("l_orderkey").alias("orderkey"),
    )


def text_rating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user::item::rating`` text lines (the ratings wire format) derived from the tables."""
    r = ratings_from_orders(spark, sf_dir)
    return r.select("orderkey", "is_test", "month", F.concat_ws(
        "::", F.col("user").cast("string"), F.col("item").cast("string"),
        F.col("rating").cast("int").cast("string")).alias("value"))


def text_point_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label,f1,f2`` text lines (the points wire format) derived from ``events``.

    label = 1 for purchases else 0, f1 = user_id % 10, f2 = value.  Error events
    carry their ``props`` text as an extra field and signup events lose their
    value field, so the lines exercise both arity rules.
    """
    ev = read_table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "purchase", F.lit("1")).otherwise(F.lit("0"))
    base = F.concat_ws(",", label, (F.col("user_id") % 10).cast("string"),
                       F.col("value").cast("string"))
    line = (F.when(F.col("event_type") == "error", F.concat_ws(",", base, F.col("props")))
            .when(F.col("event_type") == "signup",
                  F.concat_ws(",", label, (F.col("user_id") % 10).cast("string")))
            .otherwise(base))
    return ev.select(F.col("event_id").alias("seq"), line.alias("value"))
