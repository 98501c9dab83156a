"""Global ordinal and tumbling count windows.

A DataFrame has no arrival order, so every input carries an order key.  The
ordinal is the dense 0-based rank by that key, computed without a
single-partition window:

1. ``approxQuantile`` on the first key column -> bucket split points (one pass,
   mergeable sketch, a few numbers to the driver);
2. ``Bucketizer`` (binary search, JVM-side) assigns every row a bucket; buckets
   are balanced by construction, the split points are plan literals, so
   re-execution after an executor loss lands rows in the same bucket;
3. per-bucket counts (at most ``num_buckets`` rows) -> prefix-sum offsets,
   broadcast (size bounded by the bucket count);
4. ``row_number`` over ``partitionBy(bucket)``: one shuffle, one sort per bucket.

The order key must be unique (it is an order); ties on the first column are
broken by the remaining columns.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.session import shuffle_partitions


def _bucketed(df: DataFrame, cols: list[str], num_buckets: int | None,
              bucket_key: Column | None = None) -> DataFrame:
    spark = df.sparkSession
    p = num_buckets or shuffle_partitions(spark)
    if bucket_key is not None:
        return _bucketize(df.withColumn("_okey", bucket_key.cast("double")), p)
    first_type = df.schema[cols[0]].dataType
    if not isinstance(first_type, T.NumericType | T.DateType | T.TimestampType
                      | T.TimestampNTZType):
        raise TypeError(f"the leading order column must be numeric or temporal, got {first_type}")
    key = F.col(cols[0])
    if isinstance(first_type, T.DateType):
        key = F.unix_date(key)
    elif isinstance(first_type, T.TimestampType | T.TimestampNTZType):
        key = F.unix_micros(key.cast("timestamp"))
    return _bucketize(df.withColumn("_okey", key.cast("double")), p)


def _bucketize(keyed: DataFrame, p: int) -> DataFrame:
    splits: list[float] = []
    if p > 1:
        qs = keyed.approxQuantile("_okey", [i / p for i in range(1, p)], 1.0 / (4 * p))
        splits = sorted({q for q in qs if q is not None and not math.isnan(q)})
    if splits:
        return Bucketizer(splits=[-math.inf] + splits + [math.inf], inputCol="_okey",
                          outputCol="_bucket", handleInvalid="keep").transform(keyed)
    return keyed.withColumn("_bucket", F.lit(0.0))


def with_ordinal(df: DataFrame, order_cols, out: str = "ordinal", offset: int = 0,
                 dense: bool = False, num_buckets: int | None = None,
                 total_col: str | None = None, bucket_key: Column | None = None) -> DataFrame:
    """Add the dense 0-based rank ``out`` (+ ``offset``) by ``order_cols``.

    The only driver action is ``approxQuantile`` (a few split points).  Bucket
    counts turn into prefix offsets inside the plan (a window over the counts
    table, at most one row per bucket) and are broadcast to the row side.
    ``total_col`` optionally adds the number of rows as a column.  Buckets come
    from the leading order column unless ``bucket_key`` gives a numeric key that
    is non-decreasing in the full order (needed when the leading column has
    heavy ties, e.g. one large file, so no bucket holds most rows).
    """
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    if dense:
        # the key is already 0..n-1 up to a shift: no shuffle of rows at all
        lo, n = df.agg(F.min(cols[0]), F.count(F.lit(1))).first()
        framed = df.withColumn(out, F.col(cols[0]) - F.lit(0 if lo is None else lo)
                               + F.lit(offset))
        return framed.withColumn(total_col, F.lit(int(n))) if total_col else framed
    bucketed = _bucketed(df, cols, num_buckets, bucket_key)
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding,
                                                       Window.unboundedFollowing)
    offsets = counts.select(
        "_bucket",
        (F.coalesce(F.sum("_cnt").over(before), F.lit(0)) + F.lit(offset)).alias("_off"),
        F.sum("_cnt").over(everything).alias("_n"))
    w = Window.partitionBy("_bucket").orderBy(*cols)
    numbered = (bucketed.join(F.broadcast(offsets), "_bucket")
                .withColumn(out, F.col("_off") + F.row_number().over(w) - F.lit(1)))
    if total_col:
        numbered = numbered.withColumnRenamed("_n", total_col)
    return numbered.drop("_okey", "_bucket", "_off", "_n")


def count_windows(df: DataFrame, order_cols, size: int, out_block: str = "block",
                  dense: bool = False, n_seen: int = 0, num_buckets: int | None = None) -> DataFrame:
    """Tumbling count windows of ``size`` rows (T2), entirely inside the plan.

    ``n_seen`` rows came before this frame (a stream's earlier micro-batches), so
    ordinals continue from there and the first rows complete the open window.
    Adds ``ordinal``, ``block`` and ``closed``: a block is closed once all its
    ``size`` rows have arrived; the last, incomplete block stays open and is never
    flushed.
    """
    if size <= 0:
        raise ValueError("window size must be positive")
    framed = with_ordinal(df, order_cols, "ordinal", offset=n_seen, dense=dense,
                          num_buckets=num_buckets, total_col="_rows")
    n_closed = ((F.lit(n_seen) + F.col("_rows")) / F.lit(size)).cast("long")
    return (framed.withColumn(out_block, (F.col("ordinal") / F.lit(size)).cast("long"))
            .withColumn("closed", F.col(out_block) < n_closed)
            .drop("_rows"))
