"""The last version at or before a row's time (T5 on another stream).

Versions and rows are range-partitioned together by time and stored with their partition number.  In a partition, sorted
by time, a running window carries the last version on; what the partitions before it end with comes from a
table of one row per partition.  Ties in time are spread over partitions like any other rows, so
neither a busy instant nor a long gap between versions puts many rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import scratch_path


def last_at(rows: DataFrame, row_time: str, versions: DataFrame, version_time: str, version: str = "version") -> DataFrame:
    """Rows of ``rows`` with the columns of the last version whose time is not after theirs; of versions of one
    time the largest counts, and rows before all versions get none (null columns).  A null time meets no version."""
    spark = rows.sparkSession
    row, found = F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*[F.col(f"`{c}`") for c in versions.columns])
    empty = F.lit(None)
    left = rows.select(F.col(row_time).alias("_t"), F.lit(1).alias("_kind"), F.xxhash64(row).alias("_tie"),
                       row.alias("_row")).withColumn("_v", empty.cast(versions.select(found.alias("v")).schema["v"].dataType))
    right = versions.where(F.col(version_time).isNotNull()).select(
        F.col(version_time).alias("_t"), F.lit(0).alias("_kind"), F.col(version).cast("long").alias("_tie"),
        empty.cast(rows.select(row.alias("r")).schema["r"].dataType).alias("_row"), found.alias("_v"))
    path = scratch_path(spark, "last-at")
    order = ["_t", "_kind", "_tie"]
    left.unionByName(right).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    # one row a partition: the window over it sees no data rows
    ends = placed.where("_kind = 0").groupBy("_part").agg(F.max_by("_v", F.struct(*order)).alias("_end"))
    parts = placed.select("_part").distinct().join(ends, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    current = F.when(F.col("_t").isNotNull(), F.coalesce(F.last("_v", ignorenulls=True).over(here), F.col("_carried")))
    return (placed.join(carried, "_part").withColumn("_current", current).where("_kind = 1")
            .select("_row.*", "_current.*"))
