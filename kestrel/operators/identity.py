"""An identity for rows without a key that does not depend on how they are cut into files and tasks.

Equal rows are told apart by a number among themselves: the k-th of m equal rows has the identity hash(content, k).
Which of them is the k-th does not matter, since they are equal; the set of identities is always the same.  A
content that many rows share is numbered task by task, and the tasks' counts are added up first, so no task gets all
rows of a content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_identity(df: DataFrame, content: list[str], out: str) -> DataFrame:
    """Add ``out``, a long that is the same for the same multiset of rows."""
    placed = df.withColumn("_content", F.xxhash64(*[F.col(f"`{c}`") for c in content])).withColumn("_task", F.spark_partition_id())
    counts = placed.groupBy("_content", "_task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_content").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_content", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_content", "_task").orderBy(F.lit(0))
    return (placed.withColumn("_k", F.row_number().over(own)).join(before, ["_content", "_task"])
            .withColumn(out, F.xxhash64("_content", F.col("_before") + F.col("_k")))
            .drop("_content", "_task", "_n", "_before", "_k"))
