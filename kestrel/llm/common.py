"""Helpers shared by the corpus operators: tables, word rules, scratch tables, ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.session import scratch_path

# White space is space and \x09-\x0D; a word is a run of anything else.
# bytes.split() splits at exactly these six bytes, so it finds the same words.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Rows and bytes in one Arrow batch sent to a Python worker: bounds its memory.
BATCH_ROWS = 1500
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts vary from a word to megabytes, so batches are bounded by bytes too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
              schema) -> DataFrame:
    """``mapInArrow`` of one function from batch to batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def stored_at(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """``stored``, and the folder, for callers that remove it when nothing reads it any more."""
    path = scratch_path(df.sparkSession, f"llm-{kind}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: cuts lineage, survives
    lost executors."""
    return stored_at(df, kind)[0]


def crc32_mod(col: str, mod: int) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based rank of the rows in a total order, without a single-task sort of the rows.

    The rows are range-partitioned and stored with their partition number; the
    only window without a key runs over one count per partition.
    """
    placed = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()),
                    "rank")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    within = Window.partitionBy("_part").orderBy(*order)
    return (placed.join(offsets, "_part")
            .withColumn(out, F.col("_before") + F.row_number().over(within) - 1)
            .drop("_part", "_before"))
