"""Replay of a stored table as a stream (A5), without files of its own for the batches.

Spark's ``rate-micro-batch`` source counts: batch k holds the numbers k * n .. (k + 1) * n - 1, and a restart
gives the same numbers again.  A batch of a replay is the rows of a numbered table whose number lies in that range.  The
table is stored once, written by the tasks that hold its rows in order, so the range reads only the row groups
that hold it, and a batch is read by as many tasks as its size asks for.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.ordinal import with_ordinal
from kestrel.session import remove_scratch, scratch_path

#: A replay of n rows takes about this many batches, of at least and at most so many rows.
BATCHES = 16
LEAST_ROWS, MOST_ROWS = 500, 200_000_000


def batch_rows(n: int) -> int:
    """Rows of a batch of a replay of n rows."""
    return min(MOST_ROWS, max(LEAST_ROWS, -(-n // BATCHES)))


class Replay:
    """A table numbered without gaps by ``number`` (0 .. ``units`` - 1; a number may have many rows)."""

    def __init__(self, table: DataFrame, number: str, units: int, path: str | None = None):
        self.table, self.number, self.units, self.path = table, number, units, path

    def start(self, body: Callable[[DataFrame, int], None], checkpoint_location: str, per_batch: int,
              processing_time: str = "0 seconds") -> "Running":
        """Stream it: ``body(rows, batch_id)`` gets ``per_batch`` numbers at a time, in order."""
        spark, ended = self.table.sparkSession, threading.Event()
        numbers = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch)
                   .option("numPartitions", 1).option("startTimestamp", 0).load())

        def batch(rows: DataFrame, batch_id: int) -> None:
            low, high = rows.agg(F.min("value"), F.max("value")).first()
            if low is not None and low < self.units:
                own = F.col(self.number)
                body(self.table.where((own >= low) & (own <= high)).drop(self.number), batch_id)
            if low is not None and high >= self.units - 1:
                ended.set()

        if not self.units:
            ended.set()
        query = (numbers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
                 .trigger(processingTime=processing_time).start())
        return Running(query, ended)

    def remove(self) -> None:
        """Delete the stored copy."""
        if self.path is not None:
            remove_scratch(self.table.sparkSession, self.path)


class Running:
    """A started replay; it ends when the table has been replayed."""

    def __init__(self, query, ended: threading.Event):
        self.query, self.ended = query, ended

    def awaitTermination(self) -> None:  # noqa: N802 - as of a streaming query
        while not self.ended.wait(0.2):
            if not self.query.isActive:
                break
        if self.query.isActive:
            self.query.stop()
        if self.query.exception() is not None and not self.ended.is_set():
            raise self.query.exception()


def stored_numbers(numbered: DataFrame, number: str, units: int) -> Replay:
    """Store a numbered table and replay that copy."""
    spark = numbered.sparkSession
    path = scratch_path(spark, "replay")
    numbered.write.parquet(path)
    return Replay(spark.read.schema(numbered.schema).parquet(path), number, units, path)


def replay_rows(df: DataFrame, order_cols) -> Replay:
    """Replay by row, in the order of ``order_cols``."""
    numbered = with_ordinal(df, order_cols, out="_number")
    replay = stored_numbers(numbered, "_number", 0)
    replay.units = replay.table.count()
    return replay


def replay_groups(df: DataFrame, key: str) -> Replay:
    """Replay by value of ``key``, in its order: all rows of a value come in one batch (a day, an interval), spread
    over files by a hash, so a value that holds many rows is read by many tasks.

    The values are numbered through the ordinal operator, so any number of them will do.
    """
    values = with_ordinal(df.select(key).distinct(), key, out="_number")
    numbers = stored_numbers(values, "_number", 0)
    units = numbers.table.count()
    replay = stored_numbers(df.join(numbers.table, key).repartitionByRange("_number", F.xxhash64(*df.columns)),
                            "_number", units)
    numbers.remove()
    return replay
