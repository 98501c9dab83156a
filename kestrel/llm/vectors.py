"""Vectors as blocks of integers: shared by vector compression and whitening.

A block is one row that holds many vectors in column order (``data``: one run of numbers per
dimension), so a pass over a table moves a few long values and not an array per vector.  A
block's cells are bounded, so its memory does not depend on the table.

``usable`` states which rows count: a vector that is null or empty or holds a null, NaN or infinite
component is left out, and so is one whose length is not the table's most frequent length (the
longer of two equally frequent ones).  Integers saturate at the bound a caller names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import BATCH_BYTES

#: Cells (vectors x dimensions) and vectors of one block.
BLOCK_CELLS = 1 << 20
BLOCK_ROWS = 1 << 14


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(rows whose vector counts, their length; 0 if there is none)."""
    finite = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    lengths = kept.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = lengths["d"] if lengths else 0
    return kept.where(F.size(vector) == dim), dim


def block_rows(dim: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, dim)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as rows x dim."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def in_blocks(rows: DataFrame, dim: int, make: Callable[[pa.Table], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Tables of at most one block's vectors, each made into one row of ``schema`` (arrays of length 1)."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    most = block_rows(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                n += part.num_rows
                if n == most:
                    yield row(waiting)
                    waiting, n = [], 0
        if n:
            yield row(waiting)

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        made = make(pa.Table.from_batches(parts))
        return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return rows.mapInArrow(run, schema)


def totals(blocks: DataFrame, slots: int, add: Callable[[dict, np.ndarray], None], kind: str = "double") -> np.ndarray:
    """Sums over all blocks in ``slots`` cells: ``add`` adds a block to its task's cells.

    A task sends one row per cell and the driver gets ``slots`` numbers, however many rows there are.
    """
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, any_row = np.zeros(slots, dtype), False
        for batch in batches:
            for block in batch.to_pylist():
                add(block, cells)
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots, dtype=np.int32)), pa.array(cells)], names=["slot", "total"])

    out = np.zeros(slots, dtype)
    for r in blocks.mapInArrow(run, f"slot int, total {kind}").groupBy("slot").agg(F.sum("total").alias("total")).collect():
        out[r["slot"]] = r["total"]
    return out
