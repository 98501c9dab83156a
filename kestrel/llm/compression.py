"""Vector code compression: product codes found through per-dimension value dictionaries.

Vectors become integers and are stored once as blocks.  A block keeps, for every dimension, the
dictionary of its distinct integers and one dictionary index per vector.  To compare a block with a
codebook, the squared difference of every distinct integer to all entries is tabulated once; the
distances of a part are then gathered from those tables by dictionary index and added.  No product is
computed per vector.  Everything is integer arithmetic, so results do not depend on layout or order.

A round is one pass over the blocks; a task sends the sums of its codebook cells, and only the summed
cells (entries x dimensions) reach the driver.

Defined cases (see also ``vectors``): rows whose vector does not count are left out; a null ``vec_id`` is kept and
comes last in the order; rows of one id are ordered by their vectors and each coded; with fewer than 16
rows a codebook has as many entries; entries may be equal, the lower index wins; a length that is not a
multiple of the parts makes the later parts longer by one; an integer saturates at 2**27; equal labels
share ``label_error`` and null labels are equal; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import read_table, stored
from kestrel.llm.vectors import in_blocks, matrix, totals, usable

# The contract's scale, parts, entries and rounds.
SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
MOST = 1 << 27

#: A label's sum is kept in this many copies, so the rows of one label meet it in as many tasks.
SALTS = 16


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def cuts(dim: int) -> list[int]:
    """Where the parts begin, and the end."""
    return [k * dim // PARTS for k in range(PARTS + 1)]


def blocks_of(kept: DataFrame, dim: int) -> DataFrame:
    """Blocks: ids, labels, every dimension's dictionary, and indexes into it (unsigned 16 bit, by dimension)."""
    label = kept.schema["label"].dataType.simpleString()

    def make(t: pa.Table) -> dict[str, pa.Array]:
        x = integers(matrix(t.column("embedding").combine_chunks(), dim))
        found = [np.unique(x[:, j], return_inverse=True) for j in range(dim)]
        kept = {n: pa.array([t.column(c).to_pylist()], pa.list_(t.schema.field(c).type))
                for n, c in (("ids", "vec_id"), ("labels", "label"))}
        return kept | {"dictionary": pa.array([[v.astype(np.int32).tobytes() for v, _ in found]], pa.list_(pa.binary())),
                       "codes": pa.array([np.stack([i for _, i in found]).astype(np.uint16).tobytes()])}
    return in_blocks(kept.select("vec_id", "label", "embedding"), dim, make,
                     f"ids array<bigint>, labels array<{label}>, dictionary array<binary>, codes binary")


def opened(block: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """(dictionary per dimension, dimensions x vectors of indexes)."""
    return ([np.frombuffer(v, np.int32).astype(np.int64) for v in block["dictionary"]],
            np.frombuffer(block["codes"], np.uint16).reshape(len(block["dictionary"]), -1))


def nearest(dictionary: list[np.ndarray], codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors x parts of the nearest entries, squared distances summed over parts); books: entries x dimensions."""
    edges = cuts(books.shape[1])
    code = np.zeros((codes.shape[1], PARTS), np.uint8)
    error = np.zeros(codes.shape[1], np.int64)
    for part in range(PARTS):
        distance = np.zeros((codes.shape[1], len(books)), np.int64)
        for j in range(edges[part], edges[part + 1]):
            table = (dictionary[j][:, None] - books[None, :, j]) ** 2
            distance += table[codes[j]]
        code[:, part] = distance.argmin(axis=1)
        error += distance.min(axis=1)
    return code, error


def first_books(kept: DataFrame) -> np.ndarray:
    """The parts of the vectors of the smallest ids."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    return integers(np.array([r[0] for r in rows]))


def refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts assigned to it."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    k, dim = books.shape
    edges = cuts(dim)

    def add(block: dict, cells: np.ndarray) -> None:
        dictionary, codes = opened(block)
        code, _ = nearest(dictionary, codes, shared.value)
        for part in range(PARTS):
            cells[k * dim + part * k:][:k] += np.bincount(code[:, part], minlength=k)
            for j in range(edges[part], edges[part + 1]):
                # below 2**53 in a block, so sums of doubles are exact
                sums = np.bincount(code[:, part], dictionary[j][codes[j]], minlength=k)
                cells[j * k:][:k] += sums.astype(np.int64)

    cells = totals(blocks, k * (dim + PARTS), add, "long")
    shared.destroy()
    out = books.copy()
    for part in range(PARTS):
        counts = cells[k * dim + part * k:][:k]
        for j in range(edges[part], edges[part + 1]):
            out[:, j] = np.where(counts > 0, cells[j * k:][:k] // np.maximum(counts, 1), books[:, j])
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and position, joined by commas."""
    edges = cuts(books.shape[1])
    numbers = (str(int(v)) for a, b in zip(edges[:-1], edges[1:], strict=True) for entry in books for v in entry[a:b])
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    label = blocks.schema["labels"].dataType.elementType

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.slice(row, 1)
                dictionary, codes = opened(block.select(["dictionary", "codes"]).to_pylist()[0])
                code, error = nearest(dictionary, codes, books)
                text, width = code.tobytes().hex(), 2 * PARTS
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).flatten(), block.column(1).flatten(),
                     pa.array([text[i:i + width] for i in range(0, len(text), width)]), pa.array(error)],
                    names=["vec_id", "label", "code", "error"])
    return blocks.mapInArrow(run, f"vec_id bigint, label {label.simpleString()}, code string, error bigint")


def fit(kept: DataFrame, blocks: DataFrame) -> np.ndarray:
    """The codebooks after all rounds, entries x dimensions."""
    books = first_books(kept)
    for _ in range(ROUNDS):
        books = refined(blocks, books)
    return books


def compressed(rows: DataFrame) -> DataFrame:
    """Per kept row of (vec_id, embedding, label): its code, its error, the error of its label and the codebooks' digest."""
    kept, dim = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"), "embedding")
    if not dim:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    blocks = stored(blocks_of(kept, dim), "vector-blocks")
    books = fit(kept, blocks)
    out = stored(coded(blocks, books), "vector-codes").withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    # a label may hold a third of the rows: its one sum goes to SALTS places
    sums = (out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return (out.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_copy")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def op12_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every usable row of embeddings coded."""
    return compressed(read_table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    near = """near_{k} AS MATERIALIZED (
  SELECT rid, part, min({{'d': d, 'e': entry}}) AS best
  FROM (SELECT rid, part, entry, sum((v - c) * (v - c)) AS d FROM cell JOIN book_{k} USING (part, dim) GROUP BY ALL)
  GROUP BY rid, part)"""
    book = """book_{n} AS MATERIALIZED (
  SELECT b.part, b.entry, b.dim, coalesce(m.mean, b.c) AS c
  FROM book_{k} b LEFT JOIN (
    SELECT n.part, n.best.e AS entry, x.dim, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS mean
    FROM near_{k} n JOIN cell x USING (rid, part) GROUP BY ALL) m USING (part, entry, dim))"""
    steps = []
    for k in range(ROUNDS):
        steps += [near.format(k=k), book.format(k=k, n=k + 1)]
    return f"""
WITH fit AS (
  SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid,
         list_transform(embedding, lambda v: CAST(floor({SCALE} * v::DOUBLE) AS BIGINT)) AS x
  FROM fit WHERE len(embedding) = (SELECT len(embedding) FROM fit GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
cell AS MATERIALIZED (
  SELECT rid, dim, dim * {PARTS} // len AS part, v
  FROM (SELECT rid, len(x) AS len, unnest(range(len(x))) AS dim, unnest(x) AS v FROM kept)),
book_0 AS MATERIALIZED (SELECT part, rid AS entry, dim, v AS c FROM cell WHERE rid < {ENTRIES}),
{", ".join(steps)},
{near.format(k=ROUNDS)},
done AS (
  SELECT rid, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM near_{ROUNDS} GROUP BY rid),
total AS (SELECT label, sum(error)::BIGINT AS label_error FROM done JOIN kept USING (rid) GROUP BY label)
SELECT vec_id, code, error, label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, dim)) FROM book_{ROUNDS}) AS codebooks_sha256
FROM done JOIN kept USING (rid) JOIN total ON kept.label IS NOT DISTINCT FROM total.label
"""


OP12_SQL = _op12_sql()
