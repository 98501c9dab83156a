"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance is never formed.  A pass over the fit list applies it to a block of columns: every
task adds up Xc'(Xc Y) of its rows, centred before multiplying, and only dimensions x columns sums
reach the driver.  An outer step applies a Chebyshev polynomial of the covariance, which damps the
spectrum below the block's smallest Ritz value, through that many passes; then QR and Rayleigh-Ritz
order the block.  It ends when the residuals of the wanted components certify them.  The lower edge
of the damped interval comes from a Lanczos column that rides along in the same passes.

Values are integers with a large common offset, so centring is done in two exact steps: the integer
part of the mean is subtracted as an integer, its fraction as a double.

Defined cases (see also ``vectors``): rows whose vector does not count are left out; rows with a null ``vec_id`` and
rows that repeat each get their components, while the fit list holds every distinct vector once; components
whose variance is zero to double precision are not returned (none at all for one distinct vector); with
fewer dimensions than components there are as many as dimensions; equal eigenvalues share a space in which
any orthonormal basis is right; floor(64c) saturates at 2**24; a ``deviation`` beyond a long is null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import read_table, stored
from kestrel.llm.vectors import in_blocks, matrix, totals, usable

# The contract's scale, offset and number of components.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
MOST = 1 << 24

#: Columns of the block beyond the wanted ones.
GUARD = 32
SEED = 13
#: A component is certified when its residual is below this share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Largest ratio of the filter's gains inside the wanted spectrum, and its degree at most.
SPREAD = 1e7
MAX_DEGREE = 20
#: Outer steps before giving up; every one gains several digits (3 to 5 are usual).
MAX_STEPS = 200
#: Variances below this share of the trace are zero to double precision.
NOTHING = 1e-15

OUT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
       "identity_error double")


@dataclass
class Moments:
    """Exact sums of the fit list; the mean is base + part / n in every dimension."""

    n: int
    sums: list[int]
    squares: list[int]

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def fraction(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])

    @property
    def trace(self) -> float:
        return sum(self.n * q - s * s for s, q in zip(self.sums, self.squares, strict=True)) / self.n ** 2


def integer_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """Kept rows as vec_id and x (32-bit integers: floor(64c) + 1000000)."""
    kept, dim = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "embedding")
    scaled = F.transform("embedding", lambda c: (F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c.cast("double") * SCALE)))
                                                 + OFFSET).cast("int"))
    return kept.select("vec_id", scaled.alias("x")), dim


def fit_blocks(x: DataFrame, dim: int) -> DataFrame:
    """Blocks of the distinct vectors: 32-bit integers, row by row."""
    def make(t: pa.Table) -> dict[str, pa.Array]:
        return {"data": pa.array([matrix(t.column("x").combine_chunks(), dim).astype(np.int32).tobytes()])}
    return in_blocks(x.select("x").distinct(), dim, make, "data binary")


def opened(block: dict, dim: int) -> np.ndarray:
    return np.frombuffer(block["data"], np.int32).reshape(-1, dim).astype(np.int64)


def moments(blocks: DataFrame, dim: int) -> Moments:
    """Rows, and per dimension the sums of x and x squared.

    Squares of x - 1000000 are below 2**48; high and low halves are summed apart, so longs hold
    the sums of 2**38 rows.
    """
    def add(block: dict, cells: np.ndarray) -> None:
        v = opened(block, dim) - OFFSET
        square = v * v
        cells[0] += len(v)
        cells[1:dim + 1] += v.sum(axis=0)
        cells[dim + 1:2 * dim + 1] += (square >> 24).sum(axis=0)
        cells[2 * dim + 1:] += (square & ((1 << 24) - 1)).sum(axis=0)

    cells = [int(c) for c in totals(blocks, 3 * dim + 1, add, "long")]
    n, sums = cells[0], cells[1:dim + 1]
    squares = [(h << 24) + low for h, low in zip(cells[dim + 1:2 * dim + 1], cells[2 * dim + 1:], strict=True)]
    return Moments(n, [s + n * OFFSET for s in sums],
                   [q + 2 * OFFSET * s + n * OFFSET * OFFSET for s, q in zip(sums, squares, strict=True)])


def applied(blocks: DataFrame, m: Moments, columns: np.ndarray) -> np.ndarray:
    """Covariance of the fit list times the columns: one distributed pass."""
    dim, width = columns.shape
    shared = blocks.sparkSession.sparkContext.broadcast((m.base, m.fraction, columns))

    def add(block: dict, cells: np.ndarray) -> None:
        base, fraction, y = shared.value
        centred = (opened(block, dim) - base).astype(np.float64) - fraction
        cells += (centred.T @ (centred @ y)).ravel()

    out = totals(blocks, dim * width, add).reshape(dim, width) / m.n
    shared.destroy()
    return out


class LowEdge:
    """Lanczos on one column that rides along in the passes: a bound below the spectrum."""

    def __init__(self, start: np.ndarray):
        self.basis = [start / np.linalg.norm(start)]
        self.diagonal: list[float] = []
        self.beside: list[float] = []

    def take(self, image: np.ndarray) -> None:
        v = self.basis[-1]
        self.diagonal.append(float(v @ image))
        known = np.column_stack(self.basis)
        for _ in range(2):
            image = image - known @ (known.T @ image)
        size = float(np.linalg.norm(image))
        done = len(self.basis) == len(v) or size <= 1e-10 * abs(self.diagonal[0])
        self.beside.append(0.0 if done else size)
        if not done:
            self.basis.append(image / size)

    @property
    def done(self) -> bool:
        return bool(self.beside) and self.beside[-1] == 0.0

    def bound(self) -> float:
        k = len(self.diagonal)
        inner = np.diag(self.diagonal) + np.diag(self.beside[:k - 1], 1) + np.diag(self.beside[:k - 1], -1)
        return max(0.0, float(np.linalg.eigvalsh(inner)[0]) - self.beside[-1])


def principal(apply, dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, largest residual) of the operator ``apply``.

    ``apply`` maps dimensions x columns to its product with a symmetric matrix without negative eigenvalues.
    """
    rng = np.random.default_rng(SEED)
    width = min(dim, wanted + GUARD)
    edge = LowEdge(rng.standard_normal(dim))

    def image(columns: np.ndarray) -> np.ndarray:
        if edge.done:
            return apply(columns)
        out = apply(np.column_stack([columns, edge.basis[-1]]))
        edge.take(out[:, -1])
        return out[:, :-1]

    block = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    product = image(block)
    for _ in range(MAX_STEPS):
        inner = block.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        residual = float(np.linalg.norm(product[:, :wanted] - block[:, :wanted] * values[:wanted], axis=0).max())
        if width == dim or residual <= TOLERANCE * values[0]:
            return values[:wanted], block[:, :wanted], residual
        low, high = edge.bound(), values[-1]
        low = low if low < high else 0.9 * high
        half, middle = (high - low) / 2, (high + low) / 2
        first, last = (np.arccosh(max(1 + 1e-12, (values[i] - middle) / half)) for i in (0, wanted - 1))
        degree = int(min(MAX_DEGREE, max(2, np.log(SPREAD) / max(1e-9, first - last))))
        # the recurrence is scaled so that the polynomial is 1 at the largest Ritz value
        scale = half / (values[0] - middle)
        twice = 2 / scale
        before, now = block, (product - middle * block) * (scale / half)
        for _ in range(degree - 1):
            following = 1 / (twice - scale)
            before, now = now, (image(now) - middle * now) * (2 * following / half) - scale * following * before
            scale = following
        block = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
        product = image(block)
    raise RuntimeError(f"not certified after {MAX_STEPS} steps: residual {residual}")


@dataclass
class Whitening:
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float


def fit(blocks: DataFrame, dim: int) -> Whitening:
    """Components of positive variance, and how far the whitened fit list is from the identity."""
    m = moments(blocks, dim)
    trace = m.trace
    if trace <= 0:
        return Whitening(m, np.zeros(0), np.zeros((dim, 0)), 0.0)
    values, vectors, _ = principal(lambda y: applied(blocks, m, y), dim, min(COMPONENTS, dim))
    some = values > NOTHING * trace
    values, vectors = values[some], vectors[:, some]
    k = len(values)
    shared = blocks.sparkSession.sparkContext.broadcast((m.base, m.fraction, vectors / np.sqrt(values)))

    def add(block: dict, cells: np.ndarray) -> None:
        base, fraction, turn = shared.value
        white = ((opened(block, dim) - base).astype(np.float64) - fraction) @ turn
        cells[:k] += white.sum(axis=0)
        cells[k:] += (white.T @ white).ravel()

    cells = totals(blocks, k + k * k, add) / m.n
    mean = cells[:k]
    covariance = cells[k:].reshape(k, k) - np.outer(mean, mean)
    return Whitening(m, values, vectors, float(np.abs(covariance - np.eye(k)).max()))


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """Per row the exact sum over dimensions of (n x - S) squared; null beyond a long."""
    base, rest = m.base, [s % m.n for s in m.sums]
    d = x - base
    reach = m.n * (int(np.abs(d).max(initial=0)) + 1)
    if reach * reach * x.shape[1] < 1 << 63:
        part = m.n * d - np.array(rest, np.int64)
        return (part * part).sum(axis=1).tolist()
    exact = [sum((m.n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in d]
    return [v if v < 1 << 63 else None for v in exact]


def projected(x: DataFrame, dim: int, w: Whitening) -> DataFrame:
    """``OUT``: one row for each kept row and component."""
    shared = x.sparkSession.sparkContext.broadcast(w)
    x.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20)

    def run(batches):
        w = shared.value
        m, k, trace = w.moments, len(w.values), w.moments.trace
        turn = w.vectors / np.sqrt(w.values)
        for batch in batches:
            rows = batch.num_rows
            if not rows or not k:
                continue
            v = matrix(batch.column(1), dim).astype(np.int64)
            white = ((v - m.base).astype(np.float64) - m.fraction) @ turn
            every = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, m.n, np.int64)), pa.array(deviations(v, m), pa.int64()).take(every),
                pa.array(white.ravel()), pa.array(np.tile(w.values / trace, rows)),
                pa.array(np.full(rows * k, w.identity_error))], names=[c.split()[0] for c in OUT.split(", ")])
    return x.mapInArrow(run, OUT)


def whitened(rows: DataFrame) -> DataFrame:
    """Whitened components of every kept row of (vec_id, embedding)."""
    x, dim = integer_rows(rows)
    if not dim:
        return rows.sparkSession.createDataFrame([], OUT)
    blocks = stored(fit_blocks(x, dim), "whitening-fit")
    return projected(x, dim, fit(blocks, dim))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every usable row of embeddings whitened."""
    return whitened(read_table(spark, sf_dir, "embeddings"))
