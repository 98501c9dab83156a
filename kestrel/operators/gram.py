"""Sums of products per window.

For squared loss the mean gradient of a window is ``(G w - c) / n`` with
``G = sum x x^T`` and ``c = sum x y``; so one aggregation pass replaces every
gradient pass of every iteration.  The result is packed: with ``z = x ++ [y]``
of length ``p``, ``s`` holds ``sum z_i z_j`` for ``i <= j`` in row-major order
(length ``p (p + 1) / 2``), so G, c and ``sum y^2`` are all in it.

Narrow vectors (p <= ``wide_threshold``) use native ``sum`` expressions: partial
aggregation map-side, whole-stage codegen.  Wide vectors use ``mapInPandas``
(``Z^T Z`` per block with NumPy, one packed array per block and task) and add up
the packed arrays natively.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Keys whose packed sums a task of the wide path holds before it sends them on.
KEYS_PER_PARTIAL = 2000


def packed_len(p: int) -> int:
    return p * (p + 1) // 2


@lru_cache
def _triangle(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p)


@lru_cache
def _places(p: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Where a packed triangle holds its diagonal, and the row and column of each of its numbers."""
    pairs = [(int(i), int(j)) for i, j in zip(*_triangle(p))]
    return [k for k, (i, j) in enumerate(pairs) if i == j], pairs


def unpack(s, p: int):
    """Packed sums -> (G (p-1 x p-1), c (p-1), yy) as NumPy arrays."""
    m = np.empty((p, p))
    i, j = _triangle(p)
    m[i, j] = s
    m[j, i] = s
    return m[:-1, :-1], m[:-1, -1], m[-1, -1]


def settled(s, p: int, digits: int):
    """Packed sums -> (G, c, yy) with every sum rounded to ``digits`` significant digits of its scale.

    The scale of ``sum z_i z_j`` is ``sqrt(sum z_i^2 * sum z_j^2)``, its largest possible size, so
    the rounding is the same whatever the units of the columns.  It removes the noise
    that the order of a distributed sum leaves in the last bits, which the fixed-length
    steps of the count-window rules would amplify; sums differ from the exact ones by
    less than one part in 10^(digits - 1) of their scale.
    """
    s = np.asarray(s, dtype=float).tolist()
    diagonal, pairs = _places(p)
    root = [math.sqrt(s[k]) if s[k] > 0 else 0.0 for k in diagonal]
    out = []
    for v, (i, j) in zip(s, pairs, strict=True):
        scale = root[i] * root[j]
        # a number without a scale (0, or not a number) counts as 0, one beyond all scales stays
        out.append(0.0 if not scale > 0 else v if scale == math.inf else round(v, digits - 1 - math.floor(math.log10(scale))))
    return unpack(out, p)


def _key_list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def gram(df: DataFrame, keys, dim: int, x: str = "x", y: str = "y",
         wide_threshold: int = 16) -> DataFrame:
    """Per-key (n, s) where s is the packed upper triangle of sum z z^T, z = x ++ [y].

    ``dim`` is the length of ``x`` (bias included).
    """
    keys = _key_list(keys)
    p = dim + 1
    if p <= wide_threshold:
        z = [F.col(x).getItem(i) for i in range(dim)] + [F.col(y)]
        zcols = [z[i].alias(f"_z{i}") for i in range(p)]
        flat = df.select(*keys, *zcols)
        sums = [F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")) for i in range(p) for j in range(i, p)]
        return flat.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s"))
    return _gram_wide(df, keys, dim, x, y)


def _gram_wide(df: DataFrame, keys: list[str], dim: int, x: str, y: str) -> DataFrame:
    p = dim + 1
    iu = np.triu_indices(p)
    key_fields = [f for f in df.schema.fields if f.name in keys]
    out_schema = T.StructType(key_fields + [
        T.StructField("n", T.LongType(), False),
        T.StructField("s", T.ArrayType(T.DoubleType(), False), False)])

    def partial(batches):
        """One packed array per key and task: windows are contiguous, so a task holds few."""
        sums = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for key_vals, grp in pdf.groupby(keys, sort=False):
                key_vals = key_vals if isinstance(key_vals, tuple) else (key_vals,)
                zm = np.empty((len(grp), p))
                zm[:, :dim] = np.stack(grp[x].to_numpy())
                zm[:, dim] = grp[y].to_numpy(dtype=float)
                n, s = sums.get(key_vals, (0, 0.0))
                sums[key_vals] = (n + len(grp), s + (zm.T @ zm)[iu])
            if len(sums) >= KEYS_PER_PARTIAL:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    def rows(sums):
        frame = {k: [key[i] for key in sums] for i, k in enumerate(keys)}
        return pd.DataFrame({**frame, "n": [v[0] for v in sums.values()],
                             "s": [v[1] for v in sums.values()]})

    zero = F.array_repeat(F.lit(0.0), packed_len(p))
    parts = df.select(*keys, x, y).mapInPandas(partial, out_schema)
    # a key has one partial for each task that holds some of its rows
    return (parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("s").alias("parts"))
            .select(*keys, "n", F.aggregate(
                "parts", zero, lambda a, b: F.zip_with(a, b, lambda u, v: u + v)).alias("s")))


def gram_long(g: DataFrame, keys, dim: int) -> DataFrame:
    """Packed Gram -> long form (keys..., i, j, value) with 0-based z indices
    (index ``dim`` is y).  For inspection and SQL comparison."""
    keys = _key_list(keys)
    p = dim + 1
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    idx = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    zipped = F.arrays_zip(idx.alias("ij"), F.col("s").alias("v"))
    return (g.select(*keys, "n", F.explode(zipped).alias("e"))
            .select(*keys, "n", F.col("e.ij.i").alias("i"), F.col("e.ij.j").alias("j"),
                    F.col("e.v").alias("value")))


def sampled_gram(df: DataFrame, keys, dim: int, iterations: int, fraction: float,
                 sample_col: str = "seq", seed: int = 42, x: str = "x", y: str = "y",
                 hash_fn=None) -> DataFrame:
    """Grams of the per-iteration mini-batch samples (M7): keys + ``t`` (1..T).

    Row ``r`` is in iteration ``t``'s sample when ``hash(r, t) < fraction``.  The
    default hash is ``xxhash64(sample_col, t, seed)`` mapped to [0, 1).  Each row
    is expanded by T before the partial aggregation, which collapses it again
    map-side; no row is shuffled.
    """
    keys = _key_list(keys)
    if fraction >= 1.0:
        full = gram(df, keys, dim, x, y)
        return full.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    t = F.col("t")
    if hash_fn is None:
        u = (F.pmod(F.xxhash64(F.col(sample_col), t, F.lit(seed)), F.lit(1 << 30))
             / F.lit(float(1 << 30)))
    else:
        u = hash_fn(F.col(sample_col), t)
    expanded = (df.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
                .filter(u < F.lit(fraction)))
    return gram(expanded, keys + ["t"], dim, x, y)
