"""Vector arithmetic on ARRAY<DOUBLE> columns with higher-order functions.

Everything stays inside Catalyst expressions, so scoring needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(x, w) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(_col(x), _col(w), lambda a, b: a * b),
                       F.lit(0.0), lambda acc, v: acc + v)


def decision(score) -> Column:
    """Class decision (B10): +1 when the score is strictly positive, else -1."""
    return F.when(_col(score) > 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def huber_sign(w, epsilon: float) -> Column:
    """Huber-smoothed sign per weight (B11): 1 above eps, -1 below -eps, w/eps between."""
    return F.transform(_col(w), lambda v: F.when(v > epsilon, F.lit(1.0))
                       .when(v < -epsilon, F.lit(-1.0))
                       .otherwise(v / F.lit(float(epsilon))))
