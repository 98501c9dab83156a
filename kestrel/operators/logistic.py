"""Online logistic regression over count windows (M3).

The logistic gradient is not quadratic, so a window cannot be summarised by sums of products; each of its T
iterations needs the window's rows.  Closed windows go through ``operators.relay``: they are folded on the executors in one
job, and only weights leave it.  A window of more than ``rows_per_task`` rows never meets in one task; each of its iterations is
a distributed sum, and a job takes the sums of many iterations.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.ordinal import count_windows
from kestrel.operators.relay import ROWS_PER_TASK, fold_points
from kestrel.operators.rules import LogisticGD
from kestrel.session import scratch_path
from kestrel.streaming.modelstore import ModelStore


def train_logistic_windows(points: DataFrame, dim: int, window: int,
                           rule: LogisticGD | None = None, order_col="seq", w0=None,
                           rows_per_task: int = ROWS_PER_TASK, dense: bool = False,
                           store: ModelStore | None = None,
                           model_id: str | None = None) -> ModelStore:
    """Version k is the model after closed window k (version -1 = ``w0``)."""
    spark = points.sparkSession
    rule = rule or LogisticGD()
    store = store or ModelStore(spark, scratch_path(spark, "models"), model_id or uuid.uuid4().hex)
    w = np.zeros(dim) if w0 is None else np.asarray(w0, dtype=float)
    framed = count_windows(points, order_col, window, dense=dense).filter(F.col("closed"))
    store.write_folded(w, fold_points(framed, w, rule, dim, window, points.count() // window,
                                      rows_per_task=rows_per_task), window)
    return store
