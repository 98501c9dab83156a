"""Chainable model builders for streaming SGD.

Settings chain, then any number of streams may train the model in turn and any
number may be scored with it:

    model = streaming_ridge(spark, reg=0.01).set_step_size(0.2)
    model.set_initial_weights([0.0] * 4)
    morning = model.train_on(first_stream, "<checkpoint a>")
    evening = model.train_on(second_stream, "<checkpoint b>")
    scored = model.predict_on(third_stream, "<predictions>", "<checkpoint c>")

``set_initial_weights`` resets the model (a fresh version history);
``resume`` takes up a stored one.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kestrel.operators.rules import SGD, SGD_LASSO_REG
from kestrel.session import scratch_path
from kestrel.streaming.glm_stream import StreamingGLM, predict_on, stream_name
from kestrel.streaming.modelstore import ModelStore


class StreamingSGDModel:
    def __init__(self, spark: SparkSession, rule: SGD, model_root: str | None = None):
        self.spark = spark
        self.rule = rule
        self.root = model_root or scratch_path(spark, "models")
        self.w0 = None
        self.store = None

    # ---- parameters ------------------------------------------------------------
    def set_step_size(self, step: float) -> "StreamingSGDModel":
        self.rule = replace(self.rule, step=float(step))
        return self

    def set_num_iterations(self, n: int) -> "StreamingSGDModel":
        self.rule = replace(self.rule, iterations=int(n))
        return self

    def set_mini_batch_fraction(self, fraction: float) -> "StreamingSGDModel":
        self.rule = replace(self.rule, fraction=float(fraction))
        return self

    def set_reg_param(self, reg: float) -> "StreamingSGDModel":
        self.rule = replace(self.rule, reg=float(reg))
        return self

    def set_initial_weights(self, weights, model_id: str | None = None) -> "StreamingSGDModel":
        """Reset the model: a new version history whose version -1 is ``weights``."""
        return self.resume(model_id or uuid.uuid4().hex, weights)

    def resume(self, model_id: str, weights=None) -> "StreamingSGDModel":
        """Continue the model of this id below the model root; ``weights`` start it if there is none."""
        self.store = ModelStore(self.spark, self.root, model_id)
        self.w0 = np.asarray(self.store.start(weights).weights if weights is None else weights, dtype=float)
        self.store.start(self.w0)
        return self

    # ---- use -----------------------------------------------------------------
    def _require(self):
        if self.w0 is None or self.store is None:
            raise ValueError("initial weights must be set before training or prediction")

    def trainer(self, **kw) -> StreamingGLM:
        self._require()
        return StreamingGLM(self.store, self.rule, len(self.w0), w0=self.w0, **kw)

    def train_on(self, stream: DataFrame, checkpoint_location: str, **kw):
        """Train on a stream; a second call trains the same model on a second one, in turn."""
        trigger = {k: kw.pop(k) for k in ("processing_time", "available_now") if k in kw}
        kw.setdefault("stream_id", stream_name(checkpoint_location))
        return self.trainer(**kw).train_on(stream, checkpoint_location, **trigger)

    def predict_on(self, stream: DataFrame, sink_path: str, checkpoint_location: str, **kw):
        self._require()
        return predict_on(stream, self.store, sink_path, checkpoint_location, **kw)

    def latest_model(self):
        self._require()
        return self.trainer().latest_weights()


def streaming_linear_regression(spark: SparkSession, **kw) -> StreamingSGDModel:
    return StreamingSGDModel(spark, SGD(updater="none"), **kw)


def streaming_lasso(spark: SparkSession, **kw) -> StreamingSGDModel:
    return StreamingSGDModel(spark, SGD(updater="l1", reg=SGD_LASSO_REG), **kw)


def streaming_ridge(spark: SparkSession, reg: float, **kw) -> StreamingSGDModel:
    return StreamingSGDModel(spark, SGD(updater="l2", reg=reg), **kw)
