"""kestrel: online learning (count-window GLMs, streaming SGD, ALS retraining)
expressed as Spark DataFrame / Structured Streaming jobs."""

__version__ = "0.1.0"
