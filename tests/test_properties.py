"""Properties: any micro-batch cut gives the batch model; the ordinal is a dense rank."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrel.operators.glm import train_count_windows
from kestrel.operators.ordinal import with_ordinal
from kestrel.operators.rules import NormalizedGD
from kestrel.sources.tables import events_points
from kestrel.streaming.glm_stream import StreamingGLM
from kestrel.streaming.modelstore import ModelStore

SF = "/root/testdata/sf0.001"
RULE = NormalizedGD(step=0.05, iterations=30, reg=0.01)
SLOW = settings(max_examples=4, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(cuts=st.lists(st.integers(min_value=1, max_value=399), min_size=1, max_size=3, unique=True))
def test_any_cut_gives_the_batch_model(spark, scratch, cuts):
    pts = events_points(spark, SF).filter("NOT holdout AND seq < 400").select("seq", "y", "x")
    want = [r["weights"] for r in train_count_windows(pts, RULE, 3, 40).versions()
            .filter("version >= 0").orderBy("version").collect()]
    store = ModelStore(spark, f"{scratch}/m-{'-'.join(map(str, cuts))}", "p")
    glm = StreamingGLM(store, RULE, 3, w0=[0.0] * 3, window=40)
    bounds = [0] + sorted(cuts) + [400]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        glm.process_batch(pts.filter((F.col("seq") >= lo) & (F.col("seq") < hi)), i)
    got = [r["weights"] for r in store.versions().filter("version >= 0")
           .orderBy("version").collect()]
    assert got == want


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.integers(min_value=-10**12, max_value=10**12), min_size=1,
                     max_size=300, unique=True),
       buckets=st.integers(min_value=1, max_value=12))
def test_ordinal_is_dense_rank(spark, keys, buckets):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["ordinal"] for r in with_ordinal(df, "k", num_buckets=buckets).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert np.array_equal(sorted(got.values()), np.arange(len(keys)))
