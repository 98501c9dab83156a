"""Ordinal, count windows, sums of products, scoring, metrics."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kestrel.operators.gram import gram, sampled_gram, unpack
from kestrel.operators.metrics import error_trace
from kestrel.operators.ordinal import count_windows, with_ordinal


def test_ordinal_dense_rank_on_sparse_keys(spark):
    rng = np.random.default_rng(3)
    keys = rng.choice(10**9, size=3000, replace=False)
    df = spark.createDataFrame(pd.DataFrame({"k": keys.astype("int64")}))
    for buckets in (1, 3, 16):
        got = {r["k"]: r["ordinal"] for r in with_ordinal(df, "k", num_buckets=buckets).collect()}
        want = {int(k): i for i, k in enumerate(sorted(keys))}
        assert got == want


def test_ordinal_tie_break_on_second_column(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (0, 5)], "a long, b long")
    got = sorted((r["a"], r["b"], r["ordinal"]) for r in with_ordinal(df, ["a", "b"]).collect())
    assert got == [(0, 5, 0), (1, 1, 1), (1, 2, 2)]


def test_count_windows_continue_open_window(spark):
    df = spark.range(100, 117).withColumnRenamed("id", "seq")
    framed = count_windows(df, "seq", 5, n_seen=13)
    rows = sorted((r["seq"], r["ordinal"], r["block"], r["closed"]) for r in framed.collect())
    assert rows[0] == (100, 13, 2, True)      # completes the open window 2 (rows 10..14)
    assert rows[-1] == (116, 29, 5, True)
    short = count_windows(df.filter("seq < 115"), "seq", 5, n_seen=13)
    assert sorted((r["ordinal"], r["closed"]) for r in short.collect())[-1] == (27, False)


def test_gram_narrow_and_wide_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    n, d = 240, 20
    X = rng.normal(size=(n, d))
    y = rng.normal(size=n)
    block = np.arange(n) // 50
    rows = [(int(b), [float(v) for v in xr], float(t)) for b, xr, t in zip(block, X, y)]
    df = spark.createDataFrame(rows, "block long, x array<double>, y double")
    wide = {r["block"]: r for r in gram(df, "block", d, wide_threshold=8).collect()}
    narrow = {r["block"]: r for r in gram(df, "block", d, wide_threshold=64).collect()}
    for b in range(5):
        m = block == b
        G, c, yy = unpack(np.array(wide[b]["s"]), d + 1)
        assert np.allclose(G, X[m].T @ X[m]) and np.allclose(c, X[m].T @ y[m])
        assert np.allclose(yy, y[m] @ y[m])
        assert wide[b]["n"] == m.sum() == narrow[b]["n"]
        assert np.allclose(wide[b]["s"], narrow[b]["s"])


def test_sampled_gram_fraction(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("seq"), F.lit(0).cast("long").alias("day"),
                                     F.array(F.lit(1.0)).alias("x"), F.lit(1.0).alias("y"))
    g = sampled_gram(df, "day", 1, 4, 0.25).collect()
    assert sorted(r["t"] for r in g) == [1, 2, 3, 4]
    for r in g:
        assert 350 < r["n"] < 650


def test_error_trace_counts(spark):
    df = spark.createDataFrame([([1.0, 1.0], 1.0), ([-1.0, 1.0], -1.0), ([2.0, 1.0], -1.0)],
                               "x array<double>, y double")
    out = {r["version"]: (r["n_test"], r["n_err"]) for r in
           error_trace(df, spark.createDataFrame(
               [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.0])], "version long, weights array<double>"),
               max_weights=2).collect()}
    assert out == {0: (3, 1), 1: (3, 1), 2: (3, 2)}


def test_set_summary_and_line(spark):
    from kestrel.operators.als import union_history
    from kestrel.operators.metrics import set_summary, summary_line
    a = spark.createDataFrame([(1, 10, 3.0), (2, 10, 4.0)], "user int, item int, rating double")
    b = spark.createDataFrame([(1, 10, 3.0)], "user int, item int, rating double")
    h = union_history(a, b)
    r = set_summary(h).first()
    assert (r["n_ratings"], r["n_users"], r["n_items"]) == (3, 2, 1)
    assert summary_line(r) == "Initial set got 3 ratings from 2 users on 1 movies."
    assert set_summary(h, approx=True).first()["n_users"] == 2


def test_bucket_key_spreads_ties_of_leading_column(spark):
    df = spark.range(0, 500).select(F.lit(0).cast("long").alias("f"), F.col("id").alias("pos"))
    key = F.col("f").cast("double") * F.lit(float(2 ** 54)) + F.col("pos").cast("double")
    out = with_ordinal(df, ["f", "pos"], num_buckets=5, bucket_key=key)
    assert {r["pos"]: r["ordinal"] for r in out.collect()} == {i: i for i in range(500)}
