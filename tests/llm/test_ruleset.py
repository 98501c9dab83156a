"""Sparse rule ensemble: paths, compiled rules, the L1 optimum, held-out accuracy and odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kestrel.llm import ruleset as R

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = R.stored(R.learning_rows(R.stored(R.statistics_of(docs), "t"), labels), "t")
    return rows, R.fit(rows)


def holds(rule, row):
    return all((low is None or row[name] > low) and (high is None or row[name] <= high) for name, low, high in rule)


def test_paths_partition_the_rows_as_the_tree_does(learned):
    rows, _ = learned
    data = rows.withColumn("features", array_to_vector(F.array(*R.STATISTICS)))
    tree = DecisionTreeClassifier(maxDepth=3, weightCol="weight").fit(data)
    rules = R.paths(tree.toDebugString)
    leaves = [r for r in rules if not any(a != r and set(region(r)) < set(region(a)) for a in rules)]
    assert len(rules) == tree.numNodes - 1 and leaves
    for row in data.collect():
        # a row follows one path: the rules it meets are that path's, one for each depth
        met = [r for r in rules if holds(r, row)]
        assert 1 <= len(met) <= 3


def region(rule):
    return [(n, s, v) for n, low, high in rule for s, v in ((">", low), ("<=", high)) if v is not None]


def test_printed_tree_to_rules():
    text = "\n".join(["Tree", "  If (feature 0 <= 1.5)", "   If (feature 0 <= 0.5)", "    Predict: 0.0",
                      "   Else (feature 0 > 0.5)", "    Predict: 1.0", "  Else (feature 0 > 1.5)", "   Predict: 1.0"])
    s = R.STATISTICS[0]
    assert R.paths(text) == [((s, None, 1.5),), ((s, None, 0.5),), ((s, 0.5, 1.5),), ((s, 1.5, None),)]


def test_compiled_score_equals_the_rules_by_hand(learned):
    rows, model = learned
    assert 0 < len(model.rules) < 200
    for row in rows.withColumn("score", R.score(model)).collect():
        total = model.intercept + sum(w for r, w in model.rules if holds(r, row))
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-12)


def test_weights_are_at_the_lasso_optimum(learned):
    """At the optimum a rule's gradient is the penalty (in units of its spread) where its weight is not zero."""
    rows, model = learned
    data = rows.toPandas()
    y, weight = data["label"].to_numpy(), data["weight"].to_numpy()
    facts = np.array([[float(holds(r, row)) for r, _ in model.rules] for row in data.to_dict("records")])
    p = 1 / (1 + np.exp(-(model.intercept + facts @ np.array([w for _, w in model.rules]))))
    share = weight / weight.sum()
    mean = share @ facts
    spread = np.sqrt(share @ (facts - mean) ** 2 * len(y) / (len(y) - 1))
    gradient = (share * (p - y)) @ facts / spread
    assert abs(share @ (p - y)) < 2e-3
    for g, (_, w) in zip(gradient, model.rules, strict=True):
        assert g == pytest.approx(-R.PENALTY * np.sign(w), abs=1e-3)


def test_held_out_quality(spark):
    out = R.op11_ruleset(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert out.score.between(0, 1).all() and ((out.score >= 0.3).astype(int) == out.predicted).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out, strict=True))
    held = out[out.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.97
    assert (held[held.quality == 0].predicted == 0).mean() > 0.9


def test_odd_rows(spark, make, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, 1, 0), (None, 1, 0), (9, None, 0), (11, 5, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = make([(i, ("good words of plain text here " * 9) if i % 2 else "### $$$ ||| x " * 20) for i in range(20, 60)])
    out = R.classified(docs.unionByName(odd), labels)
    rows = out.collect()
    assert len(rows) == docs.count() + odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    by = {r["doc_id"]: r["predicted"] for r in rows}
    assert all(by[i] == i % 2 for i in range(20, 60))
    assert {r["score"] for r in R.classified(odd, labels.limit(0)).collect()} == {0.5}
    assert R.classified(none, labels).collect() == []


def test_learning_rows_are_bounded_by_class(spark, monkeypatch):
    monkeypatch.setattr(R, "FIT_ROWS", 50)
    stats = spark.range(2000).select(F.col("id").alias("doc_id"), *[F.rand(i).alias(n) for i, n in enumerate(R.STATISTICS)])
    labels = stats.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality"))
    rows = R.learning_rows(stats, labels)
    counts = {r["label"]: (r["count"], r["w"]) for r in rows.groupBy("label").agg(F.count("*").alias("count"), F.sum("weight").alias("w")).collect()}
    assert all(20 < n < 100 for n, _ in counts.values()) and counts[0.0][1] == pytest.approx(counts[1.0][1])
    assert rows.exceptAll(R.learning_rows(stats, labels)).count() == 0
