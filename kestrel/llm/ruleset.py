"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on the statistics of labelled documents.  Every path from a root to a node is a
conjunctive rule; paths that name the same region are one rule.  A logistic regression with an L1
penalty weighs the rules and leaves most at zero.  The rest are compiled into one Spark column
expression, so scoring is a projection of the stored statistics.

Whole texts are read once, for the statistics.  Growing and weighing use at most ``FIT_ROWS`` labelled
rows of a class, chosen by a hash of the row; the classes weigh the same, so the score is the probability of
label 1 between equally frequent classes.

Defined cases: a null or empty text has statistics 0 and is scored like any other; a null ``doc_id`` is scored,
is not held out and matches no label; rows that repeat are each scored and each learned from; a document labelled twice
counts twice; labels other than 0 and 1 are not learned from; without learning rows of both classes every score is
0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import crc32_mod, read_table, stored
from kestrel.llm.quality import FEATURES, measured

# The contract's held-out rows and decision.
HELD_OUT_MOD, HELD_OUT = 5, 0
THRESHOLD = 0.3

#: Learning rows of a class, at most (expected number; the rows are chosen by a hash).
FIT_ROWS = 20_000
TREES, DEPTH = 30, 3
#: Weight of the L1 penalty, and steps of the fit at most.
PENALTY, STEPS = 0.002, 100
SEED = 11

#: The statistics rules are made of, each a column.
STATISTICS = ("log_words", *FEATURES)

#: A rule: (statistic, lower bound it must exceed or None, upper bound it must not exceed or None).
Rule = tuple[tuple[str, float | None, float | None], ...]


@dataclass(frozen=True)
class Ensemble:
    """The rules with their weights; ``intercept`` alone gives 0.5."""

    intercept: float = 0.0
    rules: tuple[tuple[Rule, float], ...] = ()


def statistics_of(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""
    cols = [F.log1p("n_words").alias("log_words")] + [F.col("x")[i].alias(n) for i, n in enumerate(FEATURES)]
    return measured(docs).select("doc_id", *cols)


def learning_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out part, at most FIT_ROWS of a class: label, weight, statistics."""
    known = stats.where(crc32_mod("doc_id", HELD_OUT_MOD) != HELD_OUT).join(
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")),
        F.col("doc_id") == F.col("_id")).where("label IN (0, 1)").drop("_id")
    known = stored(known, "ruleset-labelled")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in (counts or {0: 1}).items() for v in (k, min(1.0, FIT_ROWS / n))]),
                         F.col("label"))
    draw = F.pmod(F.xxhash64("doc_id", *STATISTICS), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = stored(known.where(draw < share), "ruleset-learning")
    taken = {r["label"]: r["count"] for r in some.groupBy("label").count().collect()}
    weight = F.element_at(F.create_map(*[F.lit(v) for k in (0, 1) for v in (k, sum(taken.values()) / (2.0 * max(1, taken.get(k, 0))))]),
                          F.col("label"))
    return some.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), *STATISTICS)


_CONDITION = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(description: str) -> list[Rule]:
    """The rules of one tree, from its printed form: one for every node below the root."""
    rules, trail = [], []
    for line in description.split("\n"):
        found = _CONDITION.match(line)
        if found:
            depth = len(found[1])
            trail = [t for t in trail if t[0] < depth] + [(depth, int(found[2]), found[3], float(found[4]))]
            bounds: dict[int, tuple[float | None, float | None]] = {}
            for _, feature, sign, value in trail:
                low, high = bounds.get(feature, (None, None))
                if sign == ">":
                    low = value if low is None else max(low, value)
                else:
                    high = value if high is None else min(high, value)
                bounds[feature] = (low, high)
            rules.append(tuple((STATISTICS[f], *bounds[f]) for f in sorted(bounds)))
    return rules


def holds(rule: Rule) -> Column:
    """The rule as a column expression."""
    sides = [c for name, low, high in rule
             for c in ([F.col(name) > low] if low is not None else []) + ([F.col(name) <= high] if high is not None else [])]
    return reduce(and_, sides)


def fit(rows: DataFrame) -> Ensemble:
    """Rules from trees, weights from an L1 logistic regression over them."""
    if {r[0] for r in rows.select("label").distinct().collect()} != {0.0, 1.0}:
        return Ensemble()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.5, featureSubsetStrategy="onethird",
                                    weightCol="weight", seed=SEED).fit(
        rows.select("label", "weight", array_to_vector(F.array(*STATISTICS)).alias("features")))
    rules = sorted({r for tree in forest.trees for r in paths(tree.toDebugString)}, key=repr)
    if not rules:
        return Ensemble()
    facts = rows.select("label", "weight", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=STEPS, weightCol="weight").fit(facts)
    weights = zip(rules, model.coefficients.toArray().tolist(), strict=True)
    return Ensemble(float(model.intercept), tuple((r, w) for r, w in weights if w != 0.0))


def score(ensemble: Ensemble) -> Column:
    """The ensemble as one column expression over the statistics: probability of label 1."""
    total = F.lit(ensemble.intercept)
    for rule, weight in ensemble.rules:
        total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = stored(statistics_of(docs), "ruleset-statistics")
    ensemble = fit(learning_rows(stats, labels))
    held_out = F.coalesce(crc32_mod("doc_id", HELD_OUT_MOD) == HELD_OUT, F.lit(False))
    return stats.select("doc_id", held_out.alias("held_out"), score(ensemble).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_ruleset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document scored for quality."""
    return classified(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
