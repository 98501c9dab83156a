"""Quality rules: an isolation forest on rule statistics.

One pass over the whole texts gives every document its rule statistics.  The
forest's trees part the value ranges of the statistics at random; a document whose
statistics are unusual falls into a sparse cell after few splits, so its mean path is
short.  Trees are drawn from labelled good rows (a bounded, documented sample); value ranges cover
all documents, and the score below which a document goes is calibrated from all labelled rows.

Defined cases: a null or empty text has no words, all counts 0 and fails the base rules;
a null ``doc_id`` is scored like any other but matches no label; rows that repeat
are each scored; a document labelled twice counts twice; without labelled rows of both
kinds there is no calibration and the base rules alone decide; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import per_batch, read_table, stored, words_of

# The contract's base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: Bounded sample of labelled good rows that the trees are drawn from.
SAMPLE_ROWS = 5_000
TREES = 100
ROWS_PER_TREE = 256
MAX_DEPTH = 20
SEED = 8
#: Scores are calibrated on a grid of this many steps.
GRID = 1000
#: A rejected good row costs as much as this many missed bad rows (shares of their class).
GOOD_COST = 4.0

FEATURES = ("symbols_per_word", "upper_share", "mark_share", "repeat_share", "dup_line_share",
            "mean_word", "log_line_words", "distinct_share")
_BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = _BASE + ", x array<double>"

_WHITE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGITS)


def _count(data: bytes, which: bytes) -> int:
    return len(data) - len(data.translate(None, which))


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words in 3-word windows that occur twice or more, number of distinct words)."""
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    if len(w) < 4:
        return 0, len(ids)
    # pairs are renumbered before the third word is added, so keys stay below 2**63
    _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = times[window] > 1
    covered = np.zeros(len(w), bool)
    for shift in range(3):
        covered[shift:len(w) - 2 + shift] |= twice
    return int(covered.sum()), len(ids)


def statistics(text: str | None) -> tuple:
    """The five base counts and the forest's features of one whole text."""
    text = text or ""
    data = text.encode()
    words = words_of(text)
    n = len(words)
    chars = len(text) - _count(data, _WHITE)
    symbols = _count(data, SYMBOLS)
    seen, dup, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip(_WHITE):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat, distinct = repeated_words(words)
    upper, marks = _count(data, _UPPER), _count(data, _MARKS)
    letters = max(1, chars - marks)
    features = [symbols / max(1, n), upper / letters, marks / max(1, chars), repeat / max(1, n),
                dup / max(1, lines), min(chars / max(1, n), 50.0), math.log1p(n / max(1, lines)),
                math.log1p(distinct) / math.log1p(max(1, n))]
    return n, chars, symbols, dup, repeat, features


def measured(docs: DataFrame) -> DataFrame:
    """Rule statistics of every document (``SCHEMA``)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array(c, pa.int64()) for c in cols[:5]]
            + [pa.array(cols[5], pa.list_(pa.float64()))],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"])
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


@dataclass
class Forest:
    """Trees as flat arrays: split feature (-1: leaf), split value, children, path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    roots: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score 2 ** -(mean path / expected path): near 1 is unusual."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(MAX_DEPTH):
                f = self.feature[node]
                go_left = x[rows, np.maximum(f, 0)] < self.value[node]
                node = np.where(f < 0, node, np.where(go_left, self.left[node], self.right[node]))
            total += self.path[node]
        return 2.0 ** (-total / len(self.roots) / expected_path(ROWS_PER_TREE))


def expected_path(n: int) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow_forest(sample: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = SEED) -> Forest:
    """Trees of random splits; a node splits its own part of the value range, so ranges
    without sample rows become short paths."""
    rng = np.random.default_rng(seed)
    feature, value, left, right, path, roots = [], [], [], [], [], []

    def grow(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
        me = len(feature)
        for store, v in ((feature, -1), (value, 0.0), (left, me), (right, me),
                         (path, depth + expected_path(len(rows)))):
            store.append(v)
        usable = np.flatnonzero(hi > lo)
        if len(rows) > 1 and depth < MAX_DEPTH and len(usable):
            f = int(rng.choice(usable))
            cut = float(rng.uniform(lo[f], hi[f]))
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = cut
            feature[me], value[me] = f, cut
            left[me] = grow(rows[rows[:, f] < cut], lo, below, depth + 1)
            right[me] = grow(rows[rows[:, f] >= cut], above, hi, depth + 1)
        return me

    for _ in range(TREES):
        take = rng.choice(len(sample), min(ROWS_PER_TREE, len(sample)), replace=False)
        roots.append(grow(sample[take], low, high, 0))
    return Forest(np.array(feature), np.array(value), np.array(left), np.array(right),
                  np.array(path), np.array(roots))


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """The forest and the score above which a document goes; None without both labels."""
    known = stats.join(labels.select(F.col("doc_id").alias("_id"), "quality"), F.col("doc_id") == F.col("_id"))
    known = stored(known.where("quality IN (0, 1) AND n_words > 0").select("doc_id", "quality", "x"), "labelled")
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if set(counts) != {0, 1}:
        return None
    # rows in the order of a hash: a bounded sample that does not depend on the layout
    top = (known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
           .select("x").toPandas())
    ends = stats.where("n_words > 0").agg(*[F.min(F.col("x")[i]) for i in range(len(FEATURES))],
                                          *[F.max(F.col("x")[i]) for i in range(len(FEATURES))]).first()
    k = len(FEATURES)
    forest = grow_forest(np.stack(top["x"].to_numpy()), np.array(ends[:k]), np.array(ends[k:]))
    step = F.floor(F.col("score") * GRID).cast("int")
    hist = scored(known, forest).groupBy(step.alias("step")).agg(
        F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good")).toPandas().sort_values(
        "step", ascending=False)
    gain = hist["bad"].cumsum() / counts[0] - GOOD_COST * hist["good"].cumsum() / counts[1]
    best = int(gain.to_numpy().argmax())
    return forest, (int(hist["step"].iloc[best]) / GRID if gain.iloc[best] > 0 else math.inf)


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """Add the anomaly score to rows that hold the feature column x."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
        score = shared.value.score(flat.reshape(-1, len(FEATURES)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)],
                                          names=[*batch.schema.names, "score"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    return per_batch(stats, run, fields + ", score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: the base counts, base_failed, anomaly score and kept."""
    stats = stored(measured(docs), "rule-statistics")
    model = fit(stats, labels)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = stats.withColumn("base_failed", failed)
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~failed).drop("x")
    forest, cut = model
    return (scored(rows, forest).withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(cut)))
            .drop("x"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, columns as they came.

    Every row is judged by its own text where it is read, so no text is shuffled.
    """
    stats = stored(measured(docs), "rule-statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))
    text_at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in batch.column(text_at).to_pylist()]
        keep = np.array([not (r[0] < MIN_WORDS or 100 * r[4] > MAX_REPEAT_PERCENT * r[0]) for r in rows])
        if shared.value is not None:
            forest, cut = shared.value
            keep &= forest.score(np.array([r[5] for r in rows])) < cut
        return batch.filter(pa.array(keep))
    return per_batch(docs, run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document judged."""
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score")
