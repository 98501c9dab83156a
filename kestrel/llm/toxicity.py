"""Toxicity by class-conditional Kneser-Ney models over words.

A document is scored by the log-likelihood difference of its distinct words under a toxic and an ordinary model,
divided by their number (plus PRIOR_WORDS, which holds back texts of a few words).  In the model of a class

    P(word) = (own count - DISCOUNT, if the word is kept) / own total + freed share * shared(word)

* a word is kept if its documents differ between the classes by more than chance (likelihood ratio of at least
  MIN_G) and by a factor of MIN_RATIO.  The counts of all other words are discounted whole: both models then judge them by the same shared
  counts, and they tell nothing but the classes' freed shares.  That constant, which an unknown word gets too,
  is left out, so any spelling model below ``shared`` would cancel and there is none;
* the own count of a kept word is the number of the class's documents that hold it, at most the number of different
  words seen before it there (the Kneser-Ney continuation count), so copies of one document do not add up; the total
  is of documents, and what the copies lose is freed too;
* ``shared`` has the same counts over both classes, discounted down to equal parts for unknown words.

The difference is mapped to 0..1 by a logistic curve fitted on a part of the learning rows that the counts did not
see.  Word pairs are not modelled as expressions of their own: see README for the measurement.

Defined cases: a null or empty text has no words and scores what the curve gives at zero; without
learning rows of both classes every score is 0.5; a document labelled twice is learned twice; a null
``doc_id`` matches no label and is never held out; rows that repeat are each scored; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import crc32_mod, per_batch, read_table, stored
from kestrel.llm.language import held_out
from kestrel.llm.wordscores import coded_words

DISCOUNT = 0.75
PRIOR_WORDS = 30.0
#: 16 is exceeded by chance by one word in 16,000.
MIN_G = 16.0
#: With enough documents every difference exceeds chance; a smaller one than this says nothing of a document.
MIN_RATIO = 2.0
HELD_OUT_MOD, HELD_OUT = 3, 1
#: A fifth of the learning rows is kept from the counts, for the logistic curve.
CURVE_MOD, CURVE = 5, 0
#: The curve sees differences per hundred words, in a histogram with this many steps to a unit.
PER_WORDS = 100.0
GRID = 20
MAX_SCORE = 500.0
THRESHOLD = 0.7

#: Stands before a text's first word; no word is empty.
START = ""


def clean(texts: pa.Array) -> pa.Array:
    """Lower case, with letters and digits only, parted by spaces."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " ")


def tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, document of every word in a row, index of every word)."""
    words, index, bounds = coded_words(clean(texts))
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    real = np.array([w != "" for w in words], bool)[index] if words else np.zeros(0, bool)
    return words, doc[real], index[real].astype(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, ordinary, toxic): the documents of each class that hold a word, over all rows of (toxic, text).

    Documents are counted, not occurrences, so one that repeats a word tells no more about it than another.
    The table grows with the learning texts.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, doc, index = tokens(batch.column(1))
        v = max(1, len(words))
        doc, index = np.divmod(np.unique(doc * v + index), v)
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)[doc]
        n = [pa.array(np.bincount(index[toxic == c], minlength=len(words)), pa.int64()) for c in (False, True)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *n], names=["word", "ordinary", "toxic"])
    return (per_batch(rows.select("toxic", "text"), run, "word string, ordinary long, toxic long")
            .where("word != ''").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))


def continuation_counts(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(word, before0, before1, before): different words that stand before a word of ``kept``, by class and in all.

    The pairs meet ``kept`` (few words, broadcast by its stored size) before they are shuffled.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, doc, index = tokens(batch.column(1))
        names, v = pa.array([*words, START], pa.string()), len(words) + 1
        first = np.r_[True, doc[1:] != doc[:-1]][:len(doc)]
        before = np.where(first, v - 1, np.r_[0, index[:-1]][:len(doc)])
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        key, toxic = np.divmod(np.unique((before * v + index) * 2 + toxic), 2)
        return pa.RecordBatch.from_arrays([names.take(pa.array(key // v)), names.take(pa.array(key % v)), pa.array(toxic)],
                                          names=["before", "word", "toxic"])
    pairs = (per_batch(rows.select("toxic", "text"), run, "before string, word string, toxic long")
             .join(kept.select("word"), "word").groupBy("word", "before")
             .agg(F.min("toxic").alias("least"), F.max("toxic").alias("most")))
    return pairs.groupBy("word").agg(F.sum((F.col("least") == 0).cast("long")).alias("before0"),
                                     F.sum("most").alias("before1"), F.count(F.lit(1)).alias("before"))


def differs(n0: int, n1: int) -> Column:
    """Whether a word's share of n0 ordinary documents differs from its share of n1 toxic ones by more than chance and
    by a factor of MIN_RATIO or more."""
    share = (F.col("ordinary") + F.col("toxic")) / (n0 + n1)

    def part(k: Column, n: int) -> Column:
        # a word's documents and those without it
        return (F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
                + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0))
    rates = F.col("ordinary") / n0, F.col("toxic") / n1
    return ((2 * (part(F.col("ordinary"), n0) + part(F.col("toxic"), n1)) >= MIN_G)
            & (F.greatest(*rates) >= MIN_RATIO * F.least(*rates)))


def word_weights(words: DataFrame, kept: DataFrame, n0: int, n1: int) -> DataFrame:
    """(word, weight): log ratio of the kept words' probabilities in the two models, against an unknown word's.

    ``words``: ``word_counts`` over ``n0`` ordinary and ``n1`` toxic documents; ``kept``: those that differ, with
    their ``continuation_counts``.
    """
    own = {"own0": F.least("ordinary", "before0"), "own1": F.least("toxic", "before1")}
    left = {k: F.greatest(v - DISCOUNT, F.lit(0.0)) for k, v in own.items()}
    s = words.agg(F.sum("ordinary").alias("own0"), F.sum("toxic").alias("own1"), F.count(F.lit(1)).alias("kinds")).first()
    both = F.least(F.col("ordinary") + F.col("toxic"), F.col("before"))
    of_kept = kept.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in left.items()],
                       F.coalesce(F.sum(F.col("ordinary") + F.col("toxic") - both), F.lit(0)).alias("copies")).first()
    free = {k: 1 - of_kept[k] / max(s[k], 1) for k in left}
    shared = ((F.greatest(both - DISCOUNT, F.lit(0.0)) + DISCOUNT * s["kinds"] / (s["kinds"] + 1))
              / (s["own0"] + s["own1"] - of_kept["copies"]))
    p = {k: left[k] / max(s[k], 1) + free[k] * shared for k in left}
    return kept.select("word", (F.log(p["own1"] / p["own0"]) - float(np.log(free["own1"] / free["own0"]))).alias("weight"))


def differences(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """Add x, the length-normalised log-likelihood difference per PER_WORDS words, in place of the text.

    ``weights`` holds only words that differ by more than chance, so Catalyst broadcasts it by its stored size; were
    it large, the join would shuffle.
    """
    at, names = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, doc, index = tokens(batch.column(at))
        v = max(1, len(words))
        doc, index = np.divmod(np.unique(doc * v + index), v)
        places = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(places), pa.array(words, pa.string()).take(pa.array(index)))
        return pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(np.diff(places).astype(np.int64)), held],
            names=[*names, "n", "words"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    rows = per_batch(docs, run, fields + ", n long, words array<string>").withColumn("_row", F.monotonically_increasing_id())
    held = rows.select("_row", *names, "n", F.explode_outer("words").alias("word")).join(weights, "word", "left")
    x = F.coalesce(F.sum("weight"), F.lit(0.0)) * PER_WORDS / (F.col("n") + PRIOR_WORDS)
    return held.groupBy("_row", *names, "n").agg(x.alias("x")).drop("_row", "n")


def fit_curve(x: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic (slope, offset) by Newton steps on histogram counts, with a small ridge."""
    at, n = np.stack([x, np.ones_like(x)]), ordinary + toxic

    def loss(c: np.ndarray) -> float:
        z = c @ at
        return float((n * np.logaddexp(0, z) - toxic * z).sum() + 5e-4 * c @ c)
    c = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(c @ at, -30, 30)))
        g = at @ (toxic - n * p) - 1e-3 * c
        step = np.linalg.solve((at * (n * p * (1 - p))) @ at.T + 1e-3 * np.eye(2), g)
        # a full step can overshoot where the curve is flat
        while loss(c + step) > loss(c) and np.abs(step).max() >= 1e-9:
            step = step / 2
        c = c + step
        if np.abs(step).max() < 1e-9:
            break
    return c


def score(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score.  ``labelled``: rows of (doc_id, text, toxic)."""
    rows = stored(labelled.where("toxic IN (0, 1)").select("doc_id", "text", "toxic"), "labelled")
    for_curve = F.coalesce(crc32_mod("doc_id", CURVE_MOD) == CURVE, F.lit(False))
    learning = rows.where(~for_curve)
    sizes = learning.agg(F.sum((F.col("toxic") == 0).cast("long")).alias("n0"), F.sum((F.col("toxic") == 1).cast("long")).alias("n1")).first()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not sizes["n0"] or not sizes["n1"]:
        return plain.select("doc_id", F.lit(0.5).alias("score"))
    words = stored(word_counts(learning), "words")
    if words.isEmpty():
        return plain.select("doc_id", F.lit(0.5).alias("score"))
    kept = stored(words.where(differs(*sizes)), "kept")
    kept = stored(kept.join(continuation_counts(learning, kept), "word"), "counted")
    weights = stored(word_weights(words, kept, *sizes), "weights")
    step = F.round(F.least(F.greatest("x", F.lit(-MAX_SCORE)), F.lit(MAX_SCORE)) * GRID).cast("int").alias("x")
    hist = (differences(rows.where(for_curve).select("toxic", "text"), weights)
            .groupBy(step).agg(F.sum(1 - F.col("toxic")).alias("ordinary"), F.sum("toxic").alias("toxic"))
            .toPandas())
    if hist["toxic"].sum() == 0 or hist["ordinary"].sum() == 0:
        slope, offset = 1.0, 0.0
    else:
        slope, offset = map(float, fit_curve(hist["x"].to_numpy() / GRID, *(hist[c].to_numpy(float) for c in ("ordinary", "toxic"))))
    z = F.col("x") * F.lit(slope) + F.lit(offset)
    return differences(plain, weights).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's toxicity."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = held_out(HELD_OUT_MOD, HELD_OUT)
    # labels grow with the documents, so the join shuffles at every size
    labelled = docs.where(~out).join(labels.where(~out).hint("merge"), "doc_id")
    return score(docs, labelled).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
