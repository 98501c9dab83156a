"""Mixing sources to target weights.

Words per source are summed (partial sums map-side, so a source with a third of
all rows is one row per task after the combine).  Targets share ``budget`` times
all words by the sources' weights; a target stops at ``max_rate`` times its
source's words and what is over is shared again.  A source's repetition rate is
target / words; every document is taken ``floor(rate)`` times, plus once more
when its hash draw is below the fraction.  Draws depend on seed and ``doc_id`` (where it is null, on the text)
only, so reruns and recomputed partitions agree.

Defined cases: a null text has size 0; the null source is a source of its own,
after all others; a source without words has target 0 and its documents are
taken 0 times; rows that repeat a ``doc_id`` share its draw, as do rows without one that repeat a text; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import WORD, global_rank, read_table, stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_RATE = 2.0
SEED = "mix-1"
#: Twelve hex digits of the md5 make the draw: a number of 48 bits.
DRAW_RANGE = float(1 << 48)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key() -> Column:
    """What a document's draw hangs on: its id, or else its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def draw(name: Column, seed: str) -> Column:
    key = F.concat(F.lit(seed + ":"), name)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(DRAW_RANGE)


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
                   max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    The level ``share`` (words per unit of weight) is found by rounds over two
    sums: sources at their limit keep it, the others split what is left.  Only
    these sums reach the driver, never the list of sources.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(stats, [F.col("source").asc_nulls_last()], "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = stored(ranked.select(
        "source", "source_size",
        F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(max_rate)).alias("limit")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share, at_limit = 0.0, -1
    while True:
        full = F.col("limit") <= F.col("weight") * F.lit(share)
        n_full, kept, open_weight = table.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n_full == at_limit or not open_weight:
            break
        at_limit, share = n_full, (budget * total - kept) / open_weight
    return table.select("source", "source_size", "weight",
                        F.least(F.col("limit"), F.col("weight") * F.lit(share)).alias("target"))


def with_copies(rows: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """Add source_size, target, rate and copies to rows of (_draw: see ``draw_key``, source, ...).

    The join is left to Catalyst: it broadcasts the sources only when they are
    few, and splits a skewed source otherwise.
    """
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = rows.join(t, rows["source"].eqNullSafe(t["_source"])).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    return (joined.withColumn("rate", rate)
            .withColumn("copies", (whole + (draw(F.col("_draw"), seed) < F.col("rate") - whole)
                                   .cast("int")).cast("int"))
            .drop("_draw"))


def doc_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw_key().alias("_draw"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE,
        seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sizes = stored(doc_sizes(docs), "sizes")
    return (with_copies(sizes, source_targets(sizes, weights, budget, max_rate), seed)
            .withColumn("taken", F.col("copies") * F.col("size")))


def emit_mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
               max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, columns as they came."""
    targets = source_targets(doc_sizes(docs), weights, budget, max_rate)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source",
                      draw_key().alias("_draw"))
    return (with_copies(own, targets, seed)
            .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
            .select("row.*"))


def op10_mix(spark, sf_dir: str) -> DataFrame:
    """Contract query: the mix of all documents, one row each."""
    return mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS draw,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS pos
  FROM d GROUP BY source),
w AS (
  SELECT source, source_size, {MAX_RATE}::DOUBLE * source_size AS cap,
         CASE pos % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM s),
levels AS (
  SELECT cap / weight AS level,
         {BUDGET}::DOUBLE * (SELECT sum(source_size) FROM w)::DOUBLE
           - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap / b.weight < a.cap / a.weight), 0) AS rest,
         (SELECT sum(b.weight) FROM w b WHERE b.cap / b.weight >= a.cap / a.weight) AS open
  FROM w a WHERE source_size > 0),
best AS (
  -- the water level: full sources are those whose own level lies below it
  SELECT max(rest / open) FILTER (WHERE rest / open <= level) AS share FROM levels),
t AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT share FROM best), 0)::DOUBLE) AS target
  FROM w),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('{SEED}:' || d.draw), 1, 12) AS BIGINT)
           / {DRAW_RANGE:.1f}::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
