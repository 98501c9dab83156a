"""Benchmark decontamination: spaced-seed hashing, DataFrame operations only.

A token is a lower-cased run of letters and digits; in scripts written without spaces every letter is a token.
Every window of every document is hashed under each mask, which skips some token positions, and joined to
the hashes of the benchmark's windows.  A hit gives an alignment of a document with an item; around its hits the
alignment is verified: some WINDOW consecutive item tokens must equal the document's at
the same places, but for up to SUBSTITUTIONS.  The two masks together hit every such window at least once,
whichever two positions are substituted.

Items of fewer than WINDOW tokens must occur whole and unchanged; those of fewer than MIN_TOKENS (a name, a
greeting) must be a whole line or the whole text.

Defined cases: a null or empty text is clean; every row is judged by its own text, so rows that share an id, a null id
included, can differ; repeated items are reported each; an item without tokens is never found; an empty benchmark
leaves all documents clean; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import read_table, stored

WINDOW = 13
SUBSTITUTIONS = 2
MIN_TOKENS = 5
#: Token positions that count.  Every choice of two substituted positions in 13 leaves a place for one of them.
MASKS = ((0, 2, 3, 6, 8, 9), (0, 1, 4, 6, 7, 10))
#: Benchmark hashes up to this many are broadcast (about 32 bytes each); beyond, the join shuffles.
BROADCAST_SEEDS = 2_000_000
#: Keys that the documents of one seed are spread over where the join shuffles.
SALTS = 16

_BREAK = "[^\\p{L}\\p{N}]+"
#: Blocks of scripts written without spaces between words: Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = "([\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\x{20000}-\\x{3FFFF}])"
#: What tells rows apart: the id and 128 bits of the text.
KEY = ("doc_id", "text_a", "text_b")


def tokens(text: Column) -> Column:
    """Tokens of a text; an empty one may stand at either end."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _UNSPACED, " $1 "), _BREAK)


def keyed(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_a"),
            F.xxhash64(F.lit(1), text).alias("text_b")]


def same_row(left: DataFrame, right: DataFrame, prefix: str) -> Column:
    return (left["doc_id"].cast("long").eqNullSafe(right[f"{prefix}doc_id"]) & (left["text_a"] == right[f"{prefix}text_a"])
            & (left["text_b"] == right[f"{prefix}text_b"]))


def once(value: Column) -> Column:
    """A value that the steps above it use several times: a generator is not folded into them."""
    return F.explode(F.array(value))


def window_hashes(hashes: str, masks) -> Column:
    """array<struct<pos, hash>> of all windows of an array of token hashes under all masks."""
    def under(k: int, mask) -> Column:
        last = F.size(hashes) - 1 - mask[-1]
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            i.alias("pos"), F.xxhash64(F.lit(k), *[F.get(F.col(hashes), i + o if o else i) for o in mask]).alias("hash")))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))
    return F.concat(*[under(k, m) for k, m in enumerate(masks)])


def windows(rows: DataFrame, key: list[str], masks) -> DataFrame:
    """(key, pos, hash) of all windows of rows of (key, tokens)."""
    hashed = rows.select(*key, F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    return (hashed.select(*key, F.explode(window_hashes("h", masks)).alias("w"))
            .select(*key, F.col("w.pos").alias("pos"), F.col("w.hash").alias("hash")))


def named_lines(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, row, item_id, matched) of the texts and lines that are an item of fewer than MIN_TOKENS tokens."""
    units = docs.select(*KEY, F.explode(F.concat(F.split(F.coalesce("text", F.lit("")), "\n"), F.array(
        F.coalesce("text", F.lit(""))))).alias("unit"))
    cut = units.select(*KEY, F.filter(tokens(F.col("unit")), lambda t: t != "").alias("tokens"))
    return (cut.where(F.size("tokens") < MIN_TOKENS).join(items, "tokens")
            .groupBy(*KEY, "row", "item_id").agg(F.max(F.size("tokens")).alias("matched")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: ``KEY``, item_id, doc_pos (token where the item would begin; null for a named line), matched
    (most equal tokens in one window), window."""
    items = stored(benchmark.select(
        F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"),
        F.filter(tokens(F.col("text")), lambda t: t != "").alias("tokens")).where(F.size("tokens") > 0), "items")
    n = F.size("tokens")
    short = [r[0] for r in items.where((n < WINDOW) & (n >= MIN_TOKENS)).select(n).distinct().collect()]
    masks = list(MASKS) + [tuple(range(k)) for k in sorted(short)]
    held = stored(windows(items.where(n >= MIN_TOKENS), ["row"], masks).select(
        "row", F.col("pos").alias("item_pos"), "hash"), "seeds")
    texts = docs.select(*keyed(docs), "text")
    met = windows(texts.select(*KEY, tokens(F.col("text")).alias("tokens")), list(KEY), masks)
    if held.count() <= BROADCAST_SEEDS:
        met = met.join(F.broadcast(held), "hash")
    else:
        # a window that a third of all documents hold is met under as many keys as there are salts
        met = met.withColumn("salt", F.pmod(F.xxhash64(*KEY, "pos"), F.lit(SALTS))).join(
            held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["hash", "salt"])
    hits = (met.groupBy(*KEY, "row", (F.col("pos") - F.col("item_pos")).alias("doc_pos"))
            .agg(F.min("item_pos").alias("first"), F.max("item_pos").alias("last")))
    hits = stored(hits, "hits")
    found = hits.withColumnsRenamed({k: f"hit_{k}" for k in KEY}).join(items, "row")
    both = (texts.join(found, same_row(texts, found, "hit_"))
            .select(*KEY, "row", "item_id", "doc_pos", "first", "last", F.col("tokens").alias("item"),
                    once(tokens(F.col("text"))).alias("doc")))
    n = F.size("item")
    width = F.least(F.lit(WINDOW), n)
    equal = F.transform("item", lambda t, j: F.coalesce(F.get(F.col("doc"), j + F.col("doc_pos")) == t, F.lit(False)).cast("int"))
    # windows that cover a hit
    starts = F.sequence(F.greatest(F.lit(0), F.col("first") - width + 1), F.least(n - width, F.col("last")))
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(
        F.slice("equal", s + 1, F.col("window")), F.lit(0), lambda a, x: a + x)))
    need = F.when(n < WINDOW, n).otherwise(F.lit(WINDOW - SUBSTITUTIONS))
    long = (both.withColumn("window", width).withColumn("equal", once(equal)).withColumn("matched", best)
            .where(F.col("matched") >= need)
            .groupBy(*KEY, "row", "item_id", "doc_pos").agg(F.max("matched").alias("matched"), F.max("window").alias("window")))
    names = items.where(F.size("tokens") < MIN_TOKENS)
    if names.isEmpty():
        return long.drop("row")  # no line needs to be cut
    lines = named_lines(texts, names)
    return long.unionByName(lines.withColumn("doc_pos", F.lit(None).cast("int")).withColumn("window", F.col("matched"))).drop("row")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, columns as they came."""
    gone = leaks(docs, benchmark).select(*[F.col(k).alias(f"_gone_{k}") for k in KEY]).distinct()
    _, a, b = keyed(docs)
    own = docs.select("*", a.alias("_a"), b.alias("_b"))
    return own.join(gone, own["doc_id"].cast("long").eqNullSafe(gone["_gone_doc_id"]) & (own["_a"] == gone["_gone_text_a"])
                    & (own["_b"] == gone["_gone_text_b"]), "left_anti").drop("_a", "_b")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the items that it leaks (a sorted list of item ids)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = (leaks(docs, read_table(spark, sf_dir, "benchmark")).groupBy(*[F.col(k).alias(f"leaked_{k}") for k in KEY])
             .agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.count(F.lit(1)).alias("n_overlaps")))
    none = F.array().cast("array<bigint>")
    own = docs.select(*keyed(docs))
    return (own.join(found, same_row(own, found, "leaked_"), "left")
            .select("doc_id", F.col("items").isNotNull().alias("contaminated"),
                    F.coalesce("items", none).alias("items"), F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps")))
