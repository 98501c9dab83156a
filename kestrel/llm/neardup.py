"""Near-duplicate documents: HyperMinHash registers, banding, corrected estimate, verification.

A document's set holds its distinct five-word shingles.  Every register keeps, for one
hash function, the leading-zero count of the smallest hash and the mantissa bits behind it
(16 bits in all).  Every hash function sees every shingle: splitting the shingles
among the registers would leave most registers of a short document empty.  Four neighbouring
registers make a band; documents that agree in a band are candidates.  The share of
equal registers, corrected for chance collisions, drops candidates that are far off, and the rest
is confirmed on the full sets.

Equal sets are joined to one class first, so a large group of copies is one node.  Inside a band's
bucket, pairs are not spelled out: all members are first compared with the most central one.
Buckets that then still hold several components are gathered into groups (members that share
such a bucket, directly or not), and a group's members are compared exactly across its
components: block by block, as products of small document x shingle matrices, from which a
task returns only links that join two components.  So every candidate link is found or
implied by others, and neither rows nor tasks grow with the square of a bucket.

Defined cases: a text without words, or null, has an empty set and links with nothing; a null
``doc_id`` links with nothing, has a null component and is kept; rows that repeat an id are
one node (any of them links it) and are all reported; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import per_batch, read_table, stored
from kestrel.llm.components import components

#: Words in a shingle; link at 100 * intersection >= PERCENT * union.
SHINGLE = 5
PERCENT = 75
#: 32 bands of 4 registers: a pair at the threshold is missed with probability (1 - 0.75**4)**32, about 5e-6.
BANDS = 32
BAND_ROWS = 4
REGISTERS = BANDS * BAND_ROWS
MANTISSA_BITS = 10
#: The estimate's standard deviation at 0.75 is 0.038; candidates over five of them below go.
MIN_ESTIMATE = 0.75 - 5 * 0.04
#: A block of a group holds about this many shingles; a document counts as LEAST_SHINGLES at least, so
#: a block of short ones is bounded too.
BLOCK_SHINGLES = 100_000
LEAST_SHINGLES = 100
#: Shingles (columns) in one matrix product.
COLUMNS = 4096
#: Shingles hashed at a time, small enough for the processor's cache.
CHUNK = 1 << 15

_rng = np.random.default_rng(1)
_FACTORS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(lists)
    coded = pc.dictionary_encode(flat)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    idx = coded.indices.to_numpy()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    empty = coded.dictionary.index("").as_py()  # white space at an end of a text leaves an empty piece
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        w = idx[a:b]
        if empty >= 0:
            w = w[w != empty]
        h = hashes[w]
        n = len(h)
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        k = min(n, SHINGLE)
        s = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            s += h[i:n - k + 1 + i] * _PLACES[i]
        out.append(np.unique(_mix(s)))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(documents x REGISTERS) 16-bit registers; zero for an empty set."""
    low = np.zeros((len(sets), REGISTERS), np.uint64)
    k = 0
    while k < len(sets):
        first, total = k, 0
        while k < len(sets) and (k == first or total + len(sets[k]) <= CHUNK):
            total += len(sets[k])
            k += 1
        own = [i for i in range(first, k) if len(sets[i])]
        if not own:
            continue
        s = np.concatenate([sets[i] for i in own])
        at = np.cumsum([0] + [len(sets[i]) for i in own[:-1]])
        hashed = np.empty_like(s)
        for r in range(REGISTERS):
            np.multiply(s, _FACTORS[r], out=hashed)
            hashed += _SHIFTS[r]
            low[own, r] = np.minimum.reduceat(hashed, at)
    _, bits = np.frexp((low >> np.uint64(11)).astype(np.float64))
    zeros = (53 - bits).astype(np.uint64)
    mantissa = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    return ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)


SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, regs array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, 128-bit set identity and registers (a band in each long) per document."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1))
        ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        regs = registers(sets).view(np.int64)
        n = len(sets)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]),
             pa.ListArray.from_arrays(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32), pa.array(regs.ravel()))],
            names=["doc_id", "n_shingles", "set_a", "set_b", "regs"])
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SIGNATURE)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of two disjoint sets of these sizes is equal by chance."""
    total = np.zeros(len(n))
    for z in range(54):
        high, low = 2.0 ** -z, 2.0 ** -(z + 1)
        p = (1 - low) ** n - (1 - high) ** n
        q = (1 - low) ** m - (1 - high) ** m
        total += p * q
    return total / 2 ** MANTISSA_BITS


def estimated(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) whose corrected estimate is not far below the threshold."""
    def side(x: str) -> DataFrame:
        return sigs.select(F.col("doc_id").alias(x), F.col("n_shingles").alias("n_" + x), F.col("regs").alias("r_" + x))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        def regs(k: int) -> np.ndarray:
            return batch.column(k).flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS)
        n, m = (batch.column(k).to_numpy().astype(float) for k in (2, 4))
        by_chance = chance(n, m)
        estimate = ((regs(3) == regs(5)).mean(axis=1) - by_chance) / (1 - by_chance)
        keep = (estimate >= MIN_ESTIMATE) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "r_a", "n_b", "r_b")
    return per_batch(both, run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; ``texts`` is (doc_id, text)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        def sets(k: int) -> list[np.ndarray]:
            coded = pc.dictionary_encode(batch.column(k))  # a hub's text is shingled once a batch
            own = shingle_sets(coded.dictionary)
            return [own[i] for i in coded.indices.to_pylist()]
        keep = []
        for s, t in zip(sets(2), sets(3), strict=True):
            shared = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(bool(shared) and 100 * shared >= PERCENT * (len(s) + len(t) - shared))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return per_batch(both.select("a", "b", "text_a", "text_b"), run, "a long, b long").distinct()


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def central_pairs(multi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hubs: key, hub; pairs: a, b): every member of a bucket with the member whose buckets
    are the fullest, which in a group of near copies is the one that most resemble."""
    weight = multi.groupBy("rep").agg(F.sum("n").alias("weight"))
    hubs = (multi.join(weight, "rep").groupBy("key")
            .agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("h"))
            .select("key", (-F.col("h.minus")).alias("hub")))
    return hubs, multi.join(hubs, "key").where("rep != hub").select(*ordered("rep", "hub")).distinct()


def _joining(a: list[np.ndarray], b: list[np.ndarray], roots_a: list[int], roots_b: list[int]) -> list[tuple[int, int]]:
    """Indices (i, j) of linked pairs of the two blocks, only those that join two components."""
    # only shingles that both blocks hold can be shared
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    both = np.zeros((len(a), len(b)), np.float32)
    own = []
    for block in (a, b):
        flat = np.concatenate(block)
        doc = np.repeat(np.arange(len(block)), [len(x) for x in block])
        at = np.searchsorted(shared, flat)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == flat[hit]
        own.append((doc[hit], at[hit]))
    for low in range(0, len(shared), COLUMNS):
        x, y = (np.zeros((len(block), COLUMNS), np.float32) for block in (a, b))
        for m, (doc, at) in ((x, own[0]), (y, own[1])):
            inside = (at >= low) & (at < low + COLUMNS)
            m[doc[inside], at[inside] - low] = 1
        both += x @ y.T
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    linked = 100 * both >= PERCENT * (sizes - both)
    top: dict[int, int] = {}

    def find(r: int) -> int:
        while top.get(r, r) != r:
            r = top[r]
        return r
    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        r, s = find(roots_a[i]), find(roots_b[j])
        if r != s:
            top[max(r, s)] = min(r, s)
            out.append((int(i), int(j)))
    return out


def cross_links(multi: DataFrame, hubs: DataFrame, comps: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different components of buckets that hold several.

    ``comps`` is (node, root) of the links known so far, ``sizes`` (rep, n_shingles).
    """
    member = (multi.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
              .withColumn("root", F.coalesce("root", "rep")))
    open_keys = (member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                 .where("lo != hi").select("key"))
    rows = stored(member.join(open_keys, "key").join(hubs, "key").select("rep", "root", "hub"), "open")
    groups = components(rows.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    nodes = (rows.select("rep", "root").distinct()
             .join(groups.select(F.col("node").alias("rep"), F.col("root").alias("grp")), "rep").join(sizes, "rep"))
    nodes = stored(nodes.select("grp", "rep", "root", "n_shingles"), "group-nodes")
    parts = nodes.groupBy("grp", "root").agg(
        F.sum(F.greatest("n_shingles", F.lit(LEAST_SHINGLES))).alias("w"))
    main = parts.groupBy("grp").agg(F.max(F.struct("w", "root")).alias("m"), F.sum("w").alias("all"))
    blocks = main.select(
        "grp", F.col("m.root").alias("main"),
        F.ceil((F.col("all") - F.col("m.w")) / BLOCK_SHINGLES).cast("int").alias("minor_blocks"),
        F.ceil(F.col("m.w") / BLOCK_SHINGLES).cast("int").alias("main_blocks"))
    # minor rows meet each other and the main component; the main component's rows do not meet
    placed = nodes.join(blocks, "grp").withColumn("minor", F.col("root") != F.col("main"))
    placed = placed.withColumn("block", F.when(
        F.col("minor"), F.pmod(F.xxhash64("rep"), F.col("minor_blocks")))
        .otherwise(F.pmod(F.xxhash64("rep"), F.col("main_blocks")) + F.col("minor_blocks")).cast("int"))
    last = F.when(F.col("minor"), F.col("minor_blocks") + F.col("main_blocks") - 1).otherwise(F.col("minor_blocks") - 1)
    spread = (placed.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
              .select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "block", "rep", "root"))
    full = spread.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sets = shingle_sets(table.column("text").combine_chunks())
        block, rep, root = (table.column(c).to_pylist() for c in ("block", "rep", "root"))
        x = [k for k, n in enumerate(block) if n == i]
        y = [k for k, n in enumerate(block) if n == j]
        found = _joining([sets[k] for k in x], [sets[k] for k in y],
                         [root[k] for k in x], [root[k] for k in y]) if x and y else []
        return pa.table({"a": pa.array([rep[x[k]] for k, _ in found], pa.int64()),
                         "b": pa.array([rep[y[k]] for _, k in found], pa.int64())})
    return full.groupBy("grp", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = stored(signatures(docs), "signatures")
    sets = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    rows = stored(sets.join(classes, ["set_a", "set_b"]).select("doc_id", "n_shingles", "rep", F.when(
        F.col("doc_id") == F.col("rep"), F.col("regs")).alias("regs")), "classes")
    # an id with several texts ties their classes together
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi")
    tied = rows.join(several, "doc_id").where("rep != lo").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    reps = rows.where("regs IS NOT NULL").distinct().select("doc_id", "n_shingles", "regs")
    entries = (reps.select(F.col("doc_id").alias("rep"), F.posexplode("regs").alias("band", "reg"))
               .select(F.xxhash64("band", "reg").alias("key"), "rep").distinct())
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    multi = stored(entries.join(shared, "key"), "buckets")
    hubs, pairs = central_pairs(multi)
    hubs = stored(hubs, "hubs")
    likely = stored(estimated(pairs, reps), "candidates")
    # the texts of all documents that may be compared, read once
    needed = multi.select(F.col("rep").alias("doc_id")).distinct()
    texts = stored(docs.join(needed, "doc_id"), "texts")
    links = stored(confirmed(likely, texts).unionByName(tied), "confirmed")
    comps = stored(components(links), "components")
    more = stored(cross_links(multi, hubs, comps, reps.select(F.col("doc_id").alias("rep"), "n_shingles"), texts), "cross")
    # what is known so far enters as one link a node
    final = components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    by_rep = rows.select("doc_id", "rep").distinct().join(
        final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    by_doc = by_rep.groupBy("doc_id").agg(F.min("root").alias("root"))
    return (sigs.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, columns as they came; a row without an id is a group of its own.

    Of rows that repeat a kept id one stays, whatever their texts (an id is one node): the one whose text, then
    whose other columns, hash lowest, so a rerun keeps the same.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    order = F.struct(F.xxhash64("text"), F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]))
    one = (named.join(kept, named["doc_id"] == kept["_kept"]).groupBy("_kept")
           .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("_row")).select("_row.*"))
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's component."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
