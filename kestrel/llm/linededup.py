"""Line dedup: segment-partition edit join.

Lines within MAX_EDITS edits of each other are copies.  A line is cut into MAX_EDITS + 1 segments; of two
lines that close, one holds a segment of the other unchanged, at a place that their lengths and the
segment's number confine.  So lines are filed under (length, segment number, segment), each line probes the
few substrings that can match, and lines that meet are verified by a banded bit-parallel edit distance.

Equal lines are one node first.  Lines that meet under a key are not paired with each other: all are
verified against one of them, and only where a key then still holds several components are lines of
different components compared, block by block inside tasks that return just links between components.

A line is what stands between line feeds, without white space at its ends.  Lines of fewer than MIN_CHARS
characters are copies only when equal; empty lines are no lines.  The first line of a component (by
document and place) is kept.

Defined cases: a null or empty text has no lines; rows with a null id sort last; every input row is a document
of its own, so of rows that repeat an id (a null id included) only the first, in the order they are read, can keep
a line; an empty table gives an empty result; other columns are not read.  Lines are identified by 64-bit hashes (xxh3).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import per_batch, read_table, stored, stored_at
from kestrel.llm.components import components
from kestrel.session import remove_scratch

MAX_EDITS = 2
MIN_CHARS = 20
#: Lines in a block of the comparison across components.
BLOCK_LINES = 1000

_ENDS = " \t\r\x0b\x0c"


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(place, line) of the lines of a text, stripped, without empty ones."""
    return [(k, s) for k, x in enumerate((text or "").split("\n")) if (s := x.strip(_ENDS))]


def line_id(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def segments(length: int, edits: int = MAX_EDITS) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line; the last ones are longer by one."""
    k = edits + 1
    short, longer = divmod(length, k)
    out, at = [], 0
    for i in range(k):
        n = short + (i >= k - longer)
        out.append((at, n))
        at += n
    return out


def probes(line: str, edits: int = MAX_EDITS) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment number, start, length) of the substrings that may be a segment of a line
    of that length, no longer than this one."""
    out, n = [], len(line)
    for length in range(max(0, n - edits), n + 1):
        more = n - length
        for i, (at, size) in enumerate(segments(length, edits)):
            low = max(0, at - i, at + more - (edits - i))
            high = min(n - size, at + i, at + more + (edits - i))
            out.extend((length, i, start, size) for start in range(low, high + 1))
    return out


_PLACES: dict[int, tuple[list, list]] = {}


def line_keys(line: str) -> tuple[list[int], list[bool]]:
    """(hashes of the keys that a line probes, whether a key is a segment of its own)."""
    n = len(line)
    if n not in _PLACES:
        if len(_PLACES) > 10_000:
            _PLACES.clear()
        # length and segment number go into the hash's seed
        own, found = segments(n), probes(line)
        _PLACES[n] = ([(length * (MAX_EDITS + 1) + i, start, start + size) for length, i, start, size in found],
                      [length == n and own[i] == (start, size) for length, i, start, size in found])
    data = line.encode("utf-32-le", "surrogatepass")
    places, owned = _PLACES[n]
    return [xxhash.xxh3_64_intdigest(data[4 * a:4 * b], seed) for seed, a, b in places], owned


def common_prefix(p: str, t: str) -> int:
    """Length of the common prefix, by bisection over slices."""
    low, high = 0, min(len(p), len(t))
    while low < high:
        mid = (low + high + 1) // 2
        if p[low:mid] == t[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(p: str, t: str, edits: int = MAX_EDITS) -> bool:
    """Whether two lines are at most ``edits`` apart: bit-parallel over a band of 2 * edits + 1
    diagonals, after what they share at both ends is cut off."""
    if p == t:
        return True
    if abs(len(p) - len(t)) > edits:
        return False
    k = common_prefix(p, t)
    p, t = p[k:], t[k:]
    k = common_prefix(p[::-1], t[::-1])
    return banded(p[:len(p) - k], t[:len(t) - k], edits)


def banded(p: str, t: str, edits: int) -> bool:
    m, n = len(p), len(t)
    if min(m, n) == 0:
        return max(m, n) <= edits
    if min(m, n) <= edits:  # a common prefix changes nothing and makes the band fit
        return banded(" " * (edits + 1) + p, " " * (edits + 1) + t, edits)
    mask = (1 << (2 * edits + 1)) - 1
    rows: dict[str, int] = {}
    for i, c in enumerate(p):
        rows[c] = rows.get(c, 0) | 1 << i
    up, down = (mask << edits) & mask, 0  # vertical steps of +1 and -1 in the band
    bottom, score = 2 * edits, edits
    for j in range(1, n + 1):
        eq = rows.get(t[j - 1], 0)
        shift = j - edits - 1
        x = (eq >> shift if shift >= 0 else eq << -shift) & mask
        diagonal = ((((x & up) + up) ^ up) | x | down) & mask  # cells equal to their upper left neighbour
        right_up = (down | ~(diagonal | up)) & mask
        right_down = diagonal & up
        if j + edits <= m:
            score += not diagonal >> bottom & 1  # along the band's lowest diagonal
            if score > 3 * edits:
                return False
        else:
            k = m - j + edits  # along the last row
            score += (right_up >> k & 1) - (right_down >> k & 1)
        half = diagonal >> 1
        up = (right_down | ~(half | right_up)) & mask
        down = half & right_up
    return score <= edits


def line_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, place, line) of all lines, identified by hash; a row at place -1 for every document.

    ``row`` numbers the input rows as they are read; it is stored with the lines and used nowhere else.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids, places, lines = [], [], [], []
        for row, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = lines_of(text)
            rows += [row] * (len(own) + 1)
            ids += [doc_id] * (len(own) + 1)
            places += [-1, *[k for k, _ in own]]
            lines += [None, *[line_id(s) for _, s in own]]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()),
                                           pa.array(lines, pa.int64())], names=["row", "doc_id", "place", "line"])
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return per_batch(numbered, run, "row long, doc_id long, place int, line long")


def _distinct_long(batch: pa.RecordBatch) -> dict[str, int]:
    return {s: line_id(s) for text in batch.column(1).to_pylist() for _, s in lines_of(text) if len(s) >= MIN_CHARS}


def key_rows(docs: DataFrame) -> DataFrame:
    """(key, line, own) of all keys of the distinct lines; a batch's repeats are sent once."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = _distinct_long(batch)
        keys = [line_keys(s) for s in lines]
        flat = np.fromiter((k for x, _ in keys for k in x), np.uint64)
        own = np.fromiter((o for _, x in keys for o in x), bool)
        line = np.repeat(np.fromiter(lines.values(), np.int64, len(lines)), [len(x) for x, _ in keys])
        return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(line), pa.array(own)],
                                          names=["key", "line", "own"])
    return per_batch(docs, run, "key long, line long, own boolean")


def line_texts(docs: DataFrame) -> DataFrame:
    """(line, content) of the distinct long lines of every batch."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = _distinct_long(batch)
        return pa.RecordBatch.from_arrays([pa.array(lines.values(), pa.int64()), pa.array(lines.keys(), pa.string())],
                                          names=["line", "content"])
    return per_batch(docs, run, "line long, content string")


def verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines that are close."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [within(p, t) for p, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    with_a = pairs.join(contents.select(F.col("line").alias("a"), F.col("content").alias("content_a")), "a")
    both = with_a.join(contents.select(F.col("line").alias("b"), F.col("content").alias("content_b")), "b")
    return per_batch(both.select("a", "b", "content_a", "content_b"), run, "a long, b long")


def across(meeting: DataFrame, comps: DataFrame, contents: DataFrame) -> DataFrame:
    """Links between different components of keys that hold several, by blocks of lines.

    Lines under one key are cut into blocks; a task compares the lines of one that own the key's segment with the
    lines of another and returns only links that join two components.
    """
    member = (meeting.join(comps.withColumnRenamed("node", "line"), "line", "left")
              .withColumn("root", F.coalesce("root", "line")))
    several = (member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
               .where("lo != hi").select("key", F.ceil(F.col("n") / BLOCK_LINES).cast("int").alias("blocks")))
    placed = member.join(several, "key").withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    spread = (placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "block", "line", "root", "own"))
    full = spread.join(contents, "line")

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "line", "root", "content", "own")), strict=True))
        top: dict[int, int] = {}

        def find(r: int) -> int:
            while top.get(r, r) != r:
                r = top[r]
            return r
        out = []
        left, right = ([r for r in rows if r[0] == b] for b in (i, j))
        right.sort(key=lambda r: len(r[3]))
        sizes = [len(r[3]) for r in right]
        for _, a, ra, s, mine in left:
            near = right[bisect_left(sizes, len(s) - MAX_EDITS):bisect_right(sizes, len(s) + MAX_EDITS)]
            for _, b, rb, t, theirs in near:
                if (mine or theirs) and (i != j or a < b) and find(ra) != find(rb) and within(s, t):
                    top[max(find(ra), find(rb))] = min(find(ra), find(rb))
                    out.append((a, b))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
    return full.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def classified_lines(docs: DataFrame) -> DataFrame:
    """``line_classes``, and a row at place -1 for every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(line_rows(docs), "lines")
    keys, keys_path = stored_at(key_rows(docs), "keys")
    # keys that come more than once and that a line owns; a few are one line's, met again in another batch
    shared = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned"))
              .where("n > 1 AND owned").select("key"))
    met, met_path = stored_at(keys.join(shared, "key").groupBy("key", "line").agg(F.max("own").alias("own")), "met")
    remove_scratch(spark, keys_path)
    hubs = (met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("own"), F.col("line"))).alias("hub"))
            .where("n > 1").select("key", "hub"))
    meeting = stored(met.join(hubs, "key"), "meeting")
    remove_scratch(spark, met_path)
    pairs = meeting.where("line != hub").select(F.col("hub").alias("a"), F.col("line").alias("b")).distinct()
    needed = meeting.select("line").distinct()
    contents = stored(line_texts(docs).join(needed, "line").dropDuplicates(["line"]), "contents")
    links = stored(verified(pairs, contents), "links")
    comps = stored(components(links), "components")
    more = across(meeting.select("key", "line", "own"), comps, contents)
    final = components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    # sorting nulls last: the order key of a null id is after all others
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "place")
    firsts = rows.where("line IS NOT NULL").groupBy("line").agg(F.min(place).alias("first"))
    nodes = firsts.join(final.withColumnRenamed("node", "line"), "line", "left").select(
        "line", F.coalesce("root", "line").alias("root"), "first")
    by_root = nodes.groupBy("root").agg(F.min("first").alias("first"))
    classes = nodes.select("line", "root").join(by_root, "root").select("line", "first")
    lines = rows.join(classes, "line").select(
        "row", "doc_id", "place", F.col("first.doc_id").alias("class_doc"), F.col("first.place").alias("class_place"),
        ((F.col("row") == F.col("first.row")) & (F.col("place") == F.col("first.place"))).alias("kept"))
    return lines.unionByName(rows.where("place < 0").select("row", "doc_id", "place"), allowMissingColumns=True)


def line_classes(docs: DataFrame) -> DataFrame:
    """Per line: row, doc_id, place, class_doc, class_place (the component's first line), kept."""
    return classified_lines(docs).where("place >= 0")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its numbers of lines and of lines that copy an earlier one, and the class of each
    line (the document and place of the class's first line, as ``doc:place``)."""
    name = F.concat_ws(":", F.coalesce(F.col("class_doc").cast("string"), F.lit("null")), "class_place")
    line = F.col("place") >= 0
    return (classified_lines(read_table(spark, sf_dir, "documents")).groupBy("row", "doc_id").agg(
        F.count_if(line).alias("n_lines"), F.count_if(line & ~F.col("kept")).alias("n_dropped"),
        F.array_sort(F.collect_list(F.when(line, F.struct("place", name.alias("class"))))).alias("line_classes"))
        .drop("row"))
