"""Token-ID output: independent zstandard frames with a trailing seek table.

Documents are range-partitioned by id; each task encodes its documents in order and
writes one shard.  A shard is a file in the public seekable zstandard layout:

    data frames   token ids of whole documents, unsigned 32-bit little-endian
    index frame   per document: id, frame, offset in the frame, number of ids
    seek table    a skippable frame: per frame its compressed size, content size and
                  checksum (low 32 bits of xxh64 of the content), then a 9-byte footer

so a reader fetches the footer, the table and the index, and then decompresses only
the frames of the documents it wants.  A shard is written under a temporary name and
moved when complete; its name and content depend on its range only, so a retried task replaces
it by the same bytes.  Files are opened through ``pyarrow.fs`` by their URI.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` sorts first
and is read back as null; rows that repeat an id are written one after another, ordered by
a hash of their texts; an empty table writes no shard; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import bounded_batches, read_table, stored
from kestrel.session import scratch_path

# The public seekable layout and the contract's end id.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
END_ID = 2
TOKENIZER = "word_bpe_49k.json"

#: A data frame is closed once it holds this many bytes; a longer document has a frame of its own.
FRAME_BYTES = 1 << 18
LEVEL = 3
#: Words whose ids a worker remembers; the memory is emptied when full.
CACHED_WORDS = 700_000

# The tokenizer's split, for words of ASCII and Latin-1 letters only.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a tokenizer file's content.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    words' ids in a row.  A batch's distinct words are found by Arrow's dictionary encoding;
    words seen before are remembered.  Words of plain letters and marks skip the tokenizer's
    general normaliser and go to its model part by part; all others, and any other kind of
    tokenizer, are encoded by the library as they are.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(content)
        self.model = self.tokenizer.model
        spec = json.loads(content)
        split = json.dumps(spec.get("pre_tokenizer") or "")
        self.by_word = "</w>" == spec["model"].get("end_of_word_suffix") and '"Removed"' in split
        self.special = re.compile("|".join(re.escape(t["content"][:2]) for t in spec["added_tokens"])
                                  if spec.get("added_tokens") else "(?!)")
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        if (found := self.parts.get(part)) is None:
            spelt = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            ids = [t.id for t in self.model.tokenize(spelt)]
            found = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or self.special.search(word):
            return self._library(word)
        low = word.lower()
        if low.isalpha():
            return self._part(low)
        return b"".join(map(self._part, _SPLIT.findall(low)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin and the last one's end)."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            ids = [np.frombuffer(self._library(t), "<u4") for t in texts.to_pylist()]
            ends = np.cumsum([0] + [len(i) for i in ids])
            return np.concatenate([np.zeros(0, "<u4"), *ids]), ends
        lists = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        if len(self.words) > CACHED_WORDS or len(self.parts) > CACHED_WORDS:
            self.words, self.parts = {"": b""}, {}
        known, packed = self.words, []
        for w in coded.dictionary.to_pylist():
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self._word(w)
            packed.append(ids)
        pool = np.frombuffer(b"".join(packed), "<u4")
        size = np.array([len(p) // 4 for p in packed], np.int64)
        first = np.cumsum(size) - size
        word = coded.indices.to_numpy()
        n = size[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        # each word's ids are a run of the pool
        ids = pool[np.repeat(first[word] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = lists.offsets.to_numpy()
        return ids, ends[bounds - bounds[0]]


@functools.lru_cache(maxsize=2)
def encoder(content: str) -> Encoder:
    return Encoder(content)


def tokenizer_content(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


class ShardWriter:
    """Writes one shard to an open binary stream."""

    def __init__(self, stream):
        self.stream, self.pack = stream, zstandard.ZstdCompressor(level=LEVEL)
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int, int]] = []  # id, is null, frame, offset, ids
        self.open: list[bytes] = []
        self.filled = 0

    def _frame(self, content: bytes) -> None:
        data = self.pack.compress(content)
        self.stream.write(data)
        self.table.append((len(data), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _close_frame(self) -> None:
        if self.filled:
            self._frame(b"".join(self.open))
        self.open, self.filled = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.filled and self.filled + len(ids) > FRAME_BYTES:
            self._close_frame()
        self.docs.append((doc_id or 0, doc_id is None, len(self.table), self.filled, len(ids) // 4))
        self.open.append(ids)
        self.filled += len(ids)

    def close(self) -> tuple[int, int]:
        """Ends the shard; (documents, ids)."""
        self._close_frame()
        cols = list(zip(*self.docs, strict=True)) or [()] * 5
        self._frame(b"".join(np.array(c, t).tobytes() for c, t in
                             zip(cols, ("<i8", "u1", "<u4", "<u4", "<u4"), strict=True)))
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries
                          + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE))
        return len(self.docs), sum(d[4] for d in self.docs)


class ShardReader:
    """Random access to a shard: opening reads the seek table and the index only."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & HAS_CHECKSUMS:
            raise ValueError("not a shard: no seek table with checksums")
        raw = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.packed, self.plain, self.sums = raw.T
        self.starts = np.concatenate([[0], np.cumsum(self.packed, dtype=np.int64)])
        index = self.frame(n - 1)
        k = len(index) // 21
        self.ids = np.frombuffer(index, "<i8", k)
        self.null = np.frombuffer(index, "u1", k, 8 * k).astype(bool)
        self.frames, self.offsets, self.counts = (np.frombuffer(index, "<u4", k, (9 + 4 * i) * k) for i in range(3))
        self.last = (-1, b"")

    def frame(self, i: int) -> bytes:
        """One frame's content, checked."""
        data = self.source.read_at(int(self.packed[i]), int(self.starts[i]))
        content = self.unpack.decompress(data, max_output_size=int(self.plain[i])) if self.plain[i] else b""
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.sums[i]):
            raise ValueError(f"frame {i} does not match its checksum")
        return content

    def document(self, k: int) -> bytes:
        """Packed ids of the k-th document; neighbours in one frame decompress it once."""
        f = int(self.frames[k])
        if self.last[0] != f:
            self.last = (f, self.frame(f))
        at = int(self.offsets[k])
        return self.last[1][at:at + 4 * int(self.counts[k])]

    def find(self, doc_id: int) -> list[int]:
        """Positions of the documents with this id."""
        return np.flatnonzero((self.ids == doc_id) & ~self.null).tolist()


def open_shard(path: str) -> ShardReader:
    filesystem, inner = fs.FileSystem.from_uri(path)
    return ShardReader(filesystem.open_input_file(inner))


MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else "file://" + path


def write_shards(docs: DataFrame, folder: str, end_id: int = END_ID,
                 tokenizer: str | None = None) -> DataFrame:
    """Encode and write all documents below ``folder`` (a shared URI); the manifest, stored."""
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(tokenizer_content(tokenizer))
    end = struct.pack("<I", end_id)
    folder = as_uri(folder).rstrip("/")
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        enc, shard = encoder(content.value), TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}.zst"
        filesystem, inner = fs.FileSystem.from_uri(name)
        filesystem.create_dir(inner.rpartition("/")[0], recursive=True)
        part = f"{inner}.{uuid.uuid4().hex}.part"
        with filesystem.open_output_stream(part) as stream:
            out = ShardWriter(stream)
            while batch is not None:
                ids, at = enc.encode(batch.column(1))
                for k, doc_id in enumerate(batch.column(0).to_pylist()):
                    out.add(doc_id, ids[at[k]:at[k + 1]].tobytes() + end)
                batch = next(batches, None)
            n_docs, n_tokens = out.close()
        filesystem.move(part, inner)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([name]), pa.array([n_docs]), pa.array([n_tokens])],
            names=["shard", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("tie"))
    # the tie-breaker parts rows that repeat one id
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return stored(placed.mapInArrow(run, MANIFEST), "manifest")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, position int"


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read every document back from the shards of a manifest (``DIGEST``)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = open_shard(row["path"])
                k = len(reader.ids)
                starts = row["first"] + np.concatenate([[0], np.cumsum(reader.counts, dtype=np.int64)])[:k]
                crc = [zlib.crc32(reader.document(i)) for i in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.ids, mask=reader.null), pa.array(starts), pa.array(reader.counts.astype("i8")),
                     pa.array(crc, pa.int64()), pa.array([row["shard"]] * k, pa.int32()),
                     pa.array(np.arange(k, dtype="i4"))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "position"])

    # one task a shard, whichever way the manifest was stored
    return shards.repartition(max(1, manifest.count())).mapInArrow(run, DIGEST)


def token_output(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the shards and read them back: one row per document."""
    return read_shards(write_shards(docs, folder or scratch_path(docs.sparkSession, "llm-tokens")))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents through the file format and back."""
    return token_output(read_table(spark, sf_dir, "documents"))
