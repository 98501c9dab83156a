"""Token shards: ids as the library gives them, exact round trip, random access, damage."""

import io
import os
import struct
import zlib

import pyarrow as pa
import pytest

from kestrel.llm import tokens as K


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at:at + n]


def library(text):
    return K.encoder(K.tokenizer_content()).tokenizer.encode(text or "", add_special_tokens=False).ids


TEXTS = ["a<|endoftext|>b c", "İstanbul ΣΑΣ é \u2028y\x1cz", None, "", "\x00a\x85b", "don't we'LL 'S",
         " café ́x µ ª º × ÷ ÀÉß\x0bq\x0cz ", "日本語 テスト", "😀", "ﬁ ŒUVRE Ǆ", "a\xadb", "1234 1,234.5% ½", "<| x |>"]


def test_encoder_gives_the_library_ids(spark):
    enc = K.encoder(K.tokenizer_content())
    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for texts in (TEXTS, docs, []):
        ids, at = enc.encode(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            assert ids[at[k]:at[k + 1]].tolist() == library(t), t


def test_shards_read_back(odd, none, scratch):
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    out = K.token_output(odd, "file://" + scratch).orderBy("start").collect()
    start = 0
    for r, o in zip(rows, out, strict=True):
        ids = library(r["text"]) + [K.END_ID]
        assert tuple(o)[:4] == (r["doc_id"], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert not [f for f in os.listdir(scratch) if f.endswith(".part")]
    assert K.token_output(none).collect() == []


def test_random_access_reads_only_its_frame_and_checks_it():
    stream = Bytes()
    out = K.ShardWriter(stream)
    docs = {k: struct.pack("<3I", k, k + 1, 2) * 20_000 for k in range(6)}
    for k, ids in docs.items():
        out.add(k, ids)
    out.add(None, b"")
    assert out.close() == (7, 6 * 60_000)
    reader = K.ShardReader(stream)
    assert [reader.document(i) for i in reader.find(4)] == [docs[4]] and reader.find(0) == [0] and reader.find(99) == []
    assert len(set(reader.frames[:6])) == 6
    raw = bytearray(stream.getvalue())
    raw[int(reader.starts[2]) + 20] ^= 1  # in the frame of document 2
    damaged = K.ShardReader(Bytes(bytes(raw)))
    assert damaged.document(1) == docs[1]
    with pytest.raises(Exception):
        damaged.document(2)
    # any zstandard reader can read the data frames in a row
    import zstandard
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(stream.getvalue()), read_across_frames=True).read()
    assert whole.startswith(b"".join(docs.values()))
    with pytest.raises(ValueError):
        K.ShardReader(Bytes(b"x" * 50))
