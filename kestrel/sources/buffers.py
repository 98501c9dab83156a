"""A replayable line source (A4): send buffers of fixed size, with byte offsets as its position.

The wire that the reference listens on carries buffers of one size: a line or several, then padding.  Here
they are stored one after another in the files of a folder, which keeps every byte that was sent.  The stream's position
is a byte offset into that sequence of files; a batch is a range of bytes, cut at buffers and dealt to tasks in
slices.  A restart reads the same bytes again, so a batch is always the same.  No port is opened.

Most of a buffer is padding, so files may be gzipped (``.gz``): offsets count the bytes that were sent, and a slice unpacks
the files that hold it.  Such a file holds less than 4 GiB of them, in one gzip member, as Spark's text writer makes it.

Register once per session (``spark.dataSource.register(BufferSource)``), then
``spark.readStream.format("buffers").option("path", folder).load()`` gives ``offset`` and ``value`` (the
buffer's text, padding included: ``clean_rating_lines`` and ``points_from_lines`` take it from there).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Fixed value: the size of a send buffer.
BUFFER_BYTES = 1400
#: Buffers that one task reads at a time.
SLICE_BUFFERS = 20_000


def _store(path: str) -> tuple:
    """(file system, folder) of a path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _unpacked(where, name: str, size: int) -> int:
    """Bytes that a gzipped file holds: its last four bytes tell."""
    if size < 18:
        return 0
    with where.open_input_file(name) as f:
        f.seek(size - 4)
        return int.from_bytes(f.read(4), "little")


def _packed(name: str) -> bool:
    return name.endswith(".gz")


class Slice(InputPartition):
    """Bytes ``start`` to ``end`` of the sequence, and where they are: (file, low, high)."""

    def __init__(self, start: int, end: int, parts: list):
        self.start, self.end, self.parts = start, end, parts


def _bytes(where, name: str, low: int, high: int, size: int) -> Iterator[bytes]:
    """A range of a file's bytes, unpacked, ``size`` at a time."""
    with where.open_input_stream(name, compression="gzip") if _packed(name) else where.open_input_file(name) as f:
        if _packed(name):
            skip = low
            while skip:
                skip -= len(f.read(min(skip, size)))
        else:
            f.seek(low)
        while low < high:
            data = f.read(min(high - low, size))
            if not data:
                raise EOFError(f"{name} ends before {high}")
            low += len(data)
            yield data


class BufferReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("bufferbytes", BUFFER_BYTES))
        self.most = int(options.get("maxbufferspertrigger", 1 << 40))
        self.at = 0
        self.unpacked: dict[tuple[str, int], int] = {}

    def _files(self) -> list[tuple[str, int]]:
        """(file, bytes sent) of the folder, in name order; a packed file is opened once."""
        from pyarrow import fs
        where, folder = _store(self.path)
        found = [f for f in where.get_file_info(fs.FileSelector(folder)) if f.is_file and not f.base_name.startswith(("_", "."))]
        for f in found:
            if _packed(f.path) and (f.path, f.size) not in self.unpacked:
                self.unpacked[f.path, f.size] = _unpacked(where, f.path, f.size)
        return sorted((f.path, self.unpacked.get((f.path, f.size), f.size)) for f in found)

    def initialOffset(self) -> dict:  # noqa: N802 - the interface's name
        return {"bytes": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        total = sum(n for _, n in self._files())
        # whole buffers only: one that is still being written waits
        self.at = max(self.at, min(total // self.size * self.size, self.at + self.most * self.size))
        return {"bytes": self.at}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.at = max(self.at, end["bytes"])
        step, files, first = SLICE_BUFFERS * self.size, [], 0
        for name, n in self._files():
            files.append((name, first, first + n))
            first += n
        slices, k = [], 0
        for a in range(start["bytes"], end["bytes"], step):
            b, parts = min(a + step, end["bytes"]), []
            while k < len(files) and files[k][2] <= a:
                k += 1
            for name, low, high in files[k:]:
                if low >= b:
                    break
                if high > low:
                    parts.append((name, max(a, low) - low, min(b, high) - low))
            slices.append(Slice(a, b, parts))
        return slices

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        where, _ = _store(self.path)
        rest, offset = b"", partition.start
        for name, low, high in partition.parts:
            for data in _bytes(where, name, low, high, 1000 * self.size):
                data = rest + data
                whole = len(data) // self.size * self.size
                rest = data[whole:]
                cut = [data[k:k + self.size] for k in range(0, whole, self.size)]
                if cut:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(offset, offset + whole, self.size), pa.int64()),
                         pa.array([c.decode("utf-8", "replace") for c in cut])], names=["offset", "value"])
                offset += whole


class BufferSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "buffers"

    def schema(self) -> str:
        return "offset long, value string"

    def streamReader(self, schema) -> BufferReader:  # noqa: N802
        return BufferReader(self.options)
