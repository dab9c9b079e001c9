"""Token-ID shards: one zstandard frame a document, a seek table at the end.

A shard is a sequence of independent frames: a skippable one with a JSON
header, one with the little-endian token ids of each document, a skippable one
with the doc_ids and a bit for each that is null, and the seek table of the public seekable format (sizes and
the low 32 bits of XXH64 of every frame's content). A reader takes the table
from the file's end and decompresses the documents that it is asked for.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .columns import narrow
from .kernels import slices
from .lm_scoring import VOCABULARY, token_ids, tokenizer
from .scratch import small_batches

LEVEL = 3
#: A shard is closed at so many compressed bytes or documents, so that none outgrows a task's memory.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16

HEADER_MAGIC, IDS_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1


class CorruptShard(ValueError):
    """A shard whose table or content fails its checksum or bounds."""


class ShardBuilder:
    """Collects frames of one shard."""

    def __init__(self, dtype: str, name: str):
        self.dtype = np.dtype(dtype)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.tokens = self.size = 0
        self._skippable(HEADER_MAGIC, json.dumps({"dtype": self.dtype.str, "tokenizer": name}).encode())

    def _skippable(self, magic: int, content: bytes) -> None:
        self._put(struct.pack("<II", magic, len(content)) + content, 0, 0)

    def _put(self, frame: bytes, size: int, check: int) -> None:
        self.frames.append(frame)
        self.entries.append((len(frame), size, check))
        self.size += len(frame)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.dtype).tobytes()
        self._put(self.compressor.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.ids.append(doc_id)
        self.tokens += len(ids)

    def finish(self) -> bytes:
        missing = np.array([i is None for i in self.ids], bool)
        self._skippable(IDS_MAGIC, np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.packbits(missing).tobytes())
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        table += struct.pack("<IBI", len(self.entries), 0x80, FOOTER_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SEEK_MAGIC, len(table)) + table


class ShardReader:
    """Random access to a shard's documents; ``source`` is its bytes or an open binary file."""

    def __init__(self, source):
        if isinstance(source, bytes | bytearray | memoryview):
            import io

            source = io.BytesIO(source)
        self.file = source
        end = source.seek(0, os.SEEK_END)
        if end < 17:
            raise CorruptShard("shorter than a seek table")
        count, descriptor, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        size = count * 12 + 9
        if magic != FOOTER_MAGIC or descriptor != 0x80 or size + 8 > end or struct.unpack("<II", self._read(end - size - 8, 8)) != (SEEK_MAGIC, size):
            raise CorruptShard("no seek table")
        table = np.frombuffer(self._read(end - size, size - 9), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.checks = table[:, :2], table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        if count < 2 or self.starts[-1] != end - size - 8:
            raise CorruptShard("the table doesn't fit the frames")
        header = json.loads(self._skipped(0, HEADER_MAGIC))
        self.dtype, self.tokenizer = np.dtype(header["dtype"]), header["tokenizer"]
        n, ids = count - 2, self._skipped(count - 1, IDS_MAGIC)
        if len(ids) != 8 * n + -(-n // 8):
            raise CorruptShard("the ids don't fit the frames")
        missing = np.unpackbits(np.frombuffer(ids, np.uint8, offset=8 * n), count=n)
        self.doc_ids = [None if gone else int(i) for i, gone in zip(np.frombuffer(ids, "<i8", n), missing, strict=True)]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _skipped(self, k: int, magic: int) -> bytes:
        frame = self._read(int(self.starts[k]), int(self.sizes[k, 0]))
        if struct.unpack("<II", frame[:8]) != (magic, len(frame) - 8):
            raise CorruptShard("a header is damaged")
        return frame[8:]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def tokens(self, k: int) -> np.ndarray:
        """Token ids of the ``k``-th document; no other frame is read."""
        frame = self._read(int(self.starts[k + 1]), int(self.sizes[k + 1, 0]))
        try:
            raw = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(self.sizes[k + 1, 1]) or 1)
        except zstandard.ZstdError as e:
            raise CorruptShard(str(e)) from None
        if len(raw) != self.sizes[k + 1, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k + 1]:
            raise CorruptShard(f"frame {k} fails its checksum")
        return np.frombuffer(raw, self.dtype)


SCHEMA = "shard string, n_docs long, n_tokens long, doc_ids array<long>, data binary"


def shards(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(shard, n_docs, n_tokens, doc_ids, data)``: the corpus' token ids as seekable shards.

    Every row of ``docs`` is one frame, in the order of its partition: a null or
    empty text is a frame of no tokens, repeated rows are frames each, a null
    doc_id is null again in ``doc_ids``. No documents: no shards. Other columns
    aren't read, whatever their names. Nothing is shuffled, and a task that is run again makes the same
    shards of the same names.
    """
    small_batches(docs.sparkSession)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokenizer(vocabulary)
        dtype = "<u2" if enc.n_vocab <= 1 << 16 else "<u4"
        part, number, now = TaskContext.get().partitionId(), 0, None

        def close() -> pa.RecordBatch:
            columns = [pa.array([f"{part:06d}-{number:06d}"]), pa.array([len(now.ids)], pa.int64()), pa.array([now.tokens], pa.int64()), pa.array([now.ids], pa.list_(pa.int64())), pa.array([now.finish()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "n_docs", "n_tokens", "doc_ids", "data"])

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    now = now or ShardBuilder(dtype, name)
                    now.add(doc_id, token_ids(enc, text or ""))
                    if now.size >= SHARD_BYTES or len(now.ids) >= SHARD_DOCS:
                        yield close()
                        number, now = number + 1, None
        if now:
            yield close()

    return narrow(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def write_shards(table: DataFrame, folder: str) -> None:
    """Each shard as ``folder/<shard>.zst``, by rename; ``folder`` is a path or URI of a file system that all executors reach."""

    def run(rows) -> None:
        from pyarrow.fs import FileSystem

        files, root = FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for row in rows:
            path = f"{root}/{row.shard}.zst"
            temporary = f"{path}.{os.getpid()}.tmp"
            with files.open_output_stream(temporary) as f:
                f.write(row.data)
            files.move(temporary, path)

    table.select("shard", "data").foreachPartition(run)
