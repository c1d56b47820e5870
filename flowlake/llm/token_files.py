"""Token files: independent zstandard frames, a document table and a trailing seek table.

A shard is a sequence of zstandard frames, each with its own content checksum, followed by a
skippable frame with the document table and a skippable frame with the seek table in the public
layout of the seekable format (sizes and the low half of the xxh64 of every frame's content), so
that any zstandard tool can read the ids and a reader of some documents decompresses only the
frames that hold them. The document table's frame stands in the seek table too, with no content.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_path, scratch_path, small_batches, table
from .tokens import encoder, ids_crc32, slabs, tokenizer_text

# Fixed values of the seekable zstandard layout: skippable frame magics, footer magic, checksum flag.
SEEK_FRAME, DOCS_FRAME, FOOTER, HAS_CHECKSUM = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80

FRAME_BYTES = 1 << 18
#: A task begins a new shard beyond so many bytes of ids or documents, and reads documents in batches of so many.
SHARD_BYTES, SHARD_DOCS, READ_DOCS = 1 << 28, 1 << 20, 1 << 13
SHARD_SCHEMA = "task int, shard int, path string, n_docs long, n_tokens long, n_bytes long"


def frame_checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class ShardWriter:
    """Writes documents to a stream; holds one frame and the document table (17 bytes a document)."""

    def __init__(self, out, dtype: np.dtype, frame_bytes: int = FRAME_BYTES):
        self.out, self.dtype, self.frame_bytes = out, dtype, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.waiting, self.held, self.frames = [], 0, []
        self.known, self.ids, self.lengths, self.n_tokens, self.n_bytes = array("B"), array("q"), array("Q"), 0, 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def _frame(self) -> None:
        raw = b"".join(self.waiting)
        data = self.zip.compress(raw)
        self.frames.append((len(data), len(raw), frame_checksum(raw)))
        self._put(data)
        self.waiting, self.held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = memoryview(np.ascontiguousarray(ids, self.dtype)).cast("B")
        self.known.append(doc_id is not None)
        self.ids.append(doc_id or 0)
        self.lengths.append(len(ids))
        self.n_tokens += len(ids)
        while self.held + len(raw) > self.frame_bytes:  # long documents go on in the next frames
            room = self.frame_bytes - self.held if len(raw) > self.frame_bytes else 0
            if room:
                self.waiting.append(bytes(raw[:room]))
                self.held, raw = self.held + room, raw[room:]
            self._frame()
        self.waiting.append(bytes(raw))
        self.held += len(raw)

    def full(self) -> bool:
        return self.n_tokens * self.dtype.itemsize >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def close(self) -> None:
        if self.held:
            self._frame()
        n = len(self.ids)
        columns = (np.frombuffer(x, t).astype(t) for x, t in ((self.known, "u1"), (self.ids, "<i8"), (self.lengths, "<u8")))
        docs = self.zip.compress(b"".join(c.tobytes() for c in columns) if n else b"")
        body = struct.pack("<QI", n, self.dtype.itemsize) + docs
        self._put(struct.pack("<II", DOCS_FRAME, len(body)) + body)
        self.frames.append((len(body) + 8, 0, frame_checksum(b"")))
        rows = np.array(self.frames, "<u4").tobytes()
        self._put(struct.pack("<II", SEEK_FRAME, len(rows) + 9) + rows + struct.pack("<IBI", len(self.frames), HAS_CHECKSUM, FOOTER))


class ShardReader:
    """Reads a shard from a seekable file: documents in order, or only those asked for."""

    def __init__(self, f):
        self.f = f
        f.seek(f.size() - 9)
        n, flag, magic = struct.unpack("<IBI", f.read(9))
        if magic != FOOTER or flag != HAS_CHECKSUM:
            raise ValueError("not a token shard")
        seek_at = f.size() - 9 - 12 * n - 8
        f.seek(seek_at)
        kind, size = struct.unpack("<II", f.read(8))
        if kind != SEEK_FRAME or size != 12 * n + 9:
            raise ValueError("broken seek table")
        self.frames = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        self.raw_at = np.concatenate(([0], np.cumsum(self.frames[:, 1])))
        f.seek(int(self.at[-2]))  # the last frame is the document table's
        kind, size = struct.unpack("<II", f.read(8))
        if kind != DOCS_FRAME or self.at[-2] + 8 + size != self.at[-1] or self.at[-1] != seek_at:
            raise ValueError("broken document table")
        body = f.read(size)
        n_docs, width = struct.unpack("<QI", body[:12])
        self.dtype = np.dtype(f"<u{width}")
        docs = zstandard.ZstdDecompressor().decompress(body[12:])
        known = np.frombuffer(docs, np.uint8, n_docs)
        self.doc_ids = pa.array(np.frombuffer(docs, "<i8", n_docs, n_docs), mask=known == 0)
        self.lengths = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.unzip = zstandard.ZstdDecompressor()
        self.held, self.raw, self.opened = -1, b"", 0

    def _frame(self, k: int) -> bytes:
        if k != self.held:
            self.f.seek(int(self.at[k]))
            raw = self.unzip.decompress(self.f.read(int(self.frames[k, 0])))
            if len(raw) != self.frames[k, 1] or frame_checksum(raw) != self.frames[k, 2]:
                raise ValueError(f"frame {k} fails its checksum")
            self.held, self.raw, self.opened = k, raw, self.opened + 1
        return self.raw

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only the frames that hold it are decompressed."""
        width = self.dtype.itemsize
        first, last = int(self.starts[k]) * width, int(self.starts[k + 1]) * width
        parts, frame = [], int(np.searchsorted(self.raw_at, first, "right")) - 1
        while first < last:
            raw, base = self._frame(frame), int(self.raw_at[frame])
            part = raw[first - base : last - base]
            parts.append(part)
            first, frame = first + len(part), frame + 1
        return np.frombuffer(b"".join(parts), self.dtype)

    def find(self, doc_ids) -> dict[int, list[np.ndarray]]:
        """Ids of the documents asked for; a repeated doc_id has several entries."""
        out: dict[int, list[np.ndarray]] = {}
        for k in np.flatnonzero(pc.is_in(self.doc_ids, value_set=pa.array(set(doc_ids), pa.int64()))):
            out.setdefault(self.doc_ids[int(k)].as_py(), []).append(self.document(int(k)))
        return out


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, tasks: int | None = None) -> DataFrame:
    """Encodes every whole text and writes shards in ascending doc_id order; one row per shard.

    Rows: task and shard (their order is that of the documents), path, n_docs, n_tokens, n_bytes. A
    shard ends at SHARD_BYTES or SHARD_DOCS, so its size doesn't follow the number of ``tasks``. Null
    texts are empty (only the end id), null doc_ids come first, rows with equal doc_id stand in the
    order of their text's hash. Every attempt of a task writes files of its own and the rows name
    those that count, so a lost executor leaves no half-written shard behind. ``path`` is a folder
    that all executors reach.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(tasks, F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie)
    types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]

    def run(batches):
        enc, task, out, writer, rows = encoder(spec.value), TaskContext.get(), None, None, []
        fs, local = pafs.FileSystem.from_uri(path)

        def begin():
            nonlocal out, writer
            name = f"shard-{task.partitionId():06d}-{len(rows):04d}-{task.taskAttemptId()}.tok"
            fs.create_dir(local, recursive=True)
            out = fs.open_output_stream(f"{local}/{name}")
            writer = ShardWriter(out, enc.dtype)
            rows.append([task.partitionId(), len(rows), f"{path}/{name}"])

        def end():
            nonlocal writer
            writer.close()
            out.close()
            rows[-1] += [len(writer.ids), writer.n_tokens, writer.n_bytes]
            writer = None

        for b in batches:
            for part in slabs(b):
                ids, lengths = enc.encode_all(part.column(1), end_id)
                ends = np.cumsum(lengths)
                for doc_id, start, stop in zip(part.column(0).to_pylist(), (ends - lengths).tolist(), ends.tolist()):
                    if writer is None:
                        begin()
                    writer.add(doc_id, ids[start:stop])
                    if writer.full():
                        end()
        if writer:
            end()
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        pa.default_memory_pool().release_unused()

    return d.mapInArrow(run, SHARD_SCHEMA)


def read_token_files(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the shards, from their files.

    start counts the ids of all documents before it; the shards' own totals give each its base.
    """
    spark = shards.sparkSession
    before = Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row per shard
    based = shards.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                fs, local = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(local) as f:
                    r = ShardReader(f)
                    for at in range(0, len(r.lengths), READ_DOCS):
                        some = slice(at, min(at + READ_DOCS, len(r.lengths)))
                        crc = [ids_crc32(r.document(k)) for k in range(some.start, some.stop)]
                        columns = [r.doc_ids[some], pa.array(r.starts[some] + base), pa.array(r.lengths[some]), pa.array(crc, pa.int64())]
                        yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes ``docs`` as token files in the shared folder and returns what the files hold, per document.

    Empty tables give no shards and no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    with small_batches(spark):
        shards, at = table(write_token_files(docs, folder, tokenizer_path, end_id), "token-shards")
    found = table(read_token_files(shards), "token-rows")[0]
    delete_path(spark, folder)
    delete_path(spark, at)
    return found
