"""Token-id files: independent zstandard frames with a trailing seek table and a checksum for each frame.

Layout of a shard (all integers little-endian)::

    frame 0 .. frame n-1   each an independent zstandard frame of whole documents' ids (unsigned 32 bit)
    frame n                the document index: doc_id, null flag, tokens, frame, first id within the frame
    seek table             zstandard skippable frame: per frame compressed size, size, low half of XXH64;
                           then the number of frames, the descriptor and the magic number

This is the public "seekable zstandard" layout, so any zstandard reader can decompress a shard from start to end, and
``ShardReader`` decompresses only the frames of the documents asked for.

Defined cases: a null text is an empty one (only the end id); a null doc_id sorts first; repeated doc_ids stay, ordered
by text; an empty table gives no shard and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, staged
from .tokens import default_vocabulary, encode_documents

# Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Ids in a frame before it is closed; a longer document has a frame of its own.
FRAME_IDS = 65_536
_INDEX = struct.Struct("<4sQ")
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def _open(uri: str, mode: str):
    """A file in any store that pyarrow reaches (local, HDFS, S3, ...); executors open only the shared folder with it."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_file(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # the name must not make it compress again


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    """Streams documents into one shard; holds one open frame and the index."""

    def __init__(self, out, level: int = 3, frame_ids: int = FRAME_IDS) -> None:
        import zstandard

        self.out, self.frame_ids = out, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.open_ids = self.n_tokens = self.n_bytes = 0
        self.docs: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.open_ids and self.open_ids + n > self.frame_ids:
            self._flush()
        self.docs.append((doc_id or 0, doc_id is None, n, len(self.entries), self.open_ids))
        self.open.append(ids)
        self.open_ids += n
        self.n_tokens += n

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.n_bytes += len(packed)
        self.entries.append((len(packed), len(data), _checksum(data)))

    def _flush(self) -> None:
        if self.open:
            self._frame(b"".join(self.open))
        self.open, self.open_ids = [], 0

    def close(self) -> None:
        self._flush()
        cols = list(zip(*self.docs, strict=True)) or [()] * 5
        kinds = ("<i8", "u1", "<u8", "<u4", "<u8")
        self._frame(_INDEX.pack(b"TIDX", len(self.docs)) + b"".join(np.asarray(c, dtype=k).tobytes() for c, k in zip(cols, kinds, strict=True)))
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        tail = struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table
        self.out.write(tail)
        self.n_bytes += len(tail)


class ShardReader:
    """Reads the seek table and the index; decompresses a frame only when one of its documents is asked for."""

    def __init__(self, file) -> None:
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        end = file.seek(0, 2) or file.tell()
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        file.seek(end - 9 - 12 * n)
        self.entries = np.frombuffer(file.read(12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        index = self.frame(n - 1)
        tag, m = _INDEX.unpack_from(index)
        if tag != b"TIDX":
            raise ValueError("no document index")
        at = _INDEX.size
        cols = []
        for kind in ("<i8", "u1", "<u8", "<u4", "<u8"):
            cols.append(np.frombuffer(index, dtype=kind, count=m, offset=at))
            at += cols[-1].nbytes
        self.doc_ids, self.nulls, self.n_tokens, self.frames, self.firsts = cols

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.at[k]))
        data = self.zstd.decompress(self.file.read(int(self.entries[k, 0])), max_output_size=int(self.entries[k, 1]))
        if len(data) != self.entries[k, 1] or _checksum(data) != self.entries[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order; one frame is held at a time."""
        k, data = -1, b""
        for doc_id, null, n, frame, first in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.n_tokens.tolist(), self.frames.tolist(), self.firsts.tolist(), strict=True):
            if frame != k:
                k, data = frame, self.frame(frame)
            yield (None if null else doc_id), data[4 * first : 4 * (first + n)]

    def get(self, doc_id: int) -> list[bytes]:
        """The ids of the documents with this doc_id, read from their frames only."""
        return [self.frame(int(self.frames[i]))[4 * int(self.firsts[i]) : 4 * int(self.firsts[i] + self.n_tokens[i])] for i in np.flatnonzero((self.doc_ids == doc_id) & (self.nulls == 0))]


def write_token_files(docs: DataFrame, out_dir: str, vocabulary: str | None = None, end_id: int = 0, level: int = 3, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order; returns the manifest, one row a shard.

    Range partitions are the shards, so order needs one shuffle and no global sort. A task writes its shard under a
    name of its own and reports it in the manifest, which is staged: a task that is run again after a lost executor
    leaves at most an unlisted file, never a half-read one.
    """
    vocabulary = vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, out, path = TaskContext.get().partitionId(), None, None, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                path = f"{out_dir}/shard-{shard:06d}-{uuid.uuid4().hex}.tok.zst"
                out = _open(path, "w")
                writer = ShardWriter(out, level, frame_ids)
            ids = encode_documents(vocabulary, batch.column("text").to_pylist(), end_id)
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                writer.add(doc_id, x)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": len(writer.docs), "n_tokens": writer.n_tokens, "n_bytes": writer.n_bytes}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read all shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"], "r") as f:
                    reader, start, out = ShardReader(f), row["base"], []
                    for doc_id, ids in reader.documents():
                        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), row["shard"]))
                        start += len(ids) // 4
                        if len(out) == 50_000:
                            yield _batch(out)
                            out = []
                    if out:
                        yield _batch(out)

    # One row a shard: the running total is over shards, not documents.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    based = manifest.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens"))
    return based.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def token_round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder in the shared store and read them back."""
    return read_token_files(write_token_files(docs, fresh_dir(spark, "token-files"), vocabulary))
