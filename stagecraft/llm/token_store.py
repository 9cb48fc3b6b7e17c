"""Token-ID output: independent zstandard frames with a trailing seek table.

A store is a folder of shards in ascending document order.  Shard ``x`` has two files of
the same form: ``x.ids.zst`` (token ids, little-endian uint32, nothing between documents)
and ``x.doc.zst`` (one 24-byte record per document: id, id-present flag, token count).
Each file is a row of independent zstandard frames followed by a skippable frame that
holds the seek table: per frame its compressed size, its decompressed size and the low
32 bits of the XXH64 of its content; then the frame count, a descriptor byte and the
seek-table magic.  Any zstandard tool decompresses a file from front to back, and
:class:`SeekReader` fetches a byte range by reading the footer and the frames it
overlaps only, verifying each frame's checksum.

Defined cases: a null or empty text gives the end id alone; an empty table gives no
shard and no row; a null ``doc_id`` sorts first; equal ids are ordered by the XXH64 of
their text, equal rows follow each other and each keeps its own row; other columns of
the input are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import document_columns, file_system, materialize, shuffle_partitions, slices, work_dir
from .library_ids import encode_rows

#: Fixed values of the seekable zstandard layout.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 256 << 10
DOC_RECORD = "<qqq"


class SeekWriter:
    """Appends bytes to a stream as independent frames of about ``frame_bytes``."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard
        self.stream, self.frame_bytes = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.parts: list[bytes] = []
        self.held = 0
        self.frames: list[tuple[int, int, int]] = []

    def write(self, data: bytes) -> None:
        """One document's bytes; a frame ends between documents unless one is longer than it."""
        if self.held and self.held + len(data) > self.frame_bytes:
            self._flush()
        for i in range(0, len(data), self.frame_bytes):
            part = data[i:i + self.frame_bytes] if len(data) > self.frame_bytes else data
            self.parts.append(part)
            self.held += len(part)
            if self.held >= self.frame_bytes:
                self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        import xxhash
        content = b"".join(self.parts)
        frame = self.packer.compress(content)
        self.stream.write(frame)
        self.frames.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.parts, self.held = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_TABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)


class SeekReader:
    """Random access to a file of :class:`SeekWriter`; decompresses only what is asked for."""

    def __init__(self, fs, path: str):
        import zstandard
        self.unpack = zstandard.ZstdDecompressor()
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_TABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"no seek table at the end of {path}")
        entries = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), dtype="<u4").reshape(n, 3)
        self.packed = np.concatenate([[0], np.cumsum(entries[:, 0], dtype=np.int64)])
        self.plain = np.concatenate([[0], np.cumsum(entries[:, 1], dtype=np.int64)])
        self.sums = entries[:, 2]
        self.size = int(self.plain[-1])
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        import xxhash
        a, b = int(self.packed[k]), int(self.packed[k + 1])
        content = self.unpack.decompress(self.file.read_at(b - a, a))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.sums[k]):
            raise ValueError(f"checksum of frame {k} does not match")
        self.frames_read += 1
        return content

    def read(self, offset: int, length: int) -> bytes:
        if length <= 0:
            return b""
        k = bisect_right(self.plain, offset) - 1
        out, need, skip = [], length, offset - int(self.plain[k])
        while need > 0:
            part = self.frame(k)[skip:skip + need]
            out.append(part)
            need -= len(part)
            skip, k = 0, k + 1
        return b"".join(out)

    def close(self) -> None:
        self.file.close()


class Cursor:
    """Consecutive pieces of a file's content; each frame is decompressed once."""

    def __init__(self, reader: SeekReader):
        self.reader, self.held, self.at, self.k = reader, b"", 0, 0

    def take(self, size: int) -> bytes:
        parts = []
        while size > len(self.held) - self.at:
            parts.append(self.held[self.at:])
            size -= len(parts[-1])
            self.held, self.at, self.k = self.reader.frame(self.k), 0, self.k + 1
        parts.append(self.held[self.at:self.at + size])
        self.at += size
        return b"".join(parts)


MANIFEST = "shard int, path string, n_docs long, n_ids long, stored_bytes long"


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None,
                shards: int | None = None) -> DataFrame:
    """Encode every text and write it, in ascending ``doc_id`` order, below ``folder``.

    Returns the manifest (one row per shard, materialised).  A task writes its shard
    under a name of its own attempt and the manifest names the attempts that counted, so
    a retried or speculative task does no harm.
    """
    spark = docs.sparkSession
    rows = document_columns(docs).withColumn("tie", F.xxhash64("text"))
    n = shards or shuffle_partitions(spark)
    dealt = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches):
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        streams = []
        for batch in slices(batches, 512):
            if not streams:
                streams = [fs.open_output_stream(f"{base}/{name}.{x}.zst", compression=None) for x in ("ids", "doc")]
                ids_out, doc_out = SeekWriter(streams[0]), SeekWriter(streams[1])
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, encode_rows(tokenizer, batch.column(1).to_pylist())):
                ids_out.write(ids + tail)
                count = (len(ids) + len(tail)) // 4
                doc_out.write(struct.pack(DOC_RECORD, key or 0, key is not None, count))
                n_docs += 1
                n_ids += count
        if streams:
            ids_out.close()
            doc_out.close()
            size = sum(s.tell() for s in streams)
            for s in streams:
                s.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"],
                "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64()),
                "stored_bytes": pa.array([size], pa.int64())})

    return materialize(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")


def open_shard(path: str) -> tuple[SeekReader, SeekReader]:
    fs, base = file_system(path)
    return SeekReader(fs, f"{base}.ids.zst"), SeekReader(fs, f"{base}.doc.zst")


def read_store(manifest: DataFrame) -> DataFrame:
    """Read all shards back: one row per document with the position and crc32 of its ids."""
    spark = manifest.sparkSession
    # one row per shard: the running total over shards is a window of as many rows
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids, docs = open_shard(path)
                cursor = Cursor(ids)
                for k in range(len(docs.plain) - 1):
                    rec = np.frombuffer(docs.frame(k), dtype="<i8").reshape(-1, 3)
                    crcs = [zlib.crc32(cursor.take(n)) for n in (4 * rec[:, 2]).tolist()]
                    starts = start + np.cumsum(rec[:, 2]) - rec[:, 2]
                    start += int(rec[:, 2].sum())
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(rec[:, 0], pa.int64(), mask=rec[:, 1] == 0),
                        "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(rec[:, 2], pa.int64()),
                        "ids_crc32": pa.array(crcs, pa.int64())})
                ids.close()
                docs.close()

    n = shuffle_partitions(spark)
    return (shards.repartitionByRange(n, "shard")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of the documents whose ``doc_id`` is in ``wanted``: (doc_id, ids array<long>).

    Only the frames that hold a wanted document are decompressed.  The shards' document
    records are read first and joined with ``wanted``.
    """
    def locate(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                ids, docs = open_shard(path)
                at = 0
                for k in range(len(docs.plain) - 1):
                    rec = np.frombuffer(docs.frame(k), dtype="<i8").reshape(-1, 3)
                    offs = at + 4 * (np.cumsum(rec[:, 2]) - rec[:, 2])
                    at += int(4 * rec[:, 2].sum())
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(rec[:, 0], pa.int64(), mask=rec[:, 1] == 0),
                        "path": pa.array([path] * len(rec), pa.string()), "at": pa.array(offs, pa.int64()),
                        "size": pa.array(4 * rec[:, 2], pa.int64())})
                ids.close()
                docs.close()

    def fetch(batches):
        readers: dict = {}
        for batch in batches:
            out = []
            for path, at, size in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if path not in readers:
                    for r in readers.values():
                        r.close()
                    fs, base = file_system(path)
                    readers = {path: SeekReader(fs, f"{base}.ids.zst")}
                out.append(np.frombuffer(readers[path].read(at, size), dtype="<u4").astype(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0),
                                              "ids": pa.array(out, pa.list_(pa.int64()))})

    n = shuffle_partitions(manifest.sparkSession)
    where = (manifest.select("path").repartitionByRange(n, "path")
             .mapInArrow(locate, "doc_id long, path string, at long, size long"))
    keys = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    hits = where.join(keys, "doc_id", "left_semi").select("doc_id", "path", "at", "size")
    return (hits.repartitionByRange(n, "path", "at").sortWithinPartitions("path", "at")
            .mapInArrow(fetch, "doc_id long, ids array<long>"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids (byte-level vocabulary, end id 2) and read them back."""
    from .library_ids import tokenizer_path
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_store(docs, work_dir(spark, "token-store"),
                           tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_store(manifest)
