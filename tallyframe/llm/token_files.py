"""Token ids in seekable compressed files, one zstandard frame a document.

A file is a run of independent frames, a skippable frame with the document ids,
and, last, the seek table of the zstandard seekable format: per frame its
compressed size, its size, and the low 32 bits of the XXH64 of its content. A
reader finds the table from the end of the file, and reads and decompresses only
the frames of the documents it was asked for, checking each against its checksum.

Files hold ascending document ids, and later files later ones. A task writes its
file under a name of its own, so a repeated task leaves no half-written file that
counts: only files in the returned manifest do. Files go through pyarrow's
filesystems, to the folder that the cluster shares. Memory is bounded by one
batch of documents and 20 bytes a document of the file.

NULL text is empty and has the end id alone. NULL ids come first. Documents with
one id are ordered by the hash of their text.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.batches import slices
from tallyframe.llm.tokens import TEXTS, Encoder
from tallyframe.storage import fresh_path, stage

#: Fixed values of the zstandard frame and seekable formats.
SEEK_TABLE_MAGIC = 0x184D2A5E
DOC_INDEX_MAGIC = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
NO_ID = -(1 << 63)

MANIFEST = "shard int, path string, n_docs long, n_ids long, first_id long, last_id long"


class Damaged(Exception):
    """A frame or table that does not match its checksum or format."""


class Writer:
    """Frames of one file, then its tables on close."""

    def __init__(self, out, level: int = 1):
        import zstandard

        self.out, self.z = out, zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.table, self.ids = bytearray(), bytearray()
        self.n = 0
        self.first = self.last = None

    def add(self, doc_id: int | None, content: bytes) -> None:
        import xxhash

        frame = self.z.compress(content)
        self.out.write(frame)
        self.table += struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        self.ids += struct.pack("<q", NO_ID if doc_id is None else doc_id)
        self.n += 1
        if doc_id is not None:
            self.first, self.last = doc_id if self.first is None else self.first, doc_id

    def close(self) -> None:
        self.out.write(struct.pack("<II", DOC_INDEX_MAGIC, len(self.ids)) + self.ids)
        #: The table also describes the index, as a frame without content, so that sizes add up to its own place.
        self.table += struct.pack("<III", len(self.ids) + 8, 0, 0)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(self.table) + 9) + self.table + struct.pack("<IBI", self.n + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC))


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source, end = source, source.size()
        n, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise Damaged("no seek table with checksums")
        table = self._read(end - 9 - 12 * n - 8, 12 * n + 8)
        if struct.unpack_from("<II", table) != (SEEK_TABLE_MAGIC, 12 * n + 9):
            raise Damaged("bad seek table")
        self.frames, at = [], 0
        for packed, size, check in struct.iter_unpack("<III", memoryview(table)[8:]):
            self.frames.append((at, packed, size, check))
            at += packed
        at, packed, _, _ = self.frames.pop()
        index = self._read(at, packed)
        if struct.unpack_from("<II", index) != (DOC_INDEX_MAGIC, packed - 8):
            raise Damaged("bad document index")
        self.ids = [None if i == NO_ID else i for (i,) in struct.iter_unpack("<q", memoryview(index)[8:])]

    def _read(self, at: int, n: int) -> bytes:
        return self.source.read_at(n, at)

    def document(self, k: int) -> bytes:
        """The content of the k-th document of the file."""
        import xxhash
        import zstandard

        at, packed, size, check = self.frames[k]
        content = zstandard.ZstdDecompressor().decompress(self._read(at, packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise Damaged(f"document {self.ids[k]} fails its checksum")
        return content


def open_file(path: str) -> Reader:
    system, inner = fs.FileSystem.from_uri(path)
    return Reader(system.open_input_file(inner))


def write_files(docs: DataFrame, folder: str | None = None, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, doc_id: str = "doc_id", text: str = "text", level: int = 1) -> DataFrame:
    """Encode and write all documents; returns the manifest (shard, path, n_docs, n_ids, first_id, last_id), shards in document order."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = Encoder.of(vocabulary), TaskContext.get().partitionId()
        path, writer, n_ids, out = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.zst", None, 0, None
        for batch in batches:
            for part in slices(batch, 1, TEXTS):
                for d, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    if writer is None:
                        system, inner = fs.FileSystem.from_uri(path)
                        system.create_dir(inner.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(inner, compression=None)  # the name would choose one
                        writer = Writer(out, level)
                    writer.add(d, ids + end)
                    n_ids += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), *(pa.array([x], pa.int64()) for x in (writer.n, n_ids, writer.first, writer.last))], ["shard", "path", "n_docs", "n_ids", "first_id", "last_id"])

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    ordered = rows.repartitionByRange(F.col("d").asc_nulls_first(), "h").sortWithinPartitions(F.col("d").asc_nulls_first(), "h").select("d", "t")
    return stage(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest plus the number of ids before each file; one row a file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = open_file(path)
                for k in range(0, len(reader.ids), 8192):
                    ids = reader.ids[k : k + 8192]
                    rows = []
                    for j, d in enumerate(ids, k):
                        content = reader.document(j)
                        rows.append((d, start, len(content) // 4, zlib.crc32(content)))
                        start += len(content) // 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return with_starts(manifest).select("path", "start").repartition(files).mapInArrow(read, schema)


def read_documents(spark: SparkSession, manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[int]]:
    """The ids of the few documents asked for. Only files whose range holds one are opened, and no other frame is decompressed.

    Of documents with one id the last one counts.
    """
    wanted, found = sorted(set(doc_ids)), {}
    if not wanted:
        return found
    near = manifest.filter((F.col("first_id") <= wanted[-1]) & (F.col("last_id") >= wanted[0])).orderBy("shard")
    for row in near.select("path", "first_id", "last_id").toLocalIterator():
        some = set(wanted[bisect_left(wanted, row["first_id"]) : bisect_right(wanted, row["last_id"])])
        if some:
            reader = open_file(row["path"])
            for k, d in enumerate(reader.ids):
                if d in some:
                    content = reader.document(k)
                    found[d] = list(struct.unpack(f"<{len(content) // 4}I", content))
    return found
