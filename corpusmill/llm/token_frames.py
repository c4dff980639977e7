"""Token ids in files of independent Zstandard frames with a trailing seek table.

File layout (the public Zstandard seekable format, so any Zstandard tool reads the stream of ids):

    frame of document 0 | frame of document 1 | ... | skippable frame: document index | skippable frame: seek table

- A document's frame decompresses to its ids as little-endian unsigned 32-bit integers and needs no other frame.
- Seek table: per frame compressed size, decompressed size and the low 32 bits of the XXH64 of the decompressed bytes; then the number
  of frames, a descriptor byte with the checksum flag, and the magic number of the seek table.
- Document index: one frame (compressed, inside a skippable one) of doc_ids as little-endian signed 64-bit integers, with a bitmap of null ids behind
  them. Its seek table row has decompressed size 0, as for any skippable frame.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusmill.llm.common import bounded_batches, shared_folder, slices, stage
from corpusmill.llm.tokens import default_tokenizer_path, encode_documents, shared_encoder

# Fixed values of the public format.
SKIPPABLE, INDEX_MAGIC, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80


def file_system(path: str):
    """(Arrow file system, path in it) of a URI or an absolute path; used inside tasks, where no JVM is at hand."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class FrameWriter:
    """Appends one document after the other to an open binary file; holds 20 bytes per document until it is closed."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.level = out, level
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False)
        self.sizes: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []

    def add(self, doc_id: int | None, payload: bytes) -> None:
        from xxhash import xxh64_intdigest

        frame = self.compressor.compress(payload)
        self.out.write(frame)
        self.sizes.append((len(frame), len(payload), xxh64_intdigest(payload) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)

    def close(self) -> None:
        numbers = np.array([i or 0 for i in self.doc_ids], "<i8").tobytes() + np.packbits([i is None for i in self.doc_ids]).tobytes()
        index = self.compressor.compress(numbers)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array([*self.sizes, (len(index) + 8, 0, 0)], "<u4").tobytes()
        footer = struct.pack("<IBI", len(self.sizes) + 1, CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Random access to a file of frames; only the frames asked for are read and decompressed."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._read(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        ends = np.cumsum(table[:, 0])
        if ends[-1] + 8 + 12 * frames + 9 != size:
            raise ValueError("the seek table does not cover the file")
        self.starts, self.table = (ends - table[:, 0])[:-1], table[:-1]
        index = self.decompressor.decompress(self._read(int(ends[-2]) + 8 if frames > 1 else 8, int(table[-1, 0]) - 8))
        self.count = frames - 1
        self.doc_ids = np.frombuffer(index[: 8 * self.count], "<i8")
        self.nameless = np.unpackbits(np.frombuffer(index[8 * self.count :], np.uint8))[: self.count].astype(bool)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def payload(self, k: int) -> bytes:
        from xxhash import xxh64_intdigest

        size, full, check = self.table[k].tolist()
        data = self.decompressor.decompress(self._read(int(self.starts[k]), size), max_output_size=full)
        if len(data) != full or xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def find(self, doc_id: int) -> list[int]:
        """Frames of a document; ids rise within a file."""
        named = np.flatnonzero(~self.nameless)
        low, high = np.searchsorted(self.doc_ids[named], [doc_id, doc_id + 1])
        return named[low:high].tolist()


def write_frames(
    docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", end_id: int = 2, tokenizer: str | None = None, level: int = 3,
    files: int | None = None,
) -> DataFrame:
    """Write the ids of all documents below `path`, in rising order of their id over the files; returns the manifest
    (file, part, first_id, last_id, n_docs, n_tokens, size), also written as Parquet beside the files.

    Documents are range-partitioned by id, so each task writes one file of neighbours while it reads, with memory for one batch. A
    file is written under a name of its attempt and then moved, so a task that runs again replaces its own result. Null
    texts are empty; null ids come first; rows with equal ids are ordered by a hash of their text; an empty table gives an empty manifest.
    """
    folder, tokenizer = path.rstrip("/"), tokenizer or default_tokenizer_path()
    manifest_schema = "file string, part int, first_id long, last_id long, n_docs long, n_tokens long, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, writer, tokens, encoder = context.partitionId(), None, 0, shared_encoder(tokenizer)
        system, base = file_system(folder)
        name = f"{base}/ids-{part:06d}.zst"
        attempt = f"{base}/.attempt-{part:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        out = None
        for batch in slices(batches, "text"):
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(attempt)
                writer = FrameWriter(out, level)
            ids, bounds = encode_documents(encoder, batch.column(1), end_id)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                writer.add(doc_id, ids[a:b].tobytes())
            tokens += len(ids)
        if out is not None:
            writer.close()
            size = out.tell()
            out.close()
            system.move(attempt, name)
            row = [f"{folder}/ids-{part:06d}.zst", part, writer.doc_ids[0], writer.doc_ids[-1], len(writer.doc_ids), tokens, size]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.string(), pa.int32(), *[pa.int64()] * 5])], names=[c.split()[0] for c in manifest_schema.split(", ")])

    bounded_batches()
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("digest"))
    # The driver samples the range keys, so they hold no text.
    ranged = narrow.repartitionByRange(files, "id", "digest") if files else narrow.repartitionByRange("id", "digest")
    ranged.sortWithinPartitions("id", "digest").mapInArrow(run, manifest_schema).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest_schema).parquet(f"{folder}/manifest")


def read_frames(manifest: DataFrame, doc_ids: list[int] | None = None, payloads: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files of a manifest, or of those asked for; with `payloads` also ids.

    start is the number of ids of all documents before, over all files. Every frame that is read is checked. For chosen documents
    only the files whose range holds one are opened, and only their frames decompressed; start then comes from the seek table's sizes.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(row["file"])
                with system.open_input_file(path) as source:
                    reader = FrameReader(source, row["size"])
                    lengths = reader.table[:, 1] // 4
                    starts = row["before"] + np.cumsum(lengths) - lengths
                    chosen = range(reader.count) if doc_ids is None else sorted(k for i in set(doc_ids) for k in reader.find(i))
                    for some in (chosen[a : a + 1024] for a in range(0, len(chosen), 1024)):
                        data = [reader.payload(k) for k in some]
                        columns = [pa.array([None if reader.nameless[k] else int(reader.doc_ids[k]) for k in some], pa.int64()), pa.array(starts[some]),
                                   pa.array(lengths[some]), pa.array([zlib.crc32(x) for x in data], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if payloads:
                            columns.append(pa.array(data, pa.binary()))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    # One row per file: a running sum over as many rows as there are files.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", "size", "part", "first_id", "last_id", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before"))
    if doc_ids is not None:
        files = files.where(F.exists(F.lit(sorted(doc_ids)) if doc_ids else F.array().cast("array<bigint>"), lambda i: (i <= F.col("last_id")) & (i >= F.coalesce(F.col("first_id"), i))))
    files = stage(files.select("file", "size", "before", "part"), "frame-files")
    wanted = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(max(wanted, files.count()), "part").drop("part").mapInArrow(run, schema)


def scratch_files(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-frames-{uuid.uuid4().hex}"
