"""Token files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds consecutive documents::

    data frame 0 .. data frame k-1 | index frame | seek table

Each data frame is a zstandard frame of whole documents' ids as little-endian unsigned 32-bit integers. The
index frame holds the number of documents, their ids, the bounds of their tokens in the file, and the first document of each
data frame, as little-endian 64-bit integers. The seek table is the skippable frame of the public seekable format:
compressed size, size and checksum (the low 32 bits of XXH64 of the data) of every frame, then the number of
frames, a descriptor and a magic number. A reader takes the table from the end of the file, the index frame, and
then only the frames of the documents it was asked for; any zstandard tool can unpack the file as a whole.

Rows: a null text counts as empty and has the end id alone; rows with equal or null ids all keep their place (nulls
first); an empty table gives no file; further columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import only, stored
from tidemark.llm.pieces import encoded_slices
from tidemark.session import scratch_path

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
FOOTER, FOOTER_SIZE = "<IBI", 9
ENTRY, ENTRY_SIZE = "<III", 12

FRAME_TOKENS = 1 << 18
NO_ID = -(1 << 63)
MANIFEST = "path string, shard long, n_docs long, n_tokens long, n_bytes long"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path on it; a plain path is a local one."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class TokenFileWriter:
    """Writes documents one by one; holds one frame's ids and the index at a time."""

    def __init__(self, sink, frame_tokens: int = FRAME_TOKENS, level: int = 1):
        self.sink, self.frame_tokens = sink, frame_tokens
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.bounds = [0]
        self.frame_docs = [0]
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.n_bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.bounds.append(self.bounds[-1] + len(ids))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.frame_tokens:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            self._frame(np.concatenate(self.pending).astype("<u4").tobytes())
            self.frame_docs.append(len(self.doc_ids))
            self.pending, self.waiting = [], 0

    def _frame(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.sink.write(packed)
        self.n_bytes += len(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        head = [len(self.doc_ids), len(self.frame_docs)]
        self._frame(np.array(head + self.doc_ids + self.bounds + self.frame_docs, "<i8").tobytes())
        body = b"".join(struct.pack(ENTRY, *e) for e in self.table) + struct.pack(FOOTER, len(self.table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        tail = struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body
        self.sink.write(tail)
        self.n_bytes += len(tail)


class TokenFileReader:
    """Reads single documents of a file; ``frames_read`` counts the data frames it has unpacked."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flags, magic = struct.unpack(FOOTER, self._at(size - FOOTER_SIZE, FOOTER_SIZE))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no token file: its end holds no seek table")
        entries = self._at(size - FOOTER_SIZE - count * ENTRY_SIZE, count * ENTRY_SIZE)
        self.table = [struct.unpack_from(ENTRY, entries, i * ENTRY_SIZE) for i in range(count)]
        self.places = np.concatenate([[0], np.cumsum([e[0] for e in self.table])]).astype(np.int64)
        self.frames_read = 0
        index = np.frombuffer(self._unpack(count - 1), "<i8")
        docs, frames = int(index[0]), int(index[1])
        self.doc_ids = index[2 : 2 + docs]
        self.bounds = index[2 + docs : 3 + 2 * docs]
        self.frame_docs = index[3 + 2 * docs : 3 + 2 * docs + frames]

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def _unpack(self, frame: int) -> bytes:
        packed, size, check = self.table[frame]
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[frame]), packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {frame} is damaged: its checksum differs")
        return data

    def frame(self, number: int) -> Iterator[tuple[int, np.ndarray]]:
        """Places of a data frame's documents in the file, with their ids."""
        self.frames_read += 1
        ids = np.frombuffer(self._unpack(number), "<u4")
        first, stop = int(self.frame_docs[number]), int(self.frame_docs[number + 1])
        base = int(self.bounds[first])
        for k in range(first, stop):
            yield k, ids[int(self.bounds[k]) - base : int(self.bounds[k + 1]) - base]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in their order."""
        for number in range(len(self.frame_docs) - 1):
            yield from self.frame(number)

    def read(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of the wanted documents; frames without any are not touched."""
        places = np.flatnonzero(np.isin(self.doc_ids, np.fromiter(wanted, np.int64)))
        for number in np.unique(np.searchsorted(self.frame_docs, places, side="right") - 1):
            for k, ids in self.frame(int(number)):
                if k in places:
                    yield int(self.doc_ids[k]), ids


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, text_specials: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them below ``folder`` (a URI all executors reach) in ascending doc_id order.

    Returns the manifest, itself stored: one row for each file in the order of its documents, with ``first_token``, the
    number of ids in all files before it. A task tried again writes a file of another name; only files of the manifest count.
    """

    def write(batches):
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        name = f"{place.rstrip('/')}/{uuid.uuid4().hex}.tok"
        writer = sink = None
        shard = 0
        for batch, ids, bounds in encoded_slices(batches, tokenizer_path, end_id, text_specials):
            if writer is None:
                sink = system.open_output_stream(name)
                writer = TokenFileWriter(sink)
                shard = batch.column("shard")[0].as_py()
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                writer.add(doc_id, ids[bounds[k] : bounds[k + 1]])
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [name],
                    "shard": [shard],
                    "n_docs": [len(writer.doc_ids)],
                    "n_tokens": [writer.bounds[-1]],
                    "n_bytes": [writer.n_bytes],
                }
            )

    ordered = only(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(ordered.withColumn("shard", F.spark_partition_id().cast("long")).mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Documents of the manifest's files: doc_id, start (ids of all documents before it) and ids.

    ``wanted`` names doc_ids (a list held in the plan); then only frames that hold one of them are unpacked.
    """

    def read(batches):
        system, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as source:
                    reader = TokenFileReader(source)
                    frames = range(len(reader.frame_docs) - 1)
                    if wanted is not None:
                        places = np.flatnonzero(np.isin(reader.doc_ids, np.array(wanted, np.int64)))
                        frames = np.unique(np.searchsorted(reader.frame_docs, places, side="right") - 1)
                    for number in frames:
                        found = [(k, ids) for k, ids in reader.frame(int(number)) if wanted is None or k in places]
                        doc_ids = [int(reader.doc_ids[k]) for k, _ in found]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([None if d == NO_ID else d for d in doc_ids], pa.int64()),
                                pa.array([row["first_token"] + int(reader.bounds[k]) for k, _ in found], pa.int64()),
                                pa.ListArray.from_arrays(
                                    pa.array(np.concatenate([[0], np.cumsum([len(x) for _, x in found])]), pa.int32()),
                                    pa.array(np.concatenate([x for _, x in found]).astype(np.int64), pa.int64()),
                                ),
                            ],
                            names=["doc_id", "start", "ids"],
                        )

    spread = manifest.select("path", "first_token").repartition("path")
    return spread.mapInArrow(read, "doc_id long, start long, ids array<long>")


def token_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """For each document, read back from the files: doc_id, start, n_tokens and the crc32 of its ids as they lie there."""

    def digest(batches):
        system, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as source:
                    reader = TokenFileReader(source)
                    crcs = [zlib.crc32(np.ascontiguousarray(ids, "<u4")) for _, ids in reader.documents()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.doc_ids, pa.int64(), mask=reader.doc_ids == NO_ID),
                            pa.array(row["first_token"] + reader.bounds[:-1], pa.int64()),
                            pa.array(np.diff(reader.bounds), pa.int64()),
                            pa.array(crcs, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.select("path", "first_token").repartition("path")
    return spread.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files below the shared folder."""
    return scratch_path(spark, "tokens")
