"""What several operators share: Arrow slices of bounded size, words and their hashes, tables cut off from their lineage."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

SLICE_BYTES = 16 << 20
BATCH_ROWS = 1000


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: computed once, and no executor's loss undoes it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate rows whose results are stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of the input can't clash with an operator's own."""
    return docs.select(*[F.col(c) for c in columns])


def id_hash(column: str = "doc_id"):
    """crc32 of an id as text, the base of all splits into training and held-out rows (a null id counts as 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker. Tasks may keep in it what any task would compute alike."""
    return sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__


def small_batches(docs: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``docs``, whose rows go to Python tasks in batches of at most ``rows`` from now on: a batch is copied several times on its way.

    This sets ``spark.sql.execution.arrow.maxRecordsPerBatch`` of the session, unless it is smaller. Tasks gather what they need with ``slices``.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return docs


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Join and cut batches so that the texts of each hold about ``limit`` bytes; one longer text is a slice of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece, more in pieces(batches, text, limit):
        if held and size + more > limit:
            yield joined(held)
            held, size = [], 0
            # What the last slice needed goes back to the system.
            pa.default_memory_pool().release_unused()
        held.append(piece)
        size += more
    if held:
        yield joined(held)
    pa.default_memory_pool().release_unused()


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start), int(ends[stop - 1] - before)
            start = stop


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as one compressed value, for a row of a table."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    r"""Words ``[^\x20\x09-\x0D]+`` of each text: all words, and where each text's begin (one more entry at the end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    filled = pc.greater(pc.binary_length(values), 0)
    flags = filled.to_numpy(zero_copy_only=False)
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    kept = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=kept[1:])
    return values.filter(filled), kept[bounds]


def coded(values: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct strings and the position of each value's string among them."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    dictionary = values.dictionary_encode()
    return dictionary.dictionary.to_pylist(), dictionary.indices.to_numpy(zero_copy_only=False)


def hashes(strings: list[str], seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(s.encode("utf-8", "surrogatepass"), seed) for s in strings), np.uint64, len(strings))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside each text, and their texts' bounds; a text with fewer words has none."""
    n = len(codes)
    lengths = np.maximum(np.diff(bounds) - width + 1, 0)
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    if n < width:
        return np.zeros(0, np.uint64), out
    rolling = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        rolling = mixed(rolling * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - width + 1 + k])
    first = np.repeat(bounds[:-1] - out[:-1], lengths)
    return rolling[np.arange(out[-1]) + first], out


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss and Jordan's elimination row by row; at this size the threads of a linear-algebra library cost more than they save."""
    m = len(matrix)
    work = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        top = k + int(np.abs(work[k:, k]).argmax())
        work[[k, top]] = work[[top, k]]
        work[k] /= work[k, k]
        factors = work[:, k].copy()
        factors[k] = 0
        rows = np.flatnonzero(factors)
        work[rows] -= factors[rows, None] * work[k]
    return work[:, m:]
