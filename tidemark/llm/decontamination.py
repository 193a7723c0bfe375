"""Benchmark decontamination by greedy string tiling.

Texts are words in lower case without punctuation at their ends. Every window of ``min_match`` words has a Karp-Rabin fingerprint,
kept running by prefix sums; a window that a document shares with a benchmark item is a seed. For each pair of document and item,
runs of seeds on one diagonal are the maximal matches; the longest match is marked as a tile, its words leave the game on both
sides, matches that lose words are cut, and so on while a match of ``min_match`` words is left. Tiles may come in any order, so
passages whose parts changed places are found too. The item leaks if tiles cover ``coverage`` of its words.

A bitmap of fixed size (``BITMAP_BITS``) lets tasks discard windows that no item has; its false positives fall in the join with the
seeds, so the benchmark may be of any size.

Rows: null and empty texts match nothing; an item under ``min_match`` words can't leak; rows with equal doc_ids and different texts
are judged apart, equal rows once; rows with null doc_ids are judged each text on its own; empty tables give an empty result;
further columns are not read.
"""

from __future__ import annotations

import heapq
import uuid
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import coded, hashes, mixed, only, slices, stored, words_of

MIN_MATCH = 5
COVERAGE = 0.8
BITMAP_BITS = 1 << 26
EDGES = string.punctuation + "“”‘’«»…–—"
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all normalised words, and the texts' bounds."""
    words, bounds = words_of(texts)
    distinct, codes = coded(words)
    plain = [w.lower().strip(EDGES) for w in distinct]
    values = hashes(plain)[codes] if len(codes) else np.zeros(0, np.uint64)
    kept = np.array([bool(w) for w in plain], bool)[codes] if len(codes) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(kept)])
    return values[kept], ends[bounds]


def fingerprints(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin fingerprints of all windows inside each text, and their bounds."""
    n = len(values)
    lengths = np.maximum(np.diff(bounds) - width + 1, 0)
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    if n < width:
        return np.zeros(0, np.uint64), out
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    back = np.full(n, INVERSE, np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers)])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], lengths)
    return mixed((sums[at + width] - sums[at]) * back[at]), out


def seeds(items: DataFrame, id_column: str, width: int) -> DataFrame:
    """One row for each window of each item: item_id, item_tokens, ipos, seed."""

    def cut(batches):
        for batch in slices(batches):
            values, bounds = normal_words(batch.column("text"))
            prints, at = fingerprints(values, bounds, width)
            windows = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(batch.num_rows), windows))),
                    pa.array(np.repeat(np.diff(bounds), windows), pa.int64()),
                    pa.array(np.arange(at[-1]) - np.repeat(at[:-1], windows), pa.int64()),
                    pa.array(prints.view(np.int64)),
                ],
                names=["item_id", "item_tokens", "ipos", "seed"],
            )

    return items.select(F.col(id_column).alias("item_id"), "text").mapInArrow(cut, "item_id long, item_tokens long, ipos long, seed long")


def bitmap(seed_table: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Which fingerprints (by their low bits) occur; at most ``bits`` / 64 rows reach the driver, whatever the table's size."""
    low = F.col("seed").bitwiseAND(F.lit(bits - 1))
    rows = seed_table.groupBy(F.shiftright(low, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int((seed & {bits - 1}L) & 63))")).alias("bits")
    )
    out = np.zeros(bits // 64, np.int64)
    for r in rows.collect():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def tiles(points: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of seed points (place in the document, place in the item): (place, place in item, length) of each tile."""
    heap: list[tuple[int, int, int]] = []
    start = previous = None
    for d, i in sorted(set(points), key=lambda p: (p[0] - p[1], p[0])):
        if previous is not None and (d - 1, i - 1) == previous:
            previous = (d, i)
            continue
        if start is not None:
            heap.append((-(previous[0] - start[0] + width), start[1], start[0]))
        start = previous = (d, i)
    if start is not None:
        heap.append((-(previous[0] - start[0] + width), start[1], start[0]))
    heapq.heapify(heap)
    doc_marked: set[int] = set()
    item_marked: set[int] = set()
    out = []
    while heap:
        length, i, d = heapq.heappop(heap)
        length = -length
        free = [k for k in range(length) if i + k not in item_marked and d + k not in doc_marked]
        if len(free) == length:
            out.append((d, i, length))
            item_marked.update(range(i, i + length))
            doc_marked.update(range(d, d + length))
            continue
        # Cut what is left into runs of free words.
        run = 0
        for n, k in enumerate(free):
            run += 1
            if n + 1 == len(free) or free[n + 1] != k + 1:
                if run >= width:
                    heapq.heappush(heap, (-run, i + k - run + 1, d + k - run + 1))
                run = 0
    return out


def shared_seeds(docs: DataFrame, seed_bits: np.ndarray, width: int) -> DataFrame:
    """Windows of documents that an item may have: doc_id, text_key, dpos, seed."""
    held = docs.sparkSession.sparkContext.broadcast(seed_bits)
    mask = np.uint64(len(seed_bits) * 64 - 1)

    def scan(batches):
        bits = held.value
        for batch in slices(batches):
            values, bounds = normal_words(batch.column("text"))
            prints, at = fingerprints(values, bounds, width)
            low = prints & mask
            hit = np.flatnonzero((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1))
            owner = np.searchsorted(at, hit, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(owner)), batch.column("text_key").take(pa.array(owner)), pa.array(hit - at[owner], pa.int64()), pa.array(prints[hit].view(np.int64))],
                names=["doc_id", "text_key", "dpos", "seed"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(scan, "doc_id long, text_key long, dpos long, seed long")


def leaks(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """Pairs of documents and the items they hold: doc_id, item_id, item_tokens, n_tiles, longest, tiled, coverage."""
    return leaks_by_text(docs, items, **params).drop("text_key")


def leaks_by_text(
    docs: DataFrame, items: DataFrame, id_column: str = "item_id", min_match: int = MIN_MATCH, coverage: float = COVERAGE
) -> DataFrame:
    """The pairs of ``leaks`` with the text's hash, which tells documents with null or equal ids apart."""
    seed_table = stored(seeds(items, id_column, min_match), "seeds")
    found = shared_seeds(docs, bitmap(seed_table), min_match)
    points = found.join(seed_table, "seed").groupBy("doc_id", "text_key", "item_id", "item_tokens").agg(
        F.collect_list(F.struct("dpos", "ipos")).alias("points"), F.count_distinct("ipos").alias("places")
    )
    # Even if every seed's place began a tile of its own, fewer could not cover enough.
    points = points.filter(F.col("places") * min_match >= F.col("item_tokens") * coverage)

    def judge(batches):
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "text_key", "item_id", "item_tokens", "n_tiles", "longest", "tiled", "coverage")}
            for r in batch.select(["doc_id", "text_key", "item_id", "item_tokens", "points"]).to_pylist():
                found = tiles([(p["dpos"], p["ipos"]) for p in r["points"]], min_match)
                tiled = sum(t[2] for t in found)
                if tiled >= coverage * r["item_tokens"]:
                    values = (r["doc_id"], r["text_key"], r["item_id"], r["item_tokens"], len(found), max(t[2] for t in found), tiled, tiled / r["item_tokens"])
                    for name, value in zip(rows, values, strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.float64() if k == "coverage" else pa.int64()) for k, v in rows.items()], names=list(rows)
            )

    schema = "doc_id long, text_key long, item_id long, item_tokens long, n_tiles long, longest long, tiled long, coverage double"
    return points.mapInArrow(judge, schema)


def without_leaks(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """``docs`` without those that hold an item; of documents with null or equal ids only those whose text holds one go."""
    tag = f"_{uuid.uuid4().hex}_"
    bad = leaks_by_text(docs, items, **params).select(F.col("doc_id").alias(f"{tag}id"), F.col("text_key").alias(f"{tag}text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{tag}id")) & (F.xxhash64("text") == F.col(f"{tag}text"))
    return docs.join(bad, same, "left_anti")
