"""Packing documents into sequences of a fixed number of tokens: cutting stock by column generation.

A document is its ids and an end id. Its full blocks of ``capacity`` tokens are sequences of their own; what remains
(the tail, under ``capacity`` tokens) is an item of the cutting-stock problem. Items are counted by length class of
``width`` tokens; a linear program over patterns (how many items of each class share one sequence) is solved by column
generation: the simplex method holds one pattern for each class, a knapsack by dynamic programming looks for a pattern
whose items are worth more than one sequence at the current prices. The rounded-down pattern counts are dealt to items by
their rank within the class. Items that rounding leaves over, at most (classes x items of a pattern) whatever the input's size, are laid
end to end and cut every ``capacity`` tokens; the last rest is cut into powers of two, which need no padding.

Only the histogram and the patterns reach the driver; both are bounded by ``capacity`` / ``width`` classes.

Rows: a null text counts as empty and is one piece with the end id alone; rows with equal or null ids are packed each;
an empty table gives no pieces; further columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import inverted, only, stored
from tidemark.llm.pieces import encoded_slices

CAPACITY = 2048
WIDTH = 8
BLOCKS = 0

ENCODED = (
    "chunk long, row long, doc_id long, n long, cls int, local_rank long, block_rank long, crcs array<long>, ids binary"
)
PIECES = "chunk long, row long, doc_id long, start long, length long, doc_tokens long, sequence_id long, place long, crc long"


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """Encoded documents, stored: ids (little-endian unsigned 32 bit), the crc32 of each block and of the tail, the tail's
    class, and the ranks of tail and blocks within the task that encoded them."""

    def encode(batches):
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(capacity // width + 2, np.int64)
        row = blocks = 0
        for batch, ids, bounds in encoded_slices(batches, tokenizer_path, end_id):
            count = batch.num_rows
            lengths = np.diff(bounds)
            classes = -(-(lengths % capacity) // width)
            ranks = np.zeros(count, np.int64)
            order = np.argsort(classes, kind="stable")
            ordered = classes[order]
            firsts = np.searchsorted(ordered, ordered)
            ranks[order] = np.arange(count) - firsts + seen[ordered]
            seen += np.bincount(classes, minlength=len(seen))
            full = lengths // capacity
            block_ranks = blocks + np.cumsum(full) - full
            blocks += int(full.sum())
            data = ids.astype("<u4").tobytes()
            blobs = [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            step = 4 * capacity
            crcs = [[zlib.crc32(x[i : i + step]) for i in range(0, len(x), step)] for x in blobs]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(count, chunk), pa.int64()),
                    pa.array(np.arange(row, row + count), pa.int64()),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(classes, pa.int32()),
                    pa.array(ranks, pa.int64()),
                    pa.array(block_ranks, pa.int64()),
                    pa.array(crcs, pa.list_(pa.int64())),
                    pa.array(blobs, pa.binary()),
                ],
                names=["chunk", "row", "doc_id", "n", "cls", "local_rank", "block_rank", "crcs", "ids"],
            )
            row += count

    return stored(only(docs, "doc_id", "text").mapInArrow(encode, ENCODED), "pack-encoded")


@dataclass
class Plan:
    """``segments[c]``: (first rank, first sequence, items of the class in the pattern) in order of rank; items of the class
    ranked ``dealt[c]`` or more are left over. ``sequences``: how many sequences the patterns fill."""

    segments: dict[int, list[tuple[int, int, int]]]
    dealt: dict[int, int]
    sequences: int
    patterns: int
    bound: float


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the most valuable multiset of sizes within the capacity."""
    worth = np.full(capacity + 1, -1.0)
    worth[sizes] = prices
    # value[capacity - room] is the best for that room, so that all choices of a room are one slice.
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        options = value[capacity - room + 1 :] + worth[1 : room + 1]
        size = int(options.argmax()) + 1
        best, idle = options[size - 1], value[capacity - room + 1]
        value[capacity - room], choice[room] = (best, size) if best > idle + 1e-12 else (idle, 0)
    counts = np.zeros(capacity + 1)
    room = capacity
    while room > 0:
        counts[choice[room]] += choice[room] > 0
        room -= choice[room] or 1
    return float(value[0]), counts[sizes]


def solve(demand: dict[int, int], capacity: int, tolerance: float = 1e-2) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float]:
    """Patterns, how often each is used (a linear program's solution), the classes, and the bound it proves.

    Gilmore and Gomory's method: the basis starts with one pattern of a single class for each class, prices are the basis'
    duals, and a pattern enters while it is worth more than ``1 + tolerance`` sequences, which also bounds the distance to the optimum.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0))
    m = len(sizes)
    need = np.array([demand[c] for c in sizes], float)
    basis = np.diag((capacity // sizes).astype(float))
    cost = np.ones(m)
    inverse = np.diag(1.0 / np.diag(basis))
    level = np.diag(inverse) * need
    prices = np.diag(inverse).copy()
    for step in range(200 * m + 1000):
        if step % 100 == 99:
            inverse = inverted(basis)
            level = np.maximum((inverse * need).sum(axis=1), 0)
            prices = (cost[:, None] * inverse).sum(axis=0)
        low = int(prices.argmin())
        if prices[low] < -1e-9:
            # More items than asked for: a surplus column is cheaper.
            entering, price = np.zeros(m), 0.0
            entering[low] = -1
        else:
            worth, entering = best_pattern(sizes, np.maximum(prices, 0), capacity)
            if worth <= 1 + tolerance:
                break
            price = 1.0
        used = np.flatnonzero(entering)
        shift = (inverse[:, used] * entering[used]).sum(axis=1)
        up = shift > 1e-9
        if not up.any():
            break
        ratios = np.full(m, np.inf)
        ratios[up] = level[up] / shift[up]
        out = int(ratios.argmin())
        move = ratios[out]
        level = np.maximum(level - move * shift, 0)
        level[out] = move
        pivot = inverse[out] / shift[out]
        prices = prices + (price - (prices[used] * entering[used]).sum()) * pivot
        inverse = inverse - np.outer(shift, pivot)
        inverse[out] = pivot
        basis[:, out] = entering
        cost[out] = price
    patterns = [basis[:, k] for k in range(m) if cost[k] > 0]
    return patterns, level[cost > 0], sizes, float((need * np.maximum(prices, 0)).sum())


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH) -> Plan:
    """Deal the items of each class to the rounded patterns."""
    demand = {c: n for c, n in histogram.items() if c > 0 and n > 0}
    if not demand:
        return Plan({}, {}, 0, 0, 0.0)
    patterns, level, sizes, bound = solve(demand, capacity // width)
    times = np.floor(level + 1e-6).astype(np.int64)
    segments: dict[int, list[tuple[int, int, int]]] = {int(c): [] for c in sizes}
    dealt = {int(c): 0 for c in sizes}
    sequence = 0
    for pattern, count in zip(patterns, times, strict=True):
        if count <= 0:
            continue
        for k in np.flatnonzero(pattern > 0):
            c, items = int(sizes[k]), int(round(pattern[k]))
            segments[c].append((dealt[c], sequence, items))
            dealt[c] += items * int(count)
        sequence += int(count)
    dealt = {c: min(n, demand[c]) for c, n in dealt.items()}
    return Plan(segments, dealt, sequence, int((times > 0).sum()), bound)


def deal(plan: Plan, classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The sequence of each item, -1 for those left over."""
    out = np.full(len(classes), -1, np.int64)
    for c in np.unique(classes):
        segments = plan.segments.get(int(c))
        mine = np.flatnonzero((classes == c) & (ranks < plan.dealt.get(int(c), 0)))
        if segments and len(mine):
            firsts = np.array([s[0] for s in segments])
            at = np.searchsorted(firsts, ranks[mine], side="right") - 1
            begin = np.array([s[1] for s in segments])[at]
            items = np.array([s[2] for s in segments])[at]
            out[mine] = begin + (ranks[mine] - firsts[at]) // items
    return out


def tail_bounds(total: int, capacity: int) -> list[int]:
    """Where the sequences of the laid-out rest begin: every ``capacity`` tokens, then by powers of two."""
    at = list(range(0, total - total % capacity, capacity))
    place = total - total % capacity
    rest = total % capacity
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at.append(place)
            place += 1 << bit
    return [*at, total]


def pack_encoded(encoded: DataFrame, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """Pieces of encoded documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and (chunk, row), the
    key of the encoded document."""
    slim = encoded.drop("ids")
    counts = stored(
        slim.groupBy("chunk", "cls")
        .agg(F.count("*").alias("items"), F.sum(F.expr(f"n div {capacity}")).alias("blocks"))
        .withColumn("part", F.explode(F.array(F.struct(F.col("cls").alias("cls"), F.col("items").alias("k")), F.struct(F.lit(-1).alias("cls"), F.col("blocks").alias("k")))))
        .filter("part.cls <> 0 and part.k > 0")
        .groupBy("chunk", F.col("part.cls").alias("cls"))
        .agg(F.sum("part.k").alias("k")),
        "pack-counts",
    )
    histogram = {r["cls"]: r["k"] for r in counts.groupBy("cls").agg(F.sum("k").alias("k")).collect()}
    plan = make_plan(histogram, capacity, width)
    before = Window.partitionBy("cls").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "cls", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))

    tails = slim.filter("cls > 0").join(offsets.filter("cls > 0"), ["chunk", "cls"]).select(
        "chunk", "row", "doc_id", "n", "cls", (F.col("first") + F.col("local_rank")).alias("rank"), F.element_at("crcs", -1).alias("crc")
    )

    def assign(batches):
        for batch in batches:
            classes = batch.column("cls").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deal(plan, classes, ranks), pa.int64())], names=[*batch.schema.names, "sequence_id"])

    placed = tails.mapInArrow(assign, "chunk long, row long, doc_id long, n long, cls int, rank long, crc long, sequence_id long")
    placed = stored(placed, "pack-placed")
    length = F.col("n") % capacity
    within = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.filter("sequence_id >= 0").select(
        "chunk", "row", "doc_id", (F.col("n") - length).alias("start"), length.alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), "sequence_id", F.coalesce(F.sum(length).over(within), F.lit(0)).alias("offset"),
    )

    left = placed.filter("sequence_id < 0")
    total = left.agg(F.coalesce(F.sum(length), F.lit(0)).alias("t")).first()["t"]
    cuts = np.array(tail_bounds(int(total), capacity), np.int64)

    def cut(batches):
        for batch in batches:
            rows = {k: [] for k in ("chunk", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for r in batch.to_pylist():
                rest = r["n"] % capacity
                base = r["n"] - rest
                at = r["place"]
                while at < r["place"] + rest:
                    k = int(np.searchsorted(cuts, at, side="right")) - 1
                    stop = min(r["place"] + rest, int(cuts[k + 1]))
                    start = base + at - r["place"]
                    values = (
                        r["chunk"], r["row"], r["doc_id"], start, stop - at,
                        zlib.crc32(r["ids"][4 * start : 4 * (start + stop - at)]),
                        r["n"], plan.sequences + k, at - int(cuts[k]),
                    )
                    for name, value in zip(rows, values, strict=True):
                        rows[name].append(value)
                    at = stop
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    # One task orders the rest: its rows are bounded by the plan, not by the input.
    line = Window.orderBy(F.desc("cls"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    lined = left.select("chunk", "row", "doc_id", "n", F.coalesce(F.sum(length).over(line), F.lit(0)).alias("place"))
    # For the same reason these rows, (capacity / width)^2 of a few numbers at most, may be broadcast, and the ids are not shuffled.
    rest = encoded.select("chunk", "row", "ids").join(F.broadcast(lined), ["chunk", "row"]).mapInArrow(
        cut, "chunk long, row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )

    base = plan.sequences + max(len(cuts) - 1, 0)
    blocks = (
        slim.filter(F.col("n") >= capacity)
        .join(offsets.filter("cls = -1").select("chunk", "first"), "chunk")
        .select("*", F.posexplode(F.slice("crcs", 1, F.expr(f"int(n div {capacity})"))).alias("k", "crc"))
        .select(
            "chunk", "row", "doc_id", (F.col("k") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"),
            F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
            (F.lit(base) + F.col("first") + F.col("block_rank") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
    )
    return whole.unionByName(rest).unionByName(blocks)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    return pack_encoded(encode_documents(docs, tokenizer_path, end_id, capacity, width), capacity, width).drop("chunk", "row")


def sequences(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids (little-endian unsigned 32 bit), one shuffle of the ids."""
    cut = pieces.join(encoded.select("chunk", "row", "ids"), ["chunk", "row"]).select(
        "sequence_id", "offset", F.substring("ids", F.expr("int(4 * start + 1)"), F.expr("int(4 * length)")).alias("ids")
    )
    parts = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, part: F.concat(acc, part["ids"]))
    return parts.select("sequence_id", joined.alias("ids"))
