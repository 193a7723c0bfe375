"""Codes of vectors: each part of a vector is named by the nearest entry of its position's codebook, found with LAESA pivots.

A component x becomes the integer floor(256 * x); a vector is cut into ``PARTS`` equal consecutive parts. Each position's codebook starts as that part
of the vectors with the smallest vec_ids and is refined in rounds: every part goes to its nearest entry, then an entry becomes the floored mean of its
parts; an entry without parts stays.

LAESA: ``PIVOTS`` fixed pivots for each position are taken from the first codebook, far from each other. The squared distances of all parts to their
pivots are computed once and stored beside the integers. In each round only the distances of pivots and entries are new: by the triangle
inequality |d(part, pivot) - d(pivot, entry)| bounds d(part, entry) from below, the largest of the bounds counts. A part evaluates its entries
in the order of their bounds, in exact integers, until the next bound is beyond the nearest entry found; ties go to the lower index. A bound
is lowered by more than its rounding error, so pruning never changes a result.

Each round is one pass over the stored rows. Tasks send sums by position and entry, as many as the codebooks have components; the codebooks are all
that reaches the driver. The errors of labels are summed before they are joined back, and labels with more than a thousandth of the rows (fewer than
a thousand labels) are joined apart from the others.

Rows: a vector that is null or holds a null, NaN or infinite component is dropped, as is one with a component too large for a distance
of 64 bits (beyond 2^27 / 256 for 64 components) or with another length than the vector of the smallest vec_id. Where the length is no multiple of
``PARTS``, zeros are added. Equal vec_ids are each encoded and enter the first codebook by their integers' order; null vec_ids are
encoded and never enter it unless too few others are there. Null labels are one label. Fewer vectors than entries give a shorter
codebook. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 6
SCALE = 256
BLOCK = 4096
HOT_SHARE = 1000


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the integers of each vector without null or non-finite components: x."""
    value = F.col("embedding").cast("array<double>")
    # NaN is larger than all numbers; 2^53 keeps the product in whole numbers until the length's own limit is known.
    sound = F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull() | (F.abs(c) >= 2.0**53))
    whole = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return vectors.select("vec_id", "label", value.alias("x")).filter(sound).select("vec_id", "label", whole.alias("x"))


def component_limit(length: int) -> int:
    """Components below it keep sums of squared differences over a vector under 2^62."""
    return math.isqrt((1 << 62) // (4 * max(length, 1)))


def first_codebooks(kept: DataFrame, entries: int, parts: int) -> tuple[np.ndarray, int]:
    """(parts, entries, components) from the smallest vec_ids, and the vectors' length."""
    top = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(1).collect()
    length = len(top[0]["x"]) if top else 0
    wide = -(-length // parts)
    rows = fitting(kept, length).orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    books = np.zeros((len(rows), parts * wide), np.int64)
    for k, row in enumerate(rows):
        books[k, :length] = row["x"]
    return books.reshape(len(rows), parts, wide).transpose(1, 0, 2).copy(), length


def fitting(kept: DataFrame, length: int) -> DataFrame:
    limit = component_limit(length)
    return kept.filter(F.size("x") == length).filter(~F.exists("x", lambda c: (c >= limit) | (c <= -limit)))


def choose_pivots(books: np.ndarray, count: int) -> np.ndarray:
    """For each position entries far from each other: the first one, then always the one farthest from those chosen."""
    chosen = []
    for book in books:
        picked = [0]
        nearest = ((book - book[0]) ** 2).sum(axis=1)
        while len(picked) < min(count, len(book)):
            picked.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((book - book[picked[-1]]) ** 2).sum(axis=1))
        chosen.append(book[picked])
    return np.array(chosen)


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all others."""
    out = np.zeros((len(points), len(others)), np.int64)
    for k in range(points.shape[1]):
        step = points[:, k, None] - others[None, :, k]
        out += step * step
    return out


def nearest_entries(points: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each point's nearest entry, and how many distances were evaluated.

    ``to_pivots``: the points' squared distances to the pivots.
    """
    near = np.sqrt(to_pivots.astype(np.float64))
    far = np.sqrt(squared(pivots, book).astype(np.float64))
    bounds = np.zeros((len(points), len(book)))
    for p in range(len(pivots)):
        np.maximum(bounds, np.abs(near[:, p, None] - far[None, p]), out=bounds)
    bounds -= 1e-9 + 1e-12 * (near.max(axis=1, initial=0)[:, None] + far.max(initial=0))
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.zeros(len(points), np.int64)
    live = np.arange(len(points))
    evaluated = 0
    while len(live):
        entry = bounds.argmin(axis=1)
        bound = bounds[np.arange(len(live)), entry]
        # The root of the largest number stands for "none yet"; an evaluated entry's bound is infinite.
        go = bound <= np.sqrt(best[live].astype(np.float64))
        if not go.all():
            live, bounds, entry = live[go], bounds[go], entry[go]
            if not len(live):
                break
        step = points[live] - book[entry]
        distance = (step * step).sum(axis=1)
        evaluated += len(live)
        better = (distance < best[live]) | ((distance == best[live]) & (entry < index[live]))
        best[live[better]], index[live[better]] = distance[better], entry[better]
        bounds[np.arange(len(live)), entry] = np.inf
    return index, best, evaluated


def blocks(batches, wide: int, parts: int, pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of stored rows with their parts (rows, parts, components) and pivot distances (rows, parts, pivots)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            n = part.num_rows
            yield part, part.column("x").flatten().to_numpy().reshape(n, parts, wide), part.column("d").flatten().to_numpy().reshape(n, parts, pivots)


def flat(values: np.ndarray) -> pa.ListArray:
    n = len(values)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * values[0].size if n else [0], pa.int32()), pa.array(values.reshape(-1), pa.int64()))


def with_pivot_distances(kept: DataFrame, length: int, pivots: np.ndarray) -> DataFrame:
    """Rows of the vectors' length, their integers filled up to whole parts, with the squared distances to the pivots: d."""
    parts, wide = len(pivots), pivots.shape[2]

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.zeros((part.num_rows, parts * wide), np.int64)
                x[:, :length] = part.column("x").flatten().to_numpy().reshape(part.num_rows, length)
                x = x.reshape(part.num_rows, parts, wide)
                d = np.stack([squared(x[:, p], pivots[p]) for p in range(parts)], axis=1)
                columns = [part.column("vec_id"), part.column("label"), flat(x), flat(d)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "d"])

    rows = fitting(kept, length)
    schema = rows.select("vec_id", "label", "x", F.col("x").alias("d")).schema
    return rows.mapInArrow(measure, schema)


def refined(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floored mean of the parts nearest to it."""
    parts, entries, wide = books.shape
    count = pivots.shape[1]

    def gather(batches):
        # Column 0 counts parts, the others sum components.
        total = np.zeros((parts, entries, wide + 1), np.int64)
        for _, x, d in blocks(batches, wide, parts, count):
            for p in range(parts):
                index = nearest_entries(x[:, p], d[:, p], books[p], pivots[p])[0]
                np.add.at(total[p], (index, 0), 1)
                np.add.at(total[p][:, 1:], index, x[:, p])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.reshape(-1)[cells])], names=["cell", "n"])

    sums = np.zeros(parts * entries * (wide + 1), object)
    # Sums of many rows may pass 64 bits.
    for r in rows.mapInArrow(gather, "cell long, n long").groupBy("cell").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        sums[r["cell"]] = int(r["n"])
    sums = sums.reshape(parts, entries, wide + 1)
    out = books.copy()
    for p, e in np.argwhere(sums[:, :, 0] > 0):
        out[p, e] = [int(s) // int(sums[p, e, 0]) for s in sums[p, e, 1:]]
    return out


def coded_rows(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of each stored row."""
    parts, _, wide = books.shape
    count = pivots.shape[1]

    def encode(batches):
        for part, x, d in blocks(batches, wide, parts, count):
            codes = np.zeros((part.num_rows, parts), np.uint8)
            error = np.zeros(part.num_rows, np.int64)
            for p in range(parts):
                index, distance, _ = nearest_entries(x[:, p], d[:, p], books[p], pivots[p])
                codes[:, p] = index
                error += distance
            text = codes.tobytes().hex()
            names = [text[2 * parts * k : 2 * parts * (k + 1)] for k in range(part.num_rows)]
            columns = [part.column("vec_id"), part.column("label"), pa.array(names, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    schema = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    return rows.mapInArrow(encode, schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the sum of the errors of its label's rows."""
    key = F.struct(F.col("label").isNull(), F.col("label"))
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    hot = totals.filter(F.col("n") * HOT_SHARE > rows)
    tagged = coded.join(F.broadcast(hot.select(key.alias("k"), F.col("label_error").alias("hot"))), key == F.col("k"), "left")
    others = totals.filter(F.col("n") * HOT_SHARE <= rows).select(key.alias("other"), "label_error")
    cold = tagged.filter("hot is null").drop("hot", "k").join(others, key == F.col("other"))
    return tagged.filter("hot is not null").select("vec_id", "label", "code", "error", F.col("hot").alias("label_error")).union(
        cold.select("vec_id", "label", "code", "error", "label_error")
    )


def codebook_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.reshape(-1).tolist()))


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivot_count: int = PIVOTS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of every vector that is kept, and the final codebooks (parts, entries, components)."""
    kept = integer_vectors(vectors)
    books, length = first_codebooks(kept, entries, parts)
    if not books.size and not books.shape[1]:
        empty = kept.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, books
    pivots = choose_pivots(books, pivot_count)
    rows = stored(with_pivot_distances(kept, length, pivots), "vector-parts")
    for _ in range(rounds):
        books = refined(rows, books, pivots)
    return with_label_errors(stored(coded_rows(rows, books, pivots), "vector-codes")), books


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = vector_codes(vectors)
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same codes by all distances, for vectors whose length is a multiple of ``parts``."""
    steps = [
        f"""
kept as (select vec_id, label, list_transform(embedding, lambda c: cast(floor({SCALE} * cast(c as double)) as bigint)) x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
pieces as (select vec_id, label, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] v from kept, range({parts}) r(p)),
first as (select vec_id, row_number() over (order by vec_id) - 1 e from kept qualify e < {entries}),
book0 as (select p, e, v from pieces join first using (vec_id))"""
    ]
    distance = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        steps.append(f"""
near{k} as (select vec_id, label, p, v, min(struct_pack(d := d, e := e)) m
  from (select a.vec_id, a.label, a.p, a.v, b.e, cast({distance} as bigint) d from pieces a join book{k} b using (p)) group by all)""")
        if k < rounds:
            steps.append(f"""
mean{k} as (select p, e, list(cast(floor(s / n) as bigint) order by i) v from (select p, m.e e, i, cast(sum(v[i]) as double) s, count(*) n
  from near{k}, range(1, 1 + (select max(len(v)) from book0)) r(i) group by all) group by all),
book{k + 1} as (select b.p, b.e, coalesce(m.v, b.v) v from book{k} b left join mean{k} m using (p, e))""")
    steps.append(f"""
coded as (select vec_id, label, string_agg(printf('%02x', m.e), '' order by p) code, cast(sum(m.d) as bigint) error from near{rounds} group by all)""")
    return f"""with {",".join(steps)}
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error,
  (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from book{rounds}) codebooks_sha256 from coded"""
