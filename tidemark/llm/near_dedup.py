"""Near-duplicates by BagMinHash on multisets of word shingles.

A document is the multiset of its five-word shingles; a text of one to four words is one shingle. Two documents are linked when the
weighted Jaccard similarity of their multisets (sum of the smaller counts over sum of the larger) is 0.8 or more; classes are what links connect.

The signature has ``rows * bands`` registers. A shingle of weight w owns the interval [0, w), cut into the dyadic parts [0,1), [1,2), [2,4),
[4,8) ...; every part is a Poisson process seeded by shingle and part, whose rate is the part's length. Each point of a process has a time, a
register and a place in its part; a point counts if its place lies below w, so that equal shingles of different weights share the points
below the smaller weight. A register keeps its earliest point. Times are drawn in increasing order and a document stops at a
time by which its registers are expected to be full, again with twice the time where one is not. Two registers agree with a probability
equal to the weighted Jaccard similarity.

Steps: equal word sequences collapse to one node first, so groups of exact copies weigh nothing. Nodes that share a band meet in a
bucket. In each bucket the smallest node is the pivot and all others are compared with it, by their multisets. Links join classes
(components, by alternating large and small stars). In buckets that hold more than one class all members, the pivot's class too, meet again with those
of a like size, slot by slot in tasks of bounded size, which compare what is not in one class yet and give out links alone. So every two nodes
that share a band end in one class or have been compared. A link of 0.8 shares a band with a probability of 0.9999.

Rows: a text without words (null too) is a class of its own; rows with equal ids each get a row; rows with null ids are classed by text, and a
class's id is its smallest non-null doc_id; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import coded, hashes, mixed, only, slices, small_batches, stored, window_hashes, words_of

WIDTH = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 30
BLOCK = 512

SIGNED = "doc_id long, text_key long, hi long, lo long, size long, bands array<long>"


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles with the texts' bounds, and a 128-bit digest of each text's word sequence."""
    words, bounds = words_of(texts)
    distinct, codes = coded(words)
    values = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.diff(bounds)
    place = (np.arange(len(values)) - np.repeat(bounds[:-1], counts)).astype(np.uint64)
    digests = np.zeros((2, len(counts)), np.uint64)
    full = np.flatnonzero(counts)
    for k in range(2 if len(full) else 0):
        spread = mixed(values + mixed(place * np.uint64(2) + np.uint64(k)))
        digests[k, full] = mixed(np.add.reduceat(spread, bounds[:-1][full]) + counts[full].astype(np.uint64))
    grams, at = window_hashes(values, bounds, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        grams = np.insert(grams, at[short], digests[0, short])
        at = at + np.concatenate([[0], np.cumsum((counts > 0) & (counts < width))])
    return grams, at, digests[0], digests[1]


def bags(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: the text, 44 bits of the shingle's hash, and its weight."""
    texts = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    keys = np.sort((texts << np.uint64(44)) | (grams >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    weights = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), weights


def registers(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """The (texts, m) registers of bags; the number in a register names its earliest point."""
    out = np.full(texts * m, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(owner, weights=weight, minlength=texts)
    limit = np.full(texts, np.inf)
    limit[total > 0] = m * (np.log(m) + 3) / total[total > 0]
    todo = np.zeros(texts, bool)
    todo[owner] = True
    # One entry for each dyadic part of a shingle's interval: its lower end and length.
    part = np.zeros(len(owner), np.int64)
    index = [np.arange(len(owner))]
    parts = [part]
    level = 0
    rest = np.flatnonzero(weight > 1)
    while len(rest):
        level += 1
        index.append(rest)
        parts.append(np.full(len(rest), level))
        rest = rest[weight[rest] > (1 << level)]
    index, parts = np.concatenate(index), np.concatenate(parts)
    while todo.any():
        live = index[todo[owner[index]]]
        lev = parts[todo[owner[index]]]
        low = np.where(lev > 0, 1 << np.maximum(lev - 1, 0), 0)
        span = np.maximum(low, 1)
        seed = mixed(element[live] * np.uint64(0x9E3779B97F4A7C15) + lev.astype(np.uint64))
        time = np.zeros(len(live))
        step = 0
        while len(live):
            step += 1
            draw = mixed(seed + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / span
            stay = time < limit[owner[live]]
            live, seed, time, low, span, draw = live[stay], seed[stay], time[stay], low[stay], span[stay], draw[stay]
            point = mixed(draw ^ np.uint64(0xA0761D6478BD642F))
            deep = np.flatnonzero(span > 1)
            counted = np.ones(len(live), bool)
            if len(deep):
                place = low[deep] + (mixed(point[deep]) % span[deep].astype(np.uint64)).astype(np.int64)
                counted[deep] = place < weight[live[deep]]
            who = owner[live[counted]]
            where = who * m + (point[counted] % np.uint64(m)).astype(np.int64)
            tick = (time[counted] / limit[who] * 2.0**32).astype(np.uint64)
            np.minimum.at(out, where, (tick << np.uint64(32)) | (point[counted] >> np.uint64(32)))
        empty = (out.reshape(texts, m) == np.iinfo(np.uint64).max).any(axis=1) & todo
        limit[empty] *= 2
        out.reshape(texts, m)[empty] = np.iinfo(np.uint64).max
        todo = empty
    return out.reshape(texts, m) & np.uint64(0xFFFFFFFF)


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    keys = np.zeros((len(signature), bands), np.uint64)
    grid = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, r])
    return mixed(keys + np.arange(bands, dtype=np.uint64))


def signatures(docs: DataFrame, width: int = WIDTH, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, the text's hash, digest of the word sequence (null without words) and band keys of every document."""

    def sign(batches):
        for batch in slices(batches, limit=4 << 20):
            grams, at, hi, lo = shingles(batch.column("text"), width)
            texts = batch.num_rows
            filled = np.diff(at) > 0
            keys = np.zeros((texts, bands), np.uint64)
            if filled.any():
                keys[filled] = band_keys(registers(*bags(grams, at), texts, rows * bands)[filled], rows, bands)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, texts * bands + 1, bands), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("text_key"),
                    pa.array(hi.view(np.int64), mask=~filled),
                    pa.array(lo.view(np.int64), mask=~filled),
                    pa.array(np.diff(at), pa.int64()),
                    lists,
                ],
                names=["doc_id", "text_key", "hi", "lo", "size", "bands"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(sign, SIGNED)


def bag_table(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """The sorted shingle hashes (32 bits, with repeats) of the nodes' texts: node, bag. ``nodes``: node, rep, hi, lo.

    At 32 bits two unlike shingles of a pair of texts of 20,000 words are taken as one with a probability of one in 200,000.
    """

    def gather(batches):
        for batch in slices(batches, limit=4 << 20):
            grams, at, hi, lo = shingles(batch.column("text"), width)
            same = (hi.view(np.int64) == batch.column("hi").to_numpy(zero_copy_only=False)) & (lo.view(np.int64) == batch.column("lo").to_numpy(zero_copy_only=False))
            found = np.flatnonzero(same)
            data = [np.sort((grams[at[k] : at[k + 1]] >> np.uint64(32)).astype("<u4")).tobytes() for k in found]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(found)), pa.array(data, pa.binary())], names=["node", "bag"])

    texts = only(docs, "doc_id", "text").join(nodes, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "node", "hi", "lo")
    return texts.mapInArrow(gather, "node long, bag binary").dropDuplicates(["node"])


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two sorted bags."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    # The k-th copy of a shingle in one bag matches the k-th copy in the other.
    copy = np.arange(len(x)) - np.searchsorted(x, x, side="left")
    shared = int((copy < np.searchsorted(y, x, side="right") - np.searchsorted(y, x, side="left")).sum())
    return shared / (len(x) + len(y) - shared)


def verified(pairs: DataFrame, nodes: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """(node, pivot, linked) by the multisets; pairs whose sizes rule a link out are left away."""

    def judge(batches):
        for batch in batches:
            sims = [overlap(a, b) >= threshold for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivot"), pa.array(sims, pa.bool_())], names=["node", "pivot", "linked"])

    sizes = nodes.select("node", "size")
    near = (
        pairs.join(sizes, "node")
        .join(sizes.select(F.col("node").alias("pivot"), F.col("size").alias("other")), "pivot")
        # The smaller bag can share no more than its size.
        .filter(F.least("size", "other") >= threshold * F.greatest("size", "other"))
        .select("node", "pivot")
    )
    return (
        near.join(bag.select("node", F.col("bag").alias("a")), "node")
        .join(bag.select(F.col("node").alias("pivot"), F.col("bag").alias("b")), "pivot")
        .select("node", "pivot", "a", "b")
        .mapInArrow(judge, "node long, pivot long, linked boolean")
    )


def components(links: DataFrame) -> DataFrame:
    """Connected components of (u, v) pairs: node, root (its smallest node), for all nodes but the roots.

    Large stars and small stars alternate until the edges stay as they are; minima and joins only, so a hub of any size is split by Spark.
    """
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "cc")
    print_of = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u > v")
            .distinct()
        )
        edges = stored(small, "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == print_of:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        print_of = now


def links_within(nodes: list[int], roots: list[int], data: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """Links that join what is not joined yet among the bags of one block."""
    bags_of = [np.frombuffer(x, "<u4") for x in data]
    sizes = np.array([len(b) for b in bags_of])
    starts = np.cumsum(sizes) - sizes
    whole = np.concatenate(bags_of)
    # The k-th copy of a shingle is an item of its own, so that a multiset is a set of items.
    copy = np.concatenate([np.arange(len(b)) - np.searchsorted(b, b, side="left") for b in bags_of])
    items = np.unique((copy.astype(np.uint64) << np.uint64(32)) | whole, return_inverse=True)[1]
    group = np.unique(np.array(roots), return_inverse=True)[1]
    out = []
    marked = np.zeros(int(items.max()) + 1, np.int64)
    for k in range(len(nodes) - 1):
        others = group[k + 1 :] != group[k]
        if not others.any():
            if (group[k + 1 :] == group[k + 1]).all():
                break
            continue
        mine = items[starts[k] : starts[k] + sizes[k]]
        marked[mine] = 1
        shared = np.add.reduceat(marked[items[starts[k + 1] :]], starts[k + 1 :] - starts[k + 1])
        marked[mine] = 0
        linked = others & (shared >= threshold * (sizes[k] + sizes[k + 1 :] - shared))
        for at in np.flatnonzero(linked) + k + 1:
            if group[at] != group[k]:
                out.append((nodes[at], nodes[k]))
                group[group == group[at]] = group[k]
    return out


def block_links(members: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """Links between members (bucket, node, root) of one bucket and different classes: u, v.

    The largest class of a bucket and the members outside it are cut into slots of about ``BLOCK`` members each. Two slots at a time meet in a task; slots
    of the largest class do not meet each other, as their members are joined. So all pairs of unlike classes are seen, no task holds more than two slots,
    a class of any size is sent as often as there are slots outside it, and only links come out.
    """
    slots = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed_buckets = sizes.groupBy("bucket").agg(F.count("*").alias("k"), F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).filter("k > 1")
    plan = mixed_buckets.select("bucket", F.col("top.root").alias("top"), slots(F.col("top.n")).alias("inner"), slots(F.col("all") - F.col("top.n")).alias("outer"))
    placed = members.join(plan, "bucket").withColumn("slot", F.xxhash64("node"))
    # Slots outside the largest class come first.
    slot = F.when(F.col("root") == F.col("top"), F.col("outer") + F.pmod("slot", F.col("inner"))).otherwise(F.pmod("slot", F.col("outer"))).cast("int")
    last = F.col("outer") - 1 + F.when(F.col("root") == F.col("top"), 0).otherwise(F.col("inner"))
    spread = placed.select("bucket", "node", "root", slot.alias("slot"), F.explode(F.sequence(F.lit(0), last)).alias("other")).filter("slot <> other")
    blocks = spread.select("bucket", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"), "slot", "node", "root").join(bag, "node")

    def compare(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("slot").to_numpy(), kind="stable")
        columns = [table.column(c).to_pylist() for c in ("node", "root", "bag")]
        found = links_within(*([c[k] for k in order] for c in columns), threshold) if table.num_rows > 1 else []
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return blocks.groupBy("bucket", "lo", "hi").applyInArrow(compare, "u long, v long")


def near_duplicate_classes(docs: DataFrame, **params) -> DataFrame:
    """One row for each document: doc_id and class_id, the smallest doc_id of the documents it is a copy or near copy of."""
    return classed(docs, **params).select("doc_id", "class_id")


def classed(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """doc_id, text_key, class_id and root (null without words) of every document; classes without any id have roots of their own too."""
    signed = stored(signatures(small_batches(docs), width, rows, bands), "signed")
    nodes = stored(
        signed.filter("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last")
    met = stored(members.join(pivots.select("bucket", "pivot"), "bucket").select("bucket", "node", "pivot"), "met")
    pairs = stored(met.filter("node <> pivot").select("node", "pivot").distinct(), "pairs")
    roots = None
    if not pairs.isEmpty():
        wanted = pairs.select(F.explode(F.array("node", "pivot")).alias("node")).distinct()
        bag = stored(bag_table(docs, nodes.drop("bands", "size").join(wanted, "node", "left_semi"), width), "bags")
        links = verified(pairs, nodes, bag, threshold).filter("linked").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
        roots = components(links)
        classed = met.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = classed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("bucket")
        # Linked bags differ by a fifth in size at most: the members of a bucket of several classes meet in its classes of like sizes, which overlap.
        step = F.floor(F.log("size") / F.lit(max(-math.log(threshold), 1e-3) * 1.001)).cast("long")
        sized = classed.join(several, "bucket").join(nodes.select("node", "size"), "node")
        classes = F.explode(F.array(F.xxhash64("bucket", step), F.xxhash64("bucket", step + 1))).alias("bucket")
        more = block_links(stored(sized.select("node", "root", classes), "members"), bag, threshold)
        roots = components(more.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    if roots is None:
        reps = nodes.select("hi", "lo", F.col("rep").alias("class_id"), F.col("node").alias("root"))
    else:
        whole = nodes.drop("bands").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = whole.groupBy("root").agg(F.min("rep").alias("class_id"))
        reps = whole.join(least, "root").select("hi", "lo", "class_id", "root")
    joined = signed.select("doc_id", "text_key", "hi", "lo").join(reps, ["hi", "lo"], "left")
    return joined.select("doc_id", "text_key", "root", F.when(F.col("hi").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def without_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest doc_id (null ids last), then of the smallest text hash.

    Texts without words are a class each. Of rows with equal ids and texts one stays, chosen by a hash of all its columns.
    """
    tag = f"_{uuid.uuid4().hex}_"
    rows = stored(classed(docs, **params).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")), "kept")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "n")).alias("k")
    kept = rows.filter("root is not null").groupBy("root").agg(first).select("k.doc_id", "k.text_key", "k.n").union(rows.filter("root is null").select("doc_id", "text_key", "n"))
    kept = kept.select(F.col("doc_id").alias(f"{tag}id"), F.col("text_key").alias(f"{tag}text"), F.col("n").alias(f"{tag}n"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{tag}id")) & (F.xxhash64("text") == F.col(f"{tag}text"))
    found = docs.join(kept, same)
    columns = [F.col(c) for c in docs.columns]
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    least = F.min_by(F.struct(*columns), F.xxhash64(*plain)).alias("row")
    repeated = found.filter(F.col(f"{tag}n") > 1).groupBy(f"{tag}id", f"{tag}text").agg(least).select("row.*")
    return found.filter(F.col(f"{tag}n") == 1).select(*columns).union(repeated)
