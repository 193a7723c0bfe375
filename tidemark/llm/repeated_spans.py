"""Removal of long repeated byte strings by bucket-pointer refinement over the suffixes of all texts.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else, in the same text or another, is removed. Strings
are judged on the input and never cross texts.

Buckets: the suffixes that begin with the same eight bytes share a bucket, whose identifier is these bytes. Refinement sorts a bucket by the identifier
of the bucket that each suffix lies in w bytes later, so buckets of w bytes become buckets of 2 w bytes; the identifiers that a round
has made are what the next one points to: 8, 16, 32, 64, 128 and, with pointers that overlap, 200 bytes. Identifiers are numbers mixed from the two
refined (64 + 32 bits), so tasks that never meet give equal strings equal identifiers and no ranks are exchanged.

Which suffixes need their buckets of 200 bytes compared over all texts is settled on few of them, in three rounds:

1.  A window of 200 bytes is led by the smallest of its 137 identifiers of 64 bytes, the first one if several are equal. Equal windows have equal leaders at equal
    places. The windows that one place leads lie next to each other and are a group, whose context is the string they span (336 bytes at most). Slices of
    texts send each leader's identifier with its context's, about one for 69 bytes.
2.  A leader met once leads unique windows. Where all groups of a leader have the same context, each window has its twin. Leaders met twice or more in
    unlike contexts are contested. Contested groups whose context was met once, and one for each context met more often (so copies weigh little), are cut into
    blocks of 16 windows at equal distances from the leader; a block is led by the 185 bytes that all its windows share, and its context is what they span.
    Blocks are settled as groups are.
3.  Of contested blocks the windows themselves are sent; a window met twice is repeated.

Slices of about ``SLICE`` bytes of whole texts are packed once, in a table bucketed by their number, so that only keys are shuffled; a key is sent once for each
slice, however often it occurs there. No task holds more than one slice (a longer text is a slice of its own) with its keys. Counts are summed before the
shuffle, and joins on a leader are split by Spark where one leads very many groups.

Rows: null and empty texts, and those shorter than 200 bytes, lose nothing; equal texts lose all their bytes (from 200 on), whatever their ids; rows with equal
or null ids are texts of their own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, only, packed, slices, small_batches, stored, unpacked
from tidemark.session import scratch_path

LENGTH = 200
BLOCK = 16
SLICE = 4 << 20
PIECE = 1 << 17
PLACE_BITS = np.uint64(18)
LANES = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(0xD1342543DE82EF95), np.uint64(0x94D049BB133111EB)))

# What is known of a group: its windows are repeated; it is sent on in finer groups; both. Blocks add LEVEL. Last, a window that is repeated.
REPEATED, SENT, REPEATED_AND_SENT = 0, 1, 2
LEVEL = 3
WINDOW = 2 * LEVEL

CHUNKS = "kind string, slice long, texts binary, leader long, context long, proof int, n int"
KEYS = "slice long, leader long, context long, proof int, n int"
SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def refine(left: np.ndarray, right: np.ndarray, lane: tuple[np.uint64, np.uint64]) -> np.ndarray:
    """Identifiers of the buckets that pairs of identifiers make."""
    out = left * lane[0]
    out += right
    out ^= out >> np.uint64(32)
    out *= lane[1]
    out ^= out >> np.uint64(29)
    return out


def identifiers(data: np.ndarray, length: int, lane: tuple[np.uint64, np.uint64]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Identifiers of all strings of q, of 2 q and of ``length`` bytes, and q: the largest power of two up to half of ``length``."""
    ids = data.astype(np.uint64)
    for w in (1, 2, 4):
        ids = ids[:-w] | (ids[w:] << np.uint64(8 * w))
    q = 8
    while 4 * q <= length:
        ids = refine(ids[:-q], ids[q:], lane)
        q *= 2
    twice = refine(ids[:-q], ids[q:], lane)
    return ids, twice, stretched(twice, length - 2 * q, lane), q


def stretched(ids: np.ndarray, step: int, lane: tuple[np.uint64, np.uint64]) -> np.ndarray:
    """Identifiers of strings longer by ``step``, by pointers that overlap."""
    return refine(ids[:-step], ids[step:], lane) if step else ids


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


@dataclass
class Piece:
    """Identifiers of a stretch of a slice: of 2 q bytes, and of all windows in both lanes."""

    start: int
    twice: np.ndarray
    windows: np.ndarray
    proofs: np.ndarray
    q: int
    length: int


@dataclass
class Groups:
    """Windows by leader: the leader's and the context's identifiers, the leader's place, the first and last window."""

    piece: Piece
    leader: np.ndarray
    context: np.ndarray
    proof: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def members(self, keys: np.ndarray) -> np.ndarray:
        """The windows of the groups whose contexts are among ``keys``."""
        which = np.flatnonzero(np.isin(self.context, keys))
        sizes = (self.last - self.first + 1)[which]
        begin = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) + np.repeat(self.first[which] - begin, sizes)

    def blocks(self, keys: np.ndarray, width: int = BLOCK) -> Groups:
        """The blocks of the groups whose contexts are among ``keys``."""
        piece = self.piece
        width = min(width, piece.length - 2 * piece.q + 1)
        which = np.flatnonzero(np.isin(self.context, keys))
        place, near, far = self.place[which], (self.place - self.last)[which], (self.place - self.first)[which]
        count = far // width - near // width + 1
        begin = np.cumsum(count) - count
        number = np.arange(count.sum()) + np.repeat(near // width - begin, count)
        place, near, far = np.repeat(place, count), np.repeat(near, count), np.repeat(far, count)
        first, last = place - np.minimum(far, number * width + width - 1), place - np.maximum(near, number * width)
        core = place - number * width
        step = piece.length - width + 1 - 2 * piece.q
        leader = refine(piece.twice[core], piece.twice[core + step], LANES[0]) if step else piece.twice[core]
        return Groups(piece, leader, *contexts(piece, place, first, last), place, first, last)


def contexts(piece: Piece, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shape = ((place - first) << 20 | (last - first)).astype(np.uint64)
    return tuple(refine(refine(ids[first], ids[last], lane), shape, lane) for ids, lane in zip((piece.windows, piece.proofs), LANES, strict=True))


def groups_of(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[Groups]:
    """The groups of a slice, piece by piece. A group that two pieces share is two groups."""
    for start in range(0, len(data) - length + 1, PIECE):
        stop = min(start + PIECE, len(data) - length + 1)
        places = np.arange(start, stop)
        inside = np.flatnonzero(places + length <= bounds[np.searchsorted(bounds, places, side="right")])
        if not len(inside):
            continue
        part = data[start : stop + length - 1]
        small, twice, whole, q = identifiers(part, length, LANES[0])
        piece = Piece(start, twice, whole, identifiers(part, length, LANES[1])[2], q, length)
        keyed = (small >> PLACE_BITS << PLACE_BITS) | np.arange(len(small), dtype=np.uint64)
        leads = (sliding_least(keyed, length - q + 1) & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)[inside]
        begins = np.flatnonzero(np.concatenate([[True], leads[1:] != leads[:-1]]))
        first, last = inside[begins], inside[np.append(begins[1:], len(inside)) - 1]
        place = leads[begins]
        yield Groups(piece, small[place], *contexts(piece, place, first, last), place, first, last)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each text's begin (one more entry at the end)."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def short(values: np.ndarray) -> pa.Array:
    return pa.array((values >> np.uint64(32)).astype(np.uint32).view(np.int32))


def distinct_keys(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Leader, context and proof of each distinct context of a slice, and how often it is there."""
    leader, context, proof = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*parts, strict=True) if parts else ([], [], [])))
    context, at, n = np.unique(context, return_index=True, return_counts=True)
    return signed(leader[at]), signed(context), short(proof[at]), pa.array(n.astype(np.int32))


def leaders(docs: DataFrame, length: int) -> DataFrame:
    """Packed slices of texts (kind ``texts``), and for each slice its distinct groups with the number of their places (kind ``groups``)."""

    def send(batches):
        task = TaskContext.get().partitionId()
        for number, part in enumerate(slices(batches, limit=SLICE)):
            name = task << 24 | number
            texts = pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("text")], names=["doc_id", "text"])
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["texts"]), pa.array([name]), pa.array([packed(texts)], pa.binary()), *nothing], names=["kind", "slice", "texts", "leader", "context", "proof", "n"]
            )
            keys = distinct_keys([(g.leader, g.context, g.proof) for g in groups_of(*bytes_of(part.column("text")), length)])
            size = len(keys[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(["groups"] * size, pa.string()), pa.array(np.full(size, name)), pa.nulls(size, pa.binary()), *keys],
                names=["kind", "slice", "texts", "leader", "context", "proof", "n"],
            )

    return docs.mapInArrow(send, CHUNKS)


def settled(groups: DataFrame, level: int) -> DataFrame:
    """slice, key (the context) and state of all groups whose leader is met twice or more."""
    facts = groups.groupBy("leader").agg(F.sum("n").alias("met"), (F.min("context") < F.max("context")).alias("contested")).filter("met > 1")
    live = stored(groups.join(facts.select("leader", "contested"), "leader").drop("leader"), "live-groups")
    contexts = live.filter("contested").groupBy("context", "proof").agg(F.sum("n").alias("met"), F.min("slice").alias("chosen"))
    state = F.when(F.col("met") == 1, SENT).when(F.col("slice") == F.col("chosen"), REPEATED_AND_SENT).otherwise(REPEATED)
    contested = live.filter("contested").join(contexts, ["context", "proof"]).select("slice", F.col("context").alias("key"), state.alias("state"))
    found = live.filter("not contested").select("slice", F.col("context").alias("key"), F.lit(REPEATED).alias("state")).union(contested)
    return stored(found.withColumn("state", F.col("state") + level), "suffix-states")


def keys_by_state(table: pa.Table) -> list[np.ndarray]:
    state, key = table.column("state").to_numpy(), table.column("key").to_numpy().view(np.uint64)
    return [key[state == s] for s in range(WINDOW + 1)]


def sent_keys(texts: DataFrame, states: DataFrame, length: int, blocks: bool) -> DataFrame:
    """The blocks of the groups that are sent on, or else the windows of the blocks that are sent on (leader and context alike)."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        by_state = keys_by_state(right)
        groups, finer = (np.concatenate(by_state[k + SENT : k + LEVEL]) for k in (0, LEVEL))
        parts = []
        for blob in left.column("texts").to_pylist() if len(groups) else []:
            for g in groups_of(*bytes_of(unpacked(blob).column("text")), length):
                found = g.blocks(groups)
                at = found.members(finer)
                windows = g.piece.windows[at]
                parts.append((found.leader, found.context, found.proof) if blocks else (windows, windows, g.piece.proofs[at]))
        keys = distinct_keys(parts)
        name = right.column("slice")[0].as_py() if right.num_rows else 0
        return pa.table([pa.array(np.full(len(keys[0]), name)), *keys], names=["slice", "leader", "context", "proof", "n"])

    sent = states.filter(~F.col("state").isin(REPEATED, LEVEL + REPEATED))
    return texts.groupBy("slice").cogroup(sent.groupBy("slice")).applyInArrow(send, KEYS)


def cleaned_texts(texts: DataFrame, states: DataFrame, length: int) -> DataFrame:
    """What each text loses: its repeated windows' bytes."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        by_state = keys_by_state(right)
        groups, finer = (np.concatenate(by_state[k : k + LEVEL : REPEATED_AND_SENT]) for k in (0, LEVEL))
        sent = np.concatenate(by_state[SENT:LEVEL])
        out = []
        for blob in left.column("texts").to_pylist():
            batch = unpacked(blob)
            data, bounds = bytes_of(batch.column("text"))
            steps = np.zeros(len(data) + 1, np.int32)
            for g in groups_of(data, bounds, length) if right.num_rows else ():
                found = g.blocks(sent)
                at = found.members(by_state[LEVEL + SENT])
                alike = at[np.isin(g.piece.windows[at], by_state[WINDOW])]
                repeated = np.unique(np.concatenate([g.members(groups), found.members(finer), alike])) + g.piece.start
                steps[repeated] += 1
                steps[repeated + length] -= 1
            covered = np.cumsum(steps[:-1]) > 0
            begins = covered & ~np.concatenate([[False], covered[:-1]])
            firsts = bounds[:-1][np.diff(bounds) > 0]
            begins[firsts] = covered[firsts]
            added = lambda flags, bounds=bounds: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
            removed = added(covered)
            left_over = np.diff(bounds) - removed
            kept = data[~covered].tobytes()
            digests = [hashlib.sha256(kept[b - n : b]).hexdigest() for b, n in zip(np.cumsum(left_over).tolist(), left_over.tolist(), strict=True)]
            columns = [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(removed), pa.array(added(begins)), pa.array(digests, pa.string())]
            out.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]))
        return pa.Table.from_batches(out)

    return texts.groupBy("slice").cogroup(states.groupBy("slice")).applyInArrow(cut, SPANS)


def bucketed(chunks: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Texts and groups of the chunks, written once; the texts are bucketed by slice and need no shuffle later. Also the groups' folder."""
    spark = chunks.sparkSession
    path = scratch_path(spark, "suffix-groups")
    name = f"suffix_groups_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks.write.partitionBy("kind").bucketBy(buckets, "slice").option("path", path).saveAsTable(name)
    table = spark.table(name)
    return table.filter("kind = 'texts'").select("slice", "texts"), table.filter("kind = 'groups'").drop("kind", "texts"), f"{path}/kind=groups"


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text; ``length`` is 16 at least."""
    texts, groups, folder = bucketed(leaders(only(small_batches(docs), "doc_id", "text"), length))
    states = settled(groups, 0)
    discard(docs.sparkSession, folder)
    states = states.union(settled(sent_keys(texts, states, length, blocks=True), LEVEL))
    met = F.sum("n").over(Window.partitionBy("leader", "proof"))
    windows = sent_keys(texts, states, length, blocks=False).withColumn("met", met).filter("met > 1")
    windows = stored(windows.select("slice", F.col("leader").alias("key"), F.lit(WINDOW).alias("state")), "suffix-windows")
    return cleaned_texts(texts, states.union(windows), length)
