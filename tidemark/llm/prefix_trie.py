"""A prefix trie of conversations whose nodes are numbered by minimal perfect hashes, shard by shard.

Conversations are rebuilt first: conversation c begins with the first h = crc32(c) mod 6 turns of conversation c - c % 100 and goes on with its own turns after
its first h. Every distinct sequence of first turns is a node; conversations that begin with it are its members, those that hold nothing more end there.

1.  Turns are ordered by range partitions of (conv_id, turn). Each range numbers its rows and keeps running sums of turn hashes times powers of an odd number
    (two lanes of 64 bits); what a conversation brings over from earlier ranges is one row for each range. So a prefix's digest comes from sums
    at two places, whatever a conversation's length, and no conversation lies in one task.
2.  Conversations are cut into stretches of ``STRETCH`` turns, dealt to shards of about ``SHARD`` turns by hash, so a first turn that a third of all conversations
    share is spread over all shards. A shard enumerates its distinct prefix digests, gives them slots 0, 1, 2 ... by a minimal perfect hash (every
    lookup is verified against the digest kept at its slot) and scatters members, ends and smallest conv_ids into flat arrays by slot.
3.  Nodes are summed over shards by digest, and each shard gets the totals of its nodes back. A node belongs to the shard that holds its smallest member's
    stretch; this shard alone counts it. Shards accumulate leaves and saved tokens through the arrays of parent slots, deepest slots first. What
    lies below a stretch's end is added at its last slot. Sums over shards are the results.
4.  The ids of conversations that end at a node are joined to texts by ranges of (node, conv_id); one task then hashes a node's texts as a stream.

Rows: null roles and texts are empty; null turns come first; turns of one number are ordered by hashes of role and text; rows with a null conv_id
belong to no conversation and are left out; repeated rows are turns each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mixed, packed, stored, unpacked

STRETCH = 1024
SHARD = 1 << 16
HEAD = 5
FAMILY = 100
ROOM = 1.5
POWERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
WORD = 1 << 64
JOINED = 1 << 14
GUEST = np.uint64(0xA0761D6478BD642F)

NUMBERED = "conv_id long, part int, place long, a long, b long, chars long"
INSTANCES = "conv_id long, depth long, a long, b long, chars long, ends boolean"
COUNTED = "shard int, arrays binary, slot int, a long, b long, conv_id long, n long, ends long, chars long, depth long"
SUMMED = "a long, b long, conv_id long, parent_conv_id long, n_convs long, depth long, n_children long, n_leaves long, saved_tokens long"


class Slots:
    """A minimal perfect hash of distinct digests: a key that is alone at its place of a level has a slot there, the others go to the next level."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        used = 0
        while len(a):
            size = int(ROOM * len(a)) + 1
            place = self.place(a, b, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            numbers = np.where(alone, used + np.cumsum(alone) - 1, -1)
            slot = numbers[place]
            fits = slot >= 0
            self.a[slot[fits]], self.b[slot[fits]] = a[fits], b[fits]
            self.levels.append(numbers)
            used += int(fits.sum())
            a, b = a[~fits], b[~fits]

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(a + mixed(b + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.a)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of digests; a digest that is not in the table is an error."""
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for level, numbers in enumerate(self.levels):
            if not len(todo):
                break
            out[todo] = numbers[self.place(a[todo], b[todo], level, len(numbers))]
            todo = todo[out[todo] < 0]
        if len(todo) or not (np.array_equal(self.a[out], a) and np.array_equal(self.b[out], b)):
            raise ValueError("a prefix digest has no slot of its own")
        return out


def unsigned(column) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def numbered(turns: DataFrame) -> DataFrame:
    """Places and running sums of turns inside each range of rows: conv_id, part, place, a, b, chars."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("hi"), F.col("lo")]

    def number(batches):
        part = TaskContext.get().partitionId()
        last, place_before, sums_before = None, 0, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            new = np.concatenate([[True], ids[1:] != ids[:-1]])
            first = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            place = np.arange(len(ids)) - first[run] + 1
            carried = run == 0 if last == ids[0] else np.zeros(len(ids), bool)
            sums = []
            for lane, (name, base) in enumerate(zip(("hi", "lo"), POWERS, strict=True)):
                powers = np.cumprod(np.full(int(place.max()), base, np.uint64))
                steps = np.cumsum(unsigned(batch.column(name)) * powers[place - 1])
                total = steps - np.concatenate([[np.uint64(0)], steps])[first][run]
                total[carried] = total[carried] * np.uint64(pow(base, place_before, WORD)) + np.uint64(sums_before[lane])
                sums.append(total)
            place[carried] += place_before
            last, place_before, sums_before = ids[-1], int(place[-1]), [int(s[-1]) for s in sums]
            columns = [pa.array(ids), pa.array(np.full(len(ids), part, np.int32)), pa.array(place), *map(signed, sums), batch.column("chars")]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "place", "a", "b", "chars"])

    return turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, NUMBERED)


def carried_over(ranges: list) -> dict[int, tuple[int, int, int, int]]:
    """For each range whose first conversation began earlier: the conversation, its rows before and their sums."""
    out: dict[int, tuple[int, int, int, int]] = {}
    before = None
    for r in sorted(ranges, key=lambda r: r["part"]):
        if before is not None and before[0] == r["first"]:
            out[r["part"]] = before
        conv, place, sums = r["last"], r["end"]["place"], (r["end"]["a"] % WORD, r["end"]["b"] % WORD)
        if r["part"] in out and r["first"] == conv:
            _, n, *earlier = out[r["part"]]
            place, sums = place + n, tuple((e + s * pow(p, n, WORD)) % WORD for e, s, p in zip(earlier, sums, POWERS, strict=True))
        before = (conv, place, *sums)
    return out


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), a, b, chars: places and sums over whole conversations."""
    end = F.max_by(F.struct("place", "a", "b"), F.struct("conv_id", "place")).alias("end")
    # One row for each task that numbered rows.
    carry = carried_over(rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), end).collect())

    def shift(batches):
        for batch in batches:
            ids, part = batch.column("conv_id").to_numpy(), batch.column("part").to_numpy()
            place, sums = batch.column("place").to_numpy().copy(), [unsigned(batch.column(c)).copy() for c in ("a", "b")]
            for p in np.unique(part).tolist():
                if p in carry:
                    conv, n, *earlier = carry[p]
                    at = np.flatnonzero((part == p) & (ids == conv))
                    place[at] += n
                    for s, e, base in zip(sums, earlier, POWERS, strict=True):
                        s[at] = s[at] * np.uint64(pow(base, n, WORD)) + np.uint64(e)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(place), *map(signed, sums), batch.column("chars")], names=["conv_id", "place", "a", "b", "chars"])

    return rows.mapInArrow(shift, "conv_id long, place long, a long, b long, chars long")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rebuilt conversations, a row for each of their prefixes from the empty one on: conv_id, depth, a, b (digest), chars of the last turn, ends."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("hi"),
        F.xxhash64(F.lit(7), text, role).alias("lo"),
        F.char_length(text).cast("long").alias("chars"),
    )
    rows = placed(stored(numbered(turns), "trie-turns"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("long")
    rows = rows.withColumn("h", taken)
    heads = rows.filter((F.col("place") <= HEAD) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "a", "b", "chars"))).alias("head")
    )
    convs = (
        rows.groupBy("conv_id", "h").agg(F.max("place").alias("own"), F.max(F.when(F.col("place") == F.col("h"), F.struct("a", "b"))).alias("cut"))
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .join(heads, "base", "left")
        .withColumn("g", F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)).cast("long")))
        .withColumn("length", F.col("g") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .withColumn("top", F.when(F.col("g") > 0, F.element_at("head", F.greatest("g", F.lit(1)).cast("int"))))
    )
    convs = stored(convs.select("conv_id", "h", "g", "length", "cut", "top", "head"), "trie-conversations")
    empty = F.struct(F.lit(0).cast("long").alias("place"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "chars")])
    begun = convs.select("conv_id", "length", F.explode(F.concat(F.array(empty), F.when(F.col("g") > 0, F.slice("head", F.lit(1), F.col("g").cast("int"))).otherwise(F.array()))).alias("n")).select(
        "conv_id", F.col("n.place").alias("depth"), "n.a", "n.b", "n.chars", (F.col("n.place") == F.col("length")).alias("ends")
    )
    zero = F.lit(0).cast("long")
    known = convs.filter("length > g").select(
        "conv_id", "g", "length", *[F.coalesce(F.col(f"{x}.{c}"), zero).alias(f"{x}_{c}") for x in ("cut", "top") for c in ("a", "b")]
    )
    own = rows.filter("place > h").join(known, "conv_id")

    def extend(batches):
        for batch in batches:
            g, h = batch.column("g").to_numpy(), batch.column("h").to_numpy()
            sums = []
            for c, base in zip(("a", "b"), POWERS, strict=True):
                factor = np.array([pow(base, -k, WORD) for k in range(HEAD + 1)], np.uint64)[h - g]
                sums.append((unsigned(batch.column(c)) - unsigned(batch.column(f"cut_{c}"))) * factor + unsigned(batch.column(f"top_{c}")))
            depth = batch.column("place").to_numpy() - h + g
            columns = [batch.column("conv_id"), pa.array(depth), *map(signed, sums), batch.column("chars"), pa.array(depth == batch.column("length").to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "a", "b", "chars", "ends"])

    return begun.union(own.mapInArrow(extend, INSTANCES))


def stretches(instances: DataFrame, shards: int, stretch: int) -> DataFrame:
    """Prefixes with their stretch and shard. The last prefix of a stretch that goes on is also the next one's first, as a ``guest``."""
    own = F.when(F.col("depth") == 0, 0).otherwise(F.floor((F.col("depth") - 1) / stretch)).cast("long")
    goes_on = (F.col("depth") > 0) & (F.col("depth") % stretch == 0) & ~F.col("ends")
    both = F.array(F.struct(own.alias("stretch"), F.lit(False).alias("guest")), F.struct((own + 1).alias("stretch"), F.lit(True).alias("guest")))
    cut = instances.withColumn("goes_on", goes_on).select("*", F.explode(F.when(goes_on, both).otherwise(F.slice(both, 1, 1))).alias("s")).select("*", "s.*").drop("s")
    return cut.withColumn("shard", shard_of(shards))


def shard_of(shards: int):
    return F.pmod(F.xxhash64("conv_id", "stretch"), F.lit(shards)).cast("int")


def counted(table: pa.Table) -> pa.Table:
    """One shard: its slots' arrays packed in one row, and a row for each slot with members, ends and the smallest conv_id."""
    conv, depth, stretch = (table.column(c).to_numpy() for c in ("conv_id", "depth", "stretch"))
    order = np.lexsort((depth, stretch, conv))
    conv, depth, stretch = conv[order], depth[order], stretch[order]
    a, b = (unsigned(table.column(c))[order] for c in ("a", "b"))
    chars, ends, guest, goes_on = (table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("chars", "ends", "guest", "goes_on"))
    # A guest has a slot beside that of the same prefix in its own stretch, should the shard hold both.
    a = np.where(guest, a ^ GUEST, a)
    by_digest = np.lexsort((b, a))
    new = np.concatenate([[True], (a[by_digest][1:] != a[by_digest][:-1]) | (b[by_digest][1:] != b[by_digest][:-1])])
    slots = Slots(a[by_digest][new], b[by_digest][new])
    slot = slots.of(a, b)
    n = len(slots)
    parent = np.full(n, -1, np.int64)
    inner = np.flatnonzero(np.concatenate([[False], (conv[1:] == conv[:-1]) & (stretch[1:] == stretch[:-1])]))
    parent[slot[inner]] = slot[inner - 1]
    depths, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    depths[slot], sizes[slot] = depth, chars
    mine = ~guest
    members = np.bincount(slot[mine], minlength=n)
    finished = np.bincount(slot[mine & ends], minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot[mine], conv[mine])
    digest = np.where(members == 0, slots.a ^ GUEST, slots.a)
    tails = np.flatnonzero(goes_on & mine)
    arrays = pa.RecordBatch.from_arrays(
        [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (parent, digest.view(np.int64), slots.b.view(np.int64), depths, sizes, least, conv[tails], stretch[tails], slot[tails])],
        names=["parent", "a", "b", "depth", "chars", "least", "tail_conv", "tail_stretch", "tail_slot"],
    )
    shard = table.column("shard")[0].as_py()
    columns = [
        pa.array([shard] * (n + 1), pa.int32()),
        pa.array([packed(arrays)] + [None] * n, pa.binary()),
        pa.array([None, *range(n)], pa.int32()),
        *[pa.concat_arrays([pa.nulls(1, pa.int64()), signed(x)]) for x in (digest, slots.b)],
        pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(least, mask=members == 0)]),
        *[pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(x.astype(np.int64))]) for x in (members, finished, sizes, depths)],
    ]
    return pa.table(columns, names=["shard", "arrays", "slot", "a", "b", "conv_id", "n", "ends", "chars", "depth"])


def accumulated(left: pa.Table, right: pa.Table) -> pa.Table:
    """One shard's share of its nodes' sums. ``right``: totals of nodes by slot, or (slot null) what lies below the end of a conversation's stretch."""
    arrays = unpacked(left.column("arrays")[0].as_py())
    parent, a, b, depth, chars, least, tail_conv, tail_stretch, tail_slot = (arrays.column(k).flatten().to_numpy() for k in range(9))
    n = len(parent)
    fact = right.filter(right.column("slot").is_valid())
    at = fact.column("slot").to_numpy()
    smallest, members, leaf = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    smallest[at], members[at], leaf[at] = (fact.column(c).to_numpy() for c in ("conv_id", "n_convs", "leaf"))
    owned = least == smallest
    leaves, saved = owned * leaf, owned * (members - 1) * chars
    below = right.filter(right.column("slot").is_null())
    if below.num_rows:
        where = {k: s for k, s in zip(zip(tail_conv.tolist(), tail_stretch.tolist(), strict=True), tail_slot.tolist(), strict=True)}
        for conv, stretch, more_leaves, more_saved in zip(*(below.column(c).to_pylist() for c in ("conv_id", "stretch", "leaf", "saved")), strict=True):
            leaves[where[conv, stretch]] += more_leaves
            saved[where[conv, stretch]] += more_saved
    children = np.bincount(parent[owned & (parent >= 0)], minlength=n)
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        inner = level[parent[level] >= 0]
        np.add.at(leaves, parent[inner], leaves[inner])
        np.add.at(saved, parent[inner], saved[inner])
    # A guest's sums are those of its own stretch's shard; only its children are counted here.
    guest = least == np.iinfo(np.int64).max
    leaves[guest], saved[guest] = 0, 0
    above = np.where(parent >= 0, smallest[parent], 0)
    columns = [
        pa.array(a), pa.array(b), pa.array(smallest, mask=~owned), pa.array(above, mask=~owned | (parent < 0)), pa.array(members, mask=~owned), pa.array(depth, mask=~owned),
        pa.array(children), pa.array(leaves), pa.array(saved),
    ]
    return pa.table(columns, names=[c.split()[0] for c in SUMMED.split(", ")])


def below_stretches(nodes: DataFrame, stretch: int) -> DataFrame:
    """Leaves and saved tokens that lie below the end of each stretch and are counted on its conversation's own nodes: conv_id, stretch, leaf, saved."""
    own = nodes.filter(F.col("depth") > stretch).withColumn("stretch", F.floor((F.col("depth") - 1) / stretch).cast("long"))
    sums = own.groupBy("conv_id", "stretch").agg(F.sum("leaf").alias("leaf"), F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    every = sums.groupBy("conv_id").agg(F.max("stretch").alias("m")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("stretch"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    summed = every.join(sums, ["conv_id", "stretch"], "left").select("conv_id", "stretch", *[F.sum(F.coalesce(c, F.lit(0))).over(deeper).alias(c) for c in ("leaf", "saved")])
    return summed.filter("leaf is not null")


def end_digests(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256: the digest of the conv_ids that end at each node, joined in ascending order."""
    order = ["a", "b", "conv_id"]

    def join(batches):
        for batch in batches:
            a, b, ids = (batch.column(c).to_numpy() for c in order)
            begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            begin = np.unique(np.concatenate([begin, np.arange(0, len(a), JOINED)]))
            stops = np.append(begin[1:], len(a))
            texts = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(begin.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[begin]), pa.array(b[begin]), pa.array(ids[begin]), pa.array(texts, pa.string())], names=[*order, "ids"])

    def digest(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield rows(out)
        if node is not None:
            yield rows([(*node, state.hexdigest())])

    def rows(out):
        return pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), r, strict=True)) for r in out], schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())]))

    texts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "a long, b long, conv_id long, ids string")
    return texts.repartition("a", "b").sortWithinPartitions(*order).mapInArrow(digest, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, stretch: int = STRETCH, shard_rows: int = SHARD) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    instances = stored(rebuilt(conversations), "trie-prefixes")
    shards = max(1, -(-instances.count() // shard_rows))
    rows = stored(stretches(instances, shards, stretch).groupBy("shard").applyInArrow(counted, COUNTED), "trie-slots")
    slots = rows.filter("arrays is null")
    nodes = slots.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), (F.sum("ends") == F.sum("n")).cast("long").alias("leaf"), F.max("chars").alias("chars"), F.max("depth").alias("depth")
    )
    nodes = stored(nodes, "trie-nodes")
    facts = slots.select("shard", "slot", "a", "b").join(nodes, ["a", "b"]).select("shard", "slot", "conv_id", F.lit(0).cast("long").alias("stretch"), "n_convs", "leaf", F.lit(0).cast("long").alias("saved"))
    more = below_stretches(nodes, stretch).select(shard_of(shards).alias("shard"), F.lit(None).cast("int").alias("slot"), "conv_id", "stretch", F.lit(0).cast("long").alias("n_convs"), "leaf", "saved")
    arrays = rows.filter("arrays is not null").select(F.col("shard").alias("shard"), "arrays")
    shares = arrays.groupBy("shard").cogroup(facts.union(more).groupBy("shard")).applyInArrow(accumulated, SUMMED)
    sums = shares.groupBy("a", "b").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")], *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    )
    ends = end_digests(instances.filter("ends").select("a", "b", "conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return sums.join(ends, ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def oracle_sql() -> str:
    """The same nodes with whole sequences of turns as keys; turns of one conversation must have different numbers."""
    # The checksum bit by bit, over the digits of conv_id.
    bits = "xor(r, s)"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda c: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)[1]"
    digits = "list_transform(string_split(cast(conv_id as varchar), ''), lambda d: cast(ascii(d) as bigint))"
    crc = f"xor(list_reduce({digits}, lambda r, s: {bits}, cast(4294967295 as bigint)), 4294967295)"
    return f"""
with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) pos, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} t
  from conversations where conv_id is not null),
convs as (select conv_id, list(t order by pos) ts, {crc} % 6 h from turns group by conv_id),
whole as (select c.conv_id, list_concat(coalesce(b.ts[:c.h], []), c.ts[c.h + 1:]) ts
  from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 100),
prefixes as (select conv_id, d, ts[:d] p, len(ts) = d ends, case when d > 0 then len(ts[d].text) else 0 end chars from whole, range(0, 1 + (select max(len(ts)) from whole)) r(d) where d <= len(ts)),
nodes as (select p, any_value(d) depth, min(conv_id) conv_id, count(*) n_convs, any_value(chars) chars, bool_and(ends) leaf,
  sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) ends_sha256 from prefixes group by p),
up as (select n.conv_id, n.depth, n.n_convs, n.chars, n.leaf, n.p[:d] anc from nodes n, range(0, 1 + (select max(len(ts)) from whole)) r(d) where d <= n.depth),
sums as (select anc p, count(*) filter (leaf) n_leaves, cast(sum((n_convs - 1) * chars) as bigint) saved_tokens from up group by anc),
children as (select p[:depth - 1] p, count(*) n_children from nodes where depth > 0 group by all)
select n.conv_id, cast(n.depth as bigint) depth, u.conv_id parent_conv_id, n.n_convs, coalesce(c.n_children, 0) n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n join sums s using (p) left join children c using (p) left join nodes u on n.depth > 0 and u.p = n.p[:n.depth - 1]"""
