"""Scoring texts with Brown's class-based bigram model.

Tokens are lower-case (A-Z) words and one end for each text. A word met ``MIN_COUNT`` times or more in the training texts belongs to one of ``CLASSES``
classes, so the clustered vocabulary grows with the corpus. Classes are found in two steps. Words whose share of the training tokens is at least
``MIN_SHARE`` (so there are at most ``1 / MIN_SHARE`` of them) are clustered by exchange: in every round the tasks take the words' counts of
left and right neighbour classes and move each word, one after the other, to the class where the class bigrams' likelihood is
highest; the moves of all tasks make the next round's classes. All further words, however many, then join the class where that likelihood is highest,
each by its own neighbours; their classes stay in a table keyed by word. Words met less often belong to a class by their ending and
by how often they occur. For these, a training token is classed as if it had not been seen itself: the only token of a word stands for unknown words, one of
two tokens for words met once. So unknown words have a probability learnt from the text, and all probabilities of a context add up to one.

    P(w | v) = P(class of w | class of v) * count(w) / count(class of w)

Transitions are smoothed by the classes' own shares. Unknown words are one token.

Distribution: texts are encoded in chunks of bounded size; each chunk's distinct words, as 64-bit hashes, meet the other chunks' for their
counts over all training texts (one shuffle) and go back to their chunk, which is then rewritten as class units in a table bucketed by chunk. A
further word's neighbours go to the task of its hash, sorted, so that the task holds the counts of one word at a time; the classes go back by chunk. Vocabulary
counts are never gathered in one place; what reaches the driver is bounded by ``1 / MIN_SHARE`` words and the classes.

Rows: a null text is empty and has the end alone; rows with equal ids are scored each; a null id is hashed as 0; without training texts the
score is the base score; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import coded, discard, hashes, id_hash, only, packed, slices, small_batches, stored, unpacked, words_of
from tidemark.session import scratch_path

CLASSES = 32
ENDINGS = 64
MIN_SHARE = 1e-5
MIN_COUNT = 16
ROUNDS = 3
PULL = 5.0
CHUNK_BYTES = 12 << 20
BATCH_BYTES = 4 << 20

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def encode_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of texts as numbers of their distinct words, and a row for each distinct word: (kind texts, chunk, docs) or (kind words, chunk, code, k, n, ending),
    with n the word's tokens in the chunk's training texts."""

    def encode(batches):
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, limit=CHUNK_BYTES)):
            chunk = task << 24 | number
            words, bounds = words_of(pc.ascii_lower(batch.column("text")))
            strings, codes = coded(words)
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            train = np.repeat(~held, np.diff(bounds))
            counts = np.bincount(codes[train], minlength=len(strings)) if len(strings) else np.zeros(0, np.int64)
            docs_batch = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), lists(codes, bounds)], names=["doc_id", "held_out", "codes"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(["texts"]), pa.array([chunk], pa.int64()), pa.array([packed(docs_batch)], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())],
                names=["kind", "chunk", "docs", "code", "k", "n", "ending"],
            )
            keys = hashes(strings).view(np.int64)
            endings = np.fromiter((zlib.crc32(s[-3:].encode("utf-8", "surrogatepass")) % ENDINGS for s in strings), np.int32, len(strings))
            for lo in range(0, len(strings), 100_000):
                part = slice(lo, min(lo + 100_000, len(strings)))
                size = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["words"]).take(pa.array(np.zeros(size, np.int8))), pa.array(np.full(size, chunk)), pa.nulls(size, pa.binary()), pa.array(np.arange(part.start, part.stop, dtype=np.int32)), pa.array(keys[part]), pa.array(counts[part], pa.int64()), pa.array(endings[part])],
                    names=["kind", "chunk", "docs", "code", "k", "n", "ending"],
                )

    return docs.mapInArrow(encode, "kind string, chunk long, docs binary, code int, k long, n long, ending int")


class Units:
    """Numbers that stand for tokens: frequent words, then ending x how often the word occurs (0, 1, 2, 3 or more), then the end, then the
    further clustered words of the token's chunk."""

    def __init__(self, frequent: int):
        self.frequent = frequent
        self.end = frequent + 4 * ENDINGS
        # Classes: those of frequent words, then unknown, once-met and other words by ending, then the end.
        self.classes = CLASSES + 3 * ENDINGS + 1
        self.contexts = CLASSES + ENDINGS + 1

        self.further = self.end + 1

    def of(self, count: np.ndarray, ending: np.ndarray, number: np.ndarray) -> np.ndarray:
        return np.where(number >= 0, number, self.frequent + 4 * ending + np.minimum(count, 3)).astype(np.int32)

    def class_map(self, assigned: np.ndarray, training: bool) -> np.ndarray:
        """The class of each unit; a training token is classed as if it had not been seen."""
        kind = np.array([0, 0, 1, 2] if training else [0, 1, 2, 2])
        rare = CLASSES + 3 * np.repeat(np.arange(ENDINGS), 4) + np.tile(kind, ENDINGS)
        return np.concatenate([assigned, rare, [self.classes - 1]]).astype(np.int32)

    def context_map(self, assigned: np.ndarray) -> np.ndarray:
        return np.concatenate([assigned, CLASSES + np.repeat(np.arange(ENDINGS), 4), [self.contexts - 1]]).astype(np.int32)


def token_stream(batch: pa.RecordBatch, rows: np.ndarray, end: int) -> np.ndarray:
    """The units of the given texts one after the other, an end before the first and after each."""
    column = batch.column("units").take(pa.array(rows))
    bounds = column.offsets.to_numpy()
    units = column.flatten().to_numpy()
    out = np.full(len(units) + len(rows) + 1, end, np.int32)
    inside = np.ones(len(out), bool)
    inside[0] = False
    inside[bounds[1:] - bounds[0] + np.arange(1, len(rows) + 1)] = False
    out[inside] = units
    return out


def one_by_one(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The chunks of a batch, of which only one at a time lies in memory unpacked."""
    for row in range(batch.num_rows):
        yield tuple(batch.column(name)[row].as_py() for name in names)
        pa.default_memory_pool().release_unused()


def training_contexts(docs: pa.RecordBatch, further: bytes, units: Units, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of a chunk's training texts and their contexts while further words still count by their endings."""
    stream = token_stream(docs, np.flatnonzero(~docs.column("held_out").to_numpy(zero_copy_only=False)), units.end)
    endings = unpacked(further).column("ending").to_numpy()
    return stream, np.concatenate([context, CLASSES + endings], dtype=np.int32)[stream]


def neighbour_counts(units_table: DataFrame, units: Units, assigned: np.ndarray, classes_only: bool = False) -> DataFrame:
    """Neighbour classes of frequent words (unit, cell, n) and of their classes (unit = -1 - class)."""
    width = units.contexts

    def count(batches):
        words = np.zeros(units.frequent * 2 * width, np.int64)
        context = units.context_map(assigned)
        for batch in batches:
            for blob, further in one_by_one(batch, "docs", "further"):
                stream, near = training_contexts(unpacked(blob), further, units, context)
                met = stream < units.frequent
                words += np.bincount(stream[:-1][met[:-1]] * (2 * width) + near[1:][met[:-1]], minlength=len(words))
                words += np.bincount(stream[1:][met[1:]] * (2 * width) + width + near[:-1][met[1:]], minlength=len(words))
        grid = words.reshape(units.frequent, 2 * width)
        classes = np.zeros((CLASSES, 2 * width), np.int64)
        np.add.at(classes, assigned, grid)
        at, cell = np.nonzero(grid[:0] if classes_only else grid)
        class_at, class_cell = np.nonzero(classes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([at, -1 - class_at]), pa.int64()),
                pa.array(np.concatenate([cell, class_cell]), pa.int64()),
                pa.array(np.concatenate([grid[at, cell], classes[class_at, class_cell]]), pa.int64()),
            ],
            names=["unit", "cell", "n"],
        )

    return units_table.mapInArrow(count, "unit long, cell long, n long").groupBy("unit", "cell").agg(F.sum("n").alias("n"))


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(table: np.ndarray, assigned: np.ndarray, words: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Move each word to its best class, one after the other; ``table``: neighbour counts of the classes, kept up to date."""
    table = table.astype(float)
    total = table.sum(axis=1)
    out = {}
    for word in sorted(words):
        cells, counts = words[word]
        size = counts.sum()
        now = int(assigned[word])
        table[now, cells] -= counts
        total[now] -= size
        near = table[:, cells]
        gain = (entropy(near + counts) - entropy(near)).sum(axis=1) - (entropy(total + size) - entropy(total))
        best = int(gain.argmax())
        if gain[best] <= gain[now] + 1e-9:
            best = now
        table[best, cells] += counts
        total[best] += size
        out[word] = best
    return out


def cluster(units_table: DataFrame, units: Units, rounds: int) -> np.ndarray:
    """Classes of frequent words by distributed exchange."""
    assigned = np.arange(units.frequent) % CLASSES
    for _ in range(rounds if units.frequent else 0):
        cells = stored(neighbour_counts(units_table, units, assigned), "neighbours")
        table = class_table(cells, units)

        def move(batches, table=table, assigned=assigned):
            words: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            parts = [b for b in batches if b.num_rows]
            if parts:
                whole = pa.Table.from_batches(parts)
                unit = whole.column("unit").to_numpy()
                order = np.argsort(unit, kind="stable")
                cell, n = whole.column("cell").to_numpy()[order], whole.column("n").to_numpy()[order].astype(float)
                names, first = np.unique(unit[order], return_index=True)
                ends = np.append(first[1:], len(order))
                words = {int(w): (cell[a:b], n[a:b]) for w, a, b in zip(names, first, ends, strict=True)}
            found = exchange(table, assigned, words)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["unit", "cls"])

        moved = cells.filter("unit >= 0").repartition("unit").mapInArrow(move, "unit long, cls long").collect()
        assigned = assigned.copy()
        for r in moved:
            assigned[r["unit"]] = r["cls"]
    return assigned


def class_table(cells: DataFrame, units: Units) -> np.ndarray:
    table = np.zeros((CLASSES, 2 * units.contexts), np.int64)
    for r in cells.filter("unit < 0").collect():
        table[-1 - r["unit"], r["cell"]] = r["n"]
    return table


def further_neighbours(units_table: DataFrame, units: Units, assigned: np.ndarray) -> DataFrame:
    """For each chunk and further word the neighbour cells of its training tokens, left and right: (k, cells), one number for each neighbour."""
    width = units.contexts
    kind = np.uint8 if 2 * width <= 256 else np.uint16

    def neighbours(batches):
        context = units.context_map(assigned)
        for batch in batches:
            for blob, further in one_by_one(batch, "docs", "further"):
                stream, near = training_contexts(unpacked(blob), further, units, context)
                keys = unpacked(further).column("k").to_numpy()
                left, right = stream[:-1] >= units.further, stream[1:] >= units.further
                word = np.concatenate([stream[:-1][left], stream[1:][right]]) - units.further
                cell = np.concatenate([near[1:][left].astype(kind), (width + near[:-1][right]).astype(kind)])
                del stream, near, left, right
                cell = cell[np.argsort(word, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(keys)))])
                met = np.flatnonzero(np.diff(ends))
                for lo in range(0, len(met), 100_000):
                    part = met[lo : lo + 100_000]
                    first, last = ends[part[0]], ends[part[-1] + 1]
                    # Words without a training token here are empty ranges between the others.
                    offsets = (np.append(ends[part], last) - first).astype(np.int32) * cell.itemsize
                    values = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(cell[first:last].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.int64()), values], names=["k", "cells"])

    return units_table.mapInArrow(neighbours, "k long, cells binary")


def best_classes(table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class where each word, given its neighbour counts, raises the class bigrams' likelihood most; of equal ones the first."""
    total = table.sum(axis=1)
    base, base_total = entropy(table), entropy(total)
    out = np.zeros(len(grid), np.int64)
    for lo in range(0, len(grid), 200):
        part = grid[lo : lo + 200].astype(float)
        gain = (entropy(table[None] + part[:, None]) - base).sum(axis=2) - (entropy(total[None] + part.sum(axis=1, keepdims=True)) - base_total)
        out[lo : lo + 200] = gain.argmax(axis=1)
    return out


def join_classes(units_table: DataFrame, units: Units, assigned: np.ndarray) -> DataFrame:
    """The class of each further word by its neighbours in all training texts: (k, cls, n), n its training tokens."""
    width = 2 * units.contexts
    kind = np.uint8 if width <= 256 else np.uint16
    table = class_table(neighbour_counts(units_table, units, assigned, classes_only=True), units).astype(float)

    def choose(batches):
        def rows(names: np.ndarray, grid: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(best_classes(table, grid), pa.int32()), pa.array(grid.sum(axis=1) // 2, pa.int64())], names=["k", "cls", "n"]
            )

        # Rows come sorted by word: all words of a batch but the last are whole.
        name, counts = np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("k").to_numpy()
            cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), kind)
            sizes = pc.binary_length(batch.column("cells")).to_numpy() // cells.itemsize
            names, at = np.unique(k, return_inverse=True)
            grid = np.bincount(np.repeat(at, sizes) * width + cells, minlength=len(names) * width).reshape(-1, width)
            if len(name) and name[0] == names[0]:
                grid[0] += counts[0]
            elif len(name):
                yield rows(name, counts)
            yield rows(names[:-1], grid[:-1])
            name, counts = names[-1:], grid[-1:]
        if len(name):
            yield rows(name, counts)

    found = further_neighbours(units_table, units, assigned).repartition("k").sortWithinPartitions("k").mapInArrow(choose, "k long, cls int, n long")
    return stored(found, "lm-classes")


def classes_by_chunk(further: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes of each chunk's further words in order of their codes: (chunk, cls), a byte for each word."""

    def gather(key, rows):
        order = np.argsort(rows.column("code").to_numpy(), kind="stable")
        cls = rows.column("cls").to_numpy()[order].astype(np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "cls": pa.array([cls.tobytes()], pa.binary())})

    found = further.join(classes.select("k", "cls"), "k").select("chunk", "code", "cls")
    return stored(found.groupBy("chunk").applyInArrow(gather, "chunk long, cls binary"), "lm-chunk-classes")


def with_further(classes: np.ndarray, cls: bytes | None) -> np.ndarray:
    """The classes of all units of a chunk."""
    return np.concatenate([classes, np.frombuffer(cls or b"", np.uint8)], dtype=np.int32)


def transition_counts(units_table: DataFrame, units: Units, assigned: np.ndarray) -> np.ndarray:
    """How often a class follows a class in the training texts."""
    size = units.classes

    def count(batches):
        total = np.zeros(size * size, np.int64)
        classes = units.class_map(assigned, training=True)
        for batch in batches:
            for blob, cls in one_by_one(batch, "docs", "cls"):
                docs = unpacked(blob)
                stream = with_further(classes, cls)[token_stream(docs, np.flatnonzero(~docs.column("held_out").to_numpy(zero_copy_only=False)), units.end)]
                total += np.bincount(stream[:-1] * size + stream[1:], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    out = np.zeros(size * size)
    for r in units_table.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(size, size)


def log_transitions(counts: np.ndarray, units: Units) -> np.ndarray:
    """log10 P(class | class before), with the probability of any unknown word in all unknown-word columns."""
    share = (counts.sum(axis=0) + 0.01) / (counts.sum() + 0.01 * len(counts))
    chance = (counts + PULL * share) / (counts.sum(axis=1, keepdims=True) + PULL)
    unknown = CLASSES + 3 * np.arange(ENDINGS)
    chance[:, unknown] = chance[:, unknown].sum(axis=1, keepdims=True)
    return np.log10(chance)


def by_chunk(df: DataFrame, *kinds: str) -> tuple[DataFrame, str]:
    """Write a table bucketed by chunk, whose texts need no shuffle later, in a folder for each of ``kinds``; also its path."""
    spark = df.sparkSession
    name, path = f"lm_chunks_{uuid.uuid4().hex}", scratch_path(spark, "lm-chunks")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.partitionBy(*kinds).bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    return spark.table(name), path


def few_bytes(docs: DataFrame, limit: int = BATCH_BYTES) -> DataFrame:
    """``docs``, whose rows and all later ones go to Python tasks in batches of about ``limit`` bytes: a chunk is one large row.

    This sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session, unless it is smaller.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(name).rstrip("b")) <= limit:
        conf.set(name, str(limit))
    return docs


def score_texts(docs: DataFrame, rounds: int = ROUNDS, min_share: float = MIN_SHARE, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from the documents whose crc32(doc_id) mod 7 is not 2. ``base_score`` is the add-one unigram's log10 probability of the text,
    ``score`` the class model's.
    """
    docs = only(small_batches(few_bytes(docs)), "doc_id", "text").select("doc_id", (id_hash() % 7 == 2).alias("held_out"), "text")
    table, path = by_chunk(encode_chunks(docs), "kind")
    texts, chunks = table.filter("kind = 'texts'").select("chunk", "docs"), table.filter("kind = 'words'").drop("kind", "docs")
    training = docs.filter("not held_out").count()
    tokens = (chunks.agg(F.sum("n").alias("n")).first()["n"] or 0) + training
    min_count = max(2, min_count)
    least = max(min_count, int(np.ceil(min_share * tokens)))
    whole = Window.partitionBy("k").orderBy("chunk", "code")
    counted = (
        chunks.withColumn("c", F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("first", F.row_number().over(whole) == 1)
        .select("chunk", "code", "ending", "c", "first", F.when(F.col("c") >= min_count, F.col("k")).alias("k"))
    )
    counted = stored(counted, "lm-words")
    discard(docs.sparkSession, f"{path}/kind=words")
    words = counted.filter("first and c > 0")
    rare = words.filter("k is null").groupBy("ending").agg(
        F.sum((F.col("c") == 1).cast("long")).alias("once"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("more"), F.count("*").alias("types")
    ).collect()
    frequent = sorted(((r["c"], r["k"]) for r in words.filter(F.col("k").isNotNull() & (F.col("c") >= least)).select("c", "k").collect()), reverse=True)
    further = counted.filter(F.col("k").isNotNull() & (F.col("c") < least))
    distinct = len(frequent) + further.filter("first").count() + sum(r["types"] for r in rare) + (1 if training else 0)
    units = Units(len(frequent))
    keys = np.array([k for _, k in frequent], np.int64)
    order = np.argsort(keys)
    sorted_keys, numbers = keys[order], np.arange(len(keys))[order]
    room = tokens + distinct + 1

    def translate(key, left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        count, ending, number = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
        code = right.column("code").to_numpy()
        count[code] = right.column("c").to_numpy()
        ending[code] = right.column("ending").to_numpy()
        k = right.column("k").combine_chunks()
        clustered = k.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(clustered & (count[code] >= least))
        if len(at):
            number[code[at]] = numbers[np.searchsorted(sorted_keys, k.take(pa.array(at)).to_numpy(zero_copy_only=False))]
        at = np.flatnonzero(clustered & (count[code] < least))
        at = at[np.argsort(code[at], kind="stable")]
        number[code[at]] = units.further + np.arange(len(at))
        further = pa.RecordBatch.from_arrays(
            [k.take(pa.array(at, pa.int64())).cast(pa.int64()), pa.array(ending[code[at]], pa.int64())], names=["k", "ending"]
        )
        unit = units.of(count, ending, number)
        base = np.log10((count + 1) / room)
        logs = np.log10(np.maximum(count, 1))
        blobs = []
        for blob in left.column("docs").to_pylist():
            docs = unpacked(blob)
            codes, bounds = docs.column("codes").flatten().to_numpy(), docs.column("codes").offsets.to_numpy()

            def added(values: np.ndarray, bounds=bounds, codes=codes) -> np.ndarray:
                sums = np.zeros(len(codes) + 1)
                np.cumsum(values[codes], out=sums[1:])
                return sums[bounds[1:]] - sums[bounds[:-1]]

            batch = pa.RecordBatch.from_arrays(
                [
                    docs.column("doc_id"),
                    docs.column("held_out"),
                    pa.array(added((count > 0).astype(float)).round().astype(np.int64) + (1 if training else 0)),
                    pa.array(added(base) + np.log10((training + 1) / room)),
                    pa.array(added(logs)),
                    lists(unit[codes] if len(codes) else np.zeros(0, np.int32), bounds),
                ],
                names=["doc_id", "held_out", "n_known", "base", "logs", "units"],
            )
            blobs.append(packed(batch))
        pa.default_memory_pool().release_unused()
        return pa.table({"chunk": left.column("chunk"), "docs": pa.array(blobs, pa.binary()), "further": pa.array([packed(further)] * len(blobs), pa.binary())})

    units_table, _ = by_chunk(
        texts.groupBy("chunk").cogroup(counted.select("chunk", "code", "ending", "c", "k").groupBy("chunk")).applyInArrow(translate, "chunk long, docs binary, further binary")
    )
    discard(docs.sparkSession, path)
    assigned = cluster(units_table, units, rounds)
    classes = join_classes(units_table, units, assigned)
    chunk_classes = classes_by_chunk(further.select("chunk", "code", "k"), classes)
    units_table = units_table.select("chunk", "docs").join(chunk_classes, "chunk", "left")
    counts = transition_counts(units_table, units, assigned)
    transitions = log_transitions(counts, units)
    # What a class's words share out among themselves: tokens of the class; for words met once, the number of such words.
    mass = np.ones(units.classes)
    np.add.at(mass, assigned, np.array([c for c, _ in frequent], float) if frequent else np.zeros(0))
    for r in classes.groupBy("cls").agg(F.sum("n").alias("n")).collect():
        mass[r["cls"]] += r["n"]
    mass[:CLASSES] = np.maximum(mass[:CLASSES] - 1, 1)
    for r in rare:
        mass[CLASSES + 3 * r["ending"] + 1] = max(r["once"], 1)
        mass[CLASSES + 3 * r["ending"] + 2] = max(r["more"], 1)
    spread = np.log10(mass)
    spread[-1] = 0

    def score(batches):
        classes = units.class_map(assigned, training=False)
        for batch in batches:
            for blob, cls in one_by_one(batch, "docs", "cls"):
                docs = unpacked(blob)
                n = docs.num_rows
                stream = with_further(classes, cls)[token_stream(docs, np.arange(n), units.end)]
                steps = transitions.ravel()[stream[:-1] * units.classes + stream[1:]]
                steps -= spread[stream[1:]]
                lengths = np.diff(docs.column("units").offsets.to_numpy()).astype(np.int64) + 1
                sums = np.add.reduceat(steps, np.cumsum(lengths) - lengths) if n else np.zeros(0)
                base = docs.column("base").to_numpy()
                total = sums + docs.column("logs").to_numpy() if training else base
                yield pa.RecordBatch.from_arrays(
                    [docs.column("doc_id"), docs.column("held_out"), pa.array(lengths), docs.column("n_known"), pa.array(base), pa.array(total)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    scored = units_table.mapInArrow(score, SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
