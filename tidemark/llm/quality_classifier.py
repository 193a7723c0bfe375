"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each whole text gives some twenty statistics. Random Fourier features (cosines at normal frequencies) of the standardised statistics approximate a
Gaussian kernel. Tasks sum the normal equations of their rows, so what is shuffled and solved depends on the number of features alone. The labelled rows
fall in two folds; the equations of one fold score the other, and these scores, counted in ``BINS`` bins, are made monotone by pooling
adjacent violators. The final weights come from the equations of both folds.

Rows: a null or empty text has all-zero statistics and is scored like any other; labels that are null count as none, a doc_id labelled several
times counts with the mean of its labels; rows with equal or null doc_ids are scored each (null ids learn nothing); without labelled rows all
scores are 0.5; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import coded, hashes, id_hash, inverted, only, slices, stored, window_hashes, words_of

COSINES = 192
GAMMA = 0.03
RIDGE = 1e-4
BINS = 1000
LOW, HIGH = -0.5, 1.5
STATISTICS = 20


def distinct_shares(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of each text's keys that repeat an earlier one of the text."""
    counts = np.diff(at)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    pairs = np.sort((owner << np.uint64(44)) | (keys >> np.uint64(20)))
    first = np.concatenate([[True], pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, bool)
    distinct = np.bincount((pairs[first] >> np.uint64(44)).astype(np.int64), minlength=len(counts))
    return 1 - distinct / np.maximum(counts, 1) * (counts > 0) - (counts == 0)


def statistics(texts: pa.Array) -> np.ndarray:
    """Statistics of whole texts, one row each."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    _, offsets, payload = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(payload, np.uint8)[bounds[0] : bounds[-1]] if payload is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    size = np.maximum(np.diff(bounds), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / size

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    stop = np.zeros(256, bool)
    stop[list(b".!?")] = True
    words, at = words_of(texts)
    strings, codes = coded(words)
    values = hashes(strings)[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.diff(at)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    lettered = np.fromiter((any(c.isalpha() for c in s) for s in strings), np.float64, len(strings))

    def mean(per_word: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(per_word[codes] if len(codes) else np.zeros(0))])
        return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(counts, 1)

    grams, gram_at = window_hashes(values, at, 3)
    parts = pc.split_pattern(texts, "\n")
    lines, line_codes = coded(parts.flatten())
    line_values = hashes(lines)[line_codes] if len(line_codes) else np.zeros(0, np.uint64)
    line_at = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
    word_mean = mean(lengths.astype(float))
    return np.stack(
        [
            np.log1p(np.diff(bounds)),
            np.log1p(counts),
            word_mean,
            np.sqrt(np.maximum(mean(lengths.astype(float) ** 2) - word_mean**2, 0)),
            share(symbol[data]) * 10,
            share(data == 33) * 10,
            share(stop[data]) * 10,
            share(data == 44) * 10,
            share(upper) / np.maximum(share(upper) + share(lower), 1e-9),
            share((data >= 48) & (data <= 57)) * 5,
            share(data == 10) * 10,
            share(data >= 128) * 2,
            share((data < 128) & ~upper & ~lower & (data > 32) & ~((data >= 48) & (data <= 57))) * 5,
            mean(lettered),
            distinct_shares(values, at),
            distinct_shares(grams, gram_at),
            distinct_shares(line_values, line_at),
            np.log1p(np.diff(line_at)),
            mean((lengths == 1).astype(float)) * 5,
            mean((lengths > 20).astype(float)) * 5,
        ],
        axis=1,
    )


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and its text's statistics, stored."""

    def measure(batches):
        for batch in slices(batches, limit=8 << 20):
            found = statistics(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, STATISTICS), pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "x"])

    return stored(only(docs, "doc_id", "text").mapInArrow(measure, "doc_id long, x array<double>"), "statistics")


@dataclass
class Features:
    """Standardisation and the fixed random frequencies."""

    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.spread, -8, 8)
        waves = np.cos(x @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(x), 1)), x, waves])


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATISTICS)


def normal_equations(train: DataFrame, features: Features) -> np.ndarray:
    """Summed equations of each of the two folds: (2, width, width + 1), the last column for the labels. ``train``: fold, x, y."""
    width = 1 + STATISTICS + len(features.phases)

    def add(batches):
        sums = np.zeros((2, width, width + 1))
        for batch in batches:
            z = features.of(rows_of(batch.column("x")))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for fold in (0, 1):
                mine = z[folds == fold]
                sums[fold, :, :width] += mine.T @ mine
                sums[fold, :, width] += mine.T @ y[folds == fold]
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(sums.reshape(-1)[cells])], names=["cell", "v"])

    out = np.zeros(2 * width * (width + 1))
    for r in train.mapInArrow(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(2, width, width + 1)


def ridge(equations: np.ndarray) -> np.ndarray:
    """Weights of summed equations; the first feature is the constant, so its square sum is the number of rows."""
    width = len(equations)
    penalty = np.full(width, RIDGE * max(equations[0, 0], 1.0) + 1e-3)
    penalty[0] = 1e-6
    return (inverted(equations[:, :width] + np.diag(penalty)) * equations[:, width]).sum(axis=1)


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)


def monotone(good: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The share of label 1 in each bin, made non-decreasing by pooling adjacent violators and joined by lines between the pools' centres."""
    pools: list[list[float]] = []
    for k in np.flatnonzero(count):
        pools.append([good[k], count[k], k * count[k]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    if not pools:
        return np.full(len(count), 0.5)
    # Half a row of either label keeps a pool of few rows from certainty.
    values = [(g + 0.5 * (g / n)) / (n + 0.5) if 0 < g < n else (g + 0.25) / (n + 0.5) for g, n, _ in pools]
    return np.interp(np.arange(len(count)), [c / n for _, n, c in pools], np.maximum.accumulate(values))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. ``labels``: doc_id, label (1 good, 0 bad).

    Rows with crc32(doc_id) mod 3 = 1 are held out of all learning.
    """
    table = statistics_table(docs)
    labels = labels.select("doc_id", F.col("label").cast("double").alias("label")).filter("label is not null").groupBy("doc_id").agg(F.avg("label").alias("y"))
    fold = F.when(id_hash() % 3 == 0, 0).otherwise(1)
    train = table.filter(id_hash() % 3 != 1).join(labels, "doc_id").select(fold.alias("fold"), "x", "y")
    train = stored(train, "labelled")
    sums = train.agg(
        F.count("*").alias("n"),
        *[F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(STATISTICS)],
        *[F.sum(F.col("x")[k] * F.col("x")[k]).alias(f"q{k}") for k in range(STATISTICS)],
    ).first()
    held_out = (id_hash() % 3 == 1).alias("held_out")
    if not sums["n"]:
        return table.select("doc_id", held_out, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mean = np.array([sums[f"s{k}"] for k in range(STATISTICS)]) / sums["n"]
    spread = np.sqrt(np.maximum(np.array([sums[f"q{k}"] for k in range(STATISTICS)]) / sums["n"] - mean**2, 1e-6))
    draw = np.random.default_rng(20)
    frequencies = draw.normal(0, np.sqrt(2 * GAMMA), (STATISTICS, COSINES))
    features = Features(mean, spread, frequencies, draw.uniform(0, 2 * np.pi, COSINES))
    equations = normal_equations(train, features)
    # Fold k is scored by the weights of the other fold.
    crossed = np.stack([ridge(equations[1]), ridge(equations[0])])
    weights = ridge(equations.sum(axis=0))

    def bins(batches):
        for batch in batches:
            z = features.of(rows_of(batch.column("x")))
            raw = (z * crossed[batch.column("fold").to_numpy(zero_copy_only=False)]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(bin_of(raw), pa.int64()), batch.column("y")], names=["bin", "y"])

    good, count = np.zeros(BINS), np.zeros(BINS)
    for r in train.mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect():
        good[r["bin"]], count[r["bin"]] = r["good"], r["n"]
    curve = monotone(good, count)

    def score(batches):
        for batch in batches:
            raw = (features.of(rows_of(batch.column("x"))) * weights).sum(axis=1)
            # Between bins along the line, so that the order of raw scores is kept where the curve rises.
            place = np.clip((raw - LOW) / (HIGH - LOW) * BINS - 0.5, 0, BINS - 1)
            values = np.interp(place, np.arange(BINS), curve)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return table.select("doc_id", held_out, "x").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
