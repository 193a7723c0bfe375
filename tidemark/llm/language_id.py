"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. A word (lower case, with the word mark in front) may be cut into
pieces in many ways; its probability is the sum over all of them, by the forward algorithm. A character outside the vocabulary is the piece
``<unk>``. The pieces' probabilities are fitted by expectation maximisation: forward and backward sums give the expected counts of pieces
in the training words, from a start in which all pieces are alike. Words longer than ``RUN`` characters are taken in runs of that length,
each scored whole.

Training words are counted by language in each task before they are shuffled, and the expected counts that tasks send are
bounded by vocabulary x languages, as is the model that goes to the tasks. Scores are posteriors under the languages' shares of training rows.

Rows: a null text or one without a letter is ``und`` with score 0; a null language trains nothing; rows with equal or null ids count each (a
null id is hashed as 0); without training rows all is ``und``; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_hash, only, slices, small_batches, stored, words_of

MARK = "▁"
RUN = 32
LATTICE = 24_000
ROUNDS = 2
SMOOTHING = 0.1
UNKNOWN = "und"
MIN_SCORE = 0.5
STEP = np.uint64(0x100000001B3)


class Pieces:
    """The vocabulary as a lookup from hashes of code points to piece numbers."""

    SLOTS = 18

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        self.tables = []
        todo = {p: k for k, p in enumerate(pieces)}
        factor = 0x9E3779B97F4A7C15
        while todo:
            keys = np.zeros(1 << self.SLOTS, np.uint64)
            values = np.full(1 << self.SLOTS, -1, np.int32)
            left = {}
            for piece, k in todo.items():
                h = self.hash_of(piece)
                slot = (h * factor & 0xFFFFFFFFFFFFFFFF) >> (64 - self.SLOTS)
                if values[slot] < 0:
                    keys[slot], values[slot] = h, k
                else:
                    left[piece] = k
            self.tables.append((np.uint64(factor), keys, values))
            todo, factor = left, factor * 6364136223846793005 % (1 << 64) | 1

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        for factor, keys, values in self.tables:
            slot = (h * factor) >> np.uint64(64 - self.SLOTS)
            out = np.where(keys[slot] == h, values[slot], out)
        return out


def read_pieces(model_path: str) -> list[str]:
    """Pieces of a sentencepiece file by number; control and byte pieces stand for themselves and match no text."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    odd = [model.is_control(k) or model.is_byte(k) or model.is_unknown(k) for k in range(len(plain))]
    return [f"\x00{k}" if bad else p for k, (p, bad) in enumerate(zip(plain, odd, strict=True))]


class Lattice:
    """All segmentations of many runs of characters at once, one array operation for each end and length of a piece."""

    def __init__(self, words: list[str], pieces: Pieces, unknown: int = 0):
        marked = [MARK + w for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        starts = np.cumsum(sizes) - sizes
        runs = -(-sizes // RUN)
        owner = np.repeat(np.arange(len(sizes)), runs)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        length = np.minimum(sizes[owner] - within * RUN, RUN)
        order = np.argsort(-length, kind="stable")
        self.owner, self.length = owner[order], length[order]
        begin = (starts[owner] + within * RUN)[order]
        self.words = len(words)
        self.live = [int(np.searchsorted(-self.length, -j, side="right")) for j in range(RUN + 1)]
        self.arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[]]
        rolling: list[np.ndarray] = []
        for j in range(1, RUN + 1):
            n = self.live[j]
            if not n:
                break
            char = codes[begin[:n] + j - 1]
            rolling = [char, *(h[:n] * STEP + char for h in rolling[: pieces.longest - 1])]
            found = []
            for back, h in enumerate(rolling, 1):
                ids = pieces.find(h)
                if back == 1:
                    ids = np.where(ids < 0, unknown, ids)
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    found.append((j - back, at, ids[at]))
            self.arcs.append(found)

    def forward(self, probability: np.ndarray) -> list[np.ndarray]:
        """Forward sums by place; ``probability``: pieces x languages."""
        sums = [np.ones((len(self.length), probability.shape[1]))]
        for j in range(1, len(self.arcs)):
            now = np.zeros((self.live[j], probability.shape[1]))
            for start, at, ids in self.arcs[j]:
                now[at] += sums[start][at] * probability[ids]
            sums.append(now)
        return sums

    def totals(self, sums: list[np.ndarray]) -> np.ndarray:
        out = np.ones((len(self.length), sums[0].shape[1]))
        for j in range(1, len(sums)):
            lo = self.live[j + 1] if j + 1 < len(sums) else 0
            out[lo : self.live[j]] = sums[j][lo:]
        return out

    def log_probability(self, probability: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability, words x languages."""
        logs = np.log(self.totals(self.forward(probability)))
        return np.stack([np.bincount(self.owner, weights=logs[:, k], minlength=self.words) for k in range(logs.shape[1])], axis=1)

    def expected(self, probability: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected counts of pieces, pieces x languages, if word w occurs ``counts[w]`` times in each language."""
        sums = self.forward(probability)
        share = counts[self.owner] / self.totals(sums)
        languages = probability.shape[1]
        back = [np.zeros((self.live[j], languages)) for j in range(len(sums))]
        back[0] = np.zeros((len(self.length), languages))
        numbers, weights = [], []
        for j in range(len(sums) - 1, 0, -1):
            lo = self.live[j + 1] if j + 1 < len(sums) else 0
            back[j][lo:] = share[lo : self.live[j]]
            for start, at, ids in self.arcs[j]:
                flow = probability[ids] * back[j][at]
                back[start][at] += flow
                numbers.append(ids)
                weights.append(sums[start][at] * flow)
        if not numbers:
            return np.zeros_like(probability)
        ids, flow = np.concatenate(numbers), np.concatenate(weights)
        return np.stack([np.bincount(ids, weights=flow[:, k], minlength=len(probability)) for k in range(languages)], axis=1)


def lowered(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words, each word's number among them, and the texts' bounds."""
    words, bounds = words_of(texts)
    coded = words.dictionary_encode() if not isinstance(words, pa.ChunkedArray) else words.combine_chunks().dictionary_encode()
    small = pc.utf8_lower(coded.dictionary).dictionary_encode()
    codes = small.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    return small.dictionary.to_pylist(), codes, bounds


def word_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """How often each lower-case word stands in the training texts of each language: word, lang (number), n."""
    number = {name: k for k, name in enumerate(languages)}

    def count(batches):
        for batch in slices(batches, limit=12 << 20):
            words, codes, bounds = lowered(batch.column("text"))
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            keys = codes.astype(np.int64) * len(number) + np.repeat(langs, np.diff(bounds))
            counts = np.bincount(keys, minlength=len(words) * len(number)) if len(keys) else np.zeros(0, np.int64)
            at = np.flatnonzero(counts)
            for lo in range(0, len(at), 100_000):
                part = at[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()).take(pa.array(part // len(number))), pa.array((part % len(number)).astype(np.int32)), pa.array(counts[part], pa.int64())],
                    names=["word", "lang", "n"],
                )

    return docs.mapInArrow(count, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Languages with their piece probabilities and prior shares."""

    def __init__(self, languages: list[str], shares: np.ndarray, probability: np.ndarray, pieces: Pieces):
        self.languages, self.shares, self.probability, self.pieces = languages, shares, probability, pieces


def train(docs: DataFrame, model_path: str, rounds: int = ROUNDS) -> Model:
    """Fit on (text, lang) rows with a language."""
    docs = small_batches(docs).select("text", "lang").filter("lang is not null and text is not null")
    shares = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    pieces = Pieces(read_pieces(model_path))
    count = len(languages)
    probability = np.full((pieces.size, count), 1.0 / pieces.size)
    if not languages:
        return Model([], np.zeros(0), probability, pieces)
    words = stored(word_counts(docs, languages), "language-words")
    for _ in range(rounds):

        # Functions carry the model by value, so executors need no copy of this package.
        def expect(batches, lexicon=pieces, now=probability):
            total = np.zeros_like(now)
            for batch in batches:
                for lo in range(0, batch.num_rows, LATTICE):
                    part = batch.slice(lo, LATTICE)
                    coded = part.column("word").dictionary_encode()
                    counts = np.zeros((len(coded.dictionary), now.shape[1]))
                    np.add.at(counts, (coded.indices.to_numpy(), part.column("lang").to_numpy()), part.column("n").to_numpy())
                    total += Lattice(coded.dictionary.to_pylist(), lexicon).expected(now, counts)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.reshape(-1)[at])], names=["cell", "n"])

        counts = np.zeros(pieces.size * count)
        for r in words.mapInArrow(expect, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[r["cell"]] = r["n"]
        counts = counts.reshape(pieces.size, count) + SMOOTHING
        probability = counts / counts.sum(axis=0)
    total = np.array([shares[x] for x in languages], float)
    return Model(languages, total / total.sum(), probability, pieces)


def scored(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior."""
    n = len(texts)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model.languages or not letters.any():
        return [UNKNOWN] * n, np.zeros(n)
    words, codes, bounds = lowered(texts)
    logs = np.concatenate([Lattice(words[k : k + LATTICE], model.pieces).log_probability(model.probability) for k in range(0, len(words), LATTICE)])
    owner = np.repeat(np.arange(n), np.diff(bounds))
    total = np.stack([np.bincount(owner, weights=logs[codes, k], minlength=n) for k in range(logs.shape[1])], axis=1) + np.log(model.shares)
    best = total.argmax(axis=1)
    posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, posterior, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score in place of text; the other columns stay. One of the columns is ``text``."""
    kept = [c for c in docs.columns if c != "text"]

    def score(batches):
        for batch in slices(batches, limit=12 << 20):
            names, scores = scored(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = docs.select(*[F.col(c) for c in kept], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(score, schema)


def identify(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learnt from those not held out (crc32 of doc_id mod 5 is 0)."""
    docs = only(docs, "doc_id", "text", "lang")
    out = (id_hash() % 5 == 0).alias("held_out")
    model = train(docs.filter(id_hash() % 5 != 0), model_path)
    return predict(docs.select("doc_id", out, "text"), model)


def recognised(docs: DataFrame, model_path: str, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without texts that have no letter or whose likeliest language has a posterior under ``min_score``."""
    model = train(docs.filter(id_hash() % 5 != 0), model_path)

    def keep(batches):
        for batch in slices(batches, limit=12 << 20):
            names, scores = scored(batch.column("text"), model)
            yield batch.filter(pa.array([name != UNKNOWN and s >= min_score for name, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
