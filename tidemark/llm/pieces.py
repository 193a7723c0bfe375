"""Token ids of whole texts by a public tokenizer file.

A text is cut where the byte-level pattern always ends a piece (a single white-space character between
characters that are none, an ASCII letter before ASCII punctuation, both sides of a line break), so that each
distinct piece of a task is encoded once. The ids are those of encoding the whole text; a property test holds
both against each other.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm.common import slices, worker_cache

CACHE_PIECES = 300_000
SLICE = 6 << 20


def _byte_classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 3
    kinds[48:58] = 0
    kinds[65:91] = kinds[97:123] = 2
    kinds[32] = 1
    kinds[10] = 4
    return kinds


# 1 space, 4 line break, 2 ASCII letter, 3 ASCII punctuation, 0 the rest
KINDS = _byte_classes()
# Bytes that may begin a white-space character beyond a space, or be one.
OPENS_SPACE = np.zeros(256, bool)
OPENS_SPACE[list(range(9, 14)) + list(range(28, 33)) + [0xC2, 0xE1, 0xE2, 0xE3]] = True


def piece_bounds(data: np.ndarray, texts: np.ndarray, specials: list[bytes] = ()) -> np.ndarray:
    """Where pieces begin and end in the joined bytes of texts; ``texts`` holds the bounds of the texts.

    The strings of ``specials`` are never cut.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[texts] = True
    if n > 2:
        kinds = KINDS[data]
        cut[1:n] |= (kinds[:-1] == 2) & (kinds[1:] == 3)
        at = np.flatnonzero((kinds == 1) | (kinds == 4))
        at = at[(at > 0) & (at < n - 1)]
        before = data[at - 1]
        good = ~OPENS_SPACE[data[at + 1]] & ~((before >= 9) & (before <= 13)) & ~((before >= 28) & (before <= 32))
        wide = np.flatnonzero(before >= 0x80)
        if len(wide):
            # The character before may be a white-space character of two or three bytes.
            lead2 = data[np.maximum(at[wide] - 2, 0)]
            lead3 = data[np.maximum(at[wide] - 3, 0)]
            good[wide] &= ~((lead2 == 0xC2) | (lead3 == 0xE1) | (lead3 == 0xE2) | (lead3 == 0xE3))
        at = at[good]
        # White space at a text's edge ends no piece.
        edge = np.zeros(n + 1, bool)
        edge[texts] = True
        at = at[~edge[at] & ~edge[at + 1]]
        cut[at] = True
        cut[at[kinds[at] == 4] + 1] = True
        for special in specials:
            joined = data.tobytes()
            place = joined.find(special)
            while place >= 0:
                cut[place + 1 : place + len(special)] = edge[place + 1 : place + len(special)]
                place = joined.find(special, place + 1)
    return np.flatnonzero(cut)


class Encoder:
    """Encodes slices of texts; keeps the ids of pieces it has met, up to a bound of pieces."""

    def __init__(self, tokenizer_path: str, text_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # True: the strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = text_specials
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [] if text_specials else [t.content.encode() for t in added]
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            total = int(sizes.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
            self.flat[self.used : self.used + total] = np.fromiter((x for ids in lists for x in ids), np.int32, total)
            have = len(self.known)
            while have + len(part) > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
                self.lengths = np.concatenate([self.lengths, np.zeros(len(self.lengths), np.int64)])
            self.lengths[have : have + len(part)] = sizes
            self.starts[have : have + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.used += total
            self.known.update(zip(part, range(have, have + len(part)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text's ids. A null text counts as empty."""
        texts = texts.fill_null("")
        if texts.type != pa.string():
            texts = texts.cast(pa.string())
        _, offsets, payload = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first = int(bounds[0])
        size = int(bounds[-1]) - first
        bounds = (bounds - first).astype(np.int64)
        if size == 0:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(payload, np.uint8)[first : first + size]
        at = piece_bounds(data, bounds, self.specials)
        pieces = pa.Array.from_buffers(
            pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        if len(self.known) > CACHE_PIECES:
            self.known, self.used = {}, 0
        distinct = pieces.dictionary.to_pylist()
        get = self.known.get
        ids = list(map(get, distinct))
        fresh = [p for p, i in zip(distinct, ids, strict=True) if i is None]
        if fresh:
            self._learn(fresh)
            ids = list(map(self.known.get, distinct))
        place = np.array(ids, np.int64)[pieces.indices.to_numpy(zero_copy_only=False)]
        lengths, starts = self.lengths[place], self.starts[place]
        ends = np.cumsum(lengths)
        out = self.flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])]
        edges = np.concatenate([[0], ends])
        return out, edges[np.searchsorted(at, bounds)]


def encoder(tokenizer_path: str, text_specials: bool = False) -> Encoder:
    """One encoder for each Python worker and file: what it knows serves the worker's later tasks too."""
    held = worker_cache()
    key = ("encoder", tokenizer_path, text_specials)
    if key not in held:
        held[key] = Encoder(tokenizer_path, text_specials)
    return held[key]


def split_ids(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with ``end_id`` behind them, and the new bounds."""
    n = len(bounds) - 1
    new = bounds + np.arange(n + 1)
    out = np.empty(int(new[-1]), np.int32)
    ends = new[1:] - 1
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[ends] = end_id
    out[mask] = ids
    return out, new


def encoded_slices(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, text_specials: bool = False):
    """For each slice of (doc_id, text): the batch, its ids and their bounds, each document closed by ``end_id``."""
    enc = encoder(tokenizer_path, text_specials)
    for batch in slices(batches, limit=SLICE):
        ids, bounds = enc.encode(batch.column("text"))
        yield batch, *split_ids(ids, bounds, end_id)
