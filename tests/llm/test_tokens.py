"""Token files and packing: exact round trips against the tokenizer, cover of every id, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import no_docs, odd_docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, token_files
from tidemark.llm.pieces import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
PIECES = Encoder(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab Z'.,!é\u00a0\u2003\u3000\u0085\t\n\r1_-s日|>\x1c", "<|endoftext|>"]), max_size=30).map("".join), max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    ids, bounds = PIECES.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark):
    docs = odd_docs(spark)
    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(docs, folder, PATH, end_id=0)
    rows = token_files.token_digests(manifest, folder).collect()
    rows.sort(key=lambda r: r["start"])
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [d for d, _ in texts]
    at = 0
    expected = defaultdict(list)
    for doc_id, text in texts:
        ids = WHOLE.encode(text or "", add_special_tokens=False).ids + [0]
        expected[doc_id].append((len(ids), crc(ids)))
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in expected[r["doc_id"]]
    some = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(manifest, folder, [9, 10, 99]).collect()}
    assert set(some) == {9, 10}
    assert some[10] == WHOLE.encode(next(t for d, t in texts if d == 10), add_special_tokens=False).ids + [0]
    everything = token_files.read_token_files(manifest, folder).collect()
    assert sorted(len(r["ids"]) for r in everything) == sorted(r["n_tokens"] for r in rows)


def test_a_reader_unpacks_only_what_it_needs_and_sees_damage():
    sink = pa.BufferOutputStream()
    writer = token_files.TokenFileWriter(sink, frame_tokens=10)
    for k in range(20):
        writer.add(k, np.arange(k * 3, k * 3 + 4))
    writer.close()
    data = bytes(sink.getvalue().to_pybytes())
    reader = token_files.TokenFileReader(pa.BufferReader(data))
    assert [(d, x.tolist()) for d, x in reader.read([7])] == [(7, [21, 22, 23, 24])]
    assert reader.frames_read == 1
    damaged = bytearray(data)
    damaged[int(reader.places[2]) + 5] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017 zstandard or the checksum, whichever sees it first
        list(token_files.TokenFileReader(pa.BufferReader(bytes(damaged))).documents())


def test_token_files_of_an_empty_table(spark):
    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(no_docs(spark), folder, PATH)
    assert token_files.token_digests(manifest, folder).collect() == []


def check_pieces(docs, pieces, capacity):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(WHOLE.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces.collect():
        by_doc[(p["doc_id"], p["doc_tokens"])].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert sum(len(v) for v in texts.values()) == sum(1 for ps in by_doc.values() for p in ps if p["start"] == 0)
    for (doc_id, n), ps in by_doc.items():
        ids = next(x for x in texts[doc_id] if len(x) == n)
        assert sum(p["length"] for p in ps) % n == 0
        for p in ps:
            assert crc(ids[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"]
    padding = total = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        total += at
        padding += capacity - at if at & (at - 1) else 0
    return padding / max(total, 1)


def test_packing_covers_every_id_once(spark):
    docs = odd_docs(spark)
    assert check_pieces(docs, packing.pack_documents(docs, PATH), packing.CAPACITY) < 0.05


def test_packing_many_documents_leaves_little_padding(spark):
    draw = random.Random(3)
    docs = spark.createDataFrame([(k, prose(k, draw.randrange(1, 260))) for k in range(600)], "doc_id long, text string")
    encoded = packing.encode_documents(docs, PATH, 1)
    pieces = packing.pack_encoded(encoded)
    assert check_pieces(docs, pieces, packing.CAPACITY) < 0.02
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(encoded, pieces).collect()}
    sizes = {r["sequence_id"]: r["n"] for r in pieces.groupBy("sequence_id").sum("length").toDF("sequence_id", "n").collect()}
    assert {k: len(v) // 4 for k, v in whole.items()} == sizes


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(no_docs(spark), PATH).collect() == []


def test_knapsack_is_the_best_of_all():
    draw = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.unique(draw.integers(1, 12, 4))
        prices = draw.random(len(sizes))
        best = [0.0] * 25
        for room in range(1, 25):
            best[room] = max([best[room - 1], *(best[room - s] + p for s, p in zip(sizes, prices) if s <= room)])
        value, counts = packing.best_pattern(sizes, prices, 24)
        assert value == pytest.approx(best[24]) and (counts * prices).sum() == pytest.approx(value) and (counts * sizes).sum() <= 24


def test_plan_is_near_the_bound_and_deals_no_item_twice():
    draw = np.random.default_rng(1)
    histogram = {int(c): int(n) for c, n in zip(range(1, 257), draw.integers(0, 4000, 256))}
    plan = packing.make_plan(histogram)
    used = defaultdict(int)
    for c, n in histogram.items():
        if n:
            sequences = packing.deal(plan, np.full(n, c), np.arange(n))
            for s, k in zip(*np.unique(sequences[sequences >= 0], return_counts=True)):
                used[s] += c * k
    assert max(used.values()) <= 256 and len(used) == plan.sequences
    units = sum(c * n for c, n in histogram.items())
    assert plan.bound <= 1.011 * units / 256 + 1
    assert units - sum(c * n for c, n in plan.dealt.items()) < 0.02 * units
