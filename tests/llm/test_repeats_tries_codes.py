"""Repeated spans, prefix tries and vector codes against brute force, with every odd row."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.cases import no_docs, odd_docs, prose
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, repeated_spans, vector_codes

# ---- repeated spans


def cut(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    whole = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in whole for i in range(len(b) - length + 1))
    out = []
    for b in whole:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return out


def edited_texts(seed, length, letters):
    draw = random.Random(seed)
    stock = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 5, length, 3 * length, 10 * length]))) for _ in range(20)]
    out = [None, ""]
    for _ in range(80):
        text = draw.choice(stock)
        if text and draw.random() < 0.7:
            at = draw.randrange(len(text))
            text = text[:at] + draw.choice(["", "x", "yy"]) + text[at + draw.randrange(3) :]
        if draw.random() < 0.3:
            text += draw.choice(stock)[: 3 * length]
        if draw.random() < 0.05:
            text = "x" * draw.choice([length - 1, length, length + 1, 5 * length])
        out.append(text)
    return out


@pytest.mark.parametrize(("length", "letters", "piece"), [(16, "ab", 256), (20, "abcdéfgh ", 1 << 17), (37, "abc", 100), (64, "abcdefgh ", 300), (200, "ab日c ", 1 << 17)])
def test_repeats_against_brute_force(spark, monkeypatch, length, letters, piece):
    monkeypatch.setattr(repeated_spans, "PIECE", piece)
    texts = edited_texts(length, length, letters)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in repeated_spans.without_repeats(df, length).collect())
    assert got == [(k, *x) for k, x in enumerate(cut(texts, length))]


def test_repeats_in_many_small_slices(spark, monkeypatch):
    monkeypatch.setattr(repeated_spans, "SLICE", 700)
    texts = edited_texts(5, 40, "abcd")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in repeated_spans.without_repeats(df, 40).collect())
    assert got == [(k, *x) for k, x in enumerate(cut(texts, 40))]


def test_repeats_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = docs.select("doc_id", "text").collect()
    expected = [(r["doc_id"], *x) for r, x in zip(rows, cut([r["text"] for r in rows], 200), strict=True)]
    key = lambda r: (r[0] is not None, r[0], *r[1:])
    got = repeated_spans.without_repeats(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    assert repeated_spans.without_repeats(no_docs(spark)).collect() == []


def test_a_passage_that_a_third_of_all_texts_share(spark):
    passage = prose(99, 60)
    texts = [(passage if k % 3 == 0 else "") + prose(k, 50) for k in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = sorted(tuple(r) for r in repeated_spans.without_repeats(df).collect())
    assert got == [(k, *x) for k, x in enumerate(cut(texts, 200))]


def test_identifiers_are_equal_for_equal_strings_alone():
    data = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcXabcabcabcabcabcabc", np.uint8)
    _, _, ids, q = repeated_spans.identifiers(data, 17, repeated_spans.LANES[0])
    assert q == 8
    by_text = {}
    for i, x in enumerate(ids.tolist()):
        by_text.setdefault(bytes(data[i : i + 17]), set()).add(x)
    assert all(len(x) == 1 for x in by_text.values())
    assert len(set().union(*by_text.values())) == len(by_text)


# ---- prefix tries


def nodes_of(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    ordered = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    whole = {}
    for c, ts in ordered.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(ordered.get(c - c % 100, [])[:h] + ts[h:])
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == p)
        above = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), above, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=order)


def order(row):
    return tuple((x is not None, x) for x in row)


def talk(seed, ids=120, family=300):
    draw = random.Random(seed)
    rows = []
    for c in [100, 200, *draw.sample(range(family), ids)]:
        for turn in range(draw.choice([1, 2, 5, 8, 8, 30])):
            text = draw.choice(["a", "bé", None, "ccc"]) if turn < 3 else draw.choice(["x", "yy"])
            rows.append((c, turn if turn else None, draw.choice(["user", None]), text))
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    draw.shuffle(rows)
    return rows


TURNS = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize(("stretch", "shard"), [(1024, 1 << 16), (4, 50), (1, 7)])
def test_trie_against_brute_force(spark, stretch, shard):
    rows = talk(stretch)
    rows += [(c, t, "user", "z" * (t % 3)) for c in (77, 78) for t in range(1000, 1100)] + [(None, 1, "user", "lost")]
    rows += [(302, 0, "user", "a")]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    got = prefix_trie.prefix_trie(df, stretch, shard)
    assert sorted(map(tuple, got.collect()), key=order) == nodes_of(rows)


def test_trie_of_one_hot_conversation_over_many_ranges(spark):
    rows = [(5, t, "user", f"t{t % 50}") for t in range(300)] + [(c, t, "user", f"t{t}") for c in range(6, 40) for t in range(8)]
    df = spark.createDataFrame(rows, TURNS)
    prefixes = prefix_trie.rebuilt(df.repartition(9))
    assert prefixes.filter("conv_id = 5").selectExpr("count(*)", "count(distinct a, b)", "max(depth)").first()[:2] == (prefixes.filter("conv_id = 5").count(),) * 2
    got = prefix_trie.prefix_trie(df, 64, 100)
    assert sorted(map(tuple, got.collect()), key=order) == nodes_of(rows)


def test_trie_of_odd_rows(spark):
    names = "conv_id long, turn int, role string, text string, shard int, depth long, a string, h long, stretch string, base int"
    rows = [(1, None, None, None), (1, 2, "user", ""), (1, 2, "user", ""), (1, 3, "user", "x" * 100_000), (2, 1, "", None), (None, None, None, None), (100, 1, "user", "b" * 9)]
    df = spark.createDataFrame([(*r, 1, 2, "a", 3, "s", 4) for r in rows], names)
    got = prefix_trie.prefix_trie(df)
    assert sorted(map(tuple, got.collect()), key=order) == nodes_of(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []


def test_slots_are_minimal_and_verified():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 1 << 63, 5000).astype(np.uint64), draw.integers(0, 1 << 63, 5000).astype(np.uint64)
    slots = prefix_trie.Slots(a, b)
    assert sorted(slots.of(a, b).tolist()) == list(range(5000))
    with pytest.raises(ValueError, match="no slot"):
        slots.of(a + np.uint64(1), b)


# ---- vector codes


def codes_of(rows, parts=16, entries=64, rounds=2):
    kept = [(v, label, [math.floor(256 * x) for x in vec]) for v, vec, label in rows if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    wide = len(kept[0][2]) // parts
    piece = lambda x, p: x[p * wide : (p + 1) * wide]
    books = [[piece(x, p) for _, _, x in kept[:entries]] for p in range(parts)]

    def assign(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(piece(x, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, _, x in kept:
                groups.setdefault(assign(x, p)[1], []).append(piece(x, p))
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])])
        books = new
    out, totals = [], Counter()
    for v, label, x in kept:
        found = [assign(x, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        totals[label] += error
        out.append((v, label, "".join(f"{k:02x}" for _, k in found), error))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((v, code, error, totals[label], digest) for v, label, code, error in out), key=order)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, length=32, spread=0.4):
    draw = random.Random(seed)
    single = lambda x: float(np.float32(x))
    return [(k * 3, [single(draw.gauss(0, spread)) for _ in range(length)], draw.choice([1, 2, None])) for k in range(n)]


@pytest.mark.parametrize(("n", "length"), [(300, 32), (70, 16), (20, 48)])
def test_codes_against_brute_force(spark, n, length):
    rows = vectors(n, n, length)
    got = vector_codes.digests(spark.createDataFrame(rows, VECTORS).repartition(4))
    assert sorted(map(tuple, got.collect()), key=order) == codes_of(rows)


def test_codes_of_odd_rows(spark):
    rows = vectors(4, 90, 32)
    rows += [(1, None, 1), (2, [None] * 32, 1), (4, [float("nan")] * 32, 1), (5, [float("inf")] + [0.0] * 31, 1), (7, [-0.001] * 32, 9)]
    rows += [rows[0], rows[0], (0, [0.5] * 32, 2), (None, [0.25] * 32, None)]
    wider = spark.createDataFrame([(*r, 1, "d", "k") for r in rows], VECTORS + ", x int, d string, code string").repartition(3)
    assert sorted(map(tuple, vector_codes.digests(wider).collect()), key=order) == codes_of(rows)
    # Other lengths and numbers beyond 64-bit distances are dropped, a length between whole parts is filled up.
    more = spark.createDataFrame([*rows, (900, [0.1] * 31, 1), (901, [3e38] * 32, 1)], VECTORS)
    assert sorted(map(tuple, vector_codes.digests(more).collect()), key=order) == codes_of(rows)
    short = vector_codes.digests(spark.createDataFrame([(1, [0.5, 1.0, 2.0], None)], VECTORS)).first()
    assert (short["code"], short["error"], short["label_error"]) == ("00" * 16, 0, 0)
    assert vector_codes.digests(wider.limit(0)).collect() == []


def test_errors_of_hot_and_rare_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 4)
    rows = [(k, 0 if k % 3 == 0 else (None if k % 3 == 1 else k), "", k) for k in range(300)]
    got = vector_codes.with_label_errors(spark.createDataFrame(rows, "vec_id long, label int, code string, error long"))
    totals = Counter()
    for _, label, _, error in rows:
        totals[label] += error
    assert sorted((r["vec_id"], r["label_error"]) for r in got.collect()) == [(v, totals[label]) for v, label, _, _ in rows]


def test_pruning_never_changes_the_nearest_entry():
    draw = np.random.default_rng(7)
    book = draw.integers(-90, 90, (64, 4))
    book[10] = book[3]
    points = draw.integers(-120, 120, (2000, 4))
    points[:64] = book
    pivots = vector_codes.choose_pivots(book[None], 6)[0]
    index, distance, evaluated = vector_codes.nearest_entries(points, vector_codes.squared(points, pivots), book, pivots)
    every = vector_codes.squared(points, book)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert evaluated < 2000 * 64 / 4
