"""Classes against brute force on all pairs, the estimate's error, hot groups, odd rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from cases import no_docs, odd_docs, prose

from tidemark.llm import near_dedup as nd


def bag(text):
    words = (text or "").split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
    return Counter(grams)


def brute(rows):
    bags = {k: bag(t) for k, (_, t) in enumerate(rows)}
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in bags:
        for b in range(a):
            union = sum((bags[a] | bags[b]).values())
            if union and sum((bags[a] & bags[b]).values()) >= 0.8 * union:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        groups[find(k)].append(doc_id)
    out = []
    for k, (doc_id, text) in enumerate(rows):
        known = [d for d in groups[find(k)] if d is not None]
        out.append((doc_id, min(known) if known and bag(text) else doc_id))
    return sorted(out, key=str)


def classes(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in nd.near_duplicate_classes(docs).collect()), key=str)


def test_classes_equal_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for k in range(60):
        base = prose(k, draw.randrange(5, 300))
        for _ in range(draw.randrange(1, 5)):
            words = base.split()
            for _ in range(draw.randrange(0, 4)):
                words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, rows[0][1]), (1001, "a b"), (1002, "a b"), (1003, ""), (1004, ""), (1005, None)]
    assert classes(spark, rows) == brute(rows)


def test_passages_shared_by_many_unlike_texts_make_no_class(spark):
    shared = prose(99, 200)
    rows = [(k, prose(k, 160, 5000) + " " + shared) for k in range(150)]
    assert classes(spark, rows) == [(k, k) for k, _ in sorted(rows, key=lambda r: str((r[0], r[0])))]


def test_a_large_group_of_near_copies_is_one_class(spark):
    draw = random.Random(7)
    base = prose(3, 300).split()
    rows = []
    for k in range(800):
        words = list(base)
        words[draw.randrange(300)] = f"n{k}"
        rows.append((k, " ".join(words)))
    rows += [(k + 800, rows[0][1]) for k in range(800)]
    assert {c for _, c in classes(spark, rows)} == {0}


def test_registers_estimate_weighted_similarity():
    draw = np.random.default_rng(0)
    errors = []
    for t in range(40):
        words = [f"w{draw.integers(0, 300)}" for _ in range(200)] + ["r"] * int(draw.integers(0, 60))
        other = list(words)
        for _ in range(int(draw.integers(0, 10))):
            other[int(draw.integers(0, len(other)))] = f"x{t}"
        grams, at, _, _ = nd.shingles(pa.array([" ".join(words), " ".join(other)]))
        found = nd.registers(*nd.bags(grams, at), 2, 256)
        a, b = bag(" ".join(words)), bag(" ".join(other))
        errors.append((found[0] == found[1]).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in nd.near_duplicate_classes(docs).collect()), key=str) == brute(rows)
    kept = nd.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 7, None, None, 8, 9, 10, 11, 12]))


def test_empty_table(spark):
    assert nd.near_duplicate_classes(no_docs(spark)).collect() == []
    assert nd.without_near_duplicates(no_docs(spark)).collect() == []


def chain(base, links, edits, draw, tag):
    """Texts each made of the one before by so many new words, one after the other."""
    out = [list(base)]
    for k in range(links):
        words = list(out[-1])
        for at in draw.sample(range(0, len(words), 5), edits):
            words[at + draw.randrange(5)] = f"{tag}{k}x{at}"
        out.append(words)
    return [" ".join(words) for words in out]


def test_links_within_the_class_of_a_pivot_are_seen(spark):
    # Hundreds of copies in chains whose links lie at 0.80 to 0.85; they branch off a group of close copies, so pivots of that group head most buckets.
    draw = random.Random(11)
    base = prose(3, 300, 5000).split()
    rows = chain(base, 300, 1, random.Random(1), "c")[1:40]
    for branch in range(24):
        rows += chain(rows[branch].split(), 12, 6, draw, f"b{branch}y")[1:]
    rows = [(k, text) for k, text in enumerate(draw.sample(rows, len(rows)))]
    assert classes(spark, rows) == brute(rows)


def test_all_links_that_share_a_band_are_found(spark):
    # Few bands, so that many linked texts meet in one bucket alone.
    draw = random.Random(13)
    rows = []
    for k in range(6):
        rows += chain(prose(k, 150, 5000).split(), 60, 3, draw, f"g{k}y")
    rows = list(enumerate(draw.sample(rows, len(rows))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r["doc_id"]: set(r["bands"]) for r in nd.signatures(docs, rows=3, bands=4).collect()}
    bags, root = [bag(text) for _, text in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and keys[a] & keys[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    found = {tuple(r) for r in nd.near_duplicate_classes(docs, rows=3, bands=4).collect()}
    assert found == set(enumerate(root))
