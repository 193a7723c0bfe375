"""Filtering stages of the pipeline: null and repeated ids, clashing columns, and whole results against brute force."""

import random
from collections import Counter

import pytest
from llm.cases import prose

from tidemark.llm import decontamination, near_dedup

DOCS = "doc_id long, text string, lang string, _kept long, _leaks long, root string, text_key string, n long"


def rows_of(spark, pairs):
    return spark.createDataFrame([(k, t, lang, 1, 2, "r", "t", 3) for k, t, lang in pairs], DOCS)


def similar(a, b):
    bags = []
    for t in (a, b):
        words = t.split()
        bags.append(Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)]))
    shared = sum((bags[0] & bags[1]).values())
    return shared >= 0.8 * sum((bags[0] | bags[1]).values())


def one_of_each(pairs):
    """The (doc_id, text) pairs that stay, by comparing all texts."""
    distinct = sorted({(k, t) for k, t, _ in pairs}, key=lambda r: (r[0] is None, r[0] or 0))
    group = list(range(len(distinct)))
    for i, (_, a) in enumerate(distinct):
        for j in range(i):
            b = distinct[j][1]
            if a and b and a.split() and b.split() and (a.split() == b.split() or similar(a, b)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    seen, out = set(), []
    for g, (k, t) in zip(group, distinct, strict=True):
        if not (t and t.split()) or g not in seen:
            seen.add(g)
            out.append((k, t))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    draw = random.Random(seed)
    pairs = [(None, prose(5), "en"), (None, prose(5) + " x", "en"), (5, prose(6), "en"), (None, prose(6), "fr"), (9, None, "en"), (10, None, "en"), (11, " ", "en"), (11, " ", "en")]
    for k in range(20, 80):
        words = prose(draw.randrange(12), 150).split()
        for _ in range(draw.choice([0, 1, 2, 40])):
            words[draw.randrange(len(words))] = "edit"
        pairs.append((draw.choice([k, k, 20]), " ".join(words), "en"))
    pairs += pairs[8:12]
    got = near_dedup.without_near_duplicates(rows_of(spark, pairs))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    expected = one_of_each(pairs)
    assert len(kept) == len(expected)
    # Rows without an id are ranked by their text's hash, so which of them stays is open.
    assert sorted(r for r in kept if r[0] is not None and Counter(k for k, _ in expected)[r[0]] == 1) == sorted(r for r in expected if r[0] is not None and Counter(k for k, _ in expected)[r[0]] == 1)


def test_rows_that_differ_in_other_columns_alone(spark):
    pairs = [(1, prose(1), lang) for lang in ("en", "fr", "de")] + [(2, prose(2), "en")]
    first = [sorted(map(tuple, near_dedup.without_near_duplicates(rows_of(spark, p).repartition(3)).collect())) for p in (pairs, pairs[::-1])]
    assert first[0] == first[1] and len(first[0]) == 2


def test_leaks_of_null_and_repeated_ids(spark):
    item = prose(70, 30, 10**6)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    pairs = [(None, "a b c " + item, "en"), (None, prose(1), "en"), (3, item, "en"), (3, prose(2), "en"), (4, None, "en"), (5, prose(3), "en")]
    got = decontamination.without_leaks(rows_of(spark, pairs), items)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted((str(k), t) for k, t, _ in pairs if not (t and item in t))
    assert [r["item_id"] for r in decontamination.leaks(rows_of(spark, pairs), items).collect()] == [1, 1]
