"""Tiling against a plain version of the algorithm; leaks, reordered passages, clean texts, odd rows."""

import random

import numpy as np
import pyarrow as pa
from cases import no_docs, odd_docs, prose

from tidemark.llm import decontamination as dc

ITEMS = "item_id long, text string, seed string, dpos long"


def plain_tiles(doc, item, width):
    """Greedy string tiling by looking at all starts in each round."""
    marked_d, marked_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in marked_i and d + n not in marked_d:
                    n += 1
                if n >= width and (n > best[2] or (n == best[2] and (i, d) < (best[1], best[0]))):
                    best = (d, i, n)
        if best[2] < width:
            return out
        d, i, n = best
        marked_d.update(range(d, d + n))
        marked_i.update(range(i, i + n))
        out.append(best)


def test_tiles_equal_the_plain_algorithm():
    draw = random.Random(2)
    for _ in range(80):
        doc = [draw.randrange(3) for _ in range(draw.randrange(1, 40))]
        item = [draw.randrange(3) for _ in range(draw.randrange(1, 25))]
        points = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]]
        assert sorted(dc.tiles(points, 3)) == sorted(plain_tiles(doc, item, 3))


def test_fingerprints_are_those_of_the_window_alone():
    values = np.random.default_rng(0).integers(0, 2**63, 40).astype(np.uint64)
    prints, at = dc.fingerprints(values, np.array([0, 17, 17, 20, 40]), 5)
    assert np.diff(at).tolist() == [13, 0, 0, 16]
    alone, _ = dc.fingerprints(values[22:27], np.array([0, 5]), 5)
    assert alone[0] == prints[at[3] + 2]


def leaks(spark, docs, items, **params):
    found = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **params)
    return {(r["doc_id"], r["item_id"]): r for r in found.collect()}


def test_whole_reordered_and_disguised_passages_leak_and_clean_texts_do_not(spark):
    item = prose(50, 40, 10**6)
    words = item.split()
    docs = [
        (1, prose(1) + " " + item + " " + prose(2)),
        (2, " ".join(words[20:]) + " " + prose(3) + " " + " ".join(words[:20])),
        (3, prose(4) + "\n" + item.upper().replace(" ", ",  ") + "."),
        (4, " ".join(words[:20]) + " " + prose(5)),
        (5, prose(6, 400)),
        (6, item),
        (7, item + " " + item),
    ]
    found = leaks(spark, docs, [(9, item), (10, "too short"), (11, None), (12, prose(51, 30))])
    assert set(found) == {(k, 9) for k in (1, 2, 3, 6, 7)}
    assert found[(1, 9)]["n_tiles"] == 1 and found[(2, 9)]["n_tiles"] == 2 and found[(7, 9)]["coverage"] == 1.0
    assert set(leaks(spark, docs, [(9, item)], coverage=0.5)) >= {(4, 9)}


def test_odd_rows_and_columns(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, prose(1, 30), "s", 1), (2, None, None, None), (None, prose(9, 50, 5000), "s", 1), (3, "", "s", 2)], ITEMS)
    found = sorted(((r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items).collect()), key=str)
    assert found == sorted([(1, 1), (2, 1), (3, 1), (9, None)], key=str)
    kept = dc.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    assert dc.leaks(no_docs(spark), items).collect() == []
    assert dc.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_words_are_lower_case_without_edges():
    values, bounds = dc.normal_words(pa.array(["One, (two) THREE!", "one two three", "--- !", None]))
    assert bounds.tolist() == [0, 3, 6, 6, 6] and values[:3].tolist() == values[3:].tolist()
