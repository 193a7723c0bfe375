"""Search against brute force, with query blocks, dialect pairs, ties and a hot list."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from queries import retrieval as queries
from tidemark.functions.vectors import cosine_similarity, vector_literal
from tidemark.operators import retrieval

RNG = np.random.default_rng(11)
VECTORS = RNG.normal(size=(300, 16)).astype(np.float32)
VECTORS[100:200] = VECTORS[100] + RNG.normal(scale=1e-3, size=(100, 16)).astype(np.float32)  # a third lies in one place
VECTORS[7] = VECTORS[8]
DIALECTS = [None, "oracle", "mysql"]
SOURCES, TARGETS = ["oracle", "mysql", "postgresql", None, None], ["postgresql", "mysql", None]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, v.tolist(), DIALECTS[i % 3], DIALECTS[i % 2]) for i, v in enumerate(VECTORS)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>, source_dialect string, target_dialect string").repartition(5)


def brute(k, allowed=lambda q, c: True):
    v = VECTORS.astype(np.float64)
    v = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(v @ v.T, 6)
    out = set()
    for q in range(len(v)):
        order = sorted((c for c in range(len(v)) if allowed(q, c)), key=lambda c: (-s[q, c], c))[:k]
        out |= {(q, c) for c in order}
    return out


def pairs(df):
    return {(r["query_id"], r["id"]) for r in df.collect()}


def test_batch_equals_brute_force(corpus):
    plain = corpus.select("id", "embedding")
    assert pairs(retrieval.retrieve_batch(plain, plain, 5)) == brute(5)


def test_blocks_of_queries_give_the_same(corpus):
    plain = corpus.select("id", "embedding")
    got = retrieval.retrieve_batch(plain, plain, 5, block_bytes=10_000)
    assert pairs(got) == brute(5)


def test_pairs_of_dialects(corpus):
    def allowed(q, c):
        s, t = DIALECTS[c % 3], DIALECTS[c % 2]
        return s in (None, DIALECTS[q % 3]) and t in (None, DIALECTS[q % 2])

    assert pairs(retrieval.retrieve_batch(corpus, corpus, 4)) == brute(4, allowed)


def test_single_query_equals_the_expression(corpus):
    q = VECTORS[42].tolist()
    got = [r["id"] for r in retrieval.retrieve(corpus, q, 6, "oracle", "oracle").collect()]
    fit = corpus.filter("(source_dialect is null or source_dialect = 'oracle') and (target_dialect is null or target_dialect = 'oracle')")
    want = fit.withColumn("s", F.round(cosine_similarity(F.col("embedding"), vector_literal(q)), 6)).orderBy(F.desc("s"), "id").limit(6)
    assert got == [r["id"] for r in want.collect()]
    only_free = retrieval.retrieve(corpus, q, 300).collect()
    assert {r["id"] for r in only_free} == {i for i in range(300) if i % 3 == 0 and i % 2 == 0}


def test_lists(corpus):
    plain = corpus.select("id", "embedding")
    exact = retrieval.retrieve_batch(plain, plain, 5)
    assigned, centres = retrieval.build_lists(plain, 8)
    shares = []
    for probe in (1, 3, 8):
        found = retrieval.retrieve_lists(assigned, centres, plain, 5, probe)
        shares.append(retrieval.recall(found, exact).agg(F.avg("recall")).first()[0])
    assert shares == sorted(shares) and shares[-1] == 1.0


def test_zero_vectors_and_other_sizes_are_not_found(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    asked = df.filter("id = 2")
    assert pairs(retrieval.retrieve_batch(df, asked, 5)) == {(2, 2)}


def test_text_ids_and_odd_vectors_in_every_search(spark):
    rows = [(f"e{i}", v.tolist()) for i, v in enumerate(VECTORS[:60])] + [("null", None), ("short", [1.0, 2.0]), ("zero", [0.0] * 16), ("void", [])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    exact = retrieval.retrieve_batch(df, df, 3)
    assert {r["query_id"] for r in exact.collect()} == {f"e{i}" for i in range(60)} | {"short"}
    assigned, centres = retrieval.build_lists(df, 4)
    found = retrieval.retrieve_lists(assigned, centres, df, 3, probe=4)
    assert pairs(found) == {p for p in pairs(exact) if p[0] != "short"}
    free = df.withColumns({side: F.lit(None).cast("string") for side in ("source_dialect", "target_dialect")})
    assert [r["id"] for r in retrieval.retrieve(free, VECTORS[5].tolist(), 1).collect()] == ["e5"]


def test_context(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    hits = spark.createDataFrame([(1, 5, 2), (1, 6, 1)], "query_id bigint, id bigint, rank int")
    entries = spark.createDataFrame([(5, "A", "a"), (6, "B", "b")], "id bigint, title string, content string")
    got = {r["query_id"]: r["context"] for r in retrieval.context_text(queries, hits, entries).collect()}
    assert got == {1: "- B: b\n\n- A: a", 2: retrieval.NO_CONTEXT}


def test_a_search_scores_the_probed_lists_alone(corpus):
    plain = corpus.select("id", "embedding")
    assigned, centres = retrieval.build_lists(plain, 8)
    lists = {r["id"]: r["list_id"] for r in assigned.collect()}
    probes = {r["id"]: r["list_id"] for r in retrieval.probed_lists(centres, plain, 1).collect()}
    # With room for every entry, a query finds exactly its one list, also where lists are cut into small blocks.
    for rows, asked in ((65_536, 8_192), (20, 7)):
        found = pairs(retrieval.retrieve_lists(assigned, centres, plain, 1000, 1, rows, asked))
        assert found == {(q, i) for q, probed in probes.items() for i, own in lists.items() if own == probed}
    entries, queries = retrieval.list_blocks(assigned, retrieval.probed_lists(centres, plain, 2), 20, 7)
    fullest = lambda df: df.groupBy("list_id", "part", "slot").count().agg(F.max("count")).first()[0]
    assert fullest(entries) < 60 and fullest(queries) < 30


@pytest.fixture
def asked(spark, tmp_path):
    from queries.base import Tables

    rows = [(i, v.tolist(), i % 7) for i, v in enumerate(VECTORS)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return Tables(spark, str(tmp_path))


def test_every_entry_asks(asked):
    assert pairs(queries.retrieve_batch(asked)) == brute(10)


def own_pair(q, c):
    """Does entry c fit the dialects of entry q, as the registered queries deal them?"""
    source, target = (lambda i: SOURCES[i % 7 % 5]), (lambda i: TARGETS[i % 7 % 3])
    return source(c) in (None, source(q)) and target(c) in (None, target(q))


def test_every_entry_asks_for_its_pair(asked):
    assert pairs(queries.retrieve_batch_pairs(asked)) == brute(5, own_pair)


def test_every_entry_has_its_context(asked):
    hits = {}
    for q, i in brute(5, own_pair):
        hits.setdefault(q, set()).add(f"- note {i}: about label {i % 7}")
    got = {r["query_id"]: set(r["context"].split("\n\n")) for r in queries.context_text(asked).collect()}
    assert got == hits


def test_all_lists_equal_brute_force(asked):
    assert pairs(queries.retrieve_ann_all_lists(asked)) == brute(10)


def test_recall_is_held_over_every_entry(asked):
    assert [tuple(r) for r in queries.retrieve_ann_recall_reached(asked).collect()] == [(len(VECTORS), True)]


def test_parts_of_entries_and_queries_give_the_same(corpus, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORE_ROWS", 40)
    monkeypatch.setattr(retrieval, "SCORE_QUERIES", 70)
    plain = corpus.coalesce(1).select("id", "embedding")
    for k in (1, 5, 60):
        assert pairs(retrieval.retrieve_batch(plain, plain, k)) == brute(k)
    found = {(r["query_id"], r["id"]) for r in retrieval.retrieve_batch(corpus.coalesce(1), corpus, 3).collect()}
    assert found == brute(3, lambda q, c: DIALECTS[c % 3] in (None, DIALECTS[q % 3]) and DIALECTS[c % 2] in (None, DIALECTS[q % 2]))


def test_blocks_of_queries_are_read_one_at_a_time(monkeypatch, tmp_path):
    from pyarrow import dataset, parquet, table

    parquet.write_table(table({"id": range(1000), "embedding": [[1.0, 2.0]] * 1000}), f"{tmp_path}/part.parquet")
    seen, true = {}, dataset.FileSystemDataset.to_batches

    class Watched:
        def __init__(self, *args, **kwargs):
            self.found = true_dataset(*args, **kwargs)

        def to_batches(self, **options):
            seen.update(options)
            return true(self.found, **options)

    true_dataset = dataset.dataset
    monkeypatch.setattr(dataset, "dataset", Watched)
    sizes = [b.num_rows for b in retrieval._query_blocks(str(tmp_path), 1600, 2)()]
    assert sizes == [100] * 10
    assert seen["batch_readahead"] == seen["fragment_readahead"] == 0
