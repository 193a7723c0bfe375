"""Closest knowledge entries by cosine similarity, exact and by lists of near vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import scratch_path

# Size of a stored embedding, text when nothing was found, most bytes of query vectors a task holds at a time.
EMBEDDING_SIZE = 1024
NO_CONTEXT = "(no knowledge-base context retrieved)"
QUERY_BLOCK_BYTES = 64 << 20
DIGITS = 6
# Bytes of entries that meet the queries together, similarities computed at a time, rows of a block of a list.
GATHER_BYTES = 32 << 20
SCORE_ROWS, SCORE_QUERIES = 4096, 1024
LIST_ROWS, LIST_QUERIES = 65_536, 8_192


def for_pair(corpus: DataFrame, source: str | None, target: str | None) -> DataFrame:
    """Entries that fit a dialect pair: each side is agnostic or equal; without a pair only agnostic ones."""

    def fits(column: str, value: str | None) -> Column:
        free = F.col(column).isNull()
        return free if value is None else free | (F.col(column) == value)

    return corpus.filter(fits("source_dialect", source) & fits("target_dialect", target))


def retrieve(
    corpus: DataFrame, query: Sequence[float], k: int = 5, source: str | None = None, target: str | None = None
) -> DataFrame:
    """The k entries most similar to one query vector, best first; ties go to the smaller id.

    Only ids and vectors are scored and only k rows per task leave the scan. The k hits (a fixed number,
    so they may be broadcast) then pick up the entries' other columns.
    """
    fitting = for_pair(corpus, source, target).filter(F.size("embedding") == len(query)).select("id", "embedding")
    vector = F.lit([float(v) for v in query])
    dot = F.aggregate(F.zip_with("embedding", vector, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = math.sqrt(sum(float(v) ** 2 for v in query))
    scored = fitting.withColumn("similarity", F.round(dot / F.nullif(size, F.lit(0.0)) / F.lit(length or None), DIGITS))
    hits = scored.filter("similarity is not null").orderBy(F.desc("similarity"), "id").limit(k).select("id", "similarity")
    return corpus.join(F.broadcast(hits), "id").orderBy(F.desc("similarity"), "id")


def _top_k(hits: DataFrame, k: int) -> DataFrame:
    """Best k per query; the rank filter already cuts each task's rows before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _score_batches(blocks, k: int, hit_types: tuple):
    """A function over Arrow batches of the corpus: every batch meets every block of queries and keeps the k best per query.

    ``blocks`` is called in the task and yields Arrow batches of queries. Vectors are compared with those of their own size;
    zero vectors and NULLs are found by no query. The closure travels to the executors by value.
    """
    def leading(asked, at, scores, place):
        """The k best entries of each query among those found so far, by rounded score and then id: query, entry, score."""
        import numpy as np

        order = np.lexsort((place[at], -np.where(np.isnan(scores), np.inf, scores), asked))
        asked, at, scores = asked[order], at[order], scores[order]
        starts = np.flatnonzero(np.diff(asked, prepend=-1))
        nth = np.arange(len(asked)) - np.repeat(starts, np.diff(starts, append=len(asked)))
        return asked[nth < k], at[nth < k], scores[nth < k]

    def reached(scores):
        """A score that k entries of each query reach: the k-th of the best ones of its entries, dealt into groups."""
        import numpy as np

        wide = scores.shape[1] // (4 * k)
        if not wide:
            return np.full(len(scores), -np.inf)
        tops = scores[:, : wide * 4 * k].reshape(len(scores), wide, 4 * k).max(axis=1)
        return np.partition(tops, -k, axis=1)[:, -k]

    def groups(batch):
        """Rows of a batch by the size of their vector: (size, row numbers, unit vectors)."""
        import numpy as np

        column = batch.column("embedding")
        sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()])
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            flat = column.take(pa_array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            vectors = flat.reshape(len(rows), size)
            lengths = np.sqrt((vectors**2).sum(axis=1))
            good = lengths > 0
            yield int(size), rows[good], vectors[good] / lengths[good][:, None]

    def pa_array(rows):
        import pyarrow as pa

        return pa.array(rows)

    def places(ids):
        """The place of each entry in the order of ids, NULL first."""
        import numpy as np

        values = ids.to_pylist()
        order = sorted(range(len(values)), key=lambda i: (values[i] is not None, 0 if values[i] is None else values[i]))
        out = np.empty(len(values), np.int64)
        out[order] = np.arange(len(values))
        return out

    def sides(entries, queries):
        """Numbers for the dialects of entries and queries, -1 for an agnostic one: a pair of arrays for each side both have."""
        import numpy as np

        for side in ("source_dialect", "target_dialect"):
            if side in entries.schema.names and side in queries.schema.names:
                number = {None: -1}
                yield tuple(np.array([number.setdefault(d, len(number)) for d in x.column(side).to_pylist()], np.int32) for x in (entries, queries))

    def fits(pairs, asked, rows):
        """Which entries a query may see: those of its dialects or agnostic ones; nothing where there are no dialects."""
        ok = None
        for have, want in pairs:
            mine = (have[rows] == -1)[None, :] | (have[rows][None, :] == want[asked][:, None])
            ok = mine if ok is None else ok & mine
        return ok

    def gathered(batches):
        """Batches joined up to ``GATHER_BYTES``, so that the queries are read once for many rows."""
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held and size + batch.nbytes > GATHER_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def best(asked, units, rows, vectors, pairs, place):
        """The k best of these entries for each of these queries; entries are scored in parts, and only those that may still lead are kept."""
        import numpy as np

        empty = np.zeros(0, np.int64)
        found, floor = (empty, empty, np.zeros(0)), np.full(len(asked), -np.inf)
        for lo in range(0, len(rows), SCORE_ROWS):
            part = rows[lo : lo + SCORE_ROWS]
            scores, ok = units @ vectors[lo : lo + SCORE_ROWS].T, fits(pairs, asked, part)
            if ok is not None:
                scores[~ok] = -np.inf
            # Scores that are equal once rounded lie closer together than the last digit.
            floor = np.fmax(floor, reached(scores))
            chosen = ~(scores < (floor - 10.0**-DIGITS)[:, None])
            which, at = np.divmod(np.flatnonzero(chosen if ok is None else chosen & ok), len(part))
            new = which, part[at], np.round(scores[which, at], DIGITS)
            found = leading(*(np.concatenate(x) for x in zip(found, new, strict=True)), place)
        return asked[found[0]], found[1], found[2]

    def run(batches, asked_blocks=blocks):
        import numpy as np
        import pyarrow as pa

        for batch in gathered(batches):
            mine, place = list(groups(batch)), places(batch.column("id"))
            for block in asked_blocks():
                # A task holds the similarities of so many entries and queries at a time.
                for first in range(0, block.num_rows, SCORE_QUERIES):
                    queries = block.slice(first, SCORE_QUERIES)
                    pairs = list(sides(batch, queries))
                    found = [best(asked, units, rows, vectors, pairs, place) for size, asked, units in groups(queries) for other, rows, vectors in mine if other == size]
                    if found:
                        which, at, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                        hits = [queries.column("id").take(pa.array(which)).cast(hit_types[0]), batch.column("id").take(pa.array(at)).cast(hit_types[1]), pa.array(scores)]
                        yield pa.RecordBatch.from_arrays(hits, names=["query_id", "id", "similarity"])

    return run


def _query_blocks(folder: str, limit: int, width: int):
    """Reads a folder of queries in blocks of at most ``limit`` bytes of vectors; for use in tasks.

    One block is read at a time: blocks read ahead would add up to the whole folder in every task.
    """

    def blocks():
        from pyarrow import dataset, fs

        system, place = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)
        rows = max(1, limit // (8 * max(1, width)))
        found = dataset.dataset(place, filesystem=system, format="parquet")
        alone = dataset.ParquetFragmentScanOptions(pre_buffer=False)
        for batch in found.to_batches(batch_size=rows, batch_readahead=0, fragment_readahead=0, use_threads=False, fragment_scan_options=alone):
            if batch.num_rows:
                yield batch

    return blocks


def _search(corpus: DataFrame, queries: DataFrame, k: int, block_bytes: int) -> DataFrame:
    """Score all queries against the corpus where it lies.

    The queries are written to the shared folder once; every task reads them from there, block by block, next to the rows of the
    corpus it holds. Neither side passes through the driver and the corpus is not shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    columns = [c for c in ("id", "embedding", "source_dialect", "target_dialect") if c in queries.columns]
    folder = scratch_path(corpus.sparkSession, "queries")
    queries.filter(F.size("embedding") > 0).select(*columns).write.parquet(folder)
    stored = corpus.sparkSession.read.schema(queries.select(*columns).schema).parquet(folder)
    width = stored.agg(F.max(F.size("embedding"))).first()[0] or 1
    kinds = (queries.schema["id"].dataType, corpus.schema["id"].dataType)
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, similarity double"
    score = _score_batches(_query_blocks(folder, block_bytes, width), k, tuple(map(to_arrow_type, kinds)))
    return _top_k(corpus.filter(F.size("embedding") > 0).mapInArrow(score, schema), k)


def retrieve_batch(corpus: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """Exact top-k for many queries: (query_id, id, similarity, rank).

    Both inputs need (id, embedding). When both carry source_dialect and target_dialect, an entry only
    counts for queries of its pair or when it is agnostic.
    """
    both = [c for c in ("id", "embedding", "source_dialect", "target_dialect") if c in corpus.columns and c in queries.columns]
    return _search(corpus.select(*both), queries.select(*both), k, block_bytes)


def build_lists(corpus: DataFrame, lists: int, seed: int = 7) -> tuple[DataFrame, list]:
    """Assign every vector to the nearest of ``lists`` centres, learned from all vectors.

    Vectors that are NULL, zero or of another size than most are left out: they have no place among the others.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    whole = corpus.select("id", "embedding").filter(F.size("embedding") > 0)
    common = whole.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    filled = F.exists("embedding", lambda x: x != 0)
    whole = whole.filter((F.size("embedding") == F.lit(common["n"] if common else 0)) & filled)
    raw = whole.withColumn("raw", array_to_vector("embedding"))
    rows = Normalizer(inputCol="raw", outputCol="features").transform(raw).drop("raw")
    train = rows.select("features").persist()
    model = KMeans(k=lists, seed=seed, maxIter=10, initSteps=1).fit(train)
    train.unpersist()
    assigned = model.transform(rows).select("id", "embedding", F.col("prediction").alias("list_id"))
    return assigned, [c.tolist() for c in model.clusterCenters()]


def probed_lists(centres: list, queries: DataFrame, probe: int) -> DataFrame:
    """The ``probe`` lists nearest to each query: id, embedding, list_id. The centres (``lists`` vectors) go to the tasks with the function."""

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(centres)
        for batch in batches:
            q = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            q = q / np.maximum(np.sqrt((q**2).sum(axis=1)), 1e-300)[:, None]
            gaps = (c**2).sum(axis=1)[None, :] - 2 * q @ c.T
            chosen = np.argsort(gaps, axis=1, kind="stable")[:, :probe]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen.tolist(), pa.list_(pa.int32()))], names=["id", "embedding", "lists"])

    asked = queries.select("id", "embedding").filter(F.size("embedding") == F.lit(len(centres[0])))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(nearest, kinds + ", lists array<int>").select("id", "embedding", F.explode("lists").alias("list_id"))


def list_blocks(assigned: DataFrame, probes: DataFrame, list_rows: int, list_queries: int) -> tuple[DataFrame, DataFrame]:
    """Entries and queries of each probed list, cut into parts that meet pairwise: both with list_id, part, slot.

    A list with many entries is cut into parts of about ``list_rows``, one with many queries into slots of about ``list_queries``; entries go
    to every slot and queries to every part of their list. Lists that no query probes are left away before anything is shuffled.
    """
    counts = assigned.groupBy("list_id").agg(F.count(F.lit(1)).alias("entries"), F.lit(0).cast("bigint").alias("asked")).union(
        probes.groupBy("list_id").agg(F.lit(0).cast("bigint").alias("entries"), F.count(F.lit(1)).alias("asked"))
    )
    # One row for each list, so it may be broadcast.
    plan = F.broadcast(
        counts.groupBy("list_id").agg(F.sum("entries").alias("e"), F.sum("asked").alias("a")).filter("e > 0 and a > 0")
        .select("list_id", F.ceil(F.col("e") / list_rows).cast("int").alias("parts"), F.ceil(F.col("a") / list_queries).cast("int").alias("slots"))
    )
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    entries = assigned.join(plan, "list_id").select("list_id", "id", "embedding", own("parts").alias("part"), every("slots").alias("slot"))
    asked = probes.join(plan, "list_id").select("list_id", "id", "embedding", own("slots").alias("slot"), every("parts").alias("part"))
    return entries, asked


def retrieve_lists(
    assigned: DataFrame, centres: list, queries: DataFrame, k: int = 5, probe: int = 4, list_rows: int = LIST_ROWS, list_queries: int = LIST_QUERIES
) -> DataFrame:
    """Approximate top-k: only the ``probe`` lists nearest to each query are searched, exactly.

    Queries are sent to the lists they probe and meet nothing else; probing all lists gives the exact answer. Lists with many entries
    or many queries are cut into blocks of bounded size.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    folder = scratch_path(queries.sparkSession, "probes")
    probes = probed_lists(centres, queries, probe)
    probes.write.parquet(folder)
    probes = queries.sparkSession.read.schema(probes.schema).parquet(folder)
    kinds = (queries.schema["id"].dataType, assigned.schema["id"].dataType)
    types = tuple(map(to_arrow_type, kinds))
    # Made here: the function travels by value, and tasks need no copy of this module.
    run = _score_batches(None, k, types)

    def score(entries, asked):
        import pyarrow as pa

        empty = pa.schema([("query_id", types[0]), ("id", types[1]), ("similarity", pa.float64())])
        return pa.Table.from_batches(list(run(entries.to_batches(), asked.to_batches)) if entries.num_rows and asked.num_rows else [], empty)

    entries, asked = list_blocks(assigned, probes, list_rows, list_queries)
    key = ["list_id", "part", "slot"]
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, similarity double"
    return _top_k(entries.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(score, schema), k)


def write_lists(assigned: DataFrame, path: str) -> None:
    """Keep the lists as files, one partition per list, so a search only opens the lists it probes.

    Rows are rebalanced by list; AQE spreads a list that holds much of the corpus over many tasks and files.
    """
    assigned.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


def retrieve_ann(corpus: DataFrame, queries: DataFrame, k: int = 5, lists: int = 100, probe: int = 30) -> DataFrame:
    """Build lists, keep them, and search them; use the three steps by themselves to search more than once."""
    assigned, centres = build_lists(corpus, lists)
    path = scratch_path(corpus.sparkSession, "lists")
    write_lists(assigned, path)
    return retrieve_lists(corpus.sparkSession.read.parquet(path), centres, queries, k, probe)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found, per query."""
    hit = found.select("query_id", "id", F.lit(1).alias("_hit"))
    return exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.avg(F.coalesce("_hit", F.lit(0))).alias("recall")
    )


def object_embeddings(catalog: DataFrame, vectors: DataFrame, size: int = EMBEDDING_SIZE) -> DataFrame:
    """Objects with their vector; vectors of another size count as failed, and objects whose vector failed have none."""
    good = vectors.filter(F.size("embedding") == size).select("job_id", "object_type", "object_name", "embedding")
    return catalog.join(good, ["job_id", "object_type", "object_name"], "left")


def context_text(queries: DataFrame, hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Text of the hits per query in rank order; a query has at most k hits, so the text is bounded by k entries."""
    line = F.concat(F.lit("- "), "title", F.lit(": "), "content")
    told = (
        hits.join(entries.select("id", "title", "content"), "id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
        .select("query_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n\n").alias("context"))
    )
    return queries.select("query_id").join(told, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(NO_CONTEXT))
    )
