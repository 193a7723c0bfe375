"""Changes applied to a target, as a batch and as a stream; incremental loads."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.operators.reconcile import union_all
from tidemark.session import cut_lineage
from tidemark.sources import versioned
from tidemark.sources.stores import read_store
from tidemark.streaming.sources import run_batches, run_to_files

# Fixed value: the operation that removes a row; every other one writes it.
DELETE = "D"


def latest_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last change of each key (by ts, seq); a key changed a million times costs one row per task."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("_c")).select(*keys, "_c.*")


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target after the changes: changed keys leave, and come back unless they were deleted."""
    last = latest_changes(changes, keys)
    kept = target.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.filter(F.col("op") != DELETE).select(*target.columns))


def change_lag(changes: DataFrame, now: Column) -> DataFrame:
    """Seconds between the newest change and ``now``."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return changes.agg(F.max("ts").alias("last_change")).withColumn(
        "lag_seconds", (micros(now) - micros(F.col("last_change"))) / F.lit(1e6)
    )


def merge_changes(path: str, keys: Sequence[str], buckets: int = 64):
    """A micro-batch handler that adds a batch's last change of each key to a store of changes.

    The store keeps changes with their time, deletions included, and readers take each key's last one, so late changes cannot
    undo newer ones and a replayed batch changes nothing. What is there is not rewritten with each batch.
    """

    def handle(batch: DataFrame, _batch_id: int) -> None:
        versioned.append(latest_changes(batch, keys), path, keys, _fold(keys), buckets)

    return handle


def _fold(keys: Sequence[str]):
    def fold(rows: DataFrame) -> DataFrame:
        own = [*keys, *([versioned.BUCKET] if versioned.BUCKET in rows.columns else [])]
        return latest_changes(rows, own).select(*rows.columns)

    return fold


def current_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The target a store of changes stands for."""
    return versioned.current(spark, path, _fold(keys)).filter(F.col("op") != DELETE).drop("op", "ts", "seq")


def apply_change_stream(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, buckets: int = 64) -> DataFrame:
    """Merge a stream of changes and give back the target after what is there now."""
    run_batches(stream, merge_changes(path, keys, buckets), checkpoint)
    return current_rows(stream.sparkSession, path, keys)


def high_water(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("high_water"))


def row_hash(df: DataFrame) -> Column:
    """A digest of a whole row, null-safe."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))


def newer_rows(df: DataFrame, column: str, last, loaded: DataFrame | None = None) -> DataFrame:
    """Rows at or beyond the last high-water mark; the filter is pushed down to the source.

    Rows beyond the mark always come, changed ones too. Of the rows at the very mark those come that ``loaded`` (the rows at the mark that
    were loaded, from ``marked_rows``) does not hold: late ones and changed ones. A row that stands there more often than it was loaded comes
    once for each further copy. Rows without a value in ``column`` lie at a mark of their own, before all others.
    """
    if last is None and loaded is None:
        return df
    if loaded is None:
        return df.filter(F.col(column) >= F.lit(last))
    reached = F.col(column).isNull() if last is None else F.col(column).isNull() | (F.col(column) == F.lit(last))
    tag = f"_{uuid.uuid4().hex}_"
    # Copies of a row are numbered; only rows at the mark are hashed and joined.
    hashed = df.filter(reached).withColumn(f"{tag}hash", row_hash(df))
    copies = hashed.withColumn(f"{tag}copy", F.row_number().over(Window.partitionBy(f"{tag}hash").orderBy(F.lit(1))))
    known = loaded.groupBy(F.col("row_hash").alias(f"{tag}known")).agg(F.sum("copies").alias(f"{tag}n"))
    late = copies.join(known, F.col(f"{tag}hash") == F.col(f"{tag}known"), "left").filter(F.col(f"{tag}copy") > F.coalesce(f"{tag}n", F.lit(0)))
    beyond = df.filter(F.col(column).isNotNull()) if last is None else df.filter(F.col(column) > F.lit(last))
    return beyond.unionByName(late.select(*[F.col(c) for c in df.columns]))


def marked_rows(df: DataFrame, column: str, mark) -> DataFrame:
    """row_hash and copies of the rows at the mark, and of those without a value: what a later load at the same mark must know."""
    at = F.col(column).isNull() if mark is None else F.col(column).isNull() | (F.col(column) == F.lit(mark))
    return df.filter(at).groupBy(row_hash(df).alias("row_hash")).agg(F.count(F.lit(1)).alias("copies"))


def read_mark(spark: SparkSession, path: str) -> tuple[int, object, DataFrame | None]:
    """The last load's number, its mark and the rows at it; number 0 and no mark before the first load."""
    store = read_store(spark, f"{path}/marks")
    if store is None:
        return 0, None, None
    number = store.agg(F.max("load")).first()[0]
    return number, store.filter(F.col("load") == number).select("mark").first()["mark"], spark.read.parquet(f"{path}/rows/load={number}")


def load_increment(df: DataFrame, column: str, path: str) -> DataFrame:
    """Append the rows of ``df`` that came or changed since the last load below ``path``, and keep the new mark.

    A load writes its rows, then the rows at its mark, and last its mark, each under the load's number. A load that is lost on the
    way has no mark, so the next one takes its number, replaces what it left and loses nothing; a load without new rows appends none. Returns all
    rows loaded so far (``loaded_rows``).
    """
    spark = df.sparkSession
    number, last, loaded = read_mark(spark, path)
    # One reading of the source decides about rows and mark alike.
    fresh = cut_lineage(newer_rows(df, column, last, loaded))
    newest = fresh.agg(F.max(column)).first()[0]
    mark = last if newest is None else newest
    fresh.write.mode("overwrite").parquet(f"{path}/data/load={number + 1}")
    marked = marked_rows(fresh, column, mark)
    if loaded is not None:
        # Rows without a value, and rows at a mark that has not moved, stay known.
        marked = marked.union(loaded).groupBy("row_hash").agg(F.sum("copies").alias("copies"))
    marked.write.mode("overwrite").parquet(f"{path}/rows/load={number + 1}")
    kind = df.schema[column].dataType
    one = spark.range(1).select(F.lit(number + 1).alias("load"), F.lit(mark).cast(kind).alias("mark"))
    one.coalesce(1).write.mode("append").parquet(f"{path}/marks")
    return loaded_rows(spark, path)


def loaded_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished loads."""
    number = read_mark(spark, path)[0]
    return union_all([spark.read.parquet(f"{path}/data/load={k + 1}") for k in range(number)])


def incremental_load(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append the files that arrived since the last run; the checkpoint remembers what was loaded."""
    return run_to_files(stream, path, checkpoint)
