"""Platform tables kept as files: catalogue, jobs and knowledge base."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.joins import shuffled
from tidemark.session import cut_lineage, discard, scratch_path, settled, spent_shuffles
from tidemark.sources import versioned
from tidemark.sources.versioned import BUCKET


def with_dependencies(catalog: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Attach to each object the tables it refers to; an object without any has an empty list."""
    deps = dependencies.select("job_id", F.col("child").alias("object_name"), "dependencies")
    return catalog.join(shuffled(deps), ["job_id", "object_name"], "left").withColumn(
        "dependencies", F.coalesce("dependencies", F.array().cast("array<string>"))
    )


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """A bucketed store as it is on disk, or nothing when it was never written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        # Any other fault must not pass for an empty store: the next write would then lose what is there.
        if "PATH_NOT_FOUND" not in (exc.getCondition() or ""):
            raise
        return None


def write_buckets(rows: DataFrame, path: str) -> None:
    """Replace the buckets that occur in ``rows``; the others are not read or written.

    ``rows`` may have been read from the same path, so they are checkpointed before anything is replaced.
    Rows are rebalanced by bucket: AQE splits a bucket that is too large for one task and joins small ones.
    """
    cut_lineage(rows).hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        BUCKET
    ).parquet(path)


def touched(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame | None:
    """Stored rows of the buckets these keys fall into; only the bucket numbers reach the driver."""
    stored = read_store(spark, path)
    if stored is None:
        return None
    numbers = [r[0] for r in keys.select(BUCKET).distinct().collect()]
    return stored.filter(F.col(BUCKET).isin(numbers))


def latest_loads(rows: DataFrame) -> DataFrame:
    """The rows of each job's newest load."""
    newest = rows.groupBy("job_id").agg(F.max("load").alias("_newest")).withColumnRenamed("job_id", "_job")
    return rows.join(shuffled(newest), F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("load") == F.col("_newest"))).drop("_job", "_newest")


def replace_catalog(catalog: DataFrame, dependencies: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the catalogue rows of the jobs in ``catalog``; other jobs keep theirs.

    The rows are added under the number of this load, and a job's newest load is its catalogue, so nothing that is there is rewritten and a load that
    is lost on the way changes nothing. Jobs share ``buckets`` partitions.

    Rows are settled between the steps, so that the disk holds the shuffles of one step at a time.
    """
    spark = catalog.sparkSession
    load = versioned.read_manifest(spark, path)[0] + 1
    alone, beside, whole = (scratch_path(spark, label) for label in ("catalog", "dependencies", "catalog-dependencies"))
    listed = settled(catalog, alone)
    fresh = settled(with_dependencies(listed, settled(dependencies.select("job_id", "child", "dependencies"), beside)), whole)
    discard(spark, alone, beside)
    with spent_shuffles(spark):
        versioned.append(fresh.withColumn("load", F.lit(load).cast("bigint")), path, ["job_id"], latest_loads, buckets)
    discard(spark, whole)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return versioned.current(spark, path, latest_loads).drop("load")


def upsert_jobs(events: DataFrame) -> DataFrame:
    """Jobs from their status events: name and dialects stay as first written, status follows the latest.

    Input: job_id, name, source_dialect, target_dialect, status, ts, seq.
    """
    order = F.struct("ts", "seq")
    return (
        events.groupBy("job_id")
        .agg(
            F.min_by(F.struct("name", "source_dialect", "target_dialect"), order).alias("_first"),
            F.max_by("status", order).alias("status"),
            F.min("ts").alias("created_at"),
            F.max("ts").alias("updated_at"),
        )
        .select("job_id", "_first.*", "status", "created_at", "updated_at")
    )


def job_states(events: DataFrame) -> DataFrame:
    """job_id with its first and its last event, as far as these rows tell: what ``fold_jobs`` folds."""
    order = F.struct("ts", "seq")
    return events.groupBy("job_id").agg(
        F.min_by(F.struct("ts", "seq", "name", "source_dialect", "target_dialect"), order).alias("first"),
        F.max_by(F.struct("ts", "seq", "status"), order).alias("last"),
    )


def fold_jobs(states: DataFrame) -> DataFrame:
    """One state per job: the earliest first and the latest last event by time, whenever they arrived."""
    keys = ["job_id", *([BUCKET] if BUCKET in states.columns else [])]
    return states.groupBy(*keys).agg(
        F.min_by("first", F.struct("first.ts", "first.seq")).alias("first"), F.max_by("last", F.struct("last.ts", "last.seq")).alias("last")
    ).select(*states.columns)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of a store that ``keep_jobs`` fills, as ``upsert_jobs`` gives them."""
    return versioned.current(spark, path, fold_jobs).select(
        "job_id", "first.name", "first.source_dialect", "first.target_dialect", "last.status", F.col("first.ts").alias("created_at"), F.col("last.ts").alias("updated_at")
    )


def replace_knowledge_base(documents: DataFrame, path: str) -> int:
    """Clear and refill the knowledge base; loading the same documents again changes nothing."""
    documents.write.mode("overwrite").parquet(path)
    return documents.sparkSession.read.parquet(path).count()


