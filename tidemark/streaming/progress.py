"""Status feeds of running jobs, one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.progress import TERMINAL, status_changes
from tidemark.session import cut_lineage
from tidemark.sources import versioned
from tidemark.sources.stores import fold_jobs, job_states, touched, write_buckets
from tidemark.sources.versioned import BUCKET, bucket_of


def feed_changes(out_path: str, state_path: str, payload: Sequence[str], buckets: int = 64):
    """A micro-batch handler that appends the status changes of a batch.

    Between batches one row per job is kept: what its watchers saw last and whether it has ended. The
    batch itself is worked off by the skew-safe batch operator, so a busy job does not sit in one
    task. A replayed batch is recognised by its number and adds nothing twice. Snapshots of a job that arrive
    in a later batch count as later.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(batch)
        keyed = rows.select("job_id").distinct().withColumn(BUCKET, bucket_of(["job_id"], buckets))
        stored = touched(spark, state_path, keyed)
        if stored is not None:
            stored = cut_lineage(stored)
            # A replay of the batch must start from the state before it.
            before = stored.select(
                "job_id", BUCKET, F.when(F.col("batch_id") == batch_id, F.col("earlier")).otherwise(F.struct("last_payload", "ended")).alias("s")
            ).select("job_id", BUCKET, "s.last_payload", "s.ended")
        else:
            before = None
        changes = status_changes(rows, payload, previous=None if before is None else before.drop(BUCKET))
        changes.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(out_path)

        body = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
        now = rows.groupBy("job_id").agg(
            F.max_by(body, F.struct("ts", "seq")).alias("last_payload"), F.bool_or(F.col("status").isin(*TERMINAL)).alias("ended")
        ).withColumn(BUCKET, bucket_of(["job_id"], buckets))
        if before is None:
            earlier = F.struct(F.lit(None).cast("string").alias("last_payload"), F.lit(False).alias("ended"))
            fresh = now.withColumn("earlier", earlier)
            kept = None
        else:
            known = before.select("job_id", F.struct("last_payload", "ended").alias("earlier"))
            fresh = now.join(known, "job_id", "left").withColumn(
                "ended", F.col("ended") | F.coalesce(F.col("earlier.ended"), F.lit(False))
            )
            kept = stored.join(now.select("job_id"), "job_id", "left_anti")
        fresh = fresh.withColumn("batch_id", F.lit(batch_id).cast("bigint")).select(
            "job_id", "last_payload", "ended", "earlier", "batch_id", BUCKET
        )
        write_buckets(fresh if kept is None else fresh.unionByName(kept.select(fresh.columns)), state_path)

    return handle


def keep_jobs(path: str, buckets: int = 64):
    """A micro-batch handler that adds the jobs' first and last events of a batch to a store (``stores.read_jobs``).

    Names stay as in the earliest event and the status follows the latest one by time, also where events arrive late.
    """

    def handle(batch: DataFrame, _batch_id: int) -> None:
        versioned.append(job_states(batch), path, ["job_id"], fold_jobs, buckets)

    return handle
