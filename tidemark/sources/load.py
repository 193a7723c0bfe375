"""Bulk loads, their results, and logs of load jobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# Lines of a load job's log that tell the row counts.
READ_COUNT = r"Total Read Count\s*:\s*(\d+)"
WRITE_COUNT = r"Total Write Count\s*:\s*(\d+)"

LOAD_SCHEMA = (
    "job_id string, table_name string, wave int, migration_status string, source_row_count bigint, "
    "target_row_count bigint, duration_seconds double, error string"
)


def bulk_load(
    spark: SparkSession,
    job_id: str,
    waves: Sequence[Sequence[str]],
    read: Callable[[str], DataFrame],
    write: Callable[[DataFrame, str], None],
    count_target: Callable[[str], int],
    parallelism: int = 4,
) -> DataFrame:
    """Load tables wave by wave, the tables of a wave side by side; one row per table comes back.

    Rows are counted while they are written; ``count_target`` counts the target afterwards, where a
    database is best asked for its own count. A table that fails is
    reported as ERROR and stops neither its wave nor the next. The driver handles table names only;
    give the session the FAIR scheduler to share executors between the tables of a wave.
    """

    def one(wave: int, name: str) -> tuple:
        start = time.monotonic()
        try:
            df = read(name)
            if df.isEmpty():
                write(df, name)
                moved = 0
            else:
                seen = Observation(f"load {job_id} {name}")
                write(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
                moved = seen.get["rows"]
            arrived = count_target(name)
            return (job_id, name, wave, "SUCCESS", moved, arrived, time.monotonic() - start, None)
        except Exception as exc:
            return (job_id, name, wave, "ERROR", None, None, None, str(exc))

    rows = []
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        for number, names in enumerate(waves):
            task = inheritable_thread_target(spark)(one)
            rows += list(pool.map(lambda name: task(number, name), names))
    return spark.createDataFrame(rows, LOAD_SCHEMA)


def waves_of(planned: DataFrame) -> list[list[str]]:
    """Table names per wave of one job, from ``load_waves``; tables without a wave go last, in catalogue order."""
    rows = planned.select("table_name", "wave", "ord").orderBy(F.col("wave").asc_nulls_last(), "ord").collect()
    out: dict[object, list[str]] = {}
    for row in rows:
        out.setdefault(row["wave"], []).append(row["table_name"])
    return list(out.values())


def load_metrics(loads: DataFrame) -> DataFrame:
    """Rows moved and rows per second per load; the stored seconds are whole."""
    seconds = F.col("duration_seconds")
    moved = F.coalesce("target_row_count", F.lit(0))
    return (
        loads.withColumn("rows_migrated", moved)
        .withColumn("throughput_rows_per_sec", F.when(seconds > 0, F.col("rows_migrated") / seconds))
        .withColumn("duration_seconds", F.floor(seconds).cast("int"))
    )


def load_totals(loads: DataFrame) -> DataFrame:
    """Rows moved per job, over the loads that succeeded."""
    done = F.col("migration_status") == "SUCCESS"
    return loads.groupBy("job_id").agg(
        F.coalesce(F.sum(F.when(done, F.coalesce("target_row_count", F.lit(0)))), F.lit(0)).cast("bigint").alias("rows_moved"),
        F.count_if(~done).alias("failed_tables"),
    )


def scrape_load_log(lines: DataFrame) -> DataFrame:
    """Read and write counts per job log: the first line that tells each, NULL when none does.

    Input: job_id, line_no, line. Counts are picked by line number while aggregating, so a long log
    is never put in order as a whole.
    """

    def first(pattern: str):
        hit = F.regexp_extract("line", pattern, 1)
        told = hit != ""
        return F.min_by(F.when(told, hit), F.when(told, F.col("line_no"))).cast("bigint")

    return lines.groupBy("job_id").agg(first(READ_COUNT).alias("rows_read"), first(WRITE_COUNT).alias("rows_written"))


def read_load_logs(spark: SparkSession, path: str) -> DataFrame:
    """A folder of job logs as (job_id, line_no, line); the file name is the job.

    ``line_no`` orders the lines of one file by the block they were read in and their place in it, so
    a long log may be split over tasks.
    """
    return spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("job_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"),
        F.col("value").alias("line"),
    )
