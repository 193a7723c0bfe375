"""Checks on the loaded target: foreign keys, keys, objects, sequences and the overall test report."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.joins import shuffled
from tidemark.operators.ordering import text_parts
from tidemark.operators.reconcile import OBJECT_OK, union_all

# Kinds of objects looked up on the target, the statuses that fail the missing-objects check, and the smoke limit.
CHECKED_TYPES = ("view", "procedure", "function", "trigger", "foreign_key")
MISSING_STATUSES = ("MISSING", "APPLY_FAILED", "ERROR")
SLOW_SECONDS = 5.0
PENDING_DETAIL = "Flagged for manual review; not applied to the target yet"
ALL_VALID = "All foreign keys reference valid rows"
NONE_MISSING = "No missing objects detected"


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: str
    columns: tuple[str, ...]
    parent: str
    ref_columns: tuple[str, ...]

    @property
    def label(self) -> str:
        pairs = ", ".join(f"{self.child}.{c} -> {self.parent}.{r}" for c, r in zip(self.columns, self.ref_columns))
        return f"{self.name} ({pairs})"


def _all_set(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def orphan_rows(child: DataFrame, parent: DataFrame, columns: Sequence[str], ref_columns: Sequence[str]) -> DataFrame:
    """Child rows whose key is set in all parts and has no parent."""
    refs = parent.select(*[F.col(r).alias(f"_ref{i}") for i, r in enumerate(ref_columns)])
    on = [F.col(c) == F.col(f"_ref{i}") for i, c in enumerate(columns)]
    return child.filter(_all_set(columns)).join(refs, on, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Orphans of one foreign key. Child rows are counted per key first, so a hot key meets the join as one row.

    The counts lie by key already; the parents' keys are shuffled to them, as several parents are checked in one job.
    """
    keys = child.filter(_all_set(fk.columns)).groupBy(*fk.columns).agg(F.count(F.lit(1)).alias("_rows"))
    return orphan_rows(keys, shuffled(parent), fk.columns, fk.ref_columns).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("orphan_rows")
    ).select(F.lit(fk.name).alias("constraint_name"), F.lit(fk.label).alias("label"), "orphan_rows")


def orphan_counts(tables: Mapping[str, DataFrame], fks: Sequence[ForeignKey]) -> DataFrame:
    """Orphans per foreign key, all in one job."""
    return union_all([
        orphan_count(tables[fk.child], tables[fk.parent], fk).withColumn("seq", F.lit(i)) for i, fk in enumerate(fks)
    ])


def referential_integrity(counts: DataFrame) -> DataFrame:
    """One check row from the counts of ``orphan_counts``; the findings are as many as the foreign keys at most."""
    finding = F.concat("label", F.lit(": "), F.col("orphan_rows").cast("string"), F.lit(" orphan rows"))
    hits = F.array_sort(F.collect_list(F.when(F.col("orphan_rows") > 0, F.struct("seq", finding.alias("text")))))
    return counts.agg(hits.alias("_h")).select(
        F.lit("referential_integrity").alias("check"),
        F.when(F.size("_h") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.when(F.size("_h") == 0, F.lit(ALL_VALID)).otherwise(
            F.array_join(F.transform("_h", lambda x: x["text"]), "; ")
        ).alias("detail"),
    )


def check_referential_integrity(spark: SparkSession, tables: Mapping[str, DataFrame], fks: Sequence[ForeignKey]) -> DataFrame:
    """As above; any fault, in the plan or while it runs, makes the check ERROR instead of failing the report.

    The check is worked out here; its one row is what comes back.
    """
    schema = "check string, status string, detail string"
    try:
        return spark.createDataFrame([tuple(referential_integrity(orphan_counts(tables, fks)).first())], schema)
    except Exception as exc:
        return spark.createDataFrame([("referential_integrity", "ERROR", str(exc))], schema)


def key_check(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Would this primary key hold? Duplicate keys, the rows they cover, and rows with a NULL in the key."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    full = _all_set(key)
    double = full & (F.col("_n") > 1)
    return per_key.agg(
        F.count_if(double).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(double, F.col("_n"))), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(~full, F.col("_n"))), F.lit(0)).cast("bigint").alias("null_key_rows"),
    ).withColumn("key_holds", (F.col("duplicate_keys") == 0) & (F.col("null_key_rows") == 0))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.filter(_all_set(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def sequence_reseed(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Next value for each table's key sequence: greatest key plus one."""
    return union_all([
        df.agg((F.coalesce(F.max(pk), F.lit(0)) + 1).cast("bigint").alias("next_value")).select(
            F.lit(name).alias("table_name"), F.lit(pk).alias("key_column"), "next_value"
        )
        for name, (df, pk) in tables.items()
    ])


def object_existence(
    catalog: DataFrame, target: DataFrame, applied: DataFrame, unreadable: DataFrame | None = None
) -> DataFrame:
    """Status on the target of every non-table object; names are compared without regard to case.

    ``target`` lists (job_id, object_type, object_name), ``applied`` adds applied_status and
    applied_error, ``unreadable`` the jobs whose target could not be listed.
    """
    wanted = catalog.filter(F.col("object_type").isin(*CHECKED_TYPES)).withColumn("_lower", F.lower("object_name"))
    there = target.select("job_id", "object_type", F.lower("object_name").alias("_lower")).distinct().withColumn("_there", F.lit(True))
    outcome = applied.groupBy("job_id", "object_type", "object_name").agg(
        F.max_by(F.struct("applied_status", "applied_error"), "seq").alias("_a")
    )
    joined = wanted.join(shuffled(there), ["job_id", "object_type", "_lower"], "left").join(
        shuffled(outcome), ["job_id", "object_type", "object_name"], "left"
    )
    if unreadable is not None:
        joined = joined.join(shuffled(unreadable.select("job_id", F.lit(True).alias("_lost")).distinct()), "job_id", "left")
    else:
        joined = joined.withColumn("_lost", F.lit(None).cast("boolean"))
    how = F.col("_a.applied_status")
    status = (
        F.when(F.col("_lost"), "ERROR")
        .when(F.col("_there"), "PRESENT")
        .when(how == "PENDING_MANUAL_REVIEW", "PENDING_MANUAL_REVIEW")
        .when(how == "APPLY_FAILED", "APPLY_FAILED")
        .otherwise("MISSING")
    )
    return joined.withColumn("status", status).select(
        "job_id", "ord", "object_type", "object_name", "status",
        F.when(F.col("status") == "PENDING_MANUAL_REVIEW", PENDING_DETAIL)
        .when(F.col("status") == "APPLY_FAILED", F.col("_a.applied_error"))
        .alias("detail"),
    )


def schema_compatibility(objects: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """PASS iff every object is present or pending; a job without objects passes (give ``jobs`` to see it)."""
    per_job = objects.groupBy("job_id").agg(
        F.bool_and(F.col("status").isin(*OBJECT_OK)).alias("_ok"),
        F.count_if(F.col("status") == "PRESENT").alias("_present"),
        F.count(F.lit(1)).alias("_total"),
    )
    if jobs is not None:
        per_job = jobs.select("job_id").distinct().join(shuffled(per_job), "job_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return per_job.select(
        "job_id",
        F.lit("schema_compatibility").alias("check"),
        F.when(F.coalesce("_ok", F.lit(True)), "PASS").otherwise("FAIL").alias("status"),
        F.concat(number("_present"), F.lit("/"), number("_total"), F.lit(" translated objects present on target")).alias("detail"),
    )


def missing_objects(objects: DataFrame, part_size: int = 1000) -> DataFrame:
    """Missing or failed objects per job, listed in catalogue order.

    The list comes in parts of at most ``part_size`` catalogue positions, each with the job's whole
    count; jobs with nothing missing have one PASS row.
    """
    lost = F.col("status").isin(*MISSING_STATUSES)
    totals = objects.groupBy("job_id").agg(F.count_if(lost).alias("missing"))
    names = objects.filter(lost).select("job_id", "ord", F.concat("object_type", F.lit(":"), "object_name").alias("_name"))
    parts = text_parts(names, ["job_id"], "ord", "_name", ", ", part_size)
    listed = totals.join(shuffled(parts), "job_id", "left")
    return listed.select(
        "job_id",
        F.lit("missing_objects").alias("check"),
        F.when(F.col("missing") == 0, "PASS").otherwise("FAIL").alias("status"),
        "missing",
        F.coalesce("part_no", F.lit(0)).cast("bigint").alias("part_no"),
        F.when(F.col("missing") == 0, NONE_MISSING)
        .otherwise(F.concat(F.col("missing").cast("string"), F.lit(" missing/failed: "), F.col("text")))
        .alias("detail"),
    )


def performance_smoke(
    spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], int]], limit: float = SLOW_SECONDS
) -> DataFrame:
    """Time one ``COUNT(*)`` per table; counts and seconds are all that reaches the driver.

    A table is a DataFrame, or a function that asks its database for the count.
    """
    rows = []
    for name, df in tables.items():
        start = time.monotonic()
        try:
            count, error = df() if callable(df) else df.count(), None
        except Exception as exc:
            count, error = None, str(exc)
        seconds = time.monotonic() - start
        status = "ERROR" if error else "SLOW" if seconds > limit else "OK"
        rows.append((name, count, seconds, status, error))
    return spark.createDataFrame(rows, "table_name string, row_count bigint, seconds double, status string, error string")


def smoke_check(timings: DataFrame, limit: float = SLOW_SECONDS) -> DataFrame:
    """One check row from the timings."""
    slow = F.array_sort(F.collect_list(F.when(F.col("seconds") > limit, F.format_string("%s (%.2fs)", "table_name", "seconds"))))
    wrong = F.array_sort(F.collect_list(F.when(F.col("status") == "ERROR", F.col("error"))))
    agg = timings.agg(slow.alias("_slow"), wrong.alias("_wrong"), F.count(F.lit(1)).alias("_n"))
    return agg.select(
        F.lit("performance_smoke").alias("check"),
        F.when(F.size("_wrong") > 0, "ERROR").when(F.size("_slow") > 0, "FAIL").otherwise("PASS").alias("status"),
        F.when(F.size("_wrong") > 0, F.array_join("_wrong", "; "))
        .when(F.size("_slow") > 0, F.concat(F.lit(f"Slow tables (> {limit:.0f}s): "), F.array_join("_slow", ", ")))
        .otherwise(F.concat(F.lit("All "), F.col("_n").cast("string"), F.lit(f" table(s) respond within {limit:.0f}s")))
        .alias("detail"),
    )


def test_report(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Overall PASS iff every check passed; an ERROR is not a pass."""
    grouped = checks.groupBy(*keys) if keys else checks.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") != "PASS").alias("not_passed"),
        F.when(F.coalesce(F.bool_and(F.col("status") == "PASS"), F.lit(True)), "PASS").otherwise("FAIL").alias("overall_status"),
    )


def premigration_profile(df: DataFrame, limits: Mapping[str, int], dates: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """What a strict target will refuse: over-length text, zero dates, keys that differ only by case.

    One row per finding and column; text and dates are counted in one pass.
    """

    def finding(kind: str, column: str, hit: Column) -> Column:
        return F.struct(F.lit(kind).alias("finding"), F.lit(column).alias("column_name"), F.count_if(hit).alias("rows"))

    found = [finding("over_length", c, F.length(c) > n) for c, n in limits.items()]
    found += [finding("zero_date", c, F.col(c).cast("string").startswith("0000-00-00")) for c in dates]
    out = [df.agg(F.array(*found).alias("_f")).select(F.inline("_f"))]
    for k in keys:
        spellings = df.groupBy(F.col(k)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(k).isNotNull())
        folded = spellings.groupBy(F.lower(k).alias("_k")).agg(F.count(F.lit(1)).alias("_s"), F.sum("_n").alias("_n"))
        out.append(
            folded.filter(F.col("_s") > 1)
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"))
            .select(F.lit("case_equal_key").alias("finding"), F.lit(k).alias("column_name"), "rows")
        )
    return union_all(out)
