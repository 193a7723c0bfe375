"""Risk register, counts and manual review lists for whole estates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.native_types import base_type, is_risky
from tidemark.operators.joins import shuffled
from tidemark.operators.ordering import number_rows

# Object kinds of the plan row, risk per kind, valid levels, and how many objects are refined at a time.
PLAN_TYPES = ("table", "view", "procedure", "function", "trigger")
RISK_BY_TYPE = {"view": "medium", "foreign_key": "medium", "procedure": "high", "function": "high", "trigger": "high"}
RISK_LEVELS = ("low", "medium", "high")
BATCH_SIZE = 30
TYPE_REASON = "columns use vendor-specific type(s) with no direct equivalent: "
KIND_REASON = " definitions typically require manual translation review"


def object_counts(catalog: DataFrame) -> DataFrame:
    """One row per job: how many tables, views, procedures, functions and triggers."""
    return catalog.groupBy("job_id").agg(
        *[F.count_if(F.col("object_type") == kind).alias(f"{kind}s") for kind in PLAN_TYPES]
    )


def score_risk(objects: DataFrame, columns: DataFrame) -> DataFrame:
    """Risk level and reason per object.

    A table is high when a column's type has no counterpart elsewhere, and names those types; other
    objects follow their kind. ``columns`` is reduced to the risky ones before it meets the objects. Both sides are
    matched by schema too, so tables of the same name in two schemas have a risk each.
    """
    hits = (
        columns.filter(is_risky(F.col("dialect"), F.col("native_type")))
        .groupBy("job_id", "schema_name", F.col("table_name").alias("object_name"))
        .agg(F.array_join(F.sort_array(F.collect_set(F.upper(base_type(F.col("native_type"))))), ", ").alias("_hits"))
        .withColumn("object_type", F.lit("table"))
    )
    kind = F.col("object_type")
    by_kind = F.create_map(*[F.lit(x) for kv in RISK_BY_TYPE.items() for x in kv])
    level = F.when(kind == "table", F.when(F.col("_hits").isNotNull(), "high").otherwise("low")).otherwise(
        F.coalesce(by_kind[kind], F.lit("medium"))
    )
    reason = F.when(kind == "table", F.concat(F.lit(TYPE_REASON), F.col("_hits"))).otherwise(F.concat(kind, F.lit(KIND_REASON)))
    return objects.join(shuffled(hits), ["job_id", "schema_name", "object_name", "object_type"], "left").select(
        "job_id", "ord", "object_name", "object_type", level.alias("risk_level"), reason.alias("reason")
    )


def refinement_candidates(register: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """All medium and high objects of each job, in batches of ``size`` in catalogue order; batch 0 is reviewed first.

    A job of any size is numbered over ranges of its objects (see ``operators.ordering``).
    """
    placed = number_rows(register.filter(F.col("risk_level").isin("medium", "high")), ["job_id"], ["ord"], "_place")
    return placed.withColumn("batch_no", F.floor((F.col("_place") - 1) / size).cast("int")).drop("_place")


def refine_risk(register: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply reviewed levels (job_id, object_name, risk_level, reason, seq) by name; the last valid one counts.

    Overrides that carry an ``object_type`` reach objects of that kind alone. Levels outside low/medium/high are dropped; an override without a reason keeps the old one.
    """
    names = ["job_id", "object_name", *(["object_type"] if "object_type" in overrides.columns else [])]
    valid = (
        overrides.filter(F.col("risk_level").isin(*RISK_LEVELS))
        .groupBy(*names)
        .agg(F.max_by(F.struct("risk_level", "reason"), "seq").alias("_o"))
    )
    return register.join(shuffled(valid), names, "left").select(
        "job_id", "ord", "object_name", "object_type",
        F.coalesce("_o.risk_level", "risk_level").alias("risk_level"),
        F.coalesce("_o.reason", "reason").alias("reason"),
    )


def manual_review(register: DataFrame, low_confidence: DataFrame) -> DataFrame:
    """High-risk names first, then low-confidence names, each name once with its first place."""
    high = register.filter(F.col("risk_level") == "high").select("job_id", "object_name", F.lit(0).alias("list_no"), "ord")
    low = low_confidence.select("job_id", "object_name", F.lit(1).alias("list_no"), "ord")
    return (
        high.unionByName(low)
        .groupBy("job_id", "object_name")
        .agg(F.min(F.struct("list_no", "ord")).alias("_p"))
        .select("job_id", "object_name", "_p.list_no", "_p.ord")
    )


def risk_breakdown(register: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    return register.groupBy(*keys).agg(*[F.count_if(F.col("risk_level") == x).alias(x) for x in RISK_LEVELS])


def with_type_priority(objects: DataFrame, order: Sequence[Sequence[str]]) -> DataFrame:
    """Priority of an object's kind: its place in ``order``, 99 for kinds not listed."""
    out = F.lit(99)
    for i, kinds in reversed(list(enumerate(order))):
        out = F.when(F.col("object_type").isin(*kinds), i).otherwise(out)
    return objects.withColumn("priority", out)


