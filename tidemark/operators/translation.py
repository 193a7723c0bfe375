"""Translated DDL as data: cleaning, scoring, status and what became of it on the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.ddl_text import ANSWER_PATTERN, confidence, remap_schema, requote, strip_oracle_noise, unescape_ddl
from tidemark.operators.joins import shuffled

# Thresholds, penalties and the answer that stands for "nothing to translate".
LOW_CONFIDENCE = 0.7
HIGH_BAND = 0.8
UNSTATED, FLOOR_FALLBACK = 0.75, 0.2
LIFT_PENALTY, FALLBACK_LIFT_PENALTY, FALLBACK_PENALTY = 0.05, 0.1, 0.15
RULE_ONLY, ALL_FAILED = 0.5, 0.0
NOTHING_TO_DO = "Warning: No piece find"


def requote_identifiers(objects: DataFrame, case_map: DataFrame, ddl: str = "ddl") -> DataFrame:
    """Quote bare table and column names with the spelling of the catalogue.

    Only the names whose first word occurs in an object's text are brought to it, by an equi-join on
    job and word; the catalogue is never broadcast and a text sees only its own candidates.
    ``objects`` needs (job_id, object_id) as its key.
    """
    key = ["job_id", "object_id"]
    words = objects.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(ddl), F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("_word"))
    named = case_map.withColumn("_word", F.regexp_extract("lower_name", r"(?U)\w+", 0)).filter(F.col("_word") != "")
    found = (
        words.join(shuffled(named), ["job_id", "_word"])
        .groupBy(*key, "lower_name")
        .agg(F.max("name").alias("name"))
        .groupBy(*key)
        .agg(F.collect_list(F.struct("lower_name", "name")).alias("_n"))
    )
    fixed = requote(F.col(ddl), F.map_from_entries("_n"))
    return objects.join(shuffled(found), key, "left").withColumn(ddl, F.when(F.col("_n").isNull(), F.col(ddl)).otherwise(fixed)).drop("_n")


def clean_ddl(objects: DataFrame, case_map: DataFrame) -> DataFrame:
    """The cleaning steps in order, for every target but Oracle.

    Input columns: job_id, object_id, target_dialect, source_schema, target_schema, ddl.
    """
    dialect = F.col("target_dialect")
    plain = strip_oracle_noise(unescape_ddl(F.col("ddl")))
    mapped = remap_schema(plain, F.col("source_schema"), F.col("target_schema"), dialect)
    kept = objects.withColumn("ddl", F.when(dialect == "oracle", F.col("ddl")).otherwise(mapped))
    to_quote = requote_identifiers(kept.filter(dialect == "postgresql"), case_map)
    return to_quote.unionByName(kept.filter((dialect != "postgresql") | dialect.isNull()))


def extract_confidences(answers: DataFrame, pattern: str = ANSWER_PATTERN) -> DataFrame:
    """Confidence per answer; answers without a readable one are left out."""
    return answers.withColumn("confidence", confidence(F.col("content"), pattern)).filter(F.col("confidence").isNotNull())


def score_translation(objects: DataFrame, answers: DataFrame, pattern: str = ANSWER_PATTERN) -> DataFrame:
    """Confidence per object from how it was translated (``method``), its answers and its ``lifts``."""
    key = ["job_id", "object_name"]
    told = answers.groupBy(*key).agg(
        F.avg(confidence(F.col("content"), pattern)).alias("_mean"),
        F.count_if(F.col("content") != NOTHING_TO_DO).alias("_asked"),
    )
    lifts = F.col("lifts")
    asked = F.coalesce("_asked", F.lit(0)) > 0
    stated = F.coalesce("_mean", F.when(asked, UNSTATED).otherwise(1.0))
    hybrid = F.greatest(F.lit(0.0), stated - F.lit(LIFT_PENALTY) * lifts)
    lifted = F.greatest(F.lit(0.0), F.coalesce("_mean", F.lit(UNSTATED)) - F.lit(FALLBACK_LIFT_PENALTY) * lifts)
    fallback = F.greatest(F.lit(FLOOR_FALLBACK), lifted - F.lit(FALLBACK_PENALTY))
    method = F.col("method")
    score = (
        F.when(method == "hybrid", F.round(hybrid, 4))
        .when(method == "model_only", F.round(fallback, 4))
        .when(method == "rule_only", F.lit(RULE_ONLY))
        .otherwise(F.lit(ALL_FAILED))
    )
    return objects.join(shuffled(told), key, "left").withColumn("confidence", score).drop("_mean", "_asked")


def _low() -> Column:
    return F.col("status").isin("NO_SOURCE_DDL", "ERROR") | F.coalesce(F.col("confidence") <= LOW_CONFIDENCE, F.lit(False))


def translation_status(objects: DataFrame) -> DataFrame:
    """Status and low-confidence flag from (object_type, source_ddl, error, target_ddl, confidence)."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    status = (
        F.when(F.col("object_type") == "table", "SKIPPED_TABLE")
        .when(blank("source_ddl"), "NO_SOURCE_DDL")
        .when(F.col("error").isNotNull(), "ERROR")
        .when(blank("target_ddl"), "FAILED")
        .otherwise("SUCCESS")
    )
    ranked = objects.withColumn("status", status).withColumn(
        "confidence", F.when(F.col("status").isin("SUCCESS", "FAILED"), F.col("confidence"))
    )
    return ranked.withColumn("low_confidence", _low())


def average_confidence(statuses: DataFrame) -> DataFrame:
    """Mean confidence per job over the objects that have one; NULL when none has."""
    return statuses.groupBy("job_id").agg(F.avg("confidence").alias("average_confidence"))


def applicable_translations(translations: DataFrame, catalog: DataFrame, include_pending: bool = False) -> DataFrame:
    """Successful translations that have a text and were not applied yet (or also those put off for review)."""
    status = F.col("applied_status")
    free = status.isNull() | (status == "PENDING_MANUAL_REVIEW") if include_pending else status.isNull()
    ready = translations.filter((F.col("translation_status") == "SUCCESS") & F.col("target_ddl").isNotNull() & free)
    return ready.select("id", "job_id", "source_object_id", "target_ddl").join(
        shuffled(catalog.select(F.col("object_id").alias("source_object_id"), "object_type", "object_name")), "source_object_id"
    )


def apply_outcomes(attempts: DataFrame, flagged: DataFrame) -> DataFrame:
    """What an attempt to apply each object amounts to.

    Names flagged for review are put off; a foreign key that already exists counts as applied.
    """
    names = flagged.select("job_id", "object_name").distinct().withColumn("_flag", F.lit(True))
    exists = (F.col("object_type") == "foreign_key") & F.lower("error").contains("already exists")
    status = (
        F.when(F.col("_flag"), "PENDING_MANUAL_REVIEW")
        .when(F.col("error").isNull() | exists, "APPLIED")
        .otherwise("APPLY_FAILED")
    )
    return attempts.join(shuffled(names), ["job_id", "object_name"], "left").withColumn("applied_status", status).withColumn(
        "applied_error", F.when(F.col("applied_status") == "APPLY_FAILED", F.col("error"))
    ).drop("_flag", "error")


def applied_outcomes(translations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Outcome per (job, type, name) of everything translated."""
    return translations.select("source_object_id", "applied_status", "applied_error").join(
        shuffled(catalog.select(F.col("object_id").alias("source_object_id"), "job_id", "object_type", "object_name")), "source_object_id"
    ).drop("source_object_id")


def confidence_band(c: Column) -> Column:
    return F.when(c >= HIGH_BAND, "high").when(c >= LOW_CONFIDENCE, "medium").when(c.isNotNull(), "low")


def translation_summary(statuses: DataFrame) -> DataFrame:
    """Objects per job, status and confidence band."""
    return statuses.groupBy("job_id", "status", confidence_band(F.col("confidence")).alias("band")).agg(
        F.count(F.lit(1)).alias("objects")
    )
