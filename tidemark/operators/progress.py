"""Progress of jobs: timelines, status changes and approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ordering import RANGE, TIE, carry_over, earlier, in_ranges, inside, join_groups, running

# Display group of each phase, the phase of steps that name none, statuses that end a job, and what an approval without an entry means.
DISPLAY_GROUPS = {
    "Discover": "discovery", "Analyse": "discovery",
    "Plan": "plan", "HumanReviewPlan": "plan",
    "Transform": "schema_translation", "Generate": "schema_translation", "CodeRefactor": "schema_translation",
    "DataMigrate": "data_migration",
    "Validate": "validation", "HumanReviewValidation": "validation",
    "Test": "test_report", "HumanReviewCutover": "test_report",
    "Cutover": "deployment", "Verify": "deployment",
}
NO_PHASE = "Unknown"
TERMINAL = ("DONE", "ABORTED", "ROLLED_BACK")
DEFAULT_DECISION, DEFAULT_REVIEWER = "reject", "unknown"
ROUTES = {
    "HumanReviewPlan": {"approve": "Transform", "modify": "Plan"},
    "HumanReviewValidation": {"approve": "ApplyManualReviews", "modify": "DataMigrate"},
    "HumanReviewCutover": {"approve": "Cutover"},
}


def trace_timeline(steps: DataFrame, ranges: int | None = None) -> DataFrame:
    """Steps numbered within job and phase, phases numbered in the order they first appear.

    Input: job_id, phase, ts, step_id. A phase of any size is numbered range by range (see ``ordering``); its
    place among the job's phases comes by key and range too, so no task holds a whole phase.
    """
    key, order = ["job_id", "phase"], ["ts", "step_id"]
    ranged = in_ranges(steps.withColumn("phase", F.coalesce("phase", F.lit(NO_PHASE))), key, order, ranges)
    cuts = ranged.groupBy(*key, RANGE).agg(F.min("ts").alias("_first"))
    phases = cuts.groupBy(*key).agg(F.min("_first").alias("_first")).withColumn(
        "phase_no", F.row_number().over(Window.partitionBy("job_id").orderBy("_first", "phase"))
    ).select(*key, "phase_no")
    numbered = running(ranged, key, order, F.lit(1), "step_no")
    group = F.create_map(*[F.lit(x) for kv in DISPLAY_GROUPS.items() for x in kv])[F.col("phase")]
    placed = join_groups(numbered, join_groups(cuts.drop("_first"), phases, key), [*key, RANGE])
    return placed.drop(RANGE, TIE).withColumn("display_group", group)


def _seen_and_stop(ranged: DataFrame) -> DataFrame:
    """Add to each snapshot the payload before it (``_seen``) and the first terminal snapshot of its job up to its range (``_stop``)."""
    job, order = ["job_id"], ["ts", "seq"]
    end = F.when(F.col("status").isin(*TERMINAL), F.struct(*order))
    brought = carry_over(
        ranged, job, {"_last": F.max_by("_body", F.struct(*order, TIE)), "_end": F.min(end)},
        {"_before": F.last("_last").over(earlier(job)), "_ended": F.min("_end").over(earlier(job))},
    )
    here = inside(job, order)
    return brought.withColumn("_seen", F.coalesce(F.lag("_body").over(here), "_before")).withColumn(
        "_stop", F.coalesce("_ended", F.min(end).over(Window.partitionBy("job_id", RANGE)))
    )


def status_changes(
    snapshots: DataFrame, payload: Sequence[str], ranges: int | None = None, previous: DataFrame | None = None
) -> DataFrame:
    """The snapshots a watcher is sent: those that differ from the one before, up to the first terminal status.

    Input: job_id, ts, seq, status and the ``payload`` columns compared. ``previous`` (job_id,
    last_payload, ended) continues from an earlier run. A job of any size is spread over ranges of time (see
    ``ordering``), and one row per range carries the last payload and the end over to the next.
    """
    order = F.struct("ts", "seq")
    told = snapshots.withColumn("_body", F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))
    placed = _seen_and_stop(in_ranges(told, ["job_id"], ["ts", "seq"], ranges))
    if previous is not None:
        placed = join_groups(placed, previous.select("job_id", "last_payload", "ended"), ["job_id"], "left").filter(
            ~F.coalesce(F.col("ended"), F.lit(False))
        ).withColumn("_seen", F.coalesce("_seen", "last_payload"))
    return (
        placed.filter(F.col("_stop").isNull() | (order <= F.col("_stop")))
        .filter(F.col("_seen").isNull() | (F.col("_seen") != F.col("_body")))
        .select("job_id", "ts", "seq", "status", *[c for c in payload if c != "status"], F.col("_body").alias("body"))
    )


def approval_audit(events: DataFrame) -> DataFrame:
    """All decisions with their defaults filled in; nothing is ever removed."""
    filled = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    return events.withColumn("decision", filled("decision", DEFAULT_DECISION)).withColumn(
        "reviewer", filled("reviewer", DEFAULT_REVIEWER)
    )


def _route(gate: Column, decision: Column) -> Column:
    out = F.lit("END")
    for name, targets in ROUTES.items():
        for word, target in targets.items():
            out = F.when((gate == name) & (decision == word), target).otherwise(out)
    return out


def latest_approvals(events: DataFrame) -> DataFrame:
    """The latest decision per job and gate and where it sends the job."""
    last = approval_audit(events).groupBy("job_id", "gate").agg(
        F.max_by(F.struct("decision", "reviewer"), F.struct("ts", "seq")).alias("_d"), F.count(F.lit(1)).alias("decisions")
    )
    return last.select("job_id", "gate", "_d.decision", "_d.reviewer", "decisions").withColumn(
        "next_phase", _route(F.col("gate"), F.col("decision"))
    )
