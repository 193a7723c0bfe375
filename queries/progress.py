"""Timelines, status feeds and approvals over the events table."""

from queries.base import FIXTURES, query
from tidemark.operators import progress

FIXTURES["steps"] = """
SELECT user_id AS job_id, ts, event_id AS step_id, CASE event_type WHEN 'view' THEN 'Discover' WHEN 'click' THEN 'Plan' WHEN 'signup' THEN 'Generate'
       WHEN 'purchase' THEN 'DataMigrate' ELSE CASE WHEN value > 20 THEN 'Validate' ELSE 'Rollback' END END AS phase, value FROM {events}"""
FIXTURES["snapshots"] = """
SELECT user_id AS job_id, ts, event_id AS seq, CASE WHEN value > 200 THEN CASE WHEN event_type = 'error' THEN 'ABORTED' ELSE 'DONE' END
       WHEN event_type IN ('error', 'signup') THEN 'PAUSED' ELSE 'RUNNING' END AS status,
       CASE WHEN value > 40 THEN 'Validate' WHEN value > 20 THEN 'Plan' END AS phase FROM {events}"""
FIXTURES["decisions"] = """
SELECT user_id AS job_id, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'HumanReviewPlan' WHEN 'click' THEN 'HumanReviewPlan'
       WHEN 'signup' THEN 'HumanReviewValidation' ELSE 'HumanReviewCutover' END AS gate,
       CASE WHEN value > 60 THEN 'approve' WHEN value > 30 THEN 'modify' WHEN value > 20 THEN '' END AS decision,
       CASE WHEN event_type = 'view' THEN concat('user-', event_id) END AS reviewer FROM {events}"""

_GROUP = "CASE s.phase " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in progress.DISPLAY_GROUPS.items()) + " END"


SQL_TIMELINE = f"""
WITH p AS (SELECT job_id, phase, row_number() OVER (PARTITION BY job_id ORDER BY min(ts), phase) AS phase_no FROM {{steps}} s GROUP BY job_id, phase)
SELECT s.*, p.phase_no, row_number() OVER (PARTITION BY s.job_id, s.phase ORDER BY ts, step_id) AS step_no, {_GROUP} AS display_group
FROM {{steps}} s JOIN p ON p.job_id = s.job_id AND p.phase = s.phase"""


@query("trace_timeline", SQL_TIMELINE)
def trace_timeline(t):
    return progress.trace_timeline(t.steps)


@query("trace_timeline_sliced", SQL_TIMELINE)
def trace_timeline_sliced(t):
    # A limit this low sends nearly every job down the path meant for busy ones.
    return progress.trace_timeline(t.steps, ranges=6)


SQL_CHANGES = """
SELECT job_id, ts, seq, status, phase FROM (
SELECT *, lag((status, phase)) OVER w AS seen, (status, phase) AS body, min(CASE WHEN status IN ('DONE', 'ABORTED', 'ROLLED_BACK') THEN (ts, seq) END)
  OVER (PARTITION BY job_id) AS stop FROM {snapshots} s WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)) x
WHERE (seen IS NULL OR body IS DISTINCT FROM seen) AND (stop IS NULL OR (ts, seq) <= stop)"""


@query("status_changes", SQL_CHANGES)
def status_changes(t):
    return progress.status_changes(t.snapshots, ["status", "phase"]).drop("body")


@query("status_changes_sliced", SQL_CHANGES)
def status_changes_sliced(t):
    return progress.status_changes(t.snapshots, ["status", "phase"], ranges=6).drop("body")


@query("approval_audit", """SELECT job_id, ts, seq, gate, coalesce(nullif(decision, ''), 'reject') AS decision, coalesce(reviewer, 'unknown') AS reviewer FROM {decisions} d""")
def approval_audit(t):
    return progress.approval_audit(t.decisions)


@query("latest_approvals", """
SELECT *, CASE WHEN gate = 'HumanReviewPlan' AND decision = 'approve' THEN 'Transform' WHEN gate = 'HumanReviewPlan' AND decision = 'modify' THEN 'Plan'
  WHEN gate = 'HumanReviewValidation' AND decision = 'approve' THEN 'ApplyManualReviews' WHEN gate = 'HumanReviewValidation' AND decision = 'modify' THEN 'DataMigrate'
  WHEN gate = 'HumanReviewCutover' AND decision = 'approve' THEN 'Cutover' ELSE 'END' END AS next_phase FROM (
SELECT job_id, gate, coalesce(nullif(arg_max(coalesce(decision, ''), (ts, seq)), ''), 'reject') AS decision,
       coalesce(nullif(arg_max(coalesce(reviewer, ''), (ts, seq)), ''), 'unknown') AS reviewer, count(*) AS decisions FROM {decisions} d GROUP BY ALL) x""")
def latest_approvals(t):
    return progress.latest_approvals(t.decisions)
