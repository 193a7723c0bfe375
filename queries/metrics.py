"""Rates, quantiles, costs and gauges over the events table."""

from pyspark.sql import functions as F

from queries.base import FIXTURES, query
from tidemark.operators import cluster, metrics

# Each event is one tool call: its type is the tool, its value the seconds it took.
FIXTURES["calls"] = """
SELECT event_id, ts, user_id AS job_id, event_type AS tool_name, value AS seconds, event_type <> 'error' AS ok, floor(value) AS whole,
       CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'Timeout' WHEN value > 10 THEN 'ConnectionError' END END AS error_type,
       cast(floor(value * 10) AS bigint) - 20 AS tokens_input, cast(floor(value * 3) AS bigint) - 5 AS tokens_output
FROM {events}"""
FIXTURES["gauges"] = """
SELECT event_id, ts, concat('app-', user_id) AS deployment_name, concat('ns-', user_id % 4) AS namespace, concat('cluster-', user_id % 3) AS cluster_name,
       CASE event_type WHEN 'view' THEN 'pod_available_replicas' WHEN 'click' THEN 'pod_desired_replicas' WHEN 'signup' THEN 'pod_ready_replicas'
       ELSE 'pod_restart_count' END AS metric, cast(floor(value / 10) AS bigint) AS value FROM {events}"""


def sql_windows(source: str, length: int, slide: int, labels: str, sums: str) -> str:
    """Every event copied into each of its windows (seconds), the plain way."""
    n = length // slide
    lab = labels + ", " if labels else ""
    return f"""SELECT make_timestamp((epoch_us(ts) // {slide * 1000000} - i) * {slide * 1000000}) AS window_start, {lab}{sums}
FROM {source} e, (SELECT unnest(range({n})) AS i) w GROUP BY ALL"""


SQL_INCREASE = sql_windows("{calls}", 300, 300, "tool_name", "count(*) AS increase")


@query("counter_increase_5m", SQL_INCREASE)
def counter_increase_5m(t):
    return metrics.counter_increase(t.calls, "5 minutes", ["tool_name"])


@query("counter_increase_1h_sliding", sql_windows("{calls}", 3600, 300, "tool_name", "count(*) AS increase"))
def counter_increase_1h_sliding(t):
    return metrics.counter_increase(t.calls, "1 hour", ["tool_name"], "5 minutes")


@query("counter_increase_24h", sql_windows("{calls}", 86400, 86400, "tool_name, job_id", "cast(sum(tokens_input) AS bigint) AS increase"))
def counter_increase_24h(t):
    return metrics.counter_increase(t.calls, "24 hours", ["tool_name", "job_id"], amount=F.col("tokens_input"))


@query("counter_rate_5m", "SELECT window_start, tool_name, increase / 300.0 AS rate FROM ("
       + sql_windows("{calls}", 300, 60, "tool_name", "count(*) AS increase") + ") x")
def counter_rate_5m(t):
    return metrics.counter_rate(t.calls, "5 minutes", ["tool_name"], "1 minute")


@query("gauge_last", """SELECT deployment_name, namespace, cluster_name, metric, arg_max(value, (ts, event_id)) AS value FROM {gauges} g GROUP BY ALL""")
def gauge_last(t):
    return metrics.gauge_last(t.gauges, ["deployment_name", "namespace", "cluster_name", "metric"], order=["ts", "event_id"])


def sql_buckets(kind: str) -> str:
    edges = [*metrics.BUCKETS[kind], None]
    return "(VALUES " + ", ".join(f"({i}, '{'+Inf' if b is None else f'{b:g}'}', {'1e308' if b is None else b})" for i, b in enumerate(edges)) + ") b(i, le, edge)"


@query("histogram", f"""
SELECT tool_name, round(sum(seconds), 4) AS "sum", count(*) AS "count", le, count(*) FILTER (seconds <= edge) AS bucket_count
FROM {{calls}} c, {sql_buckets('tool')} GROUP BY tool_name, le""")
def histogram(t):
    hist = metrics.histogram(t.calls, metrics.BUCKETS["tool"], ["tool_name"], "seconds")
    return metrics.histogram_rows(hist, metrics.BUCKETS["tool"], ["tool_name"]).withColumn("sum", F.round("sum", 4))


@query("histogram_by_job", f"""
SELECT job_id, tool_name, round(sum(seconds), 4) AS "sum", count(*) AS "count", le, count(*) FILTER (seconds <= edge) AS bucket_count
FROM {{calls}} c, {sql_buckets('agent')} GROUP BY job_id, tool_name, le""")
def histogram_by_job(t):
    hist = metrics.histogram(t.calls, metrics.BUCKETS["agent"], ["job_id", "tool_name"], "seconds")
    return metrics.histogram_rows(hist, metrics.BUCKETS["agent"], ["job_id", "tool_name"]).withColumn("sum", F.round("sum", 4))


def sql_quantiles(kind: str, grouped: str, keys: str) -> str:
    """``grouped`` yields keys, i, edge, cum, total."""
    last = metrics.BUCKETS[kind][-1]
    parts = ", ".join(
        f"round(max(CASE WHEN i = (SELECT min(z.i) FROM h z WHERE {' AND '.join(f'z.{k} = h.{k}' for k in keys.split(', '))} AND z.cum >= {q} * z.total) "
        f"THEN CASE WHEN edge > 1e300 THEN {last} ELSE low + (edge - low) * CASE WHEN cum > prev THEN ({q} * total - prev) / (cum - prev) ELSE 0 END END END), 6) AS p{q * 100:g}"
        for q in (0.5, 0.95, 0.99)
    )
    return f"""WITH g AS ({grouped}), h AS (SELECT *, coalesce(lag(edge) OVER w, 0) AS low, coalesce(lag(cum) OVER w, 0) AS prev
FROM g WINDOW w AS (PARTITION BY {keys} ORDER BY i)) SELECT {keys}, max(total) AS "count", {parts} FROM h GROUP BY {keys}"""


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c in ("p50", "p95", "p99")})


@query("histogram_quantile", sql_quantiles("tool", f"""
SELECT tool_name, i, edge, count(*) FILTER (seconds <= edge) AS cum, count(*) AS total FROM {{calls}} c, {sql_buckets('tool')} GROUP BY ALL""", "tool_name"))
def histogram_quantile(t):
    return rounded(metrics.quantiles(t.calls, metrics.BUCKETS["tool"], ["tool_name"], value="seconds"))


@query("histogram_quantile_5m", sql_quantiles("agent", f"""
SELECT make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS window_start, tool_name, i, edge, count(*) FILTER (seconds <= edge) AS cum, count(*) AS total
FROM {{calls}} c, {sql_buckets('agent')} GROUP BY ALL""", "window_start, tool_name"))
def histogram_quantile_5m(t):
    return rounded(metrics.windowed_quantiles(t.calls, "5 minutes", metrics.BUCKETS["agent"], ["tool_name"], value="seconds"))


@query("exact_quantiles", """
SELECT tool_name, round(quantile_cont(seconds, 0.5), 6) AS p50, round(quantile_cont(seconds, 0.95), 6) AS p95, round(quantile_cont(seconds, 0.99), 6) AS p99
FROM {calls} c GROUP BY tool_name""")
def exact_quantiles(t):
    return rounded(metrics.exact_quantiles(t.calls, ["tool_name"], value="seconds"))


@query("success_rate", "SELECT window_start, job_id, ok, total, round(100.0 * (ok / 3600.0) / (total / 3600.0 + 0.0001), 6) AS success_rate, "
       "round(100.0 * ok / total, 6) AS exact_rate FROM (" + sql_windows("{calls}", 3600, 3600, "job_id", "count(*) FILTER (ok) AS ok, count(*) AS total") + ") x")
def success_rate(t):
    found = metrics.success_rate(t.calls, "1 hour", ["job_id"], F.col("ok"))
    return found.withColumn("success_rate", F.round("success_rate", 6)).withColumn("exact_rate", F.round("exact_rate", 6))


@query("llm_cost", "SELECT *, round((tokens_input * 0.0003 + tokens_output * 0.0006) / 1000, 9) AS cost FROM ("
       + sql_windows("{calls}", 3600, 3600, "tool_name", "cast(sum(greatest(tokens_input, 0)) AS bigint) AS tokens_input, "
                     "cast(sum(greatest(tokens_output, 0)) AS bigint) AS tokens_output") + ") x")
def llm_cost(t):
    return metrics.llm_cost(t.calls, "1 hour", ["tool_name"]).withColumn("cost", F.round("cost", 9))


@query("failures_by_reason", sql_windows("(SELECT *, coalesce(error_type, 'unknown') AS reason FROM {calls} c WHERE NOT ok)", 86400, 3600, "job_id, reason", "count(*) AS increase"))
def failures_by_reason(t):
    return metrics.failures_by_reason(t.calls.filter(~F.col("ok")), "24 hours", ["job_id"], "error_type", "1 hour")


_DEPLOYMENT = ["deployment_name", "namespace", "cluster_name"]


@query("availability", """
SELECT *, round(100.0 * available / (desired + 0.0001), 6) AS availability FROM (
SELECT deployment_name, namespace, cluster_name, arg_max(value, (ts, event_id)) FILTER (metric = 'pod_available_replicas') AS available,
       arg_max(value, (ts, event_id)) FILTER (metric = 'pod_desired_replicas') AS desired FROM {gauges} g GROUP BY ALL) x
WHERE available IS NOT NULL AND desired IS NOT NULL""")
def availability(t):
    return metrics.availability(t.gauges, _DEPLOYMENT, ["ts", "event_id"]).withColumn("availability", F.round("availability", 6))


@query("sum_by_cluster", """
SELECT cluster_name, cast(sum(value) AS bigint) AS value FROM (SELECT deployment_name, namespace, cluster_name, arg_max(value, (ts, event_id)) AS value
FROM {gauges} g WHERE metric = 'pod_desired_replicas' GROUP BY ALL) x GROUP BY cluster_name""")
def sum_by_cluster(t):
    desired = t.gauges.filter(F.col("metric") == "pod_desired_replicas")
    return metrics.sum_by(desired, _DEPLOYMENT, ["cluster_name"], ["ts", "event_id"])


# Retries: each order is one attempt of a phase of the customer's job.
FIXTURES["retries"] = """
SELECT o.o_custkey AS job_id, o.o_orderpriority AS phase, j.source_dialect, j.target_dialect, CASE WHEN o.o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCESS' END AS status
FROM {orders} o JOIN {jobs} j ON j.job_id = o.o_custkey"""


@query("retry_stats", """
SELECT job_id, phase, source_dialect, target_dialect, count(*) AS attempts, count(*) FILTER (status = 'SUCCESS') AS successes,
       count(*) FILTER (status <> 'SUCCESS') AS failures FROM {retries} r GROUP BY ALL""")
def retry_stats(t):
    return metrics.retry_stats(t.retries)


# Steps: each line item is one step that starts when it ships; some still run.
FIXTURES["phase_steps"] = (
    "SELECT l_orderkey AS job_id, l_linenumber AS step_id, l_returnflag AS phase, l_shipdate AS start_time, l_linestatus, l_quantity, l_extendedprice, "
    "CASE WHEN l_linestatus = 'F' THEN timestampadd(SECOND, cast(l_quantity * 60 AS int), l_shipdate) END AS end_time FROM {lineitem}",
    "SELECT l_orderkey AS job_id, l_linenumber AS step_id, l_returnflag AS phase, l_shipdate AS start_time, l_linestatus, l_quantity, l_extendedprice, "
    "CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_seconds(cast(l_quantity * 60 AS int)) END AS end_time FROM {lineitem}",
)
_NOW = "2030-01-01 00:00:00"
SQL_DURATIONS = f"""SELECT *, (epoch_us(coalesce(end_time, timestamp '{_NOW}')) - epoch_us(start_time)) / 1e6 AS seconds FROM {{phase_steps}} s"""


def durations_of(t):
    return metrics.phase_durations(t.phase_steps, F.lit(_NOW).cast("timestamp_ntz"))


@query("phase_durations", SQL_DURATIONS)
def phase_durations(t):
    return durations_of(t)


@query("phase_duration_histogram", f"""
SELECT phase, round(sum(seconds), 3) AS "sum", count(*) AS "count", le, count(*) FILTER (seconds <= edge) AS bucket_count
FROM ({SQL_DURATIONS}) c, {sql_buckets('phase')} GROUP BY phase, le""")
def phase_duration_histogram(t):
    hist = metrics.histogram(durations_of(t), metrics.BUCKETS["phase"], ["phase"], "seconds")
    return metrics.histogram_rows(hist, metrics.BUCKETS["phase"], ["phase"]).withColumn("sum", F.round("sum", 3))


# Traced calls: tool, model and chain runs with the event's properties as metadata.
_TRACES = """
SELECT event_id AS run_id, CASE event_type WHEN 'view' THEN 'llm' WHEN 'click' THEN 'chain' ELSE 'tool' END AS run_type, event_type,
       {tags} AS base_tags, CASE WHEN event_type = 'signup' THEN value > 5 WHEN event_type = 'purchase' THEN NULL ELSE true END AS success,
       CASE WHEN event_type = 'error' THEN 'boom' END AS error, {meta} AS metadata,
       CASE WHEN value > 20 THEN cast(floor(value) AS bigint) END AS tokens_input, CASE WHEN value > 10 THEN cast(floor(value * 2) AS bigint) END AS tokens_output
FROM {{events}}"""
FIXTURES["traces"] = (
    _TRACES.format(tags="array('run', event_type)", meta="map('user', cast(user_id AS string), 'duration_seconds', '1.5', 'k', get_json_object(props, '$.k'))"),
    _TRACES.format(tags="['run', event_type]", meta="['user=' || user_id, 'k=' || coalesce(json_extract_string(props, '$.k'), 'None')]"),
)


@query("trace_runs", """
SELECT run_id, run_type, array_to_string(list_concat(list_concat(base_tags, CASE WHEN error IS NOT NULL THEN ['error']
  WHEN run_type = 'tool' AND success IS NOT NULL THEN [CASE WHEN success THEN 'success' ELSE 'failure' END] ELSE [] END), metadata), ',') AS tags,
  CASE WHEN run_type = 'llm' AND error IS NULL THEN coalesce(tokens_input, 0) END AS tokens_input,
  CASE WHEN run_type = 'llm' AND error IS NULL THEN coalesce(tokens_output, 0) END AS tokens_output,
  CASE WHEN error IS NOT NULL THEN 'error' WHEN run_type = 'tool' AND success = false THEN 'failure' ELSE 'success' END AS outcome FROM {traces} t""")
def trace_runs(t):
    return metrics.trace_runs(t.traces).withColumn("tags", F.array_join("tags", ","))


FIXTURES["job_states"] = """
SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'DONE' ELSE CASE WHEN o_totalprice > 200000 THEN 'ABORTED'
       WHEN o_totalprice > 100000 THEN 'PAUSED' ELSE 'ROLLED_BACK' END END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Discover' WHEN '2-HIGH' THEN 'Plan' WHEN '3-MEDIUM' THEN 'Validate' WHEN '5-LOW' THEN 'Done' ELSE 'Generate' END AS phase
FROM {orders}"""


@query("job_status_codes", """
SELECT *, CASE status WHEN 'PAUSED' THEN 0 WHEN 'RUNNING' THEN 1 WHEN 'DONE' THEN 2 WHEN 'ABORTED' THEN 3 END AS status_code,
       CASE phase WHEN 'Discover' THEN 0 WHEN 'Plan' THEN 1 WHEN 'Validate' THEN 4 WHEN 'Done' THEN 7 END AS phase_index FROM {job_states} j""")
def job_status_codes(t):
    return metrics.job_status_codes(t.job_states)


# Pod lists as stored text, one per order: two pods, the second sometimes without any status.
FIXTURES["pod_lists"] = """
SELECT o_orderkey AS snapshot_id, concat('{{"items":[{{"metadata":{{"name":"pod-', o_orderkey, '-a"}},"status":{{"phase":"Running","conditions":[',
  '{{"type":"Initialized","status":"True"}},{{"type":"Ready","status":"', CASE WHEN o_orderstatus = 'F' THEN 'False' ELSE 'True' END, '"}}],',
  '"containerStatuses":[{{"restartCount":9}},{{"restartCount":', o_custkey % 5, '}}]}}}},{{"metadata":{{"name":"pod-', o_orderkey, '-b"}}',
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"status":{{"phase":"Pending"}}' END, '}}]}}') AS body FROM {orders}"""
FIXTURES["deployment_texts"] = """
SELECT o_orderkey AS snapshot_id, o_totalprice > 100000 AS database_ok, concat('{{"metadata":{{"name":"app-', o_custkey, '","namespace":"ns"',
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat(',"generation":', o_orderkey % 9) END, '}},"spec":{{"replicas":', o_custkey % 4,
  ',"template":{{"spec":{{"containers":[', CASE WHEN o_orderstatus = 'F' THEN '' ELSE '{{"image":"app:1"}},{{"image":"side:2"}}' END, ']}}}}}},"status":{{',
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('"readyReplicas":', o_orderkey % 4, ',"availableReplicas":2,"conditions":[{{"type":"Available","status":"True"}}]') END,
  '}}}}') AS body FROM {orders}"""


@query("pods_flat", """
SELECT snapshot_id, json_extract_string(p, '$.metadata.name') AS name, json_extract_string(p, '$.status.phase') AS phase,
       coalesce(json_extract_string(p, '$.status.conditions[1].status') = 'True', false) AS ready,
       coalesce(cast(json_extract_string(p, '$.status.containerStatuses[1].restartCount') AS bigint), 0) AS restart_count
FROM (SELECT snapshot_id, unnest(json_extract(body, '$.items[*]')) AS p FROM {pod_lists} l) x""")
def pods_flat(t):
    return cluster.pods_flat(t.pod_lists)


SQL_DEPLOYMENTS = """
SELECT snapshot_id, database_ok, json_extract_string(body, '$.metadata.name') AS name, json_extract_string(body, '$.metadata.namespace') AS namespace,
       coalesce(cast(json_extract_string(body, '$.status.readyReplicas') AS bigint), 0) AS ready_replicas,
       coalesce(cast(json_extract_string(body, '$.spec.replicas') AS bigint), 0) AS desired_replicas,
       coalesce(cast(json_extract_string(body, '$.status.availableReplicas') AS bigint), 0) AS available_replicas,
       coalesce(cast(json_extract_string(body, '$.status.updatedReplicas') AS bigint), 0) AS updated_replicas,
       coalesce(cast(json_extract_string(body, '$.metadata.generation') AS bigint), 0) AS revision,
       coalesce(json_extract_string(body, '$.spec.template.spec.containers[0].image'), '') AS image,
       coalesce(json_array_length(body, '$.status.conditions'), 0) AS conditions FROM {deployment_texts} d"""


def deployments_of(t):
    return cluster.deployments_flat(t.deployment_texts).withColumn("conditions", F.size("conditions"))


@query("deployments_flat", SQL_DEPLOYMENTS)
def deployments_flat(t):
    return deployments_of(t)


@query("health_class", f"""
SELECT *, CASE WHEN ready_replicas >= desired_replicas AND desired_replicas > 0 THEN CASE WHEN database_ok THEN 'HEALTHY' ELSE 'DEGRADED' END
       ELSE 'UNHEALTHY' END AS health FROM ({SQL_DEPLOYMENTS}) d""")
def health_class(t):
    return cluster.health_class(deployments_of(t))
