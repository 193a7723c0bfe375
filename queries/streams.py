"""The same operators on streams; their results must equal the batch on closed windows."""

from pyspark.sql import functions as F

from queries import metrics as m
from queries import progress as p
from queries.base import FIXTURES, query
from tidemark.operators import metrics
from tidemark.session import scratch_path
from tidemark.sources import stores
from tidemark.streaming import changes, metrics as sm, progress as sp
from tidemark.streaming.sources import parquet_stream, run_batches, run_to_files


def events_stream(t):
    return parquet_stream(t.spark, t.sf_dir, t.events.schema, "events.parquet")


def derived(t, name: str):
    """The same derivation as the batch input, on the stream."""
    text = FIXTURES[name].replace("{events}", "{stream}")
    return t.spark.sql(text, stream=events_stream(t))


def dealt(t, name: str, files: int = 10):
    """The derivation on a stream of several micro-batches: events dealt to files by hash, so that most come out of order."""
    folder = scratch_path(t.spark, "dealt")
    t.events.repartitionByRange(files, F.xxhash64("event_id")).write.parquet(folder)
    text = FIXTURES[name].replace("{events}", "{stream}")
    return t.spark.sql(text, stream=parquet_stream(t.spark, folder, t.events.schema, files_per_batch=1))


def to_files(t, stream):
    base = scratch_path(t.spark, "stream")
    found = run_to_files(stream, f"{base}/out", f"{base}/checkpoint")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) if "window_start" in found.columns else found


def closed(sql: str, length: int, delay: int) -> str:
    """Only windows the watermark has passed."""
    return f"SELECT * FROM ({sql}) z WHERE epoch_ms(window_start) + {length * 1000} <= (SELECT epoch_ms(max(ts)) FROM events) - {delay * 1000}"


@query("stream_increase", closed(m.sql_windows("{calls}", 300, 300, "tool_name", "count(*) AS increase"), 300, 600))
def stream_increase(t):
    return to_files(t, sm.stream_increase(derived(t, "calls"), "5 minutes", ["tool_name"], "10 minutes"))


@query("stream_rate_sliding", closed("SELECT window_start, tool_name, increase / 300.0 AS rate FROM ("
       + m.sql_windows("{calls}", 300, 60, "tool_name", "count(*) AS increase") + ") x", 300, 600))
def stream_rate_sliding(t):
    return to_files(t, sm.stream_rate(derived(t, "calls"), "5 minutes", ["tool_name"], "10 minutes", "1 minute"))


@query("stream_success_rate", closed("SELECT window_start, job_id, ok, total, round(100.0 * (ok / 3600.0) / (total / 3600.0 + 0.0001), 6) AS success_rate FROM ("
       + m.sql_windows("{calls}", 3600, 3600, "job_id", "count(*) FILTER (ok) AS ok, count(*) AS total") + ") x", 3600, 600))
def stream_success_rate(t):
    found = sm.stream_success_rate(derived(t, "calls"), "1 hour", ["job_id"], F.col("ok"), "10 minutes")
    return to_files(t, found).withColumn("success_rate", F.round("success_rate", 6))


@query("stream_cost", closed("SELECT *, round((tokens_input * 0.0003 + tokens_output * 0.0006) / 1000, 9) AS cost FROM ("
       + m.sql_windows("{calls}", 3600, 3600, "tool_name", "cast(sum(greatest(tokens_input, 0)) AS bigint) AS tokens_input, "
                       "cast(sum(greatest(tokens_output, 0)) AS bigint) AS tokens_output") + ") x", 3600, 600))
def stream_cost(t):
    return to_files(t, sm.stream_cost(derived(t, "calls"), "1 hour", ["tool_name"], "10 minutes")).withColumn("cost", F.round("cost", 9))


@query("stream_failures", closed(m.sql_windows("(SELECT *, coalesce(error_type, 'unknown') AS reason FROM {calls} c WHERE NOT ok)", 86400, 86400, "job_id, reason", "count(*) AS increase"), 86400, 600))
def stream_failures(t):
    # The watermark follows all calls, so it is set before the successes are left out.
    calls = derived(t, "calls").withWatermark("ts", "10 minutes").filter(~F.col("ok"))
    return to_files(t, sm.stream_failures(calls, "24 hours", ["job_id"], "error_type", delay=None))


@query("stream_quantiles", "SELECT window_start, tool_name, \"count\", p50, p95, p99 FROM (" + closed(m.sql_quantiles("agent", f"""
SELECT make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) AS window_start, tool_name, i, edge, count(*) FILTER (seconds <= edge) AS cum, count(*) AS total
FROM {{calls}} c, {m.sql_buckets('agent')} GROUP BY ALL""", "window_start, tool_name"), 3600, 600) + ") y")
def stream_quantiles(t):
    found = sm.stream_quantiles(derived(t, "calls"), "1 hour", metrics.BUCKETS["agent"], ["tool_name"], "10 minutes", value="seconds")
    return m.rounded(to_files(t, found))


@query("stream_gauges", """SELECT deployment_name, namespace, cluster_name, metric, arg_max(value, (ts, event_id)) AS value FROM {gauges} g GROUP BY ALL""")
def stream_gauges(t):
    base = scratch_path(t.spark, "gauges")
    labels = ["deployment_name", "namespace", "cluster_name", "metric"]
    run_batches(dealt(t, "gauges"), sm.keep_gauges(f"{base}/store", labels, order=("ts", "event_id")), f"{base}/checkpoint")
    return sm.read_gauges(t.spark, f"{base}/store", labels, order=("ts", "event_id")).select(*labels, "value")


@query("stream_status_changes", p.SQL_CHANGES)
def stream_status_changes(t):
    base = scratch_path(t.spark, "feed")
    run_batches(derived(t, "snapshots"), sp.feed_changes(f"{base}/out", f"{base}/state", ["status", "phase"]), f"{base}/checkpoint")
    found = t.spark.read.parquet(f"{base}/out").select("job_id", "ts", "seq", "status", "phase")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_upsert_jobs", """
SELECT job_id, arg_min(name, (ts, seq)) AS name, arg_min(source_dialect, (ts, seq)) AS source_dialect, arg_min(target_dialect, (ts, seq)) AS target_dialect,
       arg_max(status, (ts, seq)) AS status, min(ts) AS created_at, max(ts) AS updated_at FROM {job_events} e GROUP BY job_id""")
def stream_upsert_jobs(t):
    base = scratch_path(t.spark, "jobs")
    run_batches(dealt(t, "job_events"), sp.keep_jobs(f"{base}/store"), f"{base}/checkpoint")
    found = stores.read_jobs(t.spark, f"{base}/store")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


# Changes of user profiles: purchases and clicks write, errors delete.
FIXTURES["profile_changes"] = """
SELECT user_id, CASE WHEN event_type = 'error' THEN 'D' WHEN event_type = 'signup' THEN 'I' ELSE 'U' END AS op, ts, event_id AS seq, value AS balance, props AS note FROM {events}"""
SQL_PROFILES = """SELECT user_id, balance, note FROM (SELECT user_id, arg_max(struct_pack(op := op, balance := balance, note := note), (ts, seq)) AS c
FROM {profile_changes} p GROUP BY user_id) x, LATERAL (SELECT c.op AS op, c.balance AS balance, c.note AS note) y WHERE op <> 'D'"""


@query("stream_apply_changes", SQL_PROFILES)
def stream_apply_changes(t):
    base = scratch_path(t.spark, "cdc")
    return changes.apply_change_stream(dealt(t, "profile_changes"), f"{base}/store", ["user_id"], f"{base}/checkpoint")


@query("incremental_load", "SELECT count(*) AS events, cast(sum(event_id) AS bigint) AS id_sum FROM events")
def incremental_load(t):
    base = scratch_path(t.spark, "incremental")
    for _ in range(2):
        # The second run finds nothing new and must add nothing.
        loaded = changes.incremental_load(events_stream(t), f"{base}/out", f"{base}/checkpoint")
    return loaded.agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("id_sum"))
