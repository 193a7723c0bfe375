"""Counters, gauges, histograms and what is computed from them, over event rows.

Every function takes one row per call or observation. An increase is a sum inside a window and a
rate is that sum per second: there are no counter resets and no extrapolation at window edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ordering import RANGE, in_ranges, join_groups, running

# Histogram bucket edges in seconds, prices per 1,000 tokens, and the guard against division by zero.
BUCKETS = {
    "checksum": (1, 5, 10, 30, 60, 120, 300),
    "phase": (5, 30, 60, 300, 900, 3600),
    "agent": (0.1, 0.5, 1, 5, 10, 30, 60, 300),
    "tool": (0.5, 1, 5, 10, 30, 60, 120, 300, 600),
    "rollout": (10, 30, 60, 120, 300, 600),
    "llm": (0.5, 1, 2, 5, 10, 30, 60),
}
PRICE_IN, PRICE_OUT = 0.0003, 0.0006
GUARD = 0.0001
JOB_STATUS = {"PAUSED": 0, "RUNNING": 1, "DONE": 2, "ABORTED": 3}
JOB_PHASE = {"Discover": 0, "Plan": 1, "Translate": 2, "Migrate": 3, "Validate": 4, "Test": 5, "Cutover": 6, "Done": 7}


def windowed_sums(
    events: DataFrame, length: str, labels: Sequence[str], sums: dict[str, Column], slide: str | None = None
) -> DataFrame:
    """Sums per window and labels; windows align to the epoch.

    Sliding windows are built from panes of the slide's width: events are first summed per pane
    (combined map-side), and only the few pane sums are copied into the windows they belong to.
    ``length`` must be a multiple of ``slide``.
    """
    step = slide or length
    panes = events.groupBy(F.window("ts", step).alias("_w"), *labels).agg(*[c.alias(n) for n, c in sums.items()])
    if step != length:
        panes = (
            panes.withColumn("_at", F.col("_w.start"))
            .groupBy(F.window("_at", length, step).alias("_w"), *labels)
            .agg(*[F.sum(n).alias(n) for n in sums])
        )
    return panes.select(F.col("_w.start").alias("window_start"), *labels, *sums)


def seconds_of(length: str) -> float:
    """Seconds of an interval text such as ``5 minutes``."""
    number, unit = length.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def counter_increase(
    events: DataFrame, length: str, labels: Sequence[str], slide: str | None = None, amount: Column | None = None
) -> DataFrame:
    total = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return windowed_sums(events, length, labels, {"increase": total}, slide)


def counter_rate(
    events: DataFrame, length: str, labels: Sequence[str], slide: str | None = None, amount: Column | None = None
) -> DataFrame:
    """Increase per second."""
    found = counter_increase(events, length, labels, slide, amount)
    return found.withColumn("rate", F.col("increase") / F.lit(seconds_of(length))).drop("increase")


def gauge_last(events: DataFrame, labels: Sequence[str], value: str = "value", order: Sequence[str] = ("ts",)) -> DataFrame:
    """The value set last per label set."""
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias(value))


def histogram(events: DataFrame, buckets: Sequence[float], labels: Sequence[str], value: str = "value") -> DataFrame:
    """Cumulative bucket counts per label set as an array (the last is +Inf), with sum and count."""
    v = F.col(value)
    counts = [F.count_if(v <= F.lit(float(b))) for b in buckets] + [F.count(v)]
    return events.groupBy(*labels).agg(
        F.array(*counts).alias("cumulative"), F.sum(v).alias("sum"), F.count(v).alias("count")
    )


def histogram_rows(hist: DataFrame, buckets: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """One row per label set and bucket edge."""
    edges = F.array(*[F.lit(f"{b:g}") for b in buckets], F.lit("+Inf"))
    return hist.select(*labels, "sum", "count", F.inline(F.arrays_zip(edges.alias("le"), F.col("cumulative").alias("bucket_count"))))


def histogram_quantile(q: float, buckets: Sequence[float], cumulative: str = "cumulative") -> Column:
    """Quantile by linear interpolation inside its bucket.

    The first bucket starts at zero; a rank in the +Inf bucket gives the greatest finite edge; no
    observations give NULL.
    """
    cum = F.col(cumulative)
    edges = F.array(*[F.lit(float(b)) for b in buckets])
    rank = F.lit(float(q)) * F.element_at(cum, -1)
    at = F.array_position(F.transform(cum, lambda c: c >= rank), True).cast("int")
    upper = F.get(edges, at - 1)
    lower = F.coalesce(F.get(edges, at - 2), F.lit(0.0))
    before = F.coalesce(F.get(cum, at - 2), F.lit(0))
    inside = F.get(cum, at - 1) - before
    share = F.when(inside > 0, (rank - before) / inside).otherwise(0.0)
    return (
        F.when(F.element_at(cum, -1) == 0, F.lit(None).cast("double"))
        .when(at > len(buckets), F.lit(float(buckets[-1])))
        .otherwise(lower + (upper - lower) * share)
    )


def quantiles(
    events: DataFrame, buckets: Sequence[float], labels: Sequence[str], qs: Sequence[float] = (0.5, 0.95, 0.99), value: str = "value"
) -> DataFrame:
    """p50/p95/p99 per label set from the histogram."""
    hist = histogram(events, buckets, labels, value)
    return hist.select(*labels, "count", *[histogram_quantile(q, buckets).alias(f"p{q * 100:g}") for q in qs])


def windowed_quantiles(
    events: DataFrame, length: str, buckets: Sequence[float], labels: Sequence[str], qs: Sequence[float] = (0.5, 0.95, 0.99),
    value: str = "value", slide: str | None = None,
) -> DataFrame:
    """Quantiles per window; bucket counts are pane sums, so sliding costs no second look at the events."""
    v = F.col(value)
    names = [f"_b{i}" for i in range(len(buckets))] + ["count"]
    sums = {n: F.count_if(v <= F.lit(float(b))) for n, b in zip(names, buckets)} | {"count": F.count(v)}
    found = windowed_sums(events, length, labels, sums, slide).withColumn("cumulative", F.array(*names))
    return found.select("window_start", *labels, "count", *[histogram_quantile(q, buckets).alias(f"p{q * 100:g}") for q in qs])


def exact_quantiles(
    events: DataFrame, labels: Sequence[str], qs: Sequence[float] = (0.5, 0.95, 0.99), value: str = "value", ranges: int | None = None
) -> DataFrame:
    """The true quantiles, for comparison with the histogram's.

    Equal values are counted before they are shuffled, so a value on most of the rows is one row per task. The counts are
    summed up in order over ranges of (labels, value), and each quantile picks the one or two values whose counts reach it.
    """
    labels = list(labels)
    counts = events.filter(F.col(value).isNotNull()).groupBy(*labels, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = in_ranges(counts, labels, [value], ranges)
    cuts = ranged.groupBy(*labels, RANGE).agg(F.sum("_n").alias("_part"))
    totals = cuts.select(*labels, RANGE, F.sum("_part").over(Window.partitionBy(*labels)).alias("_total"))
    placed = join_groups(running(ranged, labels, [value], F.col("_n"), "_upto"), totals, [*labels, RANGE])

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n")), F.col(value)))

    out = []
    for q in qs:
        spot = (F.col("_total") - 1) * F.lit(float(q)) + 1
        low, high, share = at_rank(F.floor(spot)), at_rank(F.ceil(spot)), F.max(spot - F.floor(spot))
        out.append(F.when(share == 0, low).otherwise(low * (1 - share) + high * share).cast("double").alias(f"p{q * 100:g}"))
    return placed.groupBy(*labels).agg(*out)


def success_rate(events: DataFrame, length: str, labels: Sequence[str], ok: Column, slide: str | None = None) -> DataFrame:
    """Successes in percent of all calls; the guard on per-second rates keeps it below 100.

    ``exact_rate`` is the same without the guard.
    """
    found = windowed_sums(events, length, labels, {"ok": F.count_if(ok), "total": F.count(F.lit(1))}, slide)
    seconds = F.lit(seconds_of(length))
    return found.withColumn(
        "success_rate", F.lit(100.0) * (F.col("ok") / seconds) / (F.col("total") / seconds + F.lit(GUARD))
    ).withColumn("exact_rate", F.lit(100.0) * F.col("ok") / F.col("total"))


def llm_cost(calls: DataFrame, length: str, labels: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Cost of tokens per window; negative counts are not tokens."""
    counted = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c)).otherwise(0))
    found = windowed_sums(
        calls, length, labels, {"tokens_input": counted("tokens_input"), "tokens_output": counted("tokens_output")}, slide
    )
    cost = (F.col("tokens_input") * F.lit(PRICE_IN) + F.col("tokens_output") * F.lit(PRICE_OUT)) / 1000
    return found.withColumn("cost", cost)


def failures_by_reason(events: DataFrame, length: str, labels: Sequence[str], reason: str, slide: str | None = None) -> DataFrame:
    """Failures per window and reason; a missing reason reads ``unknown``."""
    named = events.withColumn("reason", F.when(F.coalesce(F.col(reason), F.lit("")) == "", "unknown").otherwise(F.col(reason)))
    return counter_increase(named, length, [*labels, "reason"], slide)


def throughput(loads: DataFrame, phases: DataFrame | None = None) -> DataFrame:
    """Rows per second of each table's load over the whole phase of its job (0 when the phase took no time or has none).

    ``phases`` (job_id, phase_seconds, one row a job) tells how long each job's phase took on the clock, as tables load side by side;
    without it the phase counts as the sum of its tables' seconds.
    """
    if phases is None:
        phases = loads.groupBy("job_id").agg(F.sum("duration_seconds").alias("phase_seconds"))
    rows = F.coalesce("target_row_count", F.lit(0))
    return loads.join(phases.select("job_id", "phase_seconds"), "job_id", "left").withColumn(
        "rows_per_second", F.when(F.col("phase_seconds") > 0, rows / F.col("phase_seconds")).otherwise(0.0)
    )


def availability(gauges: DataFrame, labels: Sequence[str], order: Sequence[str] = ("ts",)) -> DataFrame:
    """Available in percent of desired replicas, from the last value of both gauges; one pass, no join."""

    def last(metric: str) -> Column:
        mine = F.col("metric") == metric
        return F.max_by(F.when(mine, F.col("value")), F.when(mine, F.struct(*order)))

    both = gauges.groupBy(*labels).agg(last("pod_available_replicas").alias("available"), last("pod_desired_replicas").alias("desired"))
    return both.filter(F.col("available").isNotNull() & F.col("desired").isNotNull()).withColumn(
        "availability", F.lit(100.0) * F.col("available") / (F.col("desired") + F.lit(GUARD))
    )


def sum_by(gauges: DataFrame, labels: Sequence[str], by: Sequence[str], order: Sequence[str] = ("ts",)) -> DataFrame:
    """Sum of the last values of a gauge over the label sets that share ``by``."""
    return gauge_last(gauges, labels, "value", order).groupBy(*by).agg(F.sum("value").alias("value"))


def retry_stats(history: DataFrame) -> DataFrame:
    """Attempts, successes and failures of retries per job, phase and dialect pair."""
    return history.groupBy("job_id", "phase", "source_dialect", "target_dialect").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == "SUCCESS").alias("successes"),
        F.count_if(F.col("status") != "SUCCESS").alias("failures"),
    )


def phase_durations(steps: DataFrame, now: Column) -> DataFrame:
    """Seconds each step took; a step that still runs is measured up to ``now``."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    end = F.coalesce(F.col("end_time"), now)
    return steps.withColumn("seconds", (micros(end) - micros(F.col("start_time"))) / F.lit(1e6))


def trace_runs(calls: DataFrame) -> DataFrame:
    """Tags, tokens and outcome of traced calls.

    Tags are the base tags, the outcome, and ``key=value`` of the metadata without the duration. A tool
    that returns a result says success or failure; whatever raises says error.
    """
    failed = F.col("error").isNotNull()
    tool = (F.col("run_type") == "tool") & ~failed & F.col("success").isNotNull()
    outcome = (
        F.when(failed, F.array(F.lit("error")))
        .when(tool, F.array(F.when(F.col("success"), "success").otherwise("failure")))
        .otherwise(F.array().cast("array<string>"))
    )
    told = F.map_filter(F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")), lambda k, v: k != "duration_seconds")
    pairs = F.transform(F.map_entries(told), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    model = (F.col("run_type") == "llm") & ~failed
    tokens = lambda c: F.when(model, F.coalesce(F.col(c), F.lit(0)))
    return calls.select(
        "run_id", "run_type", F.concat("base_tags", outcome, pairs).alias("tags"),
        tokens("tokens_input").alias("tokens_input"), tokens("tokens_output").alias("tokens_output"),
        F.when(failed, "error").when(tool & ~F.col("success"), "failure").otherwise("success").alias("outcome"),
    )


def _code(column: Column, codes: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[column]


def job_status_codes(jobs: DataFrame) -> DataFrame:
    """Status and phase as the numbers a gauge carries; NULL for names without a number."""
    return jobs.withColumn("status_code", _code(F.col("status"), JOB_STATUS)).withColumn(
        "phase_index", _code(F.col("phase"), JOB_PHASE)
    )
