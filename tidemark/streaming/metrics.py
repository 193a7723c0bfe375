"""Counters, rates, costs and histograms over event streams.

State is bounded by the watermark: a window is emitted once the watermark passes its end, then dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.metrics import GUARD, PRICE_IN, PRICE_OUT, histogram_quantile, seconds_of
from tidemark.sources import versioned
from tidemark.sources.versioned import BUCKET


def stream_sums(
    events: DataFrame, length: str, labels: Sequence[str], sums: dict[str, Column], delay: str | None, slide: str | None = None
) -> DataFrame:
    """Sums per window and labels; tasks combine their rows before the shuffle, so a hot label is no burden.

    ``delay=None`` keeps a watermark the caller has set, say before filtering.
    """
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    marked = events if delay is None else events.withWatermark("ts", delay)
    grouped = marked.groupBy(window.alias("_w"), *labels).agg(*[c.alias(n) for n, c in sums.items()])
    return grouped.select(F.col("_w.start").alias("window_start"), *labels, *sums)


def stream_increase(
    events: DataFrame, length: str, labels: Sequence[str], delay: str | None, slide: str | None = None, amount: Column | None = None
) -> DataFrame:
    total = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return stream_sums(events, length, labels, {"increase": total}, delay, slide)


def stream_rate(events: DataFrame, length: str, labels: Sequence[str], delay: str | None, slide: str | None = None) -> DataFrame:
    found = stream_increase(events, length, labels, delay, slide)
    return found.withColumn("rate", F.col("increase") / F.lit(seconds_of(length))).drop("increase")


def stream_success_rate(
    events: DataFrame, length: str, labels: Sequence[str], ok: Column, delay: str | None, slide: str | None = None
) -> DataFrame:
    found = stream_sums(events, length, labels, {"ok": F.count_if(ok), "total": F.count(F.lit(1))}, delay, slide)
    seconds = F.lit(seconds_of(length))
    rate = F.lit(100.0) * (F.col("ok") / seconds) / (F.col("total") / seconds + F.lit(GUARD))
    return found.withColumn("success_rate", rate)


def stream_cost(calls: DataFrame, length: str, labels: Sequence[str], delay: str | None, slide: str | None = None) -> DataFrame:
    counted = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c)).otherwise(0))
    found = stream_sums(
        calls, length, labels, {"tokens_input": counted("tokens_input"), "tokens_output": counted("tokens_output")}, delay, slide
    )
    return found.withColumn("cost", (F.col("tokens_input") * F.lit(PRICE_IN) + F.col("tokens_output") * F.lit(PRICE_OUT)) / 1000)


def stream_failures(events: DataFrame, length: str, labels: Sequence[str], reason: str, delay: str | None, slide: str | None = None) -> DataFrame:
    named = events.withColumn("reason", F.when(F.coalesce(F.col(reason), F.lit("")) == "", "unknown").otherwise(F.col(reason)))
    return stream_increase(named, length, [*labels, "reason"], delay, slide)


def stream_quantiles(
    events: DataFrame, length: str, buckets: Sequence[float], labels: Sequence[str], delay: str | None,
    qs: Sequence[float] = (0.5, 0.95, 0.99), value: str = "value",
) -> DataFrame:
    """Quantiles per window from bucket counts."""
    v = F.col(value)
    names = [f"_b{i}" for i in range(len(buckets))] + ["count"]
    sums = {n: F.count_if(v <= F.lit(float(b))) for n, b in zip(names, buckets)} | {"count": F.count(v)}
    found = stream_sums(events, length, labels, sums, delay).withColumn("cumulative", F.array(*names))
    return found.select("window_start", *labels, "count", *[histogram_quantile(q, buckets).alias(f"p{q * 100:g}") for q in qs])


def last_gauges(labels: Sequence[str], value: str = "value", order: Sequence[str] = ("ts",)):
    """A fold to the last value per label set."""

    def fold(rows: DataFrame) -> DataFrame:
        keys = [*([BUCKET] if BUCKET in rows.columns else []), *labels]
        last = F.max_by(F.struct(value, *order), F.struct(*order)).alias("_l")
        return rows.groupBy(*keys).agg(last).select(*keys, "_l.*").select(*rows.columns)

    return fold


def keep_gauges(path: str, labels: Sequence[str], value: str = "value", order: Sequence[str] = ("ts",), buckets: int = 64):
    """A micro-batch handler that adds a batch's last value per label set to a store; replaying a batch changes nothing."""
    fold = last_gauges(labels, value, order)

    def handle(batch: DataFrame, _batch_id: int) -> None:
        versioned.append(fold(batch.select(*labels, value, *order)), path, labels, fold, buckets)

    return handle


def read_gauges(spark: SparkSession, path: str, labels: Sequence[str], value: str = "value", order: Sequence[str] = ("ts",)) -> DataFrame:
    """The last value per label set, by time and not by arrival."""
    return versioned.current(spark, path, last_gauges(labels, value, order))
