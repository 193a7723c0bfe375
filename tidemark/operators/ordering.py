"""Numbering and look-back inside groups of any size.

Rows are range-partitioned by key and order, so a large key is spread over as many ranges as it needs and no
key has to be known beforehand. Each range is worked off by itself; what a key brings along from earlier
ranges (a count, a last value) is found by a scan over one row per key and range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from tidemark.functions.canonical import holds_map
from tidemark.session import cut_lineage, spent_shuffles

RANGE, TIE = "_range", "_tie"


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with facts about their group; rows whose key is NULL belong to a group as well."""
    renamed = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(renamed, same, how).drop(*[f"_g_{k}" for k in keys])


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Rows in ranges (``_range``) that follow the keys and then the order.

    Equal places in the order are told apart by a hash of the other columns (``_tie``), so many rows with the same
    key and time spread as well; only rows equal in every column share a range. The ranges are checkpointed
    because they must not be drawn anew when a stage is repeated. ``ranges`` fixes their number; else it is
    the session's, and AQE joins neighbouring small ones. Rows that bring their own ``_tie`` keep it.
    """
    hashed = [F.col(f"`{f.name}`") for f in df.schema if not holds_map(f.dataType) and not isinstance(f.dataType, T.VariantType)]
    told = df if TIE in df.columns else df.withColumn(TIE, F.xxhash64(*hashed))
    by = [*keys, *order, TIE]
    cut = told.repartitionByRange(*by) if ranges is None else told.repartitionByRange(ranges, *by)
    with spent_shuffles(df.sparkSession):
        return cut_lineage(cut.withColumn(RANGE, F.spark_partition_id()))


def inside(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The rows of a key within one range, in order."""
    return Window.partitionBy(*keys, RANGE).orderBy(*order, TIE)


def earlier(keys: Sequence[str]) -> WindowSpec:
    """Over one row per key and range: all ranges before this one."""
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def carry_over(rows: DataFrame, keys: Sequence[str], partial: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """Add to each row what its key brings along from earlier ranges; NULL for keys that begin in the row's range.

    ``partial`` are aggregates per key and range, ``carried`` window expressions over them (see ``earlier``). Only the
    first key of a range can have rows in an earlier one, so at most one row per range is broadcast.
    """
    facts = rows.groupBy(*keys, RANGE).agg(*[c.alias(n) for n, c in partial.items()])
    brought = facts.select(
        *keys, RANGE, *[c.alias(n) for n, c in carried.items()], F.count(F.lit(1)).over(earlier(keys)).alias("_ranges_before")
    ).filter(F.col("_ranges_before") > 0)
    return join_groups(rows, F.broadcast(brought.drop("_ranges_before")), [*keys, RANGE], "left")


def running(ranged: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` up to and including each row, over rows from ``in_ranges``."""
    upto = inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    placed = carry_over(
        ranged, keys, {"_sum": F.sum(amount)}, {"_shift": F.sum("_sum").over(earlier(keys))}
    ).withColumn("_own", F.sum(amount).over(upto))
    return placed.withColumn(name, (F.col("_own") + F.coalesce("_shift", F.lit(0))).cast("bigint")).drop("_own", "_shift")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, ranges: int | None = None
) -> DataFrame:
    """``row_number`` from 1 per key, without bringing a large key into one task."""
    return running(in_ranges(df, keys, order, ranges), keys, order, F.lit(1), name).drop(RANGE, TIE)


def text_parts(
    df: DataFrame, keys: Sequence[str], position: str, text: str, separator: str, size: int = 1000
) -> DataFrame:
    """Join texts in order into parts of at most ``size`` positions: key, ``part_no``, ``text``.

    ``position`` numbers the rows of a key, so a part never holds more than ``size`` rows however
    large the key is; the parts of a key in order give the whole text.
    """
    item = F.struct(F.col(position).alias("p"), F.col(text).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), separator)
    part = F.floor((F.col(position) - 1) / size).cast("bigint")
    return df.groupBy(*keys, part.alias("part_no")).agg(joined.alias("text"))
