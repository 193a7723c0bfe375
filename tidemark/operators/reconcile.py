"""Compare a loaded table with its source: counts, fingerprints, reports and keyed differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.canonical import canonical, row_bits, row_text
from tidemark.operators.fingerprint import group_fingerprints, table_fingerprint

# Statuses of the validation report.
MATCH, MISMATCH, ERROR = "MATCH", "MISMATCH", "ERROR"
OBJECT_OK = ("PRESENT", "PENDING_MANUAL_REVIEW")
DIGEST_WIDTH = 16
# Types whose least and greatest values are compared; nested ones and variants have no order or none that a database shares.
PLAIN = (T.NumericType, T.StringType, T.CharType, T.VarcharType, T.BooleanType, T.BinaryType, T.DatetimeType)
NOTE = "Row counts match but the contents differ; check collation and precision before trusting the copy"


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def align_columns(src: DataFrame, tgt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Same columns, same order, same types on both sides; names are matched without regard to case.

    A date against a timestamp is compared as a timestamp, because one side may carry a time of day.
    """
    there = {n.lower(): n for n in tgt.columns}
    here = {n.lower(): n for n in src.columns}
    if set(there) != set(here):
        only = sorted(set(there) ^ set(here))
        raise ValueError(f"columns present on one side only: {only}")
    left, right = [], []
    for key, name in here.items():
        a, b = src.schema[name].dataType, tgt.schema[there[key]].dataType
        clock = (T.DateType, T.TimestampType, T.TimestampNTZType)
        mixed = isinstance(a, clock) and isinstance(b, clock) and a != b
        cast = (lambda c: c.cast("timestamp_ntz")) if mixed else (lambda c: c)
        left.append(cast(src[f"`{name}`"]).alias(key))
        right.append(cast(tgt[f"`{there[key]}`"]).alias(key))
    return src.select(*left), tgt.select(*right)


def row_counts(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows on both sides per table; Parquet answers from footers."""
    sides = []
    for name, (src, tgt) in pairs.items():
        for side, df in (("source", src), ("target", tgt)):
            sides.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n"))
    return _sides_to_columns(union_all(sides), {"n": "row_count"}).withColumn(
        "row_count_match", F.col("row_count_source") == F.col("row_count_target")
    )


def _sides_to_columns(tall: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Two rows per table (source, target) to one; groups instead of a join of the two aggregates."""
    pick = [
        F.max(F.when(F.col("side") == side, F.col(col))).alias(f"{out}_{side}")
        for col, out in values.items()
        for side in ("source", "target")
    ]
    return tall.groupBy("table_name").agg(*pick)


def _judge(wide: DataFrame) -> DataFrame:
    counts = F.col("row_count_source") == F.col("row_count_target")
    data = F.col("checksum_source") == F.col("checksum_target")
    short = lambda c: F.substring(F.md5(c), 1, DIGEST_WIDTH)
    return wide.select(
        "table_name",
        F.when(counts, MATCH).otherwise(MISMATCH).alias("status"),
        "row_count_source",
        "row_count_target",
        short(F.col("checksum_source")).alias("checksum_source"),
        short(F.col("checksum_target")).alias("checksum_target"),
        counts.alias("row_count_match"),
        data.alias("data_match"),
        F.when(counts & ~data, NOTE).alias("checksum_note"),
    )


def reconcile_tables(
    pairs: Mapping[str, tuple[DataFrame, DataFrame]],
    cols: Mapping[str, Sequence[str]] | None = None,
    parallelism: int = 8,
    **flags,
) -> DataFrame:
    """One row per table. ``status`` follows the row counts alone; ``data_match`` tells about contents.

    Each side is scanned once for count and fingerprint together. The tables are jobs of their own, several side by side, so a table that
    fails in any way (unlike columns, a cast that fails while it runs, a file that is gone) is an ERROR row that tells why, and the others
    are compared all the same. Two rows per table reach the driver.
    """

    def sides(name: str) -> DataFrame:
        parts = []
        for side, df in zip(("source", "target"), align_columns(*pairs[name])):
            wanted = [c.lower() for c in cols[name]] if cols and name in cols else None
            found = table_fingerprint(df, wanted, **flags)
            parts.append(found.select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "row_count", "fingerprint"))
        return union_all(parts)

    def one(name: str) -> tuple:
        try:
            return sides(name).collect(), None
        except Exception as exc:
            return [], (name, ERROR, str(exc))

    spark = next(iter(pairs.values()))[0].sparkSession
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(one), pairs))
    rows, faults = [r for found, _ in done for r in found], [fault for _, fault in done if fault]
    parts = []
    if rows:
        kept = spark.createDataFrame(rows, "table_name string, side string, row_count bigint, fingerprint string")
        parts.append(_judge(_sides_to_columns(kept, {"row_count": "row_count", "fingerprint": "checksum"})))
    if faults:
        failed = spark.createDataFrame(faults, "table_name string, status string, checksum_note string")
        parts.append(failed.withColumns({"row_count_match": F.lit(False), "data_match": F.lit(False)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def reconcile_table(name: str, src: DataFrame, tgt: DataFrame, **flags) -> DataFrame:
    return reconcile_tables({name: (src, tgt)}, **flags)


def validation_report(tables: DataFrame, objects: DataFrame) -> DataFrame:
    """Table and object findings in one list: kind, name, status and the two match flags."""
    as_tables = tables.select(
        F.lit("table").alias("object_type"),
        F.col("table_name").alias("object_name"),
        "status",
        "row_count_match",
        F.col("data_match").alias("hash_match"),
    )
    as_objects = objects.select(
        "object_type",
        "object_name",
        "status",
        F.lit(None).cast("boolean").alias("row_count_match"),
        F.lit(None).cast("boolean").alias("hash_match"),
    )
    return as_tables.unionByName(as_objects)


def _is_mismatch() -> Column:
    table = F.col("object_type") == "table"
    return F.when(table, F.col("status") != MATCH).otherwise(~F.col("status").isin(*OBJECT_OK))


def report_summary(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mismatch count and overall PASS/FAIL (PASS when there is none)."""
    grouped = report.groupBy(*keys) if keys else report.groupBy()
    return grouped.agg(
        F.count_if(F.col("object_type") == "table").alias("tables"),
        F.count_if(F.col("object_type") != "table").alias("objects"),
        F.count_if(_is_mismatch()).alias("mismatches"),
    ).withColumn("overall_status", F.when(F.col("mismatches") == 0, "PASS").otherwise("FAIL"))


def match_rate(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Matched tables out of all, as a percentage."""
    tables = report.filter(F.col("object_type") == "table")
    grouped = tables.groupBy(*keys) if keys else tables.groupBy()
    hit = F.col("status") == MATCH
    return grouped.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(hit).alias("passed_tables"),
        (F.avg(F.when(hit, 1.0).otherwise(0.0)) * 100).alias("match_rate"),
    )


def mismatched_tables(report: DataFrame) -> DataFrame:
    return report.filter((F.col("object_type") == "table") & (F.col("status") != MATCH))


def validation_progress(results: DataFrame) -> DataFrame:
    """Total and passed tables per job and dialect pair."""
    return results.groupBy("job_id", "source_dialect", "target_dialect").agg(
        F.count(F.lit(1)).alias("total_tables"), F.count_if(F.col("status") == MATCH).alias("passed_tables")
    )


def mismatch_counters(results: DataFrame) -> DataFrame:
    """Content and row-count mismatches per table, job and dialect pair."""
    return results.groupBy("table_name", "job_id", "source_dialect", "target_dialect").agg(
        F.count_if(~F.col("hash_match")).alias("checksum_mismatches"),
        F.count_if(~F.col("row_count_match")).alias("row_count_mismatches"),
    )


def _range_start(key: str, width: int) -> Column:
    """First key of the range a key lies in; whole numbers throughout, so large keys keep their range."""
    c = F.col(key)
    return (c - F.pmod(c, F.lit(width))).cast("bigint")


def range_fingerprints(src: DataFrame, tgt: DataFrame, key: str, width: int) -> DataFrame:
    """Fingerprint per key range of ``width`` on both sides; differing ranges are where to drill in."""
    left, right = align_columns(src, tgt)
    key = key.lower()
    ranges = _range_start(key, width)

    def per_range(df: DataFrame, side: str) -> DataFrame:
        prints = group_fingerprints(df.withColumn("_range", ranges), ["_range"], df.columns)
        return prints.select("_range", F.lit(side).alias("side"), "row_count", "fingerprint")

    tall = per_range(left, "source").unionByName(per_range(right, "target"))
    pick = [
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}_{side}")
        for c in ("row_count", "fingerprint")
        for side in ("source", "target")
    ]
    return (
        tall.groupBy("_range")
        .agg(*pick)
        .select(
            F.col("_range").alias("range_start"),
            F.coalesce("row_count_source", F.lit(0)).alias("row_count_source"),
            F.coalesce("row_count_target", F.lit(0)).alias("row_count_target"),
            F.col("fingerprint_source").eqNullSafe(F.col("fingerprint_target")).alias("range_match"),
        )
    )


def row_diff(src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed differences: keys whose sets of rows differ, with the reason.

    Both sides are reduced per key first, so keys that repeat are compared as bags of rows and a
    hot key costs one row per task; only keys with a difference come out.
    """
    left, right = align_columns(src, tgt)
    keys = [k.lower() for k in keys]

    def bag(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*keys, row_bits(row_text(df)).alias("_h"), F.lit(sign).alias("_side"))

    n_src = F.count_if(F.col("_side") == 1)
    n_tgt = F.count_if(F.col("_side") == 0)
    side_sum = lambda side: [
        F.sum(F.when(F.col("_side") == side, F.shiftright("_h", 30)).otherwise(0)),
        F.sum(F.when(F.col("_side") == side, F.col("_h").bitwiseAND(F.lit(0x3FFFFFFF))).otherwise(0)),
    ]
    same = F.struct(*side_sum(1)) == F.struct(*side_sum(0))
    grouped = (
        bag(left, 1)
        .unionByName(bag(right, 0))
        .groupBy(*keys)
        .agg(n_src.alias("rows_source"), n_tgt.alias("rows_target"), same.alias("_same"))
    )
    change = (
        F.when(F.col("rows_target") == 0, "only_source")
        .when(F.col("rows_source") == 0, "only_target")
        .otherwise("changed")
    )
    differs = (F.col("rows_source") != F.col("rows_target")) | ~F.col("_same")
    return grouped.filter(differs).select(*keys, change.alias("difference"), "rows_source", "rows_target")


def drill_down(src: DataFrame, tgt: DataFrame, key: str, width: int) -> DataFrame:
    """Keyed differences, looked for only in the key ranges whose fingerprints differ.

    The first pass moves one row per range; only rows of differing ranges are compared by key.
    """
    left, right = align_columns(src, tgt)
    key = key.lower()
    bad = range_fingerprints(src, tgt, key, width).filter(~F.col("range_match")).select(F.col("range_start").alias("_start"))
    start = _range_start(key, width)

    def inside(df: DataFrame) -> DataFrame:
        # Rows whose key is NULL form a range of their own, so the join takes NULL as equal to NULL.
        return df.join(bad, start.eqNullSafe(F.col("_start")), "left_semi")

    return row_diff(inside(left), inside(right), [key])


def _profile(df: DataFrame, side: str) -> DataFrame:
    """Per column: rows, NULLs, least and greatest value, in one pass over the table.

    ``min_value`` and ``max_value`` show numbers as doubles; ``min_exact`` and ``max_exact`` are the canonical texts of the column's own type.
    """
    out = []
    for name, field in zip(df.columns, df.schema):
        c = F.col(f"`{name}`")
        exact = (lambda f, x=c, t=field.dataType: F.when(f(x).isNotNull(), canonical(f(x), t)) if isinstance(t, PLAIN) else F.lit(None).cast("string"))
        text = (lambda x, t=field.dataType: x.cast("double") if isinstance(t, T.NumericType) else F.lit(None).cast("double"))
        out.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(c.isNull()).alias("nulls"),
                F.min(text(c)).alias("min_value"),
                F.max(text(c)).alias("max_value"),
                exact(F.min).alias("min_exact"),
                exact(F.max).alias("max_exact"),
                F.min(F.length(c.cast("string"))).cast("bigint").alias("min_length"),
                F.max(F.length(c.cast("string"))).cast("bigint").alias("max_length"),
            )
        )
    return df.agg(F.array(*out).alias("p")).select(F.inline("p")).withColumn("side", F.lit(side))


def profile_compare(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Column profiles of both sides next to each other, with a match flag.

    The flag compares least and greatest values exactly, also where the shown doubles are equal or NULL; nested and variant columns have none.
    """
    left, right = align_columns(src, tgt)
    tall = _profile(left, "source").unionByName(_profile(right, "target"))
    facts = ("rows", "nulls", "min_value", "max_value", "min_length", "max_length")
    exact = ("min_exact", "max_exact")
    pick = [
        F.max(F.when(F.col("side") == side, F.col(f))).alias(f"{f}_{side}") for f in (*facts, *exact) for side in ("source", "target")
    ]
    same = reduce(
        lambda a, b: a & b, [F.col(f"{f}_source").eqNullSafe(F.col(f"{f}_target")) for f in (*facts, *exact)]
    )
    whole = tall.groupBy("column_name").agg(*pick).withColumn("profile_match", same)
    return whole.drop(*[f"{f}_{side}" for f in exact for side in ("source", "target")])


def _summed(c: Column, dtype: T.DataType) -> Column | None:
    """What a column adds to its total, as an exact number: sums of these agree in any order of the rows."""
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("decimal(20,0)")
    if isinstance(dtype, T.DecimalType):
        return c
    if isinstance(dtype, T.FractionalType):
        return c.try_cast("decimal(38,9)")
    if isinstance(dtype, T.NumericType):
        return c.cast("decimal(20,0)")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("decimal(20,0)")
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c).cast("decimal(20,0)")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("decimal(20,0)")
    if isinstance(dtype, PLAIN):
        return F.length(c).cast("decimal(20,0)")
    return None


def _totals(df: DataFrame, side: str) -> DataFrame:
    """Per column: values, least and greatest one as canonical text, total and values the total leaves out, in one pass."""
    nothing = F.lit(None).cast("string")
    out = []
    for name, field in zip(df.columns, df.schema):
        c, kind = F.col(f"`{name}`"), field.dataType
        plain = isinstance(kind, PLAIN)
        shown = lambda f, x=c, t=kind: F.when(F.count(x) > 0, canonical(f(x), t))
        part = _summed(c, kind)
        if part is None:
            total, unsummed = nothing, F.count(c)
        else:
            scale = 9 if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else getattr(kind, "scale", 0)
            total = F.when(F.count(part) > 0, canonical(F.try_sum(part), T.DecimalType(38, scale), null_as_empty=False))
            unsummed = F.count(c) - F.count(part)
        out.append(
            F.struct(
                F.lit(name).alias("column_name"), F.count(c).alias("values"),
                (shown(F.min) if plain else nothing).alias("least"), (shown(F.max) if plain else nothing).alias("greatest"),
                total.alias("total"), unsummed.alias("unsummed"),
            )
        )
    return df.agg(F.array(*out).alias("p")).select(F.inline("p")).withColumn("side", F.lit(side))


def profile_totals(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Totals, least and greatest values of every column on both sides as text, with a match flag.

    Numbers are added as they are, doubles at nine decimal places; booleans as 1/0, dates as days and times as
    microseconds since 1970, texts and bytes by their length. All sums are of exact decimals, so the order of rows does not
    matter. ``unsummed`` counts values that are no finite number of that size; nested columns show counts alone. A total
    beyond 38 digits reads as the NULL mark. No values at all give NULL.
    """
    left, right = align_columns(src, tgt)
    tall = _totals(left, "source").unionByName(_totals(right, "target"))
    facts = ("values", "least", "greatest", "total", "unsummed")
    pick = [F.max(F.when(F.col("side") == side, F.col(f))).alias(f"{f}_{side}") for f in facts for side in ("source", "target")]
    same = reduce(lambda a, b: a & b, [F.col(f"{f}_source").eqNullSafe(F.col(f"{f}_target")) for f in facts])
    return tall.groupBy("column_name").agg(*pick).withColumn("totals_match", same)


def sample_records(src: DataFrame, tgt: DataFrame, keys: Sequence[str], k: int, differing: bool = True) -> DataFrame:
    """``k`` keys with the records of both sides next to each other as canonical text.

    The keys are those with the least MD5 of their text, so both sides, and a repeated run, show the same ones; ``differing``
    chooses among keys whose records differ, else among all. A key with several records shows the least
    of each side and their numbers. Only the k keys are broadcast.
    """
    left, right = align_columns(src, tgt)
    keys = [c.lower() for c in keys]
    if differing:
        chosen = row_diff(left, right, keys).select(*keys)
    else:
        chosen = left.select(*keys).unionByName(right.select(*keys)).distinct()
    chosen = chosen.withColumn("_place", F.md5(row_text(chosen))).orderBy("_place", *keys).limit(k).drop("_place")
    chosen = chosen.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    same_key = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])

    def records(df: DataFrame, side: str) -> DataFrame:
        return df.join(F.broadcast(chosen), same_key, "left_semi").select(*keys, row_text(df).alias("_text"), F.lit(side).alias("_side"))

    def of(side: str) -> Column:
        return F.when(F.col("_side") == side, F.col("_text"))

    both = records(left, "source").unionByName(records(right, "target"))
    return both.groupBy(*keys).agg(
        F.count(of("source")).alias("records_source"), F.count(of("target")).alias("records_target"),
        F.min(of("source")).alias("record_source"), F.min(of("target")).alias("record_target"),
    )
