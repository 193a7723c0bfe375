"""Conversion of values between dialects, with the failures counted."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.native_types import CANONICAL_TYPES, SPARK_TYPES

# Conversions between dialects, as (source, target) -> native base type -> Spark type of the result.
PAIR_RULES = {
    ("oracle", "postgresql"): {"number": "decimal(38,18)", "date": "timestamp_ntz", "clob": "string", "raw": "binary"},
    ("oracle", "mysql"): {"number": "decimal(38,18)", "date": "timestamp_ntz", "clob": "string", "raw": "binary"},
    ("mysql", "postgresql"): {"tinyint(1)": "boolean", "year": "smallint", "enum": "string", "set": "array<string>"},
    ("mysql", "oracle"): {"tinyint(1)": "decimal(1,0)", "year": "decimal(4,0)", "enum": "string"},
    ("postgresql", "mysql"): {"boolean": "tinyint", "uuid": "char(36)", "jsonb": "string", "bytea": "binary"},
    ("postgresql", "oracle"): {"boolean": "decimal(1,0)", "uuid": "char(36)", "jsonb": "string", "bytea": "binary"},
}


# Native types that hold true or false.
FLAGS = ("boolean", "tinyint(1)")
# Decimal digits that fit each integer type.
WHOLE_TYPES = ((4, "smallint"), (9, "int"), (18, "bigint"))
_SIZED = re.compile(r"^([a-z0-9_ ]+?)\s*\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\)$")


def rule_for(source: str, target: str, native: str) -> str | None:
    """The pair's own rule for a native type, with or without its length."""
    rules = PAIR_RULES.get((source, target), {})
    native = native.lower().strip()
    return rules.get(native) or rules.get(native.split("(")[0].strip())


def type_for(source: str, target: str, native: str) -> str | None:
    """Spark type that a native column is converted to: its precision first, then the pair's rule, then the common type.

    A number of p digits without a fraction becomes the smallest integer that holds them all, one with a fraction the same decimal,
    and a text of limited length is held to that length. NULL means that no rule knows the type.
    """
    native = native.lower().strip()
    sized = _SIZED.match(native)
    name = sized[1] if sized else native
    if sized and name in ("number", "numeric", "decimal"):
        digits, scale = int(sized[2]), int(sized[3] or 0)
        if digits > 38 or scale > digits:
            return "string"
        if scale > 0:
            return f"decimal({digits},{scale})"
        # A negative scale rounds to tens and hundreds: the value is that many digits longer.
        return next((kind for most, kind in WHOLE_TYPES if digits - scale <= most), f"decimal({min(digits - scale, 38)},0)")
    rule = rule_for(source, target, native)
    if rule is not None:
        return rule
    common = CANONICAL_TYPES[source].get(name)
    if sized and common in ("VARCHAR", "CHAR"):
        return f"char({sized[2]})"
    return SPARK_TYPES.get(common)


def targets_for(native: Mapping[str, str], source: str, target: str) -> dict[str, str]:
    """Column -> Spark type for a table's native types; unknown types are an error that names them all."""
    found = {name: type_for(source, target, kind) for name, kind in native.items()}
    unknown = sorted(f"{name} {native[name]}" for name, kind in found.items() if kind is None)
    if unknown:
        raise ValueError(f"no rule from {source} to {target} for: {', '.join(unknown)}")
    flags = [name for name, kind in native.items() if kind.lower().strip() in FLAGS]
    return {name: f"flag {kind}" if name in flags and kind != "boolean" else kind for name, kind in found.items()}


def converted(column: Column, to: str) -> Column:
    """NULL where a value does not convert; zero dates do not."""
    if to.startswith("flag "):
        return converted(column, "boolean").cast("int").cast(to[5:])
    if to == "array<string>":
        return F.split(column, ",")
    if to.startswith("char("):
        return F.when(F.length(column.cast("string")) <= int(to[5:-1]), column.cast("string"))
    if to == "boolean":
        return F.when(column.cast("string").isin("1", "0"), column.cast("string") == "1").otherwise(column.try_cast("boolean"))
    return column.try_cast(to)


def convert_types(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: converted(F.col(name), to) for name, to in targets.items()})


def convert_between(df: DataFrame, native: Mapping[str, str], source: str, target: str) -> DataFrame:
    """Columns with a native type as the target takes them; all others stay as they are."""
    return convert_types(df, targets_for(native, source, target))


def conversion_failures(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Per column: values present and values that would be lost, in one pass."""
    facts = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(to).alias("target_type"),
            F.count(F.col(name)).alias("values"),
            F.count_if(F.col(name).isNotNull() & converted(F.col(name), to).isNull()).alias("failures"),
        )
        for name, to in targets.items()
    ]
    return df.agg(F.array(*facts).alias("_f")).select(F.inline("_f"))


def normalize_array(df: DataFrame, keys: Sequence[str], column: str, name: str = "item") -> DataFrame:
    """An array column as a child table: parent key, position from 0, item."""
    return df.select(*keys, F.posexplode(column).alias("position", name))


def normalize_set(df: DataFrame, keys: Sequence[str], column: str, name: str = "item") -> DataFrame:
    """A comma-separated SET column as a child table; an empty set has no rows."""
    members = df.filter(F.col(column).isNotNull() & (F.col(column) != ""))
    return members.select(*keys, F.posexplode(F.split(column, ",")).alias("position", name))
