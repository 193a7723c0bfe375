"""Canonical cell and row text, so that equal values hash alike whichever database they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The bar that joins the cells of a row, and the stand-in for NULL when it must differ from ''.
DELIMITER = "|"
NULL_MARK = "\\N"


def trim_fraction(text: Column) -> Column:
    """Plain decimal text without trailing zeros of the fraction and without a bare point."""
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def _without_exponent(text: Column) -> Column:
    """The digits of "1.25E-7" as plain decimal text, none lost and none rounded."""
    pattern = r"^-?(\d)\.(\d+)E(-?\d+)$"
    digits = F.concat(F.regexp_extract(text, pattern, 1), F.rtrim(F.regexp_extract(text, pattern, 2), F.lit("0")))
    power = F.regexp_extract(text, pattern, 3).try_cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    padded = F.rpad(digits, F.greatest(F.length(digits), power + 1), "0")
    fraction = F.substring(padded, power + 2, F.length(padded))
    large = F.concat(F.substring(padded, F.lit(1), power + 1), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return F.concat(sign, F.when(power >= 0, large).otherwise(small))


def _number_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DecimalType):
        text = c.cast("string")
        return trim_fraction(text) if dtype.scale > 0 else text
    if isinstance(dtype, T.FractionalType):
        # Adding zero turns -0.0 into 0.0. Text without an exponent only needs its ".0" cut; the exact
        # slower route is left for the few values printed with an exponent.
        text = (c + F.lit(0).cast(dtype)).cast("string")
        plain = _without_exponent(text)
        cut = F.substring(text, F.lit(1), F.length(text) - 2)
        return F.coalesce(
            F.when(text.contains("E"), plain).when(text.endswith(".0"), cut).otherwise(text), text
        )
    return c.cast("string")


def _ordered(c: Column, dtype: T.DataType) -> Column:
    """The value with the entries of all maps in it, at any depth, in order of their keys: equal maps then read alike."""
    if isinstance(dtype, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), _ordered(e["value"], dtype.valueType).alias("value")))
        order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(entries, order))
    if not holds_map(dtype):
        return c
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, dtype.elementType))
    fields = [_ordered(c.getField(f.name), f.dataType).alias(f.name) for f in dtype]
    return F.when(c.isNotNull(), F.struct(*fields))


def holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    return isinstance(dtype, T.MapType)


def canonical(
    c: Column,
    dtype: T.DataType,
    null_as_empty: bool = True,
    yes_no_as_flag: bool = False,
) -> Column:
    """Text of one cell: 1, 1.0 and 1.000 agree, booleans read 1/0, NULL reads as the empty string.

    ``null_as_empty=False`` tells NULL from ''. ``yes_no_as_flag`` reads 'Y'/'N' as 1/0 for sources
    that keep flags as single characters.
    """
    if isinstance(dtype, T.BooleanType):
        text = c.cast("int").cast("string")
    elif isinstance(dtype, T.NumericType):
        text = _number_text(c, dtype)
    elif isinstance(dtype, T.BinaryType):
        text = F.hex(c)
    elif isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        text = F.array_join(F.transform(c, lambda x: canonical(x, inner, null_as_empty)), ",")
    elif yes_no_as_flag and isinstance(dtype, T.StringType):
        text = F.when(c == "Y", "1").when(c == "N", "0").otherwise(c)
    elif isinstance(dtype, (T.MapType, T.StructType, T.VariantType)):
        text = F.to_json(_ordered(c, dtype))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("" if null_as_empty else NULL_MARK))


def row_text(df: DataFrame, cols: Sequence[str] | None = None, delimiter: str = DELIMITER, **flags) -> Column:
    """The canonical cells of a row joined by the delimiter (coalesced first: concat_ws skips NULLs)."""
    names = list(cols or df.columns)
    cells = [canonical(F.col(f"`{n}`"), df.schema[n].dataType, **flags) for n in names]
    return F.concat_ws(delimiter, *cells)


def row_bits(text: Column) -> Column:
    """First 60 bits of the row's MD5 as a bigint."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
