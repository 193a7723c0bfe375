"""Order-independent table fingerprints that combine map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.canonical import row_bits, row_text

_WIDE = "decimal(38,0)"


def bit_sums(bits: Column) -> list[Column]:
    """Sum 60-bit hashes as three 20-bit bigint sums.

    Bigint sums stay in generated code and are several times cheaper than decimal ones; 20-bit
    parts leave room for 2**43 rows. A sum is used, not xor, so that duplicate rows do not cancel.
    """
    part = F.lit(0xFFFFF)
    return [
        F.sum(F.shiftright(bits, 40)).alias("_hi"),
        F.sum(F.shiftright(bits, 20).bitwiseAND(part)).alias("_mid"),
        F.sum(bits.bitwiseAND(part)).alias("_lo"),
        F.count(F.lit(1)).alias("row_count"),
    ]


def fold_bits() -> Column:
    """The exact sum of the 60-bit hashes as text, from the three partial sums; '0' for no rows."""

    def wide(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast(_WIDE)

    total = wide("_hi") * F.lit(1 << 40).cast("decimal(13,0)") + wide("_mid") * F.lit(1 << 20).cast("decimal(7,0)")
    return (total.cast(_WIDE) + wide("_lo")).cast(_WIDE).cast("string")


def table_fingerprint(df: DataFrame, cols: Sequence[str] | None = None, **flags) -> DataFrame:
    """One row: ``row_count`` and ``fingerprint`` over all rows, in any order and any partitioning."""
    hashed = df.select(row_bits(row_text(df, cols, **flags)).alias("_h"))
    return hashed.agg(*bit_sums(F.col("_h"))).select("row_count", fold_bits().alias("fingerprint"))


def group_fingerprints(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None, **flags) -> DataFrame:
    """As ``table_fingerprint``, one row per key; partial sums keep a hot key to one row per task."""
    hashed = df.select(*keys, row_bits(row_text(df, cols, **flags)).alias("_h"))
    return hashed.groupBy(*keys).agg(*bit_sums(F.col("_h"))).select(
        *keys, "row_count", fold_bits().alias("fingerprint")
    )
