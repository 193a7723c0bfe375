"""What the views, functions, triggers and defaults of a migrated schema do, on DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def is_on(flag: Column) -> Column:
    """A flag that is TRUE, 1 or 'Y', however the source keeps it."""
    return F.upper(flag.cast("string")).isin("TRUE", "Y", "1")


def active_rows(df: DataFrame, flag: Column, columns: Sequence[str]) -> DataFrame:
    """The view over active rows: a filter and a few columns."""
    return df.filter(flag).select(*columns)


def counts_for_keys(keys: DataFrame, rows: DataFrame, key: str, row_key: str) -> DataFrame:
    """The counting function for all keys at once: one aggregation instead of a query per call."""
    counted = rows.groupBy(F.col(row_key).alias(key)).agg(F.count(F.lit(1)).alias("row_count"))
    return keys.join(counted, key, "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def create_count_function(spark: SparkSession, name: str, view: str, column: str, key_type: str = "bigint") -> None:
    """The same as a function for SQL text; Spark turns its body into a join."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(k {key_type}) RETURNS bigint "
        f"RETURN (SELECT count(*) FROM {view} WHERE {column} = k)"
    )


def lower_on_write(df: DataFrame, column: str) -> DataFrame:
    """The trigger that lower-cases a column on insert and update."""
    return df.withColumn(column, F.lower(column))


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Column defaults: filled in where the row has no value."""
    return df.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})
