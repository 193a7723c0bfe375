"""Tables kept as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T


def read_folder(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A table from Parquet, ORC, CSV or JSON; give text formats their schema, so nothing is read to guess it."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_folder(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Replace what is there with every row of ``df``."""
    df.write.format(fmt).mode("overwrite").partitionBy(*partition_by).save(path)
