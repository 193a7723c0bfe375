"""Joins of tables that grow together."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the estate: it is shuffled and sorted, never broadcast.

    Spark judges an exploded or aggregated table by its width and the files below it, not by its rows, so it may take
    millions of rows for a few MB and gather them at the driver.
    """
    return df.hint("merge")
