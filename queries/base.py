"""Registry and inputs shared by all registered queries.

Derived inputs are written once as SQL text with ``{table}`` placeholders. Spark fills a placeholder
with a DataFrame, the SQL check with the table name or a sub-select, so both sides start from the
same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.joins import shuffled

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
RELATIONAL = "region nation customer supplier part orders lineitem".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# name -> SQL for both engines, or a (Spark, DuckDB) pair where the dialects part ways
FIXTURES: dict[str, str | tuple[str, str]] = {}

_NAMES = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


class Tables:
    """The tables of one data folder and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = FIXTURES[name]
        return self.sql(text if isinstance(text, str) else text[0])

    def sql(self, text: str) -> DataFrame:
        inputs = {n: getattr(self, n) for n in dict.fromkeys(_NAMES.findall(text))}
        # Derived inputs have far more rows than Spark takes them for, so they are joined by shuffle.
        inputs = {n: df if n in BASE_TABLES else shuffled(df) for n, df in inputs.items()}
        return self.spark.sql(text, **inputs) if inputs else self.spark.sql(text)


def duck(text: str) -> str:
    """Fill the placeholders for DuckDB."""

    def sub(name: str) -> str:
        if name in BASE_TABLES:
            return name
        body = FIXTURES[name]
        return "(" + duck(body if isinstance(body, str) else body[1]) + ")"

    names = dict.fromkeys(_NAMES.findall(text))
    return text.format(**{n: sub(n) for n in names})


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its check if SQL can express it."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duck(sql)
        return fn

    return register
