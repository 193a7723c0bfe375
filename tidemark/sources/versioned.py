"""Stores that only grow: folders of changes, and a manifest that names those that count.

A write puts its rows into a new folder and then adds a manifest with the next version; what a lost write left behind is in no manifest and is
never read. Readers fold the rows of all named folders into one state; the fold must not care about order, grouping or repetition ("the
latest by time" is such a fold), so late rows and replayed batches change nothing. When a level holds ``FAN`` folders, they are folded
into one folder of the next level, so a row is rewritten as often as the level count, not with every batch. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKET = "bucket"
FAN = 8

Fold = Callable[[DataFrame], DataFrame]


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def read_manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Version and content of the newest manifest; version 0 and no folders before the first write."""
    system, place = _file_system(spark, f"{path}/manifest")
    names = sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return 0, {"folders": [], "buckets": None, "schema": None}
    stream = system.open(spark._jvm.org.apache.hadoop.fs.Path(place, names[-1]))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return int(names[-1].removesuffix(".json")), json.loads(text)


def write_manifest(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Make a version count: its file is written aside and then renamed. A version that is there already is another writer's."""
    system, final = _file_system(spark, f"{path}/manifest/{version:012d}.json")
    if system.exists(final):
        raise RuntimeError(f"version {version} of {path} was written by someone else")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{uuid.uuid4().hex}.tmp")
    stream = system.create(aside)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    if not system.rename(aside, final):
        raise RuntimeError(f"version {version} of {path} could not be written")


def read_changes(spark: SparkSession, path: str, folders: Sequence[str] | None = None) -> DataFrame | None:
    """Rows of the folders that count (or of some of them), not folded; nothing before the first write."""
    version, manifest = read_manifest(spark, path)
    if not version:
        return None
    names = [f for f, _ in manifest["folders"]] if folders is None else folders
    schema = T.StructType.fromJson(manifest["schema"])
    rows = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{n}" for n in names])
    return rows.select(*schema.names)


def _write_folder(rows: DataFrame, path: str, version: int) -> str:
    """Rows by bucket; rebalanced, so that AQE splits a bucket that is too large for one task and joins small ones."""
    name = f"change={version:012d}-{uuid.uuid4().hex}"
    rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{name}")
    return name


def append(rows: DataFrame, path: str, keys: Sequence[str], fold: Fold, buckets: int = 64, fan: int = FAN) -> int:
    """Add rows to a store and return its version. ``buckets`` counts for a new store; afterwards the manifest tells."""
    spark = rows.sparkSession
    version, manifest = read_manifest(spark, path)
    number = manifest["buckets"] or buckets
    placed = rows.withColumn(BUCKET, bucket_of(keys, number))
    folders = [*manifest["folders"], [_write_folder(placed, path, version + 1), 0]]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in placed.schema])
    content = {"folders": folders, "buckets": number, "schema": manifest["schema"] or schema.jsonValue()}
    write_manifest(spark, path, version + 1, content)
    return compact(spark, path, fold, fan)


def compact(spark: SparkSession, path: str, fold: Fold, fan: int = FAN) -> int:
    """Fold levels that hold ``fan`` folders or more into one folder of the next level; returns the version."""
    version, manifest = read_manifest(spark, path)
    while version:
        levels = [level for _, level in manifest["folders"]]
        full = sorted(level for level in set(levels) if levels.count(level) >= fan)
        if not full:
            break
        old = [f for f, level in manifest["folders"] if level == full[0]]
        name = _write_folder(fold(read_changes(spark, path, old)), path, version + 1)
        manifest["folders"] = [[f, level] for f, level in manifest["folders"] if f not in old] + [[name, full[0] + 1]]
        version += 1
        write_manifest(spark, path, version, manifest)
    return version


def current(spark: SparkSession, path: str, fold: Fold) -> DataFrame | None:
    """The state a store holds, without its bucket column; nothing before the first write."""
    rows = read_changes(spark, path)
    return None if rows is None else fold(rows).drop(BUCKET)


def remove_unused(spark: SparkSession, path: str) -> int:
    """Delete folders that no manifest's newest version names; for times without readers and writers. Returns how many."""
    _, manifest = read_manifest(spark, path)
    system, place = _file_system(spark, path)
    live = {f for f, _ in manifest["folders"]}
    dead = [s.getPath() for s in system.listStatus(place) if s.getPath().getName().startswith("change=") and s.getPath().getName() not in live]
    return sum(bool(system.delete(p, True)) for p in dead)
