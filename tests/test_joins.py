"""Joins of tables that grow together: Spark takes exploded rows for a few bytes, and they must not be broadcast all the same."""

import pytest
from pyspark.sql import functions as F

from queries.base import FIXTURES, Tables
from tidemark.operators import catalog, integrity, ordering, translation
from tidemark.plans import risk, waves
from tidemark.sources import stores


@pytest.fixture(scope="module")
def inputs(spark):
    def rows(*columns):
        """Two rows per job, from a table Spark knows to be small."""
        jobs = spark.range(6).select(F.col("id").alias("job_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("n"))
        either = lambda a, b: F.when(F.col("n") == "a", a).otherwise(b)
        fixed = {"schema_name": F.lit("s"), "dialect": F.lit("mysql"), "constraint_type": either("PRIMARY KEY", "FOREIGN KEY"), "object_type": either("view", "table"), "applied_status": either("APPLIED", "PENDING_MANUAL_REVIEW")}
        named = lambda c: fixed.get(c, F.col("n")).alias(c)
        return jobs.select("job_id", *[named(c) if isinstance(c, str) else c for c in columns])

    at = F.lit(1).alias("position")
    return {
        "constraints": rows("schema_name", "dialect", "table_name", "constraint_name", "constraint_type", "ref_constraint_name"),
        "key_usage": rows("schema_name", "table_name", "constraint_name", "column_name", at),
        "ref_usage": rows("schema_name", "constraint_name", "ref_table_name", "ref_column_name", at),
        "columns": rows(
            "schema_name", "dialect", "table_name", "column_name", F.lit(0).alias("ordinal"), F.concat("n", F.lit("son")).alias("native_type"),
            F.lit("YES").alias("is_nullable"), F.lit(None).cast("string").alias("default_value"), F.lit("PRI").alias("column_key"),
        ),
        "tables": rows("schema_name", "dialect", "table_name", F.lit("BASE TABLE").alias("table_type"), F.lit(None).cast("string").alias("definition")),
        "objects": rows(
            "schema_name", "dialect", "object_name", "object_type", F.lit(1).alias("ord"), F.concat("job_id", "n").alias("object_id"),
            F.lit("a b").alias("ddl"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("seq"), "applied_status",
            F.lit(None).cast("string").alias("applied_error"), F.concat("job_id", "n").alias("source_object_id"), F.concat("job_id", "n").alias("id"),
            F.lit("SUCCESS").alias("translation_status"), F.lit("x").alias("target_ddl"),
        ),
    }


CASES = {
    "foreign_keys": lambda x: catalog.foreign_keys(x["constraints"], x["key_usage"], x["ref_usage"]),
    "referenced_columns": lambda x: catalog.referenced_columns(x["constraints"], x["key_usage"]),
    "columns_with_pk": lambda x: catalog.columns_with_pk(x["columns"], x["constraints"], x["key_usage"]),
    "case_map_from_extracts": lambda x: catalog.case_map_from_extracts(x["tables"], x["columns"]),
    "object_existence": lambda x: integrity.object_existence(x["objects"], x["objects"], x["objects"], x["objects"]),
    "schema_compatibility": lambda x: integrity.schema_compatibility(x["objects"].withColumn("status", F.lit("PRESENT")), x["objects"]),
    "missing_objects": lambda x: integrity.missing_objects(x["objects"].withColumn("status", F.lit("MISSING"))),
    "requote_identifiers": lambda x: translation.requote_identifiers(x["objects"], catalog.case_map_from_extracts(x["tables"], x["columns"])),
    "applicable_translations": lambda x: translation.applicable_translations(x["objects"], x["objects"], True),
    "applied_outcomes": lambda x: translation.applied_outcomes(x["objects"], x["objects"]),
    "apply_outcomes": lambda x: translation.apply_outcomes(x["objects"], x["objects"]),
    "score_risk": lambda x: risk.score_risk(x["objects"], x["columns"]),
    "with_dependencies": lambda x: stores.with_dependencies(x["objects"], x["objects"].select("job_id", F.col("object_name").alias("child"), F.array("ddl").alias("dependencies"))),
    "latest_loads": lambda x: stores.latest_loads(x["objects"].withColumn("load", F.lit(1))),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_no_table_of_the_estate_is_broadcast(inputs, name):
    plan = CASES[name](inputs)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" in plan


def test_inputs_derived_by_joins_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setitem(FIXTURES, "many", "SELECT id AS k, x FROM range(6) LATERAL VIEW explode(array('a', 'b')) e AS x")
    monkeypatch.setitem(FIXTURES, "both", "SELECT m.k, n.x FROM {many} m JOIN {many} n ON n.k = m.k AND n.x = m.x")
    df = Tables(spark, "/nowhere").both
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 12


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parents_of_counted_keys_are_not_broadcast(spark):
    child = spark.createDataFrame([(1, 7), (2, 7), (None, 8), (9, None), (9, 8), (1, 9)], "a int, b int")
    # Values of a statement, so Spark knows them to be few.
    parents = {n: spark.sql(f"SELECT * FROM VALUES {v} AS t(x)") for n, v in {"p": "(1), (2), (NULL)", "q": "(7), (7), (8)"}.items()}
    fks = [integrity.ForeignKey("one", "c", ("a",), "p", ("x",)), integrity.ForeignKey("two", "c", ("b",), "q", ("x",))]
    counts = integrity.orphan_counts({"c": child, **parents}, fks)
    assert "Broadcast" not in executed(counts) and "SortMergeJoin" in executed(counts)
    assert sorted((r["constraint_name"], r["orphan_rows"]) for r in counts.collect()) == [("one", 2), ("two", 1)]


def test_catalogue_is_numbered_without_broadcasting_what_it_is_joined_from(inputs, monkeypatch):
    ranged = []
    cut = ordering.cut_lineage
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: ranged.append(executed(df)) or cut(df))
    nothing = lambda *names: inputs["tables"].limit(0).select("job_id", "dialect", "schema_name", *[F.lit(None).cast("string").alias(n) for n in names])
    rows = catalog.catalog_from_extracts({
        **{n: inputs[n] for n in ("tables", "columns", "constraints", "key_usage", "ref_usage")},
        "views": nothing("view_name", "definition"),
        "routines": nothing("routine_name", "routine_kind", "definition"),
        "triggers": nothing("trigger_name", "table_name", "definition").withColumn("is_internal", F.lit(False)),
    })
    assert len(ranged) == 1 and "Broadcast" not in ranged[0] and "Join" in ranged[0]
    found = [(r["object_type"], r["object_name"], r["ord"], [c["column_name"] for c in r["columns"] or []]) for r in rows.filter("job_id = 3").collect()]
    assert sorted(found, key=lambda r: r[2]) == [("table", "a", 1, ["a"]), ("table", "b", 2, ["b"]), ("foreign_key", "b", 3, [])]


def test_waves_broadcast_neither_links_nor_nodes(spark, monkeypatch):
    steps = []
    cut = waves.cut_lineage
    monkeypatch.setattr(waves, "cut_lineage", lambda df: steps.append(executed(df)) or cut(df))
    tables = spark.range(4).select(F.col("id").alias("job_id"), F.posexplode(F.array(*map(F.lit, "abc"))).alias("ord", "table_name"))
    edges = spark.range(4).select(F.col("id").alias("job_id"), F.inline(F.array(*[F.struct(F.lit(c).alias("child"), F.lit(p).alias("parent")) for c, p in ("ba", "cb", "ca")])))
    found = waves.load_waves(tables, edges)
    assert {(r["job_id"], r["table_name"]): r["wave"] for r in found.collect()} == {(j, n): w for j in range(4) for w, n in enumerate("abc")}
    assert len(steps) > 3 and not any("Broadcast" in s for s in [*steps, executed(found)])
