"""Orphans, keys, objects and reports on small inputs."""

from pyspark.sql import functions as F

from tidemark.operators import integrity, reconcile
from tidemark.operators.integrity import ForeignKey


def test_orphans_ignore_null_keys_and_survive_a_hot_key(spark):
    child = spark.range(10_000).select(
        F.when(F.col("id") < 4000, 1).when(F.col("id") < 4010, 99).when(F.col("id") < 5000, None).otherwise(F.col("id") % 50).cast("int").alias("k"))
    parent = spark.range(60).select(F.col("id").cast("int").alias("p"))
    fk = ForeignKey("fk", "child", ("k",), "parent", ("p",))
    assert integrity.orphan_count(child, parent, fk).first()["orphan_rows"] == 10
    assert integrity.orphan_rows(child, parent, ["k"], ["p"]).count() == 10


def test_composite_keys_need_all_parts(spark):
    child = spark.createDataFrame([(1, 1), (1, None), (2, 1), (None, None)], "a int, b int")
    parent = spark.createDataFrame([(1, 1), (1, 1)], "x int, y int")
    assert [tuple(r) for r in integrity.orphan_rows(child, parent, ["a", "b"], ["x", "y"]).collect()] == [(2, 1)]


def test_missing_table_is_an_error_not_a_failure(spark):
    t = {"child": spark.createDataFrame([(1,)], "a int"), "parent": spark.createDataFrame([(1,)], "p int")}
    bad = ForeignKey("fk", "child", ("nope",), "parent", ("p",))
    assert integrity.check_referential_integrity(spark, t, [bad]).first()["status"] == "ERROR"
    good = ForeignKey("fk", "child", ("a",), "parent", ("p",))
    row = integrity.check_referential_integrity(spark, t, [good]).first()
    assert (row["status"], row["detail"]) == ("PASS", integrity.ALL_VALID)


def test_findings_text(spark):
    t = {"c": spark.createDataFrame([(1,), (2,), (2,)], "a int"), "p": spark.createDataFrame([(1,)], "p int")}
    fks = [ForeignKey("one", "c", ("a",), "p", ("p",)), ForeignKey("two", "p", ("p",), "c", ("a",)), ForeignKey("three", "c", ("a",), "p", ("p",))]
    row = integrity.check_referential_integrity(spark, t, fks).first()
    assert row["detail"] == "one (c.a -> p.p): 2 orphan rows; three (c.a -> p.p): 2 orphan rows"


def test_key_check(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, None), (2, 1)], "a int, b int")
    row = integrity.key_check(df, ["a", "b"]).first()
    assert (row["duplicate_keys"], row["duplicate_rows"], row["null_key_rows"], row["key_holds"]) == (1, 2, 1, False)


def test_existence(spark):
    catalog = spark.createDataFrame([("j", i, k, n) for i, (k, n) in enumerate(
        [("view", "V1"), ("view", "V2"), ("function", "V2"), ("trigger", "T"), ("table", "X"), ("procedure", "P")])],
        "job_id string, ord int, object_type string, object_name string")
    target = spark.createDataFrame([("j", "view", "v1"), ("j", "view", "V1"), ("k", "view", "v2")], "job_id string, object_type string, object_name string")
    applied = spark.createDataFrame(
        [("j", "view", "V2", "PENDING_MANUAL_REVIEW", None, 0), ("j", "function", "V2", "APPLY_FAILED", "boom", 0), ("j", "trigger", "T", "APPLIED", None, 0)],
        "job_id string, object_type string, object_name string, applied_status string, applied_error string, seq int")
    rows = integrity.object_existence(catalog, target, applied).orderBy("ord").collect()
    assert [(r["object_type"], r["status"]) for r in rows] == [
        ("view", "PRESENT"), ("view", "PENDING_MANUAL_REVIEW"), ("function", "APPLY_FAILED"), ("trigger", "MISSING"), ("procedure", "MISSING")]
    assert rows[2]["detail"] == "boom"
    lost = integrity.object_existence(catalog, target, applied, spark.createDataFrame([("j",)], "job_id string"))
    assert {r["status"] for r in lost.collect()} == {"ERROR"}
    missing = integrity.missing_objects(integrity.object_existence(catalog, target, applied)).first()
    assert missing["detail"] == "3 missing/failed: function:V2, trigger:T, procedure:P"


def test_jobs_without_objects_pass(spark):
    none = spark.createDataFrame([], "job_id string, status string")
    row = integrity.schema_compatibility(none, spark.createDataFrame([("j",)], "job_id string")).first()
    assert (row["status"], row["detail"]) == ("PASS", "0/0 translated objects present on target")


def test_report_counts_an_error_as_not_passed(spark):
    checks = spark.createDataFrame([("a", "PASS"), ("b", "ERROR")], "check string, status string")
    assert integrity.test_report(checks).first()["overall_status"] == "FAIL"
    assert integrity.test_report(checks.filter("status = 'PASS'")).first()["overall_status"] == "PASS"


def test_smoke(spark):
    timings = integrity.performance_smoke(spark, {"t": spark.range(5)})
    assert timings.first()["row_count"] == 5
    assert integrity.smoke_check(timings, limit=60).first()["detail"] == "All 1 table(s) respond within 60s"
    slow = spark.createDataFrame([("a", 1, 7.25, "SLOW", None)], timings.schema)
    assert integrity.smoke_check(slow).first()["detail"] == "Slow tables (> 5s): a (7.25s)"


def test_summary(spark):
    tables = spark.createDataFrame([("a", "MATCH", True, False), ("b", "MISMATCH", False, False)], "table_name string, status string, row_count_match boolean, data_match boolean")
    objects = spark.createDataFrame([("view", "v", "PRESENT"), ("view", "w", "PENDING_MANUAL_REVIEW"), ("view", "x", "MISSING")], "object_type string, object_name string, status string")
    row = reconcile.report_summary(reconcile.validation_report(tables, objects)).first()
    assert (row["tables"], row["objects"], row["mismatches"], row["overall_status"]) == (2, 3, 2, "FAIL")
