"""Cases that a sample of ordinary data doesn't reach: exponents, map order, NULL and large keys, faults of one table or one check."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical
from tidemark.operators import integrity, reconcile, translation
from tidemark.sources.stores import read_store
from tidemark.streaming import changes
from tidemark.streaming.changes import newer_rows


def canonical_of(spark, expressions):
    df = spark.sql("SELECT " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(expressions)))
    return list(df.select(*[canonical(df[c], df.schema[c].dataType) for c in df.columns]).first())


def test_exponents_lose_no_digit(spark):
    got = canonical_of(spark, ["1e-20D", "-1.25e-7D", "1.5e10D", "12345678.9D", "1e300D", "-0.0D", "2.5e7F", "0.5D"])
    assert got == ["0." + "0" * 19 + "1", "-0.000000125", "15000000000", "12345678.9", "1" + "0" * 300, "0", "25000000", "0.5"]


def test_equal_maps_read_alike(spark):
    a, b = canonical_of(spark, ["map('a', 1, 'b', 2)", "map('b', 2, 'a', 1)"])
    assert a == b


def test_drill_down_finds_rows_with_null_and_large_keys(spark):
    big = 1152921504606846975
    rows = [(None, "x"), (1, "a"), (big, "b"), (-5, "c")]
    src = spark.createDataFrame(rows, "k long, v string")
    tgt = spark.createDataFrame([(None, "y"), (1, "a"), (big, "B"), (-5, "c")], "k long, v string")
    assert sorted((str(r["k"]), r["difference"]) for r in reconcile.drill_down(src, tgt, "k", 1000).collect()) == [(str(big), "changed"), ("None", "changed")]
    starts = {r["range_start"] for r in reconcile.range_fingerprints(src, tgt, "k", 1000).collect()}
    assert starts == {None, 0, 1152921504606846000, -1000}


def test_one_broken_table_is_an_error_row_and_the_others_go_on(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    got = {r["table_name"]: r for r in reconcile.reconcile_tables({"good": (a, a), "bad": (a, a.drop("v"))}).collect()}
    assert got["good"]["status"] == "MATCH" and got["good"]["data_match"]
    assert got["bad"]["status"] == "ERROR" and "v" in got["bad"]["checksum_note"] and not got["bad"]["row_count_match"]
    assert [r["status"] for r in reconcile.reconcile_tables({"bad": (a, a.drop("v"))}).collect()] == ["ERROR"]


def test_a_fault_while_a_check_runs_is_an_error(spark):
    child = spark.createDataFrame([("1",), ("x",)], "p string").selectExpr("cast(p as int) as p")
    parent = spark.createDataFrame([(1,)], "id int")
    keys = [integrity.ForeignKey("fk", "child", ("p",), "parent", ("id",))]
    row = integrity.check_referential_integrity(spark, {"child": child, "parent": parent}, keys).first()
    assert row["status"] == "ERROR" and "CAST" in row["detail"].upper()


def test_only_a_missing_path_is_an_empty_store(spark, tmp_path):
    assert read_store(spark, f"{tmp_path}/nothing") is None
    (tmp_path / "odd").mkdir()
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        read_store(spark, f"{tmp_path}/odd")


def test_rows_at_and_beyond_the_mark(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id int, at int, v string")
    first = rows((1, 4, "a"), (2, 4, "b"), (None, 4, "n"), (7, None, "x"))
    loaded = changes.marked_rows(first, "at", 4)
    # Key 1 was updated later, key 2 at the very mark, key 3 and a second row without a key came late.
    now = rows((1, 5, "a2"), (2, 4, "b2"), (3, 4, "c"), (None, 4, "n"), (None, 4, "n"), (7, None, "x"), (8, None, "y"), (0, 3, "old"))
    got = sorted(map(tuple, newer_rows(now, "at", 4, loaded).collect()), key=str)
    assert got == sorted([(1, 5, "a2"), (2, 4, "b2"), (3, 4, "c"), (None, 4, "n"), (8, None, "y")], key=str)
    assert newer_rows(now, "at", None).count() == 8 and newer_rows(now, "at", 4).count() == 5


def test_increments_keep_their_mark_and_survive_a_lost_load(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id int, at int")
    path = f"{tmp_path}/inc"
    assert changes.read_mark(spark, path) == (0, None, None)
    changes.load_increment(rows((1, 1), (2, 2), (3, None)), "at", path)
    # A load that was lost between its rows and its mark left a folder behind.
    rows((99, 99)).write.parquet(f"{path}/data/load=2")
    after = changes.load_increment(rows((1, 1), (2, 2), (3, None), (4, 2), (5, 3)), "at", path)
    assert sorted(r["id"] for r in after.collect()) == [1, 2, 3, 4, 5]
    again = changes.load_increment(rows((5, 3), (3, None), (4, 2)), "at", path)
    assert again.count() == 5 and changes.read_mark(spark, path)[:2] == (3, 3)
    empty = f"{tmp_path}/empty"
    assert changes.load_increment(rows((1, 1)).limit(0), "at", empty).count() == 0
    assert changes.load_increment(rows((6, None)), "at", empty).count() == 1
    assert changes.load_increment(rows((6, None), (7, 1)), "at", empty).count() == 2


def test_a_table_that_fails_while_it_runs_is_an_error_row(spark):
    good = spark.createDataFrame([(1, "a")], "k int, v string")
    bad = good.withColumn("k", F.col("v").cast("int"))
    got = {r["table_name"]: r for r in reconcile.reconcile_tables({"good": (good, good), "bad": (good, bad)}).collect()}
    assert got["good"]["status"] == "MATCH" and got["bad"]["status"] == "ERROR" and "CAST_INVALID_INPUT" in got["bad"]["checksum_note"]


def test_requoting_long_texts_is_linear(spark):
    names = spark.createDataFrame([("j", "work note", "Work Note"), ("j", "t1", "T1"), ("j", "a$b", "A$B")], "job_id string, lower_name string, name string")
    text = "select t1, work note from a$b where t10 = 't1'; " * 1500
    objects = spark.createDataFrame([("j", 0, text)], "job_id string, object_id int, ddl string")
    found = translation.requote_identifiers(objects, names)
    assert "array_append" not in found._jdf.queryExecution().executedPlan().toString()
    start = time.monotonic()
    assert found.first()["ddl"] == 'select "T1", "Work Note" from "A$B" where t10 = \'"T1"\'; ' * 1500
    assert time.monotonic() - start < 10


def test_requoting_takes_the_longest_name_and_leaves_quoted_text(spark):
    objects = spark.createDataFrame([("j", 0, 'pick Work Note, work, "work note", WORK NOTES'), ("j", 1, None), ("k", 2, "work")], "job_id string, object_id int, ddl string")
    names = spark.createDataFrame([("j", "work note", "Work Note"), ("j", "work", "Work"), ("j", "note", "NOTE")], "job_id string, lower_name string, name string")
    found = translation.requote_identifiers(objects, names)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["object_id"]: r["ddl"] for r in found.collect()} == {0: 'pick "Work Note", "Work", "work note", "Work" NOTES', 1: None, 2: "work"}


def test_profiles_compare_least_and_greatest_values_exactly(spark):
    from tidemark.operators.reconcile import profile_compare

    def side(n, d, day, at, text):
        return spark.sql(f"SELECT {n}L AS n, cast({d} AS decimal(38,2)) AS d, date'{day}' AS day, timestamp_ntz'{at}' AS at, '{text}' AS text, 1.0D AS same, array(1) AS list, cast(NULL AS int) AS none")

    one = side(2**53, 2**53, "2024-01-01", "2024-01-01 10:00:00", "abc")
    other = side(2**53 + 1, 2**53 + 1, "2024-01-02", "2024-01-01 10:00:01", "abd")
    flags = {r["column_name"]: r["profile_match"] for r in profile_compare(one, other).collect()}
    assert flags == {"n": False, "d": False, "day": False, "at": False, "text": False, "same": True, "list": True, "none": True}
    assert all(r["profile_match"] for r in profile_compare(one, one).collect())
