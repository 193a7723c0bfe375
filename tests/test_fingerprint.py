"""The fingerprint sees every change of a row and no change of order, partitioning or number type."""

import datetime as dt
import decimal
import hashlib
import random

from pyspark.sql import functions as F, types as T

from tidemark.functions.canonical import canonical, row_text
from tidemark.operators.fingerprint import group_fingerprints, table_fingerprint
from tidemark.operators.reconcile import reconcile_table, row_diff

ROWS = [(i, f"name {i % 7}", i / 4, None if i % 5 == 0 else i % 2 == 0) for i in range(200)]
SCHEMA = "id bigint, name string, amount double, flag boolean"


def fp(df, **flags):
    row = table_fingerprint(df, **flags).first()
    return row["row_count"], row["fingerprint"]


def plain(value):
    """Cell text by the rule, in Python."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (int, float)):
        return format(decimal.Decimal(str(value)).normalize(), "f")
    return str(value)


def brute(rows):
    return str(sum(int(hashlib.md5("|".join(plain(v) for v in r).encode()).hexdigest()[:15], 16) for r in rows))


def test_equals_brute_force(spark):
    assert fp(spark.createDataFrame(ROWS, SCHEMA)) == (200, brute(ROWS))


def test_order_and_partitions_do_not_matter(spark):
    rows = ROWS[:]
    random.Random(3).shuffle(rows)
    base = fp(spark.createDataFrame(ROWS, SCHEMA))
    assert base == fp(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert base == fp(spark.createDataFrame(rows, SCHEMA).coalesce(1))


def test_every_change_shows(spark):
    base = fp(spark.createDataFrame(ROWS, SCHEMA))[1]
    one_cell = [(*ROWS[0][:2], 99.25, ROWS[0][3]), *ROWS[1:]]
    swapped = [(*r[:1], ROWS[(i + 1) % 200][1], *r[2:]) for i, r in enumerate(ROWS)]
    for rows in (one_cell, ROWS + ROWS[:1], ROWS[1:], ROWS[1:] + ROWS[1:2], swapped, ROWS + ROWS[:1] * 2):
        assert fp(spark.createDataFrame(rows, SCHEMA))[1] != base


def test_empty_table(spark):
    assert fp(spark.createDataFrame([], SCHEMA)) == (0, "0")


def test_numbers_agree_across_types(spark):
    values = [("1", "1"), ("1.0", "1"), ("1.500", "1.5"), ("-0.0", "0"), ("100", "100"), ("1e-5", "0.00001"),
              ("12345678.9", "12345678.9"), ("123456789012", "123456789012"), ("0.001", "0.001")]
    df = spark.createDataFrame(values, "raw string, want string")
    for to in ("double", "decimal(38,18)", "decimal(30,6)"):
        c = F.col("raw").cast("double").cast(to)
        got = df.select("raw", "want", canonical(c, T._parse_datatype_string(to)).alias("got"))
        assert [r for r in got.collect() if r["got"] != r["want"]] == []


def test_whole_decimals_keep_their_zeros(spark):
    df = spark.sql("SELECT cast(100 AS decimal(10,0)) AS a, cast(1000 AS bigint) AS b")
    assert df.select(row_text(df)).first()[0] == "100|1000"


def test_flags_and_nulls(spark):
    df = spark.createDataFrame([("Y", None), ("N", "")], "flag string, note string")
    bools = spark.createDataFrame([(True, ""), (False, None)], "flag boolean, note string")
    assert fp(df, yes_no_as_flag=True) == fp(bools)
    assert fp(df, null_as_empty=False) != fp(spark.createDataFrame([("Y", ""), ("N", "")], "flag string, note string"), null_as_empty=False)


def test_date_against_timestamp(spark):
    day = dt.date(2024, 5, 1)
    src = spark.createDataFrame([(1, dt.datetime(2024, 5, 1))], "id int, at timestamp_ntz")
    tgt = spark.createDataFrame([(day, 1)], "AT date, ID int")
    row = reconcile_table("t", src, tgt).first()
    assert row["status"] == "MATCH" and row["data_match"]


def test_status_follows_counts_only(spark):
    src = spark.createDataFrame(ROWS, SCHEMA)
    changed = src.withColumn("amount", F.col("amount") + 1)
    row = reconcile_table("t", src, changed).first()
    assert row["status"] == "MATCH" and row["row_count_match"] and not row["data_match"] and row["checksum_note"]
    assert reconcile_table("t", src, src.limit(0)).first()["status"] == "MISMATCH"


def test_group_fingerprints_add_up(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    parts = group_fingerprints(df, ["name"]).collect()
    assert sum(int(r["fingerprint"]) for r in parts) == int(brute(ROWS))


def test_row_diff_with_repeated_keys(spark):
    src = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (3, "y"), (4, "z"), (4, "z")], "k int, v string")
    tgt = spark.createDataFrame([(1, "b"), (1, "a"), (2, "X"), (4, "z"), (5, "n")], "k int, v string")
    got = {r["k"]: r["difference"] for r in row_diff(src, tgt, ["k"]).collect()}
    assert got == {2: "changed", 3: "only_source", 4: "changed", 5: "only_target"}


def test_maps_inside_structs_and_arrays_read_alike(spark):
    kind = "s struct<m:map<string,struct<z:map<int,string>>>,n:int>, a array<struct<m:map<string,int>>>, l array<map<string,int>>"
    one = [(({"a": ({1: "x", 2: "y"},), "b": (None,)}, 1), [({"p": 1, "q": None},), None], [{"k": 1, "j": 2}, None]), (None, None, None)]
    two = [(({"b": (None,), "a": ({2: "y", 1: "x"},)}, 1), [({"q": None, "p": 1},), None], [{"j": 2, "k": 1}, None]), (None, None, None)]
    three = [(({"b": (None,), "a": ({2: "y", 1: "z"},)}, 1), [({"q": None, "p": 1},), None], [{"j": 2, "k": 1}, None]), (None, None, None)]
    texts = [[r[0] for r in spark.createDataFrame(x, kind).select(row_text(spark.createDataFrame(x, kind))).collect()] for x in (one, two, three)]
    assert texts[0] == texts[1] and texts[0][0] != texts[2][0] and texts[0][1] == "||"
