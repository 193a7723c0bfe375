"""Totals and sample records against plain Python; types by pair of dialects."""

import datetime as dt
import decimal
import hashlib
import random

import pytest

from tidemark.operators import convert
from tidemark.operators.reconcile import profile_totals, sample_records

KINDS = "k int, big bigint, n decimal(38,2), d double, flag boolean, t string, b binary, day date, at timestamp_ntz, l array<int>"


def _rows(n, seed):
    rng = random.Random(seed)
    some = lambda v: None if rng.random() < 0.2 else v
    return [
        (i, some(rng.randrange(-10**17, 10**17)), some(decimal.Decimal(rng.randrange(10**9)) / 100), some(rng.randrange(1000) / 8), some(rng.random() < 0.5),
         some(rng.choice(["", "a", "é日本", "x" * 500])), some(bytes([i % 256, 0])), some(dt.date(1960, 1, 1) + dt.timedelta(days=i)),
         some(dt.datetime(1969, 1, 1, 0, 0, 0, 17) + dt.timedelta(hours=i * 31)), some([i]))
        for i in range(n)
    ]


def _total(values):
    kept = [v for v in values if v is not None]
    if not kept or isinstance(kept[0], list):
        return None
    if isinstance(kept[0], dt.datetime):
        number = sum((v - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for v in kept)
    elif isinstance(kept[0], dt.date):
        number = sum((v - dt.date(1970, 1, 1)).days for v in kept)
    elif isinstance(kept[0], (str, bytes)):
        number = sum(map(len, kept))
    else:
        number = sum(decimal.Decimal(v) for v in kept)
    text = f"{decimal.Decimal(number):f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def test_totals_equal_plain_sums(spark):
    rows = _rows(400, 3)
    src = spark.createDataFrame(rows, KINDS)
    got = {r["column_name"]: r for r in profile_totals(src.repartition(5), src.repartition(3)).collect()}
    for place, name in enumerate(src.columns):
        row = got[name]
        assert row["total_source"] == row["total_target"] == _total([r[place] for r in rows]), name
        assert row["totals_match"] and row["values_source"] == sum(r[place] is not None for r in rows)
    assert got["l"]["least_source"] is None and got["l"]["unsummed_source"] == got["l"]["values_source"]
    assert got["t"]["least_source"] == "" and got["k"]["greatest_source"] == "399"


def test_totals_find_what_least_and_greatest_miss(spark):
    src = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 9.0)], "k int, v double")
    tgt = spark.createDataFrame([(1, 1.0), (2, 5.000001), (3, 9.0)], "k int, v double")
    row = profile_totals(src, tgt).filter("column_name = 'v'").first()
    assert (row["total_source"], row["total_target"], row["totals_match"]) == ("15", "15.000001", False)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (2.5,), (None,)], "v double")
    row = profile_totals(odd, odd).first()
    assert (row["values_source"], row["unsummed_source"], row["total_source"], row["totals_match"]) == (4, 3, "2.5", True)
    none = profile_totals(odd.limit(0), odd.limit(0)).first()
    assert (none["values_source"], none["total_source"], none["least_source"], none["totals_match"]) == (0, None, None, True)
    huge = spark.createDataFrame([(decimal.Decimal(9 * 10**37),)] * 3, "v decimal(38,0)")
    assert profile_totals(huge, huge).first()["total_source"] == "\\N"


def test_samples_are_the_same_keys_on_every_run(spark):
    rows = [(i % 90 if i % 11 else None, f"v{i}") for i in range(300)]
    changed = [(k, v + "!" if k is not None and k % 3 == 0 else v) for k, v in rows if k != 7] + [(1000, "new")]
    src, tgt = spark.createDataFrame(rows, "k int, v string"), spark.createDataFrame(changed, "k int, v string")
    text = lambda k: "" if k is None else str(k)
    place = lambda k: hashlib.md5(text(k).encode()).hexdigest()
    by_key = lambda data: {k: sorted(f"{text(k)}|{v}" for key, v in data if key == k) for k in {key for key, _ in data}}
    a, b = by_key(rows), by_key(changed)
    differ = [k for k in {*a, *b} if a.get(k) != b.get(k)]
    for pool, differing in ((differ, True), ({*a, *b}, False)):
        for parts in (1, 6):
            got = sample_records(src.repartition(parts), tgt.repartition(parts), ["K"], 8, differing).collect()
            expected = sorted(pool, key=place)[:8]
            assert {r["k"] for r in got} == set(expected) and len(got) == 8
            for r in got:
                left, right = a.get(r["k"], []), b.get(r["k"], [])
                assert (r["records_source"], r["records_target"]) == (len(left), len(right))
                assert (r["record_source"], r["record_target"]) == (left[0] if left else None, right[0] if right else None)
    assert sample_records(src, src, ["k"], 8).count() == 0
    assert sample_records(src, tgt, ["k"], 10_000).count() == len(differ)


@pytest.mark.parametrize("native, kind", [
    ("NUMBER(4,0)", "smallint"), ("NUMBER(5)", "int"), ("number(9)", "int"), ("NUMBER(10, 0)", "bigint"), ("NUMBER(19)", "decimal(19,0)"), ("NUMBER(38)", "decimal(38,0)"),
    ("NUMBER(10,2)", "decimal(10,2)"), ("NUMBER(3,-2)", "int"), ("NUMBER(2,5)", "string"), ("NUMBER", "decimal(38,18)"), ("VARCHAR2(30)", "char(30)"), ("DATE", "timestamp_ntz"),
    ("SDO_GEOMETRY", None),
])
def test_types_of_oracle_columns(native, kind):
    assert convert.type_for("oracle", "postgresql", native) == kind


def test_types_without_a_rule_are_named_together():
    with pytest.raises(ValueError, match="a SDO_GEOMETRY, b BFILE"):
        convert.targets_for({"b": "BFILE", "a": "SDO_GEOMETRY", "c": "DATE"}, "oracle", "mysql")


def test_flags_and_texts_that_do_not_fit_are_counted(spark):
    df = spark.createDataFrame([("true", "99999", "x"), ("0", "123456", "yy"), ("maybe", None, "zzz"), (None, "1e2", None)], "f string, n string, c string")
    native = {"f": "boolean", "n": "numeric(5)", "c": "character(2)"}
    got = [tuple(r) for r in convert.convert_between(df, native, "postgresql", "oracle").collect()]
    assert got[:2] == [(1, 99999, "x"), (0, 123456, "yy")] and got[2] == (None, None, None)
    lost = {r["column_name"]: (r["values"], r["failures"]) for r in convert.conversion_failures(df, convert.targets_for(native, "postgresql", "oracle")).collect()}
    assert lost["f"] == (3, 1) and lost["c"] == (3, 1)
