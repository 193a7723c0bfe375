"""Identifier rules and cleaning of DDL text."""

from pyspark.sql import functions as F

from tidemark.functions import ddl_text, native_types
from tidemark.functions.names import is_safe_identifier, is_system_schema, quote_ident
from tidemark.operators import translation
from tidemark.operators.catalog import schema_script


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_identifiers(spark):
    good = ["employees", "_x", "A$1", "t#2"]
    bad = ["1abc", "a b", "x;drop", "", 'a"b', "a-b"]
    rows = spark.createDataFrame([(n,) for n in good + bad], "n string").select("n", is_safe_identifier(F.col("n")).alias("ok")).collect()
    assert [r["n"] for r in rows if r["ok"]] == good


def test_quoting(spark):
    q = quote_ident(F.col("d"), F.col("n"))
    assert one(spark, q, d="postgresql", n='we"ird') == '"we""ird"'
    assert one(spark, q, d="mysql", n="we`ird") == "`we``ird`"
    assert one(spark, q, d="oracle", n="emp") == '"EMP"'


def test_system_schemas(spark):
    s = is_system_schema(F.col("d"), F.col("s"))
    assert one(spark, s, d="oracle", s="sys") and not one(spark, s, d="postgresql", s="SYS")
    assert one(spark, s, d="mysql", s="performance_schema") and not one(spark, s, d="mysql", s="MYSQL")


def test_types(spark):
    t = native_types.canonical_type(F.col("d"), F.col("n"))
    assert one(spark, t, d="oracle", n="DATE") == "TIMESTAMP"
    assert one(spark, t, d="mysql", n="varchar(10)") == "VARCHAR"
    assert one(spark, t, d="postgresql", n="double precision") == "DOUBLE"
    assert one(spark, t, d="postgresql", n="money") is None


def test_noise(spark):
    ddl = "CREATE OR REPLACE force EDITIONABLE VIEW\tx AS SELECT enforce,  'FORCE' FROM t"
    assert one(spark, ddl_text.strip_oracle_noise(F.col("t")), t=ddl) == "CREATE OR REPLACE VIEW x AS SELECT enforce, '' FROM t"
    assert one(spark, ddl_text.strip_oracle_noise(F.col("t")), t="éFORCE NONEDITIONABLE x") == "éFORCE x"


def test_unescape(spark):
    u = ddl_text.unescape_ddl(F.col("t"))
    assert one(spark, u, t=r"a\nb\tc\"d\\e") == 'a\nb\tc"d\\e'
    assert one(spark, u, t=r"keep\\nthis") == "keep\\nthis"
    assert one(spark, u, t="naïve ünïcode") == "naïve ünïcode"


def test_schema_remap(spark):
    m = ddl_text.remap_schema(F.col("t"), F.col("s"), F.col("g"), F.col("d"))
    ask = lambda t, d, s="SAMPLE_USER", g="Sample": one(spark, m, t=t, s=s, g=g, d=d)
    assert ask('FROM "sample_user"."X"', "postgresql") == 'FROM "sample"."X"'
    assert ask('"SAMPLE_USER"', "postgresql") == '"SAMPLE_USER"'
    assert ask("FROM `sample_user`.`X`, SAMPLE_USER.y", "mysql") == "FROM `X`, y"
    assert ask('FROM "SAMPLE_USER"."X"', "oracle") == 'FROM "SAMPLE_USER"."X"'
    assert ask("a.bXc.t, a.b.c", "mysql", s="a.b") == "a.bXc.t, c"
    assert ask('"a$b".x', "postgresql", s="a$b", g="n$1\\") == '"n$1\\".x'


def requoted(spark, texts, names):
    objects = spark.createDataFrame([("j", i, t) for i, t in enumerate(texts)], "job_id string, object_id int, ddl string")
    case_map = spark.createDataFrame([("j", n.lower(), n) for n in names], "job_id string, lower_name string, name string")
    return [r["ddl"] for r in translation.requote_identifiers(objects, case_map).orderBy("object_id").collect()]


def test_requote(spark):
    got = requoted(
        spark,
        ["SELECT * FROM employees", 'SELECT "employees".Emp_Id FROM employees', "employees_old, x.EMP_ID", "nothing here", "Work Note and work", "größe"],
        ["EMPLOYEES", "EMP_ID", "Work Note", "Work", "Größe"],
    )
    assert got == [
        'SELECT * FROM "EMPLOYEES"', 'SELECT "employees"."EMP_ID" FROM "EMPLOYEES"', 'employees_old, x."EMP_ID"', "nothing here",
        '"Work Note" and "Work"', '"Größe"',
    ]


def test_clean_ddl_leaves_oracle_targets_alone(spark):
    rows = [("j", 1, "oracle", "S", "t", r"CREATE  FORCE VIEW a\nb"), ("j", 2, "postgresql", "S", "T", r'CREATE FORCE VIEW "S"."V" AS\nSELECT emp')]
    objects = spark.createDataFrame(rows, "job_id string, object_id int, target_dialect string, source_schema string, target_schema string, ddl string")
    names = spark.createDataFrame([("j", "emp", "EMP")], "job_id string, lower_name string, name string")
    got = {r["object_id"]: r["ddl"] for r in translation.clean_ddl(objects, names).collect()}
    assert got == {1: r"CREATE  FORCE VIEW a\nb", 2: 'CREATE VIEW "t"."V" AS\nSELECT "EMP"'}


def test_confidences(spark):
    answers = [
        ('{"Answer": "SELECT 1", "Reasoning": "trivial", "Confidence": 0.9 }', 0.9),
        ('{"Answer": "SELECT 2",\n "Reasoning": "two\nlines", "Confidence": "0.8" }', 0.8),
        ("not a match", None), ('{"Answer": "x", "Reasoning": "y", "Confidence": high }', None), (None, None),
    ]
    df = spark.createDataFrame(answers, "a string, want double").select("want", ddl_text.confidence(F.col("a")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_scores(spark):
    told = '{"Answer": "x", "Reasoning": "y", "Confidence": %s }'
    cases = [
        ("none", "hybrid", 0, [], 1.0), ("warned", "hybrid", 1, ["Warning: No piece find"], 0.95), ("vague", "hybrid", 0, ["?"], 0.75),
        ("mean", "hybrid", 2, [told % 0.9, told % 0.8], 0.75), ("floor", "hybrid", 30, [], 0.0), ("model", "model_only", 1, [told % 0.88], 0.63),
        ("model_floor", "model_only", 9, [], 0.2), ("rule", "rule_only", 3, [], 0.5), ("lost", "failed", 0, [told % 0.9], 0.0),
    ]
    objects = spark.createDataFrame([("j", n, m, k) for n, m, k, _, _ in cases], "job_id string, object_name string, method string, lifts int")
    answers = spark.createDataFrame([("j", n, a) for n, _, _, xs, _ in cases for a in xs], "job_id string, object_name string, content string")
    got = {r["object_name"]: r["confidence"] for r in translation.score_translation(objects, answers).collect()}
    assert got == {n: want for n, _, _, _, want in cases}


def test_status(spark):
    rows = [("table", "x", None, None, None), ("view", None, None, None, None), ("view", "x", "boom", None, 0.9), ("view", "x", None, None, 0.0),
            ("view", "x", None, "y", 0.7), ("view", "x", None, "y", 0.71)]
    df = spark.createDataFrame([("j", *r) for r in rows], "job_id string, object_type string, source_ddl string, error string, target_ddl string, confidence double")
    got = [(r["status"], r["low_confidence"]) for r in translation.translation_status(df).collect()]
    assert got == [("SKIPPED_TABLE", False), ("NO_SOURCE_DDL", True), ("ERROR", True), ("FAILED", True), ("SUCCESS", True), ("SUCCESS", False)]
    only_table = translation.average_confidence(translation.translation_status(df.limit(1))).first()
    assert only_table["average_confidence"] is None


def test_script(spark):
    rows = [("j", 1, "table", "s", "t", "CREATE TABLE t ();;  \n"), ("j", 2, "view", "s", "v", None), ("j", 3, "table", "s", "u", "CREATE TABLE u ()")]
    df = spark.createDataFrame(rows, "job_id string, ord bigint, object_type string, schema_name string, object_name string, definition string")
    assert [r["script"] for r in schema_script(df).collect()] == ["-- TABLE: s.t\nCREATE TABLE t ();\n\n-- TABLE: s.u\nCREATE TABLE u ();"]
