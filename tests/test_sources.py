"""Options of JDBC reads and writes, loads, logs and stores."""

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.session import scratch_path
from tidemark.sources import files, jdbc, load, stores, versioned
from tidemark.sources.jdbc import Connection
from tidemark.streaming import changes

PG = Connection("postgresql", "db", "shop", "u", "secret")


def test_urls_and_namespaces():
    assert PG.url == "jdbc:postgresql://db:5432/shop" and PG.namespace == "public"
    my = Connection("mysql", "db", "shop", "u", port=3307)
    assert my.url == "jdbc:mysql://db:3307/shop" and my.namespace == "shop"
    ora = Connection("oracle", "db", "XE", "sample_user")
    assert ora.url == "jdbc:oracle:thin:@//db:1521/XE" and ora.namespace == "SAMPLE_USER"
    assert "secret" not in repr(PG)
    with pytest.raises(ValueError):
        Connection("db2", "h", "d")


def test_read_options():
    plain = jdbc.read_options(PG, "orders")
    assert plain["dbtable"] == '"public"."orders"' and "numPartitions" not in plain
    split = jdbc.read_options(PG, "orders", "id", (1, 900), 16)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "1", "900", "16")
    assert "partitionColumn" not in jdbc.read_options(PG, "empty", "id", (None, None))


def test_hash_predicates_keep_null_keys():
    parts = jdbc.hash_predicates("mysql", "code", 3)
    assert parts[0] == "(mod(crc32(`code`), 3) = 0 OR `code` IS NULL)" and parts[2] == "mod(crc32(`code`), 3) = 2"


def test_write_options(spark):
    schema = spark.createDataFrame([], "id int, name string").schema
    options = jdbc.write_options(PG, "t", schema, {"name": 40})
    assert options["truncate"] == "true" and options["createTableColumnTypes"] == "`name` VARCHAR(40)"


def test_bulk_load_counts_and_isolates_errors(spark):
    out = scratch_path(spark, "t")
    tables = {"a": spark.range(10), "b": spark.range(5), "empty": spark.range(0)}

    def read(name):
        if name == "bad":
            raise RuntimeError("no such table")
        return tables[name]

    report = load.bulk_load(
        spark, "j", [["a", "bad"], ["b", "empty"]], read, lambda df, n: files.write_folder(df, f"{out}/{n}"),
        lambda n: files.read_folder(spark, f"{out}/{n}").count())
    rows = {r["table_name"]: r for r in report.collect()}
    assert (rows["a"]["source_row_count"], rows["a"]["target_row_count"]) == (10, 10)
    assert rows["bad"]["migration_status"] == "ERROR" and "no such table" in rows["bad"]["error"]
    assert rows["empty"]["migration_status"] == "SUCCESS" and rows["empty"]["target_row_count"] == 0
    total = load.load_totals(report).first()
    assert (total["rows_moved"], total["failed_tables"]) == (15, 1)


def test_log_scrape(spark):
    base = scratch_path(spark, "logs")
    text = "start\n| Total Read Count : 12 |\nTotal Write Count  :  7\nTotal Read Count : 99"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/one")
    spark.createDataFrame([("nothing to see",)], "value string").coalesce(1).write.text(f"{base}/two")
    lines = load.read_load_logs(spark, f"{base}/*")
    assert lines.count() == 5
    rows = {(r["rows_read"], r["rows_written"]) for r in load.scrape_load_log(lines).collect()}
    assert rows == {(12, 7), (None, None)}


def test_metrics_of_loads(spark):
    df = spark.createDataFrame([(10, 2.9), (None, 5.0), (4, 0.0), (4, None)], "target_row_count bigint, duration_seconds double")
    got = [(r["rows_migrated"], r["duration_seconds"], r["throughput_rows_per_sec"]) for r in load.load_metrics(df).collect()]
    assert got == [(10, 2, 10 / 2.9), (0, 5, 0.0), (4, 0, None), (4, None, None)]


def catalog(spark, rows):
    return spark.createDataFrame(rows, "job_id int, object_name string, ord bigint")


def test_replace_catalog_keeps_other_jobs(spark):
    path = scratch_path(spark, "cat")
    deps = spark.createDataFrame([(1, "b", ["a"])], "job_id int, child string, dependencies array<string>")
    stores.replace_catalog(catalog(spark, [(1, "a", 1), (1, "b", 2), (2, "x", 1), (3, "y", 1)]), deps, path, buckets=2)
    stores.replace_catalog(catalog(spark, [(1, "c", 1), (3, "y2", 1)]), deps, path, buckets=2)
    rows = sorted((r["job_id"], r["object_name"], tuple(r["dependencies"])) for r in stores.read_catalog(spark, path).collect())
    assert rows == [(1, "c", ()), (2, "x", ()), (3, "y2", ())]


def test_upsert_keeps_first_names_and_last_status(spark):
    events = spark.createDataFrame(
        [("j", "first", "oracle", "mysql", "RUNNING", 1, 0), ("j", "second", "mysql", "oracle", "DONE", 2, 0), ("j", "third", "x", "y", "PAUSED", 2, 1)],
        "job_id string, name string, source_dialect string, target_dialect string, status string, ts int, seq int")
    row = stores.upsert_jobs(events).first()
    assert (row["name"], row["source_dialect"], row["status"], row["created_at"], row["updated_at"]) == ("first", "oracle", "PAUSED", 1, 2)
    parts = [stores.job_states(events.filter(F.col("ts") == 2)), stores.job_states(events.limit(1))]
    again = stores.fold_jobs(parts[0].union(parts[1])).first()
    assert (again["first"]["name"], again["last"]["status"], again["last"]["ts"]) == ("first", "PAUSED", 2)


def test_stores_fold_in_any_order_and_survive_lost_writes(spark):
    path = scratch_path(spark, "versioned")
    fold = changes._fold(["k"])
    schema = "k int, op string, ts int, seq int, v int"
    assert versioned.current(spark, path, fold) is None and versioned.read_manifest(spark, path)[0] == 0
    rows = [(k % 7, "D" if k % 11 == 0 else "U", (k * 37) % 101, k, k) for k in range(120)]
    for part in range(20):
        batch = spark.createDataFrame(rows[part::20], schema)
        versioned.append(batch, path, ["k"], fold, buckets=3, fan=3)
        if part == 9:
            # A write that was lost before its manifest, and a replayed one.
            versioned._write_folder(spark.createDataFrame([(1, "U", 999, 0, -1)], schema).withColumn("bucket", F.lit(0)), path, 99)
            versioned.append(batch, path, ["k"], fold, buckets=50, fan=3)
    versioned.append(spark.createDataFrame([], schema), path, ["k"], fold, fan=3)
    want = {}
    for k, op, ts, seq, v in sorted(rows, key=lambda r: (r[2], r[3])):
        want[k] = (op, v)
    state = lambda: {r["k"]: (r["op"], r["v"]) for r in versioned.current(spark, path, fold).collect()}
    assert state() == want
    _, manifest = versioned.read_manifest(spark, path)
    assert manifest["buckets"] == 3 and len(manifest["folders"]) < 8 and max(level for _, level in manifest["folders"]) >= 2
    assert versioned.remove_unused(spark, path) > 15 and state() == want
    with pytest.raises(RuntimeError, match="someone else"):
        versioned.write_manifest(spark, path, versioned.read_manifest(spark, path)[0], manifest)


def test_knowledge_base_is_replaced(spark):
    path = scratch_path(spark, "kb")
    docs = spark.createDataFrame([(1, [0.5]), (2, [0.25])], "id int, embedding array<float>")
    assert stores.replace_knowledge_base(docs, path) == 2 == stores.replace_knowledge_base(docs, path)


def test_folders_in_several_formats(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    for fmt in ("parquet", "orc", "csv", "json"):
        path = scratch_path(spark, fmt)
        files.write_folder(df, path, fmt=fmt)
        files.write_folder(df, path, fmt=fmt)
        back = files.read_folder(spark, path, fmt, df.schema)
        assert sorted(back.collect()) == sorted(df.collect())


def test_every_dialect_answers_every_question():
    from tidemark.sources import system_views as sv

    for dialect, asked in sv.QUESTIONS.items():
        assert set(sv.COLUMNS) - set(asked) <= {"ref_usage"}, dialect
        for name, (chosen, origin) in asked.items():
            whole, held = sv.extract_query(dialect, name), sv.extract_query(dialect, name, ["app", "o'k"])
            # Every column has a name of its own, also those that are no columns of the view.
            assert len(chosen) == len(sv.COLUMNS[name]) and all(f" AS {c}" in whole for c in sv.COLUMNS[name])
            assert " WHERE " not in whole[len(whole) - len(origin) :].replace(origin, "") and held == f"{whole} WHERE {chosen[0]} IN ('app', 'o''k')"
    assert "get_ddl('TABLE'" in sv.extract_query("oracle", "tables")
    assert jdbc.literal("mysql", "a\\b") == "'a\\\\b'" and jdbc.literal("oracle", "a\\b") == "'a\\b'"
    options = jdbc.query_options(PG, "SELECT 1")
    assert options["query"] == "SELECT 1" and options["driver"] == "org.postgresql.Driver" and "dbtable" not in options


def test_tables_without_a_key_are_split():
    pages = jdbc.page_predicates(1000, 4)
    assert pages[0] == "ctid >= '(0,0)'::tid AND ctid < '(250,0)'::tid" and pages[-1] == "ctid >= '(750,0)'::tid" and len(pages) == 4
    # Fewer pages than splits: no empty range, and the end stays open.
    assert jdbc.page_predicates(2, 64) == ["ctid >= '(0,0)'::tid AND ctid < '(1,0)'::tid", "ctid >= '(1,0)'::tid"]
    assert jdbc.row_predicates("oracle", [], 2) == ["mod(ora_hash(rowid), 2) = 0", "mod(ora_hash(rowid), 2) = 1"]
    assert jdbc.row_predicates("mysql", ["a", "b`"], 2)[1] == "mod(crc32(concat_ws('|', `a`, `b```)), 2) = 1"


def test_native_types_reach_a_created_table():
    schema = T.StructType().add("id", "long").add("name", "string").add("price", "double").add("note", "string").add("on", "boolean")
    natives = {"id": "NUMBER(9,0)", "name": "VARCHAR2(40)", "price": "NUMBER(12,2)", "note": "CLOB"}
    options = jdbc.write_options(PG, "t", schema, {"note": 500}, natives=natives, source="oracle")
    assert options["createTableColumnTypes"] == "`id` INT, `name` VARCHAR(40), `price` DECIMAL(12,2), `note` VARCHAR(500)"
    assert "createTableColumnTypes" not in jdbc.write_options(PG, "t", schema, natives={"note": "CLOB"}, source="oracle")


def test_driver_settings_come_from_the_caller():
    plain, own = (jdbc.Connection("mysql", "h", "d", properties=p) for p in ({}, {"sslMode": "VERIFY_CA", "driver": "other"}))
    assert plain.url == own.url == "jdbc:mysql://h:3306/d"
    options = jdbc.read_options(own, "t")
    assert options["sslMode"] == "VERIFY_CA" and options["driver"] == "com.mysql.cj.jdbc.Driver"


def test_a_replaced_catalogue_leaves_its_rows_alone_on_disk(spark, tmp_path):
    from pathlib import Path

    from tidemark.operators import catalog as objects
    from tidemark.session import shared_dir

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
        return {b for b in blocks if b.startswith("shuffle_")}

    def folders():
        top = Path(shared_dir(spark).removeprefix("file:"))
        return {p for kind in ("catalog-*", "dependencies-*", "foreign-keys-*") for p in top.glob(f"tidemark/{kind}")} | set(top.glob("*/rdd-*"))

    listed = spark.createDataFrame(
        [(j, "mysql", "table", "s", n, None, None) for j in range(5) for n in "ab"],
        "job_id bigint, dialect string, object_type string, schema_name string, object_name string, table_name string, definition string",
    )
    # Table a of job 3 has columns of two dialects.
    columns = spark.createDataFrame(
        [(j, d, "s", n, "x", 0, "int", True, None, False) for j in range(5) for n in "ab" for d in ("mysql", "oracle")[: 2 if (j, n) == (3, "a") else 1]],
        "job_id bigint, dialect string, schema_name string, table_name string, column_name string, ordinal int, native_type string, nullable boolean, default_value string, is_primary_key boolean",
    )
    fks = spark.createDataFrame(
        [(1, "mysql", "s", "f", "b", "a", ["x"], ["x"])],
        "job_id bigint, dialect string, schema_name string, constraint_name string, table_name string, ref_table_name string, columns array<string>, ref_columns array<string>",
    )
    before = shuffles(), folders()
    path = f"{tmp_path}/catalog"
    stores.replace_catalog(objects.build_catalog(listed, columns, fks), objects.dependency_lists(objects.dependency_edges(fks)), path, buckets=2)
    assert (shuffles() - before[0], folders() - before[1]) == (set(), set())
    rows = stores.read_catalog(spark, path).collect()
    found = [(r["job_id"], r["ord"], r["object_name"], r["dependencies"]) for r in rows]
    assert sorted(found) == sorted(
        [(j, i + 1, n, ["a"] if (j, n) == (1, "b") else []) for j in (0, 1, 2, 4) for i, n in enumerate("ab")] + [(1, 3, "f", []), (3, 1, "a", []), (3, 2, "a", []), (3, 3, "b", [])]
    )
    texts = {r["definition"] for r in rows if (r["job_id"], r["object_name"]) == (3, "a")}
    assert len(texts) == 2 and all(len(r["columns"]) == 1 for r in rows if r["object_type"] == "table")
