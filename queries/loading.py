"""Loads, load results, platform tables and the sample schema's objects."""

from pyspark.sql import functions as F

from queries import catalog as cat
from queries import estate  # noqa: F401  (fixtures)
from queries.base import BASE_TABLES, FIXTURES, RELATIONAL, query
from queries.reconcile import sql_print
from tidemark.operators import catalog, fingerprint, reconcile, sample_objects
from tidemark.plans.waves import load_waves
from tidemark.session import scratch_path
from tidemark.sources import files, load, stores


def _copy_all(t, names, waves, fail=()):
    """Load tables into a new folder; names in ``fail`` do not exist on the source."""
    target = scratch_path(t.spark, "load")
    report = load.bulk_load(
        t.spark, "job-1", waves,
        read=lambda n: files.read_folder(t.spark, f"{t.sf_dir}/{'missing_' if n in fail else ''}{n}.parquet"),
        write=lambda df, n: files.write_folder(df, f"{target}/{n}"),
        count_target=lambda n: files.read_folder(t.spark, f"{target}/{n}").count(),
    )
    return target, report


SQL_PRINTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, n AS row_count, fp AS fingerprint FROM ({sql_print(n, n)}) x" for n in BASE_TABLES)


@query("read_table", SQL_PRINTS)
def read_table(t):
    # The fingerprint needs every column of every row.
    return reconcile.union_all([
        fingerprint.table_fingerprint(files.read_folder(t.spark, f"{t.sf_dir}/{n}.parquet")).select(
            F.lit(n).alias("table_name"), "row_count", "fingerprint"
        )
        for n in BASE_TABLES
    ])


@query("write_table", SQL_PRINTS)
def write_table(t):
    target = scratch_path(t.spark, "write")
    out = []
    for n in BASE_TABLES:
        # Written twice: the second load must replace the first, not add to it.
        files.write_folder(getattr(t, n), f"{target}/{n}")
        files.write_folder(getattr(t, n), f"{target}/{n}")
        back = t.spark.read.parquet(f"{target}/{n}")
        out.append(fingerprint.table_fingerprint(back).select(F.lit(n).alias("table_name"), "row_count", "fingerprint"))
    return reconcile.union_all(out)


_PARENTS = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"),
            ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")]
_WAVE = {"region": 0, "part": 0, "nation": 1, "customer": 2, "supplier": 2, "orders": 3, "lineitem": 4}


@query("bulk_load", " UNION ALL ".join(
    f"SELECT 'job-1' AS job_id, '{n}' AS table_name, {_WAVE[n]} AS wave, 'SUCCESS' AS migration_status, count(*) AS source_row_count, "
    f"count(*) AS target_row_count FROM {n}" for n in RELATIONAL
))
def bulk_load(t):
    tables = t.spark.createDataFrame([("job-1", n, i) for i, n in enumerate(RELATIONAL)], "job_id string, table_name string, ord int")
    edges = t.spark.createDataFrame([("job-1", c, p) for c, p in _PARENTS], "job_id string, child string, parent string")
    _, report = _copy_all(t, RELATIONAL, load.waves_of(load_waves(tables, edges)))
    return report.drop("duration_seconds", "error")


@query("bulk_load_error", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, " + ("'ERROR' AS migration_status, NULL AS source_row_count, NULL AS target_row_count" if n == "orders"
    else f"'SUCCESS' AS migration_status, (SELECT count(*) FROM {n}) AS source_row_count, (SELECT count(*) FROM {n}) AS target_row_count")
    for n in ("nation", "orders", "lineitem")
))
def bulk_load_error(t):
    _, report = _copy_all(t, RELATIONAL, [["nation", "orders"], ["lineitem"]], fail=("orders",))
    return report.select("table_name", "migration_status", "source_row_count", "target_row_count")


# Load results: each order is the load of one table of the customer's job.
FIXTURES["loads"] = """
SELECT o_custkey AS job_id, o_orderkey AS load_id, o_orderpriority AS table_name, CASE WHEN o_orderstatus = 'F' THEN 'ERROR' ELSE 'SUCCESS' END AS migration_status,
       o_orderkey + 1 AS source_row_count, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey + 1 END AS target_row_count,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN 0.0 ELSE o_totalprice / 1000 END AS duration_seconds
FROM {orders}"""


@query("load_metrics", """
SELECT job_id, load_id, table_name, migration_status, source_row_count, target_row_count, coalesce(target_row_count, 0) AS rows_migrated,
       cast(floor(duration_seconds) AS int) AS duration_seconds,
       round(CASE WHEN duration_seconds > 0 THEN coalesce(target_row_count, 0) / duration_seconds END, 6) AS throughput_rows_per_sec FROM {loads} l""")
def load_metrics(t):
    return load.load_metrics(t.loads).withColumn("throughput_rows_per_sec", F.round("throughput_rows_per_sec", 6))


@query("load_totals", """
SELECT job_id, cast(coalesce(sum(target_row_count) FILTER (migration_status = 'SUCCESS'), 0) AS bigint) AS rows_moved,
       count(*) FILTER (migration_status <> 'SUCCESS') AS failed_tables FROM {loads} l GROUP BY job_id""")
def load_totals(t):
    return load.load_totals(t.loads)


@query("throughput", """
SELECT l.job_id, load_id, table_name, round(CASE WHEN s > 0 THEN coalesce(target_row_count, 0) / s ELSE 0 END, 6) AS rows_per_second
FROM {loads} l JOIN (SELECT job_id, sum(duration_seconds) AS s FROM {loads} m GROUP BY job_id) p ON p.job_id = l.job_id""")
def throughput(t):
    from tidemark.operators import metrics

    return metrics.throughput(t.loads).select("job_id", "load_id", "table_name", F.round("rows_per_second", 6).alias("rows_per_second"))


# Where all tables of a job load side by side, its phase ends with the slowest; every tenth job's phase was not timed.
FIXTURES["load_phases"] = "SELECT job_id, max(duration_seconds) AS phase_seconds FROM {loads} l WHERE job_id % 10 > 0 GROUP BY job_id"


@query("throughput_side_by_side", """
SELECT l.job_id, load_id, table_name, round(CASE WHEN phase_seconds > 0 THEN coalesce(target_row_count, 0) / phase_seconds ELSE 0 END, 6) AS rows_per_second
FROM {loads} l LEFT JOIN {load_phases} p ON p.job_id = l.job_id""")
def throughput_side_by_side(t):
    from tidemark.operators import metrics

    found = metrics.throughput(t.loads, t.load_phases)
    return found.select("job_id", "load_id", "table_name", F.round("rows_per_second", 6).alias("rows_per_second"))


# Logs of load jobs, one per order; some repeat a count later on, some never tell one.
_LINES = [
    "concat('INFO start ', o_orderpriority)",
    "CASE WHEN o_orderstatus = 'P' THEN 'WARN no statistics' ELSE concat('Total Read Count  :  ', o_orderkey + 3) END",
    "concat('| Total Write Count : ', o_custkey, ' rows |')",
    "concat('Total Read Count : ', o_custkey * 2)",
    "'Total Write Count : 1'",
]
FIXTURES["load_logs"] = (
    f"SELECT o_orderkey AS job_id, p AS line_no, l AS line FROM {{orders}} LATERAL VIEW posexplode(array({', '.join(_LINES)})) x AS p, l",
    "SELECT job_id, unnest(range(5)) AS line_no, unnest(lines) AS line FROM (SELECT o_orderkey AS job_id, [" + ", ".join(_LINES) + "] AS lines FROM {orders}) x",
)


@query("scrape_load_log", r"""
SELECT job_id, cast(arg_min(r, line_no) FILTER (r <> '') AS bigint) AS rows_read, cast(arg_min(w, line_no) FILTER (w <> '') AS bigint) AS rows_written
FROM (SELECT *, regexp_extract(line, 'Total Read Count\s*:\s*(\d+)', 1) AS r, regexp_extract(line, 'Total Write Count\s*:\s*(\d+)', 1) AS w FROM {load_logs} l) x
GROUP BY job_id""")
def scrape_load_log(t):
    return load.scrape_load_log(t.load_logs)


@query("replace_catalog", f"""
WITH c AS ({cat.SQL_CATALOG}), d AS (SELECT job_id, child, string_agg(parent, ',' ORDER BY seen) AS deps FROM ({cat.SQL_EDGES}) e GROUP BY job_id, child)
SELECT c.job_id, c.object_type, c.object_name, c.schema_name, c.definition, coalesce(d.deps, '') AS dependencies
FROM c LEFT JOIN d ON d.job_id = c.job_id AND d.child = c.object_name""")
def replace_catalog(t):
    deps = catalog.dependency_lists(catalog.dependency_edges(cat.fks_of(t)))
    path = scratch_path(t.spark, "catalog")
    stores.replace_catalog(cat.catalog_of(t), deps, path)
    back = stores.read_catalog(t.spark, path)
    return back.select(
        F.col("job_id").cast("bigint").alias("job_id"), "object_type", "object_name", "schema_name", "definition",
        F.array_join("dependencies", ",").alias("dependencies"),
    )


FIXTURES["job_events"] = """
SELECT user_id AS job_id, ts, event_id AS seq, concat(event_type, '-job-', event_id) AS name, CASE WHEN value > 20 THEN 'oracle' ELSE 'mysql' END AS source_dialect,
       'postgresql' AS target_dialect, CASE event_type WHEN 'error' THEN 'ABORTED' WHEN 'purchase' THEN 'DONE' ELSE 'RUNNING' END AS status FROM {events}"""


@query("upsert_jobs", """
SELECT job_id, arg_min(name, (ts, seq)) AS name, arg_min(source_dialect, (ts, seq)) AS source_dialect, arg_min(target_dialect, (ts, seq)) AS target_dialect,
       arg_max(status, (ts, seq)) AS status, min(ts) AS created_at, max(ts) AS updated_at FROM {job_events} e GROUP BY job_id""")
def upsert_jobs(t):
    return stores.upsert_jobs(t.job_events)


@query("replace_knowledge_base", "SELECT count(*) AS documents, count(DISTINCT vec_id) AS distinct_documents, min(len(embedding)) AS dimension FROM embeddings")
def replace_knowledge_base(t):
    path = scratch_path(t.spark, "knowledge")
    stores.replace_knowledge_base(t.embeddings, path)
    stores.replace_knowledge_base(t.embeddings, path)
    return t.spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("vec_id").alias("distinct_documents"), F.min(F.size("embedding")).alias("dimension")
    )


@query("active_rows", "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def active_rows(t):
    flag = F.col("o_orderstatus") == "O"
    return sample_objects.active_rows(t.orders, flag, ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])


@query("active_rows_flag", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
def active_rows_flag(t):
    flagged = t.orders.withColumn("is_active", F.when(F.col("o_orderstatus") == "F", "N").otherwise("Y"))
    return sample_objects.active_rows(flagged, sample_objects.is_on(F.col("is_active")), ["o_orderkey", "o_orderpriority"])


SQL_COUNTS = """SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS row_count FROM customer c"""


@query("count_for_key", SQL_COUNTS)
def count_for_key(t):
    return sample_objects.counts_for_keys(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey")


@query("count_function", SQL_COUNTS)
def count_function(t):
    t.orders.createOrReplaceTempView("tidemark_orders")
    t.customer.createOrReplaceTempView("tidemark_customer")
    sample_objects.create_count_function(t.spark, "orders_of", "tidemark_orders", "o_custkey")
    return t.spark.sql("SELECT c_custkey, orders_of(c_custkey) AS row_count FROM tidemark_customer")


@query("lower_on_write", "SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def lower_on_write(t):
    path = scratch_path(t.spark, "trigger")
    files.write_folder(sample_objects.lower_on_write(t.customer, "c_name"), path)
    return t.spark.read.parquet(path)


FIXTURES["sparse_orders"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_totalprice > 200000 END AS is_active,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS created_at FROM {orders}"""


@query("with_defaults", """SELECT o_orderkey, coalesce(status, 'ACTIVE') AS status, coalesce(is_active, true) AS is_active,
coalesce(created_at, timestamp '2024-01-01 00:00:00') AS created_at FROM {sparse_orders} o""")
def with_defaults(t):
    return sample_objects.with_defaults(t.sparse_orders, {
        "status": F.lit("ACTIVE"), "is_active": F.lit(True), "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
    })
