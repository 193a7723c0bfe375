"""Foreign keys, keys, objects and the test report on the damaged copy."""

from pyspark.sql import functions as F

from queries import estate  # noqa: F401  (fixtures)
from queries import reconcile as rec
from queries.base import FIXTURES, RELATIONAL, query
from tidemark.operators import integrity, reconcile
from tidemark.operators.integrity import ForeignKey

# Line items whose supplier was never recorded: NULL keys are not orphans.
FIXTURES["child_null"] = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS l_suppkey FROM {lineitem}"""

FKS = [
    ForeignKey("lineitem_orders", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ForeignKey("lineitem_part", "lineitem", ("l_partkey",), "part", ("p_partkey",)),
    ForeignKey("lineitem_supplier", "lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    ForeignKey("orders_customer", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("customer_nation", "customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("supplier_nation", "supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("nation_region", "nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ForeignKey("labels_documents", "labels", ("doc_id",), "documents", ("doc_id",)),
]


def target_tables(t):
    return {**{n: getattr(t, f"tgt_{n}") for n in RELATIONAL}, "labels": t.labels, "documents": t.documents}


def _src(name: str) -> str:
    return "{tgt_" + name + "}" if name in RELATIONAL else name


def sql_orphans(fk: ForeignKey) -> str:
    return (
        f"SELECT count(*) FROM {_src(fk.child)} c WHERE c.{fk.columns[0]} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {_src(fk.parent)} p WHERE p.{fk.ref_columns[0]} = c.{fk.columns[0]})"
    )


SQL_COUNTS = " UNION ALL ".join(
    f"SELECT '{fk.name}' AS constraint_name, '{fk.label}' AS label, ({sql_orphans(fk)}) AS orphan_rows, {i} AS seq"
    for i, fk in enumerate(FKS)
)
SQL_REFERENTIAL = f"""
SELECT 'referential_integrity' AS "check", CASE WHEN count(*) FILTER (orphan_rows > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
       coalesce(string_agg(label || ': ' || orphan_rows || ' orphan rows', '; ' ORDER BY seq) FILTER (orphan_rows > 0),
                '{integrity.ALL_VALID}') AS detail FROM ({SQL_COUNTS}) c"""


@query("orphan_rows", """
SELECT l.* FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM {tgt_orders} o WHERE o.o_orderkey = l.l_orderkey)""")
def orphan_rows(t):
    return integrity.orphan_rows(t.lineitem, t.tgt_orders, ["l_orderkey"], ["o_orderkey"])


@query("orphan_rows_null_keys", """
SELECT c.* FROM {child_null} c WHERE l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {tgt_supplier} s WHERE s.s_suppkey = c.l_suppkey)""")
def orphan_rows_null_keys(t):
    return integrity.orphan_rows(t.child_null, t.tgt_supplier, ["l_suppkey"], ["s_suppkey"])


@query("orphan_rows_composite", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l WHERE NOT EXISTS (
SELECT 1 FROM lineitem p WHERE p.l_returnflag = 'N' AND p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber)""")
def orphan_rows_composite(t):
    parent = t.lineitem.filter(F.col("l_returnflag") == "N").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))
    child = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return integrity.orphan_rows(child, parent, ["l_orderkey", "l_linenumber"], ["ok", "ln"])


@query("orphan_counts", SQL_COUNTS)
def orphan_counts(t):
    return integrity.orphan_counts(target_tables(t), FKS)


@query("referential_integrity", SQL_REFERENTIAL)
def referential_integrity(t):
    return integrity.check_referential_integrity(t.spark, target_tables(t), FKS)


@query("key_check", """
SELECT count(*) FILTER (n > 1) AS duplicate_keys, cast(coalesce(sum(n) FILTER (n > 1), 0) AS bigint) AS duplicate_rows,
       cast(0 AS bigint) AS null_key_rows, count(*) FILTER (n > 1) = 0 AS key_holds
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) k""")
def key_check(t):
    return integrity.key_check(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("key_check_null", """
SELECT count(*) FILTER (n > 1 AND full_key) AS duplicate_keys, cast(coalesce(sum(n) FILTER (n > 1 AND full_key), 0) AS bigint) AS duplicate_rows,
       cast(coalesce(sum(n) FILTER (NOT full_key), 0) AS bigint) AS null_key_rows, false AS key_holds
FROM (SELECT l_orderkey, l_suppkey, count(*) AS n, l_suppkey IS NOT NULL AS full_key FROM {child_null} c GROUP BY ALL) k""")
def key_check_null(t):
    return integrity.key_check(t.child_null, ["l_orderkey", "l_suppkey"])


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(t):
    return integrity.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


_SERIAL = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}


@query("sequence_reseed", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{k}' AS key_column, cast(max({k}) + 1 AS bigint) AS next_value FROM {n}" for n, k in _SERIAL.items()
))
def sequence_reseed(t):
    return integrity.sequence_reseed({n: (getattr(t, n), k) for n, k in _SERIAL.items()})


# Text columns as an old source may hold them: dates as text with zero dates, names differing by case only.
FIXTURES["legacy_orders"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '0000-00-00' ELSE cast(cast(o_orderdate AS date) AS string) END AS ordered_on,
       CASE WHEN o_orderstatus = 'F' THEN upper(concat('Clerk ', o_orderpriority)) ELSE concat('Clerk ', o_orderpriority) END AS clerk,
       concat(o_orderpriority, '/', o_orderkey) AS reference FROM {orders}"""


@query("premigration_profile", """
SELECT 'over_length' AS finding, 'reference' AS column_name, count(*) FILTER (length(reference) > 14) AS "rows" FROM {legacy_orders} o
UNION ALL SELECT 'over_length', 'clerk', count(*) FILTER (length(clerk) > 20) FROM {legacy_orders} o
UNION ALL SELECT 'zero_date', 'ordered_on', count(*) FILTER (ordered_on LIKE '0000-00-00%') FROM {legacy_orders} o
UNION ALL SELECT 'case_equal_key', 'clerk', cast(coalesce(sum(n), 0) AS bigint) FROM (
  SELECT lower(clerk) AS k, count(*) AS n FROM {legacy_orders} o GROUP BY 1 HAVING count(DISTINCT clerk) > 1) d""")
def premigration_profile(t):
    return integrity.premigration_profile(t.legacy_orders, {"reference": 14, "clerk": 20}, ["ordered_on"], ["clerk"])


# The target of each job: names in the other case, triggers lost in one segment, functions in another.
FIXTURES["target_objects"] = """
SELECT job_id, object_type, CASE WHEN dialect = 'oracle' THEN lower(object_name) ELSE upper(object_name) END AS object_name
FROM {estate_objects} o WHERE object_type <> 'table' AND NOT (object_type = 'trigger' AND segment = 'BUILDING')
AND NOT (object_type = 'function' AND segment IN ('MACHINERY', 'FURNITURE')) AND NOT (object_type = 'foreign_key' AND acctbal < 0)"""
FIXTURES["applied"] = """
SELECT job_id, object_type, object_name, ord AS seq,
       CASE WHEN object_type = 'trigger' THEN 'PENDING_MANUAL_REVIEW' WHEN segment = 'MACHINERY' THEN 'APPLY_FAILED'
            WHEN segment = 'AUTOMOBILE' THEN NULL ELSE 'APPLIED' END AS applied_status,
       CASE WHEN object_type <> 'trigger' AND segment = 'MACHINERY' THEN concat('syntax error near ', object_name) END AS applied_error
FROM {estate_objects} o"""
FIXTURES["unreadable_jobs"] = "SELECT c_custkey AS job_id FROM {customer} c WHERE c_nationkey = 7"

SQL_EXISTENCE = f"""
SELECT o.job_id, o.ord, o.object_type, o.object_name, s.status,
       CASE s.status WHEN 'PENDING_MANUAL_REVIEW' THEN '{integrity.PENDING_DETAIL}' WHEN 'APPLY_FAILED' THEN a.applied_error END AS detail
FROM {{estate_objects}} o
LEFT JOIN {{target_objects}} g ON g.job_id = o.job_id AND g.object_type = o.object_type AND lower(g.object_name) = lower(o.object_name)
LEFT JOIN {{applied}} a ON a.job_id = o.job_id AND a.object_type = o.object_type AND a.object_name = o.object_name
LEFT JOIN {{unreadable_jobs}} u ON u.job_id = o.job_id,
LATERAL (SELECT CASE WHEN u.job_id IS NOT NULL THEN 'ERROR' WHEN g.job_id IS NOT NULL THEN 'PRESENT'
  WHEN a.applied_status IN ('PENDING_MANUAL_REVIEW', 'APPLY_FAILED') THEN a.applied_status ELSE 'MISSING' END AS status) s
WHERE o.object_type <> 'table'"""


def existence_of(t):
    return integrity.object_existence(t.estate_objects, t.target_objects, t.applied, t.unreadable_jobs)


@query("object_existence", SQL_EXISTENCE)
def object_existence(t):
    return existence_of(t)


SQL_COMPAT = f"""
SELECT job_id, 'schema_compatibility' AS "check", CASE WHEN bool_and(status IN ('PRESENT', 'PENDING_MANUAL_REVIEW')) THEN 'PASS' ELSE 'FAIL' END AS status,
       count(*) FILTER (status = 'PRESENT') || '/' || count(*) || ' translated objects present on target' AS detail
FROM ({SQL_EXISTENCE}) e GROUP BY job_id"""


@query("schema_compatibility", SQL_COMPAT)
def schema_compatibility(t):
    return integrity.schema_compatibility(existence_of(t), t.jobs)


SQL_MISSING = f"""
WITH e AS ({SQL_EXISTENCE}), m AS (SELECT job_id, count(*) FILTER (status IN ('MISSING', 'APPLY_FAILED', 'ERROR')) AS missing FROM e GROUP BY 1),
     p AS (SELECT job_id, (ord - 1) // SIZE AS part_no, string_agg(object_type || ':' || object_name, ', ' ORDER BY ord) AS txt
           FROM e WHERE status IN ('MISSING', 'APPLY_FAILED', 'ERROR') GROUP BY ALL)
SELECT m.job_id, 'missing_objects' AS "check", CASE WHEN missing = 0 THEN 'PASS' ELSE 'FAIL' END AS status, missing,
       cast(coalesce(p.part_no, 0) AS bigint) AS part_no,
       CASE WHEN missing = 0 THEN '{integrity.NONE_MISSING}' ELSE missing || ' missing/failed: ' || p.txt END AS detail
FROM m LEFT JOIN p ON p.job_id = m.job_id"""


@query("missing_objects", SQL_MISSING.replace("SIZE", "1000"))
def missing_objects(t):
    return integrity.missing_objects(existence_of(t))


@query("missing_objects_parts", SQL_MISSING.replace("SIZE", "4"))
def missing_objects_parts(t):
    return integrity.missing_objects(existence_of(t), part_size=4)


# Seconds differ from run to run; counts and verdicts within an hour must not.
PATIENCE = 3600.0


def _lost_table():
    raise LookupError("no such table: lost")


def timings_of(t, lost: bool):
    tables = {n: getattr(t, n) for n in RELATIONAL}
    return integrity.performance_smoke(t.spark, {**tables, "lost": _lost_table} if lost else tables, PATIENCE)


@query("performance_smoke", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count, 'OK' AS status, NULL AS error FROM {n}" for n in RELATIONAL
) + " UNION ALL SELECT 'lost', NULL, 'ERROR', 'no such table: lost'")
def performance_smoke(t):
    return timings_of(t, lost=True).drop("seconds")


@query("smoke_check", f"""
SELECT 'all' AS tables, 'performance_smoke' AS "check", 'PASS' AS status, 'All {len(RELATIONAL)} table(s) respond within 3600s' AS detail
UNION ALL SELECT 'with a lost one', 'performance_smoke', 'ERROR', 'no such table: lost'
UNION ALL SELECT 'at no patience', 'performance_smoke', 'FAIL', 'Slow tables (> 0s): ' || count(*) FROM (
{" UNION ALL ".join(f"SELECT DISTINCT '{n}' FROM {n}" for n in RELATIONAL)}) x""")
def smoke_check(t):
    whole = timings_of(t, lost=False)
    slow = integrity.smoke_check(whole, 0.0).withColumn(
        "detail", F.concat(F.lit("Slow tables (> 0s): "), F.size(F.split(F.col("detail"), ", ")).cast("string"))
    )
    parts = {"all": integrity.smoke_check(whole, PATIENCE), "with a lost one": integrity.smoke_check(timings_of(t, lost=True), PATIENCE), "at no patience": slow}
    return reconcile.union_all([found.select(F.lit(name).alias("tables"), "check", "status", "detail") for name, found in parts.items()])


@query("test_report", f"""
WITH c AS (SELECT job_id, status FROM ({SQL_COMPAT}) a UNION ALL SELECT DISTINCT job_id, status FROM ({SQL_MISSING.replace('SIZE', '1000')}) b
           UNION ALL SELECT j.job_id, r.status FROM {{jobs}} j, ({SQL_REFERENTIAL}) r UNION ALL SELECT job_id, 'PASS' FROM {{jobs}} k)
SELECT job_id, count(*) AS checks, count(*) FILTER (status <> 'PASS') AS not_passed,
       CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS overall_status FROM c GROUP BY job_id""")
def test_report(t):
    objects = existence_of(t)
    compat = integrity.schema_compatibility(objects, t.jobs).select("job_id", "check", "status")
    missing = integrity.missing_objects(objects).select("job_id", "check", "status").distinct()
    # The verdicts of the shared target apply to every job; each is one row, read as a literal.
    verdicts = [
        integrity.referential_integrity(integrity.orphan_counts(target_tables(t), FKS)).first(),
        integrity.smoke_check(timings_of(t, lost=False), PATIENCE).first(),
    ]
    shared = [t.jobs.select("job_id", F.lit(v["check"]).alias("check"), F.lit(v["status"]).alias("status")) for v in verdicts]
    return integrity.test_report(reconcile.union_all([compat, missing, *shared]), ["job_id"])


SQL_REPORT = f"""
SELECT 'table' AS object_type, table_name AS object_name, status, row_count_match, data_match AS hash_match FROM ({rec.SQL_RECONCILE}) r
UNION ALL SELECT object_type, object_name, status, NULL, NULL FROM ({SQL_EXISTENCE}) e"""


def report_of(t):
    return reconcile.validation_report(reconcile.reconcile_tables(rec.pairs(t)), existence_of(t))


@query("validation_report", SQL_REPORT)
def validation_report(t):
    return report_of(t)


@query("report_summary", f"""
SELECT *, CASE WHEN mismatches = 0 THEN 'PASS' ELSE 'FAIL' END AS overall_status FROM (
SELECT count(*) FILTER (object_type = 'table') AS "tables", count(*) FILTER (object_type <> 'table') AS objects,
       count(*) FILTER (CASE WHEN object_type = 'table' THEN status <> 'MATCH' ELSE status NOT IN ('PRESENT', 'PENDING_MANUAL_REVIEW') END) AS mismatches
FROM ({SQL_REPORT}) r) s""")
def report_summary(t):
    return reconcile.report_summary(report_of(t))


@query("match_rate", f"""
SELECT count(*) AS total_tables, count(*) FILTER (status = 'MATCH') AS passed_tables, 100.0 * count(*) FILTER (status = 'MATCH') / count(*) AS match_rate
FROM ({rec.SQL_RECONCILE}) r""")
def match_rate(t):
    return reconcile.match_rate(report_of(t))


@query("mismatched_tables", f"SELECT * FROM ({SQL_REPORT}) r WHERE object_type = 'table' AND status <> 'MATCH'")
def mismatched_tables(t):
    return reconcile.mismatched_tables(report_of(t))


# Validation results of the estate: each order stands for one validated table of the customer's job.
FIXTURES["validation_results"] = """
SELECT o.o_custkey AS job_id, o.o_orderpriority AS table_name, j.source_dialect, j.target_dialect,
       CASE WHEN o.o_orderstatus = 'P' THEN 'MISMATCH' ELSE 'MATCH' END AS status,
       o.o_orderstatus <> 'P' AS row_count_match, o.o_orderstatus = 'O' AS hash_match
FROM {orders} o JOIN {jobs} j ON j.job_id = o.o_custkey"""


@query("validation_progress", """
SELECT job_id, source_dialect, target_dialect, count(*) AS total_tables, count(*) FILTER (status = 'MATCH') AS passed_tables
FROM {validation_results} v GROUP BY ALL""")
def validation_progress(t):
    return reconcile.validation_progress(t.validation_results)


@query("mismatch_counters", """
SELECT table_name, job_id, source_dialect, target_dialect, count(*) FILTER (NOT hash_match) AS checksum_mismatches,
       count(*) FILTER (NOT row_count_match) AS row_count_mismatches FROM {validation_results} v GROUP BY ALL""")
def mismatch_counters(t):
    return reconcile.mismatch_counters(t.validation_results)
