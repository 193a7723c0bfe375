"""Data jobs the migration rules call for: changes, incremental loads, conversions and child tables."""

from datetime import datetime

from pyspark.sql import functions as F

from queries import streams  # noqa: F401  (fixtures)
from queries.base import FIXTURES, query
from tidemark.operators import convert
from tidemark.session import scratch_path
from tidemark.streaming import changes

# Changes to customers: each order of a customer is one change of the balance, cancelled ones delete the customer.
FIXTURES["customer_changes"] = """
SELECT o_custkey AS c_custkey, CASE WHEN o_orderstatus = 'P' THEN 'D' ELSE 'U' END AS op, o_orderdate AS ts, o_orderkey AS seq,
       concat('Renamed#', o_orderkey) AS c_name, 3 AS c_nationkey, o_totalprice AS c_acctbal, o_orderpriority AS c_mktsegment FROM {orders}"""


@query("apply_changes", """
WITH l AS (SELECT c_custkey, arg_max(struct_pack(op := op, n := c_name, k := c_nationkey, b := c_acctbal, s := c_mktsegment), (ts, seq)) AS z
           FROM {customer_changes} x GROUP BY c_custkey)
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.c_custkey = c.c_custkey)
UNION ALL SELECT c_custkey, z.n, z.k, z.b, z.s FROM l WHERE z.op <> 'D'""")
def apply_changes(t):
    return changes.apply_changes(t.customer, t.customer_changes, ["c_custkey"])


@query("change_lag", """SELECT max(ts) AS last_change, (epoch_us(timestamp '2030-01-01 00:00:00') - epoch_us(max(ts))) / 1e6 AS lag_seconds FROM {customer_changes} c""")
def change_lag(t):
    return changes.change_lag(t.customer_changes, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))


@query("newer_rows", "SELECT * FROM orders WHERE o_orderdate >= timestamp '1998-06-30 00:00:00'")
def newer_rows(t):
    return changes.newer_rows(t.orders, "o_orderdate", datetime(1998, 6, 30))


# Orders by month at the time of a first load and of a second: then orders of the last month came late, and orders at and beyond it
# and some without a month have another price.
FIXTURES["orders_by_month"] = """
SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 50 <> 0 THEN date_trunc('month', o_orderdate) END AS month FROM {orders}"""
FIXTURES["orders_first"] = """
SELECT * FROM {orders_by_month} m
WHERE month IS NULL OR month < timestamp '1995-06-01 00:00:00' OR (month = timestamp '1995-06-01 00:00:00' AND o_orderkey % 3 <> 1)"""
FIXTURES["orders_second"] = """
SELECT o_orderkey, CASE WHEN (o_orderkey % 3 = 2 AND month >= timestamp '1995-06-01 00:00:00') OR o_orderkey % 100 = 0 THEN price + 1 ELSE price END AS price, month
FROM {orders_by_month} m"""


@query("load_increment", """
SELECT o_orderkey, price, month FROM {orders_first} a UNION ALL
SELECT o_orderkey, price, month FROM {orders_second} b
WHERE month > timestamp '1995-06-01 00:00:00' OR (month = timestamp '1995-06-01 00:00:00' AND o_orderkey % 3 <> 0) OR (month IS NULL AND o_orderkey % 100 = 0)""")
def load_increment(t):
    path = scratch_path(t.spark, "increments")
    changes.load_increment(t.orders_first, "month", path)
    changes.load_increment(t.orders_second, "month", path)
    return changes.load_increment(t.orders_second, "month", path)


@query("high_water", "SELECT max(o_orderkey) AS high_water FROM orders")
def high_water(t):
    return changes.high_water(t.orders, "o_orderkey")


# Columns as the old database holds them: flags as digits, years and sets as text, keys as UUID-like text.
FIXTURES["legacy_parts"] = """
SELECT p_partkey, CASE WHEN p_size > 45 THEN '2' WHEN p_size > 20 THEN '1' ELSE '0' END AS is_stocked, CASE WHEN p_type = 'ECONOMY' THEN '0000' ELSE cast(1990 + p_size AS string) END AS made_in,
       concat(p_brand, ',', p_type, CASE WHEN p_size > 25 THEN ',LARGE' ELSE '' END) AS tags, cast(p_retailprice AS string) AS price,
       CASE WHEN p_size = 7 THEN 'n/a' ELSE cast(p_size AS string) END AS size_text, concat(p_name, ' ', p_brand, ' ', p_type, ' with a long description') AS label FROM {part}"""
_TARGETS = {"is_stocked": "boolean", "made_in": "smallint", "price": "double", "size_text": "int", "label": "char(36)"}
_SQL_TO = {
    "is_stocked": "CASE is_stocked WHEN '1' THEN true WHEN '0' THEN false END", "made_in": "try_cast(made_in AS smallint)", "price": "try_cast(price AS double)",
    "size_text": "try_cast(size_text AS int)", "label": "CASE WHEN length(label) <= 36 THEN label END",
}


@query("convert_types", "SELECT p_partkey, " + ", ".join(f"{v} AS {k}" for k, v in _SQL_TO.items()) + ", tags FROM {legacy_parts} p")
def convert_types(t):
    return convert.convert_types(t.legacy_parts, _TARGETS)


@query("conversion_failures", " UNION ALL ".join(
    f"SELECT '{k}' AS column_name, '{_TARGETS[k]}' AS target_type, count({k}) AS \"values\", count(*) FILTER ({k} IS NOT NULL AND ({v}) IS NULL) AS failures FROM {{legacy_parts}} p"
    for k, v in _SQL_TO.items()
))
def conversion_failures(t):
    return convert.conversion_failures(t.legacy_parts, _TARGETS)


# Native types of the old columns per source, and the SQL of each column per pair.
_NATIVE = {
    "oracle": {"is_stocked": "NUMBER(1,0)", "made_in": "NUMBER(4)", "price": "NUMBER(10,2)", "size_text": "NUMBER(9,0)", "tags": "CLOB", "label": "VARCHAR2(40)"},
    "mysql": {"is_stocked": "tinyint(1)", "made_in": "year", "price": "decimal(10,2)", "size_text": "int", "tags": "enum('a')", "label": "varchar(40)"},
    "postgresql": {"is_stocked": "boolean", "made_in": "smallint", "price": "numeric(10,2)", "size_text": "numeric(18)", "tags": "jsonb", "label": "uuid"},
}
_FLAG = "CASE is_stocked WHEN '1' THEN 1 WHEN '0' THEN 0 END"
_SHORT = "CASE WHEN length(label) <= {} THEN label END"
_PAIR_SQL = {
    "oracle": {"is_stocked": "try_cast(is_stocked AS smallint)", "made_in": "try_cast(made_in AS smallint)", "size_text": "try_cast(size_text AS int)", "label": _SHORT.format(40)},
    "mysql": {"is_stocked": _FLAG, "made_in": "try_cast(made_in AS smallint)", "size_text": "try_cast(size_text AS int)", "label": _SHORT.format(40)},
    "postgresql": {"is_stocked": _FLAG, "made_in": "try_cast(made_in AS smallint)", "size_text": "try_cast(size_text AS bigint)", "label": _SHORT.format(36)},
}


def _pair(source, target):
    sql = {"price": "try_cast(price AS decimal(10,2))", "tags": "tags", **_PAIR_SQL[source]}
    if source != "oracle":
        sql["is_stocked"] = f"cast({_FLAG} AS {convert.PAIR_RULES[source, target]['tinyint(1)' if source == 'mysql' else 'boolean']})"
    if (source, target) == ("mysql", "oracle"):
        sql["made_in"] = "try_cast(made_in AS decimal(4,0))"
    native = _NATIVE[source]

    @query(f"convert_{source}_{target}", "SELECT p_partkey, " + ", ".join(f"{sql[c]} AS {c}" for c in native) + " FROM {legacy_parts} p")
    def rows(t):
        return convert.convert_between(t.legacy_parts, native, source, target)

    @query(f"convert_failures_{source}_{target}", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS \"values\", count(*) FILTER ({c} IS NOT NULL AND ({sql[c]}) IS NULL) AS failures FROM {{legacy_parts}} p" for c in native))
    def failures(t):
        return convert.conversion_failures(t.legacy_parts, convert.targets_for(native, source, target)).drop("target_type")


for _source, _target in convert.PAIR_RULES:
    _pair(_source, _target)


@query("normalize_set", """SELECT p_partkey, cast(position AS int) AS position, item FROM (
SELECT p_partkey, unnest(range(len(string_split(tags, ',')))) AS position, unnest(string_split(tags, ',')) AS item FROM {legacy_parts} p) x""")
def normalize_set(t):
    return convert.normalize_set(t.legacy_parts, ["p_partkey"], "tags")


@query("normalize_array", """SELECT vec_id, cast(position AS int) AS position, item FROM (
SELECT vec_id, unnest(range(len(embedding))) AS position, unnest(embedding) AS item FROM embeddings) x""")
def normalize_array(t):
    return convert.normalize_array(t.embeddings, ["vec_id"], "embedding")
