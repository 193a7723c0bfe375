"""Did these tables arrive intact? Counts, fingerprints and reports against a damaged copy."""

from pyspark.sql import functions as F

from queries.base import BASE_TABLES, FIXTURES, RELATIONAL, query
from tidemark.functions.canonical import canonical
from tidemark.operators import fingerprint, reconcile

COLUMNS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:s o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d "
    "l_tax:d l_returnflag:s l_linestatus:s l_shipdate:s",
    "events": "event_id:i ts:s user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:a label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}

# The damaged copy. Every rule touches whole tables by the meaning of a column, as a bad load would.
FIXTURES.update(
    # A load that stopped before the last days arrived.
    tgt_orders="SELECT * FROM {orders} WHERE o_orderdate < timestamp '2001-06-01 00:00:00' OR o_orderpriority <> '1-URGENT'",
    # Same number of rows, negative-to-zero rounding fault in one segment.
    tgt_customer="SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 0.01 "
    "ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM {customer}",
    # Keys cut to even numbers: the count agrees, every second key is lost and its neighbour doubled.
    tgt_supplier="SELECT s_suppkey - s_suppkey % 2 AS s_suppkey, s_name, s_nationkey, s_acctbal FROM {supplier}",
    # Another numeric type with the same values, columns in another order and case.
    tgt_lineitem="SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, cast(l_quantity AS decimal(12,4)) AS L_QUANTITY, "
    "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM {lineitem}",
    tgt_region="SELECT * FROM {region}",
    tgt_nation="SELECT * FROM {nation}",
    tgt_part="SELECT * FROM {part}",
)


def sql_cell(name: str, kind: str) -> str:
    number = "rtrim(rtrim(cast(try_cast(cast({} AS varchar) AS decimal(38,18)) AS varchar), '0'), '.')"
    if kind == "d":
        return f"coalesce({number.format(name)}, cast({name} AS varchar), '')"
    if kind == "a":
        return f"coalesce(array_to_string(list_transform({name}, lambda x: {number.format('x')}), ','), '')"
    return f"coalesce(cast({name} AS varchar), '')"


def sql_row(table: str) -> str:
    cells = ", ".join(sql_cell(*c.split(":")) for c in COLUMNS[table].split())
    return f"concat_ws('|', {cells})"


def sql_print(table: str, source: str) -> str:
    bits = f"cast('0x' || substr(md5({sql_row(table)}), 1, 15) AS hugeint)"
    return f"SELECT count(*) AS n, cast(coalesce(sum({bits}), 0) AS varchar) AS fp FROM {source}"


def pairs(t, tables=RELATIONAL):
    return {n: (getattr(t, n), getattr(t, f"tgt_{n}")) for n in tables}


SQL_RECONCILED = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, s.n AS ns, g.n AS nt, s.fp AS fs, g.fp AS ft "
    f"FROM ({sql_print(n, n)}) s, ({sql_print(n, '{tgt_' + n + '}')}) g"
    for n in RELATIONAL
)
SQL_RECONCILE = f"""
SELECT table_name, CASE WHEN ns = nt THEN 'MATCH' ELSE 'MISMATCH' END AS status,
       ns AS row_count_source, nt AS row_count_target,
       substr(md5(fs), 1, 16) AS checksum_source, substr(md5(ft), 1, 16) AS checksum_target,
       ns = nt AS row_count_match, fs = ft AS data_match,
       CASE WHEN ns = nt AND fs <> ft THEN '{reconcile.NOTE}' END AS checksum_note
FROM ({SQL_RECONCILED}) r"""


@query("row_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS row_count_source, "
    f"(SELECT count(*) FROM {{tgt_{n}}} g) AS row_count_target, "
    f"(SELECT count(*) FROM {n}) = (SELECT count(*) FROM {{tgt_{n}}} g) AS row_count_match"
    for n in RELATIONAL
))
def row_counts(t):
    return reconcile.row_counts(pairs(t))


@query("canonical_cells", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       + ", ".join(f"{sql_cell(c, 'd')} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
       + f", {sql_row('lineitem')} AS row_text FROM lineitem")
def canonical_cells(t):
    from tidemark.functions.canonical import row_text

    df = t.lineitem
    cells = [canonical(F.col(c), df.schema[c].dataType).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cells, row_text(df).alias("row_text"))


@query("table_fingerprint", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, n AS row_count, fp AS fingerprint FROM ({sql_print(n, n)}) x" for n in BASE_TABLES
))
def table_fingerprint(t):
    return reconcile.union_all([
        fingerprint.table_fingerprint(getattr(t, n)).select(F.lit(n).alias("table_name"), "row_count", "fingerprint")
        for n in BASE_TABLES
    ])


@query("reconcile_tables", SQL_RECONCILE)
def reconcile_tables(t):
    return reconcile.reconcile_tables(pairs(t))


@query("reconcile_lineitem", SQL_RECONCILE + " WHERE table_name = 'lineitem'")
def reconcile_lineitem(t):
    return reconcile.reconcile_table("lineitem", t.lineitem, t.tgt_lineitem)


@query("reconcile_faults", """
SELECT 'nation' AS table_name, 'MATCH' AS status, count(*) AS row_count_source, true AS data_match FROM nation
UNION ALL SELECT 'orders', 'MATCH', count(*), true FROM orders UNION ALL SELECT 'supplier', 'ERROR', NULL, false FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)""")
def reconcile_faults(t):
    # Names read as numbers fail while the job runs.
    broken = t.supplier.withColumn("s_suppkey", F.col("s_name").cast("bigint"))
    found = reconcile.reconcile_tables({"nation": (t.nation, t.nation), "supplier": (t.supplier, broken), "orders": (t.orders, t.orders)})
    return found.select("table_name", "status", "row_count_source", "data_match")


@query("range_fingerprints", f"""
WITH s AS (SELECT o_orderkey // 1000 AS b, count(*) AS n, cast(sum(cast('0x' || substr(md5({sql_row('orders')}), 1, 15) AS hugeint)) AS varchar) AS fp FROM orders GROUP BY 1),
     g AS (SELECT o_orderkey // 1000 AS b, count(*) AS n, cast(sum(cast('0x' || substr(md5({sql_row('orders')}), 1, 15) AS hugeint)) AS varchar) AS fp FROM {{tgt_orders}} x GROUP BY 1)
SELECT cast(coalesce(s.b, g.b) * 1000 AS bigint) AS range_start, coalesce(s.n, 0) AS row_count_source,
       coalesce(g.n, 0) AS row_count_target, s.fp IS NOT DISTINCT FROM g.fp AS range_match
FROM s FULL JOIN g ON s.b = g.b""")
def range_fingerprints(t):
    return reconcile.range_fingerprints(t.orders, t.tgt_orders, "o_orderkey", 1000)


def sql_row_diff(source: str, target: str, key: str, table: str) -> str:
    row = sql_row(table)
    return f"""
WITH a AS (SELECT {key}, count(*) AS n, list_sort(list({row})) AS r FROM {source} GROUP BY {key}),
     b AS (SELECT {key}, count(*) AS n, list_sort(list({row})) AS r FROM {target} x GROUP BY {key})
SELECT coalesce(a.{key}, b.{key}) AS {key},
       CASE WHEN b.n IS NULL THEN 'only_source' WHEN a.n IS NULL THEN 'only_target' ELSE 'changed' END AS difference,
       coalesce(a.n, 0) AS rows_source, coalesce(b.n, 0) AS rows_target
FROM a FULL JOIN b ON a.{key} = b.{key} WHERE a.r IS DISTINCT FROM b.r"""


@query("row_diff", sql_row_diff("customer", "{tgt_customer}", "c_custkey", "customer"))
def row_diff(t):
    return reconcile.row_diff(t.customer, t.tgt_customer, ["c_custkey"])


@query("row_diff_repeated_keys", sql_row_diff("supplier", "{tgt_supplier}", "s_suppkey", "supplier"))
def row_diff_repeated_keys(t):
    return reconcile.row_diff(t.supplier, t.tgt_supplier, ["s_suppkey"])


@query("drill_down", sql_row_diff("orders", "{tgt_orders}", "o_orderkey", "orders"))
def drill_down(t):
    return reconcile.drill_down(t.orders, t.tgt_orders, "o_orderkey", 1000)


def _sql_profile(table: str, source: str) -> str:
    parts = []
    for c in COLUMNS[table].split():
        name, kind = c.split(":")
        num = f"cast({name} AS double)" if kind in "id" else "cast(NULL AS double)"
        text = f"strlen(cast({name} AS varchar))"
        if kind == "d":
            text = f"strlen(CASE WHEN {name} = floor({name}) THEN cast(cast({name} AS bigint) AS varchar) || '.0' ELSE cast({name} AS varchar) END)"
        parts.append(
            f"SELECT '{name}' AS column_name, count(*) AS r, count(*) - count({name}) AS nu, min({num}) AS mn, max({num}) AS mx, "
            f"min({text}) AS ln, max({text}) AS lx FROM {source} x"
        )
    return " UNION ALL ".join(parts)


_PROFILE_FACTS = (("rows", "r"), ("nulls", "nu"), ("min_value", "mn"), ("max_value", "mx"), ("min_length", "ln"), ("max_length", "lx"))


@query("profile_compare", f"""
WITH a AS ({_sql_profile('customer', 'customer')}), b AS ({_sql_profile('customer', '{tgt_customer}')})
SELECT a.column_name, {', '.join(f'a.{s} AS {f}_source, b.{s} AS {f}_target' for f, s in _PROFILE_FACTS)},
       {' AND '.join(f'a.{s} IS NOT DISTINCT FROM b.{s}' for _, s in _PROFILE_FACTS)} AS profile_match
FROM a JOIN b ON a.column_name = b.column_name""")
def profile_compare(t):
    return reconcile.profile_compare(t.customer, t.tgt_customer)


def _sql_totals(table: str, source: str) -> str:
    """Column by column; orders hold no other kinds than these."""
    parts = []
    for c in COLUMNS[table].split():
        name, kind = c.split(":")
        amount = {"i": f"cast({name} AS decimal(38,0))", "d": f"cast(cast({name} AS varchar) AS decimal(38,9))"}.get(
            kind, f"cast(epoch_us({name}) AS decimal(38,0))" if name.endswith("date") else f"cast(length({name}) AS decimal(38,0))")
        total = f"cast(sum({amount}) AS varchar)"
        if kind == "d":
            total = f"rtrim(rtrim({total}, '0'), '.')"
        parts.append(
            f"SELECT '{name}' AS column_name, count({name}) AS v, {sql_cell(f'min({name})', kind)} AS lo, {sql_cell(f'max({name})', kind)} AS hi, "
            f"{total} AS su, cast(0 AS bigint) AS un FROM {source} x"
        )
    return " UNION ALL ".join(parts)


_TOTALS = (("values", "v"), ("least", "lo"), ("greatest", "hi"), ("total", "su"), ("unsummed", "un"))


@query("profile_totals", f"""
WITH a AS ({_sql_totals('orders', 'orders')}), b AS ({_sql_totals('orders', '{tgt_orders}')})
SELECT a.column_name, {', '.join(f'a.{s} AS {f}_source, b.{s} AS {f}_target' for f, s in _TOTALS)},
       {' AND '.join(f'a.{s} IS NOT DISTINCT FROM b.{s}' for _, s in _TOTALS)} AS totals_match
FROM a JOIN b ON a.column_name = b.column_name""")
def profile_totals(t):
    return reconcile.profile_totals(t.orders, t.tgt_orders)


def _sql_sample(table: str, target: str, key: str, chosen: str, k: int) -> str:
    return f"""
WITH k AS (SELECT {key} FROM ({chosen}) d ORDER BY md5(cast({key} AS varchar)), {key} LIMIT {k}),
a AS (SELECT {key}, count(*) AS n, min({sql_row(table)}) AS r FROM {table} x GROUP BY {key}), b AS (SELECT {key}, count(*) AS n, min({sql_row(table)}) AS r FROM {target} y GROUP BY {key})
SELECT k.{key}, coalesce(a.n, 0) AS records_source, coalesce(b.n, 0) AS records_target, a.r AS record_source, b.r AS record_target
FROM k LEFT JOIN a ON a.{key} = k.{key} LEFT JOIN b ON b.{key} = k.{key}"""


@query("sample_differing", _sql_sample("supplier", "{tgt_supplier}", "s_suppkey", sql_row_diff("supplier", "{tgt_supplier}", "s_suppkey", "supplier"), 20))
def sample_differing(t):
    return reconcile.sample_records(t.supplier, t.tgt_supplier, ["s_suppkey"], 20)


@query("sample_records", _sql_sample("customer", "{tgt_customer}", "c_custkey", "SELECT c_custkey FROM customer", 50))
def sample_records(t):
    return reconcile.sample_records(t.customer, t.tgt_customer, ["c_custkey"], 50, differing=False)
