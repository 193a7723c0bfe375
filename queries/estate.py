"""An estate of migration jobs: every customer is one job that holds a trading schema of its own.

The schema follows the given tables, with a table of shipments, a part that replaces another and a customer's last order added, so that
there are composite, self-referring and circular keys. It is stated once below; Spark and DuckDB repeat it per customer, so the
estate grows with the customer table.
"""

from queries.base import FIXTURES

# (table, column, PostgreSQL type, MySQL type, Oracle type, nullable, primary key)
COLUMNS = [
    ("region", "r_regionkey", "integer", "int", "NUMBER", "NO", 1),
    ("region", "r_name", "character varying(25)", "varchar(25)", "VARCHAR2(25)", "NO", 0),
    ("region", "r_side", "character varying(1)", "enum('N','S')", "VARCHAR2(1)", "YES", 0),
    ("nation", "n_nationkey", "integer", "int", "NUMBER", "NO", 1),
    ("nation", "n_name", "character varying(25)", "varchar(25)", "VARCHAR2(25)", "NO", 0),
    ("nation", "n_regionkey", "integer", "int", "NUMBER", "YES", 0),
    ("customer", "c_custkey", "integer", "int", "NUMBER", "NO", 1),
    ("customer", "c_name", "character varying(100)", "varchar(100)", "VARCHAR2(100)", "NO", 0),
    ("customer", "c_acctbal", "numeric(15,2)", "decimal(15,2)", "NUMBER(15,2)", "YES", 0),
    ("customer", "c_nationkey", "integer", "int", "NUMBER", "YES", 0),
    ("customer", "c_last_order", "bigint", "bigint", "NUMBER", "YES", 0),
    ("customer", "c_since", "date", "date", "DATE", "YES", 0),
    ("customer", "is_active", "boolean", "tinyint(1)", "CHAR(1)", "YES", 0),
    ("customer", "c_papers", "jsonb", "json", "XMLTYPE", "YES", 0),
    ("part", "p_partkey", "integer", "int", "NUMBER", "NO", 1),
    ("part", "p_name", "character varying(150)", "varchar(150)", "VARCHAR2(150)", "NO", 0),
    ("part", "p_leaflet", "text", "text", "CLOB", "YES", 0),
    ("part", "p_replaces", "integer", "int", "NUMBER", "YES", 0),
    ("orders", "o_orderkey", "bigint", "bigint", "NUMBER", "NO", 1),
    ("orders", "o_custkey", "integer", "int", "NUMBER", "NO", 0),
    ("orders", "o_placed_at", "timestamp without time zone", "datetime", "TIMESTAMP", "YES", 0),
    ("lineitem", "l_orderkey", "bigint", "bigint", "NUMBER", "NO", 1),
    ("lineitem", "l_linenumber", "integer", "int", "NUMBER", "NO", 1),
    ("lineitem", "l_partkey", "integer", "int", "NUMBER", "NO", 0),
    ("shipment", "s_shipkey", "bigint", "bigint", "NUMBER", "NO", 1),
    ("shipment", "s_orderkey", "bigint", "bigint", "NUMBER", "NO", 0),
    ("shipment", "s_linenumber", "integer", "int", "NUMBER", "NO", 0),
    ("shipment", "Ship Note", "money", "mediumtext", "INTERVAL", "YES", 0),
]
# (constraint, child, child columns, parent, parent columns); the first one makes MySQL and Oracle cyclic
FOREIGN_KEYS = [
    ("customer_last_order_fk", "customer", "c_last_order", "orders", "o_orderkey"),
    ("orders_customer_fk", "orders", "o_custkey", "customer", "c_custkey"),
    ("nation_region_fk", "nation", "n_regionkey", "region", "r_regionkey"),
    ("customer_nation_fk", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("lineitem_order_fk", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem_part_fk", "lineitem", "l_partkey", "part", "p_partkey"),
    ("shipment_line_fk", "shipment", "s_orderkey,s_linenumber", "lineitem", "l_orderkey,l_linenumber"),
    ("part_replaces_fk", "part", "p_replaces", "part", "p_partkey"),
]
TABLES = list(dict.fromkeys(c[0] for c in COLUMNS))
VIEWS = [
    ("open_accounts", "CREATE VIEW open_accounts AS SELECT c_custkey FROM customer WHERE is_active = TRUE;"),
    ("rich_accounts", "CREATE VIEW rich_accounts AS SELECT * FROM open_accounts;  "),
]
ROUTINES = [
    ("purge_shipments", "procedure", "CREATE PROCEDURE purge_shipments() AS BEGIN NULL; END;"),
    ("count_orders", "function", "CREATE FUNCTION count_orders(c INTEGER) RETURNS INTEGER AS 'SELECT 1';"),
    ("tidy_name", "function", ""),
    ("sum_balance", "aggregate", "CREATE AGGREGATE sum_balance"),
]
TRIGGERS = [
    ("trg_tidy_name", "customer", "CREATE TRIGGER trg_tidy_name", 0),
    ("ri_constraint_trigger", "customer", "", 1),
]

_DIALECT = "CASE c_custkey % 3 WHEN 0 THEN 'oracle' WHEN 1 THEN 'mysql' ELSE 'postgresql' END"
_TARGET = "CASE c_custkey % 3 WHEN 2 THEN 'mysql' ELSE 'postgresql' END"
_SCHEMA = "CASE c_custkey % 3 WHEN 0 THEN 'TRADE' WHEN 1 THEN 'trade_db' ELSE 'trade' END"


def _literal(v) -> str:
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def per_job(rows: list[tuple], names: list[str], select: str, where: str = "") -> tuple[str, str]:
    """Repeat fixed rows for every customer; ``select`` may use the columns, j.dialect and j.ns."""
    jobs = (
        f"(SELECT c_custkey AS job_id, {_DIALECT} AS dialect, {_TARGET} AS target_dialect, {_SCHEMA} AS ns, "
        "c_mktsegment AS segment, c_acctbal AS acctbal FROM {customer}) j"
    )
    structs = ", ".join("named_struct(" + ", ".join(f"'{n}', {_literal(v)}" for n, v in zip(names, r)) + ")" for r in rows)
    values = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    tail = f" WHERE {where}" if where else ""
    return (
        f"SELECT {select} FROM {jobs} LATERAL VIEW inline(array({structs})) r AS {', '.join(names)}{tail}",
        f"SELECT {select} FROM {jobs}, (VALUES {values}) r({', '.join(names)}){tail}",
    )


def folded(name: str) -> str:
    """Oracle stores unquoted names in upper case."""
    return f"CASE WHEN j.dialect = 'oracle' THEN upper(r.{name}) ELSE r.{name} END"


_FK_WHERE = "(j.dialect <> 'postgresql' OR r.fk <> 'customer_last_order_fk')"
_FK_COLS = [
    (name, child, c, parent, p, i + 1)
    for name, child, cs, parent, ps in FOREIGN_KEYS
    for i, (c, p) in enumerate(zip(cs.split(","), ps.split(",")))
]
_PK_COLS = []
for _t in TABLES:
    for _i, _c in enumerate(c[1] for c in COLUMNS if c[0] == _t and c[6]):
        _PK_COLS.append((f"{_t}_pkey", _t, _c, _i + 1))

FIXTURES.update(
    sv_tables=per_job(
        [(t, "BASE TABLE", "@") for t in TABLES]
        + [("open_accounts", "VIEW", "@"), ("pg_class", "BASE TABLE", "pg_catalog"), ("user", "BASE TABLE", "mysql"),
           ("dual", "BASE TABLE", "Sys")],
        ["t", "kind", "sch"],
        f"j.job_id, j.dialect, CASE WHEN r.sch = '@' THEN j.ns ELSE r.sch END AS schema_name, {folded('t')} AS table_name, "
        "r.kind AS table_type, cast(NULL AS string) AS definition",
    ),
    sv_views=per_job(
        VIEWS, ["v", "ddl"],
        f"j.job_id, j.dialect, j.ns AS schema_name, {folded('v')} AS view_name, "
        "CASE WHEN j.segment = 'FURNITURE' THEN NULL ELSE r.ddl END AS definition",
    ),
    sv_routines=per_job(
        ROUTINES, ["p", "kind", "ddl"],
        f"j.job_id, j.dialect, j.ns AS schema_name, {folded('p')} AS routine_name, r.kind AS routine_kind, "
        "nullif(r.ddl, '') AS definition",
    ),
    sv_triggers=per_job(
        TRIGGERS, ["g", "t", "ddl", "internal"],
        f"j.job_id, j.dialect, j.ns AS schema_name, {folded('g')} AS trigger_name, {folded('t')} AS table_name, "
        "r.internal = 1 AS is_internal, nullif(r.ddl, '') AS definition",
    ),
    sv_columns=per_job(
        [(*c, i) for i, c in enumerate(COLUMNS)],
        ["t", "c", "pg", "my", "ora", "nullable", "pk", "pos"],
        f"j.job_id, j.dialect, j.ns AS schema_name, {folded('t')} AS table_name, {folded('c')} AS column_name, "
        "r.pos AS ordinal, CASE j.dialect WHEN 'oracle' THEN r.ora WHEN 'mysql' THEN r.my ELSE r.pg END AS native_type, "
        "r.nullable AS is_nullable, CASE WHEN r.c = 'is_active' THEN 'TRUE' END AS default_value, "
        "CASE WHEN j.dialect = 'mysql' AND r.pk = 1 THEN 'PRI' END AS column_key",
    ),
    sv_pk_constraints=per_job(
        [(f"{t}_pkey", t) for t in TABLES], ["n", "t"],
        f"j.job_id, j.dialect, j.ns AS schema_name, {folded('t')} AS table_name, {folded('n')} AS constraint_name, "
        "'PRIMARY KEY' AS constraint_type, cast(NULL AS string) AS ref_constraint_name",
        "j.dialect <> 'mysql'",
    ),
    sv_fk_constraints=per_job(
        FOREIGN_KEYS, ["fk", "t", "c", "p", "pc"],
        f"j.job_id, j.dialect, j.ns AS schema_name, {folded('t')} AS table_name, {folded('fk')} AS constraint_name, "
        "'FOREIGN KEY' AS constraint_type, CASE WHEN j.dialect = 'oracle' THEN upper(concat(r.p, '_pkey')) END AS ref_constraint_name",
        _FK_WHERE,
    ),
    sv_constraints="SELECT * FROM {sv_pk_constraints} a UNION ALL SELECT * FROM {sv_fk_constraints} b",
    sv_pk_usage=per_job(
        _PK_COLS, ["n", "t", "c", "pos"],
        f"j.job_id, j.dialect, j.ns AS schema_name, {folded('t')} AS table_name, {folded('n')} AS constraint_name, "
        f"{folded('c')} AS column_name, r.pos AS position",
        "j.dialect <> 'mysql'",
    ),
    sv_fk_usage=per_job(
        _FK_COLS, ["fk", "t", "c", "p", "pc", "pos"],
        f"j.job_id, j.dialect, j.ns AS schema_name, {folded('t')} AS table_name, {folded('fk')} AS constraint_name, "
        f"{folded('c')} AS column_name, r.pos AS position",
        _FK_WHERE,
    ),
    sv_key_usage="SELECT * FROM {sv_pk_usage} a UNION ALL SELECT * FROM {sv_fk_usage} b",
    # PostgreSQL and MySQL name the referenced columns; Oracle only the referenced constraint.
    sv_ref_usage=per_job(
        _FK_COLS, ["fk", "t", "c", "p", "pc", "pos"],
        f"j.job_id, j.ns AS schema_name, r.fk AS constraint_name, r.p AS ref_table_name, r.pc AS ref_column_name, "
        "r.pos AS position",
        f"j.dialect <> 'oracle' AND {_FK_WHERE}",
    ),
    jobs=per_job([(1,)], ["one"], "j.job_id, j.dialect AS source_dialect, j.target_dialect, j.ns AS schema_name, j.segment, j.acctbal"),
)

# What the operators above should make of it, for checks that start from a finished catalogue.
FIXTURES["estate_foreign_keys"] = per_job(
    [(*f, f[2].split(",")[0], f[2].split(",")[-1], f[4].split(",")[0], f[4].split(",")[-1]) for f in FOREIGN_KEYS],
    ["fk", "t", "c", "p", "pc", "c1", "c2", "p1", "p2"],
    f"j.job_id, j.dialect, j.ns AS schema_name, {folded('fk')} AS constraint_name, {folded('t')} AS table_name, "
    f"{folded('p')} AS ref_table_name, {folded('c')} AS column_list, {folded('pc')} AS ref_column_list, "
    f"{folded('c1')} AS c1, {folded('c2')} AS c2, {folded('p1')} AS p1, {folded('p2')} AS p2",
    _FK_WHERE,
)
_OBJECTS = (
    [("table", t, "") for t in sorted(TABLES)]
    + [("view", v, d) for v, d in sorted(VIEWS)]
    + [("procedure", "purge_shipments", ROUTINES[0][2])]
    + [("function", n, d) for n, k, d in ROUTINES if k == "function"]
    + [("trigger", TRIGGERS[0][0], TRIGGERS[0][2])]
    + [("foreign_key", f[0], f"ALTER TABLE {f[1]} ADD CONSTRAINT {f[0]}") for f in sorted(FOREIGN_KEYS)]
)
# Objects of a job with their place in the catalogue, without the nested columns.
FIXTURES["estate_objects"] = per_job(
    [(i + 1, *o) for i, o in enumerate(_OBJECTS)], ["pos", "kind", "n", "ddl"],
    f"j.job_id * 100 + r.pos AS object_id, j.job_id, j.dialect, j.target_dialect, j.segment, j.acctbal, cast(r.pos AS bigint) AS ord, "
    f"r.kind AS object_type, j.ns AS schema_name, {folded('n')} AS object_name, "
    "CASE WHEN r.kind = 'view' AND j.segment = 'FURNITURE' THEN NULL ELSE nullif(r.ddl, '') END AS definition",
    "(j.dialect <> 'postgresql' OR r.n <> 'customer_last_order_fk')",
)
