"""Catalogue queries over the system-view extracts of the estate."""

from pyspark.sql import functions as F

from queries import estate  # noqa: F401  (fixtures)
from queries.base import FIXTURES, query
from tidemark.functions import native_types
from tidemark.functions.names import SAFE_IDENTIFIER, SYSTEM_SCHEMAS
from tidemark.operators import catalog

_SYSTEM = " OR ".join(
    f"(dialect = '{d}' AND {'upper(schema_name)' if d == 'oracle' else 'schema_name'} IN ({', '.join(repr(s) for s in names)}))"
    for d, names in SYSTEM_SCHEMAS.items()
)
SQL_OBJECTS = f"""
SELECT * FROM (
SELECT job_id, dialect, 'table' AS object_type, schema_name, table_name AS object_name, NULL AS table_name, definition
FROM {{sv_tables}} t WHERE table_type = 'BASE TABLE'
UNION ALL SELECT job_id, dialect, 'view', schema_name, view_name, NULL, definition FROM {{sv_views}} v
UNION ALL SELECT job_id, dialect, routine_kind, schema_name, routine_name, NULL, definition FROM {{sv_routines}} r
WHERE routine_kind IN ('procedure', 'function')
UNION ALL SELECT job_id, dialect, 'trigger', schema_name, trigger_name, table_name, definition FROM {{sv_triggers}} g
WHERE NOT is_internal) o WHERE NOT ({_SYSTEM})"""
SQL_COLUMNS = """
SELECT c.job_id, c.dialect, c.schema_name, c.table_name, c.column_name, c.ordinal, c.native_type,
       c.is_nullable = 'YES' AS nullable, c.default_value,
       k.column_name IS NOT NULL OR coalesce(c.column_key = 'PRI', false) AS is_primary_key
FROM {sv_columns} c LEFT JOIN (
  SELECT u.* FROM {sv_key_usage} u JOIN {sv_constraints} n ON n.job_id = u.job_id AND n.schema_name = u.schema_name
  AND n.table_name = u.table_name AND n.constraint_name = u.constraint_name WHERE n.constraint_type = 'PRIMARY KEY') k
ON k.job_id = c.job_id AND k.schema_name = c.schema_name AND k.table_name = c.table_name AND k.column_name = c.column_name"""
SQL_FKS = """
SELECT n.job_id, n.dialect, n.schema_name, n.constraint_name, n.table_name, r.ref_table_name,
       string_agg(u.column_name, ',' ORDER BY u.position) AS column_list,
       string_agg(r.ref_column_name, ',' ORDER BY u.position) AS ref_column_list
FROM {sv_constraints} n
JOIN {sv_key_usage} u ON u.job_id = n.job_id AND u.schema_name = n.schema_name AND u.constraint_name = n.constraint_name
JOIN (SELECT job_id, schema_name, constraint_name, ref_table_name, ref_column_name, position FROM {sv_ref_usage} f
      UNION ALL SELECT c.job_id, c.schema_name, c.constraint_name, k.table_name, k.column_name, k.position
      FROM {sv_constraints} c JOIN {sv_key_usage} k ON k.job_id = c.job_id AND k.schema_name = c.schema_name
      AND k.constraint_name = c.ref_constraint_name) r
  ON r.job_id = n.job_id AND r.schema_name = n.schema_name AND r.constraint_name = n.constraint_name AND r.position = u.position
WHERE n.constraint_type = 'FOREIGN KEY' GROUP BY ALL"""


def fks_of(t):
    refs = t.sv_ref_usage.unionByName(
        catalog.referenced_columns(t.sv_constraints, t.sv_key_usage).select(t.sv_ref_usage.columns)
    )
    return catalog.foreign_keys(t.sv_constraints, t.sv_key_usage, refs)


def objects_of(t):
    return catalog.list_objects(t.sv_tables, t.sv_views, t.sv_routines, t.sv_triggers)


def columns_of(t):
    return catalog.columns_with_pk(t.sv_columns, t.sv_constraints, t.sv_key_usage)


def catalog_of(t):
    names = ("tables", "views", "routines", "triggers", "columns", "constraints", "key_usage", "ref_usage")
    return catalog.catalog_from_extracts({n: getattr(t, f"sv_{n}") for n in names})


@query("list_objects", SQL_OBJECTS)
def list_objects(t):
    return objects_of(t)


@query("columns_with_pk", SQL_COLUMNS)
def columns_with_pk(t):
    return columns_of(t)


@query("foreign_keys", SQL_FKS)
def foreign_keys(t):
    return fks_of(t).select(
        "job_id", "dialect", "schema_name", "constraint_name", "table_name", "ref_table_name",
        F.array_join("columns", ",").alias("column_list"), F.array_join("ref_columns", ",").alias("ref_column_list"),
    )


def _q(c: str) -> str:
    return (
        f"CASE dialect WHEN 'mysql' THEN '`' || replace({c}, '`', '``') || '`' "
        f"WHEN 'oracle' THEN upper('\"' || replace({c}, '\"', '\"\"') || '\"') ELSE '\"' || replace({c}, '\"', '\"\"') || '\"' END"
    )


_FK_COLS = f"{_q('c1')} || CASE WHEN c2 <> c1 THEN ', ' || {_q('c2')} ELSE '' END"
_FK_REFS = f"{_q('p1')} || CASE WHEN p2 <> p1 THEN ', ' || {_q('p2')} ELSE '' END"
SQL_FK_DDL = f"""
SELECT job_id, dialect, schema_name, constraint_name, table_name,
       'ALTER TABLE ' || {_q('table_name')} || ' ADD CONSTRAINT ' || {_q('constraint_name')} || ' FOREIGN KEY (' ||
       {_FK_COLS} || ') REFERENCES ' || {_q('ref_table_name')} || ' (' || {_FK_REFS} || ')' AS definition
FROM {{estate_foreign_keys}} f"""


@query("fk_ddl", SQL_FK_DDL)
def fk_ddl(t):
    return catalog.fk_ddl(fks_of(t)).select("job_id", "dialect", "schema_name", "constraint_name", "table_name", "definition")


def _plain(c: str) -> str:
    kept = "CASE WHEN dialect = 'oracle' THEN '[A-Z][A-Z0-9_$#]*' ELSE '[a-z_][a-z0-9_$]*' END"
    return f"CASE WHEN dialect = 'mysql' THEN '`' || replace({c}, '`', '``') || '`' WHEN regexp_full_match({c}, {kept}) THEN {c} ELSE '\"' || {c} || '\"' END"


SQL_TABLE_DDL = f"""
SELECT job_id, dialect, schema_name, table_name, 'CREATE TABLE ' || {_plain('schema_name')} || '.' || {_plain('table_name')} ||
       ' (' || string_agg(CASE WHEN dialect = 'postgresql' THEN column_name ELSE {_plain('column_name')} END || ' ' || native_type || CASE WHEN is_nullable = 'YES' THEN '' ELSE ' NOT NULL' END, ', '
       ORDER BY ordinal) || ');' AS definition
FROM {{sv_columns}} c GROUP BY job_id, dialect, schema_name, table_name"""


@query("table_ddl", SQL_TABLE_DDL)
def table_ddl(t):
    return catalog.table_ddl(columns_of(t))


SQL_CATALOG = f"""
WITH cols AS (SELECT job_id, schema_name, table_name, string_agg(column_name || ':' || native_type || ':' || is_primary_key, ', '
              ORDER BY ordinal) AS column_list FROM ({SQL_COLUMNS}) x GROUP BY ALL),
     ddl AS ({SQL_TABLE_DDL}), fk AS ({SQL_FK_DDL}),
     listed AS (SELECT * FROM ({SQL_OBJECTS}) o UNION ALL
                SELECT job_id, dialect, 'foreign_key', schema_name, constraint_name, table_name, definition FROM fk),
     placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE object_type WHEN 'table' THEN 0 WHEN 'view' THEN 1
                WHEN 'procedure' THEN 2 WHEN 'function' THEN 3 WHEN 'trigger' THEN 4 ELSE 5 END, schema_name, object_name) AS ord FROM listed)
SELECT p.job_id, p.dialect, p.object_type, p.schema_name, p.object_name, p.table_name,
       coalesce(p.definition, d.definition) AS definition, p.ord, c.column_list
FROM placed p
LEFT JOIN cols c ON c.job_id = p.job_id AND c.schema_name = p.schema_name AND c.table_name = p.object_name AND p.object_type = 'table'
LEFT JOIN ddl d ON d.job_id = p.job_id AND d.schema_name = p.schema_name AND d.table_name = p.object_name AND p.object_type = 'table'"""


@query("build_catalog", SQL_CATALOG)
def build_catalog(t):
    flat = F.array_join(
        F.transform("columns", lambda c: F.concat_ws(":", c["column_name"], c["native_type"], c["is_primary_key"].cast("string"))), ", "
    )
    return catalog_of(t).select(
        "job_id", "dialect", "object_type", "schema_name", "object_name", "table_name", "definition", "ord", flat.alias("column_list")
    )


SQL_EDGES = """SELECT job_id, table_name AS child, ref_table_name AS parent, min((c1, constraint_name)) AS seen
FROM {estate_foreign_keys} f GROUP BY job_id, table_name, ref_table_name"""


@query("dependency_edges", f"""SELECT job_id, child, string_agg(parent, ',' ORDER BY seen) AS dependencies
FROM ({SQL_EDGES}) e GROUP BY job_id, child""")
def dependency_edges(t):
    lists = catalog.dependency_lists(catalog.dependency_edges(fks_of(t)))
    return lists.withColumn("dependencies", F.array_join("dependencies", ","))


@query("summarize_objects", f"""
SELECT o.job_id, o.object_type, o.object_name, o.object_type || ' ' || o.schema_name || '.' || o.object_name ||
       coalesce(' | columns: ' || c.names, '') AS summary
FROM ({SQL_OBJECTS} UNION ALL SELECT job_id, dialect, 'foreign_key', schema_name, constraint_name, table_name, NULL FROM {{estate_foreign_keys}} f) o
LEFT JOIN (SELECT job_id, schema_name, table_name, string_agg(column_name, ', ' ORDER BY ordinal) AS names FROM {{sv_columns}} s GROUP BY ALL) c
ON o.object_type = 'table' AND c.job_id = o.job_id AND c.schema_name = o.schema_name AND c.table_name = o.object_name""")
def summarize_objects(t):
    return catalog.summarize_objects(catalog_of(t))


def _sql_map(table: dict, dialect: str, key: str) -> str:
    arms = " ".join(f"WHEN '{d}.{k}' THEN '{v}'" for d, m in table.items() for k, v in m.items())
    return f"CASE {dialect} || '.' || {key} {arms} END"


_CANON = _sql_map(native_types.CANONICAL_TYPES, "c.dialect", "lower(trim(split_part(c.native_type, '(', 1)))")
_SPARK = "CASE canonical_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in native_types.SPARK_TYPES.items()) + " END"


@query("map_types", f"""
SELECT job_id, table_name, column_name, native_type, canonical_type, {_SPARK} AS spark_type,
       {_sql_map(native_types.TARGET_TYPES, "CASE WHEN dialect = 'postgresql' THEN 'mysql' ELSE 'postgresql' END", 'canonical_type')} AS target_type,
       canonical_type IS NOT NULL AS mapped
FROM (SELECT c.*, {_CANON} AS canonical_type FROM {{sv_columns}} c) m""")
def map_types(t):
    target = F.when(F.col("dialect") == "postgresql", "mysql").otherwise("postgresql")
    return catalog.map_types(t.sv_columns, target).select(
        "job_id", "table_name", "column_name", "native_type", "canonical_type", "spark_type", "target_type", "mapped"
    )


# Target columns of the PostgreSQL twin: names in lower case, booleans restored, one column lost, one nullable.
FIXTURES["tgt_columns"] = """
SELECT job_id, 'postgresql' AS dialect, lower(table_name) AS table_name, lower(column_name) AS column_name, ordinal,
       CASE WHEN lower(column_name) = 'is_active' THEN 'boolean' WHEN lower(native_type) LIKE 'int%' OR native_type = 'NUMBER' THEN 'integer'
            WHEN lower(native_type) LIKE 'varchar%' OR lower(native_type) LIKE 'character%' THEN 'character varying'
            ELSE lower(native_type) END AS native_type,
       is_nullable = 'YES' OR lower(column_name) = 'last_name' AS nullable
FROM {sv_columns} s WHERE lower(column_name) <> 'role'"""


@query("type_diff", f"""
WITH a AS (SELECT c.*, {_CANON} AS ty, is_nullable = 'YES' AS nu FROM {{sv_columns}} c),
     b AS (SELECT c.*, {_CANON} AS ty, nullable AS nu FROM {{tgt_columns}} c)
SELECT * FROM (
SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(lower(a.table_name), b.table_name) AS table_name,
       coalesce(lower(a.column_name), b.column_name) AS column_name, a.ty AS type_source, b.ty AS type_target,
       a.nu AS nullable_source, b.nu AS nullable_target,
       CASE WHEN b.job_id IS NULL THEN 'only_source' WHEN a.job_id IS NULL THEN 'only_target'
            WHEN a.ty IS DISTINCT FROM b.ty THEN 'type' WHEN a.nu <> b.nu THEN 'nullability' END AS finding
FROM a FULL JOIN b ON a.job_id = b.job_id AND lower(a.table_name) = b.table_name AND lower(a.column_name) = b.column_name) d
WHERE finding IS NOT NULL""")
def type_diff(t):
    return catalog.type_diff(t.sv_columns.withColumn("nullable", F.col("is_nullable") == "YES"), t.tgt_columns)


# Names found in data: brands, clerks' free text and addresses are not all usable as identifiers.
FIXTURES["named_things"] = """
SELECT p_partkey AS job_id, 'table' AS object_type, p_name AS object_name FROM {part}
UNION ALL SELECT c_custkey, 'view', c_name FROM {customer} c
UNION ALL SELECT n_nationkey, 'trigger', n_name FROM {nation} n
UNION ALL SELECT page_id, 'table', url FROM {pages} g"""


@query("invalid_identifiers", f"""SELECT job_id, object_type, object_name FROM {{named_things}} x
WHERE NOT regexp_full_match(object_name, '{SAFE_IDENTIFIER.strip("^$")}')""")
def invalid_identifiers(t):
    return catalog.invalid_identifiers(t.named_things)


@query("drop_system_objects", f"""SELECT job_id, dialect, schema_name, table_name, table_type FROM {{sv_tables}} t WHERE NOT ({_SYSTEM})""")
def drop_system_objects(t):
    return catalog.drop_system_objects(t.sv_tables).drop("definition")


SQL_SCRIPT = f"""
WITH c AS ({SQL_CATALOG}), r AS (
SELECT job_id, CASE object_type WHEN 'table' THEN 0 WHEN 'view' THEN 1 WHEN 'procedure' THEN 2 WHEN 'function' THEN 3 WHEN 'trigger' THEN 4
       ELSE 5 END AS type_rank, ord, '-- ' || upper(object_type) || ': ' || schema_name || '.' || object_name || chr(10) ||
       rtrim(rtrim(definition), ';') || ';' AS chunk FROM c WHERE definition IS NOT NULL AND definition <> '')
SELECT job_id, type_rank, cast((ord - 1) // SIZE AS bigint) AS part_no, string_agg(chunk, chr(10) || chr(10) ORDER BY ord) AS script
FROM r GROUP BY ALL"""


@query("schema_script", SQL_SCRIPT.replace("SIZE", "1000"))
def schema_script(t):
    return catalog.schema_script(catalog_of(t))


@query("schema_script_parts", SQL_SCRIPT.replace("SIZE", "3"))
def schema_script_parts(t):
    return catalog.schema_script(catalog_of(t), part_size=3)


SQL_CASE_MAP = f"""
WITH t AS (SELECT job_id, schema_name, table_name, row_number() OVER (PARTITION BY job_id ORDER BY schema_name, table_name) AS ord
           FROM (SELECT job_id, schema_name, object_name AS table_name FROM ({SQL_OBJECTS}) o WHERE object_type = 'table') d),
     n AS (SELECT job_id, table_name AS name, ord, -1 AS pos FROM t UNION ALL
           SELECT c.job_id, c.column_name, t.ord, c.ordinal FROM {{sv_columns}} c JOIN t ON t.job_id = c.job_id AND t.table_name = c.table_name)
SELECT job_id, lower(name) AS lower_name, arg_max(name, (ord, pos)) AS name FROM n GROUP BY ALL"""


@query("identifier_case_map", SQL_CASE_MAP)
def identifier_case_map(t):
    return catalog.identifier_case_map(catalog_of(t))


@query("identifier_case_map_extracts", SQL_CASE_MAP)
def identifier_case_map_extracts(t):
    return catalog.case_map_from_extracts(t.sv_tables, t.sv_columns)
