"""Extracts of the system views a catalogue is built from, for a whole database at once.

Each dialect answers the same eight questions in the same columns, so the catalogue operators never
look at the dialect's own views. One query per question and database replaces one per table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.jdbc import Connection, literal, query_options

COLUMNS = {
    "tables": ("schema_name", "table_name", "table_type", "definition"),
    "views": ("schema_name", "view_name", "definition"),
    "routines": ("schema_name", "routine_name", "routine_kind", "definition"),
    "triggers": ("schema_name", "trigger_name", "table_name", "is_internal", "definition"),
    "columns": ("schema_name", "table_name", "column_name", "ordinal", "native_type", "is_nullable", "default_value", "column_key"),
    "constraints": ("schema_name", "table_name", "constraint_name", "constraint_type", "ref_constraint_name"),
    "key_usage": ("schema_name", "table_name", "constraint_name", "column_name", "position"),
    "ref_usage": ("schema_name", "constraint_name", "ref_table_name", "ref_column_name", "position"),
}

# The questions in each dialect's SQL as the columns in the order above and what they are read from. Only MySQL names the
# referenced columns itself; the others name the referenced key, and its columns are joined in Spark. PostgreSQL and MySQL have no
# text of a table that a query could give; it is put together from the columns.
QUESTIONS = {
    "postgresql": {
        "tables": (("table_schema", "table_name", "table_type", "NULL::text"), "information_schema.tables"),
        "views": (("schemaname", "viewname", "'CREATE VIEW ' || quote_ident(viewname) || ' AS ' || definition"), "pg_views"),
        "routines": (
            ("s.nspname", "r.proname", "CASE r.prokind WHEN 'p' THEN 'procedure' WHEN 'f' THEN 'function' ELSE 'other' END",
             "CASE WHEN r.prokind IN ('p', 'f') THEN pg_get_functiondef(r.oid) END"),
            "pg_proc r JOIN pg_namespace s ON s.oid = r.pronamespace",
        ),
        "triggers": (
            ("s.nspname", "g.tgname", "o.relname", "g.tgisinternal", "pg_get_triggerdef(g.oid, true)"),
            "pg_trigger g JOIN pg_class o ON o.oid = g.tgrelid JOIN pg_namespace s ON s.oid = o.relnamespace",
        ),
        "columns": (
            ("table_schema", "table_name", "column_name", "ordinal_position", "data_type", "is_nullable", "column_default", "NULL::text"),
            "information_schema.columns",
        ),
        "constraints": (
            ("k.table_schema", "k.table_name", "k.constraint_name", "k.constraint_type", "r.unique_constraint_name"),
            "information_schema.table_constraints k LEFT JOIN information_schema.referential_constraints r "
            "ON r.constraint_schema = k.constraint_schema AND r.constraint_name = k.constraint_name",
        ),
        "key_usage": (
            ("table_schema", "table_name", "constraint_name", "column_name", "coalesce(position_in_unique_constraint, ordinal_position)"),
            "information_schema.key_column_usage",
        ),
    },
    "mysql": {
        "tables": (("table_schema", "table_name", "table_type", "NULL"), "information_schema.tables"),
        "views": (("table_schema", "table_name", "concat('CREATE VIEW `', table_name, '` AS ', view_definition)"), "information_schema.views"),
        "routines": (("routine_schema", "routine_name", "lower(routine_type)", "routine_definition"), "information_schema.routines"),
        "triggers": (("trigger_schema", "trigger_name", "event_object_table", "0", "action_statement"), "information_schema.triggers"),
        "columns": (
            ("table_schema", "table_name", "column_name", "ordinal_position", "column_type", "is_nullable", "column_default", "column_key"),
            "information_schema.columns",
        ),
        "constraints": (("table_schema", "table_name", "constraint_name", "constraint_type", "NULL"), "information_schema.table_constraints"),
        "key_usage": (("table_schema", "table_name", "constraint_name", "column_name", "ordinal_position"), "information_schema.key_column_usage"),
        "ref_usage": (
            ("table_schema", "constraint_name", "referenced_table_name", "referenced_column_name", "ordinal_position"),
            "(SELECT * FROM information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL) u",
        ),
    },
    "oracle": {
        "tables": (("owner", "table_name", "'BASE TABLE'", "dbms_metadata.get_ddl('TABLE', table_name, owner)"), "all_tables"),
        "views": (("owner", "view_name", "dbms_metadata.get_ddl('VIEW', view_name, owner)"), "all_views"),
        "routines": (
            ("owner", "object_name", "lower(object_type)", "dbms_metadata.get_ddl(object_type, object_name, owner)"),
            "(SELECT * FROM all_objects WHERE object_type IN ('PROCEDURE', 'FUNCTION')) o",
        ),
        "triggers": (("owner", "trigger_name", "table_name", "0", "dbms_metadata.get_ddl('TRIGGER', trigger_name, owner)"), "all_triggers"),
        "columns": (("owner", "table_name", "column_name", "column_id", "data_type", "nullable", "NULL", "NULL"), "all_tab_columns"),
        "constraints": (
            ("owner", "table_name", "constraint_name", "CASE constraint_type WHEN 'P' THEN 'PRIMARY KEY' WHEN 'R' THEN 'FOREIGN KEY' ELSE constraint_type END",
             "r_constraint_name"),
            "all_constraints",
        ),
        "key_usage": (("owner", "table_name", "constraint_name", "column_name", "position"), "all_cons_columns"),
    },
}


def extract_query(dialect: str, name: str, namespaces: Sequence[str] = ()) -> str:
    """The SQL of one question, each column under its own name, held to some namespaces or over the whole database."""
    chosen, origin = QUESTIONS[dialect][name]
    text = f"SELECT {', '.join(f'{c} AS {n}' for c, n in zip(chosen, COLUMNS[name], strict=True))} FROM {origin}"
    if namespaces:
        text += f" WHERE {chosen[0]} IN ({', '.join(literal(dialect, n) for n in namespaces)})"
    return text


def read_extract(spark: SparkSession, conn: Connection, name: str, job_id, namespaces: Sequence[str] = ()) -> DataFrame:
    """One extract, tagged with its job and dialect."""
    text = extract_query(conn.dialect, name, namespaces)
    rows = spark.read.format("jdbc").options(**query_options(conn, text)).load().toDF(*COLUMNS[name])
    if "is_internal" in rows.columns:
        rows = rows.withColumn("is_internal", F.col("is_internal").cast("boolean"))
    return rows.withColumn("job_id", F.lit(job_id)).withColumn("dialect", F.lit(conn.dialect))


def read_extracts(spark: SparkSession, conn: Connection, job_id, namespaces: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All extracts of the connection's namespace, of the ``namespaces`` named, or (none named) of the whole database.

    Append them to files per question to gather an estate.
    """
    chosen = (conn.namespace,) if namespaces is None else tuple(namespaces)
    return {name: read_extract(spark, conn, name, job_id, chosen) for name in QUESTIONS[conn.dialect]}
