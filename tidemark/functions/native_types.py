"""Native column types, canonical types and the Spark types that hold them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Native type -> canonical type per dialect.
CANONICAL_TYPES = {
    "oracle": {
        "number": "NUMERIC", "varchar2": "VARCHAR", "nvarchar2": "VARCHAR", "char": "CHAR", "clob": "TEXT",
        "nclob": "TEXT", "blob": "BLOB", "date": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT",
        "raw": "BLOB",
    },
    "mysql": {
        "tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INT", "bigint": "BIGINT", "decimal": "NUMERIC",
        "float": "FLOAT", "double": "DOUBLE", "varchar": "VARCHAR", "char": "CHAR", "text": "TEXT",
        "longtext": "TEXT", "date": "DATE", "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "blob": "BLOB",
        "json": "JSON",
    },
    "postgresql": {
        "smallint": "SMALLINT", "integer": "INT", "bigint": "BIGINT", "numeric": "NUMERIC", "real": "FLOAT",
        "double precision": "DOUBLE", "boolean": "BOOLEAN", "character varying": "VARCHAR", "character": "CHAR",
        "text": "TEXT", "date": "DATE", "timestamp without time zone": "TIMESTAMP",
        "timestamp with time zone": "TIMESTAMPTZ", "bytea": "BLOB", "jsonb": "JSON", "json": "JSON",
        "uuid": "UUID",
    },
}

# Canonical type -> Spark type.
SPARK_TYPES = {
    "SMALLINT": "smallint", "INT": "int", "BIGINT": "bigint", "NUMERIC": "decimal(38,18)", "FLOAT": "float",
    "DOUBLE": "double", "BOOLEAN": "boolean", "VARCHAR": "string", "CHAR": "string", "TEXT": "string",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "BLOB": "binary", "JSON": "string",
    "UUID": "string",
}

# Canonical type -> column type to create on a target.
TARGET_TYPES = {
    "oracle": {
        "SMALLINT": "NUMBER(5)", "INT": "NUMBER(10)", "BIGINT": "NUMBER(19)", "NUMERIC": "NUMBER", "FLOAT": "FLOAT",
        "DOUBLE": "FLOAT", "BOOLEAN": "CHAR(1)", "VARCHAR": "VARCHAR2(4000)", "CHAR": "CHAR(1)", "TEXT": "CLOB",
        "DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMP WITH TIME ZONE", "BLOB": "BLOB",
        "JSON": "CLOB", "UUID": "CHAR(36)",
    },
    "mysql": {
        "SMALLINT": "SMALLINT", "INT": "INT", "BIGINT": "BIGINT", "NUMERIC": "DECIMAL(38,18)", "FLOAT": "FLOAT",
        "DOUBLE": "DOUBLE", "BOOLEAN": "TINYINT(1)", "VARCHAR": "VARCHAR(4000)", "CHAR": "CHAR(1)",
        "TEXT": "LONGTEXT", "DATE": "DATE", "TIMESTAMP": "DATETIME(6)", "TIMESTAMPTZ": "DATETIME(6)",
        "BLOB": "LONGBLOB", "JSON": "JSON", "UUID": "CHAR(36)",
    },
    "postgresql": {
        "SMALLINT": "SMALLINT", "INT": "INTEGER", "BIGINT": "BIGINT", "NUMERIC": "NUMERIC", "FLOAT": "REAL",
        "DOUBLE": "DOUBLE PRECISION", "BOOLEAN": "BOOLEAN", "VARCHAR": "VARCHAR", "CHAR": "CHAR(1)", "TEXT": "TEXT",
        "DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMPTZ", "BLOB": "BYTEA", "JSON": "JSONB",
        "UUID": "UUID",
    },
}

# Column types that have no counterpart in the other two dialects.
RISKY_TYPES = {
    "oracle": ("CLOB", "BLOB", "LONG", "LONG RAW", "RAW", "XMLTYPE", "ROWID", "UROWID", "BFILE"),
    "mysql": ("ENUM", "SET", "YEAR", "TINYBLOB", "MEDIUMBLOB", "LONGBLOB", "GEOMETRY", "POINT"),
    "postgresql": ("JSONB", "JSON", "ARRAY", "HSTORE", "TSVECTOR", "XML", "CIDR", "INET", "MACADDR"),
}


def base_type(native: Column) -> Column:
    """The type's name without length or precision, lower-cased: VARCHAR2(100) -> varchar2."""
    return F.lower(F.trim(F.substring_index(native, "(", 1)))


def _lookup(table: dict[str, dict[str, str]]) -> Column:
    """A literal map keyed ``dialect.type``: a fixed handful of entries, so no join is needed."""
    pairs = [F.lit(x) for d, m in table.items() for k, v in m.items() for x in (f"{d}.{k}", v)]
    return F.create_map(*pairs)


def canonical_type(dialect: Column, native: Column) -> Column:
    """NULL when the dialect's map does not know the type."""
    return _lookup(CANONICAL_TYPES)[F.concat_ws(".", dialect, base_type(native))]


def spark_type(canonical: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SPARK_TYPES.items() for x in kv])[canonical]


def target_type(dialect: Column, canonical: Column) -> Column:
    return _lookup(TARGET_TYPES)[F.concat_ws(".", dialect, canonical)]


def is_risky(dialect: Column, native: Column) -> Column:
    hit = F.lit(False)
    for name, types in RISKY_TYPES.items():
        hit = hit | ((dialect == name) & F.upper(base_type(native)).isin(*types))
    return hit
