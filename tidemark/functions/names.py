"""Identifier rules of the three dialects as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Dialects, the safe identifier pattern, and the schemas that belong to the database itself.
DIALECTS = ("oracle", "mysql", "postgresql")
SAFE_IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_$#]*$"
SYSTEM_SCHEMAS = {
    "oracle": (
        "SYS", "SYSTEM", "OUTLN", "XDB", "CTXSYS", "MDSYS", "ORDSYS", "ORDDATA", "DBSNMP", "APPQOSSYS",
        "GSMADMIN_INTERNAL", "WMSYS", "LBACSYS",
    ),
    "mysql": ("information_schema", "mysql", "performance_schema", "sys"),
    "postgresql": ("pg_catalog", "information_schema", "pg_toast"),
}


def is_safe_identifier(name: Column) -> Column:
    return name.rlike(SAFE_IDENTIFIER)


def is_system_schema(dialect: Column, schema: Column) -> Column:
    """True for schemas of the database itself; Oracle folds to upper case first."""
    folded = F.when(dialect == "oracle", F.upper(schema)).otherwise(schema)
    hit = F.lit(False)
    for name, schemas in SYSTEM_SCHEMAS.items():
        hit = hit | ((dialect == name) & folded.isin(*schemas))
    return hit


def quote_ident(dialect: Column, name: Column) -> Column:
    """Quoted name: double quotes, backticks on MySQL, upper-cased first on Oracle; inner quotes doubled."""
    double = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    tick = F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))
    return F.when(dialect == "mysql", tick).when(dialect == "oracle", F.upper(double)).otherwise(double)
