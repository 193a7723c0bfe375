"""Object catalogues of whole estates, built from extracts of the databases' system views.

Every extract carries ``job_id`` and ``dialect``; one set of joins serves all jobs at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.names import is_safe_identifier, is_system_schema, quote_ident
from tidemark.functions.native_types import canonical_type, spark_type, target_type
from tidemark.operators.joins import shuffled
from tidemark.operators.ordering import RANGE, TIE, in_ranges, running, text_parts
from tidemark.session import checkpoint_path, discard, scratch_path, settled

# Kinds of objects, in the order they are listed and scripted.
LIST_ORDER = ("table", "view", "procedure", "function", "trigger", "foreign_key")
SCRIPT_ORDER = LIST_ORDER

KEY = ("job_id", "schema_name", "table_name")


def ranked(column: Column, values: Sequence[str], default: int = 99) -> Column:
    out = F.lit(default)
    for i, value in reversed(list(enumerate(values))):
        out = F.when(column == value, i).otherwise(out)
    return out


def ordered_list(position: Column, value: Column) -> Column:
    """Values of a group by position. Only for groups a database bounds itself: columns of a table or key."""
    pairs = F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def list_objects(
    tables: DataFrame, views: DataFrame, routines: DataFrame, triggers: DataFrame, namespace: str | None = None
) -> DataFrame:
    """All user objects: base tables, views, procedures, functions and non-internal triggers."""
    none = F.lit(None).cast("string")

    def shape(df: DataFrame, kind: Column, name: str, owner: Column = none) -> DataFrame:
        return df.select(
            "job_id", "dialect", kind.alias("object_type"), "schema_name", F.col(name).alias("object_name"),
            owner.alias("table_name"), "definition",
        )

    found = (
        shape(tables.filter(F.col("table_type") == "BASE TABLE"), F.lit("table"), "table_name")
        .unionByName(shape(views, F.lit("view"), "view_name"))
        .unionByName(
            shape(routines.filter(F.col("routine_kind").isin("procedure", "function")), F.col("routine_kind"), "routine_name")
        )
        .unionByName(shape(triggers.filter(~F.col("is_internal")), F.lit("trigger"), "trigger_name", F.col("table_name")))
    )
    if namespace is not None:
        return found.filter(F.col("schema_name") == namespace)
    return drop_system_objects(found)


def drop_system_objects(objects: DataFrame) -> DataFrame:
    return objects.filter(~is_system_schema(F.col("dialect"), F.col("schema_name")))


def columns_with_pk(columns: DataFrame, constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Columns with their nullability and whether they are part of the primary key."""
    keys = (
        constraints.filter(F.col("constraint_type") == "PRIMARY KEY")
        .select(*KEY, "constraint_name")
        .join(shuffled(key_usage.select(*KEY, "constraint_name", "column_name")), [*KEY, "constraint_name"])
        .select(*KEY, "column_name", F.lit(True).alias("_pk"))
        .distinct()
    )
    return columns.join(shuffled(keys), [*KEY, "column_name"], "left").select(
        "job_id", "dialect", "schema_name", "table_name", "column_name", "ordinal", "native_type",
        (F.col("is_nullable").isin("YES", "Y")).alias("nullable"),
        "default_value",
        (F.col("_pk").isNotNull() | F.coalesce(F.col("column_key") == "PRI", F.lit(False))).alias("is_primary_key"),
    )


def referenced_columns(constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Where a foreign key names the key it refers to, that key's columns, as a reference extract."""
    refs = constraints.filter(F.col("ref_constraint_name").isNotNull()).select(
        "job_id", "schema_name", "constraint_name", "ref_constraint_name"
    )
    cols = key_usage.select(
        "job_id", "schema_name", F.col("constraint_name").alias("ref_constraint_name"),
        F.col("table_name").alias("ref_table_name"), F.col("column_name").alias("ref_column_name"), "position",
    )
    return refs.join(shuffled(cols), ["job_id", "schema_name", "ref_constraint_name"]).drop("ref_constraint_name")


def foreign_keys(constraints: DataFrame, key_usage: DataFrame, ref_usage: DataFrame) -> DataFrame:
    """One row per foreign key; both column lists in key order, matched by position."""
    own = ["job_id", "schema_name", "constraint_name"]
    fks = constraints.filter(F.col("constraint_type") == "FOREIGN KEY").select("dialect", *own, "table_name")
    child = key_usage.select(*own, "column_name", "position")
    parent = ref_usage.select(*own, "ref_table_name", "ref_column_name", "position")
    return (
        fks.join(shuffled(child), own)
        .join(shuffled(parent), [*own, "position"])
        .groupBy("job_id", "dialect", "schema_name", "constraint_name", "table_name", "ref_table_name")
        .agg(
            ordered_list(F.col("position"), F.col("column_name")).alias("columns"),
            ordered_list(F.col("position"), F.col("ref_column_name")).alias("ref_columns"),
        )
    )


def fk_ddl(fks: DataFrame) -> DataFrame:
    """``ALTER TABLE … ADD CONSTRAINT`` text per foreign key, quoted for its dialect."""
    q = lambda c: quote_ident(F.col("dialect"), c)
    cols = lambda name: F.array_join(F.transform(F.col(name), q), ", ")
    text = F.format_string(
        "ALTER TABLE %s ADD CONSTRAINT %s FOREIGN KEY (%s) REFERENCES %s (%s)",
        q(F.col("table_name")), q(F.col("constraint_name")), cols("columns"), q(F.col("ref_table_name")), cols("ref_columns"),
    )
    return fks.withColumn("definition", text)


def _table_ddl(columns: Column) -> Column:
    """``CREATE TABLE`` text from the gathered columns of a table, names written as its own dialect reads them.

    MySQL quotes every name. Oracle and PostgreSQL leave names plain that they would store in the same case; PostgreSQL's columns stay plain.
    """
    dialect = F.col("dialect")
    kept = lambda c: F.when(dialect == "oracle", c.rlike("^[A-Z][A-Z0-9_$#]*$")).otherwise(c.rlike("^[a-z_][a-z0-9_$]*$"))
    plain = lambda c: (
        F.when(dialect == "mysql", quote_ident(F.lit("mysql"), c)).when(kept(c), c).otherwise(quote_ident(F.lit("postgresql"), c))
    )
    named = lambda c: F.when(dialect == "postgresql", c).otherwise(plain(c))
    line = lambda c: F.concat(named(c["column_name"]), F.lit(" "), c["native_type"], F.when(c["nullable"], "").otherwise(" NOT NULL"))
    return F.concat(
        F.lit("CREATE TABLE "), plain(F.col("schema_name")), F.lit("."), plain(F.col("table_name")),
        F.lit(" ("), F.array_join(F.transform(columns, line), ", "), F.lit(");"),
    )


def table_columns(columns: DataFrame) -> DataFrame:
    """Columns gathered per table as an ordered array of records."""
    record = F.struct("column_name", "native_type", "nullable", "default_value", "is_primary_key")
    return columns.groupBy("dialect", *KEY).agg(ordered_list(F.col("ordinal"), record).alias("columns"))


def table_ddl(columns: DataFrame) -> DataFrame:
    """``CREATE TABLE`` text per table, columns in their order."""
    return table_columns(columns).select("job_id", "dialect", "schema_name", "table_name", _table_ddl(F.col("columns")).alias("definition"))


def build_catalog(objects: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """One row per object with its position in the job; tables carry columns and, lacking a text, a synthesised one.

    Columns and synthesised texts are far wider than the rest, so they are settled once, stay behind while objects are numbered and join them
    by table and the dialect of its columns. Each step is settled before the next, so that the disk holds the shuffles of one step at a time.
    """
    spark = objects.sparkSession
    key = ["job_id", "schema_name", "object_name", "object_type"]
    per_table = settled(table_columns(columns).select(
        "job_id", "schema_name", F.col("table_name").alias("object_name"), F.lit("table").alias("object_type"),
        "columns", _table_ddl(F.col("columns")).alias("_ddl"), F.col("dialect").alias("_of"),
    ), scratch_path(spark, "table-columns"))
    keys = scratch_path(spark, "foreign-keys")
    listed = objects.unionByName(
        fk_ddl(settled(fks, keys)).select(
            "job_id", "dialect", F.lit("foreign_key").alias("object_type"), "schema_name",
            F.col("constraint_name").alias("object_name"), "table_name", "definition",
        )
    )
    named = [c for c in listed.columns if c not in (*key, "definition")]
    text = F.coalesce("definition", "_ddl")
    placed = listed.join(shuffled(per_table), key, "left").withColumn("_rank", ranked(F.col("object_type"), LIST_ORDER))
    told = placed.withColumn(TIE, F.xxhash64(*key, *named, text, "columns", "_rank")).drop("columns", "_ddl")
    order = ["_rank", "schema_name", "object_name"]
    ranged = in_ranges(told, ["job_id"], order)
    discard(spark, keys)
    numbered = settled(running(ranged, ["job_id"], order, F.lit(1), "ord").drop(RANGE, TIE), scratch_path(spark, "numbered-objects"))
    if place := checkpoint_path(ranged):
        discard(spark, place)
    again = per_table.withColumnRenamed("_of", "_from")
    same = [numbered[c] == again[c] for c in key] + [F.col("_of").eqNullSafe(F.col("_from"))]
    return numbered.join(shuffled(again), same, "left").select(*[numbered[c] for c in (*key, *named)], text.alias("definition"), "columns", "ord")


def catalog_from_extracts(extracts: Mapping[str, DataFrame]) -> DataFrame:
    """The catalogue of everything in the extracts (see ``sources.system_views`` for their columns)."""
    x = extracts
    refs = referenced_columns(x["constraints"], x["key_usage"])
    if "ref_usage" in x:
        refs = refs.unionByName(x["ref_usage"].select(refs.columns))
    return build_catalog(
        list_objects(x["tables"], x["views"], x["routines"], x["triggers"]),
        columns_with_pk(x["columns"], x["constraints"], x["key_usage"]),
        foreign_keys(x["constraints"], x["key_usage"], refs),
    )


def dependency_edges(fks: DataFrame) -> DataFrame:
    """Distinct (child, parent) tables with the position at which the pair is first seen."""
    return fks.groupBy("job_id", F.col("table_name").alias("child"), F.col("ref_table_name").alias("parent")).agg(
        F.min(F.struct(F.col("columns")[0].alias("column"), "constraint_name")).alias("first_seen")
    )


def dependency_lists(edges: DataFrame) -> DataFrame:
    """Per child table its parents in first-seen order; a table has no more parents than foreign keys."""
    return edges.groupBy("job_id", "child").agg(ordered_list(F.col("first_seen"), F.col("parent")).alias("dependencies"))


def summarize_objects(catalog: DataFrame) -> DataFrame:
    """One line of text per object, as used for embeddings."""
    names = F.array_join(F.transform(F.col("columns"), lambda c: c["column_name"]), ", ")
    head = F.concat(F.col("object_type"), F.lit(" "), F.col("schema_name"), F.lit("."), F.col("object_name"))
    has = F.coalesce(F.size("columns"), F.lit(0)) > 0
    return catalog.select(
        "job_id", "object_type", "object_name",
        F.concat_ws(" | ", head, F.when(has, F.concat(F.lit("columns: "), names))).alias("summary"),
    )


def map_types(columns: DataFrame, target_dialect: Column) -> DataFrame:
    """Canonical, Spark and target type per column; ``mapped`` is false for types the map does not know."""
    canon = canonical_type(F.col("dialect"), F.col("native_type"))
    return (
        columns.withColumn("canonical_type", canon)
        .withColumn("spark_type", spark_type(F.col("canonical_type")))
        .withColumn("target_type", target_type(target_dialect, F.col("canonical_type")))
        .withColumn("mapped", F.col("canonical_type").isNotNull())
    )


def type_diff(src_columns: DataFrame, tgt_columns: DataFrame) -> DataFrame:
    """Columns whose canonical type or nullability differs between the sides, or that one side lacks."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            "job_id", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"),
            canonical_type(F.col("dialect"), F.col("native_type")).alias(f"type_{tag}"),
            F.col("nullable").alias(f"nullable_{tag}"), F.lit(True).alias(f"_{tag}"),
        )

    both = side(src_columns, "source").join(side(tgt_columns, "target"), ["job_id", "table_name", "column_name"], "full_outer")
    finding = (
        F.when(F.col("_target").isNull(), "only_source")
        .when(F.col("_source").isNull(), "only_target")
        .when(~F.col("type_source").eqNullSafe(F.col("type_target")), "type")
        .when(F.col("nullable_source") != F.col("nullable_target"), "nullability")
    )
    return both.withColumn("finding", finding).filter(F.col("finding").isNotNull()).drop("_source", "_target")


def invalid_identifiers(catalog: DataFrame) -> DataFrame:
    """Objects whose names cannot be used unquoted in generated statements."""
    return catalog.filter(~is_safe_identifier(F.col("object_name")))


def schema_script(catalog: DataFrame, part_size: int = 1000) -> DataFrame:
    """DDL script per job and kind of object, in parts; objects without text are left out.

    Parts hold at most ``part_size`` catalogue positions, so a job of any size is scripted without
    gathering it in one task. Read in order of (type_rank, part_no) and joined by a blank line, the
    parts are the job's script.
    """
    text = F.regexp_replace(F.regexp_replace(F.col("definition"), r"\s+$", ""), ";+$", "")
    chunk = F.concat(
        F.lit("-- "), F.upper("object_type"), F.lit(": "), F.col("schema_name"), F.lit("."), F.col("object_name"),
        F.lit("\n"), text, F.lit(";"),
    )
    rows = catalog.filter(F.col("definition").isNotNull() & (F.col("definition") != "")).select(
        "job_id", ranked(F.col("object_type"), SCRIPT_ORDER).alias("type_rank"), "ord", chunk.alias("chunk")
    ).filter(F.col("type_rank") < len(SCRIPT_ORDER))
    return text_parts(rows, ["job_id", "type_rank"], "ord", "chunk", "\n\n", part_size).withColumnRenamed("text", "script")


def case_map_from_extracts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``identifier_case_map`` straight from the extracts of tables and columns: the same order, with nothing numbered or gathered."""
    key = ["job_id", "schema_name", "table_name"]
    base = drop_system_objects(tables.filter(F.col("table_type") == "BASE TABLE")).select(*key)
    own = base.select(*key, F.col("table_name").alias("name"), F.lit(-1).alias("ordinal"))
    cols = columns.select(*key, F.col("column_name").alias("name"), "ordinal").join(shuffled(base), key, "left_semi")
    return own.unionByName(cols).groupBy("job_id", F.lower("name").alias("lower_name")).agg(
        F.max_by("name", F.struct("schema_name", "table_name", "ordinal")).alias("name")
    )


def identifier_case_map(catalog: DataFrame) -> DataFrame:
    """Lower-cased name to the spelling seen last, over tables and their columns in catalogue order."""
    tables = catalog.filter(F.col("object_type") == "table")
    own = tables.select("job_id", F.col("object_name").alias("name"), "ord", F.lit(-1).alias("pos"))
    cols = tables.select("job_id", F.col("ord"), F.posexplode("columns").alias("pos", "c")).select(
        "job_id", F.col("c.column_name").alias("name"), "ord", "pos"
    )
    return own.unionByName(cols).groupBy("job_id", F.lower("name").alias("lower_name")).agg(
        F.max_by("name", F.struct("ord", "pos")).alias("name")
    )
