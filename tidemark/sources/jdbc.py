"""Tables of Oracle, MySQL and PostgreSQL through Spark's JDBC source.

Drivers and databases are not part of this package; put the driver's jar on the session's class path.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T

from tidemark.operators.convert import type_for

# Driver class, URL and default port per dialect; how each dialect hashes a key into buckets.
DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "oracle": "oracle.jdbc.OracleDriver",
}
URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
}
PORTS = {"postgresql": 5432, "mysql": 3306, "oracle": 1521}
HASH_BUCKET = {
    "postgresql": "mod(abs(hashtext({key}::text)::bigint), {n})",
    "mysql": "mod(crc32({key}), {n})",
    "oracle": "mod(ora_hash({key}), {n})",
}


@dataclass(frozen=True)
class Connection:
    dialect: str
    host: str
    database: str
    username: str = ""
    password: str = field(default="", repr=False)
    port: int | None = None
    schema: str | None = None
    #: Settings of the driver, such as those for encryption.
    properties: Mapping[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if self.dialect not in DRIVERS:
            raise ValueError(f"unsupported dialect: {self.dialect}")

    @property
    def namespace(self) -> str:
        """Schema on PostgreSQL (public unless given), database on MySQL, user name on Oracle."""
        if self.dialect == "postgresql":
            return self.schema or "public"
        return self.schema or (self.database if self.dialect == "mysql" else self.username.upper())

    @property
    def url(self) -> str:
        return URLS[self.dialect].format(host=self.host, port=self.port or PORTS[self.dialect], database=self.database)


def quoted(dialect: str, name: str) -> str:
    if dialect == "mysql":
        return "`" + name.replace("`", "``") + "`"
    name = name.replace('"', '""')
    return f'"{name.upper() if dialect == "oracle" else name}"'


def literal(dialect: str, text: str) -> str:
    """A text inside a statement; MySQL reads backslashes too."""
    if dialect == "mysql":
        text = text.replace("\\", "\\\\")
    return "'" + text.replace("'", "''") + "'"


def table_path(conn: Connection, table: str) -> str:
    return f"{quoted(conn.dialect, conn.namespace)}.{quoted(conn.dialect, table)}"


def _login(conn: Connection) -> dict[str, str]:
    return {**conn.properties, "url": conn.url, "driver": DRIVERS[conn.dialect], "user": conn.username, "password": conn.password}


def query_options(conn: Connection, text: str) -> dict[str, str]:
    """Options of a read that the database answers as one query."""
    return {**_login(conn), "query": text, "fetchsize": "10000"}


def read_options(
    conn: Connection, table: str, key: str | None = None, bounds: tuple[object, object] | None = None,
    partitions: int = 64, fetchsize: int = 10_000,
) -> dict[str, str]:
    """Options of a read; with a numeric or date key and its bounds the read is split into key ranges."""
    options = {**_login(conn), "dbtable": table_path(conn, table), "fetchsize": str(fetchsize), "pushDownPredicate": "true"}
    if key and bounds and None not in bounds:
        options |= {
            "partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions),
        }
    return options


def hash_predicates(dialect: str, key: str, partitions: int) -> list[str]:
    """Splits by hash for keys without an order Spark can range over; NULL keys go with the first split."""
    splits = hashed(dialect, quoted(dialect, key), partitions)
    splits[0] = f"({splits[0]} OR {quoted(dialect, key)} IS NULL)"
    return splits


def hashed(dialect: str, value: str, partitions: int) -> list[str]:
    bucket = HASH_BUCKET[dialect].format(key=value, n=partitions)
    return [f"{bucket} = {i}" for i in range(partitions)]


def page_predicates(pages: int, partitions: int) -> list[str]:
    """PostgreSQL's splits by ranges of pages: each split reads its own pages alone, the last one also those added meanwhile."""
    edges = sorted({pages * i // partitions for i in range(partitions)})
    splits = [f"ctid >= '({lo},0)'::tid AND ctid < '({hi},0)'::tid" for lo, hi in zip(edges, edges[1:])]
    return [*splits, f"ctid >= '({edges[-1]},0)'::tid"]


def row_predicates(dialect: str, columns: Sequence[str], partitions: int) -> list[str]:
    """Splits of a table without a key: by Oracle's row address, elsewhere by all of the row's columns. Rows that are alike share a split."""
    if dialect == "oracle":
        return hashed(dialect, "rowid", partitions)
    return hashed(dialect, f"concat_ws('|', {', '.join(quoted(dialect, c) for c in columns)})", partitions)


def default_predicates(spark: SparkSession, conn: Connection, table: str, partitions: int) -> list[str]:
    """Splits for a table whose key is not named: pages where it has some, else (views, other dialects) rows."""
    if conn.dialect == "postgresql":
        text = f"SELECT pg_relation_size(to_regclass({literal(conn.dialect, table_path(conn, table))})) / current_setting('block_size')::int AS n"
        pages = spark.read.format("jdbc").options(**query_options(conn, text)).load().first()[0]
        if pages:
            return page_predicates(int(pages), partitions)
    columns = spark.read.format("jdbc").options(**read_options(conn, table)).load().columns if conn.dialect != "oracle" else []
    return row_predicates(conn.dialect, columns, partitions)


def key_bounds(spark: SparkSession, conn: Connection, table: str, key: str) -> tuple[object, object]:
    """Least and greatest key, answered by the database."""
    q = quoted(conn.dialect, key)
    text = f"SELECT min({q}) AS lo, max({q}) AS hi FROM {table_path(conn, table)}"
    row = spark.read.format("jdbc").options(**query_options(conn, text)).load().first()
    return row[0], row[1]


def row_count(spark: SparkSession, conn: Connection, table: str) -> int:
    """``COUNT(*)`` answered by the database; no rows travel."""
    text = f"SELECT count(*) AS n FROM {table_path(conn, table)}"
    return int(spark.read.format("jdbc").options(**query_options(conn, text)).load().first()[0])


def read_table(
    spark: SparkSession, conn: Connection, table: str, key: str | None = None, hash_key: str | None = None, partitions: int = 64
) -> DataFrame:
    """A whole table, read in parallel by key range, by key hash where the key has no numeric order, or else by pages or rows."""
    if key and not hash_key:
        bounds = key_bounds(spark, conn, table, key)
        return spark.read.format("jdbc").options(**read_options(conn, table, key, bounds, partitions)).load()
    options = read_options(conn, table)
    splits = hash_predicates(conn.dialect, hash_key, partitions) if hash_key else default_predicates(spark, conn, table, partitions)
    return spark.read.jdbc(url=options.pop("url"), table=options.pop("dbtable"), predicates=splits, properties=options)


def column_types(schema: T.StructType, lengths: Mapping[str, int], natives: Mapping[str, str] | None = None, source: str = "", target: str = "") -> str:
    """Types of a table Spark creates: text lengths as given, else what the source's native type becomes on the target.

    Columns without either, and native types without a size or rule, get the target's own type for their Spark type.
    """
    out = []
    for f in schema:
        kind = f"VARCHAR({lengths[f.name]})" if f.name in lengths else None
        if kind is None and natives and f.name in natives:
            found = type_for(source, target, natives[f.name])
            if found and found != "string":
                kind = re.sub("^CHAR", "VARCHAR", found.upper())
        if kind:
            name = f.name.replace("`", "``")
            out.append(f"`{name}` {kind}")
    return ", ".join(out)


def write_options(
    conn: Connection, table: str, schema: T.StructType | None = None, lengths: Mapping[str, int] | None = None,
    batchsize: int = 10_000, partitions: int = 32, natives: Mapping[str, str] | None = None, source: str = "",
) -> dict[str, str]:
    """Options of a load: the table is emptied, not dropped; ``partitions`` limits open connections.

    ``natives`` are the columns' types in the ``source`` dialect, from its catalogue.
    """
    options = {
        **_login(conn), "dbtable": table_path(conn, table), "truncate": "true", "batchsize": str(batchsize),
        "numPartitions": str(partitions), "isolationLevel": "READ_COMMITTED",
    }
    if schema is not None and (types := column_types(schema, lengths or {}, natives, source, conn.dialect)):
        options["createTableColumnTypes"] = types
    return options


def write_table(
    df: DataFrame, conn: Connection, table: str, lengths: Mapping[str, int] | None = None, natives: Mapping[str, str] | None = None, source: str = ""
) -> None:
    """Create the table if it is missing, empty it, insert every row."""
    options = write_options(conn, table, df.schema, lengths, natives=natives, source=source)
    df.write.format("jdbc").options(**options).mode("overwrite").save()
