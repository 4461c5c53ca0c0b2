"""The four workspace tables (A1): users, projects, project_members, tasks.

``derive_workspace`` maps the driver's TPC-H-like parquet tables onto the
workspace model (the mapping is documented in FIXTURES.md); ``read_workspace``
reads a snapshot written by ``sources.snapshot.write_snapshot``. Both return a
``Workspace``: a plain mapping of table name to DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("users", "projects", "project_members", "tasks")

SCHEMAS = {
    "users": T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), True),
        T.StructField("email", T.StringType(), True),
        T.StructField("role", T.StringType(), True),
        T.StructField("job_role", T.StringType(), True),
        T.StructField("is_first_login", T.BooleanType(), True),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]),
    "projects": T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("created_by", T.LongType(), True),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]),
    "project_members": T.StructType([
        T.StructField("project_id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), False),
    ]),
    "tasks": T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("project_id", T.LongType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("assigned_to", T.LongType(), True),
        T.StructField("due_date", T.TimestampNTZType(), True),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]),
}


@dataclass(frozen=True)
class Workspace:
    users: DataFrame
    projects: DataFrame
    project_members: DataFrame
    tasks: DataFrame

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def replace(self, **tables: DataFrame) -> "Workspace":
        cur = {n: self[n] for n in TABLES}
        cur.update(tables)
        return Workspace(**cur)

    def items(self):
        return [(n, self[n]) for n in TABLES]


# Declared schemas of the driver tables this library reads (no inference: the
# planner does not have to open file footers, and a drifted file fails loudly).
DRIVER_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _day_offset(base: str, days: F.Column) -> F.Column:
    return F.date_add(F.lit(base).cast("date"), days.cast("int")).cast("timestamp_ntz")


def derive_users(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("id"),
        F.concat(F.col("c_mktsegment"), F.lit(" "), (k % 700).cast("string")).alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(k % 50 == 0, "admin").otherwise("member").alias("role"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("job_role"),
        (k % 3 == 0).alias("is_first_login"),
        _day_offset("1995-01-01", k % 365).alias("created_at"),
    )


def derive_projects(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("id"),
        F.col("s_name").alias("name"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))).alias("description"),
        # members (who can be deleted), admins, an unknown user (0), or nobody
        F.when(k % 11 == 0, F.lit(None).cast("long")).when(k % 2 == 1, k).otherwise((k % 3) * 50).cast("long").alias("created_by"),
        _day_offset("1995-01-01", k % 90).alias("created_at"),
    )


def derive_project_members(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The pairs are dealt to a fixed number of tasks: AQE merges the partitions of its own shuffles by
    their compressed size, and pairs of ids pack so well that a task's hash tables and sorts would grow
    with the table. Audits and joins on the pair use this dealing too."""
    li = lineitem.select("l_orderkey", "l_suppkey")
    o = orders.select("o_orderkey", "o_custkey")
    parts = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("l_suppkey").alias("project_id"), F.col("o_custkey").alias("user_id"))
              .repartition(parts, "project_id", "user_id")
              .dropDuplicates(["project_id", "user_id"]))


def derive_tasks(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    # ~9% of tasks point past the last project: a lazy scalar subquery, not a driver round trip.
    n_slots = supplier.select(F.floor(F.count(F.lit(1)) * 1.1).cast("long")).scalar()
    prio = F.col("o_orderpriority")
    due = (F.when(prio == "1-URGENT", F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS"))
            .when(prio == "2-HIGH", F.col("o_orderdate") + F.expr("INTERVAL 14 DAYS"))
            .when(prio == "3-MEDIUM", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
            .when(prio == "5-LOW", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")))
    return orders.select(
        k.alias("id"),
        (k % n_slots).cast("long").alias("project_id"),
        F.concat(F.lit("Task "), k.cast("string")).alias("title"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(prio).alias("description"),
        F.when(k % 211 == 0, F.lit(None).cast("string"))
         .when(k % 307 == 0, "blocked")
         .when(F.col("o_orderstatus") == "F", "completed")
         .when(F.col("o_orderstatus") == "P", "in_progress")
         .otherwise("todo").alias("status"),
        F.when(k % 13 == 0, F.lit(None).cast("long"))
         .when(k % 101 == 0, F.col("o_custkey") + 10000000)
         .otherwise(F.col("o_custkey")).alias("assigned_to"),
        due.cast("timestamp_ntz").alias("due_date"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


def derive_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The four tables as lazy views over the driver parquet (FIXTURES.md §4)."""
    t = lambda n: read_driver_table(spark, sf_dir, n)
    return Workspace(
        users=derive_users(t("customer")),
        projects=derive_projects(t("supplier")),
        project_members=derive_project_members(t("lineitem"), t("orders")),
        tasks=derive_tasks(t("orders"), t("supplier")),
    )


def empty_workspace(spark: SparkSession) -> Workspace:
    return Workspace(**{n: spark.createDataFrame([], SCHEMAS[n]) for n in TABLES})


def workspace_from_rows(spark: SparkSession, **rows) -> Workspace:
    """Small literal workspaces for tests (seed data, edge rows)."""
    return Workspace(**{n: spark.createDataFrame(rows.get(n, []), SCHEMAS[n]) for n in TABLES})


def register_views(ws: Workspace, prefix: str = "") -> None:
    """Expose the tables to ``spark.sql`` as temp views."""
    for name, df in ws.items():
        df.createOrReplaceTempView(prefix + name)


KEY_COLUMNS = {"users": ["id"], "projects": ["id", "created_by"], "project_members": ["project_id", "user_id"],
               "tasks": ["id", "project_id", "assigned_to"]}


def schemas_for(key_type: T.DataType) -> dict[str, T.StructType]:
    """The table schemas with ids of another type (for example text for UUIDs)."""
    return {name: T.StructType([T.StructField(f.name, key_type if f.name in KEY_COLUMNS[name] else f.dataType, f.nullable)
                                for f in SCHEMAS[name]]) for name in TABLES}


def key_type_of(ws: Workspace) -> T.DataType:
    """The one type of all key columns; raises if they differ (see ``cast_keys``)."""
    kinds = {ws[name].schema[k].dataType.simpleString(): ws[name].schema[k].dataType for name in TABLES for k in KEY_COLUMNS[name]}
    if len(kinds) != 1:
        raise ValueError(f"key columns of several types: {sorted(kinds)}")
    return next(iter(kinds.values()))


def cast_keys(ws: Workspace, dtype: str) -> Workspace:
    """C11: give every key column one type at load time (the reference compares
    ``a::text = b::text`` in joins because id types drifted; casting once keeps
    joins on typed keys)."""
    out = {}
    for name, df in ws.items():
        for k in KEY_COLUMNS[name]:
            df = df.withColumn(k, F.col(k).cast(dtype))
        out[name] = df
    return Workspace(**out)


def jdbc_slices(key: str, num_partitions: int) -> list[str]:
    """Even slices of a PostgreSQL table by a hash of its text key. The hash is widened
    before its sign goes, as the smallest integer has no absolute value."""
    return [f"abs(hashtext({key})::bigint) % {num_partitions} = {i}" for i in range(num_partitions)]


def read_jdbc_workspace(spark: SparkSession, url: str, properties: dict, *, num_partitions: int = 64) -> Workspace:
    """A1 for a live PostgreSQL store: parallel reads in hash slices of each table's key
    (ids are UUIDs, so ranges don't fit), read as text. Not exercised offline: it needs a
    database."""
    def read(table, key):
        cols = ", ".join(f"{f.name}::text AS {f.name}" if f.name in KEY_COLUMNS[table] else f.name for f in SCHEMAS[table])
        # the slices see the key under another name: a query's own columns are text already
        return spark.read.jdbc(url, f"(SELECT {cols}, {key} AS slice_key FROM {table}) t", properties=properties,
                               predicates=jdbc_slices("slice_key", num_partitions)).drop("slice_key")
    return Workspace(**{name: read(name, "project_id::text || user_id::text" if name == "project_members" else "id::text")
                        for name in TABLES})
