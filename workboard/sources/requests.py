"""Request batches derived from the driver tables (FIXTURES.md §5).

They stand in for the stream of API calls the reference serves one at a time.
Every batch grows linearly with its source table; none is a sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.sources.workspace import read_driver_table


def _t(spark, sf_dir, name):
    return read_driver_table(spark, sf_dir, name)


def onboard_reqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One onboarding request per part: blank names, bad emails, odd job roles,
    and emails that collide with users or with each other."""
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(
        k.alias("seq"),
        F.when(k % 10 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("name"),
        F.when(k % 7 == 0, F.lit("no-at-sign"))
         .when(k % 5 == 0, F.concat(F.lit(" CUSTOMER#"), F.lpad((k % 50).cast("string"), 9, "0"), F.lit("@EXAMPLE.COM ")))
         .otherwise(F.concat(F.lit("New"), F.floor(k / 3).cast("string"), F.lit("@Example.com"))).alias("email"),
        F.when(k % 4 == 0, "qa  engineer").when(k % 4 == 1, "UI/UX designer")
         .when(k % 4 == 2, "Astronaut").otherwise(" DevOps-Engineer").alias("job_role"),
    )


def link_reqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One add-member request per order: missing, unknown and repeated users, and
    project ids one past the last project."""
    k = F.col("o_orderkey")
    n = _t(spark, sf_dir, "supplier").select((F.count(F.lit(1)) + 1).cast("long")).scalar()
    return _t(spark, sf_dir, "orders").select(
        k.alias("seq"),
        (k % n).cast("long").alias("project_id"),
        F.when(k % 9 == 0, F.lit(None).cast("long"))
         .when(k % 8 == 0, F.col("o_custkey") + 10000000)
         .otherwise(F.col("o_custkey")).alias("user_id"),
    )


def task_reqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One create-task request per order, on the smallest supplier of its lines."""
    k = F.col("o_orderkey")
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    o = _t(spark, sf_dir, "orders")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        k.alias("seq"),
        (F.col("l_suppkey") + F.when(k % 23 == 0, F.lit(10000000)).otherwise(F.lit(0))).alias("project_id"),
        F.when(k % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Do "), k.cast("string"), F.lit(" "))).alias("title"),
        F.when(k % 4 == 0, F.lit("  ")).otherwise(F.lit(" note ")).alias("description"),
        F.when(k % 9 == 0, F.lit(None).cast("long"))
         .when(k % 6 == 0, F.col("o_custkey") + 1)
         .otherwise(F.col("o_custkey")).alias("assigned_to"),
    )


def status_reqs(spark: SparkSession, sf_dir: str, tasks: DataFrame) -> DataFrame:
    """One status change per event: bad statuses, unknown tasks, foreign requesters."""
    return status_reqs_from(_t(spark, sf_dir, "events"), tasks)


def status_reqs_from(e: DataFrame, tasks: DataFrame) -> DataFrame:
    """The status-request mapping over an events DataFrame (batch or stream)."""
    t = tasks.select(F.col("id").alias("_tid"), F.col("assigned_to").alias("_assignee"))
    et = F.col("event_type")
    return e.join(t, e.user_id == t._tid, "left").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(et == "signup", F.col("user_id") + 1000000000).otherwise(F.col("user_id")).alias("task_id"),
        F.when(et == "view", "todo").when(et == "click", "in_progress").when(et == "error", "done")
         .otherwise("completed").alias("status"),
        F.when(F.col("event_id") % 4 == 0, F.lit(0).cast("long"))
         .when(F.col("event_id") % 4 == 1, F.lit(52).cast("long"))
         .otherwise(F.col("_assignee")).alias("requester_id"),
    )


def project_reqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One create-project request per supplier, all by admin 50."""
    k = F.col("s_suppkey")
    return _t(spark, sf_dir, "supplier").select(
        k.alias("seq"),
        F.when(k % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" New "), F.col("s_name"))).alias("name"),
        F.when(k % 2 == 0, F.lit("")).otherwise(F.lit(" about ")).alias("description"),
        F.lit(50).cast("long").alias("creator_id"),
    )


def project_req_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member ids of the project requests: every customer is listed on exactly one
    request (customer key mod supplier count), so the list grows linearly.
    Every 97th id is unknown, admins are replaced by the previous customer, and
    each odd request also lists a small id once more (a duplicate or a new id),
    each even request a NULL id."""
    n = _t(spark, sf_dir, "supplier").select(F.count(F.lit(1)).cast("long")).scalar()
    c = F.col("c_custkey")
    from_customers = _t(spark, sf_dir, "customer").select(
        (c % n).alias("seq"),
        F.when(c % 97 == 0, c + 10000000).when(c % 50 == 0, c - 1).otherwise(c).alias("user_id"))
    s = F.col("s_suppkey")
    extra = _t(spark, sf_dir, "supplier").select(
        s.alias("seq"),
        F.when(s % 2 == 0, F.lit(None).cast("long")).otherwise(s % 40 + 1).alias("user_id"))
    return from_customers.unionByName(extra)


def member_delete_reqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests for accounts in debt (negative balance); every 9th id is unknown."""
    c = F.col("c_custkey")
    return (_t(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
            .select(c.alias("seq"), F.when(c % 9 == 0, c + 10000000).otherwise(c).alias("user_id")))


def project_delete_reqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests for suppliers in debt; every 9th id is unknown."""
    s = F.col("s_suppkey")
    return (_t(spark, sf_dir, "supplier").where(F.col("s_acctbal") < 0)
            .select(s.alias("seq"), F.when(s % 9 == 0, s + 10000000).otherwise(s).alias("project_id")))
