"""Counters and rollups.

Fan-out joins are never materialised: every 1:N side is aggregated to one row
per key first (partial aggregation happens map-side, so a hot key costs one
row per map task), then the small per-key results are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.order import newest_first
from workboard.functions.status import as_count, is_overdue
from workboard.functions.text import display_job_role


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def stats_columns(as_of) -> list[Column]:
    return [
        as_count(F.count(F.lit(1))).alias("total_tasks"),
        as_count(_count_if(F.col("status") == "completed")).alias("completed_tasks"),
        as_count(_count_if(F.col("status") == "in_progress")).alias("in_progress_tasks"),
        as_count(_count_if(is_overdue(as_of))).alias("overdue_tasks"),
    ]


def task_stats(tasks: DataFrame, as_of, user_id=None) -> DataFrame:
    """One row of counters (zeros when empty), optionally for one assignee."""
    if user_id is not None:
        tasks = tasks.where(F.col("assigned_to") == F.lit(user_id))
    return tasks.agg(*stats_columns(as_of))


def task_counters(tasks: DataFrame, as_of) -> DataFrame:
    """D10's counters in one scan: the four counters of all tasks, by status, by project and by assignee
    (column ``part``; the other keys are NULL), by grouping sets with partial aggregation. Unlike D1,
    an empty table has no row."""
    sets = [[], ["status"], ["project_id"], ["assigned_to"]]
    keyed = tasks.select("status", "project_id", "assigned_to", "due_date", F.col("status").alias("_status"))
    counters = [as_count(F.count(F.lit(1))).alias("total_tasks"),
                as_count(_count_if(F.col("_status") == "completed")).alias("completed_tasks"),
                as_count(_count_if(F.col("_status") == "in_progress")).alias("in_progress_tasks"),
                as_count(_count_if(is_overdue(as_of, "_status"))).alias("overdue_tasks")]
    out = keyed.groupingSets([[F.col(c) for c in x] for x in sets], "status", "project_id", "assigned_to").agg(
        F.grouping_id().alias("_set"), *counters)
    part = F.when(F.col("_set") == 7, "all").when(F.col("_set") == 3, "status").when(F.col("_set") == 5, "project").otherwise("assignee")
    return out.select(part.alias("part"), "status", "project_id", "assigned_to", "total_tasks", "completed_tasks",
                      "in_progress_tasks", "overdue_tasks")


def scoped_task_stats(tasks: DataFrame, as_of, viewer_id, viewer_role) -> DataFrame:
    """B5 + D1/D2: only role 'admin' sees global counters, everyone else their own."""
    return task_stats(tasks, as_of, None if viewer_role == "admin" else viewer_id)


def task_stats_by_viewer(tasks: DataFrame, viewers: DataFrame, as_of) -> DataFrame:
    """B5 for many viewers at once: ``viewers`` (viewer_id, role) with the counters each
    sees, all tasks for role 'admin' and their own for any other role.

    Tasks are counted once per assignee and once as a whole; the whole is one row, so
    giving it to every admin multiplies nothing.
    """
    own = tasks.groupBy(F.col("assigned_to").alias("viewer_id")).agg(*stats_columns(as_of))
    names = ("total_tasks", "completed_tasks", "in_progress_tasks", "overdue_tasks")
    whole = task_stats(tasks, as_of).select(F.struct(*names).alias("all"))
    admin = F.col("role").eqNullSafe("admin")
    return viewers.join(own, "viewer_id", "left").withColumn("all", whole.scalar()).select(
        "viewer_id", "role", *[F.when(admin, F.col("all")[c]).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c in names])


def task_stats_by_member(tasks: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """D2 set form: counters for every user as assignee, zeros kept."""
    per = (tasks.where(F.col("assigned_to").isNotNull())
                .groupBy(F.col("assigned_to").alias("user_id")).agg(*stats_columns(as_of)))
    u = users.select(F.col("id").alias("user_id"))
    zero = F.lit(0)
    return (u.join(per, "user_id", "left")
             .select("user_id", *[F.coalesce(F.col(c), zero).alias(c) for c in
                                  ("total_tasks", "completed_tasks", "in_progress_tasks", "overdue_tasks")]))


def tasks_per_member_name(tasks: DataFrame, users: DataFrame) -> DataFrame:
    """D3: task count per assignee *name* (namesakes merge, R5); bigint count.

    Tasks are counted per assignee first, so the join sees one row per user.
    """
    per = tasks.where(F.col("assigned_to").isNotNull()) \
               .groupBy("assigned_to").agg(F.count("id").alias("n"))
    u = users.select(F.col("id").alias("assigned_to"), F.col("name").alias("member_name"))
    return per.join(u, "assigned_to").groupBy("member_name").agg(F.sum("n").cast("long").alias("total"))


def status_distribution(tasks: DataFrame) -> DataFrame:
    """Rows per status value, NULL and unknown statuses included."""
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("task_count"))


def _links_per_user(pm: DataFrame) -> DataFrame:
    return pm.groupBy("user_id").agg(
        F.countDistinct("project_id").alias("project_count"),
        F.count(F.lit(1)).alias("link_rows"))


def _tasks_per_assignee(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("assigned_to").isNotNull()).groupBy(F.col("assigned_to").alias("user_id")).agg(
        F.count("id").alias("assigned"),
        _count_if(F.col("status") == "completed").alias("completed"))


def _members(users: DataFrame) -> DataFrame:
    return users.where(F.col("role") == "member").select(
        F.col("id").alias("user_id"), "name", "email",
        display_job_role("job_role").alias("job_role"), "created_at")


def member_rollup(users: DataFrame, pm: DataFrame, tasks: DataFrame, sort: bool = True) -> DataFrame:
    """Per member: distinct projects, assigned tasks, completed tasks (zeros kept)."""
    out = (_members(users)
           .join(_links_per_user(pm), "user_id", "left")
           .join(_tasks_per_assignee(tasks), "user_id", "left")
           .select(F.col("user_id").alias("id"), "name", "email", "job_role", "created_at",
                   as_count(F.coalesce("project_count", F.lit(0))).alias("project_count"),
                   as_count(F.coalesce("assigned", F.lit(0))).alias("assigned_task_count"),
                   as_count(F.coalesce("completed", F.lit(0))).alias("completed_task_count")))
    return out.orderBy(*newest_first()) if sort else out


def member_rollup_fanout(users: DataFrame, pm: DataFrame, tasks: DataFrame, sort: bool = True) -> DataFrame:
    """The reference's literal numbers, where ``users ⟕ links ⟕ tasks`` multiplies.

    The joined row count per member is max(links, 1) x tasks, so the counts are
    computed from per-key aggregates instead of materialising the product.
    """
    mult = F.greatest(F.coalesce(F.col("link_rows"), F.lit(0)), F.lit(1))
    out = (_members(users)
           .join(_links_per_user(pm), "user_id", "left")
           .join(_tasks_per_assignee(tasks), "user_id", "left")
           .select(F.col("user_id").alias("id"), "name", "email", "job_role", "created_at",
                   as_count(F.coalesce("project_count", F.lit(0))).alias("project_count"),
                   as_count(mult * F.coalesce("assigned", F.lit(0))).alias("assigned_task_count"),
                   as_count(mult * F.coalesce("completed", F.lit(0))).alias("completed_task_count")))
    return out.orderBy(*newest_first()) if sort else out


def project_roster_long(projects: DataFrame, pm: DataFrame, users: DataFrame) -> DataFrame:
    """D6, long form: one row per (project, member) with the member object fields.

    This replaces the reference's per-project JSON array: an array per project is
    an unbounded group, the long form is not.
    """
    links = pm.select("project_id", "user_id").dropDuplicates(["project_id", "user_id"])
    mem = users.where(F.col("role") == "member").select(
        F.col("id").alias("user_id"), F.col("name").alias("member_name"), F.col("email").alias("member_email"),
        F.col("role").alias("member_role"), display_job_role("job_role").alias("member_job_role"))
    p = projects.select(F.col("id").alias("project_id"))
    return (links.join(p, "project_id", "left_semi").join(mem, "user_id")
                 .select("project_id", F.col("user_id").alias("member_id"), "member_name",
                         "member_email", "member_role", "member_job_role"))


def project_rollup(projects: DataFrame, pm: DataFrame, users: DataFrame, sort: bool = True) -> DataFrame:
    """Per project, distinct member count (role 'member'), zeros kept."""
    mem_ids = users.where(F.col("role") == "member").select(F.col("id").alias("user_id"))
    counts = (pm.join(mem_ids, "user_id", "left_semi")
                .groupBy("project_id").agg(F.countDistinct("user_id").alias("member_count")))
    out = (projects.select("id", "name", "description", "created_at")
           .join(counts, projects.id == counts.project_id, "left")
           .select("id", "name", "description", "created_at",
                   as_count(F.coalesce("member_count", F.lit(0))).alias("member_count")))
    return out.orderBy(*newest_first()) if sort else out


def board_counts(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """Lane sizes per project board (tasks of existing projects; other statuses vanish)."""
    t = tasks.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    return t.groupBy("project_id").agg(
        _count_if(F.col("status") == "todo").alias("todo_count"),
        _count_if(F.col("status") == "in_progress").alias("in_progress_count"),
        _count_if(F.col("status") == "completed").alias("completed_count"))


def page_count_col(n: Column, size: int) -> Column:
    """``max(1, ceil(n / size))``."""
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("long")


def page_count(df: DataFrame, size: int = 8) -> DataFrame:
    """D9 as a one-row DataFrame."""
    return df.agg(page_count_col(F.count(F.lit(1)), size).alias("page_count"))
