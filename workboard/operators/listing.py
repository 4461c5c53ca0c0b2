"""Listings, row-level scopes and membership lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.order import newest_first
from workboard.functions.text import display_job_role
from workboard.operators.joins import left_lookup

# Role rules (R4). 'reference': tasks are restricted only for role 'member'.
# 'strict': everything except role 'admin' is restricted (the stats/projects rule).
ROLE_RULES = ("reference", "strict")


def _restricted(viewer_role, rule: str) -> bool:
    if rule not in ROLE_RULES:
        raise ValueError(f"rule must be one of {ROLE_RULES}")
    return viewer_role == "member" if rule == "reference" else viewer_role != "admin"


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    """B1: exact, case-sensitive match (pushed into the parquet scan)."""
    return users.where(F.col("email") == F.lit(email))


def by_id(df: DataFrame, key, column: str = "id") -> DataFrame:
    """B2: point lookup."""
    return df.where(F.col(column) == F.lit(key))


def tasks_of_project(tasks: DataFrame, project_id) -> DataFrame:
    """B9."""
    return tasks.where(F.col("project_id") == F.lit(project_id))


def member_directory(users: DataFrame, sort: bool = True) -> DataFrame:
    """Role 'member', display job role, newest first."""
    out = users.where(F.col("role") == "member").select(
        "id", "name", "email", display_job_role("job_role").alias("job_role"), "created_at")
    return out.orderBy(*newest_first()) if sort else out


def scope_tasks(tasks: DataFrame, viewer_id, viewer_role, rule: str = "reference",
                assignee_col: str = "assigned_to") -> DataFrame:
    """A restricted viewer sees only tasks assigned to them."""
    if _restricted(viewer_role, rule):
        return tasks.where(F.col(assignee_col) == F.lit(viewer_id))
    return tasks


def scope_tasks_of_viewers(tasks: DataFrame, viewers: DataFrame, rule: str = "reference") -> DataFrame:
    """B4 for many viewers (viewer_id, role) at once, as classes: a row for each task of a restricted
    viewer (viewer_id, viewers 1, task_id, tasks 1), and one row for all who see everything (viewer_id
    and task_id NULL, with the number of such viewers and of tasks), so that viewers times tasks
    is never built. A third role sees all tasks by the reference's rule, none but its own by ``strict``."""
    restricted = (F.col("role").eqNullSafe("member") if rule == "reference" else ~F.col("role").eqNullSafe("admin"))
    own = tasks.select(F.col("assigned_to").alias("viewer_id"), F.col("id").alias("task_id"))
    one = F.lit(1).cast("long")
    pairs = viewers.where(restricted).select("viewer_id").join(own, "viewer_id").select(
        "viewer_id", one.alias("viewers"), "task_id", one.alias("tasks"))
    everyone = tasks.agg(F.count(F.lit(1)).alias("tasks")).select(
        F.lit(None).cast(viewers.schema["viewer_id"].dataType).alias("viewer_id"),
        viewers.where(~restricted).select(F.count(F.lit(1))).scalar().alias("viewers"),
        F.lit(None).cast(tasks.schema["id"].dataType).alias("task_id"), "tasks")
    return pairs.unionByName(everyone)


def visible_project_ids(projects: DataFrame, pm: DataFrame, viewer_id) -> DataFrame:
    """Ids of projects the viewer belongs to or created (C5 existence test)."""
    linked = pm.where(F.col("user_id") == F.lit(viewer_id)).select(F.col("project_id").alias("id"))
    created = projects.where(F.col("created_by") == F.lit(viewer_id)).select("id")
    return linked.unionByName(created)


def visible_projects(projects: DataFrame, pm: DataFrame, viewer_id, viewer_role) -> DataFrame:
    """Admin sees all projects; others those they belong to or created.

    Written as a semi join against the viewer's project ids: equal to the
    reference's LEFT JOIN + OR + DISTINCT, without the row multiplication.
    """
    cols = ["id", "name", "description", "created_by", "created_at"]
    if viewer_role == "admin":
        return projects.select(*cols)
    return projects.join(visible_project_ids(projects, pm, viewer_id), "id", "left_semi").select(*cols)


def task_listing(tasks: DataFrame, projects: DataFrame, users: DataFrame, *,
                 with_project_id: bool = True, with_job_role: bool = False,
                 with_email: bool = True) -> DataFrame:
    """Tasks JOIN projects LEFT JOIN users.

    Tasks of a missing project drop out (inner join); an unassigned or dangling
    assignee keeps the row with NULL assignee fields.
    """
    t = tasks.select("id", "project_id", "title", "description", "status", "assigned_to",
                     "due_date", "created_at")
    p = projects.select(F.col("id").alias("_pid"), F.col("name").alias("project_name"))
    u = users.select(F.col("id").alias("assignee_id"), F.col("name").alias("assignee_name"),
                     F.col("email").alias("assignee_email"), F.col("job_role").alias("_u_job_role"))
    j = t.join(p, t.project_id == p._pid)
    j = left_lookup(j, u, "assigned_to", "assignee_id")
    cols = ["id", "title", "description", "status", "due_date", "created_at"]
    if with_project_id:
        cols.append("project_id")
    cols += ["project_name", "assignee_id", "assignee_name"]
    if with_email:
        cols.append("assignee_email")
    out = j.select(*cols, *([display_job_role("_u_job_role").alias("assignee_job_role")] if with_job_role else []))
    return out


def overview_tasks(ws, sort: bool = True) -> DataFrame:
    """Admin overview task list with display job role, newest first."""
    out = task_listing(ws.tasks, ws.projects, ws.users, with_job_role=True, with_email=False)
    return out.orderBy(*newest_first()) if sort else out


def my_tasks(ws, viewer_id, viewer_role, rule: str = "reference", sort: bool = True) -> DataFrame:
    """all tasks visible to the viewer, newest first, no limit."""
    tasks = scope_tasks(ws.tasks, viewer_id, viewer_role, rule)
    out = task_listing(tasks, ws.projects, ws.users)
    return out.orderBy(*newest_first()) if sort else out


def project_members_list(users: DataFrame, pm: DataFrame, project_id, sort: bool = True) -> DataFrame:
    """The project's users with role 'member', by name."""
    links = pm.where(F.col("project_id") == F.lit(project_id)).select(F.col("user_id").alias("id"))
    out = (users.where(F.col("role") == "member").join(links, "id", "left_semi")
                .select("id", "name", "email", "role", display_job_role("job_role").alias("job_role")))
    return out.orderBy("name", "id") if sort else out


def member_link_exists(pm: DataFrame, users: DataFrame) -> DataFrame:
    """(project_id, user_id) pairs whose user exists with role 'member'."""
    mem = users.where(F.col("role") == "member").select(F.col("id").alias("user_id"))
    return pm.select("project_id", "user_id").join(mem, "user_id", "left_semi").dropDuplicates(["project_id", "user_id"])


def available_members(users: DataFrame, pm: DataFrame, project_id) -> DataFrame:
    """C8 for one project: members not yet linked to it.

    The all-projects form is every (project, non-member) pair, which grows as
    projects x members; use ``available_member_counts`` for all projects.
    """
    linked = pm.where(F.col("project_id") == F.lit(project_id)).select(F.col("user_id").alias("id"))
    return (users.where(F.col("role") == "member").join(linked, "id", "left_anti")
                 .select("id", "name", "email", display_job_role("job_role").alias("job_role")))


def available_member_counts(users: DataFrame, projects: DataFrame, pm: DataFrame) -> DataFrame:
    """C8 for every project as counts: all members minus members already linked."""
    mem = users.where(F.col("role") == "member").select(F.col("id").alias("user_id"))
    n_members = mem.select(F.count(F.lit(1))).scalar()
    linked = (pm.join(mem, "user_id", "left_semi").groupBy("project_id")
                .agg(F.countDistinct("user_id").alias("linked")))
    return (projects.select(F.col("id").alias("project_id"))
                    .join(linked, "project_id", "left")
                    .select("project_id",
                            (n_members - F.coalesce(F.col("linked"), F.lit(0))).cast("long").alias("available_count")))


def task_detail(ws, task_id) -> DataFrame:
    """The joined row returned after a create / status update (C1 + project_id)."""
    return task_listing(by_id(ws.tasks, task_id), ws.projects, ws.users)


def valid_member_ids(users: DataFrame, ids: DataFrame, id_col: str = "user_id") -> DataFrame:
    """Rows of ``ids`` whose id belongs to an existing user with role 'member'
    (``role = 'member' AND id = ANY(ids)`` as a semi join, no ``isin`` list)."""
    mem = users.where(F.col("role") == "member").select(F.col("id").alias(id_col))
    return ids.join(mem, id_col, "left_semi")


def any_row(df: DataFrame) -> DataFrame:
    """any one row (``LIMIT 1``)."""
    return df.limit(1)


def member_struct(prefix: str = "") -> Column:
    """The member object of the project rollup as a struct."""
    return F.struct(F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}name").alias("name"),
                    F.col(f"{prefix}email").alias("email"), F.col(f"{prefix}role").alias("role"),
                    display_job_role(f"{prefix}job_role").alias("job_role"))


def remove_from_members(members: Column, member_id) -> Column:
    """G5, array side: drop one member object from an array of member structs."""
    return F.filter(members, lambda m: m["id"] != F.lit(member_id))
