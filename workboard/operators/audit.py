"""Referential and constraint audits.

The loose DDL the reference runs at start-up declares no foreign keys or CHECKs, so any
row is legal input; these jobs count what the strict DDL would have rejected.

A *domain* is a set of keys with all that refers to it: user ids, project ids. The rows of
all tables become narrow tagged entries of one union, (domain, key, how many rows have it as
their key, how many refer to it); one aggregation by domain and key, combined before its
shuffle, then tells duplicate keys (more than one row of their own) and dangling references
(none). Keys that nothing refers to (task ids, member links, email addresses) are counted by
themselves, and row rules (NOT NULL, CHECK, lengths) in one pass over their table: neither
makes the entries of the shuffle and of its hash tables wider.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.functions.status import STATUSES

USERS, PROJECTS = range(2)
#: References by domain, in the order of the columns ref_0, ref_1, ...
REFERENCES = {USERS: ("tasks_assigned_to", "links_user", "projects_created_by"), PROJECTS: ("tasks_project", "links_project")}


def _too_long(c: str, n: int) -> Column:
    return F.length(c) > n


def _row_rules() -> dict[str, dict[str, Column]]:
    """Rules on single rows, by table."""
    return {
        "users": {"not_null_id": F.col("id").isNull(), "not_null_name": F.col("name").isNull(),
                  "not_null_email": F.col("email").isNull(), "check_role": ~F.col("role").isin("admin", "member"),
                  "length_name": _too_long("name", 255), "length_email": _too_long("email", 255),
                  "length_role": _too_long("role", 50), "length_job_role": _too_long("job_role", 100)},
        "projects": {"not_null_id": F.col("id").isNull(), "not_null_name": F.col("name").isNull(),
                     "length_name": _too_long("name", 255)},
        "project_members": {"not_null_key": F.col("project_id").isNull() | F.col("user_id").isNull()},
        "tasks": {"not_null_id": F.col("id").isNull(), "not_null_title": F.col("title").isNull(),
                  "check_status": ~F.col("status").isin(*STATUSES), "length_title": _too_long("title", 255),
                  "length_status": _too_long("status", 50)}}


def _entries(df: DataFrame, domain: int, key: Column, ref: int | None = None) -> DataFrame:
    """One entry per row: as a row of its own (``ref`` None) or as reference number ``ref``."""
    refs = max(map(len, REFERENCES.values()))
    marks = [F.lit(int(ref is None)).alias("own"), *[F.lit(int(ref == k)).alias(f"ref_{k}") for k in range(refs)]]
    return df.select(F.lit(domain).alias("domain"), key.alias("key"), *marks)


def _by_key(ws) -> DataFrame:
    """Entries of users, projects and all that refers to them, added up by key."""
    own = [_entries(ws.users, USERS, F.col("id")), _entries(ws.projects, PROJECTS, F.col("id"))]
    kind = ws.users.schema["id"].dataType
    union = reduce(DataFrame.unionByName, [p.withColumn("key", F.col("key").cast(kind)) for p in own + _references(ws)])
    return union.groupBy("domain", "key").agg(*[F.sum(c).alias(c) for c in union.columns if c not in ("domain", "key")])


def _references(ws) -> list[DataFrame]:
    return [_entries(ws.tasks, USERS, F.col("assigned_to"), ref=0), _entries(ws.project_members, USERS, F.col("user_id"), ref=1),
            _entries(ws.projects, USERS, F.col("created_by"), ref=2),
            _entries(ws.tasks, PROJECTS, F.col("project_id"), ref=0),
            _entries(ws.project_members, PROJECTS, F.col("project_id"), ref=1)]


def _total(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")


def _dangling(domain: int, name: str) -> Column:
    """References of a kind whose key no row has."""
    return _total((F.col("domain") == domain) & F.col("key").isNotNull() & (F.col("own") == 0),
                  F.col(f"ref_{REFERENCES[domain].index(name)}"))


def orphan_audit(ws) -> DataFrame:
    """Rows whose parent is missing, per relation, plus unassigned tasks."""
    unassigned = _total((F.col("domain") == USERS) & F.col("key").isNull(), F.col("ref_0"))
    one = _by_key(ws).agg(
        _dangling(PROJECTS, "tasks_project").alias("tasks_missing_project"),
        _dangling(USERS, "tasks_assigned_to").alias("tasks_dangling_assignee"), unassigned.alias("tasks_unassigned"),
        _dangling(PROJECTS, "links_project").alias("links_missing_project"),
        _dangling(USERS, "links_user").alias("links_missing_user"),
        _dangling(USERS, "projects_created_by").alias("projects_missing_creator"))
    return one.unpivot([], one.columns, "check_name", "violations")


def _twice(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """How many keys more than one row has; a key with a NULL part is none."""
    return (df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("own"))
              .agg(F.count_if(F.col("own") > 1).alias(name)))


def constraint_audit(ws) -> DataFrame:
    """Violations of the strict DDL, one row per (table, rule). A primary key's violations are the
    keys that more than one row has; rows with a NULL in their key count as not_null only."""
    def twice(domain):
        return _total((F.col("domain") == domain) & F.col("key").isNotNull() & (F.col("own") > 1), F.lit(1))

    counts = {"users.primary_key": twice(USERS), "projects.primary_key": twice(PROJECTS),
              "projects.fk_created_by": _dangling(USERS, "projects_created_by"),
              "project_members.fk_project": _dangling(PROJECTS, "links_project"),
              "project_members.fk_user": _dangling(USERS, "links_user"),
              "tasks.fk_project": _dangling(PROJECTS, "tasks_project"),
              "tasks.fk_assigned_to": _dangling(USERS, "tasks_assigned_to")}
    parts = [_by_key(ws).agg(*[c.alias(name) for name, c in counts.items()]),
             _twice(ws.project_members, "project_members.primary_key", "project_id", "user_id"),
             _twice(ws.tasks, "tasks.primary_key", "id"), _twice(ws.users, "users.unique_email", "email")]
    parts += [ws[table].agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"{table}.{rule}") for rule, c in rules.items()])
              for table, rules in _row_rules().items()]
    long = reduce(DataFrame.unionByName, [one.unpivot([], [F.col(f"`{c}`") for c in one.columns], "name", "violations") for one in parts])
    name = F.split("name", "\\.")
    return long.select(name[0].alias("table_name"), name[1].alias("rule"), "violations")
