"""Validated batch jobs (I1-I8, G2, G3, A3): the reference's write endpoints.

Each job takes the current tables and a *batch* of requests (one row per
request, ordered by ``seq``) and returns a ``BatchResult``: the new tables and
one outcome row per request ``(seq, outcome, http_status)``. The first failing
check wins, in the reference's order. Request N seeing the effect of request
M < N is obtained without a row loop: among the requests that pass the
row-local checks, the one with the smallest ``seq`` per conflict key wins
(a ``min`` aggregation, partial map-side, then a many-to-one join back).

New ids are ``max(existing id) + 1 + seq`` for integer keys (a lazy scalar subquery):
a job that is retried on the same tables mints the same ids, but one that is run again
after its tables were committed would not, so a committed batch must not be run again.
String keys get ``sha2(table : batch_id : seq)``, the same in every run. Everything is
lazy: outcomes alone cost no extra job. With ``materialize`` the decisions are
checkpointed once, for callers that write several changed tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.functions.status import as_of_lit, is_known_status
from workboard.operators.joins import left_lookup
from workboard.operators.listing import member_link_exists
from workboard.session import checkpoint_root
from workboard.functions.text import (is_blank, looks_like_email, normalize_email,
                                      normalize_job_role, trim_to_null, ws_trim)

OUTCOME_COLS = ["seq", "outcome", "http_status"]

# Outcome codes and the reference's HTTP status for each.
HTTP_STATUS = {
    "invalid_name": 400, "invalid_email": 400, "invalid_job_role": 400, "duplicate": 409,
    "invalid_member": 400, "missing_user": 400, "not_member": 400, "project_not_found": 404,
    "already_member": 400, "invalid_title": 400, "missing_assignee": 400,
    "not_project_member": 400, "invalid_status": 400, "not_found": 404, "forbidden": 403,
    "inserted": 201, "applied": 200, "deleted": 200,
}


@dataclass(frozen=True)
class BatchResult:
    tables: dict
    outcomes: DataFrame


def _http(outcome: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in HTTP_STATUS.items() for x in kv])
    return F.try_element_at(m, outcome).cast("int")


def _outcomes(df: DataFrame, outcome: Column) -> DataFrame:
    return df.select(F.col("seq").cast("long").alias("seq"), outcome.alias("outcome")) \
             .withColumn("http_status", _http(F.col("outcome")))


def new_ids(existing: DataFrame, seq: Column, table: str, batch_id: str, key: str = "id") -> Column:
    """A3: deterministic ids for inserted rows. ``batch_id`` names the batch in all time."""
    if not batch_id:
        raise ValueError("batch_id is required")
    dtype = existing.schema[key].dataType
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType)):
        base = existing.select(F.coalesce(F.max(key), F.lit(-1)).cast("long") + 1).scalar()
        return (base + seq).cast(dtype)
    return F.sha2(F.concat_ws(":", F.lit(table), F.lit(batch_id), seq.cast("string")), 256)


def clean_id_list(ids: Column) -> Column:
    """Drop NULL/'' entries and de-duplicate an array of ids."""
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x.cast("string") != "")))


def append_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``INSERT ... ON CONFLICT DO NOTHING``."""
    fresh = new.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def decided(r: DataFrame, materialize: bool) -> DataFrame:
    """The per-request decision table, checkpointed to the shared checkpoint
    folder when ``materialize``: the outcomes and every changed table are
    derived from it, so it is computed once, and a lost executor does not
    force the whole validation to rerun. One row per request."""
    if not materialize:
        return r
    checkpoint_root(r.sparkSession)
    return r.checkpoint(eager=True)


def _first_per_key(valid: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest seq per conflict key among the given requests."""
    return valid.groupBy(*keys).agg(F.min("seq").alias("_first_seq"))


def onboard_members(users: DataFrame, reqs: DataFrame, as_of, batch_id: str,
                    materialize: bool = False) -> BatchResult:
    """Name -> email -> job role -> duplicate email (store or earlier in batch) -> insert."""
    r = reqs.select("seq", "name", "email", "job_role").withColumns({
        "_email": normalize_email("email"), "_role": normalize_job_role("job_role")})
    fail = (F.when(is_blank("name"), "invalid_name")
             .when(~looks_like_email("email"), "invalid_email")
             .when(F.col("_role").isNull(), "invalid_job_role"))
    r = r.withColumn("_fail", fail)
    valid = r.where(F.col("_fail").isNull())
    known = users.select(F.col("email").alias("_email")).distinct().withColumn("_exists", F.lit(True))
    per_email = _first_per_key(valid, ["_email"]).join(known, "_email", "left")
    r = left_lookup(r, per_email, "_email")
    outcome = F.coalesce(
        F.col("_fail"),
        F.when(F.col("_exists") | (F.col("seq") != F.col("_first_seq")), "duplicate").otherwise("inserted"))
    r = decided(r.withColumn("_outcome", outcome), materialize)
    ins = r.where(F.col("_outcome") == "inserted")
    new_users = ins.select(
        new_ids(users, F.col("seq"), "users", batch_id).alias("id"), ws_trim("name").alias("name"),
        F.col("_email").alias("email"), F.lit("member").alias("role"), F.col("_role").alias("job_role"),
        F.lit(True).alias("is_first_login"), as_of_lit(as_of).alias("created_at"))
    return BatchResult({"users": users.unionByName(new_users.select(*users.columns))},
                       _outcomes(r, F.col("_outcome")))


def _member_ids(users: DataFrame) -> DataFrame:
    return users.where(F.col("role") == "member").select(F.col("id").alias("user_id")).withColumn("_is_member", F.lit(True))


def create_projects(ws, reqs: DataFrame, req_members: DataFrame, as_of, batch_id: str,
                    materialize: bool = False) -> BatchResult:
    """Name -> every de-duplicated member id must be an existing 'member' -> insert
    the project, a creator link and the member links (ON CONFLICT DO NOTHING)."""
    uid = F.col("user_id")
    if isinstance(req_members.schema["user_id"].dataType, T.StringType):
        uid = F.lower(ws_trim(uid))  # R12: two spellings of one id are one member
    ids = (req_members.select("seq", uid.alias("user_id"))
           .where(F.col("user_id").isNotNull() & (F.col("user_id").cast("string") != ""))
           .dropDuplicates(["seq", "user_id"]))
    checked = left_lookup(ids, _member_ids(ws.users), "user_id")
    bad = checked.groupBy("seq").agg(F.count_if(F.col("_is_member").isNull()).alias("_bad"))
    r = left_lookup(reqs.select("seq", "name", "description", "creator_id"), bad, "seq")
    outcome = (F.when(is_blank("name"), "invalid_name")
                .when(F.coalesce(F.col("_bad"), F.lit(0)) > 0, "invalid_member")
                .otherwise("inserted"))
    r = decided(r.withColumn("_outcome", outcome).withColumn("_new_id", new_ids(ws.projects, F.col("seq"), "projects", batch_id)),
                materialize)
    ins = r.where(F.col("_outcome") == "inserted")
    new_projects = ins.select(
        F.col("_new_id").alias("id"), ws_trim("name").alias("name"),
        trim_to_null("description").alias("description"),
        F.col("creator_id").cast(ws.projects.schema["created_by"].dataType).alias("created_by"),
        as_of_lit(as_of).alias("created_at"))
    creator_links = ins.select(F.col("_new_id").alias("project_id"), F.col("creator_id").alias("user_id"))
    member_links = ids.join(ins.select("seq", "_new_id"), "seq").select(
        F.col("_new_id").alias("project_id"), "user_id")
    pm = append_absent(ws.project_members, creator_links.unionByName(member_links), ["project_id", "user_id"])
    return BatchResult({"projects": ws.projects.unionByName(new_projects.select(*ws.projects.columns)),
                        "project_members": pm}, _outcomes(r, F.col("_outcome")))


def add_project_members(ws, reqs: DataFrame, materialize: bool = False) -> BatchResult:
    """User id -> existing 'member' -> project exists (R8) -> not yet linked
    (store or earlier in batch) -> insert."""
    r = left_lookup(reqs.select("seq", "project_id", "user_id"), _member_ids(ws.users), "user_id")
    projects = ws.projects.select(F.col("id").alias("project_id")).withColumn("_project", F.lit(True))
    r = left_lookup(r, projects, "project_id")
    fail = (F.when(F.col("user_id").isNull(), "missing_user")
             .when(F.col("_is_member").isNull(), "not_member")
             .when(F.col("_project").isNull(), "project_not_found"))
    r = r.withColumn("_fail", fail)
    linked = ws.project_members.select("project_id", "user_id").distinct().withColumn("_linked", F.lit(True))
    per_pair = _first_per_key(r.where(F.col("_fail").isNull()), ["project_id", "user_id"]) \
        .join(linked, ["project_id", "user_id"], "left")
    r = left_lookup(r, per_pair, ["project_id", "user_id"])
    outcome = F.coalesce(F.col("_fail"), F.when(
        F.col("_linked") | (F.col("seq") != F.col("_first_seq")), "already_member").otherwise("inserted"))
    r = decided(r.withColumn("_outcome", outcome), materialize)
    new_links = r.where(F.col("_outcome") == "inserted").select("project_id", "user_id")
    return BatchResult({"project_members": ws.project_members.unionByName(new_links)},
                       _outcomes(r, F.col("_outcome")))


def create_tasks(ws, reqs: DataFrame, as_of, batch_id: str,
                 materialize: bool = False) -> BatchResult:
    """I4: title -> assignee given -> project exists -> assignee is a 'member'
    linked to that project -> insert with status 'todo'."""
    cols = reqs.columns
    r = reqs.select("seq", "project_id", "title", "description", "assigned_to",
                    (F.col("due_date") if "due_date" in cols else F.lit(None).cast("timestamp_ntz")).alias("due_date"))
    projects = ws.projects.select(F.col("id").alias("project_id")).withColumn("_project", F.lit(True))
    links = (member_link_exists(ws.project_members, ws.users).withColumnRenamed("user_id", "assigned_to")
             .withColumn("_linked", F.lit(True)))
    r = left_lookup(left_lookup(r, projects, "project_id"), links, ["project_id", "assigned_to"])
    outcome = (F.when(is_blank("title"), "invalid_title")
                .when(F.col("assigned_to").isNull() | (F.col("assigned_to").cast("string") == ""), "missing_assignee")
                .when(F.col("_project").isNull(), "project_not_found")
                .when(F.col("_linked").isNull(), "not_project_member")
                .otherwise("inserted"))
    r = decided(r.withColumn("_outcome", outcome), materialize)
    ins = r.where(F.col("_outcome") == "inserted")
    new_tasks = ins.select(
        new_ids(ws.tasks, F.col("seq"), "tasks", batch_id).alias("id"),
        F.col("project_id").cast(ws.tasks.schema["project_id"].dataType).alias("project_id"),
        ws_trim("title").alias("title"), trim_to_null("description").alias("description"),
        F.lit("todo").alias("status"),
        F.col("assigned_to").cast(ws.tasks.schema["assigned_to"].dataType).alias("assigned_to"),
        F.col("due_date").cast("timestamp_ntz").alias("due_date"), as_of_lit(as_of).alias("created_at"))
    return BatchResult({"tasks": ws.tasks.unionByName(new_tasks.select(*ws.tasks.columns))},
                       _outcomes(r, F.col("_outcome")))


def status_change_outcomes(tasks: DataFrame, users: DataFrame, reqs: DataFrame,
                           rule: str = "reference") -> DataFrame:
    """I5 checks: status in domain -> task exists -> a restricted requester must be
    the assignee. Returns the requests with ``outcome``/``http_status``."""
    t = tasks.select(F.col("id").alias("task_id"), F.col("assigned_to").alias("_assignee")).withColumn("_task", F.lit(True))
    u = users.select(F.col("id").alias("requester_id"), F.col("role").alias("_requester_role"))
    r = left_lookup(left_lookup(reqs.select("seq", "ts", "task_id", "status", "requester_id"), t, "task_id"),
                    u, "requester_id")
    role = F.col("_requester_role")
    restricted = (role == "member") if rule == "reference" else ~role.eqNullSafe("admin")
    outcome = (F.when(~is_known_status("status"), "invalid_status")
                .when(F.col("_task").isNull(), "not_found")
                .when(F.coalesce(restricted, F.lit(False)) & ~F.col("_assignee").eqNullSafe(F.col("requester_id")), "forbidden")
                .otherwise("applied"))
    return (r.withColumn("outcome", outcome).withColumn("http_status", _http(F.col("outcome")))
             .select("seq", "ts", "task_id", "status", "requester_id", "outcome", "http_status"))


def latest_applied(changes: DataFrame) -> DataFrame:
    """Last applied status per task, by (ts, seq) (J2 in batch form)."""
    return (changes.where(F.col("outcome") == "applied")
                   .groupBy("task_id")
                   .agg(F.max_by("status", F.struct("ts", "seq")).alias("new_status")))


def apply_status_changes(tasks: DataFrame, users: DataFrame, reqs: DataFrame,
                         rule: str = "reference", materialize: bool = False) -> BatchResult:
    """Any transition between the three statuses is allowed once checks pass."""
    checked = decided(status_change_outcomes(tasks, users, reqs, rule), materialize)
    last = latest_applied(checked)
    new_tasks = (tasks.join(last.withColumnRenamed("task_id", "id"), "id", "left")
                      .withColumn("status", F.coalesce(F.col("new_status"), F.col("status")))
                      .select(*tasks.columns))
    return BatchResult({"tasks": new_tasks}, checked.select(*OUTCOME_COLS))


def delete_members(ws, reqs: DataFrame, materialize: bool = False) -> BatchResult:
    """User exists -> role is 'member' -> delete the user, their tasks and
    links, and set ``projects.created_by`` to NULL. A second request for the
    same user finds it gone (not_found)."""
    u = ws.users.select(F.col("id").alias("user_id"), F.col("role").alias("_role")).withColumn("_exists", F.lit(True))
    r = left_lookup(reqs.select("seq", "user_id"), u, "user_id")
    first = _first_per_key(r.where(F.col("_exists") & (F.col("_role") == "member")), ["user_id"])
    r = left_lookup(r, first, "user_id")
    outcome = (F.when(F.col("_exists").isNull(), "not_found")
                .when(~F.col("_role").eqNullSafe("member"), "not_member")
                .when(F.col("seq") == F.col("_first_seq"), "deleted")
                .otherwise("not_found"))
    r = decided(r.withColumn("_outcome", outcome), materialize)
    gone = r.where(F.col("_outcome") == "deleted").select("user_id")
    users = ws.users.join(gone.withColumnRenamed("user_id", "id"), "id", "left_anti")
    tasks = ws.tasks.join(gone.withColumnRenamed("user_id", "assigned_to"), "assigned_to", "left_anti")
    pm = ws.project_members.join(gone, "user_id", "left_anti")
    flagged = gone.select(F.col("user_id").alias("created_by"), F.lit(True).alias("_gone"))
    projects = (left_lookup(ws.projects, flagged, "created_by")
                .withColumn("created_by", F.when(F.col("_gone"), F.lit(None))
                            .otherwise(F.col("created_by"))
                            .cast(ws.projects.schema["created_by"].dataType))
                .select(*ws.projects.columns))
    return BatchResult({"users": users.select(*ws.users.columns), "tasks": tasks.select(*ws.tasks.columns),
                        "project_members": pm.select(*ws.project_members.columns), "projects": projects},
                       _outcomes(r, F.col("_outcome")))


def delete_projects(ws, reqs: DataFrame, materialize: bool = False) -> BatchResult:
    """Project exists -> delete it and cascade to links and tasks."""
    p = ws.projects.select(F.col("id").alias("project_id")).withColumn("_exists", F.lit(True))
    r = left_lookup(reqs.select("seq", "project_id"), p, "project_id")
    first = _first_per_key(r.where(F.col("_exists")), ["project_id"])
    r = left_lookup(r, first, "project_id")
    outcome = F.when(F.col("_exists") & (F.col("seq") == F.col("_first_seq")), "deleted").otherwise("not_found")
    r = decided(r.withColumn("_outcome", outcome), materialize)
    gone = r.where(F.col("_outcome") == "deleted").select("project_id")
    return BatchResult({
        "projects": ws.projects.join(gone.withColumnRenamed("project_id", "id"), "id", "left_anti").select(*ws.projects.columns),
        "project_members": ws.project_members.join(gone, "project_id", "left_anti").select(*ws.project_members.columns),
        "tasks": ws.tasks.join(gone, "project_id", "left_anti").select(*ws.tasks.columns),
    }, _outcomes(r, F.col("_outcome")))


def reset_workspace(ws):
    """I8: empty tasks, links and projects; drop 'member' users (admins and NULL roles stay)."""
    return ws.replace(tasks=ws.tasks.limit(0), project_members=ws.project_members.limit(0),
                      projects=ws.projects.limit(0),
                      users=ws.users.where(~F.col("role").eqNullSafe("member")))


def apply_result(ws, result: BatchResult):
    """The workspace after a batch job."""
    return ws.replace(**result.tables)

