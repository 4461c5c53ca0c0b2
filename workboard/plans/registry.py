"""Named queries over the driver tables: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query derives the workspace from the given parquet tables (whole tables,
no sampling) and runs one library operator with the fixed parameters of
``plans.params``. ``plans.oracle.ORACLE`` holds the matching SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.functions.status import clamp, decrement_floor0
from workboard.functions.text import is_blank, looks_like_email, normalize_email, normalize_job_role, role_key
from workboard.operators import audit, board, cards, listing, mutations, paging, rollups
from workboard.plans import params as P
from workboard.plans.overview import overview
from workboard.session import scratch_path
from workboard.sources import requests as R
from workboard.sources.snapshot import read_snapshot, to_json_docs, write_snapshot
from workboard.sources.workspace import cast_keys, derive_workspace
from workboard.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        _REGISTRY[name] = fn
        return fn
    return deco


def ws_of(spark, sf_dir):
    """The derived workspace plans, built once per session and folder (plans are
    immutable and lazy; building them is client-side work worth sharing). The
    cache lives on the session object, so a new session never sees old plans."""
    cache = getattr(spark, "_workboard_ws", None)
    if cache is None:
        cache = {}
        spark._workboard_ws = cache
    key = sf_dir.rstrip("/")
    if key not in cache:
        cache[key] = derive_workspace(spark, sf_dir)
    return cache[key]


@query("task_stats")
def q_task_stats(spark, d):
    return rollups.task_stats(ws_of(spark, d).tasks, P.AS_OF)


@query("task_stats_member")
def q_task_stats_member(spark, d):
    return rollups.scoped_task_stats(ws_of(spark, d).tasks, P.AS_OF, P.VIEWER_MEMBER, "member")


@query("task_stats_by_member")
def q_task_stats_by_member(spark, d):
    ws = ws_of(spark, d)
    return rollups.task_stats_by_member(ws.tasks, ws.users, P.AS_OF)


@query("task_stats_by_viewer")
def q_task_stats_by_viewer(spark, d):
    ws = ws_of(spark, d)
    return rollups.task_stats_by_viewer(ws.tasks, ws.users.select(F.col("id").alias("viewer_id"), "role"), P.AS_OF)


@query("tasks_per_member_name")
def q_tasks_per_member_name(spark, d):
    ws = ws_of(spark, d)
    return rollups.tasks_per_member_name(ws.tasks, ws.users)


@query("status_distribution")
def q_status_distribution(spark, d):
    return rollups.status_distribution(ws_of(spark, d).tasks)


@query("member_directory")
def q_member_directory(spark, d):
    return listing.member_directory(ws_of(spark, d).users)


@query("user_by_email")
def q_user_by_email(spark, d):
    return listing.user_by_email(ws_of(spark, d).users, P.EMAIL)


@query("my_tasks_member")
def q_my_tasks_member(spark, d):
    return listing.my_tasks(ws_of(spark, d), P.VIEWER_MEMBER, "member")


@query("my_tasks_admin")
def q_my_tasks_admin(spark, d):
    return listing.my_tasks(ws_of(spark, d), P.VIEWER_ADMIN, "admin")


@query("task_page_first")
def q_task_page_first(spark, d):
    return paging.task_page(ws_of(spark, d), P.PROJECT, P.VIEWER_ADMIN, "admin")


@query("task_page_next")
def q_task_page_next(spark, d):
    return paging.task_page(ws_of(spark, d), P.PROJECT, P.VIEWER_ADMIN, "admin", cursor=P.CURSOR)


@query("task_page_ts_cursor")
def q_task_page_ts_cursor(spark, d):
    return paging.task_page(ws_of(spark, d), P.PROJECT, P.VIEWER_ADMIN, "admin", cursor=P.CURSOR,
                            cursor_mode="timestamp")


@query("task_page_member")
def q_task_page_member(spark, d):
    return paging.task_page(ws_of(spark, d), P.PROJECT, P.PAGE_VIEWER, "member")


@query("project_page_member")
def q_project_page_member(spark, d):
    return paging.project_page(ws_of(spark, d), P.VIEWER_MEMBER, "member")


@query("project_page_admin")
def q_project_page_admin(spark, d):
    return paging.project_page(ws_of(spark, d), P.VIEWER_ADMIN, "admin")


@query("project_page_next")
def q_project_page_next(spark, d):
    return paging.project_page(ws_of(spark, d), P.VIEWER_ADMIN, "admin", cursor=P.PROJECT_CURSOR)


@query("visible_projects")
def q_visible_projects(spark, d):
    ws = ws_of(spark, d)
    return listing.visible_projects(ws.projects, ws.project_members, P.VIEWER_MEMBER, "member")


@query("project_members_list")
def q_project_members_list(spark, d):
    ws = ws_of(spark, d)
    return listing.project_members_list(ws.users, ws.project_members, P.PROJECT)


@query("available_members")
def q_available_members(spark, d):
    ws = ws_of(spark, d)
    return listing.available_members(ws.users, ws.project_members, P.PROJECT)


@query("available_member_counts")
def q_available_member_counts(spark, d):
    ws = ws_of(spark, d)
    return listing.available_member_counts(ws.users, ws.projects, ws.project_members)


@query("valid_member_ids")
def q_valid_member_ids(spark, d):
    ids = R.project_req_members(spark, d).where(F.col("user_id").isNotNull()).dropDuplicates(["seq", "user_id"])
    return listing.valid_member_ids(ws_of(spark, d).users, ids)


@query("task_detail")
def q_task_detail(spark, d):
    return listing.task_detail(ws_of(spark, d), P.TASK_ID)


@query("member_rollup")
def q_member_rollup(spark, d):
    ws = ws_of(spark, d)
    return rollups.member_rollup(ws.users, ws.project_members, ws.tasks)


@query("member_rollup_fanout")
def q_member_rollup_fanout(spark, d):
    ws = ws_of(spark, d)
    return rollups.member_rollup_fanout(ws.users, ws.project_members, ws.tasks)


@query("project_rollup")
def q_project_rollup(spark, d):
    ws = ws_of(spark, d)
    return rollups.project_rollup(ws.projects, ws.project_members, ws.users)


@query("project_roster_long")
def q_project_roster_long(spark, d):
    ws = ws_of(spark, d)
    return rollups.project_roster_long(ws.projects, ws.project_members, ws.users)


@query("overview_tasks")
def q_overview_tasks(spark, d):
    return listing.overview_tasks(ws_of(spark, d))


@query("board_counts")
def q_board_counts(spark, d):
    ws = ws_of(spark, d)
    return rollups.board_counts(ws.tasks, ws.projects)


def _all_listing(ws):
    return listing.task_listing(ws.tasks, ws.projects, ws.users)


@query("kanban_board")
def q_kanban_board(spark, d):
    ws = ws_of(spark, d)
    return board.kanban_board(_all_listing(ws))


@query("kanban_board_due")
def q_kanban_board_due(spark, d):
    ws = ws_of(spark, d)
    return board.kanban_board(_all_listing(ws), sort_by="due_date")


@query("kanban_newest50")
def q_kanban_newest50(spark, d):
    return board.kanban_newest(_all_listing(ws_of(spark, d)), n=P.TASK_LIMIT)


@query("offset_page")
def q_offset_page(spark, d):
    ws = ws_of(spark, d)
    return paging.offset_page(listing.overview_tasks(ws, sort=False), P.OFFSET_PAGE, P.PAGE_SIZE, keys=_listed_keys(ws))


def _listed_keys(ws):
    """Keys of the overview listing in F4's order."""
    known = ws.projects.select(F.col("id").alias("project_id"))
    return ws.tasks.join(known, "project_id", "left_semi").select("id", "created_at")


@query("offset_page_deep")
def q_offset_page_deep(spark, d):
    ws = ws_of(spark, d)
    return paging.offset_page(listing.overview_tasks(ws, sort=False), P.OFFSET_PAGE, P.PAGE_SIZE, keys=_listed_keys(ws), top_rows=0)


@query("offset_page_last")
def q_offset_page_last(spark, d):
    ws = ws_of(spark, d)
    index = paging.PageIndex.build(_listed_keys(ws), scratch_path(spark, "page-index"))
    return index.page(listing.overview_tasks(ws, sort=False), 10 ** 9, P.PAGE_SIZE)


@query("tasks_of_viewers")
def q_tasks_of_viewers(spark, d):
    ws = ws_of(spark, d)
    return listing.scope_tasks_of_viewers(ws.tasks, ws.users.select(F.col("id").alias("viewer_id"), "role"))


@query("overview_counters")
def q_overview_counters(spark, d):
    return overview(_snapshot(spark, d), P.AS_OF)["counters"]


@query("overview_members")
def q_overview_members(spark, d):
    return overview(_snapshot(spark, d), P.AS_OF)["members"]


@query("member_docs")
def q_member_docs(spark, d):
    members = listing.member_directory(ws_of(spark, d).users, sort=False)
    return to_json_docs(members.select("id", "name", "email", "job_role"))


@query("roster_member_docs")
def q_roster_member_docs(spark, d):
    ws = ws_of(spark, d)
    rows = ws.project_members.join(ws.users.where(F.col("role") == "member"), F.col("user_id") == F.col("id"))
    return rows.select("project_id", F.to_json(listing.member_struct()).alias("member"))


@query("counter_clamps")
def q_counter_clamps(spark, d):
    ws = ws_of(spark, d)
    counts = rollups.board_counts(ws.tasks, ws.projects)
    return counts.select("project_id", decrement_floor0("in_progress_count").alias("less_one"),
                         clamp("completed_count", 1, P.PAGE_SIZE).alias("in_page"))


@query("clean_member_lists")
def q_clean_member_lists(spark, d):
    lists = R.project_req_members(spark, d).groupBy("seq").agg(F.collect_list(F.coalesce("user_id", F.lit(-1))).alias("ids"))
    ids = mutations.clean_id_list(F.transform("ids", lambda x: F.when(x >= 0, x)))  # with the NULLs that a list may have
    return lists.select("seq", F.size(ids).cast("long").alias("n_ids"),
                        F.concat_ws(",", F.array_sort(F.transform(ids, lambda x: x.cast("string")))).alias("ids"))


@query("assign_pages")
def q_assign_pages(spark, d):
    return paging.assign_pages(listing.overview_tasks(ws_of(spark, d), sort=False), P.PAGE_SIZE)


@query("today_backlog")
def q_today_backlog(spark, d):
    return board.split_today(_all_listing(ws_of(spark, d)), P.AS_OF)


@query("task_cards")
def q_task_cards(spark, d):
    return cards.task_cards(listing.overview_tasks(ws_of(spark, d), sort=False), P.AS_OF)


@query("job_role_normalise")
def q_job_role_normalise(spark, d):
    r = R.onboard_reqs(spark, d)
    return r.select("seq", role_key("job_role").alias("job_role_key"),
                    normalize_job_role("job_role").alias("job_role_canonical"),
                    is_blank("name").alias("name_blank"), looks_like_email("email").alias("email_valid"),
                    normalize_email("email").alias("email_normalised"))


@query("orphan_audit")
def q_orphan_audit(spark, d):
    return audit.orphan_audit(ws_of(spark, d))


@query("constraint_audit")
def q_constraint_audit(spark, d):
    return audit.constraint_audit(ws_of(spark, d))


@query("onboard_members")
def q_onboard_members(spark, d):
    return mutations.onboard_members(ws_of(spark, d).users, R.onboard_reqs(spark, d), P.AS_OF, "b").outcomes


@query("create_projects")
def q_create_projects(spark, d):
    return mutations.create_projects(ws_of(spark, d), R.project_reqs(spark, d),
                                     R.project_req_members(spark, d), P.AS_OF, "b").outcomes


@query("add_project_members")
def q_add_project_members(spark, d):
    return mutations.add_project_members(ws_of(spark, d), R.link_reqs(spark, d)).outcomes


@query("create_tasks")
def q_create_tasks(spark, d):
    return mutations.create_tasks(ws_of(spark, d), R.task_reqs(spark, d), P.AS_OF, "b").outcomes


@query("apply_status_changes")
def q_apply_status_changes(spark, d):
    ws = ws_of(spark, d)
    return mutations.apply_status_changes(ws.tasks, ws.users, R.status_reqs(spark, d, ws.tasks)).outcomes


@query("status_after_changes")
def q_status_after_changes(spark, d):
    ws = ws_of(spark, d)
    res = mutations.apply_status_changes(ws.tasks, ws.users, R.status_reqs(spark, d, ws.tasks))
    return rollups.task_stats(res.tables["tasks"], P.AS_OF)


@query("delete_members")
def q_delete_members(spark, d):
    return mutations.delete_members(ws_of(spark, d), R.member_delete_reqs(spark, d)).outcomes


def _row_counts(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


@query("workspace_after_member_deletes")
def q_workspace_after_member_deletes(spark, d):
    ws = ws_of(spark, d)
    t = mutations.delete_members(ws, R.member_delete_reqs(spark, d)).tables
    return _row_counts([("users", t["users"]), ("tasks", t["tasks"]), ("project_members", t["project_members"]),
                        ("projects_without_creator", t["projects"].where(F.col("created_by").isNull()))])


@query("delete_projects")
def q_delete_projects(spark, d):
    return mutations.delete_projects(ws_of(spark, d), R.project_delete_reqs(spark, d)).outcomes


@query("workspace_after_project_deletes")
def q_workspace_after_project_deletes(spark, d):
    t = mutations.delete_projects(ws_of(spark, d), R.project_delete_reqs(spark, d)).tables
    return _row_counts([("projects", t["projects"]), ("project_members", t["project_members"]), ("tasks", t["tasks"])])


@query("reset_workspace")
def q_reset_workspace(spark, d):
    return mutations.reset_workspace(ws_of(spark, d)).users


def _checked_changes(spark, d):
    ws = ws_of(spark, d)
    return ws, mutations.status_change_outcomes(ws.tasks, ws.users, R.status_reqs(spark, d, ws.tasks))


@query("status_transitions")
def q_status_transitions(spark, d):
    ws, checked = _checked_changes(spark, d)
    return live.status_transitions(checked.where(F.col("outcome") == "applied"), ws.tasks, P.AS_OF)


@query("member_counters_literal")
def q_member_counters_literal(spark, d):
    ws, checked = _checked_changes(spark, d)
    return live.member_counters_literal(checked.where(F.col("outcome") == "applied"), ws.tasks, P.AS_OF)


@query("latest_status")
def q_latest_status(spark, d):
    ws = ws_of(spark, d)
    return live.run_latest_status(spark, R.status_reqs(spark, d, ws.tasks), ws.tasks, ws.users, P.AS_OF)


@query("live_counters")
def q_live_counters(spark, d):
    ws = ws_of(spark, d)
    return live.run_live_counters(spark, R.status_reqs(spark, d, ws.tasks), ws.tasks, ws.users, P.AS_OF)


@query("status_transitions_stream")
def q_status_transitions_stream(spark, d):
    ws = ws_of(spark, d)
    return live.run_transitions(spark, R.status_reqs(spark, d, ws.tasks), ws.tasks, ws.users, P.AS_OF)


@query("rejected_events")
def q_rejected_events(spark, d):
    ws = ws_of(spark, d)
    return live.run_rejected_events(spark, R.status_reqs(spark, d, ws.tasks), ws.tasks, ws.users, P.AS_OF)


# ---- the rows that the jobs write -----------------------------------------

def _new_rows(after: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    return after.join(before.select(*keys), keys, "left_anti").select(*before.columns)


@query("onboarded_users")
def q_onboarded_users(spark, d):
    users = ws_of(spark, d).users
    return _new_rows(mutations.onboard_members(users, R.onboard_reqs(spark, d), P.AS_OF, "b").tables["users"], users, ["id"])


def _created(spark, d):
    ws = ws_of(spark, d)
    return ws, mutations.create_projects(ws, R.project_reqs(spark, d), R.project_req_members(spark, d), P.AS_OF, "b").tables


@query("created_projects")
def q_created_projects(spark, d):
    ws, tables = _created(spark, d)
    return _new_rows(tables["projects"], ws.projects, ["id"])


@query("created_project_links")
def q_created_project_links(spark, d):
    ws, tables = _created(spark, d)
    return _new_rows(tables["project_members"], ws.project_members, ["project_id", "user_id"])


@query("added_links")
def q_added_links(spark, d):
    ws = ws_of(spark, d)
    links = mutations.add_project_members(ws, R.link_reqs(spark, d)).tables["project_members"]
    return _new_rows(links, ws.project_members, ["project_id", "user_id"])


@query("created_tasks")
def q_created_tasks(spark, d):
    ws = ws_of(spark, d)
    return _new_rows(mutations.create_tasks(ws, R.task_reqs(spark, d), P.AS_OF, "b").tables["tasks"], ws.tasks, ["id"])


@query("tasks_after_changes")
def q_tasks_after_changes(spark, d):
    ws = ws_of(spark, d)
    return mutations.apply_status_changes(ws.tasks, ws.users, R.status_reqs(spark, d, ws.tasks)).tables["tasks"]


@query("projects_after_member_deletes")
def q_projects_after_member_deletes(spark, d):
    return mutations.delete_members(ws_of(spark, d), R.member_delete_reqs(spark, d)).tables["projects"].select("id", "created_by")


# ---- read from a written snapshot -----------------------------------------

def _snapshot(spark, d, keys: str = "bigint"):
    root = scratch_path(spark, "snapshot")
    write_snapshot(cast_keys(ws_of(spark, d), keys), root)
    return read_snapshot(spark, root)


@query("overview_counts")
def q_overview_counts(spark, d):
    return _row_counts([(k, v) for k, v in overview(_snapshot(spark, d), P.AS_OF).items() if k != "counters"]).withColumnRenamed("table_name", "part")


@query("task_page_snapshot")
def q_task_page_snapshot(spark, d):
    return paging.task_page(_snapshot(spark, d), P.PROJECT, P.VIEWER_ADMIN, "admin")


@query("task_listing_text_keys")
def q_task_listing_text_keys(spark, d):
    ws = _snapshot(spark, d, "string")
    return listing.task_listing(ws.tasks, ws.projects, ws.users)


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)
