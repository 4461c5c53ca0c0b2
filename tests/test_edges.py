"""Hand-built edge rows (FIXTURES.md §6) for the semantics decisions R1-R16."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.functions import status as S
from workboard.functions import text as X
from workboard.operators import listing, mutations, paging, rollups
from workboard.sources.workspace import SCHEMAS, Workspace, empty_workspace, workspace_from_rows
from workboard.streaming import live

AS_OF = dt.datetime(2024, 6, 1)
T0 = dt.datetime(2024, 1, 1)


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value,blank", [("\t ", True), (" ", True), ("   ", True), ("", True),
                                         (None, True), (" a ", False), ("﻿x　", False)])
def test_is_blank(spark, value, blank):
    assert one(spark, X.is_blank, value) is blank


def test_ws_trim_and_trim_to_null(spark):
    assert one(spark, X.ws_trim, "\t x  ") == "x"
    assert one(spark, X.ws_trim, "  x y ") == "x y"
    assert one(spark, X.trim_to_null, "   ") is None
    assert one(spark, X.trim_to_null, " note ") == "note"


@pytest.mark.parametrize("raw,canonical", [
    ("ui/ux designer", "UI/UX Designer"), ("  QA   engineer ", "QA Engineer"), ("(QA Engineer)", None),
    ("constructor", None), ("", None), (None, None), (" DevOps-Engineer", "DevOps Engineer"),
    ("FULL_STACK developer", "Full Stack Developer"), ("Team Member", "Team Member")])
def test_job_role(spark, raw, canonical):
    assert one(spark, X.normalize_job_role, raw) == canonical


def test_email_rules(spark):
    assert one(spark, X.normalize_email, " New1@Example.COM ") == "new1@example.com"
    assert one(spark, X.looks_like_email, "no-at-sign") is False
    assert one(spark, X.looks_like_email, None) is False


def test_labels(spark):
    assert one(spark, S.status_label, "in_progress") == "In Progress"
    assert one(spark, S.status_label, "blocked") == "blocked"
    assert one(spark, S.status_label, None) is None
    assert one(spark, S.next_action, "todo") == "Start Task"
    assert one(spark, S.next_action, "completed") is None


@pytest.fixture(scope="module")
def roles_ws(spark):
    users = [(1, "Ann", "a@x", "admin", None, False, T0), (2, "Bob", "b@x", "member", None, False, T0),
             (3, "Cy", "c@x", "manager", "QA Engineer", False, T0), (4, "Di", "d@x", None, None, False, T0),
             (5, "Bob", "b2@x", "member", None, False, T0)]
    projects = [(10, "P", None, 1, T0)]
    due_past = dt.datetime(2024, 3, 1)
    tasks = [(100, 10, "t1", None, "todo", 2, due_past, T0), (101, 10, "t2", None, None, 3, due_past, T0),
             (102, 10, "t3", None, "completed", 4, due_past, T0), (103, 10, "t4", None, "in_progress", 5, None, T0),
             (104, 99, "orphan", None, "todo", 2, None, T0)]
    return workspace_from_rows(spark, users=users, projects=projects, project_members=[(10, 2), (10, 5)], tasks=tasks)


def test_third_role_scope(roles_ws):
    # reference rule: only 'member' is restricted for task listings
    assert listing.my_tasks(roles_ws, 3, "manager").count() == 4
    assert listing.my_tasks(roles_ws, 3, "manager", rule="strict").count() == 1
    assert listing.my_tasks(roles_ws, 4, None).count() == 4
    # stats: everyone but 'admin' sees only their own
    assert rollups.scoped_task_stats(roles_ws.tasks, AS_OF, 3, "manager").first().total_tasks == 1
    assert rollups.scoped_task_stats(roles_ws.tasks, AS_OF, 1, "admin").first().total_tasks == 5


def test_overdue_null_status(roles_ws, spark):
    # SQL rule skips the NULL-status task (R3); browser rule counts it
    assert rollups.task_stats(roles_ws.tasks, AS_OF).first().overdue_tasks == 1
    n = roles_ws.tasks.where(S.is_overdue_browser(AS_OF)).count()
    assert n == 2


def test_namesakes_merge(roles_ws):
    rows = {r.member_name: r.total for r in rollups.tasks_per_member_name(roles_ws.tasks, roles_ws.users).collect()}
    assert rows["Bob"] == 3  # users 2 and 5 share the name (R5)


def test_listing_drops_orphans_but_stats_count_them(roles_ws):
    assert listing.my_tasks(roles_ws, 1, "admin").count() == 4
    assert rollups.task_stats(roles_ws.tasks, AS_OF).first().total_tasks == 5  # R6


def test_batch_order_onboarding(spark, roles_ws):
    reqs = spark.createDataFrame([(1, "  ", "new@x.com", "QA Engineer"), (2, "Eve", " NEW@x.com", "qa engineer"),
                                  (3, "Fay", "new@x.com", "QA Engineer"), (4, "Gus", "b@x", "QA Engineer")],
                                 "seq long, name string, email string, job_role string")
    res = mutations.onboard_members(roles_ws.users, reqs, AS_OF, "b")
    out = {r.seq: r.outcome for r in res.outcomes.collect()}
    assert out == {1: "invalid_name", 2: "inserted", 3: "duplicate", 4: "duplicate"}
    new = res.tables["users"].where(F.col("email") == "new@x.com").collect()
    assert len(new) == 1 and new[0].name == "Eve" and new[0].role == "member" and new[0].job_role == "QA Engineer"
    assert res.tables["users"].select("id").distinct().count() == 6


def test_ties_keyset(spark):
    ts = dt.datetime(2024, 2, 1)
    tasks = [(i, 1, f"t{i}", None, "todo", None, None, ts) for i in range(60)]
    ws = workspace_from_rows(spark, projects=[(1, "P", None, None, T0)], tasks=tasks)
    seen_c, cursor = [], None
    while True:
        page = paging.task_page(ws, 1, 0, "admin", cursor=cursor, limit=50).collect()
        if not page:
            break
        seen_c += [r.id for r in page]
        cursor = paging.next_cursor(page)
    assert sorted(seen_c) == list(range(60))
    first = paging.task_page(ws, 1, 0, "admin", limit=50, cursor_mode="timestamp").collect()
    nxt = paging.task_page(ws, 1, 0, "admin", cursor=paging.next_cursor(first, "timestamp"), limit=50,
                           cursor_mode="timestamp").collect()
    assert len(first) == 50 and len(nxt) == 0  # the timestamp cursor loses 10 tied rows (R2)


def test_reopen_delta_vs_recompute(spark):
    due = dt.datetime(2024, 3, 1)
    ws = workspace_from_rows(spark, users=[(1, "A", "a@x", "admin", None, False, T0)],
                             projects=[(1, "P", None, 1, T0)],
                             tasks=[(7, 1, "t", None, "in_progress", 1, due, T0)])
    changes = spark.createDataFrame([(1, dt.datetime(2024, 4, 1), 7, "completed", 1),
                                     (2, dt.datetime(2024, 4, 2), 7, "in_progress", 1)],
                                    "seq long, ts timestamp_ntz, task_id long, status string, requester_id long")
    deltas = live.status_transitions(changes, ws.tasks, AS_OF).orderBy("seq").collect()
    assert [(r.prev_status, r.d_completed, r.d_in_progress, r.d_overdue) for r in deltas] == [
        ("in_progress", 1, -1, -1), ("completed", -1, 1, 0)]
    base = rollups.task_stats(ws.tasks, AS_OF).first()
    delta_overdue = base.overdue_tasks + sum(r.d_overdue for r in deltas)
    after = mutations.apply_status_changes(ws.tasks, ws.users, changes).tables["tasks"]
    recomputed = rollups.task_stats(after, AS_OF).first().overdue_tasks
    assert (delta_overdue, recomputed) == (0, 1)  # R14: the browser arithmetic never re-adds overdue


def test_empty_workspace(spark):
    ws = empty_workspace(spark)
    r = rollups.task_stats(ws.tasks, AS_OF).first()
    assert (r.total_tasks, r.completed_tasks, r.in_progress_tasks, r.overdue_tasks) == (0, 0, 0, 0)
    assert rollups.member_rollup(ws.users, ws.project_members, ws.tasks).count() == 0
    assert rollups.page_count(ws.tasks, 8).first().page_count == 1
    assert paging.offset_page(ws.tasks, 5).count() == 0


def test_batch_order_links_and_status(spark, roles_ws):
    links = spark.createDataFrame([(1, 10, 99), (2, 10, 5), (3, 10, 2), (4, 11, 5), (5, 10, 5)],
                                  "seq long, project_id long, user_id long")
    # user 99 unknown; 5 is a member not yet linked; 2 already linked; project 11 missing; seq 5 repeats seq 2
    res = mutations.add_project_members(roles_ws.replace(project_members=roles_ws.project_members.where("user_id = 2")), links)
    out = {r.seq: r.outcome for r in res.outcomes.collect()}
    assert out == {1: "not_member", 2: "inserted", 3: "already_member", 4: "project_not_found", 5: "already_member"}
    changes = spark.createDataFrame([(1, dt.datetime(2024, 5, 2), 100, "done", 2),
                                     (2, dt.datetime(2024, 5, 1), 100, "completed", 2),
                                     (3, dt.datetime(2024, 5, 3), 100, "in_progress", 5),
                                     (4, dt.datetime(2024, 5, 3), 100, "todo", 1)],
                                    "seq long, ts timestamp_ntz, task_id long, status string, requester_id long")
    res = mutations.apply_status_changes(roles_ws.tasks, roles_ws.users, changes)
    out = {r.seq: r.outcome for r in res.outcomes.collect()}
    assert out == {1: "invalid_status", 2: "applied", 3: "forbidden", 4: "applied"}
    assert res.tables["tasks"].where("id = 100").first().status == "todo"  # latest applied by (ts, seq)


def test_live_counters_empty_stream(spark, roles_ws):
    empty = spark.createDataFrame([], "seq long, ts timestamp_ntz, task_id long, status string, requester_id long")
    got = live.run_live_counters(spark, empty, roles_ws.tasks, roles_ws.users, AS_OF).first()
    base = rollups.task_stats(roles_ws.tasks, AS_OF).first()
    assert tuple(got) == tuple(base)
    assert live.run_rejected_events(spark, empty, roles_ws.tasks, roles_ws.users, AS_OF).count() == 0


def test_live_counters_equal_batch(spark, roles_ws):
    reqs = spark.createDataFrame([(1, dt.datetime(2024, 5, 1), 100, "completed", 2),
                                  (2, dt.datetime(2024, 5, 2), 101, "in_progress", 1),
                                  (3, dt.datetime(2024, 5, 3), 102, "todo", 4),
                                  (4, dt.datetime(2024, 5, 4), 999, "todo", 1),
                                  (5, dt.datetime(2024, 5, 5), 100, "todo", 5)],
                                 "seq long, ts timestamp_ntz, task_id long, status string, requester_id long")
    got = live.run_live_counters(spark, reqs, roles_ws.tasks, roles_ws.users, AS_OF).first()
    after = mutations.apply_status_changes(roles_ws.tasks, roles_ws.users, reqs).tables["tasks"]
    assert tuple(got) == tuple(rollups.task_stats(after, AS_OF).first())
    rej = {r.seq: r.outcome for r in live.run_rejected_events(spark, reqs, roles_ws.tasks, roles_ws.users, AS_OF).collect()}
    assert rej == {4: "not_found", 5: "forbidden"}


REQS = "seq long, ts timestamp_ntz, task_id long, status string, requester_id long"


CHANGES = REQS + ", requester_role string, kind string, assigned_to long, due_date timestamp_ntz"
ROLES = {1: "admin", 2: "member", 3: "member", 4: "viewer", 5: "member"}


def _landed(spark, rows, folder):
    """Rows of (seq, ts, task_id, status, requester_id) and whole change rows, as the stream reads them."""
    whole = [r if len(r) > 5 else (*r, ROLES.get(r[4]), None, None, None) for r in rows]
    spark.createDataFrame(whole, CHANGES).coalesce(1).write.parquet(folder)


def _board(spark, root, tasks, **kw):
    changes = live.file_stream(spark, f"{root}/landing/*", T.StructType.fromDDL(CHANGES), files_per_trigger=1)
    return live.start_live_board(spark, changes, tasks, AS_OF, f"{root}/board", **{"trigger": {"processingTime": "1 second"}, **kw})


def _applied(spark, ws, rows):
    return mutations.apply_status_changes(ws.tasks, ws.users, spark.createDataFrame(rows, REQS)).tables["tasks"]


def _stats(tasks):
    return tuple(rollups.task_stats(tasks, AS_OF).first())


def test_live_board_through_commit_restart_and_new_tasks(spark, roles_ws):
    """Counters before, during and after a commit, after a restart, and with tasks that other jobs create and delete."""
    from workboard.session import scratch_path
    from workboard.sources.snapshot import read_snapshot, snapshot_mark
    root = scratch_path(spark, "live-test")
    one = [(1, dt.datetime(2024, 5, 1), 100, "completed", 2), (2, dt.datetime(2024, 5, 1), 101, "done", 1)]
    two = [(3, None, 100, "todo", 2), (4, dt.datetime(2024, 5, 3), 101, "completed", 1)]
    three = [(5, dt.datetime(2024, 5, 4), 101, "in_progress", 1), (6, dt.datetime(2024, 5, 5), 102, "completed", 2)]
    _landed(spark, one, f"{root}/landing/f1")
    query, board = _board(spark, root, roles_ws.tasks)
    try:
        query.processAllAvailable()
        assert tuple(board.counters().first()) == _stats(_applied(spark, roles_ws, one))
        assert live.commit_changes(board, roles_ws, f"{root}/snapshots") == 0
        committed = read_snapshot(spark, f"{root}/snapshots")
        assert _stats(committed.tasks) == tuple(board.counters().first())
        _landed(spark, two, f"{root}/landing/f2")
        query.processAllAvailable()
        assert tuple(board.counters().first()) == _stats(_applied(spark, roles_ws, one + two))
    finally:
        query.stop()
    mark = snapshot_mark(spark, f"{root}/snapshots")
    assert (mark["seq"], mark["stream"]) == (2, f"{root}/board")
    _landed(spark, three, f"{root}/landing/f3")
    query, board = _board(spark, root, committed.tasks)  # goes on from its checkpoint; the tables given now don't matter
    due = dt.datetime(2024, 1, 1)
    try:
        query.processAllAvailable()
        after = _applied(spark, roles_ws, one + two + three)
        assert tuple(board.counters().first()) == _stats(after)
        made = (7, dt.datetime(2024, 5, 6), 555, "todo", 1, "admin", "put", 2, due)
        gone = (8, dt.datetime(2024, 5, 6), 102, None, 1, "admin", "delete", None, None)
        _landed(spark, [made, gone, (9, dt.datetime(2024, 5, 7), 555, "completed", 2), (10, dt.datetime(2024, 5, 8), 102, "todo", 1)],
                f"{root}/landing/f4")
        query.processAllAvailable()
        total = _stats(after.where("id <> 102"))
        assert tuple(board.counters().first()) == (total[0] + 1, total[1] + 1, *total[2:])
        assert {r.seq: r.outcome for r in board.rejected().collect()} == {
            2: "invalid_status", 6: "forbidden", 10: "not_found"}
    finally:
        query.stop()
    # a new stream from the committed tables: requests that they have are left out, the others count as
    # in a batch job on those tables (which don't say when a task was last changed)
    changes = live.file_stream(spark, f"{root}/landing/f[123]", T.StructType.fromDDL(CHANGES))
    query, fresh = live.start_live_board(spark, changes, committed.tasks, AS_OF, f"{root}/second", after_seq=mark["seq"],
                                         trigger={"availableNow": True})
    query.awaitTermination()
    assert tuple(fresh.counters().first()) == _stats(_applied(spark, committed, two + three))
    assert sorted(r.seq for r in fresh.log().collect()) == [3, 4, 5, 6]


def test_a_retried_micro_batch_changes_nothing(spark, roles_ws):
    from workboard.session import scratch_path
    root = scratch_path(spark, "live-retry")
    batches = [[(1, dt.datetime(2024, 5, 1), 100, "completed", 2)], [(2, dt.datetime(2024, 5, 2), 100, "todo", 2)],
               [(3, dt.datetime(2024, 4, 1), 100, "in_progress", 2), (4, dt.datetime(2024, 5, 5), 101, "completed", 1)]]
    board = live.replay(spark, spark.createDataFrame(sum(batches, []), REQS), roles_ws.tasks, roles_ws.users, AS_OF, root=root, files=3, files_per_trigger=1)
    want, n, last = tuple(board.counters().first()), board.log().count(), board.last()["batch"]
    for batch in (last, last):
        rows = spark.createDataFrame(spark.read.schema(board.schema).parquet(f"{board.root}/log/batch={batch}").collect(), board.schema)
        board.process(rows, batch)
    assert tuple(board.counters().first()) == want == _stats(_applied(spark, roles_ws, sum(batches, [])))
    assert board.log().count() == n == 4
    late = {r.seq: r for r in board.transitions().collect()}
    assert late[1].prev_status in ("todo", "in_progress", "completed", None) and late[2].d_completed == -1


def test_merged_log_keeps_rows_and_readers(spark, roles_ws, monkeypatch):
    import os
    from workboard.session import scratch_path
    monkeypatch.setattr(live, "MERGE", 2)
    rows = [(i, dt.datetime(2024, 5, 1 + i), 100 + i % 2, ("completed", "todo", "in_progress", "done")[i % 4], None) for i in range(9)]
    reqs = spark.createDataFrame(rows, REQS)
    board = live.LiveBoard(spark, scratch_path(spark, "live-merge"), T.StructType.fromDDL(CHANGES))
    board.begin(roles_ws.tasks, AS_OF, "reference", 64)
    done = live.replay(spark, reqs, roles_ws.tasks, roles_ws.users, AS_OF).log().collect()
    reader = None
    for i, row in enumerate(sorted(done, key=lambda r: r.seq)):
        board.process(spark.createDataFrame([row], board.schema), i)
        if i == 5:
            reader = board.log()  # sees the folders of before the next merges
        assert sorted(r.seq for r in board.log().collect()) == list(range(i + 1))
    assert reader.count() == 6
    folders = [p for p in os.listdir(f"{board.root}/log".replace("file:", ""))]
    assert sum(p.startswith("merged") for p in folders) > 1
    board.retain = 0.0
    board.merge(board.last()["batch"])
    board.merge(board.last()["batch"])
    left = os.listdir(f"{board.root}/log".replace("file:", ""))
    assert len(left) <= 4 < len(folders) and board.log().count() == 9
    assert tuple(board.counters().first()) == _stats(_applied(spark, roles_ws, rows))


def test_a_micro_batch_touches_its_own_buckets(spark):
    """The state that a micro-batch updates depends on its rows, not on the size of the table."""
    from workboard.session import scratch_path
    touched = []
    for n in (2_000, 20_000):
        root = scratch_path(spark, "live-size")
        tasks = spark.range(n).selectExpr("id", "'todo' AS status", "id AS assigned_to", "CAST(NULL AS timestamp_ntz) AS due_date")
        for f in range(2):
            rows = [(10 * f + k, dt.datetime(2024, 5, 1), 97 * k, "completed", 1) for k in range(5)]
            _landed(spark, rows, f"{root}/landing/f{f}")
        query, board = _board(spark, root, tasks, trigger={"availableNow": True}, tasks_per_bucket=64)
        query.awaitTermination()
        touched.append([p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.numInputRows][-1])
        assert tuple(board.counters().first()) == (n, 5, 0, 0)
    assert touched[0] <= 5 and touched[1] <= 5


def _one_by_one(tasks, rows, as_of):
    """The live board's rules, a change at a time: log rows by seq, and the tasks in the end."""
    def place(r):
        return (r[1] is not None, r[1] or dt.datetime.min, r[0], r[3] or "")

    def counts(t):
        if t is None:
            return 0, 0, 0, 0
        late = t[0] is not None and t[0] != "completed" and t[2] is not None and t[2] < as_of
        return 1, int(t[0] == "completed"), int(t[0] == "in_progress"), int(late)
    log = {}
    for seq, ts, i, status, requester, role, kind, assignee, due in sorted(rows, key=place):
        task, new, literal, outcome, here = tasks.get(i), None, (0, 0, 0), "applied", place((seq, ts, i, status))
        if kind == "status":
            outcome = ("invalid_status" if status not in ("todo", "in_progress", "completed") else "not_found" if task is None
                       else "forbidden" if role == "member" and task[1] != requester else "applied")
        if outcome != "applied" or (kind == "status" and task[3] is not None and task[3] >= here):
            new = task
        elif kind == "put":
            new = (status, assignee, due, task[3] if task else None)
        elif kind == "status":
            new = (status, task[1], task[2], here)
            if task[0] != status:
                late = task[0] != "completed" and task[2] is not None and task[2] < as_of
                literal = ((status == "in_progress") - (task[0] == "in_progress"), (status == "completed") - (task[0] == "completed"),
                           -int(late and status == "completed"))
        tasks.pop(i, None)
        if new is not None:
            tasks[i] = new
        log[seq] = (i, status, outcome, task[0] if task else None, *literal, *(b - a for a, b in zip(counts(task), counts(new))))
    return log


def test_packed_changes_equal_one_by_one(spark, monkeypatch):
    """Rows go through the state in packs; several to a bucket and micro-batch, with steps of a few rows."""
    import random

    from workboard.session import scratch_path
    from workboard.streaming import task_state
    monkeypatch.setattr(task_state, "PACK_BYTES", 1500)
    monkeypatch.setattr(task_state, "STEP_ROWS", 7)
    rnd, states = random.Random(7), ["todo", "in_progress", "completed", "done", None]
    tasks = {i: (rnd.choice(states), rnd.choice([1, 2, 3, None]), rnd.choice([None, dt.datetime(2020, 1, 1), dt.datetime(2099, 1, 1)]), None)
             for i in range(600)}
    frame = spark.createDataFrame([(i, *t[:3]) for i, t in tasks.items()], "id long, status string, assigned_to long, due_date timestamp_ntz")
    root, want = scratch_path(spark, "live-packed"), {}
    for f in range(3):
        rows = []
        for k in range(200):
            kind = rnd.choice(["status"] * 8 + ["put", "delete"])
            rows.append((200 * f + k, rnd.choice([None, dt.datetime(2024, 5, 1, rnd.randrange(5))]), rnd.choice([*range(20), 700, 701]), rnd.choice(states),
                         rnd.choice([1, 2, 3]), rnd.choice(["admin", "member", None]), kind, rnd.choice([1, 2, None]), dt.datetime(2020, 1, 2)))
        spark.createDataFrame(rows, CHANGES).repartition(3).write.parquet(f"{root}/landing/f{f}")
        want.update(_one_by_one(tasks, rows, AS_OF))
    changes = live.file_stream(spark, f"{root}/landing/*", T.StructType.fromDDL(CHANGES), files_per_trigger=3)
    query, board = live.start_live_board(spark, changes, frame, AS_OF, f"{root}/board", trigger={"availableNow": True})
    query.awaitTermination()
    got = board.log().collect()
    assert {r.seq: (r.task_id, r.status, r.outcome, r.prev_status, r.d_in_progress, r.d_completed, r.d_overdue, r.g_total, r.g_completed,
                    r.g_in_progress, r.g_overdue) for r in got} == want and len(got) == 600
    late = [t[2] is not None and t[2] < AS_OF and t[0] not in (None, "completed") for t in tasks.values()]
    assert tuple(board.counters().first()) == (len(tasks), *(sum(t[0] == s for t in tasks.values()) for s in ("completed", "in_progress")), sum(late))
    assert sorted(map(tuple, board.latest().collect())) == sorted((i, t[0]) for i, t in tasks.items() if t[3] is not None)
    # what a micro-batch writes are the tasks that changed, not all of their buckets
    import pickle
    state = spark.read.format("statestore").option("stateVarName", "changed").load(f"{root}/board/checkpoint").select("value.tasks").collect()
    assert sum(len(pickle.loads(r.tasks)) for r in state) <= 22


def test_a_replay_has_few_large_buckets(spark):
    from workboard.session import scratch_path
    from workboard.sources.files import write_record
    tasks = spark.range(600_000).selectExpr("id", "'todo' AS status", "id AS assigned_to", "CAST(NULL AS timestamp_ntz) AS due_date")
    cores, buckets = spark.sparkContext.defaultParallelism, []
    for size in (live.TASKS_PER_BUCKET, live.REPLAY_TASKS_PER_BUCKET):
        board = live.LiveBoard(spark, scratch_path(spark, "live-buckets"), T.StructType.fromDDL(CHANGES))
        buckets.append(board.begin(tasks, AS_OF, "reference", size)["buckets"])
        assert board.begin(tasks, AS_OF, "reference", 1)["buckets"] == buckets[-1]  # it goes on with its own
    write_record(spark, f"{board.root}/stream.json", '{"buckets": 3, "as_of": "2024-05-01", "rule": "reference"}', replace=True)
    with pytest.raises(ValueError, match="another layout"):
        board.begin(tasks, AS_OF, "reference", 1)
    assert buckets == [2344, min(2343, max(73, live.BUCKETS_PER_CORE * cores)) + 1]


def test_counter_clamps(spark):
    df = spark.createDataFrame([(0,), (1,), (9,)], "v int")
    rows = df.select(S.decrement_floor0("v").alias("d"), S.clamp("v", 1, 5).alias("c")).collect()
    assert [(r.d, r.c) for r in rows] == [(0, 1), (0, 1), (8, 5)]
    assert S.as_count is not None and listing.by_id(df.withColumnRenamed("v", "id"), 9).count() == 1


def test_as_of_independent_of_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        v = spark.range(1).select(S.as_of_lit(dt.datetime(1998, 8, 2)).alias("t")).first().t
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert v == dt.datetime(1998, 8, 2)


def test_two_spellings_of_one_id(spark, roles_ws):
    from workboard.sources.workspace import cast_keys
    ws = cast_keys(roles_ws, "string")
    reqs = spark.createDataFrame([(1, "P2", None, "1")], "seq long, name string, description string, creator_id string")
    members = spark.createDataFrame([(1, " 5"), (1, "5"), (1, ""), (1, None)], "seq long, user_id string")
    res = mutations.create_projects(ws, reqs, members, AS_OF, "b")
    assert [r.outcome for r in res.outcomes.collect()] == ["inserted"]
    new = res.tables["project_members"].join(ws.project_members, ["project_id", "user_id"], "left_anti")
    assert sorted(r.user_id for r in new.collect()) == ["1", "5"]


@pytest.mark.parametrize("limit", [0, -1, "20", 2.5, True])
def test_limit_validation(roles_ws, limit):
    with pytest.raises(ValueError):
        paging.task_page(roles_ws, 10, 1, "admin", limit=limit)
    with pytest.raises(ValueError):
        paging.project_page(roles_ws, 1, "admin", limit=limit)


def test_member_counters_floor_at_zero(spark, roles_ws):
    # user 3 owns task 101: status NULL, due in the past -> SQL overdue 0, browser overdue yes
    changes = spark.createDataFrame([(1, dt.datetime(2024, 5, 1), 101, "completed", 3),
                                     (2, dt.datetime(2024, 5, 2), 101, "todo", 3),
                                     (3, dt.datetime(2024, 5, 3), 101, "completed", 3)],
                                    "seq long, ts timestamp_ntz, task_id long, status string, requester_id long")
    out = {r.user_id: r for r in live.member_counters_literal(changes, roles_ws.tasks, AS_OF).collect()}
    r = out[3]
    # completed: 0 -> 1 -> 0 -> 1; overdue: 0, -1 floored to 0, then 0 (not overdue after reopen? todo is overdue: -1 -> floor 0)
    assert (r.total_tasks, r.completed_tasks, r.in_progress_tasks, r.overdue_tasks) == (1, 1, 0, 0)
    raw = live.status_transitions(changes, roles_ws.tasks, AS_OF).agg(F.sum("d_overdue")).first()[0]
    assert raw == -2  # without the floor the counter would read -2


def test_trim_keeps_space_before_final_nel(spark):
    # Java's ``$`` matches before a final U+0085; JavaScript trim() does not strip it
    assert one(spark, X.ws_trim, "0 \x85") == "0 \x85"
    assert one(spark, X.ws_trim, " a\n") == "a"


def test_keyset_pages_with_null_timestamps(spark):
    ts = [None, None, None, dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 5), None]
    tasks = [(i, 1, f"t{i}", None, "todo", None, None, t) for i, t in enumerate(ts)]
    ws = workspace_from_rows(spark, projects=[(1, "P", None, None, T0)], tasks=tasks)
    seen, cursor = [], None
    while True:
        page = paging.task_page(ws, 1, 0, "admin", cursor=cursor, limit=2).collect()
        if not page:
            break
        seen += [r.id for r in page]
        cursor = paging.next_cursor(page)
    # PostgreSQL order: NULL timestamps first (id desc), then newest first
    assert seen == [6, 2, 1, 0, 4, 3, 5]


def test_every_audit_rule_finds_a_violation(spark):
    from workboard.operators import audit
    from workboard.sources.workspace import SCHEMAS, Workspace
    t0 = dt.datetime(2024, 1, 1)
    rows = {
        "users": [(None, None, None, "boss", None, None, t0), (1, "n" * 256, "e" * 256, "r" * 51, "j" * 101, False, t0),
                  (1, "a", "dup@x", "member", None, False, t0), (2, "b", "dup@x", "admin", None, False, t0)],
        "projects": [(None, None, None, None, t0), (1, "p" * 256, None, 99, t0), (1, "p", None, 1, t0)],
        "project_members": [(None, 1), (1, None), (77, 1), (1, 88), (1, 1), (1, 1)],
        "tasks": [(None, 1, None, None, "odd", 1, None, t0), (1, 77, "t" * 256, None, "s" * 51, 88, None, t0),
                  (1, 1, "t", None, "todo", None, None, t0)],
    }
    ws = Workspace(**{n: spark.createDataFrame(r, T.StructType([T.StructField(f.name, f.dataType) for f in SCHEMAS[n]]))
                      for n, r in rows.items()})
    found = {(r.table_name, r.rule): r.violations for r in audit.constraint_audit(ws).collect()}
    assert len(found) == 27 and all(n > 0 for n in found.values()), found
    assert all(r.violations > 0 for r in audit.orphan_audit(ws).collect())


def test_constraint_audit_counts_by_narrow_entries(spark):
    """Repeated and NULL keys in all tables; what is shuffled by key holds counts of keys and references only."""
    from workboard.operators import audit
    t = dt.datetime(2024, 1, 1)
    kinds = {n: T.StructType([T.StructField(f.name, f.dataType) for f in schema]) for n, schema in SCHEMAS.items()}
    rows = {
        "users": [(1, "a", "x@y", "admin", None, False, t), (1, "b", "x@y", "boss", None, False, t), (None, None, None, None, None, False, t),
                  (None, "c" * 256, "z@y", "member", None, False, t)],
        "projects": [(1, "p", None, 1, t), (2, None, None, 9, t), (2, "q", None, None, t)],
        "project_members": [(1, 1), (1, 1), (1, None), (None, 1), (7, 8), (7, 8), (7, 8)],
        "tasks": [(1, 1, "t", None, "todo", 1, None, t), (1, 3, None, None, "done", 5, None, t), (None, None, "u", None, None, None, None, t)]}
    ws = Workspace(**{n: spark.createDataFrame(rows[n], kinds[n]) for n in kinds})
    found = {(r.table_name, r.rule): r.violations for r in audit.constraint_audit(ws).collect()}
    assert {k: v for k, v in found.items() if v} == {
        ("users", "not_null_id"): 2, ("users", "primary_key"): 1, ("users", "not_null_name"): 1, ("users", "not_null_email"): 1,
        ("users", "check_role"): 1, ("users", "length_name"): 1, ("users", "unique_email"): 1,
        ("projects", "primary_key"): 1, ("projects", "not_null_name"): 1, ("projects", "fk_created_by"): 1,
        ("project_members", "not_null_key"): 2, ("project_members", "primary_key"): 2,
        ("project_members", "fk_project"): 3, ("project_members", "fk_user"): 3,
        ("tasks", "not_null_id"): 1, ("tasks", "primary_key"): 1, ("tasks", "not_null_title"): 1, ("tasks", "check_status"): 1,
        ("tasks", "fk_project"): 1, ("tasks", "fk_assigned_to"): 1}
    assert len(found) == 27
    assert audit._by_key(ws).columns == ["domain", "key", "own", "ref_0", "ref_1", "ref_2"]
