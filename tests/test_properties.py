"""Properties over the driver data (FIXTURES.md facts, batch jobs, numbering, snapshots)."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from tests import plain
from workboard.operators import audit, listing, mutations, paging, rollups
from workboard.operators.ordered import number_within_groups
from workboard.plans import params as P
from workboard.sources import requests as R
from workboard.sources.catalog import list_tables
from workboard.sources.snapshot import read_snapshot, to_json_docs, write_snapshot
from workboard.sources.workspace import derive_workspace, register_views
from workboard.session import scratch_path


@pytest.fixture(scope="module")
def ws01(spark):
    return derive_workspace(spark, SF01)


def test_fixture_facts_sf001(ws01):
    by_status = {r.status: r.task_count for r in rollups.status_distribution(ws01.tasks).collect()}
    assert by_status == {None: 72, "blocked": 48, "completed": 4895, "in_progress": 5045, "todo": 4940}
    o = {r.check_name: r.violations for r in audit.orphan_audit(ws01).collect()}
    assert (o["tasks_missing_project"], o["tasks_dangling_assignee"], o["tasks_unassigned"]) == (1360, 137, 1154)
    assert rollups.task_stats(ws01.tasks, P.AS_OF).first().overdue_tasks == 4272
    assert ws01.project_members.count() == 48518


def test_fanout_differs_from_rollup(ws01):
    a = rollups.member_rollup(ws01.users, ws01.project_members, ws01.tasks, sort=False)
    b = rollups.member_rollup_fanout(ws01.users, ws01.project_members, ws01.tasks, sort=False)
    j = a.alias("a").join(b.alias("b"), "id")
    assert j.where(F.col("a.assigned_task_count") != F.col("b.assigned_task_count")).count() > 1000
    assert a.agg(F.sum("assigned_task_count")).first()[0] == 13427 - 0  # real assigned tasks of members


def test_roster_count_equals_member_count(ws01):
    roll = rollups.project_rollup(ws01.projects, ws01.project_members, ws01.users, sort=False)
    roster = rollups.project_roster_long(ws01.projects, ws01.project_members, ws01.users) \
        .groupBy("project_id").count()
    j = roll.join(roster, roll.id == roster.project_id, "left")
    assert j.where(F.coalesce(F.col("count"), F.lit(0)) != F.col("member_count")).count() == 0


@pytest.mark.parametrize("job", ["onboard", "links", "tasks", "status", "projects", "del_members", "del_projects"])
def test_outcome_per_request(spark, ws01, job):
    d = SF01
    if job == "onboard":
        reqs = R.onboard_reqs(spark, d)
        res = mutations.onboard_members(ws01.users, reqs, P.AS_OF, "b")
    elif job == "links":
        reqs = R.link_reqs(spark, d)
        res = mutations.add_project_members(ws01, reqs)
    elif job == "tasks":
        reqs = R.task_reqs(spark, d)
        res = mutations.create_tasks(ws01, reqs, P.AS_OF, "b")
    elif job == "status":
        reqs = R.status_reqs(spark, d, ws01.tasks)
        res = mutations.apply_status_changes(ws01.tasks, ws01.users, reqs)
    elif job == "projects":
        reqs = R.project_reqs(spark, d)
        res = mutations.create_projects(ws01, reqs, R.project_req_members(spark, d), P.AS_OF, "b")
    elif job == "del_members":
        reqs = R.member_delete_reqs(spark, d)
        res = mutations.delete_members(ws01, reqs)
    else:
        reqs = R.project_delete_reqs(spark, d)
        res = mutations.delete_projects(ws01, reqs)
    o = res.outcomes
    assert o.count() == reqs.count()
    assert o.select("seq").distinct().count() == reqs.count()
    assert o.where(F.col("http_status").isNull()).count() == 0


def test_fixture_outcome_counts(spark, ws01):
    def counts(df):
        return {r.outcome: r["count"] for r in df.groupBy("outcome").count().collect()}
    assert counts(mutations.onboard_members(ws01.users, R.onboard_reqs(spark, SF01), P.AS_OF, "b").outcomes) == {
        "invalid_name": 200, "invalid_email": 257, "invalid_job_role": 343, "duplicate": 563, "inserted": 637}
    assert counts(mutations.create_tasks(ws01, R.task_reqs(spark, SF01), P.AS_OF, "b").outcomes) == {
        "invalid_title": 1472, "missing_assignee": 1475, "project_not_found": 512,
        "not_project_member": 1069, "inserted": 10215}
    st = counts(mutations.apply_status_changes(ws01.tasks, ws01.users, R.status_reqs(spark, SF01, ws01.tasks)).outcomes)
    assert st == {"invalid_status": 2014, "not_found": 2017, "forbidden": 1510, "applied": 4459}
    assert counts(mutations.add_project_members(ws01, R.link_reqs(spark, SF01)).outcomes) == {
        "missing_user": 1667, "not_member": 1919, "project_not_found": 113, "already_member": 4210, "inserted": 7091}
    assert counts(mutations.create_projects(ws01, R.project_reqs(spark, SF01), R.project_req_members(spark, SF01),
                                            P.AS_OF, "b").outcomes) == {"invalid_name": 12, "invalid_member": 15, "inserted": 73}


def test_inserted_rows_follow_outcomes(spark, ws01):
    res = mutations.create_tasks(ws01, R.task_reqs(spark, SF01), P.AS_OF, "b")
    new = res.tables["tasks"].count() - ws01.tasks.count()
    assert new == res.outcomes.where(F.col("outcome") == "inserted").count()
    added = res.tables["tasks"].join(ws01.tasks.select("id"), "id", "left_anti")
    assert added.where(F.col("created_at") != F.lit(P.AS_OF)).count() == 0
    assert added.where((F.col("status") != "todo") | F.col("title").startswith(" ")).count() == 0
    assert res.tables["tasks"].select("id").distinct().count() == res.tables["tasks"].count()


def test_create_projects_links(spark, ws01):
    res = mutations.create_projects(ws01, R.project_reqs(spark, SF01), R.project_req_members(spark, SF01), P.AS_OF, "b")
    ins = res.outcomes.where(F.col("outcome") == "inserted").count()
    new_p = res.tables["projects"].count() - ws01.projects.count()
    assert new_p == ins
    pm = res.tables["project_members"]
    assert pm.count() == pm.dropDuplicates(["project_id", "user_id"]).count()
    new_ids = res.tables["projects"].join(ws01.projects, "id", "left_anti").select(F.col("id").alias("project_id"))
    creators = pm.join(new_ids, "project_id", "left_semi").where(F.col("user_id") == 50).count()
    assert creators == ins


def test_delete_member_cascades(spark, ws01):
    res = mutations.delete_members(ws01, R.member_delete_reqs(spark, SF01))
    gone = res.outcomes.where(F.col("outcome") == "deleted").select(F.col("seq"))
    assert gone.count() > 0
    ids = R.member_delete_reqs(spark, SF01).join(gone, "seq", "left_semi").select("user_id")
    t = res.tables
    assert t["tasks"].join(ids.withColumnRenamed("user_id", "assigned_to"), "assigned_to", "left_semi").count() == 0
    assert t["project_members"].join(ids, "user_id", "left_semi").count() == 0
    assert t["projects"].join(ids.withColumnRenamed("user_id", "created_by"), "created_by", "left_semi").count() == 0


def test_reset_keeps_admins_and_null_roles(spark):
    ws = derive_workspace(spark, SF001)
    r = mutations.reset_workspace(ws)
    assert r.tasks.count() == 0 and r.projects.count() == 0 and r.project_members.count() == 0
    assert r.users.where(F.col("role") == "member").count() == 0
    assert r.users.count() == ws.users.where(F.col("role") == "admin").count()


def test_skewed_group_numbering(spark):
    # one project holds a third of all rows
    base = spark.range(30000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 997).alias("project_id"),
        F.when(F.col("id") % 2 == 0, "todo").otherwise(None).alias("status"),
        (F.col("id") % 50).alias("created_at"))
    order = [F.col("created_at").desc(), F.col("id").desc()]
    a = plain.numbered(base, ["project_id", "status"], order, size_col="n", lag_cols=("id",))
    b = number_within_groups(base, ["project_id", "status"], order, size_col="n", lag_cols=("id",), num_partitions=17)
    cols = ["id", "pos", "n", "prev_id"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert b.count() == 30000


def test_keyset_pages_cover_listing(spark):
    ws = derive_workspace(spark, SF01)
    seen, cursor = [], None
    while True:
        page = paging.task_page(ws, P.PROJECT, P.VIEWER_ADMIN, "admin", cursor=cursor, limit=50).collect()
        if not page:
            break
        seen += [r.id for r in page]
        cursor = paging.next_cursor(page)
    full = listing.task_listing(ws.tasks, ws.projects, ws.users).where(F.col("project_id") == P.PROJECT)
    assert len(seen) == len(set(seen)) == full.count() == 137


def _plan(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_assign_pages_without_a_single_partition(spark):
    ws = derive_workspace(spark, SF001)
    lst = listing.overview_tasks(ws, sort=False)
    a = plain.numbered(lst, [], paging.newest_first(), pos_col="row_number").select("id", "row_number")
    b = paging.assign_pages(lst, 8)
    assert a.exceptAll(b.select("id", "row_number")).count() == 0 and b.count() == a.count()
    assert b.where(F.col("page") != F.floor((F.col("row_number") - 1) / 8) + 1).count() == 0
    b.collect()
    assert "SinglePartition" not in _plan(b)


def test_snapshot_roundtrip(spark):
    ws = derive_workspace(spark, SF001)
    root = scratch_path(spark, "snapshot-test")
    v0 = write_snapshot(ws, root)
    after = mutations.reset_workspace(ws)
    v1 = write_snapshot(after, root)
    assert (v0, v1) == (0, 1)
    latest = read_snapshot(spark, root)
    assert latest.tasks.count() == 0
    old = read_snapshot(spark, root, 0)
    assert old.tasks.count() == ws.tasks.count()
    docs = to_json_docs(rollups.task_stats(old.tasks, P.AS_OF)).first().doc
    assert docs.startswith('{"total_tasks":1500')


def test_list_tables(spark):
    ws = derive_workspace(spark, SF001)
    register_views(ws)
    assert {r.table_name for r in list_tables(spark).collect()} == {"users", "projects", "project_members", "tasks"}


def test_offset_page_at_any_depth(spark):
    ws = derive_workspace(spark, SF001)
    lst = listing.overview_tasks(ws, sort=False)
    everything = [r.id for r in lst.orderBy(*paging.newest_first()).collect()]
    pages = -(-len(everything) // 8)
    for page in (-1, 1, 40, pages, 10 ** 9):
        at = (min(max(page, 1), pages) - 1) * 8
        assert [r.id for r in paging.offset_page(lst, page, 8).collect()] == everything[at:at + 8]


def test_snapshots_are_never_overwritten(spark):
    import pytest
    from workboard.sources.snapshot import SnapshotConflict
    ws = derive_workspace(spark, SF001)
    root = scratch_path(spark, "snapshot-conflict")
    with pytest.raises(ValueError):
        write_snapshot(ws, root, mode_tables=("tasks",))  # nothing to carry forward
    assert write_snapshot(ws, root) == 0
    with pytest.raises(SnapshotConflict):
        write_snapshot(mutations.reset_workspace(ws), root, version=0)
    assert read_snapshot(spark, root, 0).tasks.count() == ws.tasks.count()
    assert write_snapshot(ws.replace(tasks=ws.tasks.limit(5)), root, mode_tables=("tasks",)) == 1
    latest = read_snapshot(spark, root)
    assert latest.tasks.count() == 5 and latest.users.count() == ws.users.count()
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, root, 7)


def test_two_writers_of_one_version(spark, monkeypatch):
    import pytest
    from workboard.sources import snapshot
    ws = derive_workspace(spark, SF001)
    root = scratch_path(spark, "snapshot-race")
    assert write_snapshot(ws, root) == 0
    monkeypatch.setattr(snapshot, "_commit_of", lambda *a: None)  # the other commits after the check
    with pytest.raises(snapshot.SnapshotConflict):
        write_snapshot(ws, root, version=0)


def test_jobs_on_text_keys(spark):
    from workboard.sources.workspace import cast_keys
    ws = derive_workspace(spark, SF001)
    text = cast_keys(ws, "string")

    def keyed(df):
        return df.select(*[F.col(c).cast("string") if c.endswith(("_id", "_to", "creator_id")) else F.col(c) for c in df.columns])
    reqs, members = R.project_reqs(spark, SF001), R.project_req_members(spark, SF001)
    pairs = [
        (mutations.create_projects(ws, reqs, members, P.AS_OF, "b"), mutations.create_projects(text, keyed(reqs), keyed(members), P.AS_OF, "b")),
        (mutations.add_project_members(ws, R.link_reqs(spark, SF001)), mutations.add_project_members(text, keyed(R.link_reqs(spark, SF001)))),
        (mutations.create_tasks(ws, R.task_reqs(spark, SF001), P.AS_OF, "b"), mutations.create_tasks(text, keyed(R.task_reqs(spark, SF001)), P.AS_OF, "b")),
        (mutations.delete_members(ws, R.member_delete_reqs(spark, SF001)), mutations.delete_members(text, keyed(R.member_delete_reqs(spark, SF001)))),
        (mutations.delete_projects(ws, R.project_delete_reqs(spark, SF001)), mutations.delete_projects(text, keyed(R.project_delete_reqs(spark, SF001)))),
    ]
    for a, b in pairs:
        assert a.outcomes.exceptAll(b.outcomes).count() == 0 and a.outcomes.count() == b.outcomes.count()
        assert {k: v.count() for k, v in a.tables.items()} == {k: v.count() for k, v in b.tables.items()}


def test_text_ids_differ_by_table_and_batch(spark):
    import pytest
    from workboard.sources.workspace import cast_keys
    users = cast_keys(derive_workspace(spark, SF001), "string").users
    ids = [users.limit(1).select(mutations.new_ids(users, F.lit(1), table, batch).alias("i")).first().i
           for table in ("users", "tasks") for batch in ("a", "b")]
    assert len(set(ids)) == 4
    with pytest.raises(ValueError):
        mutations.new_ids(users, F.lit(1), "users", "")


def test_deleted_members_leave_projects_without_creator(spark, ws01):
    gone = mutations.delete_members(ws01, R.member_delete_reqs(spark, SF01)).tables["projects"]
    before = ws01.projects.where(F.col("created_by").isNull()).count()
    assert gone.where(F.col("created_by").isNull()).count() == before + 5


def test_counters_beyond_int(spark):
    from workboard.functions.status import as_count
    assert spark.range(1).select(as_count(F.lit(3_000_000_000)).alias("n")).first().n == 3_000_000_000


def test_snapshot_layout_prunes(spark):
    ws = derive_workspace(spark, SF01)
    root = scratch_path(spark, "snapshot-layout")
    write_snapshot(ws, root, partitions=4)
    snap = read_snapshot(spark, root)
    page = paging.task_page(snap, P.PROJECT, P.VIEWER_ADMIN, "admin", cursor=P.CURSOR).collect()
    ref = paging.task_page(ws, P.PROJECT, P.VIEWER_ADMIN, "admin", cursor=P.CURSOR).collect()
    assert [r.id for r in page] == [r.id for r in ref]
    import contextlib, io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        snap.tasks.where(F.col("project_id") == 5).explain()
    plan = buf.getvalue()
    assert "PushedFilters: [IsNotNull(project_id), EqualTo(project_id,5)]" in plan
    # rows are range-partitioned on project_id: each file holds a contiguous key range
    import pyarrow.parquet as pq, glob
    files = sorted(glob.glob(f"{root.replace('file:', '')}/data/*/tasks/*.parquet"))
    ranges = [(pq.read_table(f, columns=["project_id"]).column(0).to_pylist()) for f in files]
    lows = [min(r) for r in ranges if r]
    assert lows == sorted(lows)


def test_latest_status_of_a_stream_equals_the_batch(spark, ws01):
    from workboard.streaming import live
    reqs = R.status_reqs(spark, SF01, ws01.tasks)
    board = live.replay(spark, reqs, ws01.tasks, ws01.users, P.AS_OF, files=5, files_per_trigger=1)
    assert board.last()["batch"] >= 4  # several micro-batches, so old statuses come from the state
    latest = board.latest()
    checked = mutations.status_change_outcomes(ws01.tasks, ws01.users, reqs)
    batch = mutations.latest_applied(checked).toDF("task_id", "status")
    streamed = live.status_transitions(checked.where("outcome = 'applied'"), ws01.tasks, P.AS_OF)
    assert board.transitions().exceptAll(streamed).count() == 0 and streamed.count() == board.transitions().count() == 4459
    assert latest.exceptAll(batch).count() == 0 and batch.count() == latest.count() == 150


def test_a_replay_is_landed_and_read_by_many_tasks(spark, ws01):
    """Files in the order of the changes, as many as asked for, and several of them to a micro-batch."""
    import os

    from workboard.session import scratch_path
    from workboard.streaming import live
    reqs, root = R.status_reqs(spark, SF01, ws01.tasks), scratch_path(spark, "live-files")
    board = live.replay(spark, reqs, ws01.tasks, ws01.users, P.AS_OF, root=root, files=6, files_per_trigger=4)
    landing = f"{root}/landing".replace("file:", "")
    files = sorted(n for n in os.listdir(landing) if n.endswith(".parquet"))
    spans = [spark.read.parquet(f"file:{landing}/{n}").agg(F.min("ts"), F.max("ts"), F.count("*")).first() for n in files]
    assert len(files) == 6 and sum(s[2] for s in spans) == reqs.count() and max(s[2] for s in spans) < reqs.count() / 2
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert board.last()["batch"] == 1 and board.log().count() == reqs.count()


def test_micro_batches_and_state_go_by_size_not_by_shuffle_partitions(spark, ws01, monkeypatch):
    """Many shuffle partitions make neither more micro-batches nor more state partitions than the requests and tasks need."""
    import os

    from workboard.session import scratch_path
    from workboard.streaming import live
    key, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before, reqs = spark.conf.get(key), R.status_reqs(spark, SF01, ws01.tasks)
    try:
        spark.conf.set(key, 5 * cores)
        root = scratch_path(spark, "live-size")
        board = live.replay(spark, reqs, ws01.tasks, ws01.users, P.AS_OF, root=root)
        assert spark.conf.get(key) == str(5 * cores)
        assert board.last()["batch"] == 0 and board.log().count() == reqs.count()
        assert len([n for n in os.listdir(f"{root}/board/checkpoint/state/0".replace("file:", "")) if n.isdigit()]) == cores
        spark.conf.set(key, 3)
        monkeypatch.setattr(live, "BYTES_PER_CORE", 1)
        small = live.replay(spark, reqs, ws01.tasks, ws01.users, P.AS_OF)
    finally:
        spark.conf.set(key, before)
    assert small.last()["batch"] == 2  # a file at a time
    assert small.counters().collect() == board.counters().collect()
    assert small.latest().exceptAll(board.latest()).count() == 0


def test_links_stay_dealt_to_as_many_tasks_as_shuffles_have(spark):
    """AQE merges small partitions; those of the links must not grow with the table."""
    from workboard.sources.workspace import derive_project_members
    lineitem = spark.createDataFrame([(i, i % 7) for i in range(400)] * 2, "l_orderkey long, l_suppkey long")
    orders = spark.createDataFrame([(i, i % 11) for i in range(400)], "o_orderkey long, o_custkey long")
    links = derive_project_members(lineitem, orders)
    assert links.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, links.collect())) == sorted({(i % 7, i % 11) for i in range(400)})


def test_member_counters_equal_a_replay(spark, ws01):
    """Counters per assignee by replaying the changes one at a time."""
    from workboard.streaming import live
    checked = mutations.status_change_outcomes(ws01.tasks, ws01.users, R.status_reqs(spark, SF01, ws01.tasks))
    applied = checked.where(F.col("outcome") == "applied")
    tasks = {r.id: r for r in ws01.tasks.collect()}
    base = {}
    for t in tasks.values():
        b = base.setdefault(t.assigned_to, [0, 0, 0])
        b[0] += t.status == "completed"
        b[1] += t.status == "in_progress"
        b[2] += t.status is not None and t.status != "completed" and t.due_date is not None and t.due_date < P.AS_OF
    status, want = {}, {}
    for c in sorted(applied.collect(), key=lambda r: (r.ts, r.seq)):
        t = tasks[c.task_id]
        old, new = status.get(c.task_id, t.status), c.status
        status[c.task_id] = new
        if t.assigned_to is None:
            continue
        w = want.setdefault(t.assigned_to, base[t.assigned_to])
        if old != new:
            for k, s in enumerate(("completed", "in_progress")):
                w[k] = w[k] + 1 if new == s else max(0, w[k] - 1) if old == s else w[k]
            late = old != "completed" and t.due_date is not None and t.due_date < P.AS_OF
            if late and new == "completed":
                w[2] = max(0, w[2] - 1)
    got = {r.user_id: [r.completed_tasks, r.in_progress_tasks, r.overdue_tasks]
           for r in live.member_counters_literal(applied, ws01.tasks, P.AS_OF).collect()}
    assert got == want and len(got) > 100


def test_stream_counters_equal_batch_applied(spark, ws01):
    from workboard.streaming import live
    reqs = R.status_reqs(spark, SF01, ws01.tasks)
    stream = live.run_live_counters(spark, reqs, ws01.tasks, ws01.users, P.AS_OF).first()
    batch = rollups.task_stats(mutations.apply_status_changes(ws01.tasks, ws01.users, reqs).tables["tasks"],
                               P.AS_OF).first()
    assert tuple(stream) == tuple(batch)
    rejected = live.run_rejected_events(spark, reqs, ws01.tasks, ws01.users, P.AS_OF).count()
    assert rejected == 10000 - 4459


def test_a_dead_writer_does_not_block_the_store(spark):
    from workboard.sources.files import write_record
    from workboard.sources.snapshot import latest_version, vacuum
    ws = derive_workspace(spark, SF001)
    root = scratch_path(spark, "snapshot-dead")
    assert write_snapshot(ws, root) == 0
    # one writer died before its commit, another (of an earlier library) in the middle of its record
    ws.tasks.limit(3).write.parquet(f"{root}/data/dead/tasks")
    write_record(spark, f"{root}/_commits/{1:012d}.json", "")
    assert latest_version(spark, root) == 0 and read_snapshot(spark, root).tasks.count() == ws.tasks.count()
    assert write_snapshot(ws.replace(tasks=ws.tasks.limit(5)), root, mode_tables=("tasks",)) == 1
    assert vacuum(spark, root) == []  # nothing is old enough
    reader = read_snapshot(spark, root, 0)
    assert vacuum(spark, root, older_than=0.0) == ["data/dead/tasks"]
    assert reader.tasks.count() == ws.tasks.count() and read_snapshot(spark, root).tasks.count() == 5
    gone = vacuum(spark, root, keep=1, older_than=0.0)  # version 0 goes; the tables that version 1 carries forward stay
    assert sorted(g.split("/")[-1] for g in gone) == [f"{0:012d}.json", "tasks"]
    latest = read_snapshot(spark, root)
    assert latest.tasks.count() == 5 and latest.users.count() == ws.users.count()
    assert write_snapshot(ws, root) == 2


def test_a_page_index_reads_the_parts_of_a_page(spark, ws01):
    from workboard.functions.order import newest_first
    from workboard.operators import paging
    keys = ws01.tasks.select("id", "created_at")
    index = paging.PageIndex.build(keys, scratch_path(spark, "page-index"), partitions=7)
    want = [r.id for r in keys.orderBy(*newest_first()).collect()]
    pages = -(-len(want) // 8)
    assert len(index.parts) == 7 and sum(n for _, n in index.parts) == len(want)
    for page in (-1, 1, 2, pages // 3, pages - 1, pages, pages + 5):
        at = (min(max(page, 1), pages) - 1) * 8
        assert [r.id for r in index.page(keys, page).collect()] == want[at:at + 8]
    files = {f.split("/part=")[1].split("/")[0] for f in index.page(keys, pages // 3).inputFiles() if "/part=" in f}
    assert 1 <= len(files) <= 2
    again = paging.PageIndex(spark, index.path, "id", newest_first())
    assert [r.id for r in again.page(keys, 9, 100).collect()] == want[800:900]
    empty = paging.PageIndex.build(keys.limit(0), scratch_path(spark, "page-index"))
    assert empty.page(keys, 3).count() == 0


def test_numbering_shuffles_the_rows_once(spark, ws01):
    from workboard.operators import board
    plan = board.kanban_board(ws01.tasks)._jdf.queryExecution().executedPlan().toString()
    # what is read back is joined with one row per piece: no window and no sort over the rows
    assert plan.count("Window") <= 2 and "row_number" not in plan


def test_viewers_see_their_classes(spark):
    from workboard.operators import listing
    tasks = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None), (5, 9)], "id long, assigned_to long")
    viewers = spark.createDataFrame([(7, "member"), (8, "viewer"), (9, None), (1, "admin"), (6, "member")], "viewer_id long, role string")
    key = (lambda r: (r[0] is not None, *[x or 0 for x in r]))
    got = sorted(map(tuple, listing.scope_tasks_of_viewers(tasks, viewers).collect()), key=key)
    assert got == [(None, 3, None, 5), (7, 1, 1, 1), (7, 1, 2, 1)]
    strict = sorted(map(tuple, listing.scope_tasks_of_viewers(tasks, viewers, "strict").collect()), key=key)
    assert strict == [(None, 1, None, 5), (7, 1, 1, 1), (7, 1, 2, 1), (8, 1, 3, 1), (9, 1, 5, 1)]
