"""Small helpers: id lists, member structs, key casts, overview bundle, JSON docs."""

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import SF001
from workboard.operators import listing, mutations
from workboard.plans import params as P
from workboard.plans.overview import overview
from workboard.sources.workspace import cast_keys, derive_workspace


def test_clean_id_list(spark):
    df = spark.createDataFrame([(["a", None, "", "b", "a"],)], "ids array<string>")
    assert sorted(df.select(mutations.clean_id_list(F.col("ids")).alias("x")).first().x) == ["a", "b"]


def test_append_absent(spark):
    base = spark.createDataFrame([(1, 2)], "project_id long, user_id long")
    new = spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "project_id long, user_id long")
    out = mutations.append_absent(base, new, ["project_id", "user_id"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2), (1, 3)]


def test_member_struct_and_removal(spark):
    ws = derive_workspace(spark, SF001)
    arr = (ws.users.where(F.col("id") < 5).agg(F.sort_array(F.collect_list(listing.member_struct())).alias("m")))
    row = arr.select(listing.remove_from_members(F.col("m"), 2).alias("m")).first()
    assert [m.id for m in row.m] == [0, 1, 3, 4]
    assert row.m[0].job_role is not None


def test_cast_keys_to_string(spark):
    ws = cast_keys(derive_workspace(spark, SF001), "string")
    assert dict(ws.tasks.dtypes)["assigned_to"] == "string"
    assert listing.my_tasks(ws, "52", "member").count() == listing.my_tasks(derive_workspace(spark, SF001), 52, "member").count()


def test_any_row_and_detail(spark):
    ws = derive_workspace(spark, SF001)
    assert listing.any_row(ws.users).count() == 1
    d = listing.task_detail(ws, 3).collect()
    assert len(d) <= 1


def test_overview_bundle(spark):
    ws = derive_workspace(spark, SF001)
    o = overview(ws, P.AS_OF)
    assert set(o) == {"stats", "counters", "members", "projects", "tasks"}
    assert o["stats"].count() == 1
    assert o["tasks"].count() == listing.task_listing(ws.tasks, ws.projects, ws.users).count()


def test_null_keys_are_spread_and_the_lookup_side_keeps_its_keys(spark):
    import contextlib
    import io
    ws = derive_workspace(spark, SF001)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            listing.task_listing(ws.tasks, ws.projects, ws.users).explain()
        plan = buf.getvalue()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    smj = [ln for ln in plan.splitlines() if "SortMergeJoin" in ln and "LeftOuter" in ln]
    assert smj and "_lk_0" in smj[0]
    exchanges = [ln for ln in plan.splitlines() if "Exchange hashpartitioning(" in ln]
    assert any("_lk_0" in ln for ln in exchanges) and any("assignee_id" in ln or "id#" in ln for ln in exchanges)


def test_hot_keys_are_split(spark):
    """A third of all tasks on one project and one assignee: NULL keys
    are spread by the row's id, and AQE splits the hot partitions."""
    import contextlib
    import io

    from workboard.sources.workspace import workspace_from_rows
    t0 = dt.datetime(2024, 1, 1)
    users = [(i, f"u{i}", f"u{i}@x", "member", None, False, t0) for i in range(300)]
    projects = [(p, f"p{p}", None, None, t0) for p in range(7)]
    tasks = [(i, 0 if i % 3 == 0 else i % 7, f"t{i}", None, "todo",
              1 if i % 3 == 0 else (None if i % 11 == 0 else i % 300), None, t0) for i in range(30000)]
    ws = workspace_from_rows(spark, users=users, projects=projects, tasks=tasks)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = listing.task_listing(ws.tasks, ws.projects, ws.users)
        assert df.count() == 30000
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        plan = buf.getvalue()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    final = plan.split("isFinalPlan=true")[1]
    outer = [ln for ln in final.splitlines() if "SortMergeJoin" in ln and "LeftOuter" in ln][0]
    assert "_lk_0" in outer and "skew=true" in outer
    assert any("skew=true" in ln and "Inner" in ln for ln in final.splitlines())


def test_cli_writes_json_documents(spark):
    from workboard.__main__ import main
    from workboard.session import scratch_path
    out = scratch_path(spark, "cli-test")
    paths = main(["overview", "--data", SF001, "--out", out, "--as-of", "1998-08-02T00:00:00"], spark=spark)
    assert set(paths) == {"stats", "counters", "members", "projects", "tasks"}
    stats = spark.read.json(paths["stats"]).first()
    assert stats.total_tasks == 1500
    audits = main(["audit", "--data", SF001, "--out", out + "-audit"], spark=spark)
    assert spark.read.json(audits["constraints"]).count() == 27


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    code = "import __spark_entry__ as E; assert set(E.oracle_sql()) <= set(E.queries())"
    root = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd="/", check=True, timeout=120,
                   env={**__import__("os").environ, "PYTHONPATH": root})
