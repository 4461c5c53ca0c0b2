"""The reference's seed workspace (1 admin, 5 members, 1 project, 5 tasks)."""

import datetime as dt

import pytest

from workboard.operators import listing, paging, rollups
from workboard.sources.workspace import workspace_from_rows

T0 = dt.datetime(2024, 1, 1, 9)
AS_OF = dt.datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def seed(spark):
    users = [(1, "Admin", "admin@taskmanager.com", "admin", None, False, T0)] + [
        (1 + i, f"Team Member {i}", f"member{i}@taskmanager.com", "member", "Developer", False,
         T0 + dt.timedelta(minutes=i)) for i in range(1, 6)]
    projects = [(100, "Alpha Project", "Main team project", 1, T0)]
    links = [(100, 1 + i) for i in range(1, 6)]
    tasks = [(1000 + i, 100, f"Task {i} for Team Member {i}", "Please complete this assigned task.", "todo",
              1 + i, None, T0 + dt.timedelta(minutes=10 + i)) for i in range(1, 6)]
    return workspace_from_rows(spark, users=users, projects=projects, project_members=links, tasks=tasks)


def test_stats(seed):
    r = rollups.task_stats(seed.tasks, AS_OF).first()
    assert (r.total_tasks, r.completed_tasks, r.in_progress_tasks, r.overdue_tasks) == (5, 0, 0, 0)


def test_member_rollup_equals_fanout_on_seed(seed):
    a = rollups.member_rollup(seed.users, seed.project_members, seed.tasks).collect()
    b = rollups.member_rollup_fanout(seed.users, seed.project_members, seed.tasks).collect()
    assert a == b
    assert all((r.project_count, r.assigned_task_count, r.completed_task_count) == (1, 1, 0) for r in a)
    assert len(a) == 5


def test_project_rollup(seed):
    r = rollups.project_rollup(seed.projects, seed.project_members, seed.users).first()
    assert r.member_count == 5


def test_first_page(seed):
    page = paging.task_page(seed, 100, 1, "admin").collect()
    assert len(page) == 5
    assert [r.id for r in page] == [1005, 1004, 1003, 1002, 1001]


def test_member_sees_own_tasks_only(seed):
    rows = listing.my_tasks(seed, 3, "member").collect()
    assert [r.id for r in rows] == [1002]
