"""The admin overview bundle over one snapshot."""

from __future__ import annotations

from workboard.operators.listing import overview_tasks
from workboard.operators.rollups import member_rollup, project_rollup, task_counters, task_stats


def overview(ws, as_of) -> dict:
    """stats (D1), counters (D1 as a whole, by status, project and assignee, in one scan), members (D4),
    projects (D6), tasks (C2): lazy plans over one workspace; pass a snapshot read with ``read_snapshot`` for a consistent view."""
    return {
        "stats": task_stats(ws.tasks, as_of),
        "counters": task_counters(ws.tasks, as_of),
        "members": member_rollup(ws.users, ws.project_members, ws.tasks),
        "projects": project_rollup(ws.projects, ws.project_members, ws.users),
        "tasks": overview_tasks(ws),
    }
