"""Composite keyset paging visits every row once, in PostgreSQL's newest-first order."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from workboard.operators import paging
from workboard.sources.workspace import workspace_from_rows

T0 = dt.datetime(2024, 1, 1)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(days=st.lists(st.one_of(st.none(), st.integers(0, 3)), min_size=0, max_size=30),
       limit=st.integers(1, 7))
def test_pages_cover_in_order(spark, days, limit):
    tasks = [(i, 1, f"t{i}", None, "todo", None, None, None if d is None else T0 + dt.timedelta(days=d))
             for i, d in enumerate(days)]
    ws = workspace_from_rows(spark, projects=[(1, "P", None, None, T0)], tasks=tasks)
    seen, cursor = [], None
    for _ in range(len(days) + 2):
        page = paging.task_page(ws, 1, 0, "admin", cursor=cursor, limit=limit).collect()
        if not page:
            break
        assert len(page) <= limit
        seen += [r.id for r in page]
        cursor = paging.next_cursor(page)
    # PostgreSQL: created_at DESC puts NULLs first; id DESC breaks ties
    want = [i for i, _ in sorted(enumerate(days), key=lambda x: (x[1] is not None, -(x[1] or 0), -x[0]))]
    assert seen == want
