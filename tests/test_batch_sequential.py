"""Batch jobs equal a one-request-at-a-time simulation of the reference
(random small workspaces and request batches, duplicates and conflicts included)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from workboard.functions.text import JOB_ROLE_LOOKUP, _role_key_py
from workboard.operators import mutations
from workboard.sources.workspace import workspace_from_rows
from tests.test_text_property import js_trim

T0 = dt.datetime(2024, 1, 1)
ROLES = ["admin", "member", None, "manager"]


def users_rows(roles):
    return [(i, f"n{i}", f"u{i}@x.com", r, None, False, T0) for i, r in enumerate(roles)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(roles=st.lists(st.sampled_from(ROLES), min_size=1, max_size=6),
       n_projects=st.integers(0, 3),
       links=st.sets(st.tuples(st.integers(0, 3), st.integers(0, 6)), max_size=6),
       reqs=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 7))),
                     min_size=1, max_size=25))
def test_add_members_sequential(spark, roles, n_projects, links, reqs):
    ws = workspace_from_rows(spark, users=users_rows(roles),
                             projects=[(p, f"p{p}", None, None, T0) for p in range(n_projects)],
                             project_members=sorted(links))
    batch = spark.createDataFrame([(i, p, u) for i, (p, u) in enumerate(reqs)],
                                  "seq long, project_id long, user_id long")
    got = {r.seq: r.outcome for r in mutations.add_project_members(ws, batch).outcomes.collect()}
    members = {i for i, r in enumerate(roles) if r == "member"}
    linked = set(links)
    want = {}
    for i, (p, u) in enumerate(reqs):  # the reference handles requests one by one
        if u is None:
            want[i] = "missing_user"
        elif u not in members:
            want[i] = "not_member"
        elif p is None or p >= n_projects:
            want[i] = "project_not_found"
        elif (p, u) in linked:
            want[i] = "already_member"
        else:
            linked.add((p, u))
            want[i] = "inserted"
    assert got == want


names = st.sampled_from(["", " ", "\t", "Ann", " Bo "])
emails = st.sampled_from([None, "", "no-at", "a@x.com", " A@X.com ", "u1@x.com", "U2@x.com"])
jobs = st.sampled_from([None, "", "qa engineer", " QA-Engineer ", "astronaut", "Team Member"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(reqs=st.lists(st.tuples(names, emails, jobs), min_size=1, max_size=25))
def test_onboarding_sequential(spark, reqs):
    users = users_rows(["admin", "member", "member"])
    batch = spark.createDataFrame([(i, n, e, j) for i, (n, e, j) in enumerate(reqs)],
                                  "seq long, name string, email string, job_role string")
    got = {r.seq: r.outcome for r in mutations.onboard_members(
        workspace_from_rows(spark, users=users).users, batch, T0, "b").outcomes.collect()}
    known = {u[2] for u in users}
    want = {}
    for i, (n, e, j) in enumerate(reqs):
        if n is None or js_trim(n) == "":
            want[i] = "invalid_name"
        elif not e or "@" not in e:
            want[i] = "invalid_email"
        elif j is None or JOB_ROLE_LOOKUP.get(_role_key_py(js_trim(j))) is None:
            want[i] = "invalid_job_role"
        elif js_trim(e.lower()) in known:
            want[i] = "duplicate"
        else:
            known.add(js_trim(e.lower()))
            want[i] = "inserted"
    assert got == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(roles=st.lists(st.sampled_from(ROLES), min_size=1, max_size=6),
       reqs=st.lists(st.integers(0, 7), min_size=1, max_size=20))
def test_member_deletes_sequential(spark, roles, reqs):
    ws = workspace_from_rows(spark, users=users_rows(roles),
                             projects=[(0, "p", None, 1, T0)],
                             tasks=[(10 + i, 0, "t", None, "todo", i, None, T0) for i in range(len(roles))])
    batch = spark.createDataFrame(list(enumerate(reqs)), "seq long, user_id long")
    res = mutations.delete_members(ws, batch)
    got = {r.seq: r.outcome for r in res.outcomes.collect()}
    present = {i: r for i, r in enumerate(roles)}
    want = {}
    for i, u in enumerate(reqs):
        if u not in present:
            want[i] = "not_found"
        elif present[u] != "member":
            want[i] = "not_member"
        else:
            del present[u]
            want[i] = "deleted"
    assert got == want
    assert sorted(r.id for r in res.tables["users"].collect()) == sorted(present)
    assert sorted(r.assigned_to for r in res.tables["tasks"].collect()) == sorted(present)
