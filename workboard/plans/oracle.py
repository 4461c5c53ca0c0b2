"""Independent SQL (DuckDB dialect) for every registered query.

Each statement starts from the driver tables through the shared ``WITH``
block below (the FIXTURES.md mapping), written as plain SQL rather than
generated from the Spark code.
"""

from __future__ import annotations

from workboard.plans.params import (AS_OF_SQL, CURSOR, CURSOR_SQL, EMAIL, OFFSET_PAGE, PAGE_SIZE, PAGE_VIEWER,
                                    PROJECT, PROJECT_CURSOR, PROJECT_CURSOR_SQL, PROJECT_LIMIT,
                                    TASK_ID, TASK_LIMIT, VIEWER_MEMBER)


# Fixed values, spelled out here so that an error in the library's own does not agree with itself:
# the white space of ECMAScript trim() and the job roles by their lookup key.
SPACE = (r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")
ROLES = {
    "full stack developer": "Full Stack Developer",
    "frontend developer": "Frontend Developer",
    "backend developer": "Backend Developer",
    "qa engineer": "QA Engineer",
    "ui ux designer": "UI/UX Designer",
    "devops engineer": "DevOps Engineer",
    "product manager": "Product Manager",
    "business analyst": "Business Analyst",
    "support engineer": "Support Engineer",
    "team member": "Team Member",
}


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+\\z', '', 'g')"


def blank(x: str) -> str:
    return f"coalesce({js_trim(x)} = '', true)"


def role_norm(x: str) -> str:
    key = f"regexp_replace(lower({js_trim(x)}), '[^a-z0-9]+', ' ', 'g')"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items())
    return f"(CASE {key} {whens} END)"


VIEWS = """
users AS (
  SELECT c_custkey AS id,
         concat(c_mktsegment, ' ', CAST(c_custkey % 700 AS VARCHAR)) AS name,
         concat(lower(c_name), '@example.com') AS email,
         CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'member' END AS role,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS job_role,
         c_custkey % 3 = 0 AS is_first_login,
         CAST(DATE '1995-01-01' + CAST(c_custkey % 365 AS INT) AS TIMESTAMP) AS created_at
  FROM customer),
projects AS (
  SELECT s_suppkey AS id, s_name AS name,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat('nation ', CAST(s_nationkey AS VARCHAR)) END AS description,
         CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 2 = 1 THEN s_suppkey ELSE (s_suppkey % 3) * 50 END AS created_by,
         CAST(DATE '1995-01-01' + CAST(s_suppkey % 90 AS INT) AS TIMESTAMP) AS created_at
  FROM supplier),
project_members AS (
  SELECT DISTINCT l_suppkey AS project_id, o_custkey AS user_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tasks AS (
  SELECT o_orderkey AS id,
         CAST(o_orderkey % (SELECT CAST(floor(count(*) * 1.1) AS BIGINT) FROM supplier) AS BIGINT) AS project_id,
         concat('Task ', CAST(o_orderkey AS VARCHAR)) AS title,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS description,
         CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 307 = 0 THEN 'blocked'
              WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'in_progress'
              ELSE 'todo' END AS status,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_custkey + 10000000
              ELSE o_custkey END AS assigned_to,
         CASE o_orderpriority WHEN '1-URGENT' THEN o_orderdate + INTERVAL 7 DAY
              WHEN '2-HIGH' THEN o_orderdate + INTERVAL 14 DAY WHEN '3-MEDIUM' THEN o_orderdate + INTERVAL 30 DAY
              WHEN '5-LOW' THEN o_orderdate + INTERVAL 90 DAY END AS due_date,
         CAST(o_orderdate AS TIMESTAMP) AS created_at
  FROM orders),
listing AS (
  SELECT t.id, t.title, t.description, t.status, t.due_date, t.created_at, t.project_id,
         p.name AS project_name, u.id AS assignee_id, u.name AS assignee_name, u.email AS assignee_email,
         COALESCE(u.job_role, 'Team Member') AS assignee_job_role
  FROM tasks t JOIN projects p ON p.id = t.project_id LEFT JOIN users u ON u.id = t.assigned_to)
"""

REQUEST_VIEWS = f"""
onboard_reqs AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_partkey % 10 = 0 THEN '   ' ELSE concat(' ', p_name, ' ') END AS name,
         CASE WHEN p_partkey % 7 = 0 THEN 'no-at-sign'
              WHEN p_partkey % 5 = 0 THEN concat(' CUSTOMER#', lpad(CAST(p_partkey % 50 AS VARCHAR), 9, '0'), '@EXAMPLE.COM ')
              ELSE concat('New', CAST(p_partkey // 3 AS VARCHAR), '@Example.com') END AS email,
         CASE p_partkey % 4 WHEN 0 THEN 'qa  engineer' WHEN 1 THEN 'UI/UX designer' WHEN 2 THEN 'Astronaut'
              ELSE ' DevOps-Engineer' END AS job_role
  FROM part),
link_reqs AS (
  SELECT o_orderkey AS seq,
         o_orderkey % (SELECT count(*) + 1 FROM supplier) AS project_id,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 8 = 0 THEN o_custkey + 10000000
              ELSE o_custkey END AS user_id
  FROM orders),
task_reqs AS (
  SELECT o_orderkey AS seq,
         l_suppkey + CASE WHEN o_orderkey % 23 = 0 THEN 10000000 ELSE 0 END AS project_id,
         CASE WHEN o_orderkey % 10 = 0 THEN '  ' ELSE concat(' Do ', CAST(o_orderkey AS VARCHAR), ' ') END AS title,
         CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE ' note ' END AS description,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN o_custkey + 1
              ELSE o_custkey END AS assigned_to
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey) l
       ON l_orderkey = o_orderkey),
status_reqs AS (
  SELECT e.event_id AS seq, CAST(e.ts AS TIMESTAMP) AS ts,
         CASE WHEN e.event_type = 'signup' THEN e.user_id + 1000000000 ELSE e.user_id END AS task_id,
         CASE e.event_type WHEN 'view' THEN 'todo' WHEN 'click' THEN 'in_progress' WHEN 'error' THEN 'done'
              ELSE 'completed' END AS status,
         CASE WHEN e.event_id % 4 = 0 THEN 0 WHEN e.event_id % 4 = 1 THEN 52 ELSE t.assigned_to END AS requester_id
  FROM events e LEFT JOIN tasks t ON t.id = e.user_id),
status_checked AS (
  SELECT r.*,
         CASE WHEN r.status IS NULL OR r.status NOT IN ('todo', 'in_progress', 'completed') THEN 'invalid_status'
              WHEN t.id IS NULL THEN 'not_found'
              WHEN u.role = 'member' AND t.assigned_to IS DISTINCT FROM r.requester_id THEN 'forbidden'
              ELSE 'applied' END AS outcome
  FROM status_reqs r LEFT JOIN tasks t ON t.id = r.task_id LEFT JOIN users u ON u.id = r.requester_id),
applied_tasks AS (
  SELECT t.id, t.project_id, t.title, t.description,
         COALESCE((SELECT c.status FROM status_checked c WHERE c.task_id = t.id AND c.outcome = 'applied'
                   ORDER BY c.ts DESC, c.seq DESC LIMIT 1), t.status) AS status,
         t.assigned_to, t.due_date, t.created_at
  FROM tasks t),
project_reqs AS (
  SELECT s_suppkey AS seq,
         CASE WHEN s_suppkey % 9 = 0 THEN '  ' ELSE concat(' New ', s_name) END AS name,
         CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' about ' END AS description,
         50 AS creator_id
  FROM supplier),
project_req_members AS (
  SELECT c_custkey % (SELECT count(*) FROM supplier) AS seq,
         CASE WHEN c_custkey % 97 = 0 THEN c_custkey + 10000000 WHEN c_custkey % 50 = 0 THEN c_custkey - 1
              ELSE c_custkey END AS user_id
  FROM customer
  UNION ALL
  SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_suppkey % 40 + 1 END FROM supplier),
member_delete_reqs AS (
  SELECT c_custkey AS seq, CASE WHEN c_custkey % 9 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS user_id
  FROM customer WHERE c_acctbal < 0),
project_delete_reqs AS (
  SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey + 10000000 ELSE s_suppkey END AS project_id
  FROM supplier WHERE s_acctbal < 0)
"""

HTTP = """CASE outcome WHEN 'duplicate' THEN 409 WHEN 'project_not_found' THEN 404 WHEN 'not_found' THEN 404
  WHEN 'forbidden' THEN 403 WHEN 'inserted' THEN 201 WHEN 'applied' THEN 200 WHEN 'deleted' THEN 200 ELSE 400 END"""


def _with(body: str, requests: bool = False) -> str:
    views = VIEWS.strip() + ("," + REQUEST_VIEWS.rstrip() if requests else "")
    return f"WITH {views}\n{body.strip()}"


def _stats(src: str) -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS total_tasks,
       CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS completed_tasks,
       CAST(count(*) FILTER (WHERE status = 'in_progress') AS BIGINT) AS in_progress_tasks,
       CAST(count(*) FILTER (WHERE status <> 'completed' AND due_date IS NOT NULL AND due_date < {AS_OF_SQL}) AS BIGINT) AS overdue_tasks
FROM {src}"""


LISTING_COLS = ("id, title, description, status, due_date, created_at, project_id, project_name, "
                "assignee_id, assignee_name, assignee_email")
PAGE_COLS = ("id, title, description, status, due_date, created_at, project_name, "
             "assignee_id, assignee_name, assignee_email")
OVERVIEW_COLS = ("id, title, description, status, due_date, created_at, project_id, project_name, "
                 "assignee_id, assignee_name, assignee_job_role")
NEWEST = "ORDER BY created_at DESC NULLS FIRST, id DESC"


def _board(src: str, order: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY project_id, status ORDER BY {order}) AS lane_position,
       count(*) OVER (PARTITION BY project_id, status) AS lane_size
FROM ({src}) b WHERE status IN ('todo', 'in_progress', 'completed')"""


def _outcome_select(src: str) -> str:
    return f"SELECT CAST(seq AS BIGINT) AS seq, outcome, CAST({HTTP} AS INT) AS http_status FROM {src}"


ONBOARD_CHECKED = f"""(
  SELECT r.seq,
         CASE WHEN {blank('r.name')} THEN 'invalid_name'
              WHEN NOT coalesce(contains(r.email, '@'), false) THEN 'invalid_email'
              WHEN {role_norm('r.job_role')} IS NULL THEN 'invalid_job_role'
              WHEN EXISTS (SELECT 1 FROM users u WHERE u.email = {js_trim('lower(r.email)')}) THEN 'duplicate'
              WHEN EXISTS (SELECT 1 FROM onboard_reqs e
                           WHERE e.seq < r.seq AND {js_trim('lower(e.email)')} = {js_trim('lower(r.email)')}
                             AND NOT {blank('e.name')} AND coalesce(contains(e.email, '@'), false)
                             AND {role_norm('e.job_role')} IS NOT NULL) THEN 'duplicate'
              ELSE 'inserted' END AS outcome
  FROM onboard_reqs r)"""

PROJECTS_CHECKED = """(
  SELECT r.seq,
         CASE WHEN """ + blank("r.name") + """ THEN 'invalid_name'
              WHEN EXISTS (SELECT 1 FROM project_req_members m
                           WHERE m.seq = r.seq AND m.user_id IS NOT NULL
                             AND m.user_id NOT IN (SELECT id FROM users WHERE role = 'member')) THEN 'invalid_member'
              ELSE 'inserted' END AS outcome
  FROM project_reqs r)"""

LINKS_CHECKED = """(
  SELECT r.seq,
         CASE WHEN r.user_id IS NULL THEN 'missing_user'
              WHEN r.user_id NOT IN (SELECT id FROM users WHERE role = 'member') THEN 'not_member'
              WHEN r.project_id NOT IN (SELECT id FROM projects) THEN 'project_not_found'
              WHEN EXISTS (SELECT 1 FROM project_members pm WHERE pm.project_id = r.project_id AND pm.user_id = r.user_id) THEN 'already_member'
              WHEN EXISTS (SELECT 1 FROM link_reqs e WHERE e.seq < r.seq AND e.project_id = r.project_id AND e.user_id = r.user_id
                           AND e.user_id IN (SELECT id FROM users WHERE role = 'member')
                           AND e.project_id IN (SELECT id FROM projects)) THEN 'already_member'
              ELSE 'inserted' END AS outcome
  FROM link_reqs r)"""

TASKS_CHECKED = """(
  SELECT r.seq,
         CASE WHEN """ + blank("r.title") + """ THEN 'invalid_title'
              WHEN r.assigned_to IS NULL THEN 'missing_assignee'
              WHEN r.project_id NOT IN (SELECT id FROM projects) THEN 'project_not_found'
              WHEN NOT EXISTS (SELECT 1 FROM project_members pm JOIN users u ON u.id = pm.user_id
                               WHERE pm.project_id = r.project_id AND pm.user_id = r.assigned_to AND u.role = 'member') THEN 'not_project_member'
              ELSE 'inserted' END AS outcome
  FROM task_reqs r)"""

MEMBER_DELETES_CHECKED = """(
  SELECT r.seq,
         CASE WHEN u.id IS NULL THEN 'not_found'
              WHEN u.role IS DISTINCT FROM 'member' THEN 'not_member'
              WHEN r.seq = (SELECT min(e.seq) FROM member_delete_reqs e WHERE e.user_id = r.user_id) THEN 'deleted'
              ELSE 'not_found' END AS outcome
  FROM member_delete_reqs r LEFT JOIN users u ON u.id = r.user_id)"""


ORACLE = {
    "task_stats": _with(_stats("tasks")),
    "task_stats_member": _with(_stats(f"tasks WHERE assigned_to = {VIEWER_MEMBER}")),
    "task_stats_by_member": _with(f"""
SELECT u.id AS user_id, CAST(count(t.id) AS BIGINT) AS total_tasks,
       CAST(count(t.id) FILTER (WHERE t.status = 'completed') AS BIGINT) AS completed_tasks,
       CAST(count(t.id) FILTER (WHERE t.status = 'in_progress') AS BIGINT) AS in_progress_tasks,
       CAST(count(t.id) FILTER (WHERE t.status <> 'completed' AND t.due_date IS NOT NULL AND t.due_date < {AS_OF_SQL}) AS BIGINT) AS overdue_tasks
FROM users u LEFT JOIN tasks t ON t.assigned_to = u.id GROUP BY u.id"""),
    "task_stats_by_viewer": _with(f"""
SELECT u.id AS viewer_id, u.role, CAST(count(t.id) AS BIGINT) AS total_tasks,
       count(t.id) FILTER (WHERE t.status = 'completed') AS completed_tasks,
       count(t.id) FILTER (WHERE t.status = 'in_progress') AS in_progress_tasks,
       count(t.id) FILTER (WHERE t.status <> 'completed' AND t.due_date IS NOT NULL AND t.due_date < {AS_OF_SQL}) AS overdue_tasks
FROM users u LEFT JOIN tasks t ON t.assigned_to = u.id OR u.role = 'admin' GROUP BY u.id, u.role"""),
    "tasks_per_member_name": _with("""
SELECT u.name AS member_name, CAST(sum(n.tasks) AS BIGINT) AS total
FROM (SELECT assigned_to, count(*) AS tasks FROM tasks GROUP BY assigned_to) n JOIN users u ON u.id = n.assigned_to
GROUP BY u.name"""),
    "status_distribution": _with("SELECT status, count(*) AS task_count FROM tasks GROUP BY status"),
    "member_directory": _with("""
SELECT id, name, email, COALESCE(job_role, 'Team Member') AS job_role, created_at
FROM users WHERE role = 'member' ORDER BY created_at DESC, id DESC"""),
    "user_by_email": _with(f"SELECT * FROM users WHERE email = '{EMAIL}'"),
    "my_tasks_member": _with(f"SELECT {LISTING_COLS} FROM listing WHERE assignee_id = {VIEWER_MEMBER} {NEWEST}"),
    "my_tasks_admin": _with(f"SELECT {LISTING_COLS} FROM listing {NEWEST}"),
    "task_page_first": _with(f"SELECT {PAGE_COLS} FROM listing WHERE project_id = {PROJECT} {NEWEST} LIMIT {TASK_LIMIT}"),
    "task_page_next": _with(f"""
SELECT {PAGE_COLS} FROM listing WHERE project_id = {PROJECT}
  AND (created_at < {CURSOR_SQL} OR (created_at = {CURSOR_SQL} AND id < {CURSOR[1]}))
{NEWEST} LIMIT {TASK_LIMIT}"""),
    "task_page_ts_cursor": _with(f"""
SELECT {PAGE_COLS} FROM listing WHERE project_id = {PROJECT} AND created_at < {CURSOR_SQL}
{NEWEST} LIMIT {TASK_LIMIT}"""),
    "task_page_member": _with(f"""
SELECT {PAGE_COLS} FROM listing WHERE project_id = {PROJECT} AND assignee_id = {PAGE_VIEWER}
{NEWEST} LIMIT {TASK_LIMIT}"""),
    "project_page_member": _with(f"""
SELECT id, name, description, created_by, created_at FROM projects
WHERE created_by = {VIEWER_MEMBER} OR id IN (SELECT project_id FROM project_members WHERE user_id = {VIEWER_MEMBER})
{NEWEST} LIMIT {PROJECT_LIMIT}"""),
    "project_page_admin": _with(f"SELECT id, name, description, created_by, created_at FROM projects {NEWEST} LIMIT {PROJECT_LIMIT}"),
    "project_page_next": _with(f"""
SELECT id, name, description, created_by, created_at FROM projects
WHERE created_at < {PROJECT_CURSOR_SQL} OR (created_at = {PROJECT_CURSOR_SQL} AND id < {PROJECT_CURSOR[1]})
{NEWEST} LIMIT {PROJECT_LIMIT}"""),
    "visible_projects": _with(f"""
SELECT id, name, description, created_by, created_at FROM projects
WHERE created_by = {VIEWER_MEMBER} OR id IN (SELECT project_id FROM project_members WHERE user_id = {VIEWER_MEMBER})"""),
    "project_members_list": _with(f"""
SELECT id, name, email, role, COALESCE(job_role, 'Team Member') AS job_role FROM users
WHERE role = 'member' AND id IN (SELECT user_id FROM project_members WHERE project_id = {PROJECT}) ORDER BY name, id"""),
    "available_members": _with(f"""
SELECT id, name, email, COALESCE(job_role, 'Team Member') AS job_role FROM users
WHERE role = 'member' AND id NOT IN (SELECT user_id FROM project_members WHERE project_id = {PROJECT})"""),
    "available_member_counts": _with("""
SELECT p.id AS project_id,
       CAST((SELECT count(*) FROM users WHERE role = 'member')
            - (SELECT count(DISTINCT pm.user_id) FROM project_members pm JOIN users u ON u.id = pm.user_id
               WHERE u.role = 'member' AND pm.project_id = p.id) AS BIGINT) AS available_count
FROM projects p"""),
    "valid_member_ids": _with("""
SELECT DISTINCT m.seq, m.user_id FROM project_req_members m JOIN users u ON u.id = m.user_id
WHERE u.role = 'member' AND m.user_id IS NOT NULL""", requests=True),
    "task_detail": _with(f"SELECT {LISTING_COLS} FROM listing WHERE id = {TASK_ID}"),
    "member_rollup": _with("""
SELECT u.id, u.name, u.email, COALESCE(u.job_role, 'Team Member') AS job_role, u.created_at,
       CAST((SELECT count(DISTINCT pm.project_id) FROM project_members pm WHERE pm.user_id = u.id) AS BIGINT) AS project_count,
       CAST((SELECT count(t.id) FROM tasks t WHERE t.assigned_to = u.id) AS BIGINT) AS assigned_task_count,
       CAST((SELECT count(t.id) FROM tasks t WHERE t.assigned_to = u.id AND t.status = 'completed') AS BIGINT) AS completed_task_count
FROM users u WHERE u.role = 'member' ORDER BY u.created_at DESC, u.id DESC"""),
    "member_rollup_fanout": _with("""
SELECT u.id, u.name, u.email, COALESCE(u.job_role, 'Team Member') AS job_role, u.created_at,
       CAST(COALESCE(l.projects, 0) AS BIGINT) AS project_count,
       CAST(greatest(COALESCE(l.links, 0), 1) * COALESCE(n.tasks, 0) AS BIGINT) AS assigned_task_count,
       CAST(greatest(COALESCE(l.links, 0), 1) * COALESCE(n.done, 0) AS BIGINT) AS completed_task_count
FROM users u
LEFT JOIN (SELECT user_id, count(*) AS links, count(DISTINCT project_id) AS projects FROM project_members GROUP BY user_id) l
       ON l.user_id = u.id
LEFT JOIN (SELECT assigned_to, count(*) AS tasks, count(*) FILTER (WHERE status = 'completed') AS done
           FROM tasks GROUP BY assigned_to) n ON n.assigned_to = u.id
WHERE u.role = 'member'"""),
    "project_rollup": _with("""
SELECT p.id, p.name, p.description, p.created_at, CAST(COALESCE(m.members, 0) AS BIGINT) AS member_count
FROM projects p
LEFT JOIN (SELECT project_id, count(DISTINCT user_id) AS members FROM project_members
           WHERE user_id IN (SELECT id FROM users WHERE role = 'member') GROUP BY project_id) m ON m.project_id = p.id"""),
    "project_roster_long": _with("""
SELECT DISTINCT pm.project_id, u.id AS member_id, u.name AS member_name, u.email AS member_email,
       u.role AS member_role, COALESCE(u.job_role, 'Team Member') AS member_job_role
FROM projects p JOIN project_members pm ON pm.project_id = p.id JOIN users u ON u.id = pm.user_id
WHERE u.role = 'member'"""),
    "overview_tasks": _with(f"SELECT {OVERVIEW_COLS} FROM listing {NEWEST}"),
    "board_counts": _with("""
SELECT project_id, count(*) FILTER (WHERE status = 'todo') AS todo_count,
       count(*) FILTER (WHERE status = 'in_progress') AS in_progress_count,
       count(*) FILTER (WHERE status = 'completed') AS completed_count
FROM tasks WHERE project_id IN (SELECT id FROM projects) GROUP BY project_id"""),
    "kanban_board": _with(_board(f"SELECT {LISTING_COLS} FROM listing", "created_at DESC, id DESC")),
    "kanban_board_due": _with(_board(f"SELECT {LISTING_COLS} FROM listing",
                                     "due_date ASC NULLS LAST, created_at DESC, id DESC")),
    "kanban_newest50": _with(_board(f"""
SELECT {LISTING_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS FIRST, id DESC) AS rn
                            FROM listing) x WHERE rn <= {TASK_LIMIT}""", "created_at DESC, id DESC")),
    "offset_page": _with(f"SELECT {OVERVIEW_COLS} FROM listing {NEWEST} LIMIT {PAGE_SIZE} OFFSET {(OFFSET_PAGE - 1) * PAGE_SIZE}"),
    "assign_pages": _with(f"""
SELECT {OVERVIEW_COLS}, row_number() OVER ({NEWEST}) AS row_number,
       (row_number() OVER ({NEWEST}) - 1) // {PAGE_SIZE} + 1 AS page
FROM listing"""),
    "today_backlog": _with(f"""
SELECT {LISTING_COLS}, CASE WHEN CAST(created_at AS DATE) = CAST({AS_OF_SQL} AS DATE) THEN 'today' ELSE 'backlog' END AS bucket
FROM listing"""),
    "task_cards": _with(f"""
SELECT id, status, overdue,
       COALESCE(CASE status WHEN 'todo' THEN 'To Do' WHEN 'in_progress' THEN 'In Progress' WHEN 'completed' THEN 'Completed' END, status) AS status_label,
       CASE WHEN overdue THEN 'Overdue' ELSE COALESCE(CASE status WHEN 'todo' THEN 'To Do' WHEN 'in_progress' THEN 'In Progress' WHEN 'completed' THEN 'Completed' END, status) END AS badge_text,
       CASE WHEN overdue THEN 'danger' WHEN status = 'completed' THEN 'success' WHEN status = 'in_progress' THEN 'primary' ELSE 'neutral' END AS status_tone,
       CASE status WHEN 'todo' THEN 'Start Task' WHEN 'in_progress' THEN 'Mark Complete' END AS next_action,
       CASE status WHEN 'todo' THEN 'in_progress' WHEN 'in_progress' THEN 'completed' END AS next_status,
       COALESCE(strftime(due_date, '%d %b %Y'), 'Flexible') AS due_text,
       COALESCE(NULLIF(description, ''), 'No description provided for this task.') AS description_text,
       COALESCE(NULLIF(assignee_name, ''), 'Unassigned') AS assignee_text
FROM (SELECT *, (status IS DISTINCT FROM 'completed') AND due_date IS NOT NULL AND due_date < {AS_OF_SQL} AS overdue
      FROM listing) x"""),
    "job_role_normalise": _with(f"""
SELECT seq, regexp_replace(lower({js_trim('job_role')}), '[^a-z0-9]+', ' ', 'g') AS job_role_key,
       {role_norm('job_role')} AS job_role_canonical,
       {blank('name')} AS name_blank,
       coalesce(contains(email, '@'), false) AS email_valid,
       {js_trim('lower(email)')} AS email_normalised
FROM onboard_reqs""", requests=True),
    "orphan_audit": _with("""
SELECT 'tasks_missing_project' AS check_name, count(*) AS violations FROM tasks WHERE project_id IS NOT NULL AND project_id NOT IN (SELECT id FROM projects)
UNION ALL SELECT 'tasks_dangling_assignee', count(*) FROM tasks WHERE assigned_to IS NOT NULL AND assigned_to NOT IN (SELECT id FROM users)
UNION ALL SELECT 'tasks_unassigned', count(*) FROM tasks WHERE assigned_to IS NULL
UNION ALL SELECT 'links_missing_project', count(*) FROM project_members WHERE project_id NOT IN (SELECT id FROM projects)
UNION ALL SELECT 'links_missing_user', count(*) FROM project_members WHERE user_id NOT IN (SELECT id FROM users)
UNION ALL SELECT 'projects_missing_creator', count(*) FROM projects WHERE created_by IS NOT NULL AND created_by NOT IN (SELECT id FROM users)"""),
    "constraint_audit": _with("""
SELECT 'users' AS table_name, 'not_null_id' AS rule, count(*) FILTER (WHERE id IS NULL) AS violations FROM users
UNION ALL SELECT 'users', 'not_null_name', count(*) FILTER (WHERE name IS NULL) FROM users
UNION ALL SELECT 'users', 'not_null_email', count(*) FILTER (WHERE email IS NULL) FROM users
UNION ALL SELECT 'users', 'check_role', count(*) FILTER (WHERE role NOT IN ('admin', 'member')) FROM users
UNION ALL SELECT 'users', 'length_name', count(*) FILTER (WHERE length(name) > 255) FROM users
UNION ALL SELECT 'users', 'length_email', count(*) FILTER (WHERE length(email) > 255) FROM users
UNION ALL SELECT 'users', 'length_role', count(*) FILTER (WHERE length(role) > 50) FROM users
UNION ALL SELECT 'users', 'length_job_role', count(*) FILTER (WHERE length(job_role) > 100) FROM users
UNION ALL SELECT 'users', 'primary_key', (SELECT count(*) FROM (SELECT id FROM users WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1))
UNION ALL SELECT 'users', 'unique_email', (SELECT count(*) FROM (SELECT email FROM users WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1))
UNION ALL SELECT 'projects', 'not_null_id', count(*) FILTER (WHERE id IS NULL) FROM projects
UNION ALL SELECT 'projects', 'not_null_name', count(*) FILTER (WHERE name IS NULL) FROM projects
UNION ALL SELECT 'projects', 'length_name', count(*) FILTER (WHERE length(name) > 255) FROM projects
UNION ALL SELECT 'projects', 'fk_created_by', count(*) FILTER (WHERE created_by IS NOT NULL AND created_by NOT IN (SELECT id FROM users)) FROM projects
UNION ALL SELECT 'projects', 'primary_key', (SELECT count(*) FROM (SELECT id FROM projects WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1))
UNION ALL SELECT 'project_members', 'not_null_key', count(*) FILTER (WHERE project_id IS NULL OR user_id IS NULL) FROM project_members
UNION ALL SELECT 'project_members', 'fk_project', count(*) FILTER (WHERE project_id NOT IN (SELECT id FROM projects)) FROM project_members
UNION ALL SELECT 'project_members', 'fk_user', count(*) FILTER (WHERE user_id NOT IN (SELECT id FROM users)) FROM project_members
UNION ALL SELECT 'project_members', 'primary_key', (SELECT count(*) FROM (SELECT project_id, user_id FROM project_members WHERE project_id IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'tasks', 'not_null_id', count(*) FILTER (WHERE id IS NULL) FROM tasks
UNION ALL SELECT 'tasks', 'not_null_title', count(*) FILTER (WHERE title IS NULL) FROM tasks
UNION ALL SELECT 'tasks', 'check_status', count(*) FILTER (WHERE status NOT IN ('todo', 'in_progress', 'completed')) FROM tasks
UNION ALL SELECT 'tasks', 'length_title', count(*) FILTER (WHERE length(title) > 255) FROM tasks
UNION ALL SELECT 'tasks', 'length_status', count(*) FILTER (WHERE length(status) > 50) FROM tasks
UNION ALL SELECT 'tasks', 'fk_project', count(*) FILTER (WHERE project_id IS NOT NULL AND project_id NOT IN (SELECT id FROM projects)) FROM tasks
UNION ALL SELECT 'tasks', 'fk_assigned_to', count(*) FILTER (WHERE assigned_to IS NOT NULL AND assigned_to NOT IN (SELECT id FROM users)) FROM tasks
UNION ALL SELECT 'tasks', 'primary_key', (SELECT count(*) FROM (SELECT id FROM tasks WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1))"""),
    "onboard_members": _with(_outcome_select(ONBOARD_CHECKED), requests=True),
    "create_projects": _with(_outcome_select(PROJECTS_CHECKED), requests=True),
    "add_project_members": _with(_outcome_select(LINKS_CHECKED), requests=True),
    "create_tasks": _with(_outcome_select(TASKS_CHECKED), requests=True),
    "apply_status_changes": _with(_outcome_select("status_checked"), requests=True),
    "status_after_changes": _with(_stats("applied_tasks"), requests=True),
    "delete_members": _with(_outcome_select(MEMBER_DELETES_CHECKED), requests=True),
    "workspace_after_member_deletes": _with("""
SELECT 'users' AS table_name, count(*) AS row_count FROM users
  WHERE id NOT IN (SELECT user_id FROM member_delete_reqs d JOIN users u ON u.id = d.user_id WHERE u.role = 'member')
UNION ALL SELECT 'tasks', count(*) FROM tasks
  WHERE assigned_to IS NULL OR assigned_to NOT IN (SELECT user_id FROM member_delete_reqs d JOIN users u ON u.id = d.user_id WHERE u.role = 'member')
UNION ALL SELECT 'project_members', count(*) FROM project_members
  WHERE user_id NOT IN (SELECT user_id FROM member_delete_reqs d JOIN users u ON u.id = d.user_id WHERE u.role = 'member')
UNION ALL SELECT 'projects_without_creator', count(*) FROM projects
  WHERE created_by IS NULL OR created_by IN (SELECT user_id FROM member_delete_reqs d JOIN users u ON u.id = d.user_id WHERE u.role = 'member')""", requests=True),
    "delete_projects": _with(_outcome_select("""(
  SELECT r.seq,
         CASE WHEN r.project_id IN (SELECT id FROM projects)
                   AND r.seq = (SELECT min(e.seq) FROM project_delete_reqs e WHERE e.project_id = r.project_id) THEN 'deleted'
              ELSE 'not_found' END AS outcome
  FROM project_delete_reqs r)"""), requests=True),
    "workspace_after_project_deletes": _with("""
SELECT 'projects' AS table_name, count(*) AS row_count FROM projects WHERE id NOT IN (SELECT project_id FROM project_delete_reqs)
UNION ALL SELECT 'project_members', count(*) FROM project_members WHERE project_id NOT IN (SELECT project_id FROM project_delete_reqs WHERE project_id IN (SELECT id FROM projects))
UNION ALL SELECT 'tasks', count(*) FROM tasks WHERE project_id IS NULL OR project_id NOT IN (SELECT project_id FROM project_delete_reqs WHERE project_id IN (SELECT id FROM projects))""", requests=True),
    "reset_workspace": _with("SELECT * FROM users WHERE role IS DISTINCT FROM 'member'"),
    "status_transitions": _with(f"""
SELECT seq, task_id, prev_status, status,
       CASE WHEN prev_status IS NOT DISTINCT FROM status THEN 0
            ELSE (CASE WHEN status = 'in_progress' THEN 1 ELSE 0 END) - (CASE WHEN prev_status = 'in_progress' THEN 1 ELSE 0 END) END AS d_in_progress,
       CASE WHEN prev_status IS NOT DISTINCT FROM status THEN 0
            ELSE (CASE WHEN status = 'completed' THEN 1 ELSE 0 END) - (CASE WHEN prev_status = 'completed' THEN 1 ELSE 0 END) END AS d_completed,
       CASE WHEN prev_status IS NOT DISTINCT FROM status THEN 0
            WHEN (prev_status IS DISTINCT FROM 'completed') AND due_date IS NOT NULL AND due_date < {AS_OF_SQL}
                 AND status = 'completed' THEN -1 ELSE 0 END AS d_overdue
FROM (SELECT c.seq, c.task_id, c.status, t.due_date,
             CASE WHEN row_number() OVER (PARTITION BY c.task_id ORDER BY c.ts, c.seq) = 1 THEN t.status
                  ELSE lag(c.status) OVER (PARTITION BY c.task_id ORDER BY c.ts, c.seq) END AS prev_status
      FROM status_checked c JOIN tasks t ON t.id = c.task_id WHERE c.outcome = 'applied') x""", requests=True),
    "member_counters_literal": _with(f"""
SELECT a.user_id, CAST(b.total_tasks AS BIGINT) AS total_tasks,
       CAST(b.completed_tasks + a.s_c - LEAST(0, b.completed_tasks + a.m_c) AS BIGINT) AS completed_tasks,
       CAST(b.in_progress_tasks + a.s_p - LEAST(0, b.in_progress_tasks + a.m_p) AS BIGINT) AS in_progress_tasks,
       CAST(b.overdue_tasks + a.s_o - LEAST(0, b.overdue_tasks + a.m_o) AS BIGINT) AS overdue_tasks
FROM (SELECT user_id, sum(d_c) AS s_c, min(cum_c) AS m_c, sum(d_p) AS s_p, min(cum_p) AS m_p,
             sum(d_o) AS s_o, min(cum_o) AS m_o
      FROM (SELECT user_id, d_c, d_p, d_o,
                   sum(d_c) OVER w AS cum_c, sum(d_p) OVER w AS cum_p, sum(d_o) OVER w AS cum_o
            FROM (SELECT t.assigned_to AS user_id, x.ts, x.seq,
                         CASE WHEN x.prev_status IS NOT DISTINCT FROM x.status THEN 0
                              ELSE (CASE WHEN x.status = 'completed' THEN 1 ELSE 0 END)
                                 - (CASE WHEN x.prev_status = 'completed' THEN 1 ELSE 0 END) END AS d_c,
                         CASE WHEN x.prev_status IS NOT DISTINCT FROM x.status THEN 0
                              ELSE (CASE WHEN x.status = 'in_progress' THEN 1 ELSE 0 END)
                                 - (CASE WHEN x.prev_status = 'in_progress' THEN 1 ELSE 0 END) END AS d_p,
                         CASE WHEN x.prev_status IS NOT DISTINCT FROM x.status THEN 0
                              WHEN (x.prev_status IS DISTINCT FROM 'completed') AND t.due_date IS NOT NULL
                                   AND t.due_date < {AS_OF_SQL} AND x.status = 'completed' THEN -1
                              ELSE 0 END AS d_o
                  FROM (SELECT c.seq, c.ts, c.task_id, c.status,
                               CASE WHEN row_number() OVER (PARTITION BY c.task_id ORDER BY c.ts, c.seq) = 1
                                    THEN (SELECT status FROM tasks WHERE id = c.task_id)
                                    ELSE lag(c.status) OVER (PARTITION BY c.task_id ORDER BY c.ts, c.seq) END AS prev_status
                        FROM status_checked c WHERE c.outcome = 'applied') x
                  JOIN tasks t ON t.id = x.task_id
                  WHERE t.assigned_to IS NOT NULL) y
            WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) z
      GROUP BY user_id) a
JOIN (SELECT assigned_to AS user_id, count(*) AS total_tasks,
             count(*) FILTER (WHERE status = 'completed') AS completed_tasks,
             count(*) FILTER (WHERE status = 'in_progress') AS in_progress_tasks,
             count(*) FILTER (WHERE status <> 'completed' AND due_date IS NOT NULL AND due_date < {AS_OF_SQL}) AS overdue_tasks
      FROM tasks WHERE assigned_to IS NOT NULL GROUP BY assigned_to) b ON a.user_id = b.user_id""", requests=True),
    "latest_status": _with("""
SELECT task_id, status FROM (
  SELECT task_id, status, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, seq DESC) AS rn
  FROM status_checked WHERE outcome = 'applied') x WHERE rn = 1""", requests=True),
    "live_counters": _with(_stats("applied_tasks"), requests=True),
    "rejected_events": _with(f"""
SELECT seq, task_id, status, requester_id, outcome, CAST({HTTP} AS INT) AS http_status
FROM status_checked WHERE outcome <> 'applied'""", requests=True),
    "offset_page_last": _with(f"""
SELECT {OVERVIEW_COLS} FROM listing {NEWEST} LIMIT {PAGE_SIZE}
OFFSET (SELECT (greatest(1, CAST(ceil(count(*) / {PAGE_SIZE}.0) AS BIGINT)) - 1) * {PAGE_SIZE} FROM listing)"""),
    "task_page_snapshot": _with(f"SELECT {PAGE_COLS} FROM listing WHERE project_id = {PROJECT} {NEWEST} LIMIT {TASK_LIMIT}"),
    "task_listing_text_keys": _with("""
SELECT CAST(id AS VARCHAR) AS id, title, description, status, due_date, created_at, CAST(project_id AS VARCHAR) AS project_id,
       project_name, CAST(assignee_id AS VARCHAR) AS assignee_id, assignee_name, assignee_email FROM listing"""),
    "overview_counts": _with("""
SELECT 'stats' AS part, CAST(1 AS BIGINT) AS row_count
UNION ALL SELECT 'members', count(*) FROM users WHERE role = 'member'
UNION ALL SELECT 'projects', count(*) FROM projects
UNION ALL SELECT 'tasks', count(*) FROM listing"""),
    "onboarded_users": _with(f"""
SELECT (SELECT max(id) + 1 FROM users) + r.seq AS id, {js_trim('r.name')} AS name, {js_trim('lower(r.email)')} AS email,
       'member' AS role, {role_norm('r.job_role')} AS job_role, true AS is_first_login, {AS_OF_SQL} AS created_at
FROM onboard_reqs r JOIN {ONBOARD_CHECKED} c ON c.seq = r.seq WHERE c.outcome = 'inserted'""", requests=True),
    "created_projects": _with(f"""
SELECT (SELECT max(id) + 1 FROM projects) + r.seq AS id, {js_trim('r.name')} AS name,
       NULLIF({js_trim('r.description')}, '') AS description, CAST(r.creator_id AS BIGINT) AS created_by, {AS_OF_SQL} AS created_at
FROM project_reqs r JOIN {PROJECTS_CHECKED} c ON c.seq = r.seq WHERE c.outcome = 'inserted'""", requests=True),
    "created_project_links": _with(f"""
SELECT DISTINCT (SELECT max(id) + 1 FROM projects) + l.seq AS project_id, l.user_id
FROM (SELECT seq, CAST(creator_id AS BIGINT) AS user_id FROM project_reqs
      UNION ALL SELECT seq, user_id FROM project_req_members WHERE user_id IS NOT NULL) l
JOIN {PROJECTS_CHECKED} c ON c.seq = l.seq WHERE c.outcome = 'inserted'""", requests=True),
    "added_links": _with(f"""
SELECT r.project_id, r.user_id FROM link_reqs r JOIN {LINKS_CHECKED} c ON c.seq = r.seq WHERE c.outcome = 'inserted'""", requests=True),
    "created_tasks": _with(f"""
SELECT (SELECT max(id) + 1 FROM tasks) + r.seq AS id, r.project_id, {js_trim('r.title')} AS title,
       NULLIF({js_trim('r.description')}, '') AS description, 'todo' AS status, r.assigned_to,
       CAST(NULL AS TIMESTAMP) AS due_date, {AS_OF_SQL} AS created_at
FROM task_reqs r JOIN {TASKS_CHECKED} c ON c.seq = r.seq WHERE c.outcome = 'inserted'""", requests=True),
    "tasks_after_changes": _with("SELECT * FROM applied_tasks", requests=True),
    "projects_after_member_deletes": _with(f"""
SELECT p.id, CASE WHEN p.created_by IN (SELECT r.user_id FROM member_delete_reqs r JOIN {MEMBER_DELETES_CHECKED} c
                                        ON c.seq = r.seq WHERE c.outcome = 'deleted') THEN NULL ELSE p.created_by END AS created_by
FROM projects p""", requests=True),
}
ORACLE["status_transitions_stream"] = ORACLE["status_transitions"]
ORACLE["offset_page_deep"] = ORACLE["offset_page"]
ORACLE["overview_members"] = ORACLE["member_rollup"]
ORACLE |= {
    "tasks_of_viewers": _with("""
SELECT u.id AS viewer_id, CAST(1 AS BIGINT) AS viewers, t.id AS task_id, CAST(1 AS BIGINT) AS tasks
FROM users u JOIN tasks t ON t.assigned_to = u.id WHERE u.role = 'member'
UNION ALL SELECT NULL, (SELECT count(*) FROM users WHERE role <> 'member'), NULL, (SELECT count(*) FROM tasks)"""),
    "overview_counters": _with(f"""
SELECT CASE grouping(status, project_id, assigned_to) WHEN 7 THEN 'all' WHEN 3 THEN 'status' WHEN 5 THEN 'project'
            ELSE 'assignee' END AS part, status, project_id, assigned_to, count(*) AS total_tasks,
       count(*) FILTER (WHERE kind = 'completed') AS completed_tasks,
       count(*) FILTER (WHERE kind = 'in_progress') AS in_progress_tasks,
       count(*) FILTER (WHERE kind <> 'completed' AND due_date < {AS_OF_SQL}) AS overdue_tasks
FROM (SELECT *, status AS kind FROM tasks) x
GROUP BY GROUPING SETS ((), (status), (project_id), (assigned_to))"""),
    "member_docs": _with("""
SELECT CAST(to_json(struct_pack(id := id, name := name, email := email, job_role := COALESCE(job_role, 'Team Member'))) AS VARCHAR) AS doc
FROM users WHERE role = 'member'"""),
    "roster_member_docs": _with("""
SELECT pm.project_id, CAST(to_json(struct_pack(id := u.id, name := u.name, email := u.email, role := u.role,
                                               job_role := COALESCE(u.job_role, 'Team Member'))) AS VARCHAR) AS member
FROM project_members pm JOIN users u ON u.id = pm.user_id WHERE u.role = 'member'"""),
    "counter_clamps": _with(f"""
SELECT project_id, greatest(0, count(*) FILTER (WHERE status = 'in_progress') - 1) AS less_one,
       least({PAGE_SIZE}, greatest(1, count(*) FILTER (WHERE status = 'completed'))) AS in_page
FROM tasks WHERE project_id IN (SELECT id FROM projects) GROUP BY project_id"""),
    "clean_member_lists": _with("""
SELECT seq, count(DISTINCT user_id) AS n_ids,
       coalesce(string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)), '') AS ids
FROM project_req_members GROUP BY seq""", requests=True),
}
