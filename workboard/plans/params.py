"""Fixed parameters of the registered queries (FIXTURES.md §4)."""

import datetime as dt

AS_OF = dt.datetime(1998, 8, 2)
AS_OF_SQL = "TIMESTAMP '1998-08-02 00:00:00'"
VIEWER_MEMBER = 52
VIEWER_ADMIN = 50
PAGE_VIEWER = 489  # a member with tasks in PROJECT (at sf0.01)
PROJECT = 5
CURSOR = (dt.datetime(1997, 8, 23), 7000)
CURSOR_SQL = "TIMESTAMP '1997-08-23 00:00:00'"
PROJECT_CURSOR = (dt.datetime(1995, 2, 15), 45)
PROJECT_CURSOR_SQL = "TIMESTAMP '1995-02-15 00:00:00'"
PAGE_SIZE = 8
OFFSET_PAGE = 3
TASK_LIMIT = 50
PROJECT_LIMIT = 20
EMAIL = "customer#000000052@example.com"
TASK_ID = 7001
