"""Keyset and offset paging.

A page is ``filter(cursor) -> orderBy -> limit``, which Spark plans as
``TakeOrderedAndProject``: every task keeps its own top ``limit`` rows and only
those reach the final merge, so a page costs one scan and no shuffle of data.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.functions.order import newest_first
from workboard.functions.status import as_of_lit
from workboard.operators.listing import scope_tasks, task_listing, tasks_of_project, visible_projects
from workboard.operators.ordered import number_within_groups, placed_in_order
from workboard.sources.files import names_in, read_record, write_record

CURSOR_MODES = ("composite", "timestamp")
TASK_PAGE_LIMIT = 50      # reference default page size for tasks
PROJECT_PAGE_LIMIT = 20   # reference default page size for projects
CLIENT_PAGE_SIZE = 8      # reference client-side page size


def _check_limit(limit) -> int:
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
        raise ValueError("limit must be a positive integer")
    return limit


def before_cursor(cursor, mode: str = "composite", ts: str = "created_at", key: str = "id") -> Column:
    """Rows strictly after ``cursor`` in newest-first order.

    ``composite``: cursor = (created_at, id), nothing is skipped on ties.
    ``timestamp``: the reference's ``created_at < cursor`` (R2): rows tied with
    the previous page's last row are skipped.
    """
    if mode not in CURSOR_MODES:
        raise ValueError(f"mode must be one of {CURSOR_MODES}")
    if mode == "timestamp":
        c_ts = cursor[0] if isinstance(cursor, (tuple, list)) else cursor
        return F.col(ts) < as_of_lit(c_ts)
    c_ts, c_id = cursor
    if c_ts is None:  # the previous page ended among the NULL timestamps (sorted first)
        return (F.col(ts).isNull() & (F.col(key) < F.lit(c_id))) | F.col(ts).isNotNull()
    t = as_of_lit(c_ts)
    return (F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) < F.lit(c_id)))


def next_cursor(page_rows: list, mode: str = "composite"):
    """Cursor for the following page from the last row of a collected page."""
    if not page_rows:
        return None
    last = page_rows[-1]
    return last["created_at"] if mode == "timestamp" else (last["created_at"], last["id"])


def task_page(ws, project_id, viewer_id, viewer_role, cursor=None, limit: int = TASK_PAGE_LIMIT,
              cursor_mode: str = "composite", rule: str = "reference") -> DataFrame:
    """a keyset page of one project's tasks, newest first."""
    limit = _check_limit(limit)
    t = tasks_of_project(ws.tasks, project_id)
    t = scope_tasks(t, viewer_id, viewer_role, rule)
    if cursor is not None:
        t = t.where(before_cursor(cursor, cursor_mode))
    out = task_listing(t, ws.projects, ws.users, with_project_id=False)
    return out.orderBy(*newest_first()).limit(limit)


def project_page(ws, viewer_id, viewer_role, cursor=None, limit: int = PROJECT_PAGE_LIMIT,
                 cursor_mode: str = "composite") -> DataFrame:
    """a keyset page of the projects visible to the viewer, newest first."""
    limit = _check_limit(limit)
    p = visible_projects(ws.projects, ws.project_members, viewer_id, viewer_role)
    if cursor is not None:
        p = p.where(before_cursor(cursor, cursor_mode))
    return p.orderBy(*newest_first()).limit(limit)


def clamp_page(n_rows: int, page: int, size: int = CLIENT_PAGE_SIZE) -> int:
    pages = max(1, -(-n_rows // size))
    return min(max(1, page), pages)


def offset_page(df: DataFrame, page: int, size: int = CLIENT_PAGE_SIZE,
                order_by: list[Column] | None = None, keys: DataFrame | None = None, key: str = "id",
                top_rows: int = 10_000) -> DataFrame:
    """page ``page`` (clamped into [1, page_count]) of ``size`` rows.

    ``keys`` has a row for each row of ``df`` with its ``key`` and the ordering columns
    (default: ``df`` itself); a narrow table spares counting and sorting a joined
    listing. A page that ends within the first ``top_rows`` rows is the tail of a top-k,
    which shuffles nothing; one further down is cut out of a distributed numbering, and only
    rows with the page's keys are fetched. Callers that turn many pages keep a ``PageIndex``.
    """
    size = _check_limit(size)
    order_by = order_by or newest_first()
    keys = df if keys is None else keys
    start = (clamp_page(keys.count(), page, size) - 1) * size
    if start + size <= top_rows:
        wanted = keys.orderBy(*order_by).limit(start + size).offset(start).select(key)
    else:
        numbered = number_within_groups(keys, [], order_by, pos_col="_row")
        wanted = numbered.where((F.col("_row") > start) & (F.col("_row") <= start + size)).select(key)
    return df.join(wanted, key, "left_semi").select(*df.columns).orderBy(*order_by)


class PageIndex:
    """The keys of a listing in order, written once: one folder per range partition, and a record
    with the number of rows of each. A page at any depth reads the folders it lies in (nearly
    always one), and there, by the files' statistics, the row groups of its places."""

    def __init__(self, spark, path: str, key: str, order_by: list[Column]):
        self.spark, self.path, self.key, self.order_by = spark, path.rstrip("/"), key, order_by
        found = json.loads(read_record(spark, f"{self.path}/index.json"))
        self.parts = [(p, n) for p, n in found["parts"]]
        self.schema = T.StructType.fromJson(found["schema"])

    @classmethod
    def build(cls, keys: DataFrame, path: str, order_by: list[Column] | None = None, key: str = "id",
              partitions: int | None = None) -> "PageIndex":
        """Write the index of ``keys`` (``key``, unique, and the ordering columns) under ``path``."""
        spark, order_by, path = keys.sparkSession, order_by or newest_first(), path.rstrip("/")
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = placed_in_order(keys, order_by, n).select(key, "_at", F.col("_part").alias("part"))
        placed.write.partitionBy("part").parquet(f"{path}/keys")
        counts = spark.read.parquet(f"{path}/keys").groupBy("part").count().collect() if names_in(spark, f"{path}/keys") else []
        write_record(spark, f"{path}/index.json", json.dumps({
            "parts": sorted((r["part"], r["count"]) for r in counts), "schema": placed.select(key, "_at").schema.jsonValue()}))
        return cls(spark, path, key, order_by)

    def page(self, df: DataFrame, page: int, size: int = CLIENT_PAGE_SIZE) -> DataFrame:
        """the rows of ``df`` on page ``page`` (clamped), in order."""
        size = _check_limit(size)
        start = (clamp_page(sum(n for _, n in self.parts), page, size) - 1) * size
        wanted, before = self.spark.createDataFrame([], self.schema).select(self.key), 0
        for part, n in self.parts:
            lo, hi = max(start - before, 0), min(start + size - before, n)
            if lo < hi:
                rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/keys/part={part}")
                wanted = wanted.unionByName(rows.where((F.col("_at") >= lo) & (F.col("_at") < hi)).select(self.key))
            before += n
        return df.join(wanted, self.key, "left_semi").select(*df.columns).orderBy(*self.order_by)


def assign_pages(df: DataFrame, size: int = CLIENT_PAGE_SIZE, order_by: list[Column] | None = None,
                 group_cols: list[str] | None = None) -> DataFrame:
    """page number and row number for every row (export form of F1/F4).

    Without groups this is a global numbering; no window runs over more than one
    range partition (see ``operators.ordered``).
    """
    size = _check_limit(size)
    order_by = order_by or newest_first()
    out = number_within_groups(df, group_cols or [], order_by, pos_col="row_number")
    return out.withColumn("page", ((F.col("row_number") - 1) / F.lit(size)).cast("long") + 1)
