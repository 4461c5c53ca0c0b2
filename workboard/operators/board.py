"""Kanban board and day split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workboard.functions.status import STATUSES, as_of_lit
from workboard.operators.ordered import number_within_groups

SORT_KEYS = ("created_at", "due_date")
LANES = STATUSES  # todo, in_progress, completed; any other status has no lane (B12)


def lane_order(sort_by: str = "created_at") -> list[Column]:
    """Card order inside a lane: newest first, or due date ascending with
    missing dates last (R13), then newest, then id."""
    if sort_by not in SORT_KEYS:
        raise ValueError(f"sort_by must be one of {SORT_KEYS}")
    tail = [F.col("created_at").desc(), F.col("id").desc()]
    return ([F.col("due_date").asc_nulls_last()] + tail) if sort_by == "due_date" else tail


def kanban_board(tasks: DataFrame, sort_by: str = "created_at") -> DataFrame:
    """Lane position and lane size for each task of each project board."""
    lanes = tasks.where(F.col("status").isin(*LANES))
    return number_within_groups(lanes, ["project_id", "status"], lane_order(sort_by),
                                pos_col="lane_position", size_col="lane_size")


def newest_per_project(tasks: DataFrame, n: int = 50) -> DataFrame:
    """E2 first step: the ``n`` newest tasks of every project (the board's first page).

    ``row_number() <= n`` lets Spark insert a partial per-group limit before
    the shuffle (WindowGroupLimit), so a hot project sends at most ``n`` rows
    per map task.
    """
    # the page comes from SQL ``ORDER BY created_at DESC`` (PostgreSQL: NULLs first)
    w = Window.partitionBy("project_id").orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())
    return tasks.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def kanban_newest(tasks: DataFrame, n: int = 50, sort_by: str = "created_at") -> DataFrame:
    """The board as first shown: the newest ``n`` tasks of each project, in lanes."""
    shown = newest_per_project(tasks, n).where(F.col("status").isin(*LANES))
    lane = Window.partitionBy("project_id", "status")  # at most n rows
    return (shown.withColumn("lane_position", F.row_number().over(lane.orderBy(*lane_order(sort_by))).cast("long"))
                 .withColumn("lane_size", F.count(F.lit(1)).over(lane)))


def split_today(tasks: DataFrame, as_of) -> DataFrame:
    """B11: 'today' when created on the calendar day of ``as_of``, else 'backlog' (NULL too)."""
    today = F.to_date(as_of_lit(as_of))
    return tasks.withColumn(
        "bucket", F.when(F.to_date("created_at") == today, "today").otherwise("backlog"))
