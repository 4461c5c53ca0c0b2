"""Status predicates, labels and counter helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The status domain and its display labels.
STATUSES = ["todo", "in_progress", "completed"]
STATUS_LABELS = {"todo": "To Do", "in_progress": "In Progress", "completed": "Completed"}
# The next status offered by each card, and its button text.
NEXT_STATUS = {"todo": "in_progress", "in_progress": "completed"}
NEXT_ACTION_LABELS = {"todo": "Start Task", "in_progress": "Mark Complete"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_lit(as_of) -> Column:
    """A ``timestamp_ntz`` literal for the reporting instant (never current_timestamp)."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    # via text: a datetime literal would pass through the Python and the
    # session time zones; a wall-clock string cast to NTZ does not
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def is_overdue(as_of, status="status", due_date="due_date") -> Column:
    """SQL rule (B7): status <> 'completed' AND due_date NOT NULL AND due_date < now.

    Three-valued like SQL: a NULL status yields NULL, which a filter or
    ``count_if`` treats as false.
    """
    return (_c(status) != "completed") & _c(due_date).isNotNull() & (_c(due_date) < as_of_lit(as_of))


def is_overdue_browser(as_of, status="status", due_date="due_date") -> Column:
    """Browser rule (B8): a NULL or unknown status counts as open."""
    return (~_c(status).eqNullSafe("completed")) & _c(due_date).isNotNull() & (_c(due_date) < as_of_lit(as_of))


def is_known_status(c="status") -> Column:
    """Status in the three-value domain (H15); NULL -> false."""
    return F.coalesce(_c(c).isin(*STATUSES), F.lit(False))


def _lookup(mapping: dict, c) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, _c(c))


def status_label(c="status") -> Column:
    """Display label; an unknown status passes through (H7)."""
    return F.coalesce(_lookup(STATUS_LABELS, c), _c(c))


def status_tone(status="status", overdue="overdue") -> Column:
    """danger / success / primary / neutral (H8)."""
    return (F.when(F.coalesce(_c(overdue), F.lit(False)), "danger")
            .when(_c(status) == "completed", "success")
            .when(_c(status) == "in_progress", "primary")
            .otherwise("neutral"))


def badge_text(status="status", overdue="overdue") -> Column:
    """'Overdue' wins over the label (H9)."""
    return F.when(F.coalesce(_c(overdue), F.lit(False)), F.lit("Overdue")).otherwise(status_label(status))


def next_status(c="status") -> Column:
    """Status a card's button moves to; NULL when there is none."""
    return _lookup(NEXT_STATUS, c)


def next_action(c="status") -> Column:
    """Button text offered by a card; NULL when there is none."""
    return _lookup(NEXT_ACTION_LABELS, c)


def as_count(c) -> Column:
    """The type of counters (H13): bigint, as a count may pass 2^31."""
    return _c(c).cast("long")


def decrement_floor0(c) -> Column:
    """``Math.max(0, x - 1)``."""
    return F.greatest(_c(c) - 1, F.lit(0))


def clamp(c, lo, hi) -> Column:
    """``Math.min(Math.max(x, lo), hi)``."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(_c(c), lo_c), hi_c)
