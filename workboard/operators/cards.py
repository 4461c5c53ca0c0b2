"""Display projections of task and project cards (H6-H12 on listings)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.functions.status import (badge_text, is_overdue_browser, next_action, next_status,
                                        status_label, status_tone)
from workboard.functions.text import display_date, or_text

# Fallback texts shown by the reference's cards and tables.
NO_TASK_DESCRIPTION = "No description provided for this task."
NO_ASSIGNEE = "Unassigned"
NO_DUE_DATE = "Flexible"


def task_cards(listing: DataFrame, as_of) -> DataFrame:
    """Card fields for every task of a listing (C1/C2 output)."""
    return (listing.withColumn("overdue", is_overdue_browser(as_of))
            .select("id", "status", "overdue",
                    status_label().alias("status_label"),
                    badge_text().alias("badge_text"),
                    status_tone().alias("status_tone"),
                    next_action().alias("next_action"),
                    next_status().alias("next_status"),
                    display_date("due_date", NO_DUE_DATE).alias("due_text"),
                    or_text("description", NO_TASK_DESCRIPTION).alias("description_text"),
                    or_text("assignee_name", NO_ASSIGNEE).alias("assignee_text")))
