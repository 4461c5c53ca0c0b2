"""The listing order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def newest_first(ts: str = "created_at", key: str = "id") -> list[Column]:
    """PostgreSQL's ``ts DESC`` (NULLs first), then the id tie-break."""
    return [F.col(ts).desc_nulls_first(), F.col(key).desc()]
