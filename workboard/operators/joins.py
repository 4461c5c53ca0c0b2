"""Join helpers that keep hot keys from landing in one task.

Many-to-one lookups (task -> project, task -> assignee) are plain equi-joins:
Catalyst/AQE choose broadcast when the looked-up side is small at runtime and
split skewed partitions of a sort-merge join otherwise. Two cases need help:

* NULL keys of an outer join all hash to one partition and can never match;
  ``left_lookup`` spreads them by a hash of the row's id.
* Aggregations after a fan-out join are rewritten as pre-aggregation (see
  ``operators.rollups``), which also removes the skew of the join itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _spread(left: DataFrame, key: str, row: Column) -> Column:
    """``key``, and where it is NULL a value made from ``row``, of the same type."""
    kind = left.schema[key].dataType
    if isinstance(kind, T.LongType):
        return F.coalesce(F.col(key), row)
    if isinstance(kind, T.StringType):
        return F.coalesce(F.col(key), row.cast("string"))
    return F.col(key)


def left_lookup(left: DataFrame, right: DataFrame, left_key, right_key=None, row_id: str | None = None) -> DataFrame:
    """``left LEFT JOIN right ON left_key = right_key`` (one column or a list).

    Rows with a NULL key part never match. For the join their key is a hash of ``row_id``
    (default: the first of id, seq, task_id that ``left`` has), so they go to as many
    partitions as other rows, and a condition on the left side keeps them from matching.
    The right side is partitioned by its plain keys: its exchange can be shared, and a
    bucketed table needs none. Key columns named the same on both sides are kept once,
    from the left (like ``on=[names]``).
    """
    lk = [left_key] if isinstance(left_key, str) else list(left_key)
    rk = lk if right_key is None else ([right_key] if isinstance(right_key, str) else list(right_key))
    row_id = row_id or next((c for c in ("id", "seq", "task_id") if c in left.columns), None)
    row = F.xxhash64(row_id) if row_id else F.xxhash64(*[f.name for f in left.schema if not isinstance(f.dataType, T.StringType)])
    renamed = {c: f"_rk_{i}" for i, c in enumerate(rk) if c in left.columns}
    r = right.select(*[F.col(c).alias(renamed.get(c, c)) for c in right.columns])
    l = left.withColumns({f"_lk_{i}": _spread(left, c, row) for i, c in enumerate(lk)})
    known = F.lit(True)
    for c in lk:
        known = known & l[c].isNotNull()
    cond = known
    for i, c in enumerate(rk):
        cond = cond & (l[f"_lk_{i}"] == r[renamed.get(c, c)])
    return l.join(r, cond, "left").drop(*[f"_lk_{i}" for i in range(len(lk))], *renamed.values())
