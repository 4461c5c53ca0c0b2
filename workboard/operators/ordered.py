"""Row numbers, group sizes, ``lag`` and running sums within groups, safe for hot groups.

``Window.partitionBy(g)`` sends every row of a group to one task: a project holding a
third of all tasks would be sorted by a single core, and a numbering without groups by
one task altogether. Here the rows are range-partitioned on (group, order), so a hot
group is cut into many partitions, and written to the shared checkpoint folder. A *piece*
is a group's part of one partition; what earlier pieces of the group add (rows, sums, the
last row's values) comes from one row per piece, joined back. It is one plan at every size.

For row numbers and sizes the partitions are sorted when they are written, and each row's
place in its partition is written with it: its number follows from the first place of its
piece, so the rows go through one shuffle. ``lag`` and running sums need windows within
the pieces, hence a second one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.session import scratch_path


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "ordered")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _before_pieces(pieces: DataFrame, grouped: bool, lag_cols, sum_cols) -> DataFrame:
    """Rows, sums and last values of the earlier pieces of each piece's group, and the
    group's size. Without groups there is one piece for each partition: the driver adds
    those few rows up."""
    if grouped:
        upto = Window.partitionBy("_group").orderBy("_part")
        earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
        return pieces.select(
            "_group", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_rows").over(Window.partitionBy("_group")).alias("_size"),
            *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sum_cols],
            *[F.lag(f"_last.{c}").over(upto).alias(f"_prev_{c}") for c in lag_cols])
    rows = sorted(pieces.collect(), key=lambda r: r["_part"])
    total, sums, last, out = 0, [0] * len(sum_cols), [None] * len(lag_cols), []
    size = sum(r["_rows"] for r in rows)
    for r in rows:
        out.append((r["_part"], total, size, *sums, *last))
        total += r["_rows"]
        sums = [s + r[f"_sum_{c}"] for s, c in zip(sums, sum_cols)]
        last = [r["_last"][c] for c in lag_cols]
    kinds = {f.name: f.dataType for f in pieces.schema["_last"].dataType.fields} if lag_cols else {}
    schema = T.StructType(
        [T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType()), T.StructField("_size", T.LongType())]
        + [T.StructField(f"_before_{c}", T.LongType()) for c in sum_cols]
        + [T.StructField(f"_prev_{c}", kinds[c]) for c in lag_cols])
    return pieces.sparkSession.createDataFrame(out, schema)


def number_within_groups(df: DataFrame, group_cols: list[str], order_by: list[Column], *,
                         pos_col: str = "pos", size_col: str | None = None,
                         lag_cols: tuple[str, ...] = (), sum_cols: tuple[str, ...] = (),
                         num_partitions: int | None = None) -> DataFrame:
    """Add ``pos_col`` (1-based row number in ``order_by`` order within the group),
    optionally ``size_col`` (rows in the group), ``prev_<c>`` for ``lag_cols``
    and ``cum_<c>`` (running sum up to and including the row, NULL as 0) for
    the integral ``sum_cols``.

    ``order_by`` should be a total order inside a group (end with a unique key)
    so the numbering is deterministic. NULL group values form groups of their own.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not lag_cols and not sum_cols:
        return _numbered(df, group_cols, order_by, pos_col, size_col, n)
    keyed = df.withColumn("_group", F.struct(*group_cols)) if group_cols else df
    piece = ["_group", "_part"] if group_cols else ["_part"]
    sort = [F.col(g).asc_nulls_first() for g in group_cols] + list(order_by)
    rows = _written(keyed.repartitionByRange(n, *sort).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy(*piece).orderBy(*order_by)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in sum_cols}
    placed = rows.withColumn("_at", F.row_number().over(local))
    pieces = (placed if lag_cols else rows).groupBy(*piece).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(value[c]).alias(f"_sum_{c}") for c in sum_cols],
        *([F.max_by(F.struct(*lag_cols), "_at").alias("_last")] if lag_cols else []))
    before = _before_pieces(pieces, bool(group_cols), lag_cols, sum_cols)
    for c in lag_cols:
        placed = placed.withColumn(f"_lag_{c}", F.lag(c).over(local))
    for c in sum_cols:
        placed = placed.withColumn(f"_run_{c}", F.sum(value[c]).over(running))
    out = [(F.col("_at") + F.col("_before")).alias(pos_col)]
    if size_col:
        out.append(F.col("_size").alias(size_col))
    out += [F.when(F.col("_at") == 1, F.col(f"_prev_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}") for c in lag_cols]
    out += [(F.col(f"_run_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in sum_cols]
    return placed.join(before, piece).select(*df.columns, *out)


def placed_in_order(df: DataFrame, sort: list[Column], n: int) -> DataFrame:
    """``df``, range-partitioned and sorted, with each row's partition (``_part``) and its place there (``_at``, from 0)."""
    ids = df.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
    return ids.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")


def _numbered(df: DataFrame, group_cols: list[str], order_by: list[Column], pos_col: str, size_col: str | None, n: int) -> DataFrame:
    sort = [F.col(g).asc_nulls_first() for g in group_cols] + list(order_by)
    rows = _written(placed_in_order(df.withColumn("_group", F.struct(*group_cols)) if group_cols else df, sort, n))
    piece = ["_group", "_part"] if group_cols else ["_part"]
    pieces = rows.groupBy(*piece).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    before = _before_pieces(pieces.select(*piece, "_rows"), bool(group_cols), (), ())
    if group_cols:
        before = before.join(pieces.select(*piece, "_from"), piece)
        start = F.col("_before") - F.col("_from")
    else:
        start = F.col("_before")
    out = [(F.col("_at") + start + 1).alias(pos_col)]
    if size_col:
        out.append(F.col("_size").alias(size_col))
    return rows.join(before, piece).select(*df.columns, *out)
