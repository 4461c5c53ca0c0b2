"""Plain window functions: what the piecewise numbering has to equal."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def numbered(df, groups, order, pos_col="pos", size_col=None, lag_cols=(), sum_cols=()):
    w = Window.partitionBy(*groups).orderBy(*order)
    out = df.withColumn(pos_col, F.row_number().over(w).cast("long"))
    for c in lag_cols:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
    for c in sum_cols:
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"cum_{c}", F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto).cast("long"))
    return out.withColumn(size_col, F.count(F.lit(1)).over(Window.partitionBy(*groups))) if size_col else out
