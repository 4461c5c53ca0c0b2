"""Piecewise numbering equals window functions on random data, with and without
groups and with NULL group keys."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import plain
from workboard.operators.ordered import number_within_groups

rows_strategy = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.sampled_from(["a", "b"])),
              st.integers(0, 5)),
    min_size=0, max_size=120)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, parts=st.integers(1, 9), groups=st.sampled_from([["g", "s"], ["g"], []]))
def test_pieces_equal_windows(spark, rows, parts, groups):
    data = [(i, g, s, o) for i, (g, s, o) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g int, s string, o int") \
        .withColumn("v", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 7 - 3))
    order = [F.col("o").desc(), F.col("id").asc()]
    a = plain.numbered(df, groups, order, size_col="n", lag_cols=("o", "s"), sum_cols=("o", "v"))
    b = number_within_groups(df, groups, order, size_col="n", lag_cols=("o", "s"), sum_cols=("o", "v"), num_partitions=parts)
    cols = ["id", "pos", "n", "prev_o", "prev_s", "cum_o", "cum_v"]
    assert sorted(tuple(r) for r in b.select(*cols).collect()) == sorted(tuple(r) for r in a.select(*cols).collect())
