"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.llm.common import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: any orderable type) to one row per linked node: (node, label).

    The label is the smallest node of the component. Each round connects every
    node's larger neighbours, then its smaller ones, to the smallest node it sees;
    the links end as one star per component. Only minima are grouped (with map-side
    combine) and joined back, so no node's neighbour list sits in one task, and each
    round is written to the shared folder. Null ends and self links say nothing and
    are left out; an empty input gives an empty table.
    """
    def forward(df):
        return (df.where(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    cur = materialize(forward(links.select("a", "b")), "links")
    mark = _mark(cur)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))))
        cur = materialize(forward(small), "links")
        before, mark = mark, _mark(cur)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
