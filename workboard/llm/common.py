"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, kind: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what is written,
    and every later reader sees the same rows.
    """
    path = scratch_path(df.sparkSession, f"llm/{kind}")
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_package(spark: SparkSession) -> None:
    """Make the package importable in the executors' Python workers."""
    ship_package(spark)


def text_bytes(text_col: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty. Python then needs no decoding
    to split at ASCII characters."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def content_key(text_col: str = "text") -> Column:
    """Content address of a text (null as empty): SHA-256 in hex."""
    return F.sha2(text_bytes(text_col), 256)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, so that inputs may use any names."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
