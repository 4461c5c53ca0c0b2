"""A2: list the workspace tables registered in the session catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.sources.workspace import TABLES


def list_tables(spark: SparkSession, names=TABLES) -> DataFrame:
    """Workspace tables present in the current catalog (temp views included)."""
    present = {t.name for t in spark.catalog.listTables()}
    rows = [(n, n in present) for n in names]
    return spark.createDataFrame(rows, "table_name string, present boolean").where(F.col("present"))
