"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, clear_staged, read_table, shared_dir, ship, small, staged

__all__ = ["BROADCAST_ROWS", "bind", "clear_staged", "fresh", "shared_dir", "ship", "small", "staged", "table"]


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many leading underscores as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")
