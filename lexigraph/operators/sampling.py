"""Sampling and degree analytics over edges (user_id, follower_id): A1-A3, J3, Q5, F16."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_distinct(lines: DataFrame, total: int, sample: int, seed: int = 0) -> DataFrame:
    """Distinct rows, of which one in total // sample is kept (Q5), by a hash of the row and the seed: whatever the
    partitions and retries, the same rows come back, and repeated ones stay or go together."""
    if sample < 1 or total < sample:
        raise ValueError("sample must be from 1 to total")
    if total // sample == 1:
        return lines.distinct()
    line = F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in lines.columns), F.lit(str(seed)))
    kept = F.conv(F.substr(F.md5(line), F.lit(1), F.lit(8)), 16, 10).cast("long") % (total // sample) == 0
    return lines.where(kept).distinct()


def follower_counts(edges: DataFrame) -> DataFrame:
    """user_id, followers (A1); users who only follow have 0. Counted on the map side, one exchange."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("user_id"), F.lit(1).cast("long").alias("n")), F.struct(F.col("follower_id").alias("user_id"), F.lit(0).cast("long").alias("n")))).alias("e"))
    return ends.groupBy("e.user_id").agg(F.sum("e.n").alias("followers"))


def follower_histogram(counts: DataFrame) -> DataFrame:
    """followers, users (A2)."""
    return counts.groupBy("followers").agg(F.count("*").alias("users"))


def screen_name_filter(names: DataFrame, counts: DataFrame) -> DataFrame:
    """The names whose user has a degree."""
    return names.join(counts, "user_id", "left_semi")


def non_numeric(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value isn't a whole number."""
    return df.where(F.col(column).try_cast("bigint").isNull())
