"""The two samples of observations, and the row choices they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order``, which should end in a unique column.

    Spark takes each key's first row of a task before the shuffle too (WindowGroupLimit), so a hot key sends one row a task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def last_per(df: DataFrame, keys: list[str], value: Column, seq: str) -> DataFrame:
    """(keys, value of the row with the greatest ``seq``): an aggregate, so copies meet before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.col(seq)).alias("_last")).select(*keys, "_last.*")


def boundary_sample(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """State: observations of version-boundary snapshots, each with its ``major``."""
    s = snapshots.where("kind = 'version_boundary'").select(F.col("id").alias("snapshot_id"), F.col("framework_version").alias("major"))
    return observations.join(s, "snapshot_id")


AUTHORED = ["repository_id", "front_end", "file_path", "identifier"]


def authored_sample(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Flow: each attributed test once, from its lowest major (a head snapshot's comes last)."""
    s = snapshots.select(F.col("id").alias("snapshot_id"), F.col("framework_version").alias("major"))
    dated = observations.where("introduced_author_date is not null").join(s, "snapshot_id", "left")
    return first_per(dated, AUTHORED, F.col("major").asc_nulls_last(), F.col("id").asc())


def newest_extracted(snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """For each repository its head snapshot, else the one of the greatest major, among those with observations."""
    some = snapshots.join(observations.select(F.col("snapshot_id").alias("id")), "id", "left_semi")
    return first_per(some, ["repository_id"], (F.col("kind") == "head").desc(), F.col("framework_version").desc_nulls_last(), F.col("id").asc())


def window_of(date: Column, cutoff: str) -> Column:
    """'pre' before the cutoff, 'post' at or after it, null without a date."""
    return F.when(date < F.lit(cutoff).cast("timestamp"), "pre").when(date.isNotNull(), "post")
