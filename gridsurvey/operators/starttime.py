"""Start times of shared checklists: find the inconsistent ones, settle on the modal value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join


def start_time_counts(df: DataFrame) -> DataFrame:
    """Checklists with more than one distinct start time, a missing one counting as a value."""
    return (
        df.select("checklist_id", "observation_datetime")
        .distinct()
        .groupBy("checklist_id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


def modal_value(df: DataFrame, keys: list[str], value: str, out: str, weight: str | None = None) -> DataFrame:
    """Most frequent value per group; nulls do not count, ties go to the smallest value.

    Counted per (group, value) first and picked second: both steps combine
    map-side, so neither a hot group nor a group with many distinct values is
    ever held in one task.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    counted = df.groupBy(*keys, value).agg(n.alias("__n"))
    order = F.when(F.col(value).isNotNull(), F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(F.min_by(value, order).alias(out))


def with_modal_value(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The group's modal value on every row of the group."""
    return null_safe_join(df, modal_value(df, keys, value, out), keys, "left")


def fixed_start_times(df: DataFrame) -> DataFrame:
    """One modal start per checklist that has several: ``observation_datetime_fixed``.

    Each distinct (block, checklist, observer list, start) row votes once per
    observer in its list, so the list length is the weight and nothing needs
    to be exploded.

    Rows are dealt out by checklist once, and those of checklists with one start
    are left out before any vote is counted. A checklist has a row per species
    and copy, so the windows stay small; those of the votes share one sort.
    """
    start, rows = F.col("observation_datetime"), df.select("pba3_block", "checklist_id", "observer_id", "observation_datetime")
    checklist = Window.partitionBy("checklist_id")
    known, n = F.count(start).over(checklist), F.count("*").over(checklist)
    several = (F.min(start).over(checklist) != F.max(start).over(checklist)) | ((known > 0) & (known < n))
    disputed = rows.repartition("checklist_id").withColumn("several", several).filter("several").drop("several")

    same_start = Window.partitionBy("checklist_id", "observation_datetime")
    same_vote = Window.partitionBy("checklist_id", "observation_datetime", "pba3_block", "observer_id").orderBy("observer_id")
    voters = F.coalesce(F.array_size(F.split("observer_id", ",")), F.lit(1))
    votes = (
        disputed.withColumn("place", F.row_number().over(same_vote))
        .withColumn("n", F.sum(F.when(F.col("place") == 1, voters)).over(same_start))
        .filter("place = 1")
    )
    order = F.when(start.isNotNull(), F.struct((-F.col("n")).alias("n"), start.alias("v")))
    return votes.groupBy("checklist_id").agg(F.min_by("observation_datetime", order).alias("observation_datetime_fixed"))


def with_fixed_start(df: DataFrame, fixed: DataFrame) -> DataFrame:
    """Replace the start by the modal one where the checklist has one."""
    return (
        df.join(fixed, "checklist_id", "left")
        .withColumn("observation_datetime", F.coalesce("observation_datetime_fixed", "observation_datetime"))
        .drop("observation_datetime_fixed")
    )


def start_time_report(df: DataFrame) -> DataFrame:
    """One row: how many checklists have several start times, and whether any has."""
    n = F.count("*")
    return start_time_counts(df).agg(n.alias("checklists"), (n > 0).alias("present"))
