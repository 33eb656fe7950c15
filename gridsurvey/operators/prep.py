"""Ingest: filter, clean and derive the sightings table.

All operators here are narrow (no shuffle) except the two that collapse
duplicates, :func:`collapse_shared` and :func:`roll_up_taxa`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.categories import (
    current_category_name,
    current_species_name,
    description_of,
    rank_of,
    rank_of_description,
)
from ..functions.text import list_contains, parse_count, squish
from ..functions.times import month_label, release_month_end, wall_clock
from ..lookups import SURVEY_START, SURVEY_TZ


def in_date_range(df: DataFrame, start=SURVEY_START, end=None) -> DataFrame:
    """Sightings dated start..end, both included. Pushed to the scan."""
    day = F.col("observation_date")
    out = df.filter(day >= F.lit(start).cast("date"))
    return out if end is None else out.filter(day <= F.lit(end).cast("date"))


def up_to_release(df: DataFrame, label: str, start=SURVEY_START) -> DataFrame:
    """Sightings from start to the end of the release month, e.g. ``Jun-2026``."""
    first = dt.datetime.strptime(label, "%b-%Y").date()
    following = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return in_date_range(df, start, following - dt.timedelta(days=1))


def in_project(df: DataFrame, project: str) -> DataFrame:
    return df.filter(list_contains(F.col("project_names"), project))


def collapse_shared(df: DataFrame) -> DataFrame:
    """One row per (checklist, species) where several observers shared a checklist.

    ``checklist_id`` is the group id of a shared checklist, else the event id.
    Every other column comes from the copy with the smallest event id;
    ``observer_id`` becomes the comma list of all observers. Rows without a
    group id have no copies: they pass by the shuffle unchanged. Both
    aggregates merge map-side, so copies of one checklist meet as partial
    states, not as rows.
    """
    carried = [c for c in df.columns if c not in ("checklist_id", "common_name", "observer_id")]
    columns = ["checklist_id", "common_name", "observer_id", *carried]
    observer = F.nullif("observer_id", F.lit("")).alias("observer_id")
    first = F.min_by(F.struct(*carried), F.struct("event_id", *[c for c in carried if c != "event_id"]))
    shared = (
        df.filter(F.col("group_id").isNotNull())
        .groupBy(F.col("group_id").alias("checklist_id"), "common_name")
        .agg(
            first.alias("first"),
            F.array_join(F.sort_array(F.collect_set("observer_id")), ",").alias("observer_id"),
        )
        .select("checklist_id", "common_name", observer, "first.*")
    )
    alone = df.filter(F.col("group_id").isNull()).select(
        F.col("event_id").alias("checklist_id"), "common_name", observer, *carried
    )
    return shared.select(*columns).unionByName(alone)


SPECIES_LEVEL = ("species", "issf", "form", "domestic")


def roll_up_taxa(df: DataFrame, count_rule: str = "sum") -> DataFrame:
    """Drop taxa above species level and merge sub-species into their species.

    One row per (checklist, species) is left: the row with the highest
    category, of equal ones the smallest by its other columns, so that
    category and code always belong together. Categories must be clean, see
    :func:`clean_codes`. Only the count is merged: the total (``sum``), which
    an uncounted ``X`` makes ``X``, or the largest reported (``max``).

    Few rows share a checklist and a species, so merging them before the shuffle
    takes away next to nothing. The rows are dealt out as they are and sorted
    once, after it, in a stage that holds no join.
    """
    number = parse_count(F.col("observation_count"))
    if count_rule == "sum":
        uncounted = F.max(F.coalesce(F.col("observation_count") == "X", F.lit(False)))
        count = F.when(uncounted, "X").otherwise(F.sum(number).cast("bigint").cast("string"))
    else:
        count = F.coalesce(
            F.max(F.when(F.col("observation_count") != "X", number)).cast("bigint").cast("string"),
            F.max(F.when(F.col("observation_count") == "X", "X")),
        )
    given = ("checklist_id", "common_name", "taxon_category", "observation_count", "breeding_category")
    carried = [c for c in df.columns if c not in given]
    species = df.filter(F.col("taxon_category").isin(*SPECIES_LEVEL)).drop("taxon_category").repartition("checklist_id", "common_name")
    order = [F.struct(*carried)] if carried else []
    if "breeding_category" in df.columns:
        carried.append("breeding_category")
        # Falling by category: unknown and missing ones last, by the complement of what ``max`` would take.
        order.insert(0, -F.coalesce(rank_of(F.col("breeding_category")), F.lit(-1)))
        order.append(F.col("breeding_category"))
    if not carried:
        return species.groupBy("checklist_id", "common_name").agg(count.alias("observation_count"))
    first = F.min_by(F.struct(*carried), F.struct(*order))
    out = species.groupBy("checklist_id", "common_name").agg(count.alias("observation_count"), first.alias("first"))
    return out.select("checklist_id", "common_name", "observation_count", "first.*")


def clean_codes(df: DataFrame) -> DataFrame:
    """Collapse blanks in the code columns; a missing category means ``C1``."""
    return df.withColumns(
        {
            "breeding_code": squish(F.col("breeding_code")),
            "breeding_category": F.coalesce(squish(F.col("breeding_category")), F.lit("C1")),
        }
    )


def with_observation_times(df: DataFrame, tz: str = SURVEY_TZ) -> DataFrame:
    """Add the month label and the wall-clock start."""
    day = F.col("observation_date")
    return df.withColumns(
        {
            "observation_month": month_label(day),
            "observation_datetime": wall_clock(day, F.col("time_observations_started"), tz),
        }
    )


def with_parsed_count(df: DataFrame) -> DataFrame:
    return df.withColumn("observation_count", parse_count(F.col("observation_count")))


def rename_block(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"atlas_block": "pba3_block"})


def strip_prefix(df: DataFrame, prefix: str, containing: str = "") -> DataFrame:
    """Drop a prefix from the names of the columns that contain a text."""
    renames = {c: c.replace(prefix, "", 1) for c in df.columns if containing in c and prefix in c}
    return df.withColumnsRenamed(renames)


def with_rank(df: DataFrame) -> DataFrame:
    """Attach description and rank; an unknown category gets nulls."""
    category = F.col("breeding_category")
    return df.withColumns({"breeding_category_desc": description_of(category), "breeding_rank": rank_of(category)})


def with_rank_of_description(df: DataFrame, desc: str, rank: str) -> DataFrame:
    return df.withColumn(rank, rank_of_description(F.col(desc)))


def rename_species(df: DataFrame) -> DataFrame:
    return df.withColumn("common_name", current_species_name(F.col("common_name")))


def rename_categories(df: DataFrame) -> DataFrame:
    return df.withColumn("breeding_category_desc", current_category_name(F.col("breeding_category_desc")))


def drop_unnamed_species(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("common_name").contains("N/A"))


def date_extent(df: DataFrame) -> DataFrame:
    day = F.col("observation_date")
    return df.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def rows_at_latest_date(df: DataFrame) -> DataFrame:
    """Rows of the most recent date: the maximum is a scalar subquery, the rows are not moved."""
    latest = df.agg(F.max("observation_date")).scalar()
    return df.filter(F.col("observation_date") == latest)


def release_end(df: DataFrame, label: Column | str = "release") -> DataFrame:
    label = F.col(label) if isinstance(label, str) else label
    return df.withColumn("release_end", release_month_end(label))


def prepare_sightings(
    raw: DataFrame,
    project: str | None = None,
    start=SURVEY_START,
    release: str | None = None,
    tz: str = SURVEY_TZ,
) -> DataFrame:
    """Raw rows to the processed sightings table, all of it before any shuffle but the collapse."""
    df = in_date_range(raw, start) if release is None else up_to_release(raw, release, start)
    if project is not None:
        df = in_project(df, project)
    df = clean_codes(df)
    if {"group_id", "event_id"} <= set(df.columns):
        df = collapse_shared(df)
    if "taxon_category" in df.columns:
        df = roll_up_taxa(df)
    return rename_block(with_observation_times(df, tz))
