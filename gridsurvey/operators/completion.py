"""Completion criteria, progress table and the block reports read from the mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import all_true, ratio
from ..lookups import COMPLETION_THRESHOLDS
from .joins import in_season
from .metrics import BLOCK

PROGRESS_COLUMNS = [
    BLOCK,
    "block_name",
    "block_region",
    "block_county",
    "season",
    "species_observed",
    "Observed",
    "Possible",
    "Probable",
    "Confirmed",
    "checklist_count",
    "birders",
    "duration_hours_total",
    "duration_hours_diurnal",
    "duration_hours_nocturnal",
    "duration_hours_unknown",
    "effort_distance_km",
    "pct_missing_pba2_confirmations",
    "pct_coded_atlas_comparison",
    "pba3_pba2_coded_count_compare_pct",
    "breeding_season_months_covered",
    "nocturnal_species_coded",
]


def by_block_name(df: DataFrame) -> DataFrame:
    """Sorted by region, county and name, missing values last."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in ("block_region", "block_county", "block_name")])


def progress_table(mart: DataFrame, season: str) -> DataFrame:
    """One season's block rows, total hours and kilometres at two decimals."""
    rows = mart.filter(F.col("season") == season).select(*PROGRESS_COLUMNS)
    rounded = rows.withColumns(
        {c: F.round(c, 2) for c in ("duration_hours_total", "effort_distance_km")}
    )
    return by_block_name(rounded).drop("season")


def completion_table(
    mart: DataFrame,
    comparison: DataFrame | None = None,
    thresholds: dict | None = None,
    season: str = "All seasons",
    season_matched: bool = False,
) -> DataFrame:
    """Seven criteria per block and their conjunction, in three-valued logic.

    The survey comparison exists for the Breeding season only. By default its
    ratio is taken by block from ``comparison``; ``season_matched=True`` reads
    the mart's own column, which is null for any other season.
    """
    t = {**COMPLETION_THRESHOLDS, **(thresholds or {})}
    rows = mart.filter((F.col("season") == season) & F.col(BLOCK).isNotNull())
    if not season_matched:
        if comparison is None:
            raise ValueError("comparison is needed unless season_matched")
        share = comparison.select(BLOCK, "pba3_pba2_coded_count_compare_pct")
        rows = rows.drop("pba3_pba2_coded_count_compare_pct").join(share, BLOCK, "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("Possible", "Probable", "Confirmed")}
    coded = rows.withColumns(counts).withColumn("species_coded", F.col("Possible") + F.col("Probable") + F.col("Confirmed"))
    flags = {
        "flag_coded_species": F.col("species_coded") >= t["coded_species"],
        "flag_confirmed_pct": ratio(F.col("Confirmed"), F.col("species_coded")) >= t["confirmed_share"],
        "flag_possible_pct": ratio(F.col("Possible"), F.col("species_coded")) < t["possible_share"],
        "flag_coded_atlas_comparison": F.col("pba3_pba2_coded_count_compare_pct") >= t["coded_ratio"],
        "flag_20_effort_hours": F.round("duration_hours_total", 2) >= t["effort_hours"],
        "flag_breeeding_season_coverage": F.col("breeding_season_months_covered") >= t["breeding_months"],
        "flag_nocturnal_coverage": (F.col("nocturnal_species_coded") >= t["nocturnal_species"])
        | (F.col("duration_hours_nocturnal") >= t["nocturnal_hours"]),
    }
    flagged = coded.withColumns(flags).withColumn("all_criteria_complete", all_true(*[F.col(f) for f in flags]))
    return by_block_name(flagged).select(BLOCK, "block_name", "block_county", "all_criteria_complete", *flags)


def region_blocks(mart: DataFrame) -> DataFrame:
    """Distinct (region, block, name) of known regions, sorted."""
    return (
        mart.filter("block_region <> 'Unknown region'")
        .select("block_region", BLOCK, "block_name")
        .distinct()
        .orderBy("block_region", F.asc_nulls_last(BLOCK))
    )


def region_hierarchy(mart: DataFrame) -> DataFrame:
    """Region -> map of block name to the sorted ids of the blocks that bear it.

    Built from the block dimension after ``distinct``: a map holds one id per
    grid cell of the region, whatever the number of sightings.
    """
    named = region_blocks(mart).filter("block_name is not null").groupBy("block_region", "block_name").agg(
        F.sort_array(F.collect_set(BLOCK)).alias("ids"))
    entries = F.sort_array(F.collect_list(F.struct("block_name", "ids")))
    return named.groupBy("block_region").agg(F.map_from_entries(entries).alias("blocks"))


def block_summary(mart: DataFrame, block: str, season: str) -> DataFrame:
    """The mart row(s) of one block and season; both filters reach the scan."""
    return mart.filter((F.col(BLOCK) == block) & (F.col("season") == season))


def block_sightings(x: DataFrame, block: str, season: str) -> DataFrame:
    """One block's sightings in a season."""
    return in_season(x.filter(F.col(BLOCK) == block), season)


def unnest_breakdown(mart: DataFrame) -> DataFrame:
    """(block, season) with one row per date of the nested effort table."""
    return mart.select(BLOCK, "season", F.inline("effort_breakdown"))
