"""All block metrics for all seasons in one plan.

The sightings are read at three grains, each pruned to its own columns and
reduced map-side before its shuffle:

* checklist grain (block, checklist, lon, lat): effort, day/night, months
  covered, checklist count, with one set of conditional maxima per season;
* species grain (block, species): observed, coded and nocturnal species, with
  one set of conditional aggregates per season as well;
* observer grain (block, observer, month): observers.

A month belongs to several seasons, so rows are fanned out to seasons only
after this reduction, and then aggregated again. Everything that has to
survive the second step is a max, a sum, a distinct key or a bit mask, so the
result is exact even for a checklist whose copies disagree on the month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import seasons_of
from ..functions.times import month_bit
from ..lookups import DAY_NIGHT, MONTHS, SEASONS, SURVEY_TZ
from .daylight import join_daylight, with_day_night_label, with_daylight
from .joins import in_season, left_join_all, null_safe_join, with_block_attributes
from .metrics import BLOCK, category_counts
from .starttime import fixed_start_times, with_fixed_start

KEYS = ["season", BLOCK]
HOURS = [f"duration_hours_{label}" for label in DAY_NIGHT]
BREEDING_MASK = sum(1 << (MONTHS.index(m) + 1) for m in SEASONS["Breeding"])


def _fan_out(df: DataFrame, seasons: dict[str, list[str]]) -> DataFrame:
    others = [c for c in df.columns if c != "observation_month"]
    return df.select(F.explode(seasons_of(F.col("observation_month"), seasons)).alias("season"), *others)


def _checklist_branch(x: DataFrame, fixed: DataFrame, daylight: DataFrame | None, seasons, tz: str) -> DataFrame:
    month, start = F.col("observation_month"), F.col("observation_datetime")
    per_season = []
    for i, months in enumerate(seasons.values()):
        inside = month.isin(*months)
        per_season += [
            F.bool_or(inside).alias(f"seen_{i}"),
            F.max(F.when(inside, F.col("duration_minutes"))).alias(f"minutes_{i}"),
            F.max(F.when(inside, F.col("effort_distance_km"))).alias(f"km_{i}"),
            F.bit_or(F.when(inside, month_bit(start))).alias(f"months_{i}"),
        ]
    by_place = x.groupBy(BLOCK, "checklist_id", "longitude", "latitude").agg(
        F.min(start).alias("observation_datetime"), *per_season
    )
    # One date per checklist, so a block's date holds its checklists whole. Rows are dealt out by both before the
    # fan-out: no stage holds the sorts of the joins and the checklists of every season at once.
    date = F.max(F.to_date("observation_datetime")).over(Window.partitionBy("checklist_id"))
    started = with_fixed_start(by_place, fixed).withColumn("observation_date", date)
    lit = with_daylight(started, tz) if daylight is None else join_daylight(started, daylight)
    seen = [
        F.when(
            F.col(f"seen_{i}"),
            F.struct(
                F.lit(season).alias("season"),
                F.col(f"minutes_{i}").alias("minutes"),
                F.col(f"km_{i}").alias("km"),
                F.col(f"months_{i}").alias("months"),
            ),
        )
        for i, season in enumerate(seasons)
    ]
    dealt = (
        with_day_night_label(lit)
        .drop("longitude", "latitude", "observation_datetime", "sunrise", "sunset")
        .repartition(BLOCK, "observation_date")
    )
    fanned = (
        dealt.select(BLOCK, "observation_date", "checklist_id", "checklist_type", F.explode(F.array(*seen)).alias("s"))
        .filter("s IS NOT NULL")
        .select(BLOCK, "observation_date", "checklist_id", "checklist_type", "s.*")
    )
    # the label depends on the place
    minutes = F.coalesce("minutes", F.lit(0.0))
    by_checklist = fanned.groupBy(*KEYS, "observation_date", "checklist_id").agg(
        F.max("minutes").alias("total_minutes"),
        F.max("km").alias("km"),
        F.bit_or("months").alias("months"),
        *[F.sum(F.when(F.col("checklist_type") == label, minutes)).alias(label) for label in DAY_NIGHT],
    )
    by_date = by_checklist.groupBy(*KEYS, "observation_date").agg(
        F.count("*").alias("checklists"),
        F.sum("total_minutes").alias("total_minutes"),
        F.sum("km").alias("km"),
        F.bit_or("months").alias("months"),
        *[(F.sum(label) / 60).alias(f"duration_hours_{label}") for label in DAY_NIGHT],
    )
    covered = F.bit_count(F.bit_or("months").bitwiseAND(F.lit(BREEDING_MASK))).cast("bigint")
    return by_date.groupBy(*KEYS).agg(
        F.sum("checklists").alias("checklist_count"),
        (F.coalesce(F.sum("total_minutes"), F.lit(0.0)) / 60).alias("duration_hours_total"),
        F.coalesce(F.sum("km"), F.lit(0.0)).alias("effort_distance_km"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in HOURS],
        F.sort_array(F.collect_list(F.struct("observation_date", *HOURS))).alias("effort_breakdown"),
        F.nullif(covered, F.lit(0)).alias("breeding_season_months_covered"),
    )


def _species_branch(x: DataFrame, nocturnal: DataFrame, seasons) -> DataFrame:
    rank, month = F.col("breeding_rank"), F.col("observation_month")
    per_season = []
    for i, months in enumerate(seasons.values()):
        inside = month.isin(*months)
        per_season += [
            F.bool_or(inside).alias(f"seen_{i}"),
            F.max(F.when(inside, rank)).alias(f"best_{i}"),
            F.count_if(inside & rank.isNull()).alias(f"unknown_{i}"),
        ]
    seen = [
        F.when(
            F.col(f"seen_{i}"),
            F.struct(F.lit(season).alias("season"), F.col(f"best_{i}").alias("best"), F.col(f"unknown_{i}").alias("unknown")),
        )
        for i, season in enumerate(seasons)
    ]
    by_species = (
        x.groupBy(BLOCK, "common_name")
        .agg(*per_season)
        .select(BLOCK, "common_name", F.explode(F.array(*seen)).alias("s"))
        .filter("s IS NOT NULL")
        .select(BLOCK, "common_name", "s.*")
    )
    listed = nocturnal.select("common_name", F.lit(True).alias("listed")).distinct()
    flagged = by_species.join(listed, "common_name", "left").withColumn(
        "coded_rank", F.when(F.col("unknown") == 0, F.col("best"))
    )
    return flagged.groupBy(*KEYS).agg(
        F.count("*").alias("species_observed"),
        F.count_if(F.col("listed") & (F.col("best") >= 2)).alias("nocturnal_species_coded"),
        *category_counts("coded_rank"),
    )


def _observer_branch(x: DataFrame, seasons) -> DataFrame:
    lists = x.select(BLOCK, "observation_month", "observer_id").distinct()
    observers = lists.select(
        BLOCK, "observation_month", F.explode_outer(F.split("observer_id", ",")).alias("observer")
    )
    return _fan_out(observers, seasons).distinct().groupBy(*KEYS).agg(F.count("*").alias("birders"))


def summarize_all_seasons(
    x: DataFrame,
    nocturnal: DataFrame,
    fixed: DataFrame | None = None,
    daylight: DataFrame | None = None,
    seasons: dict[str, list[str]] = SEASONS,
    tz: str = SURVEY_TZ,
) -> DataFrame:
    """One row per (season, block) with all metrics; x is sightings with ranks attached."""
    fixed = fixed_start_times(x) if fixed is None else fixed
    parts = [
        _checklist_branch(x, fixed, daylight, seasons, tz),
        _species_branch(x, nocturnal, seasons),
        _observer_branch(x, seasons),
    ]
    return left_join_all(parts, KEYS)


def summarize_season(
    x: DataFrame,
    season: str,
    nocturnal: DataFrame,
    fixed: DataFrame | None = None,
    daylight: DataFrame | None = None,
    tz: str = SURVEY_TZ,
) -> DataFrame:
    """The metrics of one season, one row per block.

    Only that season's months are read. Start times are settled over all of a
    checklist's rows, so they come from the unfiltered table.
    """
    fixed = fixed_start_times(x) if fixed is None else fixed
    only = {season: SEASONS[season]}
    return summarize_all_seasons(in_season(x, season), nocturnal, fixed, daylight, only, tz).drop("season")


def block_mart(summary: DataFrame, block_map: DataFrame, comparison: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mapped polygons x seasons, with survey comparison and block attributes.

    A polygon without a new block meets the summary of block-less checklists
    (null matches null), and the polygon-to-block mapping may be many to many.
    """
    mapped = null_safe_join(block_map, summary, [BLOCK], "left")
    compared = null_safe_join(mapped, comparison, [BLOCK, "season"], "left")
    return with_block_attributes(compared, blocks, county_default=False)


