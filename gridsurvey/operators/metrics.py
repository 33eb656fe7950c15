"""Per-block metrics of a sightings table.

Each function takes sightings and returns one row per block; a missing block
is a block of its own. Distinct counts are written as ``distinct`` followed by
a count, so the first step spreads a hot block over its checklists, species or
observers and combines map-side; a block never has to fit in one task.
:mod:`.season` computes all of them together for all seasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import month_bit
from ..lookups import CATEGORY_NAMES, DAY_NIGHT, MONTHS, SEASONS
from .daylight import join_daylight, with_daylight, with_day_night_label
from .joins import null_safe_join
from .starttime import with_fixed_start

BLOCK = "pba3_block"


def calc_checklist_count(x: DataFrame) -> DataFrame:
    """Distinct checklists per block."""
    return x.select(BLOCK, "checklist_id").distinct().groupBy(BLOCK).agg(F.count("*").alias("checklist_count"))


def calc_species_observed(x: DataFrame) -> DataFrame:
    """Distinct species per block."""
    return x.select(BLOCK, "common_name").distinct().groupBy(BLOCK).agg(F.count("*").alias("species_observed"))


def calc_atlasers(x: DataFrame) -> DataFrame:
    """Distinct observers per block.

    The comma list is split without trimming; a missing list counts as one
    observer. Lists are made distinct before they are exploded.
    """
    return (
        x.select(BLOCK, "observer_id")
        .distinct()
        .select(BLOCK, F.explode_outer(F.split("observer_id", ",")).alias("observer"))
        .distinct()
        .groupBy(BLOCK)
        .agg(F.count("*").alias("birders"))
    )


def calc_block_effort(x: DataFrame) -> DataFrame:
    """Hours and kilometres per block, each checklist counted once with its largest values."""
    return (
        x.groupBy(BLOCK, "checklist_id")
        .agg(F.max("duration_minutes").alias("minutes"), F.max("effort_distance_km").alias("km"))
        .groupBy(BLOCK)
        .agg(
            (F.coalesce(F.sum("minutes"), F.lit(0.0)) / 60).alias("duration_hours_total"),
            F.coalesce(F.sum("km"), F.lit(0.0)).alias("effort_distance_km"),
        )
    )


def best_rank(x: DataFrame, keys: list[str], out: str = "breeding_rank") -> DataFrame:
    """Highest rank per group; a group holding an unknown rank is left out whole."""
    return (
        x.groupBy(*keys)
        .agg(F.max("breeding_rank").alias(out), F.count_if(F.col("breeding_rank").isNull()).alias("__unknown"))
        .filter("__unknown = 0")
        .drop("__unknown")
    )


def category_counts(rank: str = "breeding_rank") -> list:
    """Aggregates counting rows per category, one column each; a category without rows is null.

    Conditional counts over the fixed category list give the same result as a
    pivot, within the aggregate at hand.
    """
    return [F.nullif(F.count_if(F.col(rank) == i), F.lit(0)).alias(desc) for i, desc in enumerate(CATEGORY_NAMES)]


def calc_species_coded(x: DataFrame) -> DataFrame:
    """Species per block by their highest category."""
    return best_rank(x, [BLOCK, "common_name"]).groupBy(BLOCK).agg(*category_counts())


def checklist_effort(x: DataFrame, fixed: DataFrame, daylight: DataFrame | None = None, *extra: str) -> DataFrame:
    """One row per (block, checklist, lon, lat): start, minutes, daylight and label.

    The start is the modal one where the checklist has several. Minutes are
    the largest reported, 0 if none was. Without a daylight table the solar
    formulas run inline, which needs no join.
    """
    grouped = x.groupBy(BLOCK, "checklist_id", "longitude", "latitude", *extra).agg(
        F.min("observation_datetime").alias("observation_datetime"),
        F.coalesce(F.max("duration_minutes"), F.lit(0.0)).alias("duration_minutes"),
    )
    started = with_fixed_start(grouped, fixed)
    lit = with_daylight(started) if daylight is None else join_daylight(started, daylight)
    return with_day_night_label(lit)


def _hours_by_label(df: DataFrame, keys: list[str]) -> DataFrame:
    hours = [
        (F.sum(F.when(F.col("checklist_type") == label, F.col("duration_minutes"))) / 60).alias(f"duration_hours_{label}")
        for label in DAY_NIGHT
    ]
    return df.groupBy(*keys).agg(*hours)


def calc_nocturnal_diurnal_effort(x: DataFrame, y: DataFrame, z: DataFrame | None = None) -> DataFrame:
    """Day, night and unknown hours per block, with the same by date nested in ``effort_breakdown``.

    x: sightings, y: fixed start times, z: daylight table (None: inline).
    Hours per date stay null where a label has no checklist; the block totals
    turn null to 0. One pass: the totals are sums over the per-date rows.
    """
    labelled = checklist_effort(x, y, z).withColumn("observation_date", F.to_date("observation_datetime"))
    return nest_breakdown(_hours_by_label(labelled, [BLOCK, "observation_date"]), [BLOCK])


def nest_breakdown(by_date: DataFrame, keys: list[str]) -> DataFrame:
    """Per-date hours to totals and a date-ordered array of structs.

    The array holds one element per survey date at most, however many
    checklists the block has.
    """
    names = [f"duration_hours_{label}" for label in DAY_NIGHT]
    totals = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]
    nested = F.sort_array(F.collect_list(F.struct("observation_date", *names))).alias("effort_breakdown")
    return by_date.groupBy(*keys).agg(*totals, nested)


def calc_breeding_season_coverage(x: DataFrame, season: str = "Breeding") -> DataFrame:
    """Distinct months of the season with a timed checklist; blocks without any are absent."""
    mask = sum(1 << (MONTHS.index(m) + 1) for m in SEASONS[season])
    months = F.bit_count(F.bit_or(month_bit(F.col("observation_datetime"))).bitwiseAND(F.lit(mask)))
    return (
        x.groupBy(BLOCK)
        .agg(months.cast("bigint").alias("breeding_season_months_covered"))
        .filter("breeding_season_months_covered > 0")
    )


def calc_nocturnal_species_coded(x: DataFrame, y: DataFrame) -> DataFrame:
    """Distinct listed species with a rank of 2 or more; 0 for blocks without any.

    x is reduced to one row per (block, species) before it meets the list, so
    the join never moves sightings.
    """
    best = x.groupBy(BLOCK, "common_name").agg(F.max("breeding_rank").alias("best"))
    listed = y.select("common_name", F.lit(True).alias("__listed")).distinct()
    coded = F.col("__listed") & (F.col("best") >= 2)
    return (
        best.join(listed, "common_name", "left")
        .groupBy(BLOCK)
        .agg(F.count_if(coded).alias("nocturnal_species_coded"))
    )


def summarize_breeding_codes(x: DataFrame) -> DataFrame:
    """Category counts of block rows as (Code, Count)."""
    names = ["Confirmed", "Probable", "Possible", "Observed"]
    return x.select(*names).unpivot([], names, "Code", "Count")


def summarize_effort(x: DataFrame) -> DataFrame:
    """Hour totals of block rows as (Effort type, Value), two decimals."""
    names = {"Total": "total", "Diurnal": "diurnal", "Nocturnal": "nocturnal", "Unknown": "unknown"}
    wide = x.select(*[F.col(f"duration_hours_{v}").alias(k) for k, v in names.items()])
    return wide.unpivot([], list(names), "Effort type", "Value").withColumn("Value", F.round("Value", 2))


def effort_naive(x: DataFrame) -> DataFrame:
    """Effort per block over distinct (checklist, minutes, km) rows, copies counted each."""
    return (
        x.select(BLOCK, "checklist_id", "duration_minutes", "effort_distance_km")
        .distinct()
        .groupBy(BLOCK)
        .agg(
            (F.coalesce(F.sum("duration_minutes"), F.lit(0.0)) / 60).alias("duration_hours_total_naive"),
            F.coalesce(F.sum("effort_distance_km"), F.lit(0.0)).alias("effort_distance_km_naive"),
        )
    )


def effort_adjusted(x: DataFrame) -> DataFrame:
    """Effort per block with the largest values per checklist, and the earliest start."""
    return (
        x.groupBy(BLOCK, "checklist_id")
        .agg(
            F.min("observation_datetime").alias("observation_datetime"),
            F.max("duration_minutes").alias("minutes"),
            F.max("effort_distance_km").alias("km"),
        )
        .groupBy(BLOCK)
        .agg(
            F.min("observation_datetime").alias("observation_datetime"),
            (F.coalesce(F.sum("minutes"), F.lit(0.0)) / 60).alias("duration_hours_total_adj"),
            F.coalesce(F.sum("km"), F.lit(0.0)).alias("effort_distance_km_adj"),
        )
    )


def compare_effort(naive: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Per-block difference adjusted - naive."""
    return null_safe_join(naive, adjusted, [BLOCK]).withColumns(
        {
            "duration_hours_diff": F.col("duration_hours_total_adj") - F.col("duration_hours_total_naive"),
            "effort_distance_diff": F.col("effort_distance_km_adj") - F.col("effort_distance_km_naive"),
        }
    )


def average_differences(compared: DataFrame) -> DataFrame:
    """One row: blocks compared, blocks whose effort differs, and the average differences of hours and distance."""
    hours, distance = F.col("duration_hours_diff"), F.col("effort_distance_diff")
    return compared.agg(
        F.count("*").alias("blocks"),
        F.count(F.when((hours != 0) | (distance != 0), 1)).alias("blocks_differing"),
        F.avg(hours).alias("duration_hours_diff_avg"),
        F.avg(distance).alias("effort_distance_diff_avg"),
    )


def location_counts(x: DataFrame) -> DataFrame:
    """Distinct checklists per coordinate."""
    return (
        x.select("checklist_id", "longitude", "latitude")
        .distinct()
        .groupBy("longitude", "latitude")
        .agg(F.count("*").alias("checklist_count"))
    )


def multiplicity(df: DataFrame, key: str, out: str = "groups") -> DataFrame:
    """Frequency of frequencies: how many keys have n rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias(out))


def with_group_count(df: DataFrame, keys: list[str], least: int = 2, out: str = "n") -> DataFrame:
    """Rows of groups with at least ``least`` rows, each with its group count.

    Counted by a combining aggregate and joined back, instead of a window
    that would hold a hot group in one task.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias(out)).filter(F.col(out) >= least)
    return null_safe_join(df, counts, keys, "inner")


def month_effort(breakdown: DataFrame, keys: list[str]) -> DataFrame:
    """Unnested per-date hours to sums per key, null counted as 0.

    ``keys`` may name obs_year, obs_month and obs_ym besides own columns.
    """
    names = [f"duration_hours_{label}" for label in DAY_NIGHT]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in names[1:]), F.coalesce(names[0], F.lit(0.0)))
    dated = breakdown.withColumns(
        {
            "obs_ym": F.trunc("observation_date", "MM"),
            "obs_year": F.year("observation_date"),
            "obs_month": F.date_format("observation_date", "MMM"),
            "duration_hours_total": total,
        }
    )
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in [*names, "duration_hours_total"]]
    return dated.groupBy(*keys).agg(*sums)


