"""Block metrics as a cube of months: mergeable state from which every season is a union.

The state of a (block, month) is small and closed under union:

* effort: sums per date over the checklists that lie in this month alone;
* several: one row per place and month of a checklist whose rows lie in several
  months; its largest values are only known once the season's months meet;
* species and observers: sets, as bitmaps over dense ids, one row per 32,768
  ids. Ranks are sets too: the species of at least a rank. A species with an
  unknown rank is in every one of those sets but not counted, so that the union
  of months still leaves it out.

A season is the union of its months; a late or corrected month replaces its own
rows and leaves the others as they are. Months are told by year, so that a
refresh touches no month of another year.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import seasons_of
from ..functions.times import month_bit
from ..lookups import CATEGORY_NAMES, DAY_NIGHT, SEASONS, SURVEY_TZ
from .daylight import join_daylight, with_day_night_label, with_daylight
from .joins import left_join_all, null_safe_join
from .metrics import BLOCK
from .season import BREEDING_MASK, HOURS, KEYS
from .starttime import fixed_start_times, with_fixed_start

MONTH = "month_start"
CELL = [BLOCK, MONTH, "observation_month"]
RANKED = [f"from_{i}" for i in range(1, len(CATEGORY_NAMES))]
#: Parts in which new ids are counted; ids are dense over all of them.
ID_PARTS = 64


@dataclass(frozen=True)
class MonthCube:
    """Tables of the cube, and the ids its bitmaps count by."""

    effort: DataFrame  # block, month, date: sums over checklists
    several: DataFrame  # block, month, checklist, place: checklists of several months
    species: DataFrame  # block, month, bucket: bitmaps seen, unknown, from_1 .. from_4
    observers: DataFrame  # block, month, bucket: bitmap seen
    species_ids: DataFrame  # common_name, id
    observer_ids: DataFrame  # observer, id

    def states(self) -> list[str]:
        return [f.name for f in fields(self) if not f.name.endswith("_ids")]


def dense_ids(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(value, id) for each distinct value of a one-column frame; ``known`` ids stay, new ones follow without gaps.

    Numbered within hashed parts and moved on by the sizes of the parts before,
    so no task sorts all values. A null is a value.
    """
    name = values.columns[0]
    new = values.distinct()
    if known is not None:
        new = null_safe_join(new, known.select(name), [name], "left_anti")
    parted = new.withColumn("part", F.pmod(F.xxhash64(name), F.lit(ID_PARTS)))
    sizes = parted.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over at most ID_PARTS rows
    first = F.lit(0) if known is None else F.coalesce(known.agg(F.max("id") + 1).scalar(), F.lit(0))
    offsets = sizes.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + first).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1
    ids = parted.withColumn("place", place).join(offsets, "part").select(name, (F.col("offset") + F.col("place")).cast("bigint").alias("id"))
    return ids if known is None else known.select(name, "id").unionByName(ids)


def _with_month(x: DataFrame) -> DataFrame:
    return x.withColumn(MONTH, F.trunc("observation_date", "MM"))


def _labelled(x: DataFrame, fixed: DataFrame, daylight: DataFrame | None, tz: str) -> DataFrame:
    """One row per (month, checklist, place) with its label and whether the checklist lies in several months."""
    start = F.col("observation_datetime")
    places = x.groupBy(*CELL, "checklist_id", "longitude", "latitude").agg(
        F.min(start).alias("observation_datetime"), F.max("duration_minutes").alias("minutes"),
        F.max("effort_distance_km").alias("km"), F.bit_or(month_bit(start)).alias("months"))
    # A checklist has few months and places, so these windows stay small; both nest in its partitioning.
    place = Window.partitionBy("checklist_id", BLOCK, "longitude", "latitude")
    whole = Window.partitionBy("checklist_id", BLOCK)
    cell = F.struct(MONTH, "observation_month")
    wide = places.withColumns({
        "observation_datetime": F.min("observation_datetime").over(place),
        "several": F.min(cell).over(whole) != F.max(cell).over(whole)})
    started = with_fixed_start(wide, fixed)
    lit = with_daylight(started, tz) if daylight is None else join_daylight(started, daylight)
    return with_day_night_label(lit).select(
        *CELL, "checklist_id", "longitude", "latitude", "checklist_type", "several", "minutes", "km", "months",
        F.to_date("observation_datetime").alias("observation_date"))


def _by_date(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per (keys, date) over checklists, each with its largest values."""
    minutes = F.coalesce("minutes", F.lit(0.0))
    by_checklist = labelled.groupBy(*keys, "checklist_id").agg(
        F.max("observation_date").alias("observation_date"), F.max("minutes").alias("total_minutes"), F.max("km").alias("km"),
        F.bit_or("months").alias("months"),
        *[F.sum(F.when(F.col("checklist_type") == label, minutes)).alias(label) for label in DAY_NIGHT])
    return by_checklist.groupBy(*keys, "observation_date").agg(
        F.count("*").alias("checklists"), F.sum("total_minutes").alias("total_minutes"), F.sum("km").alias("km"),
        F.bit_or("months").alias("months"), *[F.sum(label).alias(label) for label in DAY_NIGHT])


def _set_of(inside: Column) -> Column:
    return F.bitmap_construct_agg(F.when(inside, F.bitmap_bit_position("id")))


def _in_buckets(numbered: DataFrame):
    """Rows with ids, grouped by cell and bucket.

    Dealt out before the sets are built: a cell's bucket has at most 32,768
    rows of a few bytes, while sets combined on the map side are 4 KB each.
    """
    return numbered.withColumn("bucket", F.bitmap_bucket_number("id")).repartition(*CELL, "bucket").groupBy(*CELL, "bucket")


def _species(x: DataFrame, ids: DataFrame) -> DataFrame:
    rank = F.col("breeding_rank")
    best = x.groupBy(*CELL, "common_name").agg(F.max(rank).alias("best"), F.bool_or(rank.isNull()).alias("unknown"))
    return _in_buckets(null_safe_join(best, ids, ["common_name"], "inner")).agg(
        _set_of(F.lit(True)).alias("seen"), _set_of(F.col("unknown")).alias("unknown"),
        _set_of(F.col("best") >= 2).alias("coded"),
        *[_set_of(F.col("unknown") | (F.col("best") >= i)).alias(c) for i, c in enumerate(RANKED, 1)])


def _observer_lists(x: DataFrame) -> DataFrame:
    lists = x.select(*CELL, "observer_id").distinct()
    return lists.select(*CELL, F.explode_outer(F.split("observer_id", ",")).alias("observer"))


def _observers(seen: DataFrame, ids: DataFrame) -> DataFrame:
    return _in_buckets(null_safe_join(seen, ids, ["observer"], "inner")).agg(_set_of(F.lit(True)).alias("seen"))


def build_cube(x: DataFrame, fixed: DataFrame | None = None, daylight: DataFrame | None = None, tz: str = SURVEY_TZ,
               species_ids: DataFrame | None = None, observer_ids: DataFrame | None = None,
               keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> MonthCube:
    """The cube of sightings with ranks; ids given are kept, those of new species and observers are added.

    Hand in a written table bucketed by checklist_id: start votes, places and
    checklists then need no exchange. ``keep`` gets each table's name and rows
    and may write and reread them; ids are read by several tables.
    """
    x = _with_month(x)
    species_ids = keep("species_ids", dense_ids(x.select("common_name"), species_ids))
    # Ids and sets come from the observers of each cell, so the sightings are read for them once.
    observers = keep("cell_observers", _observer_lists(x).distinct())
    observer_ids = keep("observer_ids", dense_ids(observers.select("observer"), observer_ids))
    labelled = keep("labelled", _labelled(x, fixed_start_times(x) if fixed is None else fixed, daylight, tz))
    effort = keep("effort", _by_date(labelled.filter("not several"), CELL))
    several = keep("several", labelled.filter("several").drop("several"))
    return MonthCube(effort, several, keep("species", _species(x, species_ids)),
                     keep("observers", _observers(observers, observer_ids)), species_ids, observer_ids)


def changed_months(x: DataFrame, months: list, cube: MonthCube | None = None) -> list:
    """The months that have to be built anew when the rows of ``months`` have changed, in order.

    A checklist of several months ties them together: whether it is summed in
    one month or kept apart depends on all of its rows. So months are added
    until none shares a checklist with one outside, by the sightings or by what
    the cube once held. Only months reach the driver.
    """
    month = F.trunc("observation_date", "MM").alias("m")
    placed = x.select("checklist_id", month)
    if cube is not None:
        placed = placed.unionByName(cube.several.select("checklist_id", F.col(MONTH).alias("m")))
    found = sorted(set(months))
    while True:
        inside = placed.filter(F.col("m").isin(*found)).select("checklist_id").distinct()
        outside = placed.filter(~F.col("m").isin(*found)).join(inside, "checklist_id", "left_semi").select("m").distinct()
        more = [r.m for r in outside.collect()]
        if not more:
            return found
        found = sorted({*found, *more})


def changed_rows(x: DataFrame, months: list) -> DataFrame:
    """The sightings of some months; months are listed, so the scan of a table kept by month is pruned."""
    return x.filter(F.trunc("observation_date", "MM").isin(*months))


def merge_cubes(old: MonthCube, new: MonthCube) -> MonthCube:
    """``old`` with the months of ``new`` in place of its own.

    ``new`` must be built with the ids of ``old``. A month without any row left
    is not in ``new``; drop it with ``without_months`` first.
    """
    months = new.effort.select(MONTH).unionByName(new.several.select(MONTH)).distinct()
    parts = {}
    for name in old.states():
        kept = null_safe_join(getattr(old, name), months, [MONTH], "left_anti")
        parts[name] = kept.unionByName(getattr(new, name))
    return replace(new, **parts)


def without_months(cube: MonthCube, months: list) -> MonthCube:
    """The cube without the rows of some months."""
    outside = ~F.coalesce(F.col(MONTH).isin(*months), F.lit(False))
    return replace(cube, **{name: getattr(cube, name).filter(outside) for name in cube.states()})


def _fan_out(df: DataFrame, seasons: dict[str, list[str]]) -> DataFrame:
    others = [c for c in df.columns if c not in (MONTH, "observation_month")]
    return df.select(F.explode(seasons_of(F.col("observation_month"), seasons)).alias("season"), *others)


def _season_effort(cube: MonthCube, seasons: dict[str, list[str]]) -> DataFrame:
    several = _by_date(_fan_out(cube.several, seasons).groupBy(*KEYS, "checklist_id", "longitude", "latitude").agg(
        F.max("minutes").alias("minutes"), F.max("km").alias("km"), F.bit_or("months").alias("months"),
        F.max("checklist_type").alias("checklist_type"), F.max("observation_date").alias("observation_date")), KEYS)
    by_date = _fan_out(cube.effort, seasons).unionByName(several).groupBy(*KEYS, "observation_date").agg(
        F.sum("checklists").alias("checklists"), F.sum("total_minutes").alias("total_minutes"), F.sum("km").alias("km"),
        F.bit_or("months").alias("months"),
        *[(F.sum(label) / 60).alias(f"duration_hours_{label}") for label in DAY_NIGHT])
    covered = F.bit_count(F.bit_or("months").bitwiseAND(F.lit(BREEDING_MASK))).cast("bigint")
    return by_date.groupBy(*KEYS).agg(
        F.sum("checklists").alias("checklist_count"),
        (F.coalesce(F.sum("total_minutes"), F.lit(0.0)) / 60).alias("duration_hours_total"),
        F.coalesce(F.sum("km"), F.lit(0.0)).alias("effort_distance_km"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in HOURS],
        F.sort_array(F.collect_list(F.struct("observation_date", *HOURS))).alias("effort_breakdown"),
        F.nullif(covered, F.lit(0)).alias("breeding_season_months_covered"))


def _season_species(cube: MonthCube, nocturnal: DataFrame, seasons: dict[str, list[str]]) -> DataFrame:
    listed_ids = cube.species_ids.join(nocturnal.select("common_name").distinct(), "common_name", "left_semi")
    listed = listed_ids.groupBy(F.bitmap_bucket_number("id").alias("l_bucket")).agg(_set_of(F.lit(True)).alias("listed"))
    sets = ["seen", "unknown", "coded", *RANKED]
    united = _fan_out(cube.species, seasons).groupBy(*KEYS, "bucket").agg(*[F.bitmap_or_agg(c).alias(c) for c in sets])
    # Sizes of unions and differences from the sizes of sets: the listed among the coded need one intersection.
    both = united.join(listed, F.col("bucket") == F.col("l_bucket")).select(
        *KEYS, "bucket", F.explode(F.array("coded", "listed")).alias("set"))
    common = both.groupBy(*KEYS, "bucket").agg(F.bitmap_count(F.bitmap_and_agg("set")).alias("n")).groupBy(*KEYS).agg(
        F.sum("n").alias("listed_coded"))
    sizes = united.select(*KEYS, *[F.bitmap_count(c).alias(c) for c in sets]).groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in sets])
    bounds = [F.col("seen"), *[F.col(c) for c in RANKED], F.col("unknown")]
    counts = [F.nullif(a - b, F.lit(0)).alias(desc) for a, b, desc in zip(bounds, bounds[1:], CATEGORY_NAMES)]
    return null_safe_join(sizes, common, KEYS, "left").select(
        *KEYS, F.col("seen").alias("species_observed"),
        F.coalesce("listed_coded", F.lit(0)).cast("bigint").alias("nocturnal_species_coded"), *counts)


def _season_observers(cube: MonthCube, seasons: dict[str, list[str]]) -> DataFrame:
    united = _fan_out(cube.observers, seasons).groupBy(*KEYS, "bucket").agg(F.bitmap_or_agg("seen").alias("seen"))
    return united.groupBy(*KEYS).agg(F.sum(F.bitmap_count("seen")).alias("birders"))


def seasons_of_cube(cube: MonthCube, nocturnal: DataFrame, seasons: dict[str, list[str]] = SEASONS) -> DataFrame:
    """One row per (season, block) with all metrics, from the cube alone."""
    return left_join_all(
        [_season_effort(cube, seasons), _season_species(cube, nocturnal, seasons), _season_observers(cube, seasons)], KEYS)
