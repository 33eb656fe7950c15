"""Join operators and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..lookups import season_table
from ..operators import compare, daylight, joins, metrics, starttime
from .registry import query, r6, text, with_views


def _effort(spark, sf):
    return fx.sightings(spark, sf, species=False)


@query(
    "join_season_semi",
    with_views(
        """SELECT checklist_id, observation_month, duration_minutes FROM sightings 
WHERE observation_month IN (SELECT month FROM seasons WHERE season = 'Winter')""",
        "sightings",
        "seasons",
    ),
)
def join_season_semi(spark, sf):
    df = joins.in_season_of(_effort(spark, sf), season_table(spark), "Winter")
    return df.select("checklist_id", "observation_month", "duration_minutes")


_DUPES = "SELECT checklist_id FROM (SELECT DISTINCT checklist_id, observation_datetime FROM sightings ) GROUP BY 1 HAVING count(*) > 1"


@query(
    "join_dupes_semi",
    with_views(
        f"""SELECT DISTINCT pba3_block, checklist_id, observer_id,
  strftime(observation_datetime, '%Y-%m-%d %H:%M:%S') AS observation_datetime
FROM sightings WHERE checklist_id IN ({_DUPES})""",
        "sightings",
    ),
)
def join_dupes_semi(spark, sf):
    x = _effort(spark, sf)
    rows = joins.keep_checklists(x, starttime.start_time_counts(x))
    return rows.select(
        "pba3_block", "checklist_id", "observer_id", text("observation_datetime").alias("observation_datetime")
    ).distinct()


@query(
    "join_species_semi",
    with_views(
        "SELECT checklist_id, common_name, breeding_rank FROM sightings WHERE common_name IN (SELECT common_name FROM nocturnal )",
        "sightings",
        "nocturnal",
    ),
)
def join_species_semi(spark, sf):
    df = joins.keep_species(fx.sightings(spark, sf), fx.nocturnal_species(spark, sf))
    return df.select("checklist_id", "common_name", "breeding_rank")


@query(
    "join_fixed_start",
    with_views(
        """SELECT checklist_id, strftime(coalesce(observation_datetime_fixed, observation_datetime), '%Y-%m-%d %H:%M:%S')
    AS observation_datetime, count(*) AS n
FROM sightings LEFT JOIN fixed USING (checklist_id) GROUP BY 1, 2""",
        "sightings",
        "fixed",
    ),
)
def join_fixed_start(spark, sf):
    x = _effort(spark, sf)
    df = starttime.with_fixed_start(x, starttime.fixed_start_times(x))
    return df.groupBy("checklist_id", text("observation_datetime").alias("observation_datetime")).agg(
        F.count("*").alias("n")
    )


@query(
    "join_daylight",
    with_views(
        """SELECT checklist_id, strftime(sunrise, '%Y-%m-%d %H:%M:%S') AS sunrise,
  strftime(sunset, '%Y-%m-%d %H:%M:%S') AS sunset, duration_minutes
FROM labelled WHERE season = 'All seasons'""",
        "labelled",
    ),
)
def join_daylight(spark, sf):
    """Prepared daylight table joined by value to one row per checklist and place."""
    x = _effort(spark, sf)
    places = x.groupBy("pba3_block", "checklist_id", "longitude", "latitude").agg(
        F.min("observation_datetime").alias("observation_datetime"),
        F.coalesce(F.max("duration_minutes"), F.lit(0.0)).alias("duration_minutes"),
    )
    started = starttime.with_fixed_start(places, starttime.fixed_start_times(x))
    df = daylight.join_daylight(started, daylight.daylight_table(started))
    return df.select("checklist_id", text("sunrise").alias("sunrise"), text("sunset").alias("sunset"), "duration_minutes")


@query(
    "join_months_inner",
    with_views(
        """SELECT DISTINCT pba3_block, strftime(observation_datetime, '%b') AS month, season
FROM sightings JOIN seasons ON strftime(observation_datetime, '%b') = month WHERE season = 'Breeding'""",
        "sightings",
        "seasons",
    ),
)
def join_months_inner(spark, sf):
    seen = _effort(spark, sf).select("pba3_block", F.date_format("observation_datetime", "MMM").alias("month")).distinct()
    return seen.join(season_table(spark).filter("season = 'Breeding'"), "month")


@query(
    "join_reduce_left",
    with_views(
        """SELECT a.pba3_block, checklist_count, species_observed, birders FROM
  (SELECT pba3_block, count(DISTINCT checklist_id) AS checklist_count FROM sightings GROUP BY 1) a
  LEFT JOIN (SELECT pba3_block, count(DISTINCT common_name) AS species_observed FROM sightings GROUP BY 1) b
    ON a.pba3_block IS NOT DISTINCT FROM b.pba3_block
  LEFT JOIN (SELECT pba3_block, count(DISTINCT o) AS birders FROM
    (SELECT pba3_block, unnest(string_split(observer_id, ',')) AS o FROM sightings ) GROUP BY 1) c
    ON a.pba3_block IS NOT DISTINCT FROM c.pba3_block""",
        "sightings",
    ),
)
def join_reduce_left(spark, sf):
    x = fx.sightings(spark, sf)
    tables = [metrics.calc_checklist_count(x), metrics.calc_species_observed(x), metrics.calc_atlasers(x)]
    return joins.left_join_all(tables, ["pba3_block"])


NEW_SQL = """SELECT pba3_block, common_name, max(breeding_rank) AS new_rank FROM sightings 
WHERE observation_month IN ('Apr','May','Jun','Jul','Aug') GROUP BY 1, 2 HAVING count(breeding_rank) = count(*)"""
OLD_SQL = "SELECT pba3_block, common_name, breeding_rank AS old_rank FROM old_survey JOIN categories USING (breeding_category_desc)"


def ranks(spark, sf, x=None):
    x = fx.sightings(spark, sf) if x is None else x
    return compare.old_ranks(fx.old_survey(spark, sf)), compare.new_ranks(x)


@query(
    "join_full_keys",
    with_views(
        f"""SELECT coalesce(o.pba3_block, n.pba3_block) AS pba3_block, coalesce(o.common_name, n.common_name) AS common_name,
  old_rank, new_rank
FROM ({OLD_SQL}) o FULL JOIN ({NEW_SQL}) n
  ON o.pba3_block IS NOT DISTINCT FROM n.pba3_block AND o.common_name = n.common_name""",
        "sightings",
        "old_survey",
        "categories",
    ),
)
def join_full_keys(spark, sf):
    old, new = ranks(spark, sf)
    df = joins.full_keys(old, new, ["pba3_block", "common_name"])
    return df.select(
        "pba3_block",
        "common_name",
        F.col("pba2_breeding_rank_max").alias("old_rank"),
        F.col("pba3_breeding_rank_max").alias("new_rank"),
    )


@query(
    "join_block_attrs",
    with_views(
        """SELECT s.pba3_block, coalesce(block_name, 'Unknown block name') AS block_name,
  coalesce(block_region, 'Unknown region') AS block_region, coalesce(block_county, 'Unknown county') AS block_county,
  n AS checklist_count
FROM (SELECT pba3_block, count(DISTINCT checklist_id) AS n FROM sightings GROUP BY 1) s LEFT JOIN blocks USING (pba3_block)""",
        "sightings",
        "blocks",
    ),
)
def join_block_attrs(spark, sf):
    counts = metrics.calc_checklist_count(_effort(spark, sf))
    return joins.with_block_attributes(counts, fx.blocks(spark, sf))


@query(
    "join_focal",
    with_views(
        """SELECT common_name, coalesce(is_focal, FALSE) AS is_focal, count(*) AS n
FROM sightings LEFT JOIN focal USING (common_name) GROUP BY ALL""",
        "sightings",
        "focal",
    ),
)
def join_focal(spark, sf):
    counts = fx.sightings(spark, sf).groupBy("common_name").agg(F.count("*").alias("n"))
    return joins.with_focal_flag(counts, fx.focal_species(spark, sf))


_KEYS_SQL = f"""SELECT 'left' AS only_in, pba3_block, common_name FROM
  (SELECT pba3_block, common_name FROM ({OLD_SQL}) EXCEPT SELECT pba3_block, common_name FROM ({NEW_SQL}))
UNION ALL SELECT 'right', pba3_block, common_name FROM
  (SELECT pba3_block, common_name FROM ({NEW_SQL}) EXCEPT SELECT pba3_block, common_name FROM ({OLD_SQL}))"""


@query("join_anti", with_views(_KEYS_SQL, "sightings", "old_survey", "categories"))
def join_anti(spark, sf):
    old, new = ranks(spark, sf)
    return joins.difference_both_ways(old, new, ["pba3_block", "common_name"])


@query(
    "set_difference",
    with_views(
        """SELECT 'left' AS only_in, common_name FROM (SELECT common_name FROM nocturnal EXCEPT SELECT common_name FROM focal )
UNION ALL SELECT 'right', common_name FROM (SELECT common_name FROM focal EXCEPT SELECT common_name FROM nocturnal )""",
        "nocturnal",
        "focal",
    ),
)
def set_difference(spark, sf):
    return joins.difference_both_ways(fx.nocturnal_species(spark, sf), fx.focal_species(spark, sf), ["common_name"])


@query(
    "set_union_distinct",
    with_views(
        f"""SELECT pba3_block, common_name FROM ({OLD_SQL}) UNION SELECT pba3_block, common_name FROM ({NEW_SQL})""",
        "sightings",
        "old_survey",
        "categories",
    ),
)
def set_union_distinct(spark, sf):
    old, new = ranks(spark, sf)
    return joins.union_distinct(old, new, ["pba3_block", "common_name"])


@query(
    "set_union_tagged",
    with_views(
        """SELECT 'Breeding' AS season, pba3_block, count(DISTINCT checklist_id) AS checklist_count, NULL::BIGINT AS birders
FROM sightings WHERE observation_month IN ('Apr','May','Jun','Jul','Aug') GROUP BY 2
UNION ALL SELECT 'Winter', pba3_block, NULL, count(DISTINCT o) FROM
  (SELECT pba3_block, unnest(string_split(observer_id, ',')) AS o FROM sightings 
   WHERE observation_month IN ('Dec','Jan','Feb')) GROUP BY 2""",
        "sightings",
    ),
)
def set_union_tagged(spark, sf):
    x = _effort(spark, sf)
    parts = {
        "Breeding": metrics.calc_checklist_count(joins.in_season(x, "Breeding")),
        "Winter": metrics.calc_atlasers(joins.in_season(x, "Winter")),
    }
    return joins.union_tagged(parts, "season")


@query(
    "join_complete_keys",
    with_views(
        """SELECT season, pba3_block, count(DISTINCT common_name) AS nocturnal_species_coded FROM
  (SELECT season, s.pba3_block, CASE WHEN breeding_rank >= 4 AND common_name IN (SELECT common_name FROM nocturnal )
     THEN common_name END AS common_name
   FROM sightings s JOIN seasons ON observation_month = month) GROUP BY 1, 2""",
        "sightings",
        "seasons",
        "nocturnal",
    ),
)
def join_complete_keys(spark, sf):
    """Listed species confirmed, for every season and block with sightings."""
    x = joins.fan_out_seasons(fx.sightings(spark, sf))
    keys = ["season", "pba3_block"]
    confirmed = x.filter("breeding_rank >= 4")
    some = joins.keep_species(confirmed, fx.nocturnal_species(spark, sf)).select(*keys, "common_name").distinct()
    counted = some.groupBy(*keys).agg(F.count("*").alias("nocturnal_species_coded"))
    return joins.complete_keys(counted, x, keys, {"nocturnal_species_coded": 0})


_COMPARED = """(SELECT pba3_block, sum(duration_minutes)/60 AS h1, sum(effort_distance_km) AS k1 FROM
    (SELECT DISTINCT pba3_block, checklist_id, duration_minutes, effort_distance_km FROM sightings ) GROUP BY 1) a
  JOIN (SELECT pba3_block AS b, sum(m)/60 AS h2, sum(k) AS k2 FROM
    (SELECT pba3_block, checklist_id, max(duration_minutes) AS m, max(effort_distance_km) AS k FROM sightings GROUP BY 1, 2)
    GROUP BY 1) c ON a.pba3_block IS NOT DISTINCT FROM c.b"""


@query(
    "join_compare_averages",
    with_views(
        """SELECT count(*) AS blocks, count(*) FILTER (round(h2 - h1, 6) <> 0 OR round(k2 - k1, 6) <> 0) AS blocks_differing,
  round(avg(h2 - h1), 6) AS duration_hours_diff_avg, round(avg(k2 - k1), 6) AS effort_distance_diff_avg FROM """ + _COMPARED,
        "sightings",
    ),
)
def join_compare_averages(spark, sf):
    x = _effort(spark, sf)
    compared = metrics.compare_effort(metrics.effort_naive(x), metrics.effort_adjusted(x))
    # Six decimals first: sums of the same numbers in another order are no difference.
    compared = compared.withColumns({c: F.round(c, 6) for c in ("duration_hours_diff", "effort_distance_diff")})
    df = metrics.average_differences(compared)
    return df.withColumns({c: r6(c) for c in ("duration_hours_diff_avg", "effort_distance_diff_avg")})


@query(
    "join_compare_tables",
    with_views(
        """SELECT pba3_block, round(h1, 6) AS duration_hours_total_naive, round(h2, 6) AS duration_hours_total_adj,
  round(h2 - h1, 6) AS duration_hours_diff, round(k2 - k1, 6) AS effort_distance_diff FROM """ + _COMPARED,
        "sightings",
    ),
)
def join_compare_tables(spark, sf):
    x = _effort(spark, sf)
    df = metrics.compare_effort(metrics.effort_naive(x), metrics.effort_adjusted(x))
    names = ["duration_hours_total_naive", "duration_hours_total_adj", "duration_hours_diff", "effort_distance_diff"]
    return df.select("pba3_block", *[r6(c).alias(c) for c in names])
