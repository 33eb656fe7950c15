"""Ingest and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..lookups import category_table, season_table
from ..operators import prep
from .registry import query, r6, text, with_views


@query(
    "prep_date_range",
    with_views(
        """SELECT event_id, observation_date::VARCHAR AS observation_date, common_name FROM raw
WHERE observation_date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'""",
        "raw",
    ),
)
def prep_date_range(spark, sf):
    df = prep.up_to_release(fx.raw_sightings(spark, sf), "Jun-2000", "1996-01-01")
    return df.select("event_id", F.col("observation_date").cast("string").alias("observation_date"), "common_name")


@query(
    "prep_project",
    with_views(
        "SELECT event_id, common_name, project_names FROM raw WHERE list_contains(string_split(project_names, ', '), 'Grid Survey')",
        "raw",
    ),
)
def prep_project(spark, sf):
    return prep.in_project(fx.raw_sightings(spark, sf), "Grid Survey").select("event_id", "common_name", "project_names")


_FIRST = ["event_id", "duration_minutes", "observation_count", "breeding_category"]


@query(
    "prep_shared_dedupe",
    with_views(
        """SELECT checklist_id, common_name, observers AS observer_id, event_id, duration_minutes, observation_count,
  breeding_category
FROM (SELECT *, coalesce(group_id, event_id) AS checklist_id,
    CASE WHEN group_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY group_id, common_name
      ORDER BY event_id, duration_minutes NULLS FIRST, observation_count NULLS FIRST, breeding_category NULLS FIRST) END AS rn,
    CASE WHEN group_id IS NULL THEN observer_id ELSE array_to_string(list_sort(list_distinct(list(observer_id) OVER
      (PARTITION BY group_id, common_name))), ',') END AS observers
  FROM raw )
WHERE rn = 1""",
        "raw",
    ),
)
def prep_shared_dedupe(spark, sf):
    df = fx.raw_sightings(spark, sf).select("group_id", "observer_id", "common_name", *_FIRST)
    return prep.collapse_shared(df).drop("group_id")


_SUMMED = """CASE WHEN bool_or(coalesce(observation_count = 'X', FALSE)) THEN 'X'
  ELSE sum(CASE WHEN observation_count <> 'X' THEN observation_count::INTEGER END)::VARCHAR END"""
_LARGEST = """coalesce(max(CASE WHEN observation_count <> 'X' THEN observation_count::INTEGER END)::VARCHAR,
    max(CASE WHEN observation_count = 'X' THEN 'X' END))"""


def _rollup_sql(count: str) -> str:
    return with_views(
        f"""SELECT checklist_id, common_name, {count} AS observation_count,
  any_value(breeding_category) FILTER (rn = 1) AS breeding_category, any_value(breeding_code) FILTER (rn = 1) AS breeding_code
FROM (SELECT *, row_number() OVER (PARTITION BY checklist_id, common_name
    ORDER BY breeding_category DESC, breeding_code NULLS FIRST) AS rn
  FROM (SELECT event_id AS checklist_id, common_name, observation_count, coalesce(trim(breeding_category), 'C1') AS breeding_category,
    trim(regexp_replace(breeding_code, '\\s+', ' ', 'g')) AS breeding_code
    FROM raw WHERE taxon_category IN ('species','issf','form','domestic')))
GROUP BY 1, 2""",
        "raw",
    )


def _rolled_up(spark, sf, rule):
    raw = prep.clean_codes(fx.raw_sightings(spark, sf))
    return prep.roll_up_taxa(raw.select(
        F.col("event_id").alias("checklist_id"), "common_name", "taxon_category", "observation_count", "breeding_category",
        "breeding_code",
    ), rule)


@query("prep_taxon_rollup", _rollup_sql(_SUMMED))
def prep_taxon_rollup(spark, sf):
    return _rolled_up(spark, sf, "sum")


@query("prep_taxon_rollup_max", _rollup_sql(_LARGEST))
def prep_taxon_rollup_max(spark, sf):
    return _rolled_up(spark, sf, "max")


@query(
    "prep_sightings",
    with_views(
        """, cleaned AS (SELECT * REPLACE (coalesce(trim(breeding_category), 'C1') AS breeding_category,
    trim(regexp_replace(breeding_code, '\\s+', ' ', 'g')) AS breeding_code) FROM raw 
  WHERE observation_date BETWEEN DATE '1993-01-01' AND DATE '1997-06-30' AND list_contains(string_split(project_names, ', '), 'Grid Survey')),
shared AS (SELECT *, group_id AS checklist_id, row_number() OVER (PARTITION BY group_id, common_name ORDER BY event_id,
    taxon_category, breeding_code NULLS FIRST, breeding_category, observation_date, time_observations_started NULLS FIRST,
    duration_minutes NULLS FIRST, effort_distance_km, longitude, latitude, atlas_block NULLS FIRST, project_names, protocol_name,
    observation_count NULLS FIRST) AS rn,
  array_to_string(list_sort(list_distinct(list(observer_id) OVER (PARTITION BY group_id, common_name))), ',') AS observers
  FROM cleaned WHERE group_id IS NOT NULL),
rows AS (SELECT * EXCLUDE (rn, observers) REPLACE (observers AS observer_id) FROM shared WHERE rn = 1
  UNION ALL SELECT *, event_id FROM cleaned WHERE group_id IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY checklist_id, common_name ORDER BY breeding_category DESC, observer_id, event_id,
    group_id NULLS FIRST, breeding_code NULLS FIRST, observation_date, time_observations_started NULLS FIRST,
    duration_minutes NULLS FIRST, effort_distance_km, longitude, latitude, atlas_block NULLS FIRST, project_names, protocol_name) AS rn
  FROM rows WHERE taxon_category IN ('species','issf','form','domestic'))
SELECT checklist_id, common_name, """ + _SUMMED + """ AS observation_count, any_value(breeding_category) FILTER (rn = 1) AS breeding_category,
  any_value(breeding_code) FILTER (rn = 1) AS breeding_code, any_value(observer_id) FILTER (rn = 1) AS observer_id,
  any_value(atlas_block) FILTER (rn = 1) AS pba3_block, any_value(duration_minutes) FILTER (rn = 1) AS duration_minutes,
  any_value(strftime(observation_date, '%b')) FILTER (rn = 1) AS observation_month
FROM ranked GROUP BY 1, 2""",
        "raw",
    ).replace("\n,", ",", 1),
)
def prep_sightings(spark, sf):
    """The whole way from raw rows to the processed table."""
    df = prep.prepare_sightings(fx.raw_sightings(spark, sf), "Grid Survey", start="1993-01-01", release="Jun-1997")
    return df.select(
        "checklist_id", "common_name", "observation_count", "breeding_category", "breeding_code", "observer_id", "pba3_block",
        "duration_minutes", "observation_month",
    )


@query(
    "prep_clean_codes",
    with_views(
        """SELECT event_id, trim(regexp_replace(breeding_code, '\\s+', ' ', 'g')) AS breeding_code,
  coalesce(trim(breeding_category), 'C1') AS breeding_category FROM raw""",
        "raw",
    ),
)
def prep_clean_codes(spark, sf):
    return prep.clean_codes(fx.raw_sightings(spark, sf)).select("event_id", "breeding_code", "breeding_category")


@query(
    "prep_datetime",
    with_views(
        """SELECT event_id, strftime(observation_date, '%b') AS observation_month,
  CASE WHEN t = (t AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York'
    THEN strftime(t, '%Y-%m-%d %H:%M:%S') END AS observation_datetime
FROM (SELECT *, CAST(observation_date::VARCHAR || ' ' || time_observations_started AS TIMESTAMP) AS t FROM raw )""",
        "raw",
    ),
)
def prep_datetime(spark, sf):
    df = prep.with_observation_times(fx.raw_sightings(spark, sf))
    return df.select("event_id", "observation_month", text("observation_datetime").alias("observation_datetime"))


@query(
    "prep_rename",
    with_views("SELECT event_id AS id, atlas_block AS pba3_block, breeding_code AS code FROM raw", "raw"),
)
def prep_rename(spark, sf):
    df = prep.rename_block(fx.raw_sightings(spark, sf)).select("event_id", "pba3_block", "breeding_code")
    return prep.strip_prefix(df, "breeding_").toDF("id", "pba3_block", "code")


@query(
    "prep_count_parse",
    with_views(
        """SELECT event_id, common_name,
  CAST(CASE WHEN observation_count = 'X' THEN '1' ELSE observation_count END AS DOUBLE) AS observation_count FROM raw""",
        "raw",
    ),
)
def prep_count_parse(spark, sf):
    return prep.with_parsed_count(fx.raw_sightings(spark, sf)).select("event_id", "common_name", "observation_count")


# species names of the test set that stand for names with a mapping
_OLD_NAMES = {"blue rod": "Yellow Warbler", "cold ring": "Barn Owl", "hot gear": "House Wren", "new bolt": "N/A 1"}
_OLD_SQL = "CASE common_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OLD_NAMES.items()) + " ELSE common_name END"


def _old_named(spark, sf):
    old = fx.old_survey(spark, sf)
    return old.replace(_OLD_NAMES, subset=["common_name"])


@query(
    "prep_species_remap",
    with_views(
        f"""SELECT pba3_block, CASE n WHEN 'Yellow Warbler' THEN 'Northern Yellow Warbler'
  WHEN 'Barn Owl' THEN 'American Barn Owl' WHEN 'House Wren' THEN 'Northern House Wren' ELSE n END AS common_name,
  breeding_category_desc FROM (SELECT *, {_OLD_SQL} AS n FROM old_survey )""",
        "old_survey",
    ),
)
def prep_species_remap(spark, sf):
    return prep.rename_species(_old_named(spark, sf))


@query(
    "prep_category_remap",
    with_views(
        "SELECT pba3_block, common_name, CASE WHEN breeding_category_desc = 'Possible' THEN 'Observed' "
        "ELSE breeding_category_desc END AS breeding_category_desc FROM old_survey ",
        "old_survey",
    ),
)
def prep_category_remap(spark, sf):
    joint = fx.old_survey(spark, sf).replace({"Possible": "Observed/Possible"}, subset=["breeding_category_desc"])
    return prep.rename_categories(joint)


@query(
    "prep_drop_na_names",
    with_views(
        f"SELECT pba3_block, n AS common_name FROM (SELECT *, {_OLD_SQL} AS n FROM old_survey ) WHERE n NOT LIKE '%N/A%'",
        "old_survey",
    ),
)
def prep_drop_na_names(spark, sf):
    return prep.drop_unnamed_species(_old_named(spark, sf)).select("pba3_block", "common_name")


@query(
    "lookup_tables",
    with_views(
        """SELECT season, breeding_category_desc, breeding_rank, count(*) AS n
FROM sightings JOIN seasons ON observation_month = month GROUP BY ALL""",
        "sightings",
        "seasons",
    ),
)
def lookup_tables(spark, sf):
    """Both literal tables, joined to the sightings."""
    return (
        fx.sightings(spark, sf, species=False, ranked=False)
        .join(category_table(spark), "breeding_category")
        .join(season_table(spark).withColumnRenamed("month", "observation_month"), "observation_month")
        .groupBy("season", "breeding_category_desc", "breeding_rank")
        .agg(F.count("*").alias("n"))
    )


@query(
    "prep_rank",
    with_views(
        "SELECT checklist_id, common_name, breeding_category, breeding_category_desc, breeding_rank FROM sightings ",
        "sightings",
    ),
)
def prep_rank(spark, sf):
    df = prep.with_rank(fx.sightings(spark, sf, ranked=False))
    return df.select("checklist_id", "common_name", "breeding_category", "breeding_category_desc", "breeding_rank")


@query(
    "prep_filter_eq",
    with_views(
        """SELECT checklist_id, common_name, round(duration_minutes, 6) AS duration_minutes FROM sightings 
WHERE pba3_block = 'B03' AND observation_month IN ('Jun','Jul') AND observation_datetime IS NOT NULL
  AND abs(effort_distance_km) > 0""",
        "sightings",
    ),
)
def prep_filter_eq(spark, sf):
    df = fx.sightings(spark, sf).filter(
        (F.col("pba3_block") == "B03")
        & F.col("observation_month").isin("Jun", "Jul")
        & F.col("observation_datetime").isNotNull()
        & (F.abs("effort_distance_km") > 0)
    )
    return df.select("checklist_id", "common_name", r6("duration_minutes").alias("duration_minutes"))


@query(
    "prep_max_date",
    with_views(
        """SELECT checklist_id, common_name, (SELECT min(observation_date)::VARCHAR FROM sightings ) AS first_date,
  observation_date::VARCHAR AS last_date
FROM sightings WHERE observation_date = (SELECT max(observation_date) FROM sightings )""",
        "sightings",
    ),
)
def prep_max_date(spark, sf):
    df = fx.sightings(spark, sf)
    first = prep.date_extent(fx.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("observation_date")))
    return prep.rows_at_latest_date(df).select(
        "checklist_id",
        "common_name",
        first.select(F.col("first_date").cast("string")).scalar().alias("first_date"),
        F.col("observation_date").cast("string").alias("last_date"),
    )
