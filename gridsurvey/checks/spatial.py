"""Daylight and spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import daylight, spatial
from .metrics import rounded
from ..session import scratch_path
from .registry import VIEWS, query, text, with_views

CELL = 0.5
#: Few enough that the cells of the given tables are halved, too.
MOST_IN_CELL = 500
OVERRIDES = {"B03": 5}

# Interior point of the convex hull, without building the hull: a point is a hull vertex if the
# directions to all others leave a gap above a half turn; the cut's ends are extremes over all pairs.
VIEWS["hull_columns"] = """
SELECT pba3_block, longitude AS x, min(latitude) AS low, max(latitude) AS high FROM sightings 
WHERE pba3_block IS NOT NULL GROUP BY 1, 2"""
VIEWS["hull_points"] = """
SELECT pba3_block, x, low AS y FROM hull_columns UNION SELECT pba3_block, x, high FROM hull_columns """
VIEWS["hull_vertices"] = """
SELECT pba3_block, x, y FROM (
  SELECT pba3_block, x, y, coalesce(lead(t) OVER w, first_value(t) OVER w + 2 * pi()) - t AS gap FROM (
    SELECT a.pba3_block, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS t FROM hull_points a JOIN hull_points b
      ON a.pba3_block = b.pba3_block AND (a.x <> b.x OR a.y <> b.y))
  WINDOW w AS (PARTITION BY pba3_block, x, y ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
GROUP BY 1, 2, 3 HAVING max(gap) > pi() + 1e-9"""
VIEWS["hull_lines"] = """
SELECT pba3_block, (min(CASE WHEN y > mid THEN y END) + max(CASE WHEN y <= mid THEN y END)) / 2 AS line FROM (
  SELECT *, (min(y) OVER (PARTITION BY pba3_block) + max(y) OVER (PARTITION BY pba3_block)) / 2 AS mid FROM hull_vertices )
GROUP BY 1"""
VIEWS["centers"] = """
SELECT pba3_block, (min(cut) + max(cut)) / 2 AS longitude, any_value(line) AS latitude FROM (
  SELECT a.pba3_block, line, a.x + (b.x - a.x) * (line - a.y) / (b.y - a.y) AS cut
  FROM hull_points a JOIN hull_points b ON a.pba3_block = b.pba3_block JOIN hull_lines l ON l.pba3_block = a.pba3_block
  WHERE a.y <= line AND b.y > line AND a.pba3_block IN
    (SELECT pba3_block FROM hull_vertices GROUP BY 1 HAVING count(*) > 2)) GROUP BY 1
UNION ALL SELECT pba3_block, (min(x) + max(x)) / 2, (min(y) + max(y)) / 2 FROM hull_points WHERE pba3_block NOT IN
  (SELECT pba3_block FROM hull_vertices GROUP BY 1 HAVING count(*) > 2) GROUP BY 1"""
VIEWS["block_map"] = """
SELECT * FROM (SELECT CASE WHEN pba3_block = 'B03' THEN 5 ELSE pba2_block END AS pba2_block, pba3_block
  FROM polygons LEFT JOIN centers ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1)
WHERE NOT (pba2_block = 5 AND pba3_block IS NULL)"""
MAP_VIEWS = ["block_map"]


def mapped_blocks(spark, sf, x=None):
    centers = spatial.hull_centers(fx.sightings(spark, sf, species=False) if x is None else x)
    return spatial.block_map(fx.polygons(spark, sf), centers, CELL, OVERRIDES).select("pba2_block", "pba3_block")


def _keys(spark, sf):
    return fx.sightings(spark, sf, species=False)


@query(
    "daylight_distinct_keys",
    with_views(
        """SELECT DISTINCT strftime(observation_datetime, '%Y-%m-%d %H:%M:%S') AS observation_datetime,
  round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM sightings """,
        "sightings",
    ),
)
def daylight_distinct_keys(spark, sf):
    df = daylight.daylight_keys(_keys(spark, sf))
    return rounded(df, "longitude", "latitude").withColumn("observation_datetime", text("observation_datetime"))


_DAYLIGHT = with_views(
    """SELECT strftime(observation_datetime, '%Y-%m-%d %H:%M:%S') AS observation_datetime,
  round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, strftime(sunrise, '%Y-%m-%d %H:%M:%S') AS sunrise,
  strftime(sunset, '%Y-%m-%d %H:%M:%S') AS sunset FROM daylight """,
    "daylight",
    sun_keys="SELECT DISTINCT observation_datetime, longitude, latitude FROM sightings ",
)


@query("daylight", _DAYLIGHT)
def daylight_query(spark, sf):
    df = daylight.daylight_table(_keys(spark, sf))
    times = {c: text(c) for c in ("observation_datetime", "sunrise", "sunset")}
    return rounded(df, "longitude", "latitude").withColumns(times)


@query(
    "geo_point",
    with_views(
        """SELECT round(longitude, 6) AS x, round(latitude, 6) AS y, 4326 AS srid, count(DISTINCT checklist_id) AS n FROM sightings 
GROUP BY 1, 2""",
        "sightings",
    ),
)
def geo_point(spark, sf):
    places = _keys(spark, sf).select("checklist_id", "longitude", "latitude").distinct()
    df = spatial.as_point(places).select("point.*")
    return rounded(df, "x", "y").groupBy("x", "y", "srid").agg(F.count("*").alias("n"))


@query(
    "geo_mercator",
    with_views(
        """SELECT DISTINCT round(longitude, 6) AS longitude, round(latitude, 6) AS latitude,
  round(6378137*radians(longitude), 3) AS x_m, round(6378137*ln(tan(pi()/4 + radians(latitude)/2)), 3) AS y_m FROM sightings """,
        "sightings",
    ),
)
def geo_mercator(spark, sf):
    places = spatial.to_mercator(_keys(spark, sf).select("longitude", "latitude").distinct())
    return rounded(places, "longitude", "latitude").withColumns({c: F.round(c, 3) for c in ("x_m", "y_m")})


@query(
    "join_spatial_cover",
    with_views(
        """SELECT pba2_block::INTEGER AS pba2_block, checklist_id FROM polygons LEFT JOIN
  (SELECT DISTINCT checklist_id, longitude, latitude FROM sightings )
ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1""",
        "polygons",
        "sightings",
    ),
)
def join_spatial_cover(spark, sf):
    points = _keys(spark, sf).select("checklist_id", "longitude", "latitude").distinct()

    def kept(name, df):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    df = spatial.join_covering_adaptive(fx.polygons(spark, sf), points, "pba2_block", CELL, most=MOST_IN_CELL, keep=kept)
    return df.select("pba2_block", "checklist_id")


@query(
    "geo_hull_center",
    with_views(
        "SELECT pba3_block, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM centers ", "centers"
    ),
)
def geo_hull_center(spark, sf):
    return rounded(spatial.hull_centers(_keys(spark, sf)), "longitude", "latitude")


@query(
    "geo_block_map",
    with_views("SELECT pba2_block::INTEGER AS pba2_block, pba3_block FROM block_map ", *MAP_VIEWS),
)
def geo_block_map(spark, sf):
    return mapped_blocks(spark, sf)
