"""Registry of queries and the SQL views of the adapter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator name; without SQL only its rows can be checked."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(c) -> Column:
    """Six decimals, so that the order of summation does not show."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def text(c) -> Column:
    """Dates and wall-clock times as text, the same in every engine and session zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def with_views(body: str, *names: str, **replaced: str) -> str:
    """A query over the named adapter views, with the views they need; some may be replaced."""
    views = {**VIEWS, **replaced}
    needed: list[str] = []

    def add(name: str) -> None:
        for other in views:
            if other != name and f" {other} " in views[name].replace("\n", " ") + " " and other not in needed:
                add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({views[n].strip()})" for n in needed) + "\n" + body.strip()


_MONTHS = "('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec')"

VIEWS = {
    "checklists": """
SELECT o_orderkey, o_orderdate, o_orderstatus AS protocol_name,
  CASE WHEN c_nationkey = 24 THEN NULL ELSE 'B' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS pba3_block,
  -80.5::DOUBLE + (o_custkey % 600)::DOUBLE / 100 AS longitude,
  39.7::DOUBLE + (o_custkey % 250)::DOUBLE / 100 AS latitude
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "lines": """
SELECT *, p_name AS common_name,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))
    + to_minutes(CAST(CASE WHEN o_orderkey % 10 = 0 THEN l_linenumber % 3 ELSE 0 END AS INTEGER)) AS start_time
FROM lineitem JOIN checklists ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "categories": """
SELECT * FROM (VALUES ('0','Not Observed',0),('C1','Observed',1),('C2','Possible',2),('C3','Probable',3),
  ('C4','Confirmed',4)) t(breeding_category, breeding_category_desc, breeding_rank)""",
    "seasons": f"""
SELECT 'All seasons' AS season, m AS month FROM (SELECT unnest([{_MONTHS[1:-1]}]) AS m)
UNION ALL SELECT 'Breeding', unnest(['Apr','May','Jun','Jul','Aug'])
UNION ALL SELECT 'Winter', unnest(['Dec','Jan','Feb'])""",
    "sightings": """
SELECT s.*, breeding_category_desc, breeding_rank FROM (
SELECT CAST(o_orderkey AS VARCHAR) AS checklist_id, pba3_block, common_name,
  'obs' || CAST(l_suppkey % 7 AS VARCHAR) || ',obs' || CAST(l_linenumber % 5 AS VARCHAR) AS observer_id,
  CASE WHEN l_linenumber % 5 <> 0 THEN 'C' || CAST(l_linenumber % 5 AS VARCHAR) ELSE 'C1' END AS breeding_category,
  CAST(o_orderdate AS DATE) AS observation_date, strftime(o_orderdate, '%b') AS observation_month,
  CASE WHEN l_quantity >= 3 THEN start_time END AS observation_datetime,
  CASE WHEN l_quantity <= 45 THEN l_quantity * 6 END AS duration_minutes,
  l_discount * 100 AS effort_distance_km, longitude, latitude, protocol_name,
  CASE WHEN l_suppkey % 10 = 0 THEN 'X' WHEN l_suppkey % 10 <> 1 THEN CAST(l_suppkey % 50 AS VARCHAR) END
    AS observation_count
FROM lines ) s LEFT JOIN categories USING (breeding_category)""",
    "raw": """
SELECT 'S' || CAST(o_orderkey AS VARCHAR) || '-' || CAST(l_suppkey % 3 AS VARCHAR) AS event_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'G' || CAST(o_orderkey AS VARCHAR) END AS group_id,
  'obs' || CAST(l_suppkey % 7 AS VARCHAR) AS observer_id, common_name,
  (['species','issf','form','spuh','domestic'])[CAST(l_partkey % 5 AS INTEGER) + 1] AS taxon_category,
  CASE WHEN l_linenumber % 5 <> 0 THEN '  ' || l_returnflag || '  ' || l_linestatus || ' ' END AS breeding_code,
  CASE WHEN l_linenumber % 5 <> 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE '' END || 'C' ||
    CAST(l_linenumber % 5 AS VARCHAR) || ' ' END AS breeding_category,
  CAST(o_orderdate AS DATE) AS observation_date,
  CASE WHEN l_quantity >= 3 THEN strftime(start_time, '%H:%M:%S') END AS time_observations_started,
  CASE WHEN l_quantity <= 45 THEN l_quantity * 6 END AS duration_minutes,
  l_discount * 100 AS effort_distance_km, longitude, latitude, pba3_block AS atlas_block,
  (['Grid Survey','Backyard Count, Grid Survey','Backyard Count'])[CAST(l_suppkey % 3 AS INTEGER) + 1] AS project_names,
  protocol_name,
  CASE WHEN l_suppkey % 10 = 0 THEN 'X' WHEN l_suppkey % 10 <> 1 THEN CAST(l_suppkey % 50 AS VARCHAR) END
    AS observation_count
FROM lines """,
    "nocturnal": "SELECT DISTINCT p_name AS common_name FROM part WHERE length(p_name) % 4 = 0",
    "focal": "SELECT DISTINCT p_name AS common_name, TRUE AS is_focal FROM part WHERE length(p_name) % 3 = 0",
    "blocks": """
SELECT 'B' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS pba3_block, n_name AS block_name, r_name AS block_region,
  'County ' || CAST(n_nationkey % 7 AS VARCHAR) AS block_county
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 5""",
    "old_survey": """
SELECT pba3_block, common_name, breeding_category_desc FROM (
  SELECT pba3_block, common_name, 1 + max(l_linenumber % 4) AS breeding_rank FROM lines 
  WHERE l_returnflag = 'R' AND l_partkey % 5 = 0 GROUP BY ALL) JOIN categories USING (breeding_rank)""",
    "polygons": """
SELECT row_number() OVER (ORDER BY i, j) AS pba2_block, i / 2 AS x0, (i + 1) / 2 AS x1, j / 2 AS y0, (j + 1) / 2 AS y1
FROM (SELECT DISTINCT floor(longitude * 2) AS i, floor(latitude * 2) AS j FROM checklists )""",
    # start times: distinct rows, one vote per observer in the list, ties to the earliest
    "fixed": """
SELECT checklist_id, observation_datetime AS observation_datetime_fixed FROM (
  SELECT checklist_id, observation_datetime,
    row_number() OVER (PARTITION BY checklist_id ORDER BY count(*) DESC, observation_datetime) AS rn
  FROM (SELECT checklist_id, observation_datetime, unnest(string_split(observer_id, ',')) AS o FROM (
    SELECT DISTINCT pba3_block, checklist_id, observer_id, observation_datetime FROM sightings 
    WHERE checklist_id IN (SELECT checklist_id FROM (SELECT DISTINCT checklist_id, observation_datetime FROM sightings )
      GROUP BY 1 HAVING count(*) > 1)))
  WHERE observation_datetime IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""",
    "places": """
SELECT season, pba3_block, checklist_id, longitude, latitude,
  min(coalesce(observation_datetime_fixed, observation_datetime)) AS observation_datetime,
  coalesce(max(duration_minutes), 0) AS duration_minutes
FROM sightings JOIN seasons ON observation_month = month LEFT JOIN fixed USING (checklist_id) GROUP BY ALL""",
}


def _sun(name: str, source: str, minute: str, side: int) -> str:
    """Solar equations as a chain of views, the sun placed at a given UTC minute of the local date."""
    return f"""
SELECT *, 720 - 4 * (longitude + {side} * CASE WHEN ch BETWEEN -1 AND 1 THEN degrees(acos(ch)) END) - eq AS {name} FROM (
SELECT *, 4 * degrees(y*sin(2*radians(L)) - 2*e*sin(radians(M)) + 4*e*y*sin(radians(M))*cos(2*radians(L))
    - 0.5::DOUBLE*y*y*sin(4*radians(L)) - 1.25::DOUBLE*e*e*sin(2*radians(M))) AS eq,
  cos(radians(90.833::DOUBLE))/(cos(radians(latitude))*cos(dec)) - tan(radians(latitude))*tan(dec) AS ch FROM (
SELECT *, asin(sin(radians(eps))*sin(radians(lam))) AS dec, pow(tan(radians(eps/2)), 2) AS y FROM (
SELECT *, L + sin(radians(M))*(1.914602::DOUBLE - T*(0.004817::DOUBLE + 0.000014::DOUBLE*T))
    + sin(2*radians(M))*(0.019993::DOUBLE - 0.000101::DOUBLE*T) + 0.000289::DOUBLE*sin(3*radians(M))
    - 0.00569::DOUBLE - 0.00478::DOUBLE*sin(radians(om)) AS lam,
  23 + (26 + (21.448::DOUBLE - T*(46.815::DOUBLE + T*(0.00059::DOUBLE - T*0.001813::DOUBLE)))/60)/60
    + 0.00256::DOUBLE*cos(radians(om)) AS eps FROM (
SELECT *, fmod(fmod(280.46646::DOUBLE + T*(36000.76983::DOUBLE + 0.0003032::DOUBLE*T), 360) + 360, 360) AS L,
  357.52911::DOUBLE + T*(35999.05029::DOUBLE - 0.0001537::DOUBLE*T) AS M,
  0.016708634::DOUBLE - T*(0.000042037::DOUBLE + 0.0000001267::DOUBLE*T) AS e, 125.04::DOUBLE - 1934.136::DOUBLE*T AS om FROM (
SELECT *, ((CAST(observation_datetime AS DATE) - DATE '2000-01-01') + 2451544.5::DOUBLE + {minute}/1440 - 2451545) / 36525 AS T
FROM {source} )))))"""


def _sun_pass(name: str, source: str, minute: str, side: int, keep: str) -> str:
    return f"SELECT {keep}, {name} FROM ({_sun(name, source, minute, side)})"


VIEWS["sun_keys"] = "SELECT DISTINCT observation_datetime, longitude, latitude FROM places "
_K = "observation_datetime, longitude, latitude"
VIEWS["sun1"] = _sun_pass("r1", "sun_keys", "0::DOUBLE", 1, _K)
VIEWS["sun2"] = _sun_pass("r2", "sun1", "r1", 1, _K)
VIEWS["sun3"] = _sun_pass("s1", "sun2", "0::DOUBLE", -1, _K + ", r2")
VIEWS["sun4"] = _sun_pass("s2", "sun3", "s1", -1, _K + ", r2")
_LOCAL = "((CAST(observation_datetime AS DATE) + to_microseconds(CAST(round({}*60e6) AS BIGINT))) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'"
VIEWS["daylight"] = (
    f"SELECT {_K}, {_LOCAL.format('r2')} AS sunrise, {_LOCAL.format('s2')} AS sunset FROM sun4 "
)
VIEWS["labelled"] = """
SELECT p.*, sunrise, sunset, CASE
  WHEN observation_datetime BETWEEN sunrise - INTERVAL 40 MINUTE AND sunset + INTERVAL 20 MINUTE THEN 'diurnal'
  WHEN NOT (observation_datetime BETWEEN sunrise - INTERVAL 40 MINUTE AND sunset + INTERVAL 20 MINUTE) THEN 'nocturnal'
  ELSE 'unknown' END AS checklist_type
FROM places p LEFT JOIN daylight USING (observation_datetime, longitude, latitude)"""
