"""Survey comparison, mart, completion and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..lookups import SEASONS
from ..operators import compare, completion, joins, season
from .joins import NEW_SQL, OLD_SQL, ranks
from .metrics import HOURS, rounded, summary_frame, with_summary
from .registry import VIEWS, query, r6, with_views
from .spatial import MAP_VIEWS, mapped_blocks

VIEWS["pairs"] = f"""
SELECT coalesce(o.pba3_block, n.pba3_block) AS pba3_block, coalesce(o.common_name, n.common_name) AS common_name,
  coalesce(old_rank, 0) AS pba2_breeding_rank_max, coalesce(new_rank, 0) AS pba3_breeding_rank_max
FROM ({OLD_SQL} ) o FULL JOIN ({NEW_SQL}) n
  ON o.pba3_block IS NOT DISTINCT FROM n.pba3_block AND o.common_name = n.common_name"""
VIEWS["comparison"] = """
SELECT p.*, o.breeding_category_desc AS pba2_breeding_category_max, n.breeding_category_desc AS pba3_breeding_category_max,
  coalesce(block_name, 'Unknown block name') AS block_name, coalesce(block_region, 'Unknown region') AS block_region,
  coalesce(block_county, 'Unknown county') AS block_county
FROM pairs p JOIN categories o ON o.breeding_rank = pba2_breeding_rank_max
JOIN categories n ON n.breeding_rank = pba3_breeding_rank_max LEFT JOIN blocks USING (pba3_block)"""
VIEWS["block_comparison"] = """
SELECT pba3_block, 'Breeding' AS season, a AS species_count_pba2, b AS species_coded_pba2, c AS species_count_pba3,
  d AS species_coded_pba3, e AS pct_missing_pba2_confirmations, f AS pct_coded_atlas_comparison,
  CASE WHEN b <> 0 THEN d / b WHEN d > 0 THEN 'Infinity'::DOUBLE END AS pba3_pba2_coded_count_compare_pct
FROM (SELECT pba3_block, count(*) FILTER (o > 0) AS a, count(*) FILTER (o > 1) AS b, count(*) FILTER (n > 0) AS c,
    count(*) FILTER (n > 1) AS d, avg(CASE WHEN o = 4 AND n < 4 THEN 1.0::DOUBLE ELSE 0 END) AS e,
    avg(CASE WHEN n >= o THEN 1.0::DOUBLE ELSE 0 END) AS f
  FROM (SELECT pba3_block, pba2_breeding_rank_max AS o, pba3_breeding_rank_max AS n FROM pairs ) GROUP BY 1)"""


def comparison_frame(spark, sf, x=None):
    old, new = ranks(spark, sf, x)
    return compare.compare_species(old, new, fx.blocks(spark, sf))


@query("compare_atlas_species", with_views("SELECT * FROM comparison ", "comparison"))
def compare_atlas_species(spark, sf):
    return comparison_frame(spark, sf)


@query(
    "compare_max_rank",
    with_views(
        f"""SELECT pba3_block, common_name, breeding_category_desc AS pba3_breeding_category_max, new_rank AS pba3_breeding_rank_max
FROM ({NEW_SQL}) JOIN categories ON breeding_rank = new_rank""",
        "sightings",
        "categories",
    ),
)
def compare_max_rank(spark, sf):
    return compare.new_ranks(fx.sightings(spark, sf))


@query(
    "compare_missing",
    with_views("SELECT * FROM comparison WHERE pba2_breeding_rank_max > pba3_breeding_rank_max", "comparison"),
)
def compare_missing(spark, sf):
    return compare.missing_species(comparison_frame(spark, sf))


_SHARES = ["pct_missing_pba2_confirmations", "pct_coded_atlas_comparison", "pba3_pba2_coded_count_compare_pct"]


@query(
    "compare_block",
    with_views(
        "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _SHARES) + ") FROM block_comparison ",
        "block_comparison",
    ),
)
def compare_block(spark, sf):
    return rounded(compare.compare_blocks(comparison_frame(spark, sf)), *_SHARES)


@query(
    "compare_gap_ranked",
    with_views(
        """SELECT pba3_block, block_name, common_name, coalesce(is_focal, FALSE) AS is_focal, pba3_breeding_category_max,
  pba2_breeding_category_max FROM comparison LEFT JOIN focal USING (common_name)
WHERE pba3_block = 'B03' AND pba2_breeding_rank_max > pba3_breeding_rank_max""",
        "comparison",
        "focal",
    ),
)
def compare_gap_ranked(spark, sf):
    missing = compare.missing_species(comparison_frame(spark, sf))
    return compare.block_gaps(missing, "B03", fx.focal_species(spark, sf))


MART_VIEW = """,
mart AS (SELECT m.pba2_block, m.pba3_block, s.* EXCLUDE (pba3_block), c.* EXCLUDE (pba3_block, season),
  coalesce(block_name, 'Unknown block name') AS block_name, coalesce(block_region, 'Unknown region') AS block_region, block_county
FROM block_map m LEFT JOIN summary s ON m.pba3_block IS NOT DISTINCT FROM s.pba3_block
LEFT JOIN block_comparison c ON c.pba3_block IS NOT DISTINCT FROM m.pba3_block AND c.season = s.season
LEFT JOIN blocks b ON b.pba3_block = m.pba3_block)
"""


def with_mart(body: str) -> str:
    head, _, _ = with_summary("@@", *MAP_VIEWS, "block_comparison", "blocks").rpartition("@@")
    return head.rstrip() + MART_VIEW + body.strip()


def mart_frame(spark, sf, *names):
    """The mart of all seasons, or of the named ones alone: the others are then never computed.

    For named seasons the sightings are stored first. The mart of all seasons
    takes them as they come: its plan is held next to that over buckets.
    """
    x = fx.sightings(spark, sf, stored=bool(names))
    comparison = compare.compare_blocks(comparison_frame(spark, sf, x))
    wanted = {name: SEASONS[name] for name in names or SEASONS}
    summary, mapped = summary_frame(spark, sf, x, wanted), mapped_blocks(spark, sf, x)
    return season.block_mart(summary, mapped, comparison, fx.blocks(spark, sf)), comparison


@query(
    "join_geo_many",
    with_summary(
        """SELECT pba2_block::INTEGER AS pba2_block, m.pba3_block, season, checklist_count FROM block_map m
LEFT JOIN summary s ON m.pba3_block IS NOT DISTINCT FROM s.pba3_block""",
        *MAP_VIEWS,
    ),
)
def join_geo_many(spark, sf):
    x = fx.sightings(spark, sf, stored=True)
    df = joins.null_safe_join(mapped_blocks(spark, sf, x), summary_frame(spark, sf, x), ["pba3_block"], "left")
    return df.select("pba2_block", "pba3_block", "season", "checklist_count")


@query(
    "join_block_season",
    with_summary(
        """SELECT s.season, s.pba3_block, species_observed, species_count_pba2, species_count_pba3 FROM summary s
LEFT JOIN block_comparison c ON c.season = s.season AND c.pba3_block IS NOT DISTINCT FROM s.pba3_block""",
        "block_comparison",
    ),
)
def join_block_season(spark, sf):
    x = fx.sightings(spark, sf, stored=True)
    comparison = compare.compare_blocks(comparison_frame(spark, sf, x))
    df = joins.null_safe_join(summary_frame(spark, sf, x), comparison, ["pba3_block", "season"], "left")
    return df.select("season", "pba3_block", "species_observed", "species_count_pba2", "species_count_pba3")


_MART_COLUMNS = [
    "pba3_block", "block_name", "block_region", "block_county", "season", "species_observed", "Observed", "Possible",
    "Probable", "Confirmed", "checklist_count", "birders", "breeding_season_months_covered", "nocturnal_species_coded",
    "species_count_pba2", "species_coded_pba2", "species_count_pba3", "species_coded_pba3",
]
_MART_ROUNDED = ["duration_hours_total", "effort_distance_km", *HOURS, *_SHARES]


@query(
    "block_mart",
    with_mart(
        "SELECT pba2_block::INTEGER AS pba2_block, dates, "
        + ", ".join(f'"{c}"' for c in _MART_COLUMNS)
        + ", "
        + ", ".join(f"round({c}, 6) AS {c}" for c in _MART_ROUNDED)
        + " FROM mart"
    ),
)
def block_mart(spark, sf):
    mart, _ = mart_frame(spark, sf)
    return mart.select(
        "pba2_block",
        F.array_size("effort_breakdown").cast("bigint").alias("dates"),
        *_MART_COLUMNS,
        *[r6(c).alias(c) for c in _MART_ROUNDED],
    )


def _completion_sql(ratio: str) -> str:
    return f"""SELECT pba3_block, block_name, block_county, (f1 AND f2 AND f3 AND f4 AND f5 AND f6 AND f7) AS all_criteria_complete,
  f1 AS flag_coded_species, f2 AS flag_confirmed_pct, f3 AS flag_possible_pct, f4 AS flag_coded_atlas_comparison,
  f5 AS flag_20_effort_hours, f6 AS flag_breeeding_season_coverage, f7 AS flag_nocturnal_coverage FROM (
SELECT *, n >= 50 AS f1, CASE WHEN n <> 0 THEN con / n >= 0.25 END AS f2, CASE WHEN n <> 0 THEN pos / n < 0.25 END AS f3,
  {ratio} >= 0.8 AS f4, round(duration_hours_total, 2) >= 20 AS f5, breeding_season_months_covered >= 3 AS f6,
  (nocturnal_species_coded >= 2 OR duration_hours_nocturnal >= 2) AS f7 FROM (
SELECT *, coalesce("Possible", 0) AS pos, coalesce("Confirmed", 0) AS con,
  coalesce("Possible", 0) + coalesce("Probable", 0) + coalesce("Confirmed", 0) AS n
FROM mart WHERE season = 'All seasons' AND pba3_block IS NOT NULL))"""


@query(
    "completion_table",
    with_mart(
        _completion_sql("(SELECT any_value(c.pba3_pba2_coded_count_compare_pct) FROM block_comparison c WHERE c.pba3_block = x.pba3_block)")
        .replace("AND pba3_block IS NOT NULL))", "AND pba3_block IS NOT NULL) x)")
    ),
)
def completion_table(spark, sf):
    mart, comparison = mart_frame(spark, sf, "All seasons")
    return completion.completion_table(mart, comparison, {"coded_species": 50})


@query("completion_table_season_matched", with_mart(_completion_sql("pba3_pba2_coded_count_compare_pct")))
def completion_table_season_matched(spark, sf):
    mart, _ = mart_frame(spark, sf, "All seasons")
    return completion.completion_table(mart, thresholds={"coded_species": 50}, season_matched=True)


_PROGRESS = [c for c in completion.PROGRESS_COLUMNS if c != "season"]
_TWO = ("duration_hours_total", "effort_distance_km")


@query(
    "progress_table",
    with_mart(
        "SELECT "
        + ", ".join(
            f"round({c}, 2) AS {c}" if c in _TWO else f"round({c}, 6) AS {c}" if c in _MART_ROUNDED else f'"{c}"'
            for c in _PROGRESS
        )
        + " FROM mart WHERE season = 'Breeding'"
    ),
)
def progress_table(spark, sf):
    mart, _ = mart_frame(spark, sf, "Breeding")
    return rounded(completion.progress_table(mart, "Breeding"), *[c for c in _MART_ROUNDED if c not in _TWO])


@query(
    "hierarchy_map",
    with_views(
        """SELECT DISTINCT block_region, block_county AS block_name, pba3_block FROM blocks 
WHERE pba3_block IN (SELECT pba3_block FROM sightings )""",
        "blocks",
        "sightings",
    ),
)
def hierarchy_map(spark, sf):
    """Region -> (name -> ids), read back as rows; counties stand for names, so that blocks share some."""
    seen = fx.sightings(spark, sf, species=False).select("pba3_block").distinct()
    named = joins.with_block_attributes(seen, fx.blocks(spark, sf)).withColumn("block_name", F.col("block_county"))
    nested = completion.region_hierarchy(named).select("block_region", F.explode("blocks").alias("block_name", "ids"))
    return nested.select("block_region", "block_name", F.explode("ids").alias("pba3_block"))


