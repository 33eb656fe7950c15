"""Data-quality reports."""

from __future__ import annotations


from .. import fixtures as fx
from ..operators import daylight, quality, starttime
from ..session import scratch_path
from ..sources import readers, writers
from .registry import query, with_views
from .spatial import MAP_VIEWS, mapped_blocks


def _effort(spark, sf):
    return fx.sightings(spark, sf, species=False)


@query(
    "dq_unique",
    with_views(
        """SELECT 'place and start' AS "check", count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (n > 1) = 0 AS ok FROM
  (SELECT count(*) AS n FROM (SELECT DISTINCT observation_datetime, longitude, latitude FROM sightings ) GROUP BY observation_datetime, longitude, latitude)
UNION ALL SELECT 'checklist_id', count(*) FILTER (n > 1), count(*) FILTER (n > 1) = 0 FROM
  (SELECT count(*) AS n FROM sightings GROUP BY checklist_id)""",
        "sightings",
    ),
)
def dq_unique(spark, sf):
    x = _effort(spark, sf)
    keys = ["observation_datetime", "longitude", "latitude"]
    return quality.unique_report(daylight.daylight_keys(x), keys, "place and start").unionByName(
        quality.unique_report(x, ["checklist_id"])
    )


@query(
    "dq_one_to_one",
    with_views(
        """SELECT 'pba3_block -> pba2_block' AS "check", count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (n > 1) = 0 AS ok
FROM (SELECT count(DISTINCT pba2_block) AS n FROM block_map WHERE pba3_block IS NOT NULL GROUP BY pba3_block)
UNION ALL SELECT 'pba2_block -> pba3_block', count(*) FILTER (n > 1), count(*) FILTER (n > 1) = 0
FROM (SELECT count(*) AS n FROM (SELECT DISTINCT pba2_block, pba3_block FROM block_map ) GROUP BY pba2_block)""",
        *MAP_VIEWS,
    ),
)
def dq_one_to_one(spark, sf):
    return quality.one_to_one_report(mapped_blocks(spark, sf), "pba3_block", "pba2_block")


@query(
    "dq_coverage",
    with_views(
        """SELECT 'all of a in b' AS "check", count(*) AS missing, count(*) = 0 AS ok FROM
  (SELECT pba3_block FROM sightings EXCEPT SELECT pba3_block FROM blocks )
UNION ALL SELECT 'all of b in a', count(*), count(*) = 0 FROM
  (SELECT pba3_block FROM blocks EXCEPT SELECT pba3_block FROM sightings )""",
        "sightings",
        "blocks",
    ),
)
def dq_coverage(spark, sf):
    return quality.coverage_report(_effort(spark, sf), fx.blocks(spark, sf), ["pba3_block"])


@query(
    "dq_keys",
    with_views(
        """WITH checks AS (
  SELECT 'checklist' AS "check", count(*) AS failures FROM (SELECT 1 FROM sightings GROUP BY checklist_id HAVING count(*) > 1)
  UNION ALL SELECT 'place and start', count(*) FROM (SELECT 1 FROM sightings GROUP BY observation_datetime, longitude, latitude HAVING count(*) > 1)
  UNION ALL SELECT 'checklist_id -> observation_datetime', count(*) FROM (SELECT 1 FROM (SELECT DISTINCT checklist_id, observation_datetime FROM sightings )
    WHERE checklist_id IS NOT NULL GROUP BY checklist_id HAVING count(*) > 1)
  UNION ALL SELECT 'observation_datetime -> checklist_id', count(*) FROM (SELECT 1 FROM (SELECT DISTINCT checklist_id, observation_datetime FROM sightings )
    GROUP BY observation_datetime HAVING count(*) > 1)
  UNION ALL SELECT 'all in blocks', count(*) FROM (SELECT pba3_block FROM sightings EXCEPT SELECT pba3_block FROM blocks )
  UNION ALL SELECT 'all of blocks', count(*) FROM (SELECT pba3_block FROM blocks EXCEPT SELECT pba3_block FROM sightings ))
SELECT "check", failures, failures = 0 AS ok FROM checks""",
        "sightings",
        "blocks",
    ).replace("\nWITH checks AS (", ",\nchecks AS ("),
)
def dq_keys(spark, sf):
    """Six checks of the sightings' keys over one reading."""
    return quality.key_reports(
        _effort(spark, sf),
        {"checklist": ["checklist_id"], "place and start": ["observation_datetime", "longitude", "latitude"]},
        [("checklist_id", "observation_datetime")],
        {"blocks": (fx.blocks(spark, sf), ["pba3_block"])},
    )


@query(
    "dq_dupes_flag",
    with_views(
        """SELECT count(*) AS checklists, count(*) > 0 AS present FROM (SELECT checklist_id FROM
  (SELECT DISTINCT checklist_id, observation_datetime FROM sightings ) GROUP BY 1 HAVING count(*) > 1)""",
        "sightings",
    ),
)
def dq_dupes_flag(spark, sf):
    return starttime.start_time_report(_effort(spark, sf))


@query(
    "dq_tz",
    with_views(
        """SELECT "column", count(*) AS "rows", 0::BIGINT AS changed, TRUE AS ok FROM
  (SELECT DISTINCT observation_datetime, longitude, latitude FROM sightings )
  CROSS JOIN (SELECT unnest(['observation_datetime', 'sunrise', 'sunset']) AS "column") GROUP BY 1""",
        "sightings",
    ),
)
def dq_tz(spark, sf):
    """The daylight table written and read back."""
    before = daylight.daylight_table(_effort(spark, sf))
    path = scratch_path(spark, "daylight")
    writers.write_parquet(before, path)
    after = readers.read_parquet(spark, path)
    keys = ["observation_datetime", "longitude", "latitude"]
    return quality.same_times_report(before, after, keys, ["observation_datetime", "sunrise", "sunset"])


@query(
    "dq_null_datetime",
    with_views(
        "SELECT protocol_name, count(*) AS n FROM sightings WHERE observation_datetime IS NULL GROUP BY 1", "sightings"
    ),
)
def dq_null_datetime(spark, sf):
    return quality.missing_start_by_protocol(_effort(spark, sf))


