"""Reshape operators and the breeding calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..lookups import MONTHS, WEEKS, glossary_table
from ..operators import calendar, compare, reshape
from ..operators.sampling import with_row_number
from .registry import VIEWS, query, with_views


def _effort(spark, sf):
    return fx.sightings(spark, sf, species=False)


VIEWS["old_matrix"] = """
SELECT pba3_block, word AS common_name, breeding_category_desc, breeding_rank FROM
  (SELECT DISTINCT pba3_block FROM lines WHERE l_returnflag = 'R')
  CROSS JOIN (SELECT DISTINCT p_name AS word FROM part)
  LEFT JOIN (SELECT pba3_block AS k, p_name AS w, 1 + max(l_linenumber % 4) AS rank
    FROM lines WHERE l_returnflag = 'R' GROUP BY 1, 2) ON w = word AND k IS NOT DISTINCT FROM pba3_block
  LEFT JOIN categories ON breeding_rank = rank"""


@query(
    "unpivot_matrix",
    with_views("SELECT pba3_block, common_name, breeding_category_desc FROM old_matrix ", "old_matrix"),
)
def unpivot_matrix(spark, sf):
    return reshape.unpivot_columns(
        fx.old_survey_matrix(spark, sf), ["pba3_block"], "common_name", "breeding_category_desc"
    )


@query(
    "unpivot_old_ranks",
    with_views(
        """SELECT DISTINCT pba3_block, common_name, breeding_category_desc AS pba2_breeding_category_max,
  breeding_rank AS pba2_breeding_rank_max FROM old_matrix """,
        "old_matrix",
    ),
)
def unpivot_old_ranks(spark, sf):
    """The whole way from the wide old-survey matrix to ranked pairs."""
    return compare.old_ranks_from_matrix(fx.old_survey_matrix(spark, sf), ["pba3_block"])


@query(
    "explode_list",
    with_views(
        """SELECT checklist_id, o AS observer_id, count(*) AS n FROM
  (SELECT checklist_id, unnest(string_split(observer_id, ',')) AS o FROM sightings ) GROUP BY 1, 2""",
        "sightings",
    ),
)
def explode_list(spark, sf):
    rows = reshape.explode_list(_effort(spark, sf).select("checklist_id", "observer_id"), "observer_id")
    return rows.groupBy("checklist_id", "observer_id").agg(F.count("*").alias("n"))


VIEWS["week_counts"] = """
SELECT common_name, strftime(o_orderdate, '%b') || ' ' || least(4, (day(o_orderdate) - 1) // 8 + 1)::VARCHAR AS week,
  count(*) AS n FROM lines GROUP BY 1, 2"""
VIEWS["week_list"] = f"""
SELECT m || ' ' || q::VARCHAR AS week, ((i - 1) * 4 + q)::INTEGER AS year_week_index FROM
  (SELECT unnest({MONTHS!r}) AS m, generate_subscripts({MONTHS!r}, 1) AS i) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS q)"""
VIEWS["calendar_rows"] = """
SELECT common_name, length(common_name) % 3 = 0 AS priority_species, week, year_week_index,
  coalesce((['', 'B', 'E', 'M', 'N'])[CAST(n % 5 AS INTEGER) + 1], '') AS breeding_calendar_code, n IS NULL AS missing
FROM (SELECT DISTINCT common_name FROM lines ) CROSS JOIN week_list LEFT JOIN week_counts USING (common_name, week)"""


def codes_frame(spark, sf):
    return calendar.code_columns(calendar.clean_calendar(fx.calendar_raw(spark, sf)))


def _wide_sql(weeks: list[str], raw: bool) -> str:
    value = "CASE WHEN NOT missing THEN breeding_calendar_code END" if raw else "breeding_calendar_code"
    return ", ".join(f"max({value}) FILTER (week = '{w}') AS \"{w}\"" for w in weeks)


@query(
    "cal_clean",
    with_views(
        f"""SELECT * FROM (SELECT common_name, min(l_partkey) AS taxonomic_order FROM lines GROUP BY 1) JOIN
  (SELECT common_name, any_value(priority_species) AS priority_species, {_wide_sql(WEEKS, True)} FROM calendar_rows GROUP BY 1)
  USING (common_name)""",
        "lines",
        "calendar_rows",
    ),
)
def cal_clean(spark, sf):
    df = calendar.clean_calendar(fx.calendar_raw(spark, sf))
    return df.drop(*calendar.SAFE_DATES)


def _safe(n: int) -> str:
    return f"try_strptime('1996-' || strftime(first + {n}, '%-d-%b'), '%Y-%-d-%b')"


@query(
    "cal_safe_dates",
    with_views(
        f"""SELECT common_name, strftime({_safe(20)}, '%Y-%m-%d') AS date_probable_start,
  CASE WHEN length(starred) % 4 <> 0 THEN strftime({_safe(10)}, '%Y-%m-%d') END AS date_possible_start,
  strftime({_safe(200)}, '%Y-%m-%d') AS date_possible_end, strftime({_safe(190)}, '%Y-%m-%d') AS date_probable_end
FROM (SELECT common_name, common_name AS starred, CAST(min(o_orderdate) AS DATE) AS first FROM lines GROUP BY 1)""",
        "lines",
    ),
)
def cal_safe_dates(spark, sf):
    columns = calendar.safe_date_columns(calendar.clean_calendar(fx.calendar_raw(spark, sf)))
    df = calendar.safe_dates(columns, 1996)
    return df.select("common_name", *[F.col(c).cast("string").alias(c) for c in df.columns if c != "common_name"])


@query(
    "cal_long",
    with_views(
        "SELECT common_name, priority_species, week, breeding_calendar_code, year_week_index FROM calendar_rows ",
        "calendar_rows",
    ),
)
def cal_long(spark, sf):
    return calendar.calendar_long(codes_frame(spark, sf))


@query(
    "cal_window",
    with_views(
        f"""SELECT * FROM (SELECT common_name, any_value(priority_species) AS priority_species,
  {_wide_sql(WEEKS[36:], False)} FROM calendar_rows GROUP BY 1) WHERE "Oct 1" <> ''""",
        "calendar_rows",
    ),
)
def cal_window(spark, sf):
    return calendar.calendar_window(codes_frame(spark, sf), "Oct", drop_empty=True)


@query(
    "cal_glossary",
    with_views(
        """SELECT season_code, description, count(*) AS n FROM calendar_rows JOIN (VALUES ('B','Breeding season only'),
  ('E','Either migration or breeding'), ('M','Migration'), ('N','Non-breeding season')) g(season_code, description)
  ON breeding_calendar_code = season_code GROUP BY 1, 2""",
        "calendar_rows",
    ),
)
def cal_glossary(spark, sf):
    long = calendar.calendar_long(codes_frame(spark, sf)).withColumnRenamed("breeding_calendar_code", "season_code")
    return long.join(glossary_table(spark), "season_code").groupBy("season_code", "description").agg(
        F.count("*").alias("n")
    )


@query(
    "win_row_number_week",
    with_views(
        "SELECT common_name, week, year_week_index::INTEGER AS week_row FROM calendar_rows ", "calendar_rows"
    ),
)
def win_row_number_week(spark, sf):
    """Index of a week within its species, by an explicit order."""
    long = calendar.calendar_long(codes_frame(spark, sf))
    return with_row_number(long, ["common_name"], ["year_week_index"], "week_row").select("common_name", "week", "week_row")
