"""Aggregations: block metrics, seasons, start times, charts, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..lookups import SEASONS
from ..operators import daylight, expected, histogram, joins, metrics, month_cube, reshape, sampling, season, spatial, starttime
from ..session import scratch_path
from .registry import query, r6, text, with_views

HOURS = ["duration_hours_diurnal", "duration_hours_nocturnal", "duration_hours_unknown"]


def _effort(spark, sf):
    return fx.sightings(spark, sf, species=False)


def _kept(spark, name, df):
    """Rows that several steps read, written once."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


@query(
    "calc_checklist_count",
    with_views("SELECT pba3_block, count(DISTINCT checklist_id) AS checklist_count FROM sightings GROUP BY 1", "sightings"),
)
def calc_checklist_count(spark, sf):
    return metrics.calc_checklist_count(_effort(spark, sf))


@query(
    "calc_species_observed",
    with_views("SELECT pba3_block, count(DISTINCT common_name) AS species_observed FROM sightings GROUP BY 1", "sightings"),
)
def calc_species_observed(spark, sf):
    return metrics.calc_species_observed(fx.sightings(spark, sf))


@query(
    "calc_atlasers",
    with_views(
        """SELECT pba3_block, count(DISTINCT o) AS birders FROM
(SELECT pba3_block, unnest(string_split(observer_id, ',')) AS o FROM sightings ) GROUP BY 1""",
        "sightings",
    ),
)
def calc_atlasers(spark, sf):
    return metrics.calc_atlasers(_effort(spark, sf))


@query(
    "calc_block_effort",
    with_views(
        """SELECT pba3_block, round(coalesce(sum(m), 0)/60, 6) AS duration_hours_total,
  round(coalesce(sum(k), 0), 6) AS effort_distance_km FROM
(SELECT pba3_block, checklist_id, max(duration_minutes) AS m, max(effort_distance_km) AS k FROM sightings GROUP BY 1, 2)
GROUP BY 1""",
        "sightings",
    ),
)
def calc_block_effort(spark, sf):
    return rounded(metrics.calc_block_effort(_effort(spark, sf)), "duration_hours_total", "effort_distance_km")


_COUNTS = ", ".join(
    f"nullif(count(*) FILTER (rank = {i}), 0) AS \"{d}\""
    for i, d in enumerate(["Not Observed", "Observed", "Possible", "Probable", "Confirmed"])
)


@query(
    "calc_species_coded",
    with_views(
        f"""SELECT pba3_block, {_COUNTS} FROM (SELECT pba3_block, common_name, max(breeding_rank) AS rank FROM sightings 
GROUP BY 1, 2 HAVING count(breeding_rank) = count(*)) GROUP BY 1""",
        "sightings",
    ),
)
def calc_species_coded(spark, sf):
    return metrics.calc_species_coded(fx.sightings(spark, sf))


def _hours_sql(of: str, fill: bool) -> str:
    one = "sum(duration_minutes) FILTER (checklist_type = '{0}')/60"
    one = "coalesce(" + one + ", 0)" if fill else one
    return ", ".join(f"round({one.format(n)}, 6) AS {of}{n}" for n in ("diurnal", "nocturnal", "unknown"))


@query(
    "calc_nocturnal_diurnal_effort",
    with_views(
        f"""SELECT t.*, d.* EXCLUDE (b) FROM
(SELECT pba3_block, {_hours_sql('duration_hours_', True)} FROM labelled WHERE season = 'All seasons' GROUP BY 1) t
JOIN (SELECT pba3_block AS b, strftime(observation_datetime, '%Y-%m-%d') AS observation_date, {_hours_sql('date_', False)}
  FROM labelled WHERE season = 'All seasons' GROUP BY 1, 2) d ON t.pba3_block IS NOT DISTINCT FROM d.b""",
        "labelled",
    ),
)
def calc_nocturnal_diurnal_effort(spark, sf):
    """Totals per block with the nested per-date hours unnested beside them."""
    x = _effort(spark, sf)
    df = metrics.calc_nocturnal_diurnal_effort(x, starttime.fixed_start_times(x))
    flat = df.select("pba3_block", *HOURS, F.inline("effort_breakdown").alias("observation_date", "d", "n", "u"))
    return flat.select(
        "pba3_block",
        *[r6(c).alias(c) for c in HOURS],
        F.col("observation_date").cast("string").alias("observation_date"),
        r6("d").alias("date_diurnal"),
        r6("n").alias("date_nocturnal"),
        r6("u").alias("date_unknown"),
    )


@query(
    "day_night_label",
    with_views(
        """SELECT pba3_block, checklist_type, count(*) AS n, round(sum(duration_minutes), 6) AS minutes
FROM labelled WHERE season = 'All seasons' GROUP BY 1, 2""",
        "labelled",
    ),
)
def day_night_label(spark, sf):
    x = _effort(spark, sf)
    df = metrics.checklist_effort(x, starttime.fixed_start_times(x))
    return df.groupBy("pba3_block", "checklist_type").agg(
        F.count("*").alias("n"), r6(F.sum("duration_minutes")).alias("minutes")
    )


@query(
    "calc_breeding_season_coverage",
    with_views(
        """SELECT pba3_block, count(DISTINCT month(observation_datetime)) AS breeding_season_months_covered FROM sightings 
WHERE month(observation_datetime) BETWEEN 4 AND 8 GROUP BY 1""",
        "sightings",
    ),
)
def calc_breeding_season_coverage(spark, sf):
    return metrics.calc_breeding_season_coverage(_effort(spark, sf))


@query(
    "calc_nocturnal_species_coded",
    with_views(
        """SELECT pba3_block, count(DISTINCT common_name) FILTER (breeding_rank >= 2 AND
  common_name IN (SELECT common_name FROM nocturnal )) AS nocturnal_species_coded FROM sightings GROUP BY 1""",
        "sightings",
        "nocturnal",
    ),
)
def calc_nocturnal_species_coded(spark, sf):
    return metrics.calc_nocturnal_species_coded(fx.sightings(spark, sf), fx.nocturnal_species(spark, sf))


@query(
    "agg_mode",
    """SELECT user_id, event_type AS usual_event FROM (SELECT user_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
FROM events GROUP BY 1, 2) WHERE rn = 1""",
)
def agg_mode(spark, sf):
    return starttime.modal_value(fx.table(spark, sf, "events"), ["user_id"], "event_type", "usual_event")


@query(
    "win_mode",
    """SELECT event_id, usual_event FROM events JOIN (SELECT user_id, event_type AS usual_event FROM (SELECT user_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
FROM events GROUP BY 1, 2) WHERE rn = 1) USING (user_id)""",
)
def win_mode(spark, sf):
    df = starttime.with_modal_value(fx.table(spark, sf, "events"), ["user_id"], "event_type", "usual_event")
    return df.select("event_id", "usual_event")


@query(
    "agg_fixed_start",
    with_views(
        "SELECT checklist_id, strftime(observation_datetime_fixed, '%Y-%m-%d %H:%M:%S') AS observation_datetime_fixed FROM fixed ",
        "fixed",
    ),
)
def agg_fixed_start(spark, sf):
    df = starttime.fixed_start_times(_effort(spark, sf))
    return df.select("checklist_id", text("observation_datetime_fixed").alias("observation_datetime_fixed"))


@query(
    "agg_dupe_start_times",
    with_views(
        """SELECT checklist_id, count(*) AS n FROM (SELECT DISTINCT checklist_id, observation_datetime FROM sightings )
GROUP BY 1 HAVING count(*) > 1""",
        "sightings",
    ),
)
def agg_dupe_start_times(spark, sf):
    return starttime.start_time_counts(_effort(spark, sf))


@query(
    "agg_multiplicity",
    with_views(
        """SELECT n, count(*) AS checklists FROM (SELECT checklist_id, count(*) AS n FROM
(SELECT DISTINCT checklist_id, observation_datetime, observer_id FROM sightings ) GROUP BY 1) GROUP BY 1""",
        "sightings",
    ),
)
def agg_multiplicity(spark, sf):
    rows = _effort(spark, sf).select("checklist_id", "observation_datetime", "observer_id").distinct()
    return metrics.multiplicity(rows, "checklist_id", "checklists")


@query(
    "agg_count",
    with_views("SELECT breeding_category, protocol_name, count(*) AS n FROM sightings GROUP BY 1, 2", "sightings"),
)
def agg_count(spark, sf):
    df = _effort(spark, sf).groupBy("breeding_category", "protocol_name").agg(F.count("*").alias("n"))
    return df.orderBy("breeding_category", "protocol_name")


@query(
    "agg_distinct_rows",
    with_views(
        """SELECT *, (SELECT count(DISTINCT checklist_id) FROM sightings ) AS checklists FROM
(SELECT DISTINCT breeding_category, observation_month, breeding_rank FROM sightings )""",
        "sightings",
    ),
)
def agg_distinct_rows(spark, sf):
    x = _effort(spark, sf)
    ids = x.select("checklist_id").distinct().agg(F.count("*"))
    return x.select("breeding_category", "observation_month", "breeding_rank").distinct().withColumn(
        "checklists", ids.scalar()
    )


_PLACES = """SELECT longitude, latitude, count(*) AS n FROM
(SELECT DISTINCT checklist_id, longitude, latitude FROM sightings ) GROUP BY 1, 2"""


@query(
    "agg_location_count",
    with_views(
        f"SELECT round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, n AS checklist_count FROM ({_PLACES})",
        "sightings",
    ),
)
def agg_location_count(spark, sf):
    return rounded(metrics.location_counts(_effort(spark, sf)), "longitude", "latitude")


@query(
    "agg_effort_naive_vs_adj",
    with_views(
        """SELECT a.pba3_block, round(h1, 6) AS duration_hours_total_naive, round(k1, 6) AS effort_distance_km_naive,
  first_start AS observation_datetime, round(h2, 6) AS duration_hours_total_adj, round(k2, 6) AS effort_distance_km_adj FROM
  (SELECT pba3_block, sum(duration_minutes)/60 AS h1, sum(effort_distance_km) AS k1 FROM
    (SELECT DISTINCT pba3_block, checklist_id, duration_minutes, effort_distance_km FROM sightings ) GROUP BY 1) a
  JOIN (SELECT pba3_block, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_start, sum(m)/60 AS h2, sum(k) AS k2 FROM
    (SELECT pba3_block, checklist_id, min(observation_datetime) AS t, max(duration_minutes) AS m,
       max(effort_distance_km) AS k FROM sightings GROUP BY 1, 2) GROUP BY 1) b
  ON a.pba3_block IS NOT DISTINCT FROM b.pba3_block""",
        "sightings",
    ),
)
def agg_effort_naive_vs_adj(spark, sf):
    x = _effort(spark, sf)
    df = joins.null_safe_join(metrics.effort_naive(x), metrics.effort_adjusted(x), ["pba3_block"])
    names = [c for c in df.columns if c not in ("pba3_block", "observation_datetime")]
    return rounded(df, *names).withColumn("observation_datetime", text("observation_datetime"))


@query(
    "agg_month_effort",
    with_views(
        f"""SELECT pba3_block, year(observation_datetime) AS obs_year, strftime(observation_datetime, '%b') AS obs_month,
  {_hours_sql('duration_hours_', True)}, round(sum(duration_minutes)/60, 6) AS duration_hours_total
FROM labelled WHERE season = 'All seasons' GROUP BY 1, 2, 3""",
        "labelled",
    ),
)
def agg_month_effort(spark, sf):
    x = _effort(spark, sf)
    nested = metrics.calc_nocturnal_diurnal_effort(x, starttime.fixed_start_times(x))
    dated = nested.select("pba3_block", F.inline("effort_breakdown"))
    df = metrics.month_effort(dated, ["pba3_block", "obs_year", "obs_month"])
    return rounded(df, *HOURS, "duration_hours_total").withColumn("obs_year", F.col("obs_year").cast("bigint"))


def _season_sql() -> str:
    months = "observation_month = month"
    return f"""
base AS (SELECT season, s.* FROM sightings s JOIN seasons ON {months}),
m_count AS (SELECT season, pba3_block, count(DISTINCT checklist_id) AS checklist_count FROM base GROUP BY 1, 2),
m_species AS (SELECT season, pba3_block, count(DISTINCT common_name) AS species_observed,
  count(DISTINCT common_name) FILTER (breeding_rank >= 2 AND common_name IN (SELECT common_name FROM nocturnal ))
    AS nocturnal_species_coded FROM base GROUP BY 1, 2),
m_birders AS (SELECT season, pba3_block, count(DISTINCT o) AS birders FROM
  (SELECT season, pba3_block, unnest(string_split(observer_id, ',')) AS o FROM base) GROUP BY 1, 2),
m_effort AS (SELECT season, pba3_block, round(coalesce(sum(m), 0)/60, 6) AS duration_hours_total,
  round(coalesce(sum(k), 0), 6) AS effort_distance_km FROM
  (SELECT season, pba3_block, checklist_id, max(duration_minutes) AS m, max(effort_distance_km) AS k FROM base
   GROUP BY 1, 2, 3) GROUP BY 1, 2),
m_coded AS (SELECT season, pba3_block, {_COUNTS} FROM (SELECT season, pba3_block, common_name, max(breeding_rank) AS rank
  FROM base GROUP BY 1, 2, 3 HAVING count(breeding_rank) = count(*)) GROUP BY 1, 2),
m_dn AS (SELECT season, pba3_block, {_hours_sql('duration_hours_', True)},
  count(DISTINCT coalesce(CAST(observation_datetime AS DATE), DATE '1900-01-01')) AS dates FROM labelled GROUP BY 1, 2),
m_cover AS (SELECT season, pba3_block, count(DISTINCT month(observation_datetime)) AS breeding_season_months_covered
  FROM base WHERE month(observation_datetime) BETWEEN 4 AND 8 GROUP BY 1, 2),
summary AS (SELECT m_count.season, m_count.pba3_block, checklist_count, duration_hours_total, effort_distance_km,
  duration_hours_diurnal, duration_hours_nocturnal, duration_hours_unknown, dates, breeding_season_months_covered,
  species_observed, nocturnal_species_coded, "Not Observed", "Observed", "Possible", "Probable", "Confirmed", birders
FROM m_count""" + "".join(
        f"\nLEFT JOIN {t} ON {t}.season = m_count.season AND {t}.pba3_block IS NOT DISTINCT FROM m_count.pba3_block"
        for t in ("m_species", "m_birders", "m_effort", "m_coded", "m_dn", "m_cover")
    ) + ")"


def with_summary(body: str, *views: str) -> str:
    """A query over the season summary view, besides adapter views."""
    head = with_views("", "sightings", "seasons", "nocturnal", "labelled", *views).strip()
    return head + ",\n" + _season_sql().strip() + "\n" + body.strip()


def summary_frame(spark, sf, x=None, seasons=SEASONS):
    x = fx.sightings(spark, sf) if x is None else x
    return season.summarize_all_seasons(x, fx.nocturnal_species(spark, sf), seasons=seasons)


SUMMARY_ROUNDED = ["duration_hours_total", "effort_distance_km", *HOURS]


@query("summarize_season", with_summary("SELECT * EXCLUDE (season) FROM summary WHERE season = 'Breeding'"))
def summarize_season(spark, sf):
    df = season.summarize_season(fx.sightings(spark, sf), "Breeding", fx.nocturnal_species(spark, sf))
    df = df.withColumn("dates", F.array_size("effort_breakdown").cast("bigint")).drop("effort_breakdown")
    return rounded(df, *SUMMARY_ROUNDED)


@query("summarize_all_seasons", with_summary("SELECT * FROM summary"))
def summarize_all_seasons(spark, sf):
    df = summary_frame(spark, sf)
    df = df.withColumn("dates", F.array_size("effort_breakdown").cast("bigint")).drop("effort_breakdown")
    return rounded(df, *SUMMARY_ROUNDED)


@query("summarize_all_seasons_cube", with_summary("SELECT * FROM summary"))
def summarize_all_seasons_cube(spark, sf):
    """The same from the cube of months, over a table bucketed by checklist."""
    cube = month_cube.build_cube(fx.bucketed_sightings(spark, sf), keep=lambda name, df: _kept(spark, f"cube_{name}", df))
    df = month_cube.seasons_of_cube(cube, fx.nocturnal_species(spark, sf))
    df = df.withColumn("dates", F.array_size("effort_breakdown").cast("bigint")).drop("effort_breakdown")
    return rounded(df, *SUMMARY_ROUNDED)


@query(
    "summarize_effort",
    with_views(
        """SELECT "Effort type", round(v, 2) AS "Value" FROM (SELECT unnest(['Total','Diurnal','Nocturnal','Unknown']) AS "Effort type",
  unnest([t, d, n, u]) AS v FROM (SELECT
    (SELECT sum(m)/60 FROM (SELECT checklist_id, max(duration_minutes) AS m FROM sightings WHERE pba3_block = 'B03'
       AND observation_month IN ('Apr','May','Jun','Jul','Aug') GROUP BY 1)) AS t,
    coalesce(sum(duration_minutes) FILTER (checklist_type = 'diurnal'), 0)/60 AS d,
    coalesce(sum(duration_minutes) FILTER (checklist_type = 'nocturnal'), 0)/60 AS n,
    coalesce(sum(duration_minutes) FILTER (checklist_type = 'unknown'), 0)/60 AS u
  FROM labelled WHERE pba3_block = 'B03' AND season = 'Breeding'))""",
        "sightings",
        "labelled",
    ),
)
def summarize_effort(spark, sf):
    one = fx.sightings(spark, sf).filter("pba3_block = 'B03'")
    return metrics.summarize_effort(season.summarize_season(one, "Breeding", fx.nocturnal_species(spark, sf)))


@query(
    "summarize_breeding_codes",
    with_views(
        """SELECT "Code", nullif(count(*) FILTER (rank = r), 0) AS "Count" FROM
(SELECT unnest(['Confirmed','Probable','Possible','Observed']) AS "Code", unnest([4, 3, 2, 1]) AS r) CROSS JOIN
(SELECT common_name, max(breeding_rank) AS rank FROM sightings WHERE pba3_block = 'B03' GROUP BY 1) GROUP BY 1""",
        "sightings",
    ),
)
def summarize_breeding_codes(spark, sf):
    x = fx.sightings(spark, sf).filter("pba3_block = 'B03'")
    return metrics.summarize_breeding_codes(metrics.calc_species_coded(x))


_EXPECTED = """
spec AS (SELECT * FROM sightings WHERE observation_month IN ('Apr','May','Jun','Jul','Aug') AND pba3_block IS NOT NULL),
grid AS (SELECT DISTINCT p.pba3_block, common_name, observation_month, checklist_id
  FROM (SELECT DISTINCT pba3_block, common_name FROM spec) p JOIN (SELECT DISTINCT pba3_block, checklist_id FROM spec) c
    ON p.pba3_block = c.pba3_block CROSS JOIN (SELECT unnest(['Apr','May','Jun','Jul','Aug']) AS observation_month)),
expected AS (SELECT pba3_block, common_name, observation_month,
  count(observation_count) AS observations, count(DISTINCT checklist_id) AS checklist_count,
  avg(CASE WHEN observation_count IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS observed_pct
  FROM grid LEFT JOIN spec USING (pba3_block, common_name, observation_month, checklist_id) GROUP BY 1, 2, 3)"""


def with_expected(body: str) -> str:
    return with_views("", "sightings").strip() + "," + _EXPECTED + "\n" + body.strip()


def expected_frame(spark, sf):
    return expected.species_observed_pct(fx.sightings(spark, sf))


@query(
    "species_observed_pct",
    with_expected(
        "SELECT pba3_block, common_name, observation_month, observations, checklist_count, round(observed_pct, 6) AS observed_pct FROM expected"
    ),
)
def species_observed_pct(spark, sf):
    return rounded(expected_frame(spark, sf), "observed_pct")


@query(
    "species_observed_state",
    with_expected(
        """SELECT common_name, sum(checklist_count)::BIGINT AS checklist_count, sum(observations)::BIGINT AS observations
FROM expected GROUP BY 1"""
    ),
)
def species_observed_state(spark, sf):
    return expected.species_totals(expected_frame(spark, sf))


@query(
    "weighted_presence",
    with_expected(
        """SELECT pba3_block, common_name, observation_month, observations, checklist_count, round(observed_pct, 6) AS observed_pct,
  round(observed_pct * checklist_count, 6) AS observed_pct_weighted
FROM expected WHERE observation_month = 'Jun' AND common_name =
  (SELECT min(common_name) FROM sightings WHERE observation_month = 'Jun' AND pba3_block IS NOT NULL)"""
    ),
)
def weighted_presence(spark, sf):
    x = fx.sightings(spark, sf)
    mapped = joins.in_season(x, "Breeding").select("pba3_block").distinct()
    seen = x.filter("observation_month = 'Jun' and pba3_block is not null")
    first = seen.agg(F.min("common_name")).scalar()
    df = expected.weighted_presence(expected.species_observed_pct(x), mapped, first, "Jun")
    return rounded(df, "observed_pct", "observed_pct_weighted")


@query(
    "eb_shrinkage",
    with_expected(
        """SELECT pba3_block, common_name, observation_month, round(observations/checklist_count, 6) AS raw,
  round((mu*w + observations)/(w + checklist_count), 6) AS fitted, round(mu, 6) AS prior_mean FROM expected CROSS JOIN
(SELECT mu, mu*(1-mu)/s2 - 1 AS w FROM (SELECT avg(observations/checklist_count) AS mu,
  var_samp(observations/checklist_count) AS s2 FROM expected))"""
    ),
)
def eb_shrinkage(spark, sf):
    df = expected.shrink_rates(expected_frame(spark, sf))
    return df.select(
        "pba3_block",
        "common_name",
        "observation_month",
        r6("`.raw`").alias("raw"),
        r6("`.fitted`").alias("fitted"),
        r6("prior_mean").alias("prior_mean"),
    )


@query(
    "eb_shrinkage_totals",
    with_expected(
        """, totals AS (SELECT common_name, sum(checklist_count)::BIGINT AS n, sum(observations)::BIGINT AS k FROM expected GROUP BY 1)
SELECT common_name, round(k/n, 6) AS raw, round((mu*w + k)/(w + n), 6) AS fitted, round(mu, 6) AS prior_mean FROM totals CROSS JOIN
(SELECT mu, mu*(1-mu)/s2 - 1 AS w FROM (SELECT avg(k/n) AS mu, var_samp(k/n) AS s2 FROM totals))"""
    ),
)
def eb_shrinkage_totals(spark, sf):
    """Shrinkage of the per-species totals."""
    df = expected.shrink_rates(expected.species_totals(expected_frame(spark, sf)))
    return df.select(
        "common_name", r6("`.raw`").alias("raw"), r6("`.fitted`").alias("fitted"), r6("prior_mean").alias("prior_mean")
    )


_PAIRS = """, rates AS (SELECT least(observations, checklist_count) AS x, checklist_count AS n FROM expected WHERE checklist_count > 0)"""


@query(
    "eb_prior_likelihood",
    with_expected(
        _PAIRS + """, tails AS (
  SELECT k, count(*) FILTER (kind = 1) AS cx, count(*) FILTER (kind = 2) AS cy, count(*) FILTER (kind = 3) AS cn FROM (
    SELECT 1 AS kind, unnest(range(x::BIGINT)) AS k FROM rates UNION ALL SELECT 2, unnest(range((n - x)::BIGINT)) FROM rates
    UNION ALL SELECT 3, unnest(range(n::BIGINT)) FROM rates) GROUP BY k),
lists AS (SELECT list(k::DOUBLE) AS ks, list(cx::DOUBLE) AS cx, list(cy::DOUBLE) AS cy, list(cn::DOUBLE) AS cn FROM tails),
steps AS (
  SELECT 0 AS i, 1::DOUBLE AS a, 9::DOUBLE AS b
  UNION ALL
  SELECT i + 1, CASE WHEN i < 60 THEN a * ga / gn ELSE a - (hb * (ga - gn) - hab * (gb - gn)) / (ha * hb - hab * hab) END,
    CASE WHEN i < 60 THEN b * gb / gn ELSE b - (ha * (gb - gn) - hab * (ga - gn)) / (ha * hb - hab * hab) END
  FROM (SELECT *, -sa + sn AS ha, -sb + sn AS hb, sn AS hab FROM (SELECT i, a, b,
    list_sum(list_transform(list_zip(ks, cx), lambda t: t[2] / (a + t[1]))) AS ga,
    list_sum(list_transform(list_zip(ks, cy), lambda t: t[2] / (b + t[1]))) AS gb,
    list_sum(list_transform(list_zip(ks, cn), lambda t: t[2] / (a + b + t[1]))) AS gn,
    list_sum(list_transform(list_zip(ks, cx), lambda t: t[2] / pow(a + t[1], 2))) AS sa,
    list_sum(list_transform(list_zip(ks, cy), lambda t: t[2] / pow(b + t[1], 2))) AS sb,
    list_sum(list_transform(list_zip(ks, cn), lambda t: t[2] / pow(a + b + t[1], 2))) AS sn
  FROM steps, lists WHERE i < 75)))
SELECT round(a, 6) AS alpha, round(b, 6) AS beta, round(a / (a + b), 6) AS mean FROM steps WHERE i = 75"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def eb_prior_likelihood(spark, sf):
    """The SQL has no digamma: it adds up 1/(a + k) over the rows whose count is above k."""
    prior = expected.fit_beta_likelihood(expected_frame(spark, sf), keep=lambda df: _kept(spark, "pairs", df))
    return spark.range(1).select(
        F.round(F.lit(prior.alpha), 6).alias("alpha"), F.round(F.lit(prior.beta), 6).alias("beta"), F.round(F.lit(prior.mean), 6).alias("mean"))


@query(
    "eb_intervals",
    with_expected(
        """, prior AS (SELECT mu*w AS alpha, (1 - mu)*w AS beta FROM (SELECT mu, mu*(1-mu)/s2 - 1 AS w FROM
  (SELECT avg(observations/checklist_count) AS mu, var_samp(observations/checklist_count) AS s2 FROM expected))),
pairs AS (SELECT observations AS x, checklist_count AS n, count(*) AS rows FROM expected GROUP BY 1, 2),
posterior AS (SELECT x, n, rows, alpha + x AS a, beta + n - x AS b FROM pairs, prior),
halvings AS (
  SELECT x, n, rows, a, b, level, 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi FROM posterior, (SELECT unnest([0.025::DOUBLE, 0.975]) AS level)
  UNION ALL
  SELECT x, n, rows, a, b, level, i + 1, CASE WHEN below THEN middle ELSE lo END, CASE WHEN below THEN hi ELSE middle END FROM (
    SELECT *, exp(a*ln(middle) + b*ln(1 - middle) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a *
      list_reduce([{'t': 1::DOUBLE, 's': 1::DOUBLE}] || list_transform(range(1500), lambda k: {'t': k::DOUBLE, 's': 0::DOUBLE}),
        lambda p, q: {'t': p.t * (a + b + q.t) / (a + 1 + q.t) * middle, 's': p.s + p.t * (a + b + q.t) / (a + 1 + q.t) * middle}).s < level AS below
    FROM (SELECT *, (lo + hi)/2 AS middle FROM halvings WHERE i < 34)))
SELECT x AS observations, n AS checklist_count, any_value(rows) AS n_rows,
  round(max((lo + hi)/2) FILTER (level < 0.5), 6) AS low, round(max((lo + hi)/2) FILTER (level > 0.5), 6) AS high
FROM halvings WHERE i = 34 GROUP BY 1, 2"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def eb_intervals(spark, sf):
    """Central 95 % intervals of the shrunk rates, counted by what they depend on; the SQL sums a series instead of a fraction."""
    df = expected.rate_intervals(_kept(spark, "rates", expected_frame(spark, sf)))
    pairs = df.groupBy("observations", "checklist_count").agg(
        F.count("*").alias("n_rows"), F.any_value("`.low`").alias("low"), F.any_value("`.high`").alias("high"))
    return rounded(pairs, "low", "high")


@query(
    "density_curves",
    with_expected(
        """, counted AS (SELECT observation_month, observations/checklist_count AS v, count(*)::DOUBLE AS n FROM expected GROUP BY 1, 2),
stats AS (
  SELECT observation_month, count(*)::DOUBLE AS total, min(observations/checklist_count) AS lo, max(observations/checklist_count) AS hi,
    stddev_samp(observations/checklist_count) AS sd,
    (quantile_cont(observations/checklist_count, 0.75) - quantile_cont(observations/checklist_count, 0.25)) / 1.34 AS iqr FROM expected GROUP BY 1),
widths AS (SELECT *, 0.9::DOUBLE * CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) ELSE sd END * pow(total, -0.2::DOUBLE) AS h FROM stats WHERE sd > 0),
grids AS (SELECT *, lo - 3*h AS g0, (hi - lo + 6*h) / 511 AS d FROM widths),
placed AS (SELECT observation_month, n, v, total, h, g0, d, least(floor((v - g0)/d), 510) AS j, (v - g0)/d AS p FROM counted JOIN grids USING (observation_month)),
curve AS (SELECT observation_month, g, any_value(g0 + g*d) AS x, sum(n * ((1 - (p - j)) * exp(-0.5::DOUBLE * pow((g - j)*d/h, 2)) + (p - j) * exp(-0.5::DOUBLE * pow((g - j - 1)*d/h, 2))))
    / any_value(total*h*sqrt(2*pi())) AS density, any_value(h) AS h FROM placed, range(512) r(g) GROUP BY 1, 2)
SELECT observation_month, round(x, 6) AS x, round(density, 6) AS density, round(h, 6) AS bandwidth FROM curve"""
    ),
)
def density_curves(spark, sf):
    """Density of the observed shares by month; the SQL shares out and sums over all rows at every point."""
    rates = expected_frame(spark, sf).select(
        "observation_month", (F.col("observations") / F.col("checklist_count")).alias("rate"))
    return rounded(histogram.density(_kept(spark, "shares", rates), "rate", ["observation_month"]), "x", "density", "bandwidth")


@query(
    "complete_grid",
    with_views(
        """SELECT pba3_block, common_name, observation_month FROM (SELECT DISTINCT pba3_block, common_name FROM sightings )
CROSS JOIN (SELECT unnest(['Apr','May','Jun','Jul','Aug']) AS observation_month)""",
        "sightings",
    ),
)
def complete_grid(spark, sf):
    return expected.species_month_grid(fx.sightings(spark, sf), ["Apr", "May", "Jun", "Jul", "Aug"])


@query(
    "day_night_export",
    with_views(
        """SELECT checklist_id, pba3_block, duration_minutes::VARCHAR AS duration_minutes, checklist_type,
  strftime(observation_datetime, '%Y-%m-%d') AS observation_date, strftime(observation_datetime, '%H:%M:%S') AS observation_time,
  strftime(sunrise, '%Y-%m-%d') AS sunrise_date, strftime(sunrise, '%H:%M:%S') AS sunrise_time,
  strftime(sunset, '%Y-%m-%d') AS sunset_date, strftime(sunset, '%H:%M:%S') AS sunset_time
FROM labelled WHERE season = 'All seasons' AND pba3_block = 'B03'""",
        "labelled",
    ),
)
def day_night_export(spark, sf):
    x = _effort(spark, sf).filter("pba3_block = 'B03'")
    df = metrics.checklist_effort(x, starttime.fixed_start_times(x))
    split = {}
    for column, name in (("observation_datetime", "observation"), ("sunrise", "sunrise"), ("sunset", "sunset")):
        split[f"{name}_date"] = F.date_format(column, "yyyy-MM-dd")
        split[f"{name}_time"] = F.date_format(column, "HH:mm:ss")
    out = df.withColumns(split).select("checklist_id", "pba3_block", "duration_minutes", "checklist_type", *split)
    return out.select(*[F.col(c).cast("string").alias(c) for c in out.columns])


@query(
    "hist_bins",
    """SELECT x_bin, y_bin, count(*) AS n FROM (SELECT
  least(30, floor((value - lo)/((hi - lo)/30)) + 1)::INTEGER AS x_bin,
  least(30, floor((u - ulo)/((uhi - ulo)/30)) + 1)::INTEGER AS y_bin
FROM (SELECT value, user_id::DOUBLE AS u FROM events) CROSS JOIN
  (SELECT min(value) AS lo, max(value) AS hi, min(user_id)::DOUBLE AS ulo, max(user_id)::DOUBLE AS uhi FROM events))
GROUP BY 1, 2""",
)
def hist_bins(spark, sf):
    return histogram.histogram_2d(fx.table(spark, sf, "events"), "value", "user_id")


@query(
    "hist_bins_1d",
    with_views(
        """SELECT least(30, floor((c - lo)/((hi - lo)/30)) + 1)::INTEGER AS bin, count(*) AS n
FROM (SELECT n::DOUBLE AS c, min(n) OVER ()::DOUBLE AS lo, max(n) OVER ()::DOUBLE AS hi FROM
  (SELECT pba3_block, count(*) AS n FROM (SELECT DISTINCT pba3_block, checklist_id, longitude, latitude FROM sightings )
   GROUP BY 1)) GROUP BY 1""",
        "sightings",
    ),
)
def hist_bins_1d(spark, sf):
    places = _effort(spark, sf).select("pba3_block", "checklist_id", "longitude", "latitude").distinct()
    per_block = places.groupBy("pba3_block").agg(F.count("*").alias("n"))
    return histogram.histogram(per_block, "n")


@query(
    "graduated_classes",
    with_views(
        f"""SELECT round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, n AS checklist_count,
  len(list_filter(breaks, lambda b: b <= n))::INTEGER AS class,
  CASE WHEN n < breaks[1] THEN 2 ELSE round_even(exp(ln(3) + (len(list_filter(breaks, lambda b: b <= n)) - 1)
    * (ln(15) - ln(3)) / greatest(len(breaks) - 1, 1)), 0) END::DOUBLE AS radius
FROM ({_PLACES}) CROSS JOIN (SELECT list_sort(list_distinct(list(round_even(exp(ln(lo) + i*(ln(hi)-ln(lo))/9), 0)))) AS breaks
  FROM (SELECT min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi FROM ({_PLACES})), range(10) r(i))""",
        "sightings",
    ),
)
def graduated_classes(spark, sf):
    df = histogram.map_checklist_count(metrics.location_counts(_effort(spark, sf)))
    return rounded(df, "longitude", "latitude")


@query(
    "bbox",
    with_views(
        """SELECT round(min(x) - 1000, 3) AS xmin, round(min(y) - 1000, 3) AS ymin, round(max(x) + 1000, 3) AS xmax,
  round(max(y) + 1000, 3) AS ymax FROM (SELECT 6378137*radians(longitude) AS x,
    6378137*ln(tan(pi()/4 + radians(latitude)/2)) AS y FROM sightings )""",
        "sightings",
    ),
)
def bbox(spark, sf):
    df = spatial.bounding_box(spatial.to_mercator(_effort(spark, sf)), "x_m", "y_m", 1000.0)
    return df.select(*[F.round(c, 3).alias(c) for c in df.columns])


@query(
    "bbox_ground",
    with_views(
        f"""SELECT pba3_block, round(west, 6) AS xmin, round(south, 6) AS ymin,
  round(CASE WHEN place <= -180 THEN place + 360 WHEN place > 180 THEN place - 360 ELSE place END, 6) AS xmax, round(north, 6) AS ymax
FROM (SELECT *, west - place AS gap FROM (SELECT *, greatest(coalesce(max(east) OVER (PARTITION BY pba3_block ORDER BY west, east
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000), max(east) OVER (PARTITION BY pba3_block) - 360) AS place,
    min(latitude) OVER (PARTITION BY pba3_block) - degrees(angle) AS south, max(latitude) OVER (PARTITION BY pba3_block) + degrees(angle) AS north
  FROM (SELECT *, longitude - half AS west, longitude + half AS east FROM (
    SELECT *, degrees(asin(sin(angle) / cos(radians(latitude)))) AS half FROM (
      SELECT DISTINCT pba3_block, longitude, latitude, 1000 / {spatial.EARTH_RADIUS}::DOUBLE AS angle FROM sightings )))))
QUALIFY row_number() OVER (PARTITION BY pba3_block ORDER BY gap DESC, west) = 1""",
        "sightings",
    ),
)
def bbox_ground(spark, sf):
    """The map extent of each block, a kilometre on the ground around its points."""
    df = spatial.ground_extent(_effort(spark, sf), "longitude", "latitude", 1000.0, ["pba3_block"])
    return df.select("pba3_block", *[r6(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(
    "win_max_filter",
    with_views(
        """SELECT DISTINCT pba3_block, common_name, breeding_category_desc, breeding_rank FROM
(SELECT *, max(breeding_rank) OVER w AS best, count(*) OVER w AS n, count(breeding_rank) OVER w AS known FROM sightings 
 WINDOW w AS (PARTITION BY pba3_block, common_name)) WHERE breeding_rank = best AND n = known""",
        "sightings",
    ),
)
def win_max_filter(spark, sf):
    """Rows at the group's highest rank, one per value, by a join with the aggregate."""
    x = fx.sightings(spark, sf)
    keys = ["pba3_block", "common_name"]
    values = x.select(*keys, "breeding_category_desc", "breeding_rank").distinct()
    return joins.null_safe_join(values, metrics.best_rank(values, keys), [*keys, "breeding_rank"], "inner")


@query(
    "win_row_number",
    with_views(
        """SELECT strftime(observation_datetime, '%Y-%m-%d %H:%M:%S') AS observation_datetime, round(longitude, 6) AS longitude,
  round(latitude, 6) AS latitude, row_number() OVER (ORDER BY CAST(observation_datetime AS DATE) NULLS LAST,
    observation_datetime NULLS LAST, longitude, latitude) AS id
FROM (SELECT DISTINCT observation_datetime, longitude, latitude FROM sightings )""",
        "sightings",
    ),
)
def win_row_number(spark, sf):
    """Global index of the distinct daylight keys in start order."""
    keys = daylight.daylight_keys(_effort(spark, sf))
    # windows run over days, starts of a day, tenth-degree cells of a start and places of a cell
    placed = keys.withColumns({"day": F.to_date("observation_datetime"), "cell": F.floor(F.col("longitude") * 10)})
    df = sampling.with_global_index(placed, ["day", "observation_datetime", "cell"], ["longitude", "latitude"], "id")
    return rounded(df, "longitude", "latitude").select(
        text("observation_datetime").alias("observation_datetime"), "longitude", "latitude", "id"
    )


@query(
    "win_add_count",
    with_views(
        """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY checklist_id) AS n FROM (SELECT DISTINCT checklist_id,
  strftime(observation_datetime, '%Y-%m-%d %H:%M:%S') AS observation_datetime, duration_minutes FROM sightings ))
WHERE n > 1""",
        "sightings",
    ),
)
def win_add_count(spark, sf):
    rows = _effort(spark, sf).select("checklist_id", "observation_datetime", "duration_minutes").distinct()
    df = metrics.with_group_count(rows, ["checklist_id"]).orderBy(F.desc("n"), "checklist_id")
    return df.withColumn("observation_datetime", text("observation_datetime"))


@query(
    "win_sample_per_group",
    """SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
  ORDER BY md5('7|' || event_id::VARCHAR), event_id) AS rn FROM events) WHERE rn <= 1000""",
)
def win_sample_per_group(spark, sf):
    df = sampling.sample_per_group(fx.table(spark, sf, "events"), ["event_type"], 1000, ["event_id"], seed=7)
    return df.select("event_id", "event_type")


@query(
    "sort_multi",
    with_views("SELECT checklist_id, pba3_block, common_name, breeding_rank FROM sightings ", "sightings"),
)
def sort_multi(spark, sf):
    df = fx.sightings(spark, sf).select("checklist_id", "pba3_block", "common_name", "breeding_rank")
    return df.orderBy(F.asc_nulls_last("pba3_block"), F.desc_nulls_last("breeding_rank"), "common_name", "checklist_id")


@query(
    "limit_head",
    with_views(
        """SELECT checklist_id, count(*) AS n FROM sightings GROUP BY 1 ORDER BY n DESC, checklist_id LIMIT 6""", "sightings"
    ),
)
def limit_head(spark, sf):
    counts = _effort(spark, sf).groupBy("checklist_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "checklist_id").limit(6)


_U = "('0x' || substr(md5('3|' || event_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(
    "sample_fraction",
    f"""SELECT event_id FROM events ORDER BY {_U} DESC, event_id
LIMIT (SELECT floor(count(*) * 0.1::DOUBLE)::BIGINT FROM events)""",
)
def sample_fraction(spark, sf):
    return sampling.sample_fraction(fx.table(spark, sf, "events"), 0.1, ["event_id"], seed=3).select("event_id")


@query(
    "sample_weighted",
    f"""SELECT event_id FROM events WHERE value > 0 ORDER BY greatest(-ln(1 - {_U}), 1e-300)/value, event_id
LIMIT (SELECT floor(count(*) * 0.1::DOUBLE)::BIGINT FROM events)""",
)
def sample_weighted(spark, sf):
    return sampling.sample_weighted(fx.table(spark, sf, "events"), 0.1, "value", ["event_id"], seed=3).select("event_id")


def _flat(df):
    return df.select(
        "pba3_block", F.col("observation_date").cast("string").alias("observation_date"), *[r6(c).alias(c) for c in HOURS]
    )


_BY_DATE = with_views(
    f"""SELECT pba3_block, strftime(observation_datetime, '%Y-%m-%d') AS observation_date, {_hours_sql('duration_hours_', False)}
FROM labelled WHERE season = 'All seasons' GROUP BY 1, 2""",
    "labelled",
)


@query("unnest_group", _BY_DATE)
def unnest_group(spark, sf):
    x = _effort(spark, sf)
    nested = metrics.calc_nocturnal_diurnal_effort(x, starttime.fixed_start_times(x))
    return _flat(reshape.unnest(nested.select("pba3_block", "effort_breakdown"), "effort_breakdown"))


@query(
    "season_breakdown",
    with_views(
        f"""SELECT season, pba3_block, strftime(observation_datetime, '%Y-%m-%d') AS observation_date, {_hours_sql('duration_hours_', False)}
FROM labelled GROUP BY 1, 2, 3""",
        "labelled",
    ),
)
def season_breakdown(spark, sf):
    """The hours by date inside the summary of all seasons."""
    nested = summary_frame(spark, sf).filter("effort_breakdown is not null").select("season", "pba3_block", F.inline("effort_breakdown"))
    return nested.select(
        "season", "pba3_block", F.col("observation_date").cast("string").alias("observation_date"), *[r6(c).alias(c) for c in HOURS]
    )


@query(
    "nest_group",
    with_views(
        """SELECT pba3_block, count(*) AS dates, min(d) AS first_date, max(d) AS last_date, sum(n)::BIGINT AS checklists FROM
(SELECT pba3_block, observation_date::VARCHAR AS d, count(DISTINCT checklist_id) AS n FROM sightings GROUP BY 1, 2) GROUP BY 1""",
        "sightings",
    ),
)
def nest_group(spark, sf):
    """One array element per survey date of the block, read back from the nested form."""
    by_date = (
        _effort(spark, sf).select("pba3_block", "observation_date", "checklist_id").distinct()
        .groupBy("pba3_block", "observation_date").agg(F.count("*").alias("n"))
    )
    df = reshape.nest(by_date, ["pba3_block"], "rows")
    return df.select(
        "pba3_block",
        F.array_size("rows").cast("bigint").alias("dates"),
        F.element_at("rows", 1)["observation_date"].cast("string").alias("first_date"),
        F.element_at("rows", -1)["observation_date"].cast("string").alias("last_date"),
        F.aggregate("rows", F.lit(0).cast("bigint"), lambda acc, r: acc + r.n).alias("checklists"),
    )


@query(
    "pivot_fixed",
    with_views(
        """SELECT pba3_block, nullif(count(*) FILTER (breeding_category_desc = 'Observed'), 0) AS "Observed",
  nullif(count(*) FILTER (breeding_category_desc = 'Possible'), 0) AS "Possible",
  nullif(count(*) FILTER (breeding_category_desc = 'Probable'), 0) AS "Probable",
  nullif(count(*) FILTER (breeding_category_desc = 'Confirmed'), 0) AS "Confirmed" FROM sightings GROUP BY 1""",
        "sightings",
    ),
)
def pivot_fixed(spark, sf):
    names = ["Observed", "Possible", "Probable", "Confirmed"]
    return reshape.pivot_fixed(_effort(spark, sf), ["pba3_block"], "breeding_category_desc", names, F.count(F.lit(1)))
