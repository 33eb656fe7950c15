"""Hand-made frames for the semantic edge cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridsurvey import lookups
from gridsurvey.functions import numbers, text, times
from gridsurvey.functions.categories import rank_of
from gridsurvey.operators import (
    calendar,
    compare,
    completion,
    daylight,
    expected,
    histogram,
    joins,
    metrics,
    prep,
    quality,
    sampling,
    season,
    starttime,
)

T = dt.datetime
SIGHTING = (
    "checklist_id string, pba3_block string, common_name string, observer_id string, breeding_rank int, "
    "observation_date date, observation_month string, observation_datetime timestamp_ntz, duration_minutes double, "
    "effort_distance_km double, longitude double, latitude double"
)


def sighting(**given):
    row = dict(
        checklist_id="c1",
        pba3_block="A",
        common_name="owl",
        observer_id="a",
        breeding_rank=1,
        observation_datetime=T(2024, 6, 1, 9, 0),
        duration_minutes=60.0,
        effort_distance_km=1.0,
        longitude=-79.99,
        latitude=40.44,
    )
    row.update(given)
    day = given.get("observation_date") or (row["observation_datetime"] or T(2024, 6, 1)).date()
    row["observation_date"], row["observation_month"] = day, day.strftime("%b")
    return row


@pytest.fixture
def frame(spark):
    names = [f.strip().split(" ")[0] for f in SIGHTING.split(",")]
    return lambda *rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SIGHTING)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    ("values", "mode"), [([3, 1, 3, 1, 1], 1), ([2, 1], 1), ([None, None], None), ([None, None, 7], 7), ([5, 4, 5], 5)]
)
def test_mode_ignores_nulls_and_breaks_ties_low(spark, values, mode):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v int")
    assert rows(starttime.modal_value(df, ["g"], "v", "m")) == [("g", mode)]


def test_observers_split_without_trim_and_count_null_once(frame):
    df = frame(
        sighting(observer_id="a,b"), sighting(observer_id="b"), sighting(observer_id=None), sighting(observer_id="a, b")
    )
    assert rows(metrics.calc_atlasers(df)) == [("A", 4)]  # a, b, ' b', missing


def test_missing_block_is_a_block_and_joins_null_safely(spark, frame):
    df = frame(sighting(pba3_block=None), sighting(pba3_block=None, checklist_id="c2"), sighting(checklist_id="c3"))
    counts = metrics.calc_checklist_count(df)
    assert set(rows(counts)) == {(None, 2), ("A", 1)}
    mapping = spark.createDataFrame([(1, None), (2, "A"), (3, "Z")], "pba2_block int, pba3_block string")
    joined = joins.null_safe_join(mapping, counts, ["pba3_block"]).select("pba2_block", "checklist_count")
    assert set(rows(joined)) == {(1, 2), (2, 1), (3, None)}


def test_no_duration_gives_zero_hours(frame):
    df = frame(sighting(duration_minutes=None, effort_distance_km=None))
    assert rows(metrics.calc_block_effort(df)) == [("A", 0.0, 0.0)]
    day_night = metrics.calc_nocturnal_diurnal_effort(df, starttime.fixed_start_times(df)).collect()[0]
    assert day_night.duration_hours_diurnal == 0.0
    assert day_night.effort_breakdown[0].duration_hours_diurnal == 0.0
    assert day_night.effort_breakdown[0].duration_hours_nocturnal is None


def test_unknown_category_removes_the_species(spark, frame):
    ranks = spark.createDataFrame([("C4",), ("C0",), ("0",)], "c string").select(rank_of(F.col("c")).alias("r"))
    assert [r.r for r in ranks.collect()] == [4, None, 0]
    df = frame(
        sighting(breeding_rank=4), sighting(breeding_rank=None), sighting(common_name="jay", breeding_rank=2),
        sighting(common_name="jay", breeding_rank=3),
    )
    coded = metrics.calc_species_coded(df).collect()[0].asDict()
    assert coded == {"pba3_block": "A", "Not Observed": None, "Observed": None, "Possible": None, "Probable": 1, "Confirmed": None}


def test_two_places_count_twice_by_day_but_once_in_total(frame):
    df = frame(sighting(), sighting(longitude=-80.5))
    fixed = starttime.fixed_start_times(df)
    assert metrics.calc_block_effort(df).collect()[0].duration_hours_total == 1.0
    assert metrics.calc_nocturnal_diurnal_effort(df, fixed).collect()[0].duration_hours_diurnal == 2.0


def test_coverage_uses_the_start_and_skips_blocks_without_one(frame):
    df = frame(
        sighting(observation_datetime=None),
        sighting(pba3_block="B", observation_datetime=T(2024, 4, 1, 9)),
        sighting(pba3_block="B", observation_datetime=T(2024, 8, 1, 9)),
        sighting(pba3_block="B", observation_datetime=T(2024, 12, 1, 9)),
    )
    assert rows(metrics.calc_breeding_season_coverage(df)) == [("B", 2)]


def test_ratio_of_nothing(spark):
    df = spark.createDataFrame([(5, 0), (0, 0), (1, 2)], "n int, d int")
    got = [r[0] for r in df.select(numbers.ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [math.inf, None, 0.5]


def test_block_comparison_without_old_species(spark):
    schema = "pba3_block string, common_name string, pba2_breeding_rank_max int, pba3_breeding_rank_max int"
    df = spark.createDataFrame([("A", "owl", 0, 3), ("B", "owl", 0, 1), ("C", "owl", 4, 2)], schema)
    got = {r.pba3_block: r for r in compare.compare_blocks(df).collect()}
    assert got["A"].pba3_pba2_coded_count_compare_pct == math.inf
    assert got["B"].pba3_pba2_coded_count_compare_pct is None
    assert got["C"].pct_missing_pba2_confirmations == 1.0


def test_times_the_clock_skips_are_null(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 3, 10), "02:30:00"), (dt.date(2024, 3, 10), "03:30:00"), (dt.date(2024, 3, 11), None),
         (dt.date(2024, 3, 11), "02:30"), (dt.date(2024, 3, 11), "7:05:09"), (dt.date(2024, 11, 3), "01:30:00")],
        "observation_date date, time_observations_started string",
    )
    got = [r.observation_datetime for r in prep.with_observation_times(df).collect()]
    assert got == [None, T(2024, 3, 10, 3, 30), None, None, T(2024, 3, 11, 7, 5, 9), T(2024, 11, 3, 1, 30)]


def test_start_times_settle_on_the_most_votes(frame):
    early, late = T(2024, 6, 1, 8), T(2024, 6, 1, 9)
    df = frame(
        sighting(observer_id="a,b", observation_datetime=late),
        sighting(observer_id="c", observation_datetime=early),
        sighting(checklist_id="c2", observation_datetime=late, observer_id="a"),
        sighting(checklist_id="c2", observation_datetime=early, observer_id="b"),
        sighting(checklist_id="c3", observation_datetime=None, observer_id="a,b,c"),
        sighting(checklist_id="c3", observation_datetime=late, observer_id="d"),
        sighting(checklist_id="c4"),
    )
    assert rows(starttime.fixed_start_times(df)) == [("c1", late), ("c2", early), ("c3", late)]
    assert rows(starttime.start_time_counts(df)) == [("c1", 2), ("c2", 2), ("c3", 2)]


@pytest.mark.parametrize(
    ("day", "rise", "set_"),
    [(T(2025, 6, 21, 12), "05:49:54", "20:53:48"), (T(2025, 12, 21, 12), "07:39:48", "16:56:42")],
)
def test_daylight_known_values(spark, day, rise, set_):
    df = spark.createDataFrame([(day, -79.99, 40.44)], "observation_datetime timestamp_ntz, longitude double, latitude double")
    got = daylight.with_daylight(df).collect()[0]
    for value, wanted in ((got.sunrise, rise), (got.sunset, set_)):
        wanted = T.combine(day.date(), dt.time.fromisoformat(wanted))
        assert abs((value - wanted).total_seconds()) <= 6


def test_daylight_is_null_without_start_or_sunrise(spark):
    df = spark.createDataFrame(
        [(T(2025, 6, 21, 12), 20.0, 78.0), (None, 20.0, 40.0), (T(2025, 6, 21, 12), None, 40.0)],
        "observation_datetime timestamp_ntz, longitude double, latitude double",
    )
    assert [(r.sunrise, r.sunset) for r in daylight.with_daylight(df).collect()] == [(None, None)] * 3


def test_twilight_bounds_are_inclusive(spark):
    sunrise, sunset = T(2024, 6, 1, 6), T(2024, 6, 1, 20)
    second, dawn, dusk = dt.timedelta(seconds=1), T(2024, 6, 1, 5, 20), T(2024, 6, 1, 20, 20)
    starts = [dawn - second, dawn, dusk, dusk + second, None]
    df = spark.createDataFrame(
        [(s, sunrise, sunset) for s in starts],
        "observation_datetime timestamp_ntz, sunrise timestamp_ntz, sunset timestamp_ntz",
    )
    labels = [r.checklist_type for r in daylight.with_day_night_label(df).collect()]
    assert labels == ["nocturnal", "diurnal", "diurnal", "nocturnal", "unknown"]


def test_observed_share_by_algebra_equals_the_completed_table(spark, frame):
    cells = [("c1", "owl", 4, "5"), ("c1", "owl", 4, None), ("c2", "owl", 5, "X"), ("c3", "jay", 4, "2"), ("c3", "jay", 12, "2")]
    df = frame(*[sighting(checklist_id=c, common_name=s, observation_datetime=T(2024, m, 1, 9)) for c, s, m, _ in cells])
    counts = spark.createDataFrame([(c, s, T(2024, m, 1).strftime("%b"), n) for c, s, m, n in cells],
                                   "checklist_id string, common_name string, observation_month string, observation_count string")
    df = df.select("checklist_id", "pba3_block", "common_name", "observation_month").distinct().join(
        counts, ["checklist_id", "common_name", "observation_month"])
    seen = [c for c in cells if c[2] in range(4, 9)]
    checklists, species = {c[0] for c in seen}, {c[1] for c in seen}
    wanted = {}
    for s in species:
        for month in range(4, 9):
            total = hits = 0
            for c in checklists:
                found = [n for (cc, ss, mm, n) in seen if (cc, ss, mm) == (c, s, month)] or [None]
                total += len(found)
                hits += sum(n is not None for n in found)
            wanted[s, T(2024, month, 1).strftime("%b")] = (hits, len(checklists), hits / total)
    got = {(r.common_name, r.observation_month): (r.observations, r.checklist_count, r.observed_pct)
           for r in expected.species_observed_pct(df).collect()}
    assert got == wanted


def test_completion_flags_are_three_valued(spark):
    columns = ("pba3_block string, season string, block_name string, block_region string, block_county string, Possible bigint, "
               "Probable bigint, Confirmed bigint, duration_hours_total double, duration_hours_nocturnal double, "
               "breeding_season_months_covered bigint, nocturnal_species_coded bigint, pba3_pba2_coded_count_compare_pct double")
    mart = spark.createDataFrame(
        [("A", "All seasons", "n", "r", "c", 10, 40, 40, 19.996, 0.0, 3, 2, None),
         ("B", "All seasons", "n", "r", "c", None, None, None, 0.0, 0.0, None, 0, None),
         (None, "All seasons", "n", "r", "c", 1, 1, 1, 1.0, 1.0, 1, 1, None)], columns)
    comparison = spark.createDataFrame([("A", math.inf)], "pba3_block string, pba3_pba2_coded_count_compare_pct double")
    got = {r.pba3_block: r for r in completion.completion_table(mart, comparison).collect()}
    assert set(got) == {"A", "B"}
    assert got["A"].all_criteria_complete is True
    assert got["B"].flag_confirmed_pct is None and got["B"].all_criteria_complete is False
    matched = {r.pba3_block: r for r in completion.completion_table(mart, season_matched=True).collect()}
    assert matched["A"].all_criteria_complete is None


def test_shared_copies_collapse_to_the_first_event(spark):
    df = spark.createDataFrame(
        [("S2", "G1", "owl", "obs9", "b"), ("S1", "G1", "owl", "obs2", "a"), ("S3", None, "owl", "obs1", "c"), ("S4", None, "owl", None, "d")],
        "event_id string, group_id string, common_name string, observer_id string, breeding_code string",
    )
    got = rows(prep.collapse_shared(df).select("checklist_id", "observer_id", "event_id", "breeding_code"))
    assert got == [("G1", "obs2,obs9", "S1", "a"), ("S3", "obs1", "S3", "c"), ("S4", None, "S4", "d")]


def test_taxon_rollup_counts(spark):
    schema = "checklist_id string, common_name string, taxon_category string, observation_count string, breeding_category string"
    df = spark.createDataFrame(
        [("c", "owl", "species", "3", "C1"), ("c", "owl", "issf", "12", "C4"), ("c", "owl", "form", "X", "C2"),
         ("c", "gull sp.", "spuh", "9", "C1"), ("c", "jay", "species", "X", "C1")], schema)
    assert rows(prep.roll_up_taxa(df, "max").select("common_name", "observation_count", "breeding_category")) == [
        ("jay", "X", "C1"), ("owl", "12", "C4")]
    assert rows(prep.roll_up_taxa(df).select("common_name", "observation_count")) == [("jay", "X"), ("owl", "X")]


RAW = ("event_id string, group_id string, observer_id string, common_name string, taxon_category string, breeding_code string, "
       "breeding_category string, observation_date date, time_observations_started string, observation_count string, "
       "atlas_block string, project_names string")


@pytest.mark.parametrize("group", [None, "G1"])
def test_ingest_keeps_the_confirmed_record(spark, group):
    """Sub-species rows, code beside category, and codes that blanks would order wrongly."""
    day = dt.date(2024, 5, 1)
    made = [("species", " NY ", " C4", "5"), ("issf", "S", "C2", "1"), ("form", "A", "C3 ", "2")]
    df = spark.createDataFrame([("S1", group, "o", "owl", t, code, c, day, "07:00:00", n, "B", "P") for t, code, c, n in made], RAW)
    if group is None:
        got = prep.prepare_sightings(df, start="2020-01-01").select(
            "checklist_id", "breeding_code", "breeding_category", "observation_count").collect()
        assert [tuple(r) for r in got] == [("S1", "NY", "C4", "8")]
    plan = prep.collapse_shared(df)
    assert plan.count() == (3 if group is None else 1)


def test_rows_taken_together(spark):
    df = spark.createDataFrame(
        [("c", "owl", "species", "1", "C4", "NY"), ("c", "owl", "issf", "1", "C2", "A"), ("c", "owl", "form", "1", "C0", "0")],
        "checklist_id string, common_name string, taxon_category string, observation_count string, breeding_category string, breeding_code string")
    assert rows(prep.roll_up_taxa(df).select("breeding_category", "breeding_code", "observation_count")) == [("C4", "NY", "3")]


def test_weighted_sample_takes_all_if_few_have_a_weight(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 2 = 0, 1.0D, 0.0D) as w")
    assert sampling.sample_weighted(df, 0.9, "w", ["id"]).count() == 500
    assert sampling.sample_weighted(df.filter("w = 0"), 0.9, "w", ["id"]).count() == 0


def test_survey_zone_skips_hours_only_where_stated():
    from zoneinfo import ZoneInfo

    from gridsurvey.functions.times import GAP_HOURS

    for name, hours in GAP_HOURS.items():
        zone, at = ZoneInfo(name), dt.datetime(1900, 1, 1)
        while at.year < 2038:
            back = at.replace(tzinfo=zone).astimezone(dt.timezone.utc).astimezone(zone).replace(tzinfo=None)
            assert back == at or at.hour in hours, at
            at += dt.timedelta(minutes=30)


def test_release_label_and_month_end(spark):
    df = spark.createDataFrame([("data/x_relJun-2026/x_smp_relJun-2026.txt",), ("none.txt",)], "p string")
    label = text.release_label(F.col("p"))
    assert rows(df.select(label, times.release_month_end(label))) == [("Jun-2026", dt.date(2026, 6, 30)), (None, None)]
    dates = spark.createDataFrame([(dt.date(2026, 6, 30),), (dt.date(2026, 7, 1),), (dt.date(2023, 12, 31),)], "observation_date date")
    assert prep.up_to_release(dates, "Jun-2026").count() == 1


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a \t b\n",), ("1,234 birds",), ("X",), (None,)], "c string")
    assert [r[0] for r in df.select(text.squish(F.col("c"))).collect()] == ["a b", "1,234 birds", "X", None]
    assert [r[0] for r in df.select(text.parse_count(F.col("c"))).collect()] == [None, 1234.0, 1.0, None]


def test_species_names_of_the_old_survey(spark):
    wide = spark.createDataFrame(
        [("A", "Observed/Possible", None, "Confirmed")],
        "pba3_block string, `Barn Owl` string, `House Wren` string, `N/A 3` string",
    )
    got = rows(compare.old_ranks_from_matrix(wide, ["pba3_block"]))
    assert got == [("A", "American Barn Owl", "Observed", 1), ("A", "Northern House Wren", None, None)]
    assert len(lookups.SPECIES_RENAMES) == 7


def test_calendar(spark):
    names = ["o", "n", "a", "b", "c", "d", *lookups.WEEKS]
    first = dict(zip(names, [1, "owl**", "15-May", "1-May", "31-Jul", "bad"] + [None] * 48, strict=True)) | {"Nov 1": "N", "Jan 2": "B"}
    second = dict(zip(names, [2, "jay", None, None, None, None] + [None] * 48, strict=True))
    schema = ", ".join(["o int", *[f"`{n}` string" for n in names[1:]]])
    raw = spark.createDataFrame([tuple(r[n] for n in names) for r in (first, second)], schema)
    clean = calendar.clean_calendar(raw)
    assert rows(clean.select("common_name", "priority_species")) == [("jay", False), ("owl*", True)]
    dates = calendar.safe_dates(calendar.safe_date_columns(clean), 2025).collect()
    assert dates[0].asDict() == {
        "common_name": "owl*", "date_probable_start": dt.date(2025, 5, 15), "date_probable_end": None,
        "date_possible_start": dt.date(2025, 5, 1), "date_possible_end": dt.date(2025, 7, 31)}
    codes = calendar.code_columns(clean)
    window = calendar.calendar_window(codes, "Nov", drop_empty=True, show_priority=False)
    assert window.columns == ["common_name", *lookups.WEEKS[40:]]
    assert [r.common_name for r in window.collect()] == ["owl*"]
    long = calendar.calendar_long(codes)
    assert long.count() == 96
    assert {r.year_week_index for r in long.filter("week = 'Jan 2'").collect()} == {2}


def test_classes_need_positive_counts(spark):
    df = spark.createDataFrame([(1,), (10,), (1000,)], "checklist_count bigint")
    got = rows(histogram.map_checklist_count(df))
    assert [(r[0], r[1], r[2]) for r in got][0] == (1, 1, 3.0)
    assert max(r[2] for r in got) == 15.0
    with pytest.raises(Exception, match="must be > 0"):
        histogram.map_checklist_count(df.withColumn("checklist_count", F.lit(0))).collect()
    same = histogram.map_checklist_count(spark.createDataFrame([(5,), (5,)], "checklist_count bigint"))
    assert {(r["class"], r.radius) for r in same.collect()} == {(1, 3.0)}


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert rows(histogram.histogram(df, "v")) == [(1, 2)]


def test_quality_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "l string, r int")
    assert rows(quality.one_to_one_report(df, "l", "r")) == [("l -> r", 1, False), ("r -> l", 1, False)]
    assert rows(quality.unique_report(df, ["l", "r"])) == [("l,r", 0, True)]
    assert rows(quality.coverage_report(df, df.filter("r = 2"), ["l"])) == [("all of a in b", 1, False), ("all of b in a", 0, True)]


def test_season_summary_equals_the_single_metrics(spark, frame):
    nocturnal = spark.createDataFrame([("owl",)], "common_name string")
    df = frame(
        sighting(breeding_rank=3), sighting(common_name="jay", observer_id="b"),
        sighting(checklist_id="c2", observation_datetime=T(2024, 1, 5, 20), pba3_block=None),
        sighting(checklist_id="c3", observation_datetime=None, duration_minutes=None),
        # copies of one checklist that disagree on start and month
        sighting(checklist_id="c4", observation_datetime=T(2024, 8, 31, 23), observer_id="x"),
        sighting(checklist_id="c4", observation_datetime=T(2024, 9, 1, 0), observer_id="y,z", duration_minutes=90.0),
    )
    fixed = starttime.fixed_start_times(df)
    for name in lookups.SEASONS:
        part = joins.in_season(df, name)
        tables = [
            metrics.calc_checklist_count(part), metrics.calc_species_observed(part), metrics.calc_atlasers(part),
            metrics.calc_block_effort(part), metrics.calc_species_coded(part),
            metrics.calc_nocturnal_diurnal_effort(part, fixed), metrics.calc_breeding_season_coverage(part),
            metrics.calc_nocturnal_species_coded(part, nocturnal),
        ]
        wanted = joins.left_join_all(tables, ["pba3_block"])
        got = season.summarize_season(df, name, nocturnal).select(*wanted.columns)
        assert rows(got) == rows(wanted), name
    stacked = season.summarize_all_seasons(df, nocturnal)
    assert stacked.filter("season = 'Winter'").count() == 1


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")))
    one = sampling.sample_per_group(df, ["g"], 20, ["id"], seed=5)
    two = sampling.sample_per_group(df.repartition(7), ["g"], 20, ["id"], seed=5)
    assert rows(one) == rows(two)
    assert {r.n for r in one.groupBy("g").agg(F.count("*").alias("n")).collect()} == {20}
    tenth = sampling.sample_fraction(df, 0.1, ["id"])
    assert tenth.count() == 500 and rows(tenth) == rows(sampling.sample_fraction(df.repartition(3), 0.1, ["id"]))
    weighted = df.withColumn("w", F.when(F.col("id") < 100, 1000.0).otherwise(1.0))
    drawn = sampling.sample_weighted(weighted, 0.05, "w", ["id"])
    assert drawn.count() == 250 and drawn.filter("id < 100").count() == 100
    assert sampling.sample_fraction(df.limit(5), 0.1, ["id"]).count() == 0


def test_global_index_equals_one_sort(spark):
    df = spark.range(300).select((F.col("id") * 7 % 11).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("b"), "id")
    got = sampling.with_global_index(df, ["a", "b"], ["id"], "n").collect()
    ordered = sorted(got, key=lambda r: (r.a, r.b is None, r.b or 0, r.id))
    assert [r.n for r in ordered] == list(range(1, 301))


def test_only_disputed_starts_are_settled(frame):
    """One start, or none, leaves nothing to settle; a missing start beside a known one does. Equal votes count once."""
    early, late = T(2024, 6, 1, 9, 0), T(2024, 6, 1, 9, 1)
    df = frame(
        sighting(checklist_id="one"), sighting(checklist_id="one", common_name="wren"),
        sighting(checklist_id="none", observation_datetime=None),
        sighting(checklist_id="gap", observation_datetime=None), sighting(checklist_id="gap", observation_datetime=late),
        *[sighting(checklist_id="votes", observer_id="a", observation_datetime=early, common_name=n) for n in "xyz"],
        sighting(checklist_id="votes", observer_id="a,b", observation_datetime=late),
    )
    assert rows(starttime.fixed_start_times(df)) == [("gap", late), ("votes", late)]
