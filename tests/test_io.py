import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridsurvey import fixtures as fx
from gridsurvey import session
from gridsurvey.checks import QUERIES
from gridsurvey.operators import compare, season
from gridsurvey.operators.metrics import calc_checklist_count
from gridsurvey.operators.prep import with_rank
from gridsurvey.plans.refresh import Inputs, published, refresh
from gridsurvey.sources import readers, writers
from gridsurvey.sources.writers import open_bucketed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_without_header_skips_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Title,,\n"sub, title",,\n1,"a, b",x\n2,,\n')
    df = readers.read_csv(spark, str(tmp_path / "c.csv"), "n int, t string, u string", header=False, skip=2)
    assert rows(df) == [(1, "a, b", "x"), (2, None, None)]


def test_csv_skips_by_place(spark, tmp_path):
    """Title lines of every file, with a header after them, and the same lines again as data."""
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(f"Title {name},\nsame,same\nn,t\n1,{name}\nsame,same\n2,x\n")
    df = readers.read_csv(spark, str(tmp_path), "n string, t string", header=True, skip=2)
    assert rows(df) == sorted([("1", "a.csv"), ("1", "b.csv"), ("same", "same"), ("same", "same"), ("2", "x"), ("2", "x")], key=repr)
    df = readers.read_csv(spark, str(tmp_path), "n string, t string", header=False, skip=1)
    assert df.count() == 10


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Title,\nn,t\n1,"two\nlines"\n2,x\n')
    df = readers.read_csv(spark, str(tmp_path), "n int, t string", header=True, skip=1, multi_line=True)
    assert rows(df) == [(1, "two\nlines"), (2, "x")]


def test_csv_as_text(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 2), None)], "a int, `b c` date, d double")
    writers.write_csv(df, str(tmp_path / "out"), as_text=True)
    assert rows(readers.read_csv(spark, str(tmp_path / "out"), "a string, `b c` string, d string")) == [("1", "2024-01-02", None)]


def test_tsv_takes_quotes_as_they_are(spark, tmp_path):
    (tmp_path / "t.txt").write_text('id\tname\n1\t"Bob\' owl\n2\t\n')
    df = readers.read_tsv(spark, str(tmp_path / "t.txt"), "id int, name string")
    assert rows(df) == [(1, "\"Bob' owl"), (2, None)]


def test_geojson_collection_equals_lines(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    feature = {"type": "Feature", "properties": {"BLOCK_ID": 7}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}, indent=1))
    (tmp_path / "l.json").write_text(json.dumps(feature) + "\n")
    whole = readers.read_polygons(spark, str(tmp_path / "c.json"), "BLOCK_ID", collection=True)
    lines = readers.read_polygons(spark, str(tmp_path / "l.json"), "BLOCK_ID")
    assert rows(whole) == rows(lines)
    assert lines.collect()[0].ring[1].asDict() == {"x": 1.0, "y": 0.0}


class FakeSession:
    """Just what scratch_path asks a session for."""

    def __init__(self, **settings):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: settings.get(key.replace(".", "_"), default))})


def test_scratch_follows_the_session():
    named = FakeSession(spark_checkpoint_dir="hdfs://shared/x/", spark_sql_warehouse_dir="hdfs://warehouse")
    assert session.scratch_path(named, "t").startswith("hdfs://shared/x/t-")
    assert session.scratch_path(FakeSession(spark_sql_warehouse_dir="hdfs://warehouse"), "t").startswith("hdfs://warehouse/t-")


STAGED_BEFORE = [
    "summarize_season", "summarize_all_seasons", "species_observed_pct", "species_observed_state", "weighted_presence", "eb_shrinkage",
    "join_geo_many", "join_block_season", "block_mart", "completion_table", "completion_table_season_matched", "progress_table"]


@pytest.mark.parametrize("name", STAGED_BEFORE)
def test_queries_run_no_job_while_they_are_built(spark, small, name):
    for table in ("lineitem", "orders", "customer", "part", "nation", "region"):
        fx.table(spark, small, table)  # reads the footers once
    tracker, group = spark.sparkContext.statusTracker(), f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        QUERIES[name](spark, small)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup(group)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_results_do_not_depend_on_the_session_zone(spark, small, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    # Sums follow the order in which partitions arrive; nine decimals do not show it.
    columns = ["pba3_block", F.round("duration_hours_diurnal", 9), "breeding_season_months_covered"]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = fx.sightings(spark, small)
        got = season.summarize_season(df, "Winter", fx.nocturnal_species(spark, small)).drop("effort_breakdown")
        got = rows(got.select(*columns))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    wanted = season.summarize_season(fx.sightings(spark, small), "Winter", fx.nocturnal_species(spark, small))
    assert got == rows(wanted.select(*columns))


def test_refresh_writes_every_table(spark, small, tmp_path):
    inputs = Inputs(
        raw=fx.raw_sightings(spark, small),
        blocks=fx.blocks(spark, small),
        nocturnal=fx.nocturnal_species(spark, small),
        old_survey=fx.old_survey(spark, small),
        polygons=fx.polygons(spark, small),
    )
    paths = refresh(
        spark, inputs, str(tmp_path), project="Grid Survey", start="1995-01-01", release="Aug-2001", cell=0.5, overrides={}
    )
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    sightings = with_rank(read["sightings"])
    assert sightings.select("checklist_id", "common_name").distinct().count() == sightings.count() > 0
    summary = read["season_summary"].filter("season = 'All seasons'").select("pba3_block", "checklist_count")
    assert rows(summary) == rows(calc_checklist_count(sightings))
    assert rows(read["missing_species"]) == rows(compare.missing_species(read["species_comparison"]))
    assert read["block_mart"].select("pba2_block").distinct().count() >= 5
    assert read["expected_species_shrunk"].filter("`.fitted` is null").count() == 0
    assert read["completion"].count() > 0
    # One version, published last; its sightings are found by their buckets in another session's catalog, too.
    assert {path.rsplit("/", 1)[0] for path in paths.values()} == {published(spark, str(tmp_path))}
    again = open_bucketed(spark, paths["sightings"], "checklist_id", 4, ["observation_month"])
    assert rows(again.select("checklist_id", "common_name", "observation_month")) == rows(
        sightings.select("checklist_id", "common_name", "observation_month"))
    (tmp_path / "versions" / "99999999999999999999-unfinished").mkdir()
    assert {path.rsplit("/", 1)[0] for path in paths.values()} == {published(spark, str(tmp_path))}


def test_folders_are_written_by_the_task_that_holds_them(spark, tmp_path):
    """Rows are dealt out by folder before the write, so that no task has all folders to sort; none is lost."""
    path = str(tmp_path / "folders")
    df = spark.range(1000, numPartitions=4).selectExpr("id", "IF(id % 4 = 3, NULL, id % 4) AS month")
    writers.write_parquet(df, path, ["month"])
    files = [sorted(f.name for f in folder.iterdir() if f.name.endswith(".parquet")) for folder in (tmp_path / "folders").glob("month=*")]
    assert [len(names) for names in files] == [1] * 4
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "month").collect()), key=lambda r: r[0]) == [
        (i, None if i % 4 == 3 else i % 4) for i in range(1000)]
