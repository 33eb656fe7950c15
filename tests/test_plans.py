"""What the physical plans must and must not contain."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from gridsurvey import fixtures as fx
from gridsurvey.operators import completion, joins, metrics, season, starttime
from gridsurvey.session import scratch_path

QUERIES = entry.queries()


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("name", ["summarize_all_seasons", "block_mart", "species_observed_pct", "eb_shrinkage", "join_spatial_cover",
                                  "completion_table", "compare_block", "graduated_classes", "hist_bins", "sample_weighted"])
def test_no_cross_join_and_no_python_in_hot_paths(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "FlatMapGroupsInPandas" not in text


def test_mart_over_buckets_moves_no_checklists(spark, small, monkeypatch):
    """Over sightings bucketed by checklist nothing is dealt out by checklist again, and a quarter of the exchanges goes."""
    def exchanges(df):
        return [line for line in plan(df, "simple").splitlines() if "Exchange hashpartitioning" in line]

    before = exchanges(QUERIES["block_mart"](spark, small))
    held = fx.bucketed_sightings(spark, small)
    monkeypatch.setattr(fx, "sightings", lambda *a, **b: held)
    after = exchanges(QUERIES["block_mart"](spark, small))
    assert any("checklist_id" in line for line in before) and not any("checklist_id" in line for line in after)
    assert len(after) <= 0.8 * len(before)


def test_season_filter_prunes_folders_and_columns(spark, small):
    path = scratch_path(spark, "pruned")
    fx.sightings(spark, small).write.partitionBy("observation_month").parquet(path)
    df = metrics.calc_checklist_count(joins.in_season(spark.read.parquet(path), "Winter"))
    text = plan(df)
    assert "PartitionFilters: [observation_month" in text.replace("isnotnull(observation_month#", "observation_month")
    schema = [line for line in text.splitlines() if line.startswith("ReadSchema")][0]
    assert "checklist_id" in schema and "common_name" not in schema and "duration_minutes" not in schema


def test_point_filters_reach_the_mart_scan(spark, small):
    path = scratch_path(spark, "mart")
    season.summarize_season(fx.sightings(spark, small), "Winter", fx.nocturnal_species(spark, small)).selectExpr(
        "*", "'Winter' AS season").write.parquet(path)
    text = plan(completion.block_summary(spark.read.parquet(path), "B03", "Winter"))
    assert "EqualTo(pba3_block,B03)" in text and "EqualTo(season,Winter)" in text


def test_metrics_combine_before_they_shuffle(spark, small):
    text = plan(metrics.calc_block_effort(fx.sightings(spark, small, species=False)), "simple")
    # printed from the top: sum, exchange, partial sum over max, exchange, partial max
    first, second = text.index("Exchange"), text.index("Exchange", text.index("partial_sum"))
    assert first < text.index("partial_sum") < second < text.index("partial_max")


@pytest.mark.parametrize("name", ["progress_table", "completion_table", "completion_table_season_matched"])
def test_mart_joins_the_sightings_once(spark, small, name):
    """The grains of the mart read one written table; what is left of the line items is the old survey."""
    scans = [line for line in plan(QUERIES[name](spark, small)).splitlines() if line.startswith("Location") and "lineitem.parquet" in line]
    assert len(scans) <= (2 if name == "completion_table" else 1)  # it compares the surveys twice


@pytest.mark.parametrize("name", ["prep_taxon_rollup", "prep_taxon_rollup_max"])
def test_rolled_up_taxa_are_sorted_after_their_shuffle_only(spark, small, name):
    """The stage that joins the sightings does not sort them by species as well."""
    above, below = plan(QUERIES[name](spark, small), "simple").split("Exchange hashpartitioning(checklist_id", 1)
    assert "Aggregate" in above and "Aggregate" not in below


@pytest.mark.parametrize("name", ["lookup_tables", "join_season_semi"])
def test_fixed_tables_move_no_sightings(spark, small, name):
    """A join with a literal table never deals the sightings out by its few keys."""
    text = plan(QUERIES[name](spark, small), "simple")
    assert "SortMergeJoin" not in text and "ExistingRDD" not in text


def test_starts_are_settled_in_one_exchange(spark, small):
    """Rows are dealt out by checklist once; disputes are told, votes counted and picked where they then are."""
    text = plan(starttime.fixed_start_times(fx.sightings(spark, small, species=False)), "simple")
    assert len([line for line in text.splitlines() if "Exchange" in line and "checklist_id" in line]) == 1


def test_fan_out_to_seasons_has_its_own_stage(spark, small):
    """What is fanned out is dealt out by block and date first, apart from the sorts of the joins."""
    above, below = plan(QUERIES["summarize_all_seasons"](spark, small), "simple").split("REPARTITION_BY_COL", 1)
    assert "observation_date" in above.splitlines()[-1] and "Generate explode" in above
    assert "Generate" not in below.split("Exchange", 1)[0] and "keys=[season" not in below.split("SortMergeJoin", 1)[0]
