"""The periodic refresh: raw sightings to written marts.

Every table that more than one later step reads is written once and read
back, so a lost executor costs the tasks of one step and each step scans only
its own columns. Steps are ordinary writes of lazy plans; nothing is collected.

A refresh writes a version of its own and publishes it with its last step, so
readers never see tables of two generations. The sightings are kept in buckets
of checklists within folders of months: start votes, places and efforts need no
exchange, and a season reads its own folders.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lookups import BLOCK_OVERRIDES, SURVEY_START, SURVEY_TZ, season_table
from ..operators import compare, completion, expected, spatial
from ..operators.daylight import daylight_table
from ..operators.prep import prepare_sightings, with_rank
from ..operators.month_cube import MONTH, build_cube, seasons_of_cube
from ..operators.season import block_mart
from ..operators.starttime import fixed_start_times
from ..sources.readers import read_text_scalar
from ..sources.writers import write_bucketed, write_parquet, write_text_scalar


@dataclass
class Inputs:
    """Frames a refresh starts from."""

    raw: DataFrame  # raw sightings, one row per species of a checklist copy
    blocks: DataFrame  # pba3_block, block_name, block_region, block_county
    nocturnal: DataFrame  # common_name
    old_survey: DataFrame  # pba3_block, common_name, breeding_category_desc
    polygons: DataFrame  # pba2_block, ring


def refresh(
    spark: SparkSession,
    inputs: Inputs,
    out: str,
    project: str | None = None,
    start=SURVEY_START,
    release: str | None = None,
    cell: float = 0.125,
    overrides: dict[str, int] = BLOCK_OVERRIDES,
    tz: str = SURVEY_TZ,
    buckets: int | None = None,
) -> dict[str, str]:
    """Write all tables of a refresh in a new folder under ``out`` and publish it; returns their paths by name.

    ``buckets``: of the sightings; by default as many as shuffle partitions.
    """
    paths: dict[str, str] = {}
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    base = f"{out}/versions/{version}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stage(name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        paths[name] = f"{base}/{name}"
        write_parquet(df, paths[name], partition_by)
        return spark.read.schema(df.schema).parquet(paths[name])

    stage("seasons", season_table(spark))
    prepared = prepare_sightings(inputs.raw, project, start, release, tz)
    paths["sightings"] = f"{base}/sightings"
    sightings = with_rank(write_bucketed(prepared, paths["sightings"], "checklist_id", buckets, ["observation_month"]))
    stage("daylight", daylight_table(sightings, tz))

    new = compare.new_ranks(sightings)
    pairs = stage("species_comparison", compare.compare_species(compare.old_ranks(inputs.old_survey), new, inputs.blocks))
    stage("missing_species", compare.missing_species(pairs))
    block_pairs = stage("block_comparison", compare.compare_blocks(pairs))

    fixed = stage("fixed_starts", fixed_start_times(sightings))
    by_month = ("labelled", "effort", "species", "observers")
    cube = build_cube(sightings, fixed, tz=tz, keep=lambda name, df: stage(f"cube_{name}", df, [MONTH] if name in by_month else None))
    summary = stage("season_summary", seasons_of_cube(cube, inputs.nocturnal))
    mapped = stage("block_map", spatial.block_map(inputs.polygons, spatial.hull_centers(sightings), cell, overrides))
    mart = stage("block_mart", block_mart(summary, mapped, block_pairs, inputs.blocks))
    stage("completion", completion.completion_table(mart, block_pairs))

    rates = stage("expected_species", expected.species_observed_pct(sightings))
    stage("expected_species_shrunk", expected.shrink_rates(rates))
    names = spark.createDataFrame([(version,)], "value string")
    write_text_scalar(names, f"{out}/published/{version}")
    return paths


def published(spark: SparkSession, out: str) -> str:
    """The folder of the last version that was written to its end."""
    version = read_text_scalar(spark, f"{out}/published/*")
    return f"{out}/versions/{version.agg(F.max(version.columns[0])).first()[0]}"
