"""gridsurvey: block, season and comparison metrics of grid-based wildlife surveys on Spark."""

from .operators.histogram import map_checklist_count
from .operators.metrics import (
    calc_atlasers,
    calc_block_effort,
    calc_breeding_season_coverage,
    calc_checklist_count,
    calc_nocturnal_diurnal_effort,
    calc_nocturnal_species_coded,
    calc_species_coded,
    calc_species_observed,
    summarize_breeding_codes,
    summarize_effort,
)
from .operators.season import block_mart, summarize_all_seasons, summarize_season
from .operators.starttime import modal_value as mode

__all__ = [
    "block_mart",
    "calc_atlasers",
    "calc_block_effort",
    "calc_breeding_season_coverage",
    "calc_checklist_count",
    "calc_nocturnal_diurnal_effort",
    "calc_nocturnal_species_coded",
    "calc_species_coded",
    "calc_species_observed",
    "map_checklist_count",
    "mode",
    "summarize_all_seasons",
    "summarize_breeding_codes",
    "summarize_effort",
    "summarize_season",
]
