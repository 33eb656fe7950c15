"""Comparison of two survey generations by species evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import description_of_rank
from ..functions.numbers import ratio
from .joins import full_keys, in_season, with_block_attributes, with_focal_flag
from .metrics import BLOCK, best_rank
from .prep import drop_unnamed_species, rename_categories, rename_species, with_rank_of_description

PAIR = [BLOCK, "common_name"]


def old_ranks_from_matrix(matrix: DataFrame, id_columns: list[str]) -> DataFrame:
    """Old survey's wide codes matrix to distinct (block, species, category, rank).

    One unpivot (a narrow generate), then the name fixes of the current
    taxonomy. The category stays as written; one outside the lookup has a null
    rank.
    """
    species = [c for c in matrix.columns if c not in id_columns]
    long = matrix.unpivot(id_columns, species, "common_name", "breeding_category_desc")
    return old_ranks(rename_categories(rename_species(drop_unnamed_species(long))))


def old_ranks(long: DataFrame) -> DataFrame:
    ranked = with_rank_of_description(long, "breeding_category_desc", "pba2_breeding_rank_max")
    return (
        ranked.withColumnRenamed("breeding_category_desc", "pba2_breeding_category_max")
        .select(*PAIR, "pba2_breeding_category_max", "pba2_breeding_rank_max")
        .distinct()
    )


def new_ranks(x: DataFrame, season: str = "Breeding") -> DataFrame:
    """Highest category per (block, species) within a season's months."""
    best = best_rank(in_season(x, season), PAIR, "pba3_breeding_rank_max")
    return best.select(
        *PAIR,
        description_of_rank(F.col("pba3_breeding_rank_max")).alias("pba3_breeding_category_max"),
        "pba3_breeding_rank_max",
    )


def compare_species(old: DataFrame, new: DataFrame, blocks: DataFrame) -> DataFrame:
    """Old against new rank per (block, species); what one side lacks is "Not Observed", rank 0."""
    both = full_keys(old, new, PAIR)
    filled = both.withColumns(
        {
            "pba2_breeding_category_max": F.coalesce("pba2_breeding_category_max", F.lit("Not Observed")),
            "pba2_breeding_rank_max": F.coalesce("pba2_breeding_rank_max", F.lit(0)),
            "pba3_breeding_category_max": F.coalesce("pba3_breeding_category_max", F.lit("Not Observed")),
            "pba3_breeding_rank_max": F.coalesce("pba3_breeding_rank_max", F.lit(0)),
        }
    )
    return with_block_attributes(filled, blocks)


def missing_species(comparison: DataFrame) -> DataFrame:
    """Pairs ranked higher in the old survey than in the new."""
    return comparison.filter(F.col("pba2_breeding_rank_max") > F.col("pba3_breeding_rank_max"))


def compare_blocks(comparison: DataFrame) -> DataFrame:
    """Species and coded-species counts of both surveys per block, and three shares.

    ``pct_missing_pba2_confirmations`` is taken over all species keys of the
    block, not over the old confirmations.
    """
    old, new = F.col("pba2_breeding_rank_max"), F.col("pba3_breeding_rank_max")
    counts = comparison.groupBy(BLOCK).agg(
        F.count_if(old > 0).alias("species_count_pba2"),
        F.count_if(old > 1).alias("species_coded_pba2"),
        F.count_if(new > 0).alias("species_count_pba3"),
        F.count_if(new > 1).alias("species_coded_pba3"),
        F.avg(((old == 4) & (new < 4)).cast("double")).alias("pct_missing_pba2_confirmations"),
        F.avg((new >= old).cast("double")).alias("pct_coded_atlas_comparison"),
    )
    return counts.withColumns(
        {
            "pba3_pba2_coded_count_compare_pct": ratio(F.col("species_coded_pba3"), F.col("species_coded_pba2")),
            "season": F.lit("Breeding"),
        }
    )


def block_gaps(missing: DataFrame, block: str, focal: DataFrame) -> DataFrame:
    """One block's missing species, widest rank gap first, with the focal flag."""
    gap = F.col("pba2_breeding_rank_max") - F.col("pba3_breeding_rank_max")
    one = missing.filter(F.col(BLOCK) == block).withColumn("atlas_diff", gap)
    return (
        with_focal_flag(one, focal)
        .orderBy(F.desc("atlas_diff"), "common_name")
        .select(
            BLOCK,
            "block_name",
            "common_name",
            "is_focal",
            "pba3_breeding_category_max",
            "pba2_breeding_category_max",
        )
    )
