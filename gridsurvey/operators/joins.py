"""Join shapes of the survey model.

No join carries a broadcast hint: literal lookups are local relations of known
size, and every other side is broadcast only if Catalyst (by scan statistics)
or adaptive execution (by shuffle size) finds it under
``spark.sql.autoBroadcastJoinThreshold``; beyond that it is a sort-merge join
whose skewed partitions are split.

Keys are matched null-safely where a missing block must meet a missing block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import seasons_of
from ..lookups import SEASONS


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other; keys appear once."""
    tagged = right.select(*[F.col(k).alias(f"__{k}") for k in on], *[c for c in right.columns if c not in on])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(tagged[f"__{k}"]) for k in on])
    joined = left.join(tagged, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full_outer", "outer", "full", "right"):
        joined = joined.withColumns({k: F.coalesce(k, f"__{k}") for k in on})
    return joined.drop(*[f"__{k}" for k in on])


def in_season(df: DataFrame, season: str, month: str = "observation_month") -> DataFrame:
    """Rows whose month belongs to a season.

    The months are constants, so this semi-join is an ``IN`` filter the
    Parquet scan can use.
    """
    return df.filter(F.col(month).isin(*SEASONS[season]))


def in_season_of(df: DataFrame, seasons: DataFrame, season: str) -> DataFrame:
    """Same, against a season table instead of the constants."""
    months = seasons.filter(F.col("season") == season).select(F.col("month").alias("observation_month"))
    return df.join(months, "observation_month", "left_semi")


def fan_out_seasons(df: DataFrame, month: str = "observation_month") -> DataFrame:
    """One row per season the month belongs to. Narrow: no join, no shuffle."""
    return df.withColumn("season", F.explode(seasons_of(F.col(month))))


def keep_species(df: DataFrame, species: DataFrame) -> DataFrame:
    """Rows of the listed species."""
    return df.join(species.select("common_name"), "common_name", "left_semi")


def keep_checklists(df: DataFrame, checklists: DataFrame) -> DataFrame:
    """Rows of the listed checklists."""
    return df.join(checklists.select("checklist_id"), "checklist_id", "left_semi")


def only_in_left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left whose key does not occur in right (null matches null)."""
    return null_safe_join(left, right.select(*on).distinct(), on, "left_anti")


def difference_both_ways(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys found on one side only, tagged with the side."""
    lk, rk = left.select(*on).distinct(), right.select(*on).distinct()
    return (
        only_in_left(lk, rk, on)
        .withColumn("only_in", F.lit("left"))
        .unionByName(only_in_left(rk, lk, on).withColumn("only_in", F.lit("right")))
    )


def union_distinct(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.select(*on).unionByName(right.select(*on)).distinct()


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Stack frames, each with its name in a tag column; missing columns become null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def left_join_all(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Fold metric tables onto the first one by key.

    Each join keeps the key partitioning of the one before, so the chain costs
    one exchange per input, and the inputs are already one row per key.
    """
    return reduce(lambda a, b: null_safe_join(a, b, on, "left"), tables)


def full_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join with the key united from both sides."""
    return null_safe_join(left, right, on, "full_outer")


def with_block_attributes(df: DataFrame, blocks: DataFrame, county_default: bool = True) -> DataFrame:
    """Attach block name, region and county; unknown blocks get the default texts."""
    out = null_safe_join(df, blocks, ["pba3_block"], "left")
    defaults = {"block_name": "Unknown block name", "block_region": "Unknown region"}
    if county_default:
        defaults["block_county"] = "Unknown county"
    return out.withColumns({c: F.coalesce(c, F.lit(text)) for c, text in defaults.items()})


def with_focal_flag(df: DataFrame, focal: DataFrame) -> DataFrame:
    """Mark focal species; the rest get false."""
    return df.join(focal.select("common_name", "is_focal"), "common_name", "left").withColumn(
        "is_focal", F.coalesce("is_focal", F.lit(False))
    )


def complete_keys(df: DataFrame, keys: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """Every key of ``keys``, with the given values where df has no row."""
    out = null_safe_join(keys.select(*on).distinct(), df, on, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})
