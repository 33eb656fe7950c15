"""Wide to long, long to wide, nested tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_columns(df: DataFrame, ids: list[str], names_to: str, values_to: str) -> DataFrame:
    """All columns but the ids to rows; missing values stay as rows."""
    return df.unpivot(ids, [c for c in df.columns if c not in ids], names_to, values_to)


def pivot_fixed(df: DataFrame, ids: list[str], names_from: str, names: list, aggregate) -> DataFrame:
    """Rows to columns over a given list of names, so no job is run to find them."""
    return df.groupBy(*ids).pivot(names_from, names).agg(aggregate)


def explode_list(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """A delimited list to one row per item; a missing list stays one row."""
    return df.withColumn(column, F.explode_outer(F.split(column, sep)))


def nest(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Rows of a group to an ordered array of structs; for groups of bounded size."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(out))


def unnest(df: DataFrame, column: str) -> DataFrame:
    """Inverse of :func:`nest`."""
    return df.select(*[c for c in df.columns if c != column], F.inline(column))
