"""Binned counts and graduated classes: the data behind the charts and the count map."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import class_of, log_breaks
from .joins import null_safe_join


def _bin(df: DataFrame, value: str, bins: int) -> Column:
    bounds = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    place = F.floor(F.try_divide(F.col(value).cast("double") - lo, (hi - lo) / bins)) + 1
    return F.when(F.col(value).isNotNull(), F.least(F.coalesce(place, F.lit(1)), F.lit(bins)).cast("int"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin 1..bins between smallest and largest value; missing values left out."""
    return df.select(_bin(df, value, bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    binned = df.select(_bin(df, x, bins).alias("x_bin"), _bin(df, y, bins).alias("y_bin"))
    return binned.dropna().groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))


def map_checklist_count(df: DataFrame, value: str = "checklist_count", classes: int = 10) -> DataFrame:
    """Class and circle radius of every value on log-spaced breaks between smallest and largest.

    Breaks are rounded and made unique; radii run from 3 to 15 over the breaks
    left, and values below the first break get radius 2. Breaks come from one
    scalar subquery.
    """
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    breaks = bounds.select(F.array_distinct(log_breaks(F.col("lo"), F.col("hi"), classes)).alias("breaks"))
    scale = breaks.select(
        F.struct("breaks", log_breaks(F.lit(3), F.lit(15), F.size("breaks")).alias("radii")).alias("scale")
    ).scalar()
    placed = df.withColumn("__scale", scale).withColumn(
        "class", class_of(F.col(value), F.col("__scale.breaks"))
    )
    radius = F.when(F.col("class") == 0, F.lit(2.0)).otherwise(F.try_element_at(F.col("__scale.radii"), F.col("class")))
    return placed.withColumn("radius", radius).drop("__scale")


def density(df: DataFrame, value: str, groups: list[str], points: int = 512, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of a value over ``points`` equally spaced places per group: (groups, x, density, bandwidth).

    The bandwidth is 0.9 times the smaller of the standard deviation and the
    interquartile range over 1.34, times n to the power -1/5; where that is 0
    the standard deviation is taken, and a group whose values are all equal has
    none and is left out, as are missing values. The grid reaches ``cut``
    bandwidths beyond the smallest and largest value.

    Rows are first counted by value, each count is shared between its two
    neighbours on the grid in proportion to nearness, and the kernel is summed
    over the weighted grid: work per group depends on the grid and not on rows.
    """
    v, n = F.col("__v"), F.col("__n")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("__v")).agg(
        F.count("*").alias("__n"))
    total, mean = F.sum("__n").cast("double"), F.sum(v * n) / F.sum("__n")
    stats = counted.groupBy(*groups).agg(
        total.alias("__total"), mean.alias("__mean"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile("__v", [0.25, 0.75], n).alias("__quartiles"))
    deviations = null_safe_join(counted, stats, groups, "inner")
    spread = deviations.groupBy(*groups).agg(
        F.sqrt(F.try_divide(F.sum(n * (v - F.col("__mean")) * (v - F.col("__mean"))), F.any_value("__total") - 1)).alias("__sd"))
    iqr = (F.get("__quartiles", 1) - F.get("__quartiles", 0)) / 1.34
    narrow = F.least("__sd", iqr)
    bandwidth = 0.9 * F.when(narrow > 0, narrow).otherwise(F.col("__sd")) * F.pow("__total", F.lit(-0.2))
    grids = null_safe_join(stats.filter("__total > 1"), spread, groups, "inner").filter("__sd > 0").withColumn("bandwidth", bandwidth).select(
        *groups, "bandwidth", "__total", (F.col("__min") - cut * F.col("bandwidth")).alias("__lo"),
        ((F.col("__max") - F.col("__min") + 2 * cut * F.col("bandwidth")) / (points - 1)).alias("__step"))
    place = (v - F.col("__lo")) / F.col("__step")
    low = F.least(F.floor(place), F.lit(points - 2)).cast("int")
    shares = F.array(F.struct(low.alias("j"), (n * (1 - (place - low))).alias("w")), F.struct((low + 1).alias("j"), (n * (place - low)).alias("w")))
    binned = null_safe_join(counted, grids, groups, "inner").select(*groups, F.inline(shares)).groupBy(*groups, "j").agg(F.sum("w").alias("w"))
    arrays = binned.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("__bins"))
    scale = F.col("__step") / F.col("bandwidth")

    def at(g: Column) -> Column:
        kernel = F.aggregate("__bins", F.lit(0.0), lambda s, bin_: s + bin_.w * F.exp(
            -0.5 * (g - bin_.j) * scale * (g - bin_.j) * scale))
        return F.struct((F.col("__lo") + g * F.col("__step")).alias("x"),
                        (kernel / (F.col("__total") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"))

    whole = null_safe_join(arrays, grids, groups, "inner")
    curve = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)
    return whole.select(*groups, "bandwidth", F.inline(curve)).select(*groups, "x", "density", "bandwidth")
