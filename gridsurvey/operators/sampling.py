"""Repeatable sampling, row numbering and exact selection of the smallest keys.

Draws are decided by an md5 of seed and row key: the same rows come out
whatever the partitioning or a retried task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import uniform_key
from .joins import null_safe_join

COARSE = 1 << 10
FINE = 1 << 20


def sample_per_group(
    df: DataFrame, groups: list[str], n: int, key: list[str], seed: int = 1, salts: int = 32
) -> DataFrame:
    """Up to n random rows per group, the n smallest of the keyed order.

    First n per (group, salt), then n per group: no task sees more than
    salts x n rows of a group. Spark also cuts each map task's share to n rows
    per group before either shuffle (window group limit).
    """
    ranked = df.withColumns(
        {
            "__r": F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])),
            "__salt": F.pmod(F.xxhash64(*key), F.lit(salts)),
        }
    )
    order = [F.col("__r"), *[F.col(c) for c in key]]
    for by in ([*groups, "__salt"], groups):
        window = Window.partitionBy(*by).orderBy(*order)
        ranked = ranked.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= n).drop("__n")
    return ranked.drop("__r", "__salt")


def _cutoff(keyed: DataFrame, k: Column) -> Column:
    """(key, tie) of the k-th smallest row, as a scalar subquery.

    Two rounds of bucket counts narrow the search to one fine bucket of the
    key's logarithm; only that bucket is ordered. The counts are at most a few
    ten thousand rows each.
    """
    log = F.log2("__key")
    keyed = keyed.withColumns({"__b1": F.floor(log * COARSE), "__b2": F.floor(log * FINE)})

    def boundary(rows: DataFrame, bucket: str, wanted: Column) -> DataFrame:
        running = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = rows.groupBy(bucket).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(running))
        hit = counts.filter(F.col("upto") >= wanted)
        return hit.agg(F.min(bucket).alias("bucket"), F.min_by(F.col("upto") - F.col("n"), bucket).alias("before"))

    first = boundary(keyed, "__b1", k)
    inner = keyed.filter(F.col("__b1") == first.select("bucket").scalar())
    second = boundary(inner, "__b2", k - first.select("before").scalar())
    last = inner.filter(F.col("__b2") == second.select("bucket").scalar())
    position = F.row_number().over(Window.partitionBy("__b2").orderBy("__key", "__tie"))
    wanted = k - first.select("before").scalar() - second.select("before").scalar()
    exact = last.withColumn("__pos", position).filter(F.col("__pos") == wanted)
    return exact.select(F.struct("__key", "__tie")).scalar()


def take_smallest(df: DataFrame, key: Column, fraction: float, tie: list[str]) -> DataFrame:
    """The floor(fraction x rows) rows with the smallest positive key; rows without a key are never taken.

    If fewer rows have a key than are asked for, all of them are taken. No
    global sort and no driver-side top-k: the rows are filtered in place
    against an exact threshold. That takes five passes over ``df``, with the
    keys computed in each, so hand it a written table.
    """
    keyed = df.withColumns({"__key": key, "__tie": F.struct(*tie)}).filter(F.col("__key") > 0)
    k = df.agg(F.least(F.floor(F.count("*") * F.lit(fraction)), F.count(F.when(key > 0, 1)))).scalar()
    return keyed.filter(F.struct("__key", "__tie") <= _cutoff(keyed, k)).drop("__key", "__tie")


def sample_fraction(df: DataFrame, fraction: float, key: list[str], seed: int = 1) -> DataFrame:
    """Exactly floor(fraction x rows) rows, uniformly."""
    return take_smallest(df, 1.0 - uniform_key(seed, *[F.col(c) for c in key]), fraction, key)


def sample_weighted(df: DataFrame, fraction: float, weight: str, key: list[str], seed: int = 1) -> DataFrame:
    """Exactly floor(fraction x rows) rows without replacement, weighted (Efraimidis and Spirakis 2006)."""
    u = 1.0 - uniform_key(seed, *[F.col(c) for c in key])
    drawn = F.when(F.col(weight) > 0, F.greatest(-F.ln(u), F.lit(1e-300)) / F.col(weight))
    return take_smallest(df, drawn, fraction, key)


def with_row_number(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Position within a group of bounded size, by an explicit order."""
    window = Window.partitionBy(*groups).orderBy(*[F.asc_nulls_last(c) for c in order])
    return df.withColumn(out, F.row_number().over(window))


def with_global_index(df: DataFrame, levels: list[str], order: list[str], out: str) -> DataFrame:
    """1-based position of every row in the order (levels..., order...), nulls last.

    ``levels`` are columns from coarse to fine that start the order. Rows are
    counted per finest level; running sums over each level give its offset; a
    row number is taken only inside the finest level. So the table is never
    sorted in one task: the largest window holds one finest level.
    """
    fine = df.groupBy(*levels).agg(F.count("*").alias("__rows"))
    offsets = fine
    for depth in range(len(levels)):
        here, above = levels[: depth + 1], levels[:depth]
        window = Window.partitionBy(*above).orderBy(F.asc_nulls_last(levels[depth]))
        before = F.coalesce(F.sum("__n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        level = fine.groupBy(*here).agg(F.sum("__rows").alias("__n")).withColumn(f"__off{depth}", before).drop("__n")
        offsets = null_safe_join(offsets, level, here, "left")
    total = reduce(lambda a, b: a + b, [F.col(f"__off{d}") for d in range(len(levels))])
    base = offsets.select(*levels, total.alias("__base"))
    inside = Window.partitionBy(*levels).orderBy(*[F.asc_nulls_last(c) for c in order])
    numbered = null_safe_join(df, base, levels, "left").withColumn(out, F.col("__base") + F.row_number().over(inside))
    return numbered.drop("__base")
