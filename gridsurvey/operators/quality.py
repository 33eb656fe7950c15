"""Data-quality checks. Each gives a small report frame; none stops a run."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .joins import only_in_left


def unique_report(df: DataFrame, keys: list[str], name: str = "") -> DataFrame:
    """One row: keys occurring more than once, and whether the key is unique."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    return repeated.select(
        F.lit(name or ",".join(keys)).alias("check"), "duplicates", (F.col("duplicates") == 0).alias("ok")
    )


def one_to_one_report(df: DataFrame, left: str, right: str) -> DataFrame:
    """Is the mapping 1-1: each left value with one right value (missing left ignored), and back."""
    pairs = df.select(left, right).distinct()
    return unique_report(pairs.filter(F.col(left).isNotNull()), [left], f"{left} -> {right}").unionByName(
        unique_report(pairs, [right], f"{right} -> {left}")
    )


def coverage_report(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of each side missing on the other: two rows."""

    def one(name: str, x: DataFrame, y: DataFrame) -> DataFrame:
        gaps = only_in_left(x.select(*keys).distinct(), y, keys).agg(F.count("*").alias("missing"))
        return gaps.select(F.lit(name).alias("check"), "missing", (F.col("missing") == 0).alias("ok"))

    return one("all of a in b", a, b).unionByName(one("all of b in a", b, a))


def _digest_words(value: Column) -> list[Column]:
    """The SHA-256 of a text as four integers; a missing text has none."""
    digest = F.sha2(value.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("bigint") for i in range(4)]


def key_reports(
    df: DataFrame,
    unique: dict[str, list[str]] | None = None,
    one_to_one: list[tuple[str, str]] | None = None,
    covered: dict[str, tuple[DataFrame, list[str]]] | None = None,
) -> DataFrame:
    """(check, failures, ok) for many candidate keys of one table, which is read once.

    ``unique`` names key columns that must not repeat. ``one_to_one`` pairs give two
    checks each: values with several partners, a missing value being a partner
    like any other, and missing left values not being looked at. ``covered``
    names another table with the same key columns and gives two checks: keys
    of ``df`` that it lacks, and its keys that ``df`` lacks.

    All keys are grouping sets of one aggregation, so there is one exchange
    however many checks there are. A value has several partners if the least and
    the largest differ or only some are missing: no set of them is kept. Texts
    are told apart by the four words of their SHA-256, which have a place in a
    hash aggregate; the texts themselves would have all rows sorted.
    """
    unique, pairs, covered = unique or {}, one_to_one or [], covered or {}
    sets = [*unique.values(), *[[c] for pair in pairs for c in pair], *[keys for _, keys in covered.values()]]
    cols = list(dict.fromkeys(c for keys in sets for c in keys))
    if not sets:
        raise ValueError("no checks are asked for")
    words = {c: [f"__{at}w{i}" for i in range(4)] for at, c in enumerate(dict.fromkeys(c for pair in pairs for c in pair))
             if df.schema[c].dataType in (StringType(), BinaryType())}
    rows = df.select(*cols, F.lit(0).alias("__side"), *[
        word.alias(name) for c, names in words.items() for name, word in zip(names, _digest_words(F.col(c)), strict=True)])
    for i, (other, keys) in enumerate(covered.values(), 1):
        rows = rows.unionByName(other.select(*keys, F.lit(i).alias("__side")), allowMissingColumns=True)

    def level(keys: list[str]) -> Column:
        """Rows of this grouping set: one bit per column, set where the column is not in the key."""
        return F.col("__set") == sum(1 << i for i, c in enumerate(reversed(cols)) if c not in keys)

    here = F.col("__side") == 0
    partners = {}
    for i, (a, b) in enumerate(pairs):
        for name, c in ((f"__{i}a", b), (f"__{i}b", a)):
            values = [F.when(here, F.col(v)) for v in words.get(c, [c])]
            known = F.count(values[0])
            differ = reduce(or_, [F.min(v) < F.max(v) for v in values])
            partners[name] = differ | ((known > 0) & (known < F.count_if(here)))
    distinct_sets = list(dict.fromkeys(tuple(keys) for keys in sets))
    grouped = rows.groupingSets([[F.col(c) for c in keys] for keys in distinct_sets], *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("__set"),
        F.count_if(here).alias("__n"),
        *[F.coalesce(several, F.lit(False)).alias(name) for name, several in partners.items()],
        *[F.max(F.col("__side") == i).alias(f"__in{i}") for i in range(1, len(covered) + 1)],
    )
    found = F.col("__n") > 0
    failures: dict[str, Column] = {name: level(keys) & (F.col("__n") > 1) for name, keys in unique.items()}
    for i, (a, b) in enumerate(pairs):
        failures[f"{a} -> {b}"] = level([a]) & F.col(a).isNotNull() & F.col(f"__{i}a")
        failures[f"{b} -> {a}"] = level([b]) & F.col(f"__{i}b")
    for i, (name, (_, keys)) in enumerate(covered.items(), 1):
        failures[f"all in {name}"] = level(keys) & found & ~F.col(f"__in{i}")
        failures[f"all of {name}"] = level(keys) & ~found & F.col(f"__in{i}")
    counts = grouped.agg(*[F.count_if(failed).alias(f"__f{i}") for i, failed in enumerate(failures.values())])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"__f{i}").alias("failures"), (F.col(f"__f{i}") == 0).alias("ok"))
        for i, name in enumerate(failures)
    ])))


def same_times_report(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Do timestamps keep type and value through a write and read: one row per column."""
    types_before, types_after = dict(before.dtypes), dict(after.dtypes)
    renamed = after.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"a_{c}") for c in columns])
    condition = None
    for k in keys:
        match = before[k].eqNullSafe(renamed[f"k_{k}"])
        condition = match if condition is None else condition & match
    joined = before.select(*dict.fromkeys([*keys, *columns])).join(renamed, condition, "inner")
    counts = joined.agg(
        F.count("*").alias("rows"),
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"a_{c}"))).alias(f"changed_{c}") for c in columns],
    )
    kept = [F.lit(types_before[c] == types_after[c]) for c in columns]
    reports = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("rows"),
                F.col(f"changed_{c}").alias("changed"),
                (kept[i] & (F.col(f"changed_{c}") == 0)).alias("ok"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return counts.select(F.inline(reports))


def missing_start_by_protocol(df: DataFrame) -> DataFrame:
    """Rows without a start time, per protocol."""
    return df.filter(F.col("observation_datetime").isNull()).groupBy("protocol_name").agg(F.count("*").alias("n"))
