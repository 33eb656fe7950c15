"""Breeding calendar: species x 48 quarter-month codes, and safe dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import day_month_of_year
from ..lookups import MONTHS, WEEKS
from .prep import strip_prefix

SAFE_DATES = [
    "safe_date_probable_start",
    "safe_date_possible_start",
    "safe_date_possible_end",
    "safe_date_probable_end",
]
RAW_COLUMNS = ["taxonomic_order", "common_name", *SAFE_DATES, *WEEKS]


def clean_calendar(raw: DataFrame, names: list[str] = RAW_COLUMNS) -> DataFrame:
    """Name the columns by position; a star in the name marks a priority species and its first one is removed."""
    df = raw.toDF(*names)
    starred = df.withColumns(
        {
            "priority_species": F.col("common_name").contains("*"),
            "common_name": F.regexp_replace("common_name", r"^([^*]*)\*", "$1"),
        }
    )
    rest = [c for c in names if c not in ("taxonomic_order", "common_name")]
    return starred.select("taxonomic_order", "common_name", "priority_species", *rest)


def safe_date_columns(calendar: DataFrame) -> DataFrame:
    safe = [c for c in calendar.columns if "safe" in c]
    return calendar.select("taxonomic_order", "common_name", *safe).distinct()


def code_columns(calendar: DataFrame) -> DataFrame:
    """Without the safe dates; missing codes become empty."""
    kept = calendar.select(*[c for c in calendar.columns if "safe" not in c])
    return kept.withColumns({w: F.coalesce(w, F.lit("")) for w in WEEKS})


def safe_dates(columns: DataFrame, year: int) -> DataFrame:
    """Day-month texts as dates of a year, prefix dropped, by probable start."""
    picked = columns.select(
        "common_name",
        *[f"safe_date_{c}" for c in ("probable_start", "probable_end", "possible_start", "possible_end")],
    )
    dated = picked.withColumns({c: day_month_of_year(F.col(c), year) for c in SAFE_DATES})
    return strip_prefix(dated, "safe_", "date").orderBy(F.asc_nulls_last("date_probable_start"), "common_name")


def week_index(week: Column) -> Column:
    """Position 1..48 of a quarter-month label, by its calendar place."""
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(week, 1, 3))
    return ((month - 1) * 4 + F.substring(week, 5, 1).cast("int")).cast("int")


def calendar_long(codes: DataFrame) -> DataFrame:
    """One row per species and week with the week's index. Narrow: 48 rows per input row."""
    long = codes.drop("taxonomic_order").unpivot(
        ["common_name", "priority_species"], WEEKS, "week", "breeding_calendar_code"
    )
    return long.withColumns(
        {
            "breeding_calendar_code": F.coalesce("breeding_calendar_code", F.lit("")),
            "year_week_index": week_index(F.col("week")),
        }
    )


def calendar_window(
    codes: DataFrame, as_of_month: str | None = None, drop_empty: bool = False, show_priority: bool = True
) -> DataFrame:
    """Weeks from the month's first to the year's end (all without a month), no wrap.

    ``drop_empty`` leaves out species whose code in the first shown week is
    empty. The window is a choice of columns, so nothing is unpivoted.
    """
    weeks = WEEKS if as_of_month is None else WEEKS[MONTHS.index(as_of_month) * 4 :]
    filled = codes.withColumns({w: F.coalesce(w, F.lit("")) for w in weeks})
    if drop_empty:
        filled = filled.filter(F.col(f"`{weeks[0]}`") != "")
    ids = ["common_name", "priority_species"] if show_priority else ["common_name"]
    return filled.select(*ids, *[F.col(f"`{w}`") for w in weeks])
