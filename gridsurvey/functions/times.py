"""Date and time column functions.

A start time is kept as ``TIMESTAMP_NTZ``: the wall clock of the survey's time
zone. That is exactly what the source holds, it does not move with the session
zone, and Parquet keeps it unchanged. Instants appear only inside the daylight
formulas, where the zone is named.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import MONTHS, SURVEY_TZ


def month_label(c: Column) -> Column:
    """``Jan`` .. ``Dec``, looked up: formatting a date costs many times as much."""
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), F.month(c) - 1)


def local_to_utc(c: Column, tz: str = SURVEY_TZ) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), c)


def utc_to_local(c: Column, tz: str = SURVEY_TZ) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), c)


def exists_on_clock(c: Column, tz: str = SURVEY_TZ) -> Column:
    """False for wall-clock times the spring clock change skips."""
    return utc_to_local(local_to_utc(c, tz), tz) == c


#: Hours of the day in which a zone's clock was ever set forward.
GAP_HOURS = {"America/New_York": (2,)}


def wall_clock(day: Column, time_of_day: Column, tz: str = SURVEY_TZ) -> Column:
    """Date and ``h:mm:ss`` text to a wall-clock timestamp.

    A missing or malformed time, and a time skipped by the clock change, give
    null.
    """
    text = F.concat(day.cast("string"), F.lit(" "), time_of_day)
    complete = time_of_day.rlike(r"^\s*\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?\s*$")
    parsed = F.when(complete, text.try_cast("timestamp_ntz"))
    hours = GAP_HOURS.get(tz)
    # The way to UTC and back costs more than the parsing, so it is left to the rows a gap can hold.
    exists = exists_on_clock(parsed, tz)
    if hours is not None:
        # Told from the text: the parsed time would be computed once more for every use of it.
        exists = ~time_of_day.rlike(r"^\s*0?(?:" + "|".join(map(str, hours)) + "):") | exists
    return F.when(exists, parsed)


def release_month_end(label: Column) -> Column:
    """``Jun-2026`` to the last day of that month."""
    return F.last_day(F.to_date(label, "MMM-yyyy"))


def day_month_of_year(c: Column, year: int) -> Column:
    """``15-May`` in a given year to a date, null where it is none."""
    return F.try_to_date(F.concat(F.lit(f"{year}-"), c), "yyyy-d-MMM")


def year_month(c: Column) -> Column:
    """First day of the month, the sortable year-month."""
    return F.trunc(c, "MM")


def clock_text(c: Column) -> Column:
    """Time of day as ``HH:mm:ss``."""
    return F.date_format(c, "HH:mm:ss")


def month_bit(c: Column) -> Column:
    """A mask with the bit of the month set, for merging months seen by ``bit_or``."""
    return F.call_function("shiftleft", F.lit(1), F.month(c))
