"""Sunrise, sunset and the day/night label.

The published solar equations (Meeus, as used by the NOAA calculator) are
written as staged projections of built-in functions: no UDF, no shuffle, all
inside whole-stage codegen. The table can therefore be evaluated inline on any
frame with a start time and coordinates; joining a prepared daylight table by
value is offered as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lookups import MINUTES_AFTER_SUNSET, MINUTES_BEFORE_SUNRISE, SURVEY_TZ

COS_ZENITH = -0.014538080502496963  # cosine of 90.833 degrees: centre of the sun at sunrise, with refraction


def daylight_keys(df: DataFrame) -> DataFrame:
    """Distinct (start, lon, lat)."""
    return df.select("observation_datetime", "longitude", "latitude").distinct()


RAD = "0.017453292519943295D"  # degrees to radians
DEG4 = "229.1831180523293D"  # radians to minutes: four per degree


def _with_sun(df: DataFrame, fraction: str) -> DataFrame:
    """Add half the day's length and the equation of time, both in minutes, for the sun at a fraction of the UTC day.

    Staged so that every intermediate value is computed once. Multiple angles
    come from sine and cosine of the single angle, and all inputs are free of
    nulls, which keeps the generated code short.
    """
    df = df.selectExpr("*", f"(__day - 0.5D + {fraction}) * {1 / 36525!r}D AS __t")
    df = df.selectExpr(
        "*",
        f"(280.46646D + __t * (36000.76983D + 0.0003032D * __t)) * {RAD} AS __L",
        f"(357.52911D + __t * (35999.05029D - 0.0001537D * __t)) * {RAD} AS __M",
        "0.016708634D - __t * (0.000042037D + 0.0000001267D * __t) AS __e",
        f"(125.04D - 1934.136D * __t) * {RAD} AS __om",
    )
    df = df.selectExpr(
        "*", "sin(__M) AS __sM", "cos(__M) AS __cM", "sin(2D * __L) AS __s2L", "cos(2D * __L) AS __c2L"
    )
    df = df.selectExpr(
        "*",
        f"""__L + {RAD} * (__sM * (1.914602D - __t * (0.004817D + 0.000014D * __t))
            + 2D * __sM * __cM * (0.019993D - 0.000101D * __t)
            + (3D - 4D * __sM * __sM) * __sM * 0.000289D - 0.00569D - 0.00478D * sin(__om)) AS __lam""",
        f"""{RAD} * (23D + (26D + (21.448D - __t * (46.815D + __t * (0.00059D - __t * 0.001813D))) * {1 / 60!r}D)
            * {1 / 60!r}D + 0.00256D * cos(__om)) AS __eps""",
    )
    df = df.selectExpr("*", "sin(__eps) * sin(__lam) AS __sin_dec", "tan(__eps * 0.5D) AS __tan")
    df = df.selectExpr("*", "__tan * __tan AS __y")
    df = df.selectExpr(
        "*",
        f"""(__y * __s2L - 2D * __e * __sM + 4D * __e * __y * __sM * __c2L
            - __y * __y * __s2L * __c2L - 2.5D * __e * __e * __sM * __cM) * {DEG4} AS __eq""",
        f"{COS_ZENITH!r}D - __sin_phi * __sin_dec AS __a",
        "__cos_phi * __cos_phi * (1D - __sin_dec * __sin_dec) AS __bb",
    )
    # acos(a / b) for positive b, without a division; NaN where |a| > b
    df = df.selectExpr("*", f"atan2(sqrt(__bb - __a * __a), __a) * {DEG4} AS __hour")
    scratch = ["t", "L", "M", "e", "om", "sM", "cM", "s2L", "c2L", "lam", "eps", "tan", "y", "sin_dec", "a", "bb"]
    return df.drop(*[f"__{c}" for c in scratch])


def _event(side: int) -> str:
    """UTC minute of sunrise (side 1) or sunset (-1); NaN where the sun does not cross the horizon."""
    return f"(720D - __lon4 - {side}D * __hour - __eq)"


def _wall_clock(micros: str, tz: str) -> str:
    """UTC microseconds since 1970 to the wall clock of a zone, whatever the session zone.

    The generated code of ``from_utc_timestamp`` holds the zone; ``convert_timezone`` looks it up by name for every row.
    """
    local = f"unix_micros(from_utc_timestamp(timestamp_micros({micros}), '{tz}'))"
    return f"timestampadd(MICROSECOND, {local}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"


def with_daylight(df: DataFrame, tz: str = SURVEY_TZ, start: str = "observation_datetime") -> DataFrame:
    """Add ``sunrise`` and ``sunset`` of the start's local date, as wall-clock timestamps.

    The sun's place is taken at 0h UTC first, for both events, and once more
    at each time found. Null where there is no start, or no sunrise on that
    day at that latitude.

    Values pass from step to step in small arrays handled by ``transform``. A
    projection with a higher-order function stands outside whole-stage
    codegen, so each pass is generated as a method of its own, whatever runs
    before and after. Together they would exceed the 8000 bytecodes up to
    which the JVM compiles a method, and a row would cost several times as
    much.
    """
    kept = df.columns
    df = df.selectExpr(
        "*",
        f"transform(array(longitude * 4D, latitude * {RAD}), c -> coalesce(c, 0D)) AS __place",
        f"coalesce(CAST(datediff(CAST({start} AS DATE), DATE'2000-01-01') AS DOUBLE), 0D) AS __day",
    )
    df = df.selectExpr("*", "coalesce(__place[0], 0D) AS __lon4", "coalesce(__place[1], 0D) AS __phi").drop("__place")
    df = df.selectExpr("*", "sin(__phi) AS __sin_phi", "cos(__phi) AS __cos_phi")
    fractions = f"transform(array({_event(1)}, {_event(-1)}), m -> m * {1 / 1440!r}D) AS __at"
    df = _with_sun(df, "0D").selectExpr("*", fractions).drop("__hour", "__eq")
    known = f"{start} IS NOT NULL AND longitude IS NOT NULL AND latitude IS NOT NULL"
    midnight = f"unix_date(CAST({start} AS DATE)) * 86400000000L"
    for place, name, side in ((0, "sunrise", 1), (1, "sunset", -1)):
        minute = f"CASE WHEN {known} AND NOT isnan(__hour) THEN floor({_event(side)} * 60e6D + 0.5D) END"
        df = _with_sun(df, f"coalesce(__at[{place}], 0D)")
        df = df.selectExpr("*", f"transform(array({minute}), u -> u + {midnight}) AS __{name}").drop("__hour", "__eq")
    return df.selectExpr(*kept, *[f"{_wall_clock(f'__{name}[0]', tz)} AS {name}" for name in ("sunrise", "sunset")])


def daylight_table(df: DataFrame, tz: str = SURVEY_TZ) -> DataFrame:
    """One row per distinct (start, lon, lat) with sunrise and sunset."""
    return with_daylight(daylight_keys(df), tz)


def join_daylight(df: DataFrame, daylight: DataFrame) -> DataFrame:
    """Attach a prepared daylight table by (lon, lat, start)."""
    return df.join(daylight, ["longitude", "latitude", "observation_datetime"], "left")


def with_day_night_label(df: DataFrame, start: str = "observation_datetime") -> DataFrame:
    """``diurnal`` within [sunrise - 40 min, sunset + 20 min], else ``nocturnal``; ``unknown`` if undecidable."""
    dawn = F.col("sunrise") - F.expr(f"INTERVAL {MINUTES_BEFORE_SUNRISE} MINUTES")
    dusk = F.col("sunset") + F.expr(f"INTERVAL {MINUTES_AFTER_SUNSET} MINUTES")
    by_day = F.col(start).between(dawn, dusk)
    return df.withColumn("checklist_type", F.when(by_day, "diurnal").when(~by_day, "nocturnal").otherwise("unknown"))
