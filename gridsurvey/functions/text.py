"""String column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import MONTHS


def squish(c: Column) -> Column:
    """Trim and collapse inner runs of whitespace to one blank."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def parse_number(c: Column) -> Column:
    """First number in a text as a double; grouping commas are dropped, no number gives null."""
    digits = F.regexp_extract(F.regexp_replace(c, ",", ""), r"-?(?:\d+\.?\d*|\.\d+)", 0)
    return digits.try_cast("double")


def parse_count(c: Column) -> Column:
    """Reported count: ``X`` (present, not counted) is 1, anything else its number."""
    return parse_number(F.when(c == "X", "1").otherwise(c))


def release_label(path: Column) -> Column:
    """Release label such as ``Jun-2026`` out of a file path; null where there is none."""
    label = F.regexp_extract(path, rf"((?:{'|'.join(MONTHS)})-\d{{4}}).txt", 1)
    return F.nullif(label, F.lit(""))


def list_contains(names: Column, name: str) -> Column:
    """True where a comma list holds ``name``; blanks around the items are ignored."""
    return F.array_contains(F.split(names, r"\s*,\s*"), name) | (F.trim(names) == name)


def block_link(block: Column, base_url: str) -> Column:
    return F.concat(F.lit(base_url), block)
