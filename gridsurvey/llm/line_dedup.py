"""Removal of repeated passages by overlapping windows of three lines, in DataFrame functions.

Every three neighbouring lines that are not blank form a window, known by a
128-bit hash. A grouping over all documents, which combines on the map side,
finds the first place of every window that occurs more than once; every other
place of it is covered, and the lines under merged covers go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WINDOW = 3


def _windows(lines: Column, size: int) -> Column:
    """(h1, h2, first, last) of each run of ``size`` lines that are not blank; the numbers count all lines."""
    filled = F.filter(
        F.transform(lines, lambda line, at: F.struct(
            at.alias("at"), F.trim(line) == "", F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))),
        lambda x: ~x["col2"])
    # Zipped with itself moved on, so that no element is looked up by number.
    moved = [F.slice(filled, k + 1, F.greatest(F.size(filled), F.lit(1))) for k in range(size)]
    whole = F.filter(F.arrays_zip(*moved), lambda z: z[str(size - 1)].isNotNull())
    return F.transform(whole, lambda z: F.struct(
        F.xxhash64(*[z[str(k)]["a"] for k in range(size)]).alias("h1"),
        F.xxhash64(*[z[str(k)]["b"] for k in range(size)]).alias("h2"),
        z["0"]["at"].alias("first"), z[str(size - 1)]["at"].alias("last")))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_lines, n_removed, text), one row per row of ``docs``.

    The first place of a window is the one with the smallest (id, line), a null
    id before all others; windows may repeat inside a document. Lines are
    compared without the blanks around them; blank lines form no windows but go
    with a passage around them. A line under a later place goes even if it
    also belongs to the first place of another window; that line then still
    stands where the covering window came first. Repeated rows are one place,
    so they stay or change alike. A null text stays null and has no lines.
    Other columns are not looked at.
    """
    text = F.col("text")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumns({
        "version": F.xxhash64(text), "lines": F.split(F.coalesce(text, F.lit("")), "\n", -1)})
    found = base.select("doc_id", "version", F.explode(_windows(F.col("lines"), window)).alias("w")).select("doc_id", "version", "w.*")
    place = F.struct("doc_id", "version", "first")
    origins = staged(
        found.groupBy("h1", "h2").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n"), "windows")
    later = found.join(origins, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("origin")))
    covers = later.groupBy(F.col("doc_id").alias("c_id"), F.col("version").alias("c_version")).agg(
        F.collect_set(F.struct("first", "last")).alias("covers"))
    marked = base.join(covers, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("version") == F.col("c_version")), "left")
    gone = F.flatten(F.transform("covers", lambda c: F.sequence(c["first"], c["last"])))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    cleaned = F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("lines"))
    return marked.select(
        "doc_id", n_lines.cast("bigint").alias("n_lines"),
        F.when(F.col("covers").isNull(), 0).otherwise(F.size("lines") - F.size(stays)).cast("bigint").alias("n_removed"),
        F.when(F.col("covers").isNull(), text).otherwise(cleaned).alias("text"))
