"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text is cut into blocks of a fixed number of characters and every different
block gets an integer name; then adjacent names are paired and every different
pair gets a name, until one name is left for the whole text. Equal names mean
equal texts, without any chance of a collision.

Names do not come from one global sort. Blocks fall into buckets by a 64-bit
hash, and a block's name is (bucket, place among the sorted different blocks of
that bucket). Names so depend on the contents alone, not on partitions or
retries. The different blocks are found by a grouping on (bucket, block), which
combines on the map side: a block in a third of all texts moves once per map
task. Only buckets with several different blocks need a place other than 0 and
a join to find it; with 64 bits there are hardly any, and the full grouping
proves it for each run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null gives the empty text."""
    text = F.coalesce(text, F.lit(""))
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _blocks(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters, in one walk over it; an empty text is one empty piece."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(pieces)


def _bucket(*content: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*content), 64 - bits)


def _named(docs: DataFrame, contents: Column, fields: list[str], bits: int, level: int) -> DataFrame:
    """``docs`` with ``names`` (bucket, place) in place of ``contents``, an array of structs with ``fields``."""
    key = F.struct(_bucket(*[F.col(f"c.{f}") for f in fields], bits=bits).alias("b"), *[F.col(f"c.{f}") for f in fields])
    items = docs.select("row_key", F.posexplode(contents).alias("at", "c")).select("row_key", "at", key.alias("k"))
    distinct = items.select("k.*").distinct()
    crowded = staged(distinct.groupBy("b").count().filter("count > 1").select("b"), f"buckets{level}")
    if crowded.isEmpty():
        names = F.transform(contents, lambda c: F.struct(
            _bucket(*[c[f] for f in fields], bits=bits).alias("b"), F.lit(0).alias("place")))
        return docs.withColumn("names", names)
    inside = W.partitionBy("b").orderBy(*fields)
    places = staged(
        distinct.join(crowded, "b", "left_semi").select("b", *fields, (F.row_number().over(inside) - 1).alias("place")),
        f"places{level}",
    )
    flat = items.select("row_key", "at", "k.*").join(
        places.withColumnsRenamed({f: f"p_{f}" for f in fields}).withColumnRenamed("b", "p_b"),
        (F.col("b") == F.col("p_b"))
        & reduce(lambda x, y: x & y, [F.col(f).eqNullSafe(F.col(f"p_{f}")) for f in fields]),
        "left",
    )
    name = F.struct("b", F.coalesce("place", F.lit(0)).alias("place"))
    whole = flat.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("at", name.alias("name")))).alias("l"))
    return docs.join(whole.select("row_key", F.col("l.name").alias("names")), "row_key")


def text_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_chars: int = 4096, bits: int = 64) -> DataFrame:
    """(id, n_blocks, bucket, place, text_sha256), one row per row of ``docs``.

    Rows have equal (n_blocks, bucket, place) if and only if their texts are
    equal after lower-casing A-Z; null counts as empty. ``bits`` only sets how
    many buckets there are, the result is exact for any number of them.
    """
    text = ascii_lower(F.col(text_col))
    cut = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("text_sha256"), _blocks(F.col("t"), block_chars).alias("blocks"))
    # Repeated rows are alike in everything that follows, so one key does for them.
    keyed = cut.withColumn("row_key", F.struct("doc_id", "text_sha256"))
    contents = F.transform("blocks", lambda b: F.struct(b.alias("block")))
    named = _named(keyed, contents, ["block"], bits, 0)
    pending = staged(named.select("doc_id", "text_sha256", "row_key", F.size("names").alias("n_blocks"), "names"), "names0")
    done, level = [], 0
    while True:
        done.append(pending.filter(F.size("names") == 1))
        rest = pending.filter(F.size("names") > 1)
        if rest.isEmpty():
            break
        level += 1
        # A last name without a partner is paired with (null, null).
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(
                F.get("names", 2 * i)["b"].alias("b1"), F.get("names", 2 * i)["place"].alias("p1"),
                F.get("names", 2 * i + 1)["b"].alias("b2"), F.get("names", 2 * i + 1)["place"].alias("p2"),
            ),
        )
        paired = rest.withColumn("pairs", pairs).drop("names")
        pending = staged(
            _named(paired, F.col("pairs"), ["b1", "p1", "b2", "p2"], bits, level).drop("pairs"), f"names{level}")
    return reduce(DataFrame.unionByName, done).select(
        "doc_id", "n_blocks", F.col("names")[0]["b"].alias("bucket"), F.col("names")[0]["place"].alias("place"), "text_sha256")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_chars: int = 4096, bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Of equal texts the row with the largest id stays. A null text equals an
    empty one. A null id is smaller than any other, so such a row only stays
    in a group without ids. Rows repeated with their id each count in
    ``group_size`` and carry the same ``kept``; ``drop_duplicates`` leaves one
    of them. Other columns of ``docs`` are not looked at. An empty table gives
    no rows.
    """
    identity = ["n_blocks", "bucket", "place"]
    names = text_names(docs, id_col, text_col, block_chars, bits)
    groups = staged(
        names.groupBy(*identity).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return names.join(groups, identity).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    block_chars: int = 4096, bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated with their id, one."""
    kept = exact_duplicates(docs, id_col, text_col, block_chars, bits).filter("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    own = docs.withColumn("__sha", F.sha2(ascii_lower(F.col(text_col)), 256)).withColumn("__id", F.col(id_col))
    same = own["__id"].eqNullSafe(kept["__id"]) & (own["__sha"] == kept["__sha"])
    return own.join(kept, same, "left_semi").dropDuplicates(["__id", "__sha"]).select(*docs.columns)
