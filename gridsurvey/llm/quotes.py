"""Conversations by linked quotations, in DataFrame functions only.

Lines that begin with one or more ``>`` are quotes of that level. Quoted and own
paragraphs are normalised (one line, single blanks, lower case) and hashed; a
quoted paragraph is linked to the latest earlier message of the conversation
that has it as its own. The message quoted most directly is the parent, and
the chain of parents leads to a root. Messages in the order (root, turn) are in
reply order: every message stands after its parent, and each thread together.

A conversation is never gathered: the result is one row per message, and what
is collected is bounded by a single message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Turns per range in which the latest earlier original is looked up.
TURNS = 1024
_BREAK, _MARK = "\x01", "\x02"
_PREFIX = r"^(?:[ \t]*>)+[ \t]?"


def _lines(text: Column) -> Column:
    """(level, body) of each line; control characters that mark paragraphs below are dropped first."""
    clean = F.translate(F.coalesce(text, F.lit("")), _BREAK + _MARK + "\r", "")
    split = F.split(clean, "\n", -1)
    return F.transform(split, lambda line: F.when(
        F.ltrim(line, F.lit(" \t")).startswith(">"), F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(line, _PREFIX, "").alias("body"))).otherwise(F.struct(F.lit(0).alias("level"), line.alias("body"))))


def _own_text(lines: Column) -> Column:
    """Lines of level 0 but for "... wrote:" right before a quote, without blank lines at the ends."""
    following = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    pairs = F.zip_with(lines, following, lambda line, after: F.struct(
        line["level"].alias("level"), line["body"].alias("body"), F.coalesce(after["level"], F.lit(0)).alias("after")))
    own = F.filter(pairs, lambda p: (p["level"] == 0) & ~(
        p["body"].rlike(r"^\s*On\b.*\bwrote:\s*$") & (p["after"] > 0)))
    joined = F.array_join(F.transform(own, lambda p: p["body"]), "\n")
    return F.regexp_replace(joined, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$|^[ \t]+$", "")


def _paragraphs(lines: Column) -> Column:
    """(level, text, h1, h2) of each run of lines of one level that are not blank, in order."""
    before = F.concat(F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("body"))), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1))))
    tagged = F.zip_with(lines, before, lambda line, last: F.concat(
        F.when((line["level"] == last["level"]) & (F.trim(line["body"]) != "") & (F.trim(last["body"]) != ""), " ")
        .otherwise(F.concat(F.lit(_BREAK), line["level"].cast("string"), F.lit(_MARK))),
        line["body"]))
    runs = F.split(F.array_join(tagged, ""), _BREAK)
    parts = F.transform(runs, lambda r: F.struct(
        F.substring_index(r, _MARK, 1).alias("level"),
        F.lower(F.trim(F.regexp_replace(F.substring_index(r, _MARK, -1), r"\s+", " "))).alias("text")))
    return F.transform(F.filter(parts, lambda p: (p["text"] != "") & (p["level"] != "")), lambda p: F.struct(
        p["level"].cast("int").alias("level"), p["text"].alias("text"),
        F.xxhash64(p["text"]).alias("h1"), F.xxhash64(F.lit(1), p["text"]).alias("h2")))


def _originals(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """Each of ``quoted`` (conv, turn, level, h1, h2) with ``origin``, the latest earlier turn of ``own`` (conv, turn, h1, h2).

    The latest earlier turn lies in the same range of turns or in the last
    range before it that has one, so no window holds more than a range or a
    list of ranges, however often a passage is written and quoted.
    """
    key = ["conv", "h1", "h2"]
    wanted = quoted.select(*key).distinct()
    own = own.join(wanted, key, "left_semi").select(*key, "turn", F.lit(None).cast("int").alias("level")).distinct()
    both = own.union(quoted.select(*key, "turn", "level").distinct()).withColumn("range", F.floor(F.col("turn") / TURNS))
    is_own = F.col("level").isNull()
    last = both.groupBy(*key, "range").agg(F.max(F.when(is_own, F.col("turn"))).alias("last"))
    ranges = W.partitionBy(*key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    earlier = staged(last.withColumn("before", F.max("last").over(ranges)).drop("last"), "quote_ranges")
    inside = W.partitionBy(*key, "range").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(is_own, F.col("turn"))).over(inside)).filter(~is_own)
    return near.join(earlier, [*key, "range"]).select(*key, "turn", "level", F.coalesce("near", "before").alias("origin")).filter("origin is not null")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, root_turn, parent_turn, depth, n_quotes, n_linked, text, unlinked, formatted), one row per row.

    ``parent_turn`` is the latest turn among the linked quotes of the lowest
    level; null without any. ``root_turn`` is where the chain of parents ends,
    the turn itself without a parent; ``depth`` counts its steps. ``text`` has no
    quotes; quoted paragraphs found in no earlier message are listed in
    ``unlinked``, so that nothing is lost. ``formatted`` is the text as a chat
    turn, of the user where the role is null. Order by (conv_id, root_turn, turn) for reply order.

    Texts of control characters \\x01 and \\x02 lose them. A null text counts as
    empty. Rows with a null conversation or turn are linked with nothing. Rows
    repeated with conversation and turn are one message for its replies and
    each keep their own text. Other columns are not looked at.
    """
    base = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("raw"))
    parsed = base.withColumn("lines", _lines(F.col("raw"))).withColumn("paragraphs", _paragraphs(F.col("lines")))
    each = parsed.filter("conv is not null and turn is not null").select("conv", "turn", F.explode("paragraphs").alias("p"))
    # Three steps below read the hashes, which are a small part of the texts.
    each = staged(each.select("conv", "turn", "p.level", "p.h1", "p.h2"), "quote_paragraphs")
    quoted = each.filter("level > 0")
    linked = staged(_originals(each.filter("level = 0"), quoted), "quote_links")
    by_message = staged(linked.groupBy("conv", "turn").agg(
        F.max_by("origin", F.struct(-F.col("level"), "origin")).alias("parent"),
        F.collect_set(F.struct("h1", "h2")).alias("found")), "quote_parents")

    chains = by_message.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth"))
    chains = staged(chains, "quote_chains")
    while True:
        # Every step doubles the part of the chain that a row knows.
        onward = chains.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = chains.join(onward, ["conv", "root"], "left")
        chains = staged(joined.select(
            "conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved")), "quote_chains")
        if chains.filter("moved").isEmpty():
            break
    ends = by_message.join(chains.drop("moved"), ["conv", "turn"])
    # Texts without a quoted line are not cut into paragraphs a second time.
    none = F.filter(F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("text"), F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"))), lambda p: p["level"] > 0)
    has_quote = F.exists("lines", lambda line: line["level"] > 0)
    quotes = F.when(has_quote, F.filter(_paragraphs(F.col("lines")), lambda p: p["level"] > 0)).otherwise(none)
    full = parsed.withColumn("text", _own_text(F.col("lines"))).withColumn("quotes", quotes).drop("lines", "paragraphs", "raw")
    out = full.join(ends, ["conv", "turn"], "left")
    found = F.coalesce("found", F.array().cast("array<struct<h1:bigint,h2:bigint>>"))
    unlinked = F.filter("quotes", lambda q: ~F.array_contains(found, F.struct(q["h1"].alias("h1"), q["h2"].alias("h2"))))
    role = F.coalesce("role", F.lit("user"))
    return out.withColumn("open", unlinked).select(
        F.col("conv").alias("conv_id"), "turn", "role", F.coalesce("root", "turn").alias("root_turn"), F.col("parent").alias("parent_turn"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.size("quotes").cast("bigint").alias("n_quotes"),
        (F.size("quotes") - F.size("open")).cast("bigint").alias("n_linked"), "text",
        F.transform("open", lambda q: q["text"]).alias("unlinked"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")).alias("formatted"))


def in_reply_order(linked: DataFrame) -> DataFrame:
    """The rows sorted over all partitions, so that a written table reads as conversations; a long one spans several partitions."""
    order = ["conv_id", "root_turn", "turn"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)
