"""Cheapest repair of broken conversations by a secondary-sorted stream.

Rows are partitioned by conversation and sorted by turn; ``mapInPandas`` keeps
the state of a dynamic program across Arrow batches. The program runs from the
last row to the first with the cost that is left from each of four states, so
that the walk from the first row on can take the least letter at every step. Of
a row only the number of its step stays behind, two bytes, which go to a scratch
file of the task once a conversation is very long. A second stream in turn
order applies the edits to the texts.
"""

from __future__ import annotations

import tempfile
from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: What a role begins with, and the edits in ASCII order.
EDITS = "DIKR"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NONE = 1 << 40

#: States of a repaired conversation so far: empty, only a system turn, last turn by the user, last turn by the assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after one more turn by user or assistant; only the one that may come next is allowed.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after keeping a turn, by state and initial; -1 where that is not allowed.
KEPT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}

#: Steps remembered in memory for each conversation; more go to a file.
HELD = 1 << 20

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
FACTS = "conv string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
TURNS = "conv string, at bigint, edit string, role string, text string"


class Steps:
    """The distinct steps of the program: what is left after a row, from each state, and the edit to make there.

    Costs left are kept as differences from the least one, of which there are few.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.edits: list[tuple] = []
        self.left: list[tuple] = []
        self.less: list[int] = []
        self.end = self._settled([0, NONE, NONE, 0], [None] * 4)

    def _settled(self, cost: list, edit: list) -> tuple:
        """Costs and edits once insertions before the row are allowed; ties take the least letter."""
        out = list(cost)
        for _ in range(3):
            for s in range(4):
                out[s] = min(out[s], INSERT + out[NEXT[s]])
        for s in range(4):
            if INSERT + out[NEXT[s]] == out[s] and (cost[s] > out[s] or edit[s] is not None and edit[s][0] != "D"):
                edit[s] = ("I", NEXT[s])
        return tuple(out), tuple(edit)

    def before(self, after: tuple, initial: str, must_go: bool, truncated: bool) -> int:
        """The number of the step over one row, given the costs left after it."""
        key = (after, initial, must_go, truncated)
        step = self.known.get(key)
        if step is None:
            cost, edit, more = [NONE] * 4, [None] * 4, TRUNCATED if truncated else 0
            for s in range(4):
                ways = [(DELETE + after[s], "D", s)]
                if not must_go:
                    kept = KEPT.get(initial, (-1,) * 4)[s]
                    if kept >= 0:
                        ways.append((KEEP + more + after[kept], "K", kept))
                    ways.append((REROLE + more + after[NEXT[s]], "R", NEXT[s]))
                cost[s], letter, to = min(ways)
                edit[s] = (letter, to)
            cost, edit = self._settled(cost, edit)
            least = min(cost)
            step = self.known[key] = len(self.edits)
            self.edits.append(edit)
            self.left.append(tuple(c - least for c in cost))
            self.less.append(least)
        return step


class Trail:
    """Step numbers in the order in which they come; read back from the last to the first."""

    def __init__(self, held: int):
        self.held, self.last, self.file, self.blocks = held, array("H"), None, 0

    def add(self, step: int) -> None:
        self.last.append(step)
        if len(self.last) >= self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.last.tofile(self.file)
            self.blocks, self.last = self.blocks + 1, array("H")

    def backwards(self):
        yield from reversed(self.last)
        for k in reversed(range(self.blocks)):
            self.file.seek(k * self.held * self.last.itemsize)
            block = array("H")
            block.fromfile(self.file, self.held)
            yield from reversed(block)
        if self.file is not None:
            self.file.close()


def _find_edits(held: int):
    def run(batches):
        steps, conv, open_ = Steps(), None, False

        def result():
            edits, state = bytearray(), EMPTY
            for step in trail.backwards():
                letter = "I"
                while letter == "I":
                    letter, state = steps.edits[step][state]
                    edits += letter.encode()
            while steps.end[1][state] is not None:
                state = steps.end[1][state][1]
                edits += b"I"
            return conv, blank, duplicate, truncated, illegal, base + left[EMPTY], edits.decode()

        for batch in batches:
            out = []
            for key, copies, initial, is_blank, first, is_cut in zip(
                    batch["conv"], batch["copies"], batch["initial"], batch["blank"], batch["first"], batch["cut"]):
                key = None if pd.isna(key) else key
                if not open_ or key != conv:
                    if open_:
                        out.append(result())
                    open_, conv, trail, left, base, after = True, key, Trail(held), steps.end[0], 0, None
                    blank = duplicate = truncated = illegal = 0
                # From last to first: of equal rows all but the first are duplicates.
                for k in range(copies - 1, -1, -1):
                    again = not is_blank and not (first and k == 0)
                    step = steps.before(left, initial, is_blank or again, is_cut)
                    trail.add(step)
                    left, base = steps.left[step], base + steps.less[step]
                    blank += is_blank
                    duplicate += again
                    truncated += is_cut and not is_blank and not again
                    illegal += after is not None and initial + after not in ("su", "ua", "au")
                    after = initial
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FACTS.split(", ")])
        if open_:
            yield pd.DataFrame([result()], columns=[c.split()[0] for c in FACTS.split(", ")])

    return run


def _apply_edits(batches):
    """Repaired turns; the first row of a conversation holds its edits, its turns follow in order."""
    names, open_ = [c.split()[0] for c in TURNS.split(", ")], False

    def added(edit, role, text):
        nonlocal state, at
        if edit == "K":
            state = KEPT[role[0]][state]
        else:
            state = NEXT[state]
            role = "user" if state == USER else "assistant"
        at += 1
        return conv, at - 1, edit, role, text

    def inserted():
        nonlocal place
        while place < len(edits) and edits[place] == "I":
            place += 1
            yield added("I", None, "")

    for batch in batches:
        out = []
        for key, kind, role, text in zip(batch["conv"], batch["kind"], batch["role"], batch["text"]):
            if kind == 0:
                if open_:
                    out += inserted()
                open_, conv, edits, place, state, at = True, None if pd.isna(key) else key, text, 0, EMPTY, 0
                continue
            out += inserted()
            edit, place = edits[place], place + 1
            if edit != "D":
                out.append(added(edit, role, text))
        yield pd.DataFrame(out, columns=names)
    if open_:
        yield pd.DataFrame(list(inserted()), columns=names)


def _digest(batches):
    import hashlib

    conv, sha, open_ = None, None, False
    for batch in batches:
        out = []
        for key, role, text in zip(batch["conv"], batch["role"], batch["text"]):
            key = None if pd.isna(key) else key
            if not open_ or key != conv:
                if open_:
                    out.append((conv, sha.hexdigest()))
                open_, conv, sha = True, key, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if open_:
        yield pd.DataFrame([(conv, sha.hexdigest())], columns=["conv", "repaired_sha256"])


def _plain(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, mark): nulls as one space; ``mark`` puts rows of one turn and role into an order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select(
        F.col("conv_id").cast("string").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"), F.sha2(text, 256).alias("mark"))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def find_repairs(turns: DataFrame, held: int = HELD) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit), one row per conversation of ``turns``.

    ``turns`` has conv_id, turn, role and text; other columns are not looked at.
    Rows go by turn, null turns first, then by role and by the SHA-256 of the
    text; equal rows lie side by side. Null roles and texts count as one space;
    rows without a conv_id are one conversation, whose id is null. Empty tables
    give no row. A conversation may have any number of rows: neither a task nor
    the driver holds more of it than its edits, one letter for each row.
    """
    seen = F.struct(F.col("turn").isNotNull(), "turn")
    rows = _plain(turns).withColumn("end", _trimmed(F.col("text")))
    groups = staged(rows.groupBy("conv", "turn", "role", "mark").agg(
        F.count("*").alias("copies"), (F.max(F.length("end")) == 0).alias("blank"),
        (~F.max(F.right("end", F.lit(1))).isin(".", "!", "?")).alias("cut")), "turn_groups")
    again = groups.filter("not blank").groupBy("conv", "role", "mark").agg(
        F.min(seen).alias("seen"), F.count("*").alias("n")).filter("n > 1").select(
        F.col("conv").alias("a_conv"), F.col("role").alias("a_role"), F.col("mark").alias("a_mark"), "seen")
    marked = groups.join(again, F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("role") == F.col("a_role")) &
                         (F.col("mark") == F.col("a_mark")), "left")
    ordered = marked.select(
        "conv", "turn", "role", "mark", "copies", F.left("role", F.lit(1)).alias("initial"), "blank",
        (F.col("seen").isNull() | seen.eqNullSafe(F.col("seen"))).alias("first"), "cut")
    ordered = ordered.repartition("conv").sortWithinPartitions(
        "conv", F.desc_nulls_last("turn"), F.desc("role"), F.desc("mark"))
    return ordered.mapInPandas(_find_edits(held), FACTS)


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, at, edit, role, text): the rows that ``audits`` (conv, audit) leaves or adds, counted from 0.

    Partitions hold whole conversations in order.
    """
    rows = _plain(turns).withColumn("kind", F.lit(1))
    first = audits.select("conv", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
                          F.col("audit").alias("text"), F.lit("").alias("mark"), F.lit(0).alias("kind"))
    ordered = first.unionByName(rows).repartition("conv").sortWithinPartitions(
        "conv", "kind", F.asc_nulls_first("turn"), "role", "mark")
    return ordered.select("conv", "kind", "role", "text").mapInPandas(_apply_edits, TURNS)


def repair_conversations(turns: DataFrame, conversations: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """What is wrong with each conversation, its cheapest repair and a digest of the repaired turns.

    One row per conv_id of ``conversations`` (of ``turns`` if that is not given);
    an id without turns has zeros, an empty audit and the digest of nothing.
    ``gaps`` counts the numbers missing between the least and largest turn.
    For ties, nulls and long conversations see ``find_repairs``.
    """
    kind = turns.schema["conv_id"].dataType
    found = staged(find_repairs(turns, held), "repairs")
    digests = repaired_turns(turns, found.select("conv", "audit")).mapInPandas(_digest, "conv string, repaired_sha256 string")
    turn = F.col("turn")
    gaps = turns.groupBy(F.col("conv_id").cast("string").alias("conv")).agg(
        (F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn)).cast("bigint").alias("gaps"))
    ids = (turns if conversations is None else conversations).select(F.col("conv_id").cast("string").alias("conv")).distinct()
    out = ids
    for facts in (found, gaps, digests):
        facts = facts.withColumnRenamed("conv", "f_conv")
        out = out.join(facts, F.col("conv").eqNullSafe(F.col("f_conv")), "left").drop("f_conv")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").cast(kind).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults put in by the crc32 of ``conv_id:turn``; nulls become one space."""
    def space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    text = F.when(fault == 1, "").when(fault == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = turns.filter(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")
