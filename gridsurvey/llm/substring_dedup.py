"""Removal of repeated passages by suffix trees of bounded groups of suffixes.

Only the first ``window`` words of a suffix matter. The suffixes are split by
a prefix of variable length: first by their anchor, the least of the short word
grams in those words, which neighbouring suffixes share, so that they travel as
one run of text; where an anchor is crowded, by all their words. A suffix whose
anchor occurs nowhere else is a leaf of the whole tree and needs no group. In
each group, which fits into a task's memory, the suffixes are sorted by prefix
doubling, the lengths they have in common with their neighbours give the inner
nodes, and the leaves under a node at least ``window`` words deep are the places
of one repeat; all but the first of them go. Crowded anchors are cut into parts;
each part's first places meet again in a second tree by their whole prefix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .words import mixed, runs

WINDOW = 20
#: Words of an anchor; fewer make longer runs, more make anchors rarer.
ANCHOR = 6
#: Suffixes in one group, and in one run.
GROUP = 1 << 18
LONGEST_RUN = 4096

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


class Tokens:
    """Where the words of UTF-8 texts lie and their 64-bit hashes, on whole arrays."""

    def __init__(self):
        self.space = np.zeros(256, bool)
        self.space[list(_SPACES)] = True
        self.value = mixed(np.arange(1, 257, dtype=np.uint64))
        self.value[self.space] = 0
        self._grow(_BLOCK)

    def _grow(self, size: int) -> None:
        def powers(base: int) -> np.ndarray:
            out = np.full(size + 1, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.up, self.down = powers(_BASE), powers(_INVERSE)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all texts, word starts, word ends, the text each word is in, word hashes)."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        low = int(offsets[0]) if len(offsets) else 0
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low:int(offsets[-1]) if len(offsets) else 0]
        offsets = offsets - low
        if not len(data):
            none = np.zeros(0, np.int64)
            return data, none, none, none, np.zeros(0, np.uint64)
        inside = ~self.space[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        starts[cuts] |= inside[cuts]
        ends[cuts - 1] |= inside[cuts - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        doc = np.searchsorted(offsets, starts, side="right") - 1
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
            part = data[starts[at]:ends[to - 1]]
            if len(part) >= len(self.up):
                self._grow(2 * len(part))
            moved = starts[at:to] - starts[at]
            sums = np.add.reduceat(self.value[part] * self.up[:len(part)], moved)
            hashes[at:to] = mixed(sums * self.down[moved])
            at = to
        return data, starts, ends, doc, hashes


def suffix_runs(doc: np.ndarray, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(first suffix, suffixes, anchor, 2 if the anchor occurs in it again else 1) of each run.

    Suffixes are counted by their first word; those shorter than ``window`` are none.
    """
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none.astype(np.uint64), none
    grams = runs(hashes, anchor)
    span = window - anchor + 1
    least, done = grams, 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    starts = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1:])
    if not len(starts):
        return none, none, none.astype(np.uint64), none
    value = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (value[1:] != value[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])
    heads = np.flatnonzero(new)
    inner = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
    heads = np.flatnonzero(inner % LONGEST_RUN == 0)
    near = np.zeros(len(grams) + 1, np.int64)
    for d in range(1, min(span, len(grams) - 1) + 1):
        near[1:len(grams) - d + 1] |= grams[:-d] == grams[d:]
    near = np.cumsum(near)
    n = np.diff(np.append(heads, len(starts)))
    lo = starts[heads]
    again = near[np.minimum(lo + n - 1 + span, len(grams))] > near[lo]
    return lo, n, value[heads], 1 + again.astype(np.int64)


def _chunks(texts: pa.Array, size: int = 4 << 20):
    """Slices of ``texts`` of about ``size`` bytes, or of one text."""
    total = np.cumsum(np.asarray(texts.cast(pa.large_binary()).fill_null(b"").value_lengths() if hasattr(texts, "value_lengths")
                                 else [len(x.as_py() or "") for x in texts], np.int64)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def _find_runs(window: int, anchor: int, names: list[str]):
    def run(batches):
        tokens = Tokens()
        for batch in batches:
            for at, texts in _chunks(batch.column("text")):
                _, _, _, doc, hashes = tokens.of(texts)
                lo, n, value, again = suffix_runs(doc, hashes, window, anchor)
                rows = pa.array(doc[lo] + at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(value.view(np.int64)), batch.column("doc_id").take(rows), batch.column("version").take(rows),
                    pa.array(n), pa.array(again)], names=names)

    return run


def _cut_runs(window: int, anchor: int, buckets: int, names: list[str]):
    """Runs of text whose anchors occur elsewhere, with the group they go to."""

    def run(batches):
        tokens = Tokens()
        for batch in batches:
            live = batch.column("live").flatten()
            anchors = np.asarray(live.field("anchor")).view(np.uint64)
            parts = np.asarray(live.field("parts"))
            anchors, first = np.unique(anchors, return_index=True)
            parts = parts[first]
            for at, texts in _chunks(batch.column("text")):
                data, starts, ends, doc, hashes = tokens.of(texts)
                lo, n, value, _ = suffix_runs(doc, hashes, window, anchor)
                found = np.minimum(np.searchsorted(anchors, value), max(0, len(anchors) - 1))
                use = np.flatnonzero(anchors[found] == value) if len(anchors) else np.zeros(0, np.int64)
                lo, n, value, part = lo[use], n[use], value[use], parts[found[use]] if len(use) else np.zeros(0, np.int64)
                version = np.asarray(batch.column("version")).view(np.uint64)[doc[lo] + at]
                word = lo - np.searchsorted(doc, doc[lo])
                salt = mixed(version + word.astype(np.uint64)) % np.maximum(part, 1).astype(np.uint64)
                bucket = (mixed(value + mixed(salt)) % np.uint64(buckets)).astype(np.int64)
                rows = pa.array(doc[lo] + at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket), batch.column("doc_id").take(rows), batch.column("version").take(rows), pa.array(word),
                    pa.array(word), pa.array(part > 1), _slices(data, starts[lo], ends[lo + n - 1 + window - 1])], names=names)

    return run


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())


def _paired(rank: np.ndarray, far: np.ndarray, step: int, run: np.ndarray) -> np.ndarray:
    """The rank of each suffix by twice as many words: its own rank, then that of the suffix ``step`` words on, 0 past the run."""
    right = np.zeros(len(rank), np.int64)
    right[:-step] = np.where(run[step:] == run[:-step], far[step:], 0) if step < len(rank) else 0
    return np.unique(rank * (far.max(initial=0) + 1) + right, return_inverse=True)[1].astype(np.int64) + 1


def deep_nodes(run: np.ndarray, words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of the tree's leaves, the node at least ``window`` deep that each is under).

    ``run`` and ``words`` give the run and the hash of each word, ``starts`` the
    suffixes. A leaf that is under no such node is in one of its own.
    """
    ranks = {1: np.unique(words, return_inverse=True)[1].astype(np.int64) + 1}
    size = 1
    while 2 * size <= window:
        ranks[2 * size] = _paired(ranks[size], ranks[size], size, run)
        size *= 2
    whole, done = ranks[size], size
    for step in sorted((s for s in ranks if window & s and s < size), reverse=True):
        whole, done = _paired(whole, ranks[step], done, run), done + step
    order = starts[np.argsort(whole[starts], kind="stable")]
    # Words that neighbours in this order have in common, up to the window.
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for step in sorted(ranks, reverse=True):
        for _ in range(2 if step == max(ranks) else 1):
            i, j = a + common, b + common
            inside = (i < len(run)) & (j < len(run)) & (common + step <= window)
            i, j = np.where(inside, i, 0), np.where(inside, j, 0)
            same = inside & (run[i] == run[a]) & (run[j] == run[b]) & (ranks[step][i] == ranks[step][j])
            common += step * same
    node = np.zeros(len(order), np.int64)
    node[1:] = np.cumsum(common < window)
    return order, node


def _grow_trees(window: int, buckets: int, last: bool, schema: pa.Schema):
    """Later places of repeats in one group of runs: ranges of suffixes without a text.

    Crowded runs also give the places that are first in this group, with their text, for the second tree.
    """
    tokens = Tokens()

    def run(table: pa.Table) -> pa.Table:
        done = table.filter(table.column("text").is_null()).combine_chunks()
        table = table.filter(table.column("text").is_valid()).combine_chunks()
        texts = table.column("text")
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        data, begins, ends, run_of, words = tokens.of(texts)
        count = np.bincount(run_of, minlength=len(table))
        first = np.concatenate([[0], np.cumsum(count)])
        inside = np.arange(len(words)) - first[run_of]
        starts = np.flatnonzero(inside <= count[run_of] - window)
        if not len(starts):
            return done.select(schema.names).cast(schema)
        order, node = deep_nodes(run_of, words, starts, window)
        row = run_of[order]
        place = np.asarray(table.column("lo"))[row] + inside[order]
        ids = pd.factorize(table.column("doc_id").to_pandas(), sort=True)[0][row]  # -1, before all others, for null
        version = np.asarray(table.column("version"))[row]
        by = np.lexsort((place, version, ids, node))
        order, node, row, place, ids, version = (x[by] for x in (order, node, row, place, ids, version))
        new = np.ones(len(order), bool)
        new[1:] = node[1:] != node[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        later = (place != place[head]) | (version != version[head]) | (ids != ids[head])
        # Neighbouring later suffixes of a run make one range.
        gone = np.sort(order[later])
        cut = np.ones(len(gone), bool)
        cut[1:] = (np.diff(gone) != 1) | (run_of[gone[1:]] != run_of[gone[:-1]])
        lo, hi = gone[cut], gone[np.append(np.flatnonzero(cut)[1:] - 1, len(gone) - 1)] if len(gone) else gone
        at = run_of[lo]
        base = np.asarray(table.column("lo"))[at]
        out_version = np.asarray(table.column("version"))[at]
        bucket = (mixed(out_version.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        out = [[pa.array(bucket), table.column("doc_id").take(pa.array(at)), pa.array(out_version), pa.array(base + inside[lo]),
                pa.array(base + inside[hi]), pa.array(np.zeros(len(lo), bool)), pa.nulls(len(lo), pa.binary())]]
        if not last:
            crowded = np.asarray(table.column("crowded"))
            # The places that stand first, and equal places, which repeated rows have.
            stay = order[~later & crowded[row]]
            at = run_of[stay]
            word = np.asarray(table.column("lo"))[at] + inside[stay]
            whole = np.zeros(len(stay), np.uint64)
            for k in range(window):
                whole = mixed(whole + words[stay + k])
            out.append([pa.array((whole % np.uint64(buckets)).astype(np.int64)), table.column("doc_id").take(pa.array(at)),
                        table.column("version").take(pa.array(at)), pa.array(word), pa.array(word), pa.array(np.ones(len(stay), bool)),
                        _slices(data, begins[stay], ends[stay + window - 1])])
        tables = [pa.Table.from_arrays(x, names=schema.names).cast(schema) for x in out]
        return pa.concat_tables([done.select(schema.names).cast(schema), *tables])

    return run


def _keep_words(window: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone")):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if gone.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    spans = gone.values
                    np.add.at(edge, np.asarray(spans.field("lo")), 1)
                    np.add.at(edge, np.asarray(spans.field("hi")) + window, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())],
                schema=schema)

    return run


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                             anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, text), one row per row of ``docs``; the text is what is left, joined by single spaces.

    Words are stretches without space, tab, line feed and the like (U+0020,
    U+0009 to U+000D). A word goes if it lies in ``window`` consecutive words
    that also start earlier: in a smaller doc_id (null before all others) or
    earlier in the same text. Rows of one id with different texts go by a hash
    of the text; rows with equal id and text are one document and stay or change
    alike. A null text has no words. Other columns are not looked at. Words are
    compared by a 64-bit hash at each place of the window, so two windows are
    taken for equal by mistake only if words at one place collide and all others
    agree. A task holds one group of at most about ``group`` suffixes or one
    batch of texts; an anchor with more suffixes is cut into parts.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor has from one word to as many as the window")
    from pyspark.sql.pandas.types import to_arrow_schema

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    found_ddl = f"anchor bigint, doc_id {id_type}, version bigint, n bigint, again bigint"
    places = staged(base.mapInArrow(_find_runs(window, anchor, [c.split()[0] for c in found_ddl.split(", ")]), found_ddl), "suffix_runs")
    anchors = places.groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("again").alias("again")).filter("again > 1")
    anchors = staged(anchors.select("anchor", "n", F.ceil(F.col("n") / group).cast("bigint").alias("parts")), "anchors")
    total, most = anchors.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("parts"), F.lit(1))).first()
    buckets = int(total // group) + 1

    live = places.select("anchor", "doc_id", "version").join(anchors.select("anchor", "parts"), "anchor")
    live = live.groupBy(F.col("doc_id").alias("l_id"), F.col("version").alias("l_version")).agg(
        F.collect_set(F.struct("anchor", "parts")).alias("live"))
    with_live = base.join(live, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("version") == F.col("l_version"))).select(
        "doc_id", "version", "text", "live")
    run_ddl = f"bucket bigint, doc_id {id_type}, version bigint, lo bigint, hi bigint, crowded boolean, text binary"
    run_schema = to_arrow_schema(base.select(F.lit(0).cast("bigint").alias("bucket"), "doc_id", "version", F.lit(0).cast("bigint").alias("lo"),
                                             F.lit(0).cast("bigint").alias("hi"), F.lit(True).alias("crowded"), F.lit(b"").alias("text")).schema)
    run_schema = pa.schema([f.with_nullable(True) for f in run_schema])
    cut = with_live.mapInArrow(_cut_runs(window, anchor, buckets, run_schema.names), run_ddl)
    later = cut.groupBy("bucket").applyInArrow(_grow_trees(window, buckets, most <= 1, run_schema), run_ddl)
    if most > 1:
        later = later.groupBy("bucket").applyInArrow(_grow_trees(window, buckets, True, run_schema), run_ddl)
    gone = later.groupBy(F.col("doc_id").alias("g_id"), F.col("version").alias("g_version")).agg(
        F.collect_list(F.struct("lo", "hi")).alias("gone"))
    marked = base.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("version") == F.col("g_version")), "left").select(
        "doc_id", "text", "gone")
    out_ddl = f"doc_id {id_type}, n_words bigint, n_removed bigint, text string"
    out_schema = pa.schema([run_schema.field("doc_id"), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
    return marked.mapInArrow(_keep_words(window, out_schema), out_ddl)
