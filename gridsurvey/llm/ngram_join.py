"""Similarity join on word n-grams: MinHash banding, then exact Jaccard on the full sets.

1. Each text becomes its set of n-grams, a signature and its band hashes.
   Texts with equal sets form a class with one representative, so exact and
   reordered copies are never compared with each other.
2. A shuffle on band hashes links each representative to the smallest one in
   each of its buckets; the connected parts of that graph hold every pair that
   shares a bucket. So a bucket of any size costs one row per member.
3. The full sets meet in blocks of bounded size, by part or by bucket, whichever
   sends fewer sets: a dense group meets once as a part, a long chain of texts
   that resemble their neighbours only meets bucket by bucket, each pair judged
   in the least bucket that it shares. Every pair of blocks is one row and is
   checked as a matrix product. Only counts of links and a spanning forest
   leave the task, never all pairs of a group.
4. Connected components over the forests give the classes of near duplicates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components, forest, link_classes
from .words import Words, mixed, runs, word_table

WORDS_PER_GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 256
#: A block holds about so many sets, and fewer if they are large.
BLOCK_SETS, BLOCK_GRAMS = 64, 200_000
#: N-grams that are signed in one step, in an array that is kept.
_SIGNED_AT_ONCE = 512
_SEED = 11


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have so that pairs at the threshold share a band with the target recall."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes than allowed")
    return best


class Signer:
    """Signatures of n-gram sets by linear permutations of 32-bit hashes."""

    def __init__(self, bands: int, rows: int):
        random = np.random.default_rng(_SEED)
        self.bands, self.rows = bands, rows
        self.a = (random.integers(1, 1 << 31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.steps = random.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        self.room = np.empty((_SIGNED_AT_ONCE, bands * rows), np.uint32)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        short = (grams >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), _SIGNED_AT_ONCE):
            some = short[at : at + _SIGNED_AT_ONCE, None]
            part = np.multiply(self.a, some, out=self.room[: len(some)])
            part += self.b
            np.minimum(least, part.min(axis=0), out=least)
        return least

    def band_hashes(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of band hashes for each set."""
        signed = np.array([self.signature(s) for s in sets], np.uint64).reshape(len(sets), self.bands, self.rows)
        signed *= self.steps
        return mixed(signed.sum(axis=2) + self.salts).view(np.int64)


def _different(grams: np.ndarray) -> np.ndarray:
    """The different values in ascending order."""
    grams = np.sort(grams)
    again = grams[1:] == grams[:-1]
    return np.concatenate([grams[:1], grams[1:][~again]]) if again.any() else grams


def gram_sets(texts: Iterable[str | None], words: Words, n: int = WORDS_PER_GRAM) -> list[np.ndarray]:
    """Of each text, sorted hashes of the different n-grams; a text with fewer words is one n-gram, one without words has none."""
    sets = []
    for hashes, ends in words.hashes_of(texts):
        over_all = runs(hashes, n)  # those that reach from one text into the next are passed over
        first = 0
        for last in ends.tolist():
            whole = last - first >= n
            sets.append(_different(over_all[first : last - n + 1] if whole else runs(hashes[first:last], n)))
            first = last
    return sets


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, bands: int, rows: int, n: int = WORDS_PER_GRAM) -> DataFrame:
    """(doc_id, node, n_grams, bands): ``node`` names the text's set; null where the text has no word or the id is null."""
    table = docs.sparkSession.sparkContext.broadcast(word_table())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer = Words(table.value), Signer(bands, rows)
        for batch in batches:
            sets = gram_sets((t.as_py() for t in batch.column("text")), words, n)
            none = np.array([not len(s) for s in sets], bool)
            hashes = signer.band_hashes([s for s in sets if len(s)])
            ends = np.concatenate([[0], np.cumsum(~none) * bands]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(none, False)), pa.array(hashes.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), held],
                ["doc_id", "node", "n_grams", "bands"])

    found = docs.mapInArrow(sign, f"doc_id {dict(docs.dtypes)['doc_id']}, node binary, n_grams bigint, bands array<bigint>")
    return found.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node")))


def linked(left: list, right: list | None, threshold: float) -> np.ndarray:
    """Whether each two sets reach the threshold, by the sizes of their exact intersections."""
    members = left + (right or [])
    grams = np.concatenate(members)
    _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    shared = times[at] > 1
    columns = np.unique(at[shared], return_inverse=True)[1]
    inside = np.zeros((len(members), int(columns.max()) + 1 if len(columns) else 1), np.float32)
    inside[owner[shared], columns] = 1
    sizes = np.array([len(m) for m in members], float)
    a, b = (slice(0, len(left)), slice(len(left), None)) if right else (slice(None), slice(None))
    common = (inside[a] @ inside[b].T).astype(float)
    out = common / (sizes[a][:, None] + sizes[b][None, :] - common) >= threshold
    if not right:
        np.fill_diagonal(out, False)
    return out


def _to_judge(bands: list[list[int] | None], first: int | None, band: int | None) -> np.ndarray:
    """Which two members a row judges: of two blocks, ``first`` in the one, only those across; of a bucket, those that share no lesser one."""
    todo = ~np.eye(len(bands), dtype=bool)
    if first is not None:
        todo[:first, :first] = todo[first:, first:] = False
    if band is not None:
        lesser = [[b for b in own if b < band] for own in bands]
        columns = {b: at for at, b in enumerate({b for own in lesser for b in own})}
        inside = np.zeros((len(bands), len(columns)), np.float32)
        for i, own in enumerate(lesser):
            inside[i, [columns[b] for b in own]] = 1
        todo &= inside @ inside.T == 0
    return todo


def _check_blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per member of a row of one or two blocks: documents linked across the row, and a member it is connected to."""
    for batch in batches:
        nodes, n_links, roots = [], [], []
        for at in range(batch.num_rows):  # one row in Python objects at a time
            parts = batch.column(0)[at].as_py()
            members = [m for p in parts for m in p]
            first = len(parts[0]) if len(parts) == 2 else None
            todo = _to_judge([m["bands"] for m in members], first, batch.column(1)[at].as_py())
            some = todo.any(axis=1)
            if not some.any():
                continue
            members, todo = [m for m, s in zip(members, some, strict=True) if s], todo[np.ix_(some, some)]
            sets = [np.frombuffer(m["grams"], np.uint64) for m in members]
            if first is None:
                links = linked(sets, None, threshold)
            else:
                first = int(some[:first].sum())
                links = np.zeros((len(members), len(members)), bool)
                links[:first, first:] = linked(sets[:first], sets[first:], threshold)
                links |= links.T
            links &= todo
            counts = links @ np.array([m["weight"] for m in members], np.int64)
            label = forest(links)
            for i in np.flatnonzero(counts):
                nodes.append(members[i]["node"])
                n_links.append(int(counts[i]))
                roots.append(members[label[i]]["node"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(n_links, pa.int64()), pa.array(roots, pa.binary())], ["node", "n_links", "root"])


def _blocks(grams: Column, block_sets: int, block_grams: int) -> Column:
    """Blocks that the sets of a group take, never more than sets."""
    sets = F.count("*")
    return F.least(sets, F.greatest(F.ceil(sets / block_sets), F.ceil(F.sum(grams) / block_grams))).cast("int")


def _places(near: DataFrame, leads: DataFrame, parts: DataFrame, block_sets: int, block_grams: int) -> DataFrame:
    """(node, first_id, weight, units): the groups in which each set meets others.

    A part of b blocks sends each of its sets to b rows. If its buckets, of b blocks each by
    the same rule, send fewer in all, its sets meet in these.
    """
    own = parts.groupBy("part").agg(F.count("*").alias("n"), _blocks(F.col("n_grams"), block_sets, block_grams).alias("n_blocks"))
    by_bucket = leads.join(parts.select(F.col("node").alias("lead"), "part"), "lead").groupBy("part").agg(
        F.sum(F.col("c") * F.col("n_blocks")).alias("sent"))
    sizes = staged(own.join(by_bucket, "part").select(
        "part", "n_blocks", ((F.col("n_blocks") > 1) & (F.col("sent") < F.col("n") * F.col("n_blocks"))).alias("by_bucket")), "part_sizes")
    placed = parts.join(sizes, "part")
    whole = placed.filter("not by_bucket").select(
        "node", "first_id", "weight", F.array(F.struct("part", "n_blocks", F.lit(None).cast("bigint").alias("band"))).alias("units"))
    # Eight bytes name a bucket and sixteen a part, so they never meet.
    bucket = F.struct(F.unhex(F.lpad(F.hex("band"), 16, "0")).alias("part"), "n_blocks", "band")
    dealt = near.select(F.col("a").alias("node"), bucket.alias("unit")).join(
        placed.filter("by_bucket").select("node", "first_id", "weight"), "node")
    return whole.union(dealt.groupBy("node", "first_id", "weight").agg(F.collect_list("unit").alias("units")))


def _units(members: DataFrame) -> DataFrame:
    """Rows of one block, or of two blocks of the same part or bucket: every two members meet in one row.

    Of b blocks, each is sent to b rows. Blocks are dealt by a hash and may be empty; a block that
    meets an empty one makes no row.
    """
    blocks = members.groupBy("part", "n_blocks", "band", "block").agg(
        F.collect_list(F.struct("node", "weight", "grams", "bands")).alias("members"))
    single = blocks.filter("n_blocks = 1").select(F.array("members").alias("parts"), "band")
    several = blocks.filter("n_blocks > 1").withColumn(
        "other", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))))
    paired = several.groupBy("part", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(
        F.collect_list("members").alias("parts")).filter("i = j or size(parts) = 2")
    return single.union(paired.select("parts", "band"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS_PER_GRAM,
                    threshold: float = THRESHOLD, recall: float = RECALL,
                    block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, class_id, n_links, kept), one row per row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of
    ``n`` lower-case words reaches ``threshold``; a text with fewer words is
    one n-gram. ``n_links`` counts the rows linked directly, ``class_id`` is the
    smallest id that links reach, ``kept`` marks it. Pairs at the threshold are
    found with at least the ``recall``, closer ones with more; no pair below it
    is linked. A null or wordless text and a row with a null id are linked
    with nothing and stay. Repeated rows are copies of each other. Other
    columns are not looked at; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bands, rows = choose_bands(threshold, recall)
    signed = staged(signatures(docs, bands, rows, n), "signatures")
    sets = staged(
        signed.filter("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("weight"), F.first("n_grams").alias("n_grams"),
            F.first("bands").alias("bands")), "sets")

    banded = sets.select("node", "n_grams", F.explode("bands").alias("band"))
    leads = staged(
        banded.groupBy("band").agg(
            F.min("node").alias("lead"), F.count("*").alias("c"),
            _blocks(F.col("n_grams"), block_sets, block_grams).alias("n_blocks")).filter("c > 1"), "leads")
    near = staged(banded.join(leads, "band").select(F.col("node").alias("a"), F.col("lead").alias("b"), "band", "n_blocks"), "near")
    parts = staged(
        connected_components(near, "candidates").select("node", F.col("component").alias("part"))
        .join(sets.drop("bands"), "node"), "parts")
    placed = _places(near, leads, parts, block_sets, block_grams)

    table = docs.sparkSession.sparkContext.broadcast(word_table())
    shape = "node binary, weight bigint, units array<struct<part:binary,n_blocks:int,band:bigint>>"

    def with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(table.value)
        for batch in batches:
            node, weight, units, texts = batch.columns
            grams = gram_sets((t.as_py() for t in texts), words, n)
            same = pa.array([set_key(g) == k for g, k in zip(grams, node.to_pylist(), strict=True)], pa.bool_())
            held = pa.array([g.tobytes() for g in grams], pa.binary())
            yield pa.RecordBatch.from_arrays([node, weight, units, held], ["node", "weight", "units", "grams"]).filter(same)

    # The text of one row of each set, whatever else carries its id.
    texts = docs.join(placed.withColumnRenamed("first_id", "doc_id"), "doc_id").select("node", "weight", "units", "text")
    met = texts.mapInArrow(with_grams, f"{shape}, grams binary").select(
        "node", "weight", "grams", F.col("units.band").alias("all_bands"), F.explode("units").alias("unit"))
    members = met.select(
        "unit.*", F.pmod(F.xxhash64("node"), "unit.n_blocks").cast("int").alias("block"), "node", "weight", "grams",
        F.when(F.col("unit.band").isNotNull(), F.col("all_bands")).alias("bands")).dropDuplicates(["part", "n_blocks", "block", "node"])
    checked = staged(
        _units(members).mapInArrow(lambda it: _check_blocks(it, threshold), "node binary, n_links bigint, root binary"), "links")

    return link_classes(signed.select("doc_id", "node"), sets, checked)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document per class, with all their columns; of rows repeated with their id, one."""
    kept = near_duplicates(docs, id_col, text_col, **options).filter("kept").select(F.col("doc_id").alias("__kept"))
    own = docs.withColumn("__text", F.sha2(F.col(text_col), 256))
    stay = own.join(kept, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi")
    return stay.dropDuplicates([id_col, "__text"]).select(*docs.columns)
