"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Rows are spread over shards of bounded size by a hash, whatever their source or
cluster, and each shard is packed by itself: longest documents first, each into
the bin with the least room that still takes it. Bins are ordered by room and
carry bitmaps of the sources and duplicate clusters they hold; from the
tightest bin on, the search goes to the next until one has neither.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .common import staged

CAPACITY = 2048
SHARD_DOCUMENTS = 4096


def best_fit(rows: list[tuple], capacity: int) -> list[tuple]:
    """(row number, piece, start, length, bin, offset) for ``rows`` of (length, source, cluster), in an order to be kept.

    A row longer than a bin fills bins of its own; what is left of it is
    packed like a short row. Sources and clusters that are None conflict with nothing.
    """
    out, rest = [], []
    n_bins = 0
    for number, (length, source, cluster) in enumerate(rows):
        full, left = divmod(length, capacity)
        for piece in range(full):
            out.append((number, piece, piece * capacity, capacity, n_bins, 0))
            n_bins += 1
        if left:
            rest.append((number, full, full * capacity, left, source, cluster))
    rest.sort(key=lambda r: -r[3])  # stable: ties keep the order of rows
    bits: dict[tuple, int] = {}
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    holds: dict[int, int] = {}
    for number, piece, start, length, source, cluster in rest:
        own = 0
        for name in (("source", source), ("cluster", cluster)):
            if name[1] is not None:
                own |= bits.setdefault(name, 1 << len(bits))
        at = bisect_left(room, (length, -1))
        while at < len(room) and holds[room[at][1]] & own:
            at += 1
        if at < len(room):
            left, bin_ = room.pop(at)
        else:
            left, bin_ = capacity, n_bins
            n_bins += 1
            holds[bin_] = 0
        holds[bin_] |= own
        out.append((number, piece, start, length, bin_, capacity - left))
        if left > length:
            insort(room, (left - length, bin_))
    return out


def pack(docs: DataFrame, length: Column, source: Column, cluster: Column, id_col: str = "doc_id",
         capacity: int = CAPACITY, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, at): where each piece of each row of ``docs`` lies.

    No bin holds more than ``capacity``, two documents of one source or two of
    one cluster. A null or zero length gives one row without a bin. A null
    source or cluster conflicts with nothing; repeated rows are documents of
    their own. ``cluster`` may be any hash: equal hashes of different texts only
    keep them apart. Only ids, lengths, sources and clusters are moved.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("bigint").alias("length"),
        source.cast("string").alias("source"), cluster.cast("bigint").alias("cluster"))
    shards = max(1, math.ceil(docs.select(id_col).count() / shard_documents))
    spread = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "length"), F.lit(shards)))
    kind = dict(rows.dtypes)["doc_id"]

    def pack_shard(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        filled = shard[shard["length"] > 0].sort_values(["doc_id", "cluster", "source"], kind="stable", na_position="first")
        facts = [
            (int(n), None if pd.isna(s) else s, None if pd.isna(c) else int(c))
            for n, s, c in zip(filled["length"], filled["source"], filled["cluster"], strict=True)]
        placed = pd.DataFrame(best_fit(facts, capacity), columns=["row", "piece", "start", "length", "bin_id", "at"])
        placed["bin_id"] += key[0] << 32
        placed["doc_id"] = filled["doc_id"].to_numpy()[placed["row"]]
        return placed.drop(columns="row")

    schema = f"doc_id {kind}, piece bigint, start bigint, length bigint, bin_id bigint, at bigint"
    packed = spread.filter("length > 0").groupBy("shard").applyInPandas(pack_shard, schema)
    zero = F.lit(0).cast("bigint")
    empty = rows.filter("length = 0").select(
        "doc_id", zero.alias("piece"), zero.alias("start"), "length",
        F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("bigint").alias("at"))
    return packed.unionByName(empty)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def _facts(docs: DataFrame, key: Column) -> DataFrame:
    """(doc_id, key, length, source, same): words of each text, and a hash of it that the case of A to Z does not change."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
            # Bytes are split and lowered by their ASCII letters and blanks only, as ``\S`` and ``translate`` do.
            length = [None if t is None else len(t.split()) for t in texts]
            same = [None if t is None else int.from_bytes(blake2b(t.lower(), digest_size=8).digest(), "little", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(length, pa.int64()), batch.column("source"), pa.array(same, pa.int64())],
                ["doc_id", "key", "length", "source", "same"])

    rows = docs.select("doc_id", key.alias("key"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, key string, length bigint, source string, same bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` for a table of documents without near copies: lengths in words, equal texts as clusters."""
    return pack(docs, word_count(F.col("text")), F.col("source"), F.xxhash64("text"), capacity=capacity)


def pack_near_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` for any table of documents: lengths in words, classes of near duplicates as clusters.

    A text that is linked with no other, as one without words, is in a cluster
    with those equal to it but for the case of A to Z. A null id and an id that
    several texts carry are told apart by the text.
    """
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64("text")))
    near = ngram_join.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key")
    classes = near.filter("n_links > 0").select(F.col("doc_id").alias("key"), F.xxhash64("class_id").alias("class")).distinct()
    clustered = staged(_facts(docs, key).join(classes, "key", "left").select(
        "doc_id", "length", "source", F.coalesce("class", "same").alias("cluster")), "clusters")
    return pack(clustered, F.col("length"), F.col("source"), F.col("cluster"), capacity=capacity)
