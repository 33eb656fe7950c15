"""Prefix trie of conversations, packed into double-array tries of bounded prefix shards.

A stream over rows sorted by group of conversations rebuilds each one and names
every prefix by a chained 128-bit digest. What only one conversation has after
its last shared prefix is its tail and needs no trie. The shared parts, one row
per different sequence, are dealt to shards by a prefix that is lengthened until
no shard is crowded. Each shard numbers its turns densely, packs its subtries
into BASE and CHECK arrays and walks them for the members, children, leaves and
savings of every node. Nodes above the shard prefixes are merged by digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rows with different sequences under one prefix before the prefix is lengthened, and turns in one shard.
CROWDED = 50_000
SHARD_TURNS = 500_000
#: Conversation ids joined in one step of a digest of ids.
ID_RANGE = 1024
#: Places looked at together for a base.
BLOCK = 256

ROOT = b"\x00" * 16
REBUILT = "conv_id bigint, depth bigint, key binary, chars bigint, node binary, parent binary, last boolean"
NODES = ("node binary, parent binary, depth bigint, upper boolean, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved bigint, chars bigint, above array<binary>")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _rebuild(group: int, schema: pa.Schema):
    """Rows of each group come with its head conversation first; a conversation's rows come in order."""

    def run(batches):
        import zlib

        head, base, conv, waiting = [], None, None, None
        columns = [[] for _ in schema.names]

        def put(row):
            for column, value in zip(columns, row):
                column.append(value)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
            for c in columns:
                c.clear()
            return batch

        for batch in batches:
            for c, key, chars in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "key", "chars"))):
                if c != conv or waiting is None:
                    if waiting is not None:
                        put((*waiting, True))
                    own_base = c - (abs(c) % group) * (1 if c >= 0 else -1)
                    if own_base != base:
                        base, head = own_base, []
                    conv, place, cut = c, 0, zlib.crc32(str(c).encode()) % 6
                    waiting = (c, 0, None, 0, ROOT, None)
                    for k, n in head[:cut] if c != base else ():
                        put((*waiting, False))
                        waiting = (c, waiting[1] + 1, k, n, hashlib.blake2b(waiting[4] + k, digest_size=16).digest(), waiting[4])
                if c == base and place < 5:
                    head.append((key, chars))
                if c == base or place >= cut:
                    put((*waiting, False))
                    waiting = (c, waiting[1] + 1, key, chars, hashlib.blake2b(waiting[4] + key, digest_size=16).digest(), waiting[4])
                place += 1
            yield flush()
        if waiting is not None:
            put((*waiting, True))
            yield flush()

    return run


def rebuilt(turns: DataFrame, group: int = 100) -> DataFrame:
    """One row per prefix of each rebuilt conversation: its depth, the digest of its last turn, its own and its parent's name.

    Rows go by turn, null turns first, then by the digest of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("bigint")
    keyed = turns.filter(conv.isNotNull()).select(
        conv.alias("conv_id"), "turn", (conv - conv % group).alias("base"),
        F.unhex(F.left(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32))).alias("key"),
        F.char_length(text).cast("bigint").alias("chars"))
    ordered = keyed.repartition("base").sortWithinPartitions(
        "base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "key")
    return ordered.select("conv_id", "key", "chars").mapInArrow(_rebuild(group, _arrow(REBUILT)), REBUILT)


class DoubleArray:
    """A trie in two arrays: the child of state s by code c is t = BASE[s] + c if CHECK[t] = s."""

    def __init__(self, size: int):
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.check[0] = 0
        self.free = 1

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def place(self, state: int, codes: np.ndarray) -> None:
        """Give ``state`` children by its ascending ``codes``, at the first base where all their places are free."""
        moved, at = codes - codes[0], self.free
        while True:
            self._grow(at + BLOCK + int(moved[-1]))
            fits = at + np.flatnonzero(self.check[at:at + BLOCK] < 0)
            for step in moved[1:]:
                if not len(fits):
                    break
                fits = fits[self.check[fits + step] < 0]
            if len(fits):
                break
            at += BLOCK
        self.base[state] = fits[0] - codes[0]
        self.check[fits[0] + moved] = state
        while self.free < len(self.check) and self.check[self.free] >= 0:
            self.free += 1

    def child(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after one more code from each state; every sequence that was put in is found."""
        found = self.base[states] + codes
        if not (self.check[found] == states).all():
            raise AssertionError("a stored sequence is not in the trie")
        return found


def pack(codes: np.ndarray, starts: np.ndarray) -> DoubleArray:
    """A double array of the sequences codes[starts[i]:starts[i + 1]], level by level."""
    lengths = np.diff(starts)
    trie = DoubleArray(2 * len(codes) + int(codes.max(initial=0)) + 2)
    live = np.flatnonzero(lengths > 0)
    state, depth = np.zeros(len(lengths), np.int64), 0
    while len(live):
        own = codes[starts[live] + depth]
        order = np.lexsort((own, state[live]))
        s, c = state[live][order], own[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        s1, c1 = s[new], c[new]
        edges = np.flatnonzero(np.diff(s1, prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(s1)]):
            trie.place(int(s1[lo]), c1[lo:hi])
        depth += 1
        state[live] = trie.child(state[live], own)
        live = live[lengths[live] > depth]
    return trie


def _walk(schema: pa.Schema):
    """Nodes of the subtries of one shard, from rows of different sequences."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        keys = [k for path in rows["keys"] for k in path]
        lengths = np.array([len(p) for p in rows["keys"]], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        codes = pd.factorize(np.array([*keys, b""], object))[0][:-1].astype(np.int64)  # the dense turn ids of this shard
        trie = pack(codes, starts)
        size = len(trie.base)
        n, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
        chars, cut, depth_of = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size, np.int64)
        going = np.zeros(size, bool)
        first = np.full(size, -1, np.int64)
        here, low = np.array(rows["n_here"], np.int64), np.array(rows["conv_id"], np.int64)
        cuts, more = np.array(rows["cut"], np.int64), np.array(rows["continues"], bool)
        flat = np.array([c for path in rows["chars"] for c in path], np.int64)
        state, live, depth, levels = np.zeros(len(lengths), np.int64), np.arange(len(lengths)), 0, []
        while len(live):
            at = state[live]
            np.add.at(n, at, here[live])
            np.minimum.at(least, at, low[live])
            first[at] = live
            depth_of[at] = depth
            cut[at] |= depth < cuts[live]
            if depth:
                chars[at] = flat[starts[live] + depth - 1]
            ends = live[lengths[live] == depth]
            going[state[ends]] |= more[ends]
            levels.append(np.unique(at))
            live = live[lengths[live] > depth]
            state[live] = trie.child(state[live], codes[starts[live] + depth])
            depth += 1
        children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for level in reversed(levels):
            own = ~cut[level]
            children[level] += going[level]  # its only child is the tail of the only conversation that goes on
            leaves[level] += own & ((children[level] == 0) | going[level])
            saved[level] += np.where(own, (n[level] - 1) * chars[level], 0)
            inner = level[level > 0]
            up = trie.check[inner]
            np.add.at(children, up, 1)
            np.add.at(leaves, up, leaves[inner])
            np.add.at(saved, up, saved[inner])
        out = np.concatenate(levels)
        names = [rows["nodes"][first[s]] for s in out]
        depths = depth_of[out]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip([
            [ns[d] for ns, d in zip(names, depths)],
            [ns[d - 1] if d else None for ns, d in zip(names, depths)],
            depths, cut[out], least[out], [None if s == 0 or cut[trie.check[s]] else int(least[trie.check[s]]) for s in out],
            n[out], np.where(cut, going, children)[out], leaves[out], saved[out], chars[out],
            [ns[:d] if u else [] for ns, d, u in zip(names, depths, cut[out])]], schema.types)], schema=schema)

    return run


def _ids_digest(batches):
    node, sha, open_ = None, None, False
    for batch in batches:
        out = []
        for own, ids in zip(batch["node"], batch["ids"]):
            if not open_ or own != node:
                if open_:
                    out.append((node, sha.hexdigest()))
                open_, node, sha = True, own, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if open_:
        yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])


def _with_prefixes(sequences: DataFrame, crowded: int) -> DataFrame:
    """``sequences`` with the length ``cut`` of the prefix that names their shard, doubled where too many share one."""
    length = F.size("keys")
    out = sequences.withColumn("cut", F.lit(1))
    while True:
        prefix = F.get("nodes", F.least(F.col("cut"), length))
        open_ = out.filter(length >= F.col("cut"))
        full = open_.groupBy(prefix.alias("full")).agg(F.count("*").alias("n")).filter(F.col("n") > crowded).drop("n")
        full = staged(full, "crowded")
        if not full.take(1):
            return out.withColumn("prefix", prefix)
        longer = out.join(full, prefix == F.col("full"), "left")
        out = staged(longer.withColumn("cut", F.when(F.col("full").isNull() | (length < F.col("cut")), F.col("cut"))
                                       .otherwise(F.col("cut") * 2)).drop("full"), "prefixes")


def conversation_trie(turns: DataFrame, group: int = 100, crowded: int = CROWDED, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``turns`` has conv_id (an integer), turn, role and text; other columns are
    not looked at. A conversation begins with up to five turns of the first one
    of its ``group``. Null roles and texts are empty, equal turns of a
    conversation stay apart, ties go by a digest of role and text, and rows
    without a conv_id belong to no conversation. An empty table has no root.
    Turns are told apart by 128 bits of a SHA-256 of role and text, prefixes by
    a chain of those. A task holds no more than the shared part of one sequence
    or one shard; the part of a conversation that no other shares is streamed.
    """
    rows = staged(rebuilt(turns, group), "rebuilt")
    shared = staged(rows.filter("depth > 0").groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"), "shared")
    # A tail begins after the first prefix that a conversation has for itself.
    known = shared.select(F.col("node").alias("known"))
    deep = rows.filter("depth > 1").join(known, F.col("parent") == F.col("known"), "left").withColumn("in_trie", F.col("known").isNotNull())
    told = staged(rows.filter("depth <= 1").withColumn("in_trie", F.lit(True)).unionByName(deep.drop("known")).drop("parent"), "told")

    # Equal sequences come together before their paths are gathered: the name of the end tells the whole path.
    ends = told.filter("in_trie").groupBy("conv_id").agg(F.max(F.struct("depth", "node", "last")).alias("end"))
    tallies = ends.groupBy("end.node").agg(
        F.count("*").alias("n_here"), F.min("conv_id").alias("of"), F.max(~F.col("end.last")).alias("continues")).drop("node")
    paths = told.filter("in_trie").join(tallies, F.col("conv_id") == F.col("of")).groupBy("conv_id", "n_here", "continues").agg(
        F.sort_array(F.collect_list(F.struct("depth", "node", "key", "chars"))).alias("path"))
    turns_of = F.filter("path", lambda x: x["depth"] > 0)
    sequences = staged(paths.select(
        "conv_id", "n_here", "continues", turns_of["key"].alias("keys"), turns_of["chars"].alias("chars"), F.col("path.node").alias("nodes")),
        "sequences")
    cut = staged(_with_prefixes(sequences, crowded), "cut_sequences")

    n_turns = cut.agg(F.sum(F.size("nodes"))).first()[0] or 0
    shards = int(n_turns // shard_turns) + 1
    # Sequences that end above their prefix have a shard of their own among the others.
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("prefix"), F.lit(shards)))
    nodes = staged(dealt.groupBy("shard").applyInArrow(_walk(_arrow(NODES)), NODES), "trie_nodes")
    return _merged(nodes, told)


def _merged(nodes: DataFrame, told: DataFrame) -> DataFrame:
    """The result: nodes above the shard prefixes merged, tails and digests of the conversations that end at each node added."""
    upper = staged(nodes.filter("upper").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"),
        F.sum("n_children").alias("n_tails"), F.first("chars").alias("chars"), F.first("above").alias("above")), "upper_nodes")
    lower = nodes.filter("not upper")
    tops = lower.filter("parent_conv_id IS NULL AND parent IS NOT NULL").select("parent").unionAll(upper.filter("parent IS NOT NULL").select("parent"))
    children = tops.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "c_node")
    counted = staged(upper.join(children, F.col("node") == F.col("c_node"), "left").drop("c_node").fillna(0, ["n_children"]), "counted_upper")
    own = counted.select(
        F.explode(F.concat("above", F.array("node"))).alias("a_node"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saving"))
    sums = own.groupBy("a_node").agg(F.sum("leaf").alias("leaves"), F.sum("saving").alias("savings"))
    names = upper.select(F.col("node").alias("p_node"), F.col("conv_id").alias("p_conv"))
    whole = counted.join(sums, F.col("node") == F.col("a_node")).join(names, F.col("parent") == F.col("p_node"), "left").select(
        "node", "conv_id", "depth", F.col("p_conv").alias("parent_conv_id"), "n_convs", (F.col("n_children") + F.col("n_tails")).alias("n_children"),
        (F.col("below_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("below_saved") + F.col("savings")).alias("saved_tokens"))
    rest = lower.join(names, F.col("parent_conv_id").isNull() & (F.col("parent") == F.col("p_node")), "left").select(
        "node", "conv_id", "depth", F.coalesce("parent_conv_id", "p_conv").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"))

    # A third of all conversations may end at one node: ids are joined in ranges first, which go into the digest one by one.
    ended = told.filter("last AND in_trie").groupBy("node", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    digests = ended.repartition("node").sortWithinPartitions("node", "range").select("node", "ids").mapInPandas(
        _ids_digest, "node binary, ends_sha256 string").withColumnRenamed("node", "e_node")
    nothing = F.sha2(F.lit(""), 256)
    trie = whole.unionByName(rest).join(digests, F.col("node") == F.col("e_node"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    one, zero = (F.lit(k).cast("bigint") for k in (1, 0))
    tails = told.filter("not in_trie").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return trie.unionByName(tails)
