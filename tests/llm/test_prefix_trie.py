"""Tries against a plain version that keeps every prefix in a dictionary, and the query against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from check_oracle import compare, connect
from gridsurvey.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node int, depth string"


def plain(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, key[:32], (r, x)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        cut = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:cut] + own[c][cut:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def made_up(r, n=400):
    rows = []
    for c in [*range(0, n, 3), *range(100, n, 100), -5, -100, -103]:
        if r.random() < 0.3 and c % 100:
            rows += [(c, t, "user", "same") for t in range(7)]
            continue
        for t in range(r.randrange(1, 9)):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "é", None, ""])))
    return rows + [(None, 1, "user", "no id"), (205, 0, "user", "x"), (999, 0, "user", "alone")]


def test_same_as_plain_version(spark):
    rows = made_up(random.Random(5))
    rows += [(5000 + k, t, "user", f"turn {t}") for k in range(3) for t in range(30 + 5 * k)]
    turns = spark.createDataFrame([(*x, 1, "clash") for x in rows], SCHEMA).repartition(5)
    for crowded, size in ((10_000, 100_000), (3, 20), (1, 5)):
        got = prefix_trie.conversation_trie(turns, crowded=crowded, shard_turns=size)
        assert sorted(map(tuple, got.collect()), key=lambda x: (x[0], x[1])) == plain(rows), crowded
    assert prefix_trie.conversation_trie(turns.limit(0)).count() == 0


def test_without_turns_and_long(spark):
    rows = [(c, 0, "user", "x") for c in range(900, 930)]  # without the first one of their group, many are rebuilt without turns
    rows += [(1000, t, "user", str(t)) for t in range(300)] + [(1100, 0, "user", "y" * 1_000_000)]
    got = prefix_trie.conversation_trie(spark.createDataFrame([(*x, 1, "clash") for x in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=lambda x: (x[0], x[1])) == plain(rows)
    rows = [(907, 0, "user", "x"), (907, 1, "user", "y")]
    got = prefix_trie.conversation_trie(spark.createDataFrame([(*x, 1, "clash") for x in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=lambda x: (x[0], x[1])) == plain(rows)


def test_double_array():
    r = np.random.default_rng(2)
    for _ in range(20):
        paths = {tuple(r.integers(0, 9, r.integers(0, 7))) for _ in range(200)}
        starts = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
        codes = np.array([c for p in paths for c in p], np.int64)
        trie = prefix_trie.pack(codes, starts)
        found = {}
        for p in paths:
            state = np.zeros(1, np.int64)
            for d, c in enumerate(p):
                state = trie.child(state, np.array([c]))
                assert found.setdefault(int(state[0]), p[:d + 1]) == p[:d + 1]
        assert len(found) == len({p[:d] for p in paths for d in range(1, len(p) + 1)}) == (trie.check >= 0).sum() - 1


def test_query_agrees_with_sql(spark, small):
    problem, rows, _ = compare(spark, connect(small), small, queries.QUERIES["op11_prefix_trie"], queries.SQL["op11_prefix_trie"])
    assert problem is None, problem
    assert rows > 0
