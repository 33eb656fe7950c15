"""Suffix trees against a dictionary of all windows, and the query against its SQL."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from check_oracle import compare, connect
from gridsurvey.llm import queries, substring_dedup

SCHEMA = "doc_id bigint, text string, lo int, live string"


def plain(rows, window):
    words = {(i, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first, gone = {}, {}
    for place in sorted(words, key=lambda p: (p[0] is not None, p[0] or 0)):
        w = words[place]
        gone[place] = set()
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s:s + window]), (place, s)) != (place, s):
                gone[place].update(range(s, s + window))
    return sorted(((i, len(words[i, t]), len(gone[i, t]), " ".join(w for k, w in enumerate(words[i, t]) if k not in gone[i, t]))
                   for i, t in rows), key=str)


def made_up(r):
    pieces = [" ".join(r.choice(["a", "b", "cé", "d.", "eee"]) for _ in range(30)) for _ in range(12)]
    rows = []
    for i in range(150):
        text = r.choice([" ", "\n", "\t \x0b"]).join(
            r.choice(pieces) if r.random() < 0.6 else " ".join(r.choice("pqrst") + str(r.randrange(9)) for _ in range(r.randrange(25)))
            for _ in range(r.randrange(6)))
        rows.append((i, text))
    rows += [(200, "la " * 21), (201, "la " * 20), (202, "la " * 19), (203, "x y " * 40), (204, None), (205, ""), (206, " \n"),
             (207, "no break   em"), (208, rows[9][1]), (208, rows[9][1]), (None, rows[3][1]), (209, "w" * 3_000_000 + " end")]
    return rows


@pytest.mark.parametrize(("window", "anchor", "group"), [(20, 6, 1 << 18), (20, 6, 40), (7, 3, 25), (5, 5, 1000), (2, 1, 10)])
def test_same_as_plain_version(spark, window, anchor, group):
    rows = made_up(random.Random(window))
    docs = spark.createDataFrame([(*x, 1, "clash") for x in rows], SCHEMA).repartition(6)
    got = substring_dedup.remove_repeated_passages(docs, window=window, anchor=anchor, group=group)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, window)


def test_ids_of_any_type_and_empty(spark):
    rows = [("b", "one two three four five six"), ("a", "zero two three four five seven"), (None, "two three four")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = substring_dedup.remove_repeated_passages(docs, window=3, anchor=2)
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 6, 3, "zero five seven"), ("b", 6, 4, "one six"), (None, 3, 0, "two three four")]
    assert substring_dedup.remove_repeated_passages(docs.limit(0)).count() == 0


def test_long_text_and_copies(spark):
    r = random.Random(1)
    long = " ".join(str(r.randrange(50_000)) for _ in range(200_000))
    rows = [(1, long), (2, "start " + long)] + [(10 + k, " ".join(str(x) for x in range(60))) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x for x in substring_dedup.remove_repeated_passages(docs, group=5000).collect()}
    assert got[1].n_removed == 0 and (got[2].n_words, got[2].n_removed, got[2].text) == (200_001, 200_000, "start")
    assert [got[10 + k].n_removed for k in range(500)] == [0] + [60] * 499


def test_deep_nodes():
    r = np.random.default_rng(4)
    words, run = r.integers(0, 3, 400), np.repeat(np.arange(8), 50)
    starts = np.flatnonzero((np.arange(400) % 50) <= 50 - 6)
    order, node = substring_dedup.deep_nodes(run, words.astype(np.uint64), starts, 6)
    name = {}
    for s, n in zip(order, node):
        assert name.setdefault(n, tuple(words[s:s + 6])) == tuple(words[s:s + 6])
    assert len(set(name.values())) == len(name) and sorted(order) == list(starts)


def test_tokens():
    texts = ["a b", None, "", "  b\x0b\x0cc ", "c", "\u0085x y"]
    data, starts, ends, doc, hashes = substring_dedup.Tokens().of(pa.array(["skip", *texts]).slice(1))
    found = [(int(d), bytes(data[a:b])) for d, a, b in zip(doc, starts, ends)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
    assert len(set(hashes.tolist())) == len({w for _, w in found})


def test_query_agrees_with_sql(spark, small):
    problem, rows, _ = compare(spark, connect(small), small, queries.QUERIES["op13_substring_dedup"], queries.SQL["op13_substring_dedup"])
    assert problem is None, problem
    assert rows > 0
