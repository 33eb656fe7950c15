"""Block naming against a grouping in plain Python, with and without crowded buckets."""

import hashlib
from collections import defaultdict

import pytest

from gridsurvey.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, keep_id string, bucket int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = [i for i in groups[lowered(text)] if i is not None]
        keep = max(ids) if ids else None
        sha = hashlib.sha256(lowered(text).encode()).hexdigest()
        out.append((doc_id, keep, len(groups[lowered(text)]), doc_id == keep, sha))
    return sorted(out, key=str)


ROWS = [
    (1, "Abc def"), (2, "aBC DEF"), (3, "ÄBC"), (4, "äBC"), (5, None), (6, ""), (7, "x" * 37), (8, "X" * 37), (9, "x" * 38),
    (10, "ab" * 20), (11, "ab" * 20 + "a"), (12, "ba" * 20), (None, "lonely"), (None, "abc DEF"), (13, "ééé\n𝄞" * 9),
    (14, "ééé\n𝄞" * 9), (15, " "), (15, " "), (16, "q" * 5000), (17, "q" * 5000), (17, "another"),
]


@pytest.mark.parametrize("block_chars,bits", [(4096, 64), (4, 64), (3, 2), (1, 1)])
def test_same_as_grouping(spark, block_chars, bits):
    rows = [r for r in ROWS if block_chars > 100 or len(r[1] or "") < 1000]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA)
    got = exact_dedup.exact_duplicates(docs, block_chars=block_chars, bits=bits).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_drop_keeps_rows_whole(spark):
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in ROWS], SCHEMA)
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    kept = {(r[0], r[4]) for r in expected(ROWS) if r[3]}
    rows = [(r.doc_id, hashlib.sha256(lowered(r.text).encode()).hexdigest()) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.drop_duplicates(docs).count() == 0
