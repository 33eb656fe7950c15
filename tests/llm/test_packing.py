"""Packing against a search through all bins, and the promises a packing makes."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from gridsurvey.llm import ngram_join, packing, queries


def slow(rows, capacity):
    """Bins by looking at every bin for every row."""
    bins, out = [], []
    for k, (n, s, c) in enumerate(rows):
        for piece in range(n // capacity):
            bins.append([0, set()])
            out.append((k, piece, piece * capacity, capacity, len(bins) - 1, 0))
    for k, (n, s, c) in sorted(enumerate(rows), key=lambda r: -(r[1][0] % capacity)):
        left, own = n % capacity, {("s", s), ("c", c)} - {("s", None), ("c", None)}
        if left:
            fits = [(room, b) for b, (room, held) in enumerate(bins) if room >= left and not held & own]
            if not fits:
                bins.append([capacity, set()])
                fits = [(capacity, len(bins) - 1)]
            room, b = min(fits)
            out.append((k, n // capacity, n - left, left, b, capacity - room))
            bins[b] = [room - left, bins[b][1] | own]
    return out


def test_same_as_full_search():
    r = random.Random(2)
    for _ in range(20):
        rows = [(r.randrange(1, 250), r.choice("abcdefg") if r.random() < 0.9 else None, r.choice([None, *range(40)])) for _ in range(200)]
        assert packing.best_fit(rows, 100) == slow(rows, 100)
    assert packing.best_fit([], 100) == [] and packing.best_fit([(100, "a", 1)] * 2, 100) == slow([(100, "a", 1)] * 2, 100)


def check(lengths, rows, capacity, conflicts):
    covered, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        covered[r.doc_id].append((r.start, r.length))
        if r.length:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    assert set(covered) == set(lengths)
    for doc_id, spans in covered.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == lengths[doc_id]
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.at):
            assert r.at == at
            at += r.length
        assert at <= capacity
        for names in conflicts:
            seen = [names[r.doc_id] for r in held if names[r.doc_id] is not None]
            assert len(seen) == len(set(seen))


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (i % 7), f"s{i % 3}" if i % 4 else None, "clash") for i in range(300)] +
        [(300, None, "s0", ""), (301, "", "s0", ""), (302, "w " * 50_000, None, "")], "doc_id bigint, text string, source string, bin_id string")
    rows = packing.pack_documents(docs, capacity=8).collect()
    lengths = {i: i % 7 for i in range(300)} | {300: 0, 301: 0, 302: 50_000}
    check(lengths, rows, 8, [{i: (f"s{i % 3}" if i % 4 else None) for i in range(300)} | {300: "s0", 301: "s0", 302: None}])
    twice = spark.createDataFrame([(1, "a b", "s", 0), (1, "a b", "s", 0), (None, "a", None, 0)], "doc_id bigint, text string, source string, n int")
    got = packing.pack_documents(twice).collect()
    assert len(got) == 3 and len({r.bin_id for r in got if r.doc_id == 1}) == 2
    assert packing.pack_documents(twice.limit(0)).count() == 0


def test_near_copies_lie_apart(spark, small):
    """No bin of the query holds two members of one class of near duplicates."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    classes = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(docs).collect()}
    names = {d.doc_id: d.text.lower() for d in docs.collect()}
    bins = defaultdict(list)
    for r in queries.QUERIES["op6_packing"](spark, small).collect():
        if r.bin_id is not None:
            bins[r.bin_id].append(r.doc_id)
    for held in bins.values():
        assert len({classes[i] for i in held}) == len({names[i] for i in held}) == len(held)


def test_near_copies_of_other_sources(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (0, 1, 58, 59)]
    rows = [(i, t, f"s{i}") for i, t in enumerate([*near, near[0].upper(), "...", "..."])] + [(None, near[1], None), (0, "a b c", "s9")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = packing.pack_near_documents(docs).collect()
    assert len(got) == len(rows)
    held = defaultdict(list)
    for r in got:
        held[r.bin_id].append((r.doc_id, r.length))
    assert all(sum(n == 60 for _, n in b) <= 1 and not {(5, 1), (6, 1)} <= set(b) for b in held.values())
    assert packing.pack_near_documents(docs.limit(0)).count() == 0


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = queries.QUERIES["op6_packing"](spark, small).collect()
    check({d.doc_id: len(d.text.split()) for d in docs}, rows, packing.CAPACITY, [{d.doc_id: d.source for d in docs}, {d.doc_id: d.text for d in docs}])
    bins = {r.bin_id for r in rows}
    assert sum(r.length for r in rows) > 0.5 * packing.CAPACITY * len(bins)


def test_words_and_case_are_told_by_ascii_alone(spark):
    """One pass over the texts gives what the built-in functions would: blanks and case of ASCII only, missing texts missing."""
    texts = ["a b\tc\n d\x0be\x0cf\rg", " x y z\x1cw", "", " \n ", None, "ÄB ß", "äb ß", "Äb ß", "word"]
    docs = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    facts = {r.doc_id: r for r in packing._facts(docs, F.col("doc_id").cast("string")).collect()}
    words = {r.doc_id: r.n for r in docs.select("doc_id", packing.word_count(F.col("text")).alias("n")).collect()}
    assert {i: r.length for i, r in facts.items()} == words and facts[4].same is None
    assert facts[5].same == facts[7].same != facts[6].same
    assert packing.pack_near_documents(docs).count() == len(texts)
