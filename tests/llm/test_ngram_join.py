"""The join against all pairs in plain Python, in whole tables and in small blocks."""

import random
import re

import numpy as np
import pytest

from gridsurvey.llm import ngram_join, queries
from gridsurvey.llm.components import connected_components
from gridsurvey.llm.words import CHUNK_CHARS, Words, runs, word_table


def grams(text, n=5):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, threshold=0.8):
    """Per row (class_id, n_links) over all pairs."""
    sets = [grams(t) if i is not None else set() for i, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j]
              and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in links[todo.pop()] if k not in seen and not seen.add(k)]
        ids = [rows[k][0] for k in seen]
        out.append((rows[i][0], rows[i][0] if len(seen) == 1 else min(ids), len(links[i])))
    return sorted(out, key=str)


def chain(seed, texts=30, length=60):
    """Texts that differ from the one before in a word: neighbours are alike, ends are not."""
    r = random.Random(seed)
    words = [f"w{r.randrange(10**6)}" for _ in range(length)]
    for _ in range(texts):
        words = list(words)
        words[r.randrange(length)] = f"w{r.randrange(10**6)}"
        yield " ".join(words)


ROWS = [(i, t) for i, t in enumerate([*chain(1), *chain(2), *chain(3, 5)])]
ROWS += [(200, "Only three words"), (201, "only THREE, words!"), (202, "only three"), (203, ""), (204, None), (205, "..."), (206, ""),
         (None, ROWS[0][1]), (207, ROWS[0][1].upper()), (207, ROWS[0][1].upper()), (208, "same " * 30_000), (209, "same " * 5),
         (210, "a b c d e f"), (211, "a b c d e g")]
SCHEMA = "doc_id bigint, text string, class_id string, node int"


@pytest.mark.parametrize("block_sets", [64, 3])
def test_same_as_all_pairs(spark, block_sets):
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in ROWS], SCHEMA)
    got = ngram_join.near_duplicates(docs, block_sets=block_sets).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(ROWS)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_blocks_without_members(spark):
    """Two long near copies have more blocks than members; those in one block are still linked once."""
    rows = [(10 * k + i, t) for k in range(20) for i, t in enumerate(chain(100 + k, 2))]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA)
    got = ngram_join.near_duplicates(docs, block_grams=40).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)
    assert any(r.n_links for r in got)


def test_long_chain_meets_by_bucket(spark, monkeypatch):
    """A chain of texts like their neighbours only is sent by buckets, fewer sets than by blocks, each link counted once."""
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(160 + 12 * 150)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 160])) for i in range(150)]
    rows += [(1000 + i, t) for i, t in rows[::25]] + [(2000 + i, t) for i, t in enumerate(chain(9, 8))]
    seen, units = [], ngram_join._units
    monkeypatch.setattr(ngram_join, "_units", lambda members: seen.append(members) or units(members))
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA)
    got = ngram_join.near_duplicates(docs, block_sets=4).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)
    by_bucket = seen[0].filter("band is not null")
    assert 0 < by_bucket.count() < 150 * 150 // 4
    assert by_bucket.select("node").distinct().count() >= 140


def test_drop(spark):
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in ROWS], SCHEMA)
    out = ngram_join.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted({i for i, c, _ in brute(ROWS) if i == c}, key=str)


def test_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.QUERIES["op5_ngram_join"](spark, small).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ngram_join.near_duplicates(docs).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9995), (0.5, 0.9), (0.9, 0.999)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert bands * rows <= ngram_join.MOST_HASHES and 1 - (1 - threshold**rows) ** bands >= recall


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (101, 103), (5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}}


def test_long_near_copies_are_few_blocks(spark, monkeypatch):
    """Two long texts make two blocks at most, however many n-grams they have."""
    seen = []
    units = ngram_join._units
    monkeypatch.setattr(ngram_join, "_units", lambda members: seen.append(members) or units(members))
    long = [str(k) for k in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:-3] + ["x"]))], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs, block_grams=100).collect())
    assert got == [(1, 1, 1), (2, 1, 1)]
    assert {r.n_blocks for r in seen[0].select("n_blocks").collect()} <= {1, 2}


def test_short_texts_are_hashed_and_signed_together(monkeypatch):
    """Many texts in one pass over arrays have the sets and bands that each has by itself."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(12))) for _ in range(500)]
    texts += [None, "", "...", "a", "ΟΔΟΣ", "ΣΑΣ'Σ", "Σ", "İ x", "a\nb", "\n", "ab " * CHUNK_CHARS, "the end"]
    words, signer, passes = Words(word_table()), ngram_join.Signer(*ngram_join.choose_bands()), []
    alone = [np.unique(runs(words.hashes(t), 5)) for t in texts]
    spans = words.spans
    monkeypatch.setattr(words, "spans", lambda text: passes.append(text) or spans(text))
    sets = ngram_join.gram_sets(texts, words)
    assert len(passes) <= 4
    assert len(sets) == len(texts) and all(np.array_equal(a, b) for a, b in zip(sets, alone))
    filled = [s for s in sets if len(s)]
    bands = signer.band_hashes(filled)
    order = np.arange(1, signer.bands + 1, dtype=np.uint64)
    for grams, row in list(zip(filled, bands))[-40:]:
        short = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.array([(a * short + b).min() for a, b in zip(signer.a, signer.b)], np.uint64).reshape(signer.bands, signer.rows)
        assert np.array_equal(row, ngram_join.mixed((least * signer.steps).sum(axis=1) + ngram_join.mixed(order)).view(np.int64))
