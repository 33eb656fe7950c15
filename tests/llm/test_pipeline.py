"""The pipeline stage by stage against plain versions, and on rows made to break it."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridsurvey.llm import packing, queries

from .test_exact_dedup import expected as exact
from .test_ngram_join import brute
from .test_packing import check


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, small), name)
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(spark, small, stages):
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    assert all(df.columns == columns for name, df in stages.items() if name != "packing")


def test_filters_follow_their_operators(spark, small, stages):
    scores = queries.QUERIES["op1_toxicity"](spark, small)
    kept = rows(stages["toxicity"])
    assert set(kept) == {r.doc_id for r in scores.filter("predicted = 0").collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").filter("toxic = 0")
    assert labels.filter(F.col("doc_id").isin(list(kept))).count() >= 0.98 * labels.count()
    known = rows(stages["language_id"])
    assert set(kept) - set(known) <= {i for i, r in kept.items() if len(r.text or "") < 5 or not any(c.isalpha() for c in r.text)}


def test_duplicates_follow_plain_versions(stages):
    before = [(i, r.text) for i, r in rows(stages["language_id"]).items()]
    after = rows(stages["exact_dedup"])
    assert set(after) == {r[0] for r in exact(before) if r[3]}
    left = brute([(i, r.text) for i, r in after.items()])
    assert set(rows(stages["ngram_join"])) == {i for i, c, _ in left if i == c}


def test_bins(stages):
    docs = rows(stages["ngram_join"])
    check({i: len(d.text.split()) for i, d in docs.items()}, stages["packing"].collect(), packing.CAPACITY,
          [{i: d.source for i, d in docs.items()}, {i: d.text for i, d in docs.items()}])


def test_run_is_the_last_stage(spark, small, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, small).collect())) == Counter(map(tuple, stages["packing"].collect()))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, small, name):
    """Null columns, empty, long, tied and repeated rows, more columns, and no rows at all."""
    long = "a long text of words " * 5_000
    made = [(1, "One fine day it was", "en", "a"), (1, "One fine day it was", "en", "a"), (2, "ONE fine day it was", None, None),
            (None, None, None, None), (None, "words without id", "en", "a"), (3, "", "en", "a"), (4, long, "en", "b"), (5, long + "x", "en", "b")]
    docs = spark.createDataFrame(
        [(*r, len(r[1] or ""), "clash", 0.5, 1) for r in made],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, score double, bands int")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, small)
    got = {r.doc_id for r in out.collect()}
    if name == "packing":
        assert got == {1, 2, 3, 4, 5, None}
    else:
        assert out.columns == docs.columns
        wanted = {
            "toxicity": {1, 2, 3, 4, 5, None}, "language_id": {1, 2, 4, 5, None}, "exact_dedup": {2, 3, 4, 5, None},
            "ngram_join": {1, 3, 4, None}}[name]
        assert got == wanted, got
    assert stage(spark, docs.limit(0), small).count() == 0
