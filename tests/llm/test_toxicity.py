"""The machine against its formula written out, pairs that linear weights miss, and held-out accuracy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsurvey.llm import queries, toxicity
from gridsurvey.llm.words import Words, runs, word_table


@pytest.fixture(scope="module")
def words():
    return Words(word_table())


def test_hashes_follow_words_alone(words):
    a, b = words.hashes("The cat, the Über-cat!"), words.hashes("  the\nCAT the über cat")
    assert (a == b).all() and len(a) == 5 and a[0] == a[2] != a[1]
    assert (runs(a, 2) == runs(b, 2)).all() and len(runs(a, 9)) == 1 and len(runs(a[:0], 5)) == 0
    long = words.hashes("ab " * 40_000)
    assert len(set(long.tolist())) == 1 and long[0] == words.hashes("ab")[0]


def test_score_is_the_formula(words):
    random = np.random.default_rng(1)
    buckets, times = toxicity.terms("you lousy lousy northerners go away", words)
    machine = toxicity.Machine(-1.0, buckets[::2], random.normal(size=len(buckets[::2])), random.normal(size=(len(buckets[::2]), 3)))
    own = [(i, math.log1p(t)) for i, t in enumerate(times[::2])]
    raw = -1.0 + sum(machine.weights[i] * x for i, x in own)
    raw += sum(machine.vectors[i] @ machine.vectors[j] * x * y for (i, x), (j, y) in itertools.combinations(own, 2))
    assert machine.score(buckets, times) == pytest.approx(1 / (1 + math.exp(-raw)))


def test_learns_a_pair(words):
    """Toxic only if insult and group meet, or neither is there: no linear weights can tell."""
    texts = [("lousy northerners", 1), ("lousy weather", 0), ("kind northerners", 0), ("kind weather", 1)] * 100
    rows = [(y, *toxicity.terms(t, words)) for t, y in texts]
    machine = toxicity.fit(rows, np.unique(np.concatenate([r[1] for r in rows])))
    assert all((machine.score(b, t) >= 0.5) == bool(y) for y, b, t in rows)


def test_whole_learner_finds_the_pair(spark):
    """No word of these texts is toxic more often than the next; the screen has to let them pass for their pairs."""
    texts = [("lousy northerners", 1), ("lousy weather", 0), ("kind northerners", 0), ("kind weather", 1)]
    rows = [(f"doc-{i}", f"number{i} said {texts[i % 4][0]} again today", texts[i % 4][1]) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id string, toxic int")
    machine = toxicity.learn_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, machine).collect()}
    assert all(got[i].predicted == y for i, _, y in rows)


def test_runs_where_workers_lack_the_package(tmp_path):
    """Workers that start in another folder get all they need with the task."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {repo!r})
from gridsurvey.session import build_session
from gridsurvey.llm import toxicity
spark = build_session("apart", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {str(tmp_path)!r}}})
docs = spark.createDataFrame([(i, "lousy lout" if i % 2 else "fine day") for i in range(60)], "doc_id int, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id int, toxic int")
machine = toxicity.learn_toxicity(docs, labels)
assert all(r.predicted == r.doc_id % 2 for r in toxicity.toxicity(docs, machine).collect())
print("learned")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "learned" in done.stdout, done.stderr[-2000:]


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, "lousy lout", 5.0), (2, None, 5.0), (3, "", 5.0), (None, "lousy", 5.0), (4, "fine day", 5.0), (4, "fine day", 5.0)] +
        [(i, "lousy lout" if i % 2 else "fine day", 0.0) for i in range(10, 60)] + [(99, "lousy " * 50_000, 0.0)],
        "doc_id bigint, text string, score double")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(10, 60)] + [(1, None), (None, 1), (4, 7)], "doc_id bigint, toxic int")
    machine = toxicity.learn_toxicity(docs, labels)
    got = toxicity.toxicity(docs, machine).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[1] == by[None] == by[99] == 1 and by[4] == 0
    scores = [r.score for r in got if r.doc_id in (2, 3)]
    assert scores[0] == scores[1]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.learn_toxicity(docs, labels) is None
    assert toxicity.learn_toxicity(docs, spark.createDataFrame([(1, 1)], labels.schema)) is None
    assert [tuple(r) for r in toxicity.toxicity(docs, None).collect()] == [(1, 0.0, 0)]


def test_held_out(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    found = queries.QUERIES["op1_toxicity"](spark, path).join(labels, "doc_id").filter("held_out")
    right, total, bad, clean = found.agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*"),
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert total > 500 and right > 0.98 and bad > 0.85 and clean < 0.01, (right, total, bad, clean)
