"""Codes and estimates by their properties; links against all pairs, with whole buckets and small blocks."""

import numpy as np
import pytest

from gridsurvey.llm import embedding_join as ej
from gridsurvey.llm import queries


def brute(rows, threshold=0.9):
    """Per row (component, n_links) over all pairs of good vectors of the same length."""
    good = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for g, (_, v) in zip(good, rows)]
    n = len(rows)
    links = [[j for j in range(n) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in links[todo.pop()] if k not in seen and not seen.add(k)]
        out.append((rows[i][0], rows[i][0] if len(seen) == 1 else min(rows[k][0] for k in seen), len(links[i])))
    return sorted(out, key=str)


def vectors(seed=0):
    r = np.random.default_rng(seed)
    rows = [r.normal(size=24) for _ in range(60)]
    for k in range(5):  # groups around a vector
        rows += [rows[k] + 0.15 * r.normal(size=24) for _ in range(12)]
    rows += [r.normal(size=3) for _ in range(10)] + [rows[0], rows[0] * 2.5]
    out = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    out += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] * 24), (504, [None] + [1.0] * 23), (505, [float("inf")] * 24),
            (None, out[0][1]), (0, out[0][1]), (506, [1.0]), (507, [2.0]), (508, [-1.0]), (509, [1e-30] * 24), (510, [1e30] * 24)]
    return out


SCHEMA = "vec_id bigint, embedding array<float>, label int, node string"


@pytest.mark.parametrize("bucket,block", [(4096, 512), (4096, 5)])
def test_same_as_all_pairs(spark, bucket, block):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)
    got = ej.near_vectors(df, recall=0.9999, bucket=bucket, block=block).collect()
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(((r.vec_id, r.component_id, r.n_links) for r in got), key=str) == brute(stored)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_blocks_without_members(spark):
    """As many blocks as vectors, so that some are empty: links are still counted once."""
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in vectors()], SCHEMA)
    got = ej.near_vectors(df, recall=0.9999, block=1).collect()
    stored = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(((r.vec_id, r.component_id, r.n_links) for r in got), key=str) == brute(stored)


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(2, 1500, 64))
    y[:700] = x[:700] + 0.5 * y[:700]
    x, y = ej._unit(x), ej._unit(y)
    codes, factors, _ = ej.Coder(1, 1)(y)
    estimate, error = ej.estimates(x, codes, factors)
    off = np.diag(estimate) - (x * y).sum(axis=1)
    assert abs(off.mean()) < 0.01
    assert (np.abs(off) <= ej.ERRORS * error).mean() > 0.999


def test_tables_reach_the_recall():
    tables, coordinates = ej.choose_tables(10**6, 64)
    assert coordinates == 2
    r = np.random.default_rng(9)
    x, y = r.normal(size=(2, 2000, 64))
    x = ej._unit(x)
    y = ej._unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    coder = ej.Coder(tables, coordinates)
    meet = (coder(x)[2] == coder(0.9 * x + np.sqrt(1 - 0.81) * y)[2]).any(axis=1).mean()
    assert meet >= 0.96


def test_recall_on_a_whole_table(spark):
    path = "/root/testdata/sf0.1"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    ids = sorted(rows)
    unit = ej._unit(np.array([rows[i] for i in ids], float))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in queries.QUERIES["op4_embedding_join"](spark, path).collect()}
    found = sum(got.values())
    assert len(got) == len(ids) and all(got[i] <= n for i, n in zip(ids, near.sum(axis=1)))
    assert found >= 0.9 * near.sum()


def test_empty_table(spark):
    assert ej.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
