"""Near-duplicate embeddings by randomised-rotation binary codes.

Each unit vector is turned by a random rotation; its code is the sign of every
coordinate, and its correction factor the inner product of vector and code.
Dividing by the factor makes the code's inner product with another turned
vector an unbiased estimate of the cosine, with a known error: a pair is
recomputed in double precision if estimate and bound reach the threshold, and
is only ever linked by that exact value.

Which pairs are estimated is decided by more rotations: in each of several
tables a vector falls into the bucket of its largest turned coordinates, which
near vectors share far more often than others. The number of coordinates
follows from the number of vectors, the number of tables from the target
recall. Buckets are cut into blocks of bounded size and every two blocks meet
in one row, so a bucket with a third of all vectors is spread over many tasks;
equal vectors are one class before that. A pair counts in the first table that
its vectors share. Only counts and a spanning forest leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import forest, link_classes

THRESHOLD = 0.9
#: Share of pairs right at the threshold that meet in a table; closer pairs meet more often.
RECALL = 0.98
#: Standard errors that an estimate may lie too low.
ERRORS = 4.0
#: Coordinates are added to the buckets until an average one has at most so many vectors.
BUCKET_VECTORS = 4096
BLOCK_VECTORS = 512
_SEED = 5


def rotation(dim: int, number: int) -> np.ndarray:
    """A random rotation, the same wherever it is made. Number 0 is the codes' own."""
    random = np.random.default_rng((_SEED, dim, number))
    q, r = np.linalg.qr(random.normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def largest(turned: np.ndarray) -> np.ndarray:
    """The largest coordinate of each row, positive and negative ones apart."""
    at = np.abs(turned).argmax(axis=1)
    return 2 * at + (turned[np.arange(len(turned)), at] > 0)


def choose_tables(vectors: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL,
                  bucket: int = BUCKET_VECTORS) -> tuple[int, int]:
    """(tables, coordinates per bucket); how often a pair at the threshold shares a coordinate is measured on 20,000 made pairs."""
    coordinates = 1
    while vectors / (2 * dim) ** coordinates > bucket and dim > 1:
        coordinates += 1
    random = np.random.default_rng(_SEED)
    x, y = random.normal(size=(2, 20_000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    shared = (largest(x) == largest(threshold * x + math.sqrt(1 - threshold**2) * y)).mean() if dim > 1 else 1.0
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(shared**coordinates, 1 - 1e-9)))), coordinates


class Coder:
    """Codes, factors and bucket keys of unit vectors; keeps the rotations of each dimension."""

    def __init__(self, tables: int, coordinates: int):
        self.tables, self.coordinates = tables, coordinates
        self.kept: dict[int, list[np.ndarray]] = {}

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dim = unit.shape[1]
        if dim not in self.kept:
            self.kept[dim] = [rotation(dim, i) for i in range(1 + self.tables * self.coordinates)]
        own, *others = self.kept[dim]
        turned = unit @ own
        keys = np.full((len(unit), self.tables), dim, np.int64)
        for i, other in enumerate(others):
            table = i // self.coordinates
            keys[:, table] = keys[:, table] * (2 * dim) + largest(unit @ other)
        return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(dim), keys


def estimates(unit: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of each vector (rows) with each coded vector (columns), and the standard error of each column."""
    dim = unit.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(float) * 2 - 1
    estimate = (unit @ rotation(dim, 0)) @ signs.T / (math.sqrt(dim) * factors)
    return estimate, np.sqrt(np.maximum(1 - factors**2, 0)) / (factors * math.sqrt(max(dim - 1, 1)))


def _clean(value: np.ndarray | None) -> np.ndarray | None:
    """The vector if all its components are finite numbers and one is not zero."""
    if value is None or not len(value):
        return None
    vector = np.asarray([np.nan if v is None else v for v in value] if value.dtype == object else value, float)
    return vector if np.isfinite(vector).all() and vector.any() else None


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        vectors = [_clean(v) for v in batch["vector"]]
        batch["node"] = [hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if v is not None else None for v in vectors]
        batch["vector"] = vectors
        yield batch


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, errors: float) -> Iterator[pa.RecordBatch]:
    """Per vector of a row of one or two blocks: vectors linked across the row, and one it is connected to."""
    for batch in batches:
        found: tuple[list, list, list] = [], [], []
        for row in range(batch.num_rows):
            table, parts = batch.column(0)[row].as_py(), batch.column(1)[row]
            blocks = []
            for k in range(len(parts)):
                v = parts[k].values
                rows = len(v)
                column = {name: v.field(name) for name in ("node", "weight", "vector", "code", "factor", "keys")}
                blocks.append((
                    column["node"].to_pylist(), column["weight"].to_numpy(zero_copy_only=False),
                    _unit(column["vector"].flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)),
                    np.frombuffer(b"".join(column["code"].to_pylist()), np.uint8).reshape(rows, -1),
                    column["factor"].to_numpy(zero_copy_only=False),
                    column["keys"].flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)))
            a, b = blocks[0], blocks[-1]
            estimate, error = estimates(a[2], b[3], b[4])
            likely = estimate + errors * error >= threshold
            if a is b:
                likely = np.triu(likely | likely.T, 1)
            i, j = np.nonzero(likely)
            for t in range(table):
                apart = a[5][i, t] != b[5][j, t]
                i, j = i[apart], j[apart]
            exact = np.concatenate([(a[2][i[k : k + 65536]] * b[2][j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [[]])
            i, j = i[exact >= threshold], j[exact >= threshold]
            nodes, weights, shift = (a[0], a[1], 0) if a is b else (a[0] + b[0], np.concatenate([a[1], b[1]]), len(a[0]))
            j = j + shift
            links = np.zeros((len(nodes), len(nodes)), bool)
            links[i, j] = links[j, i] = True
            counts, label = links @ weights, forest(links)
            for k in np.flatnonzero(counts):
                for out, value in zip(found, (nodes[k], int(counts[k]), nodes[label[k]]), strict=True):
                    out.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary())], ["node", "n_links", "root"])


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                 recall: float = RECALL, errors: float = ERRORS, bucket: int = BUCKET_VECTORS, block: int = BLOCK_VECTORS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``embeddings``.

    Vectors of the same length are linked if their cosine in double precision
    reaches ``threshold``. ``n_links`` counts the rows linked directly,
    ``component_id`` is the smallest id that links reach, ``kept`` marks it.
    Vectors that are null, empty, all zero or hold a null or a non-finite
    component, and rows with a null id, are linked with nothing. Repeated rows are
    copies of each other. Other columns are not looked at; an empty table
    gives no rows.
    """
    rows = embeddings.select(F.col(id_col).alias("doc_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = dict(rows.dtypes)["doc_id"]
    keyed = staged(rows.mapInPandas(_keyed, f"doc_id {kind}, vector array<double>, node binary").withColumn(
        "node", F.when(F.col("doc_id").isNotNull(), F.col("node"))), "vectors")
    sets = staged(keyed.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("weight"), F.first("vector").alias("vector")), "vector_sets")
    total, dim = sets.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    tables, coordinates = choose_tables(total, dim, threshold, recall, bucket)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(tables, coordinates)
        for batch in batches:
            for _, same in batch.groupby(batch["vector"].map(len)):
                codes, factors, keys = coder(_unit(np.vstack(same["vector"].to_list())))
                yield same.assign(code=[c.tobytes() for c in codes], factor=factors, keys=list(keys))

    coded = staged(sets.select("node", "weight", "vector").mapInPandas(
        code, "node binary, weight bigint, vector array<double>, code binary, factor double, keys array<bigint>"), "codes")
    tabled = coded.select(F.posexplode("keys").alias("table", "key"), "*")
    sizes = staged(tabled.groupBy("table", "key").agg(F.count("*").alias("c")).filter("c > 1").select(
        "table", "key", F.ceil(F.col("c") / block).cast("int").alias("n_blocks")), "bucket_sizes")
    members = tabled.join(sizes, ["table", "key"]).withColumn("at", F.pmod(F.xxhash64("node", "table"), "n_blocks").cast("int"))
    blocks = members.groupBy("table", "key", "n_blocks", "at").agg(
        F.collect_list(F.struct("node", "weight", "vector", "code", "factor", "keys")).alias("members"))
    single = blocks.filter("n_blocks = 1").select("table", F.array("members").alias("parts"))
    several = blocks.filter("n_blocks > 1").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    paired = several.groupBy("table", "key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j")).agg(
        F.collect_list("members").alias("parts")).filter("i = j or size(parts) = 2")  # not a block with an empty one
    checked = staged(single.union(paired.select("table", "parts")).mapInArrow(
        lambda it: _compare(it, threshold, errors), "node binary, n_links bigint, root binary"), "vector_links")
    return link_classes(keyed.select("doc_id", "node"), sets, checked).select(
        F.col("doc_id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"), "kept")
