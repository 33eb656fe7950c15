"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Alternates the large-star and small-star steps until the edges stay the
    same, which takes about as many rounds as the logarithm of the longest
    path. Each step is a combining minimum per node and a join with it; the
    minima are written, so that a node with very many neighbours is split by
    adaptive execution. Nothing but a count and a checksum reaches the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges = staged(edges, f"{name}_edges")
    before = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = _star(both, F.col("v") > F.col("u"), F.least("u", "m"), name)
        turned = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = _star(turned, F.lit(True), F.col("m"), name, with_own=True)
        edges = small
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())


def _star(pairs: DataFrame, keep, least, name: str, with_own: bool = False) -> DataFrame:
    """Edges (neighbour, smallest neighbour) for the kept neighbours of each node."""
    minima = staged(pairs.groupBy("u").agg(F.min("v").alias("m")), f"{name}_minima")
    out = pairs.filter(keep).join(minima, "u").select(F.col("v").alias("a"), least.alias("b"))
    if with_own:
        out = out.union(minima.select("u", "m"))
    return staged(out.filter("a != b").distinct(), f"{name}_edges")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def forest(links: np.ndarray) -> np.ndarray:
    """The smallest member that each member of a symmetric matrix of links reaches."""
    label = np.arange(len(links))
    while True:
        least = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_classes(rows: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for each of ``rows`` (doc_id, node).

    Rows with equal nodes are copies; ``sets`` has each node's smallest id and
    number of rows (node, first_id, weight). ``links`` holds parts of what was
    found: (node, rows linked to it there, a node it is connected to). A null
    node is linked with nothing.
    """
    classes = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    of_set = sets.select("node", "first_id", "weight").join(counts, "node", "left").join(classes, "node", "left")
    of_set = staged(of_set.select(
        "node", "first_id", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component")), "linked_sets")
    first = staged(of_set.groupBy("component").agg(F.min("first_id").alias("class_id")), "class_ids")
    found = staged(of_set.join(first, "component").select("node", "n_links", "class_id"), "set_classes")
    class_id = F.coalesce("class_id", "doc_id")
    return rows.join(found, "node", "left").select(
        "doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        class_id.eqNullSafe(F.col("doc_id")).alias("kept"))
