"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-case words of a text and the first four and five letters
of longer words, hashed into 2^20 buckets; a bucket's value is log(1 + times
seen). The machine adds to the linear weights a weight for every pair of terms,
the product of two short vectors, so an insult beside the mention of a group
can count for more than both alone.

Two kinds of buckets take part, which keeps rare words from learning texts by
heart: those whose share of toxic texts differs from the base rate by five
standard errors, and those of two words that stand near each other and together
differ as much from what their own shares add up to. Either of such two may tell
nothing alone. Both statistics are Spark groupings over the written sample; the
machine itself is fitted on the few terms per text that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, staged
from .words import Words, word_table

BITS = 20
PREFIXES = (4, 5)
#: At most about so many labelled rows are learned from, picked by a hash of the id.
LEARN_ROWS = 20_000
#: A bucket takes part if at least so many texts have it and it is so many standard errors off the base rate.
LEAST_TEXTS, LEAST_ERRORS = 5, 5.0
#: Two words are looked at together up to so many words apart, if both stand so in so many texts and neither is in more than such a share.
NEAR, LEAST_PAIR_TEXTS, MOST_PAIR_SHARE = 6, 20, 0.5
#: A task counts pairs itself before the shuffle, so many at a time.
PAIRS_HELD = 1 << 21
#: At most so many terms of a sampled text reach the driver, those seen most often in it.
MOST_TERMS = 4096
FACTORS, EPOCHS, RATE, SHRINK, SEED = 8, 12, 0.1, 1e-3, 7


@dataclass
class Machine:
    """Base weight, the sorted buckets that take part, their weights and vectors."""

    base: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, buckets: np.ndarray, times: np.ndarray) -> float:
        at = np.searchsorted(self.buckets, buckets)
        at[at == len(self.buckets)] = 0
        there = self.buckets[at] == buckets if len(self.buckets) else np.zeros(len(buckets), bool)
        at, x = at[there], np.log1p(times[there])
        v = self.vectors[at] * x[:, None]
        raw = self.base + self.weights[at] @ x + 0.5 * (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def terms(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's terms and how often each was seen."""
    sums, starts, ends = words.spans(text)
    hashes = [words.between(sums, starts, ends)]
    for n in PREFIXES:
        longer = starts[ends - starts > n]
        hashes.append(words.between(sums, longer, longer + n) * np.uint64(2 * n + 1))
    buckets, times = np.unique(np.concatenate(hashes) >> np.uint64(64 - BITS), return_counts=True)
    return buckets.astype(np.int64), times


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: np.ndarray) -> Machine:
    """Logistic loss by stochastic gradient steps scaled per coordinate; ``rows``: label, buckets and times seen."""
    labels = np.array([r[0] for r in rows], float)
    share = labels.mean()
    random = np.random.default_rng(SEED)
    machine = Machine(
        float(np.log(share / (1 - share))), buckets, np.zeros(len(buckets)),
        random.normal(0, 0.05, (len(buckets), FACTORS)))
    own = [(np.searchsorted(buckets, b), np.log1p(t)) for _, b, t in rows]
    seen_base, seen_w, seen_v = 1e-2, np.full(len(buckets), 1e-2), np.full((len(buckets), FACTORS), 1e-2)
    w, vectors = machine.weights, machine.vectors
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            at, x = own[i]
            v = vectors[at] * x[:, None]
            total = v.sum(axis=0)
            raw = machine.base + w[at] @ x + 0.5 * (total**2 - (v * v).sum(axis=0)).sum()
            off = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[i]
            seen_base += off * off
            machine.base -= RATE * off / np.sqrt(seen_base)
            step = off * x + SHRINK * w[at]
            seen_w[at] += step * step
            w[at] -= RATE * step / np.sqrt(seen_w[at])
            step = off * x[:, None] * (total - v) + SHRINK * vectors[at]
            seen_v[at] += step * step
            vectors[at] -= RATE * step / np.sqrt(seen_v[at])
    return machine


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", rows: int = LEARN_ROWS) -> Machine | None:
    """A machine learned from the texts of ``docs`` that ``labels`` marks 0 or 1.

    With more than ``rows`` labels about so many are used. Ids and labels
    that are null teach nothing. None if there are not both labels.
    """
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
    marked = marked.filter("__id is not null and __label in (0, 1)")
    total = marked.count()
    if not total:
        return None
    # Never more than about ``rows`` rows of two numbers, so small enough for every executor.
    picked = F.broadcast(marked.filter(spread(F.col("__id")) < rows / total))
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(picked, "__id")
    table = docs.sparkSession.sparkContext.broadcast(word_table())

    def collect_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(table.value)
        for batch in batches:
            found = [terms(t, words) for t in batch["__text"]]
            yield pd.DataFrame({
                "label": batch["__label"], "place": batch["__place"], "buckets": [f[0] for f in found], "times": [f[1] for f in found],
                "order": [(words.hashes(t) >> np.uint64(64 - BITS)).astype(np.int64) for t in batch["__text"]]})

    sample = staged(known.withColumn("__place", F.xxhash64("__id", "__text")).drop("__id").mapInPandas(
        collect_terms, "label int, place bigint, buckets array<int>, times array<int>, order array<int>"), "toxicity_terms")
    texts, toxic = sample.agg(F.count("*"), F.sum("label")).first()
    if not texts or not 0 < toxic < texts:
        return None
    share = toxic / texts
    counted = staged(sample.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("label").alias("bad")), "toxicity_buckets")
    alone = counted.filter((F.col("n") >= LEAST_TEXTS) & (_errors(F.lit(share)) >= LEAST_ERRORS)).select("bucket")
    # At most 2^20 numbers each.
    chosen = np.array(sorted(r["bucket"] for r in alone.union(_pair_buckets(sample, counted, texts, share)).distinct().collect()), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def keep_chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen_at = np.zeros(1 << BITS, bool)
        chosen_at[shared.value] = True
        for batch in batches:
            kept = [np.flatnonzero(chosen_at[np.asarray(b, np.int64)]) for b in batch["buckets"]]
            kept = [np.sort(k[np.argsort(-t[k], kind="stable")[:MOST_TERMS]]) for k, t in zip(kept, batch["times"], strict=True)]
            batch["buckets"] = [b[k] for b, k in zip(batch["buckets"], kept, strict=True)]
            batch["times"] = [t[k] for t, k in zip(batch["times"], kept, strict=True)]
            yield batch

    plain = sample.drop("order")
    few = plain.mapInPandas(keep_chosen, plain.schema)
    rows_ = [(r["label"], np.array(r["buckets"], np.int64), np.array(r["times"], float)) for r in sorted(few.collect(), key=lambda r: (r["place"], r["label"]))]
    return fit(rows_, chosen)


def _errors(expected: Column) -> Column:
    """Standard errors by which the toxic texts among ``n`` differ from an expected share of them."""
    n = F.col("n")
    return F.abs(F.col("bad") - n * expected) / F.sqrt(n * expected * (1 - expected))


def _pair_buckets(sample: DataFrame, counted: DataFrame, texts: int, share: float) -> DataFrame:
    """Buckets of words that say something only where they stand near each other.

    The texts that hold two words near each other are compared with the share
    that the two words' own shares add up to, kept off 0 and 1.
    """
    common = counted.filter((F.col("n") >= LEAST_PAIR_TEXTS) & (F.col("n") <= MOST_PAIR_SHARE * texts))
    usable = np.array(sorted(r["bucket"] for r in common.select("bucket").collect()), np.int64)
    shared = sample.sparkSession.sparkContext.broadcast(usable)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usable_at = np.zeros(1 << BITS, bool)
        usable_at[shared.value] = True
        held, size = [], 0
        for batch in batches:
            for label, order in zip(batch["label"], batch["order"], strict=True):
                order = np.asarray(order, np.int64)
                use = usable_at[order]
                both = [np.zeros(0, np.int64)]
                for d in range(1, min(NEAR, len(order) - 1) + 1):
                    a, b, ok = order[:-d], order[d:], use[:-d] & use[d:]
                    both.append((np.minimum(a, b)[ok] << BITS) + np.maximum(a, b)[ok])
                held.append(2 * np.unique(np.concatenate(both)) + int(label))
                size += len(held[-1])
                if size >= PAIRS_HELD:
                    yield tally(held)
                    held, size = [], 0
        if held:
            yield tally(held)

    def tally(held: list[np.ndarray]) -> pd.DataFrame:
        """Texts that hold each pair, and toxic ones among them; the last bit of what is held is the label."""
        marked, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"pair": marked >> 1, "n": n, "bad": n * (marked & 1)})

    pairs = sample.select("label", "order").mapInPandas(near, "pair bigint, n bigint, bad bigint")
    tallies = pairs.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("n") >= LEAST_PAIR_TEXTS)
    split = tallies.select("n", "bad", F.shiftright("pair", BITS).cast("int").alias("a"), (F.col("pair") % (1 << BITS)).cast("int").alias("b"))
    own = {c: counted.select(F.col("bucket").alias(c), (F.col("bad") / F.col("n")).alias(f"{c}_share")) for c in ("a", "b")}
    joined = split.join(own["a"], "a").join(own["b"], "b")
    added = F.least(F.greatest(F.col("a_share") + F.col("b_share") - share, F.lit(min(share, 1 - share) / 2)), F.lit(1 - min(share, 1 - share) / 2))
    return joined.filter(_errors(added) >= LEAST_ERRORS).select(F.explode(F.array("a", "b")).alias("bucket"))


def score_toxicity(spark, text: Column, machine: Machine | None) -> Column:
    """A column of scores, 0 to 1, for a column of texts; null and empty texts get the base score, no machine gives 0."""
    if machine is None:
        return F.lit(0.0)
    # Plain arrays: what is broadcast is pickled by reference, and executors need not have this package.
    shared = spark.sparkContext.broadcast((machine.base, machine.buckets, machine.weights, machine.vectors, word_table()))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        *parts, table = shared.value
        model, words = Machine(*parts), Words(table)
        for texts in batches:
            yield pd.Series([model.score(*terms(t, words)) for t in texts], dtype=float)

    return score(text)


def toxicity(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row of ``docs``; other columns are not looked at, repeated rows score alike."""
    score = score_toxicity(docs.sparkSession, F.col(text_col), machine)
    scored = docs.select(F.col(id_col).alias("doc_id"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
