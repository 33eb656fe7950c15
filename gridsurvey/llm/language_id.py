"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (one to three characters, a
space for anything between words) by falling count. A text's own profile is
compared to each language's by the out-of-place distance: the sum over the
text's n-grams of how far their places lie apart, an absent n-gram counting as
the full profile length.

An n-gram of up to three characters is packed into one integer without loss,
so counting is a sort of integers and no table of strings is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spread

PROFILE = 300
LEARN_PER_LANGUAGE = 2_000
UNDETERMINED = "und"
_SPACE = 32


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_only(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-case code points, each run of other characters as one space, a space at both ends; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    codes = np.where(letters[codes], codes, _SPACE)
    codes = np.concatenate(([_SPACE], codes, [_SPACE]))
    codes = codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]
    return codes if len(codes) > 1 else codes[:0]


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of one to three characters and their counts."""
    grams, counts = [], []
    for n in (1, 2, 3):
        size = len(codes) - n + 1
        if size < 1:
            break
        packed = codes[:size].copy()
        for k in range(1, n):
            packed = (packed << 21) | codes[k : size + k]
        found = np.unique(packed, return_counts=True)
        grams.append(found[0])
        counts.append(found[1])
    return (np.concatenate(grams), np.concatenate(counts)) if grams else (codes[:0], codes[:0])


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent first; equal counts by the packed n-gram."""
    return grams[np.lexsort((grams, -counts))[:size]]


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                   per_language: int = LEARN_PER_LANGUAGE, size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language that ``docs`` names.

    A language with more than ``per_language`` rows is learned from about so
    many of them, picked by a hash of the id; the bound is the only sampling.
    Rows without text or language teach nothing. The result holds ``size``
    integers per language and is the only thing that reaches the driver.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter("lang is not null and text is not null")
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not totals:
        return {}
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(per_language / n)) for k, n in totals.items()))
    picked = known.filter(F.coalesce(spread(F.col("id")), F.lit(0.0)) < share[F.col("lang")])
    letters = docs.sparkSession.sparkContext.broadcast(letter_table())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                codes = [letters_only(t, letters.value) for t in texts]
                grams, counts = gram_counts(np.concatenate(codes))
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": counts})

    counted = picked.select("lang", "text").mapInPandas(count, "lang string, gram bigint, n bigint")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = summed.withColumn("place", place).filter(F.col("place") <= size).orderBy("lang", "place").collect()
    profiles: dict[str, list[int]] = {}
    for r in rows:
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def out_of_place(own: np.ndarray, known: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Distance to each language, 0 to 1. ``places``: per language the place of each of the sorted ``known`` n-grams, or -1."""
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    there = (known[at] == own) & (places[:, at] >= 0)
    apart = np.where(there, np.minimum(np.abs(places[:, at] - np.arange(len(own))), size), size)
    return apart.sum(axis=1) / (size * len(own))


def predict_language(spark, text: Column, profiles: dict[str, list[int]], size: int = PROFILE) -> Column:
    """Struct (lang_pred, score) for a column of texts.

    ``score`` is how much smaller the least distance is than the next, as a
    share of the next (0 for a tie, where the first language by name wins).
    Null texts, texts without a letter and an empty set of profiles give
    ('und', 0).
    """
    langs = sorted(profiles)
    known = np.unique(np.array(sorted({g for p in profiles.values() for g in p}), np.int64))
    places = np.full((len(langs), max(len(known), 1)), -1, np.int64)
    for row, lang in enumerate(langs):
        places[row, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))
    shared = spark.sparkContext.broadcast((langs, known, places, letter_table()))

    def one(text: str | None, langs, known, places, letters) -> tuple[str, float]:
        codes = letters_only(text, letters) if text and langs else ()
        if not len(codes):
            return UNDETERMINED, 0.0
        own = top_grams(*gram_counts(codes), size)
        distances = out_of_place(own, known, places, size)
        best = int(distances.argmin())
        second = np.delete(distances, best).min() if len(langs) > 1 else 1.0
        return langs[best], float(1 - distances[best] / second) if second > 0 else 0.0

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            yield pd.DataFrame([one(t, *model) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def identify_languages(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``, by profiles learned from ``learn_from``."""
    profiles = learn_profiles(learn_from, text_col, lang_col, id_col)
    found = predict_language(docs.sparkSession, F.col(text_col), profiles)
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("found")).select("doc_id", "found.*")
