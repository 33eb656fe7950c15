"""Breeding-evidence category, description and rank as codegen-friendly expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lookups import CATEGORIES, CATEGORY_RENAMES, SEASONS, SPECIES_RENAMES


def _case(c: Column, pairs) -> Column:
    pairs = list(pairs)
    first = F.when(c == pairs[0][0], F.lit(pairs[0][1]))
    return reduce(lambda acc, p: acc.when(c == p[0], F.lit(p[1])), pairs[1:], first)


def rank_of(category: Column) -> Column:
    """``C1``.. to its rank; an unknown category gives null."""
    return _case(category, [(cat, rank) for cat, _, rank in CATEGORIES])


def description_of(category: Column) -> Column:
    return _case(category, [(cat, desc) for cat, desc, _ in CATEGORIES])


def rank_of_description(desc: Column) -> Column:
    return _case(desc, [(d, rank) for _, d, rank in CATEGORIES])


def description_of_rank(rank: Column) -> Column:
    return _case(rank, [(r, desc) for _, desc, r in CATEGORIES])


def current_species_name(name: Column) -> Column:
    return F.coalesce(_case(name, SPECIES_RENAMES.items()), name)


def current_category_name(desc: Column) -> Column:
    return F.coalesce(_case(desc, CATEGORY_RENAMES.items()), desc)


def seasons_of(month: Column, seasons: dict[str, list[str]] = SEASONS) -> Column:
    """Array of the seasons a month label belongs to."""
    flags = [F.when(month.isin(months), F.lit(season)) for season, months in seasons.items()]
    return F.array_compact(F.array(*flags))
