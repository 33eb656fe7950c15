"""Expected species: observation shares per block, species and month, and their shrinkage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import beta_quantile, digamma, trigamma
from ..lookups import season_months
from .joins import in_season
from .metrics import BLOCK


def species_month_grid(x: DataFrame, months: list[str]) -> DataFrame:
    """Every (block, species) seen, once per month.

    The months are a constant array, so the grid is an explode of the distinct
    pairs and not a cross join.
    """
    pairs = x.select(BLOCK, "common_name").distinct()
    return pairs.withColumn("observation_month", F.explode(F.array(*[F.lit(m) for m in months])))


def species_observed_pct(x: DataFrame, season: str = "Breeding", per_month: bool = False) -> DataFrame:
    """Share of a block's checklists on which a species was counted, by month.

    The stated table completes block x months x checklists x species and then
    averages. Its row count per (block, species, month) is known without
    building it: one row for every checklist of the block that has no row for
    that species and month, plus the rows there are. So only counts are
    joined. The denominator is all checklists of the block in the season;
    ``per_month=True`` takes those of the month.
    """
    rows = in_season(x, season).filter(F.col(BLOCK).isNotNull())
    cell = [BLOCK, "common_name", "observation_month"]
    per_checklist = rows.groupBy(*cell, "checklist_id").agg(
        F.count("*").alias("rows"), F.count("observation_count").alias("observations")
    )
    cells = per_checklist.groupBy(*cell).agg(
        F.sum("rows").alias("rows"), F.sum("observations").alias("observations"), F.count("*").alias("with_rows")
    )
    scope = [BLOCK, "observation_month"] if per_month else [BLOCK]
    checklists = rows.select(*scope, "checklist_id").distinct().groupBy(*scope).agg(
        F.count("*").alias("checklist_count")
    )
    # the grid needs only the (block, species) pairs, which the small cell table already holds
    grid = species_month_grid(cells, season_months(season))
    filled = grid.join(cells, cell, "left").join(checklists, scope, "left" if per_month else "inner")
    n = F.coalesce("checklist_count", F.lit(0))
    seen = F.coalesce("observations", F.lit(0))
    total = n - F.coalesce("with_rows", F.lit(0)) + F.coalesce("rows", F.lit(0))
    return filled.select(
        *cell,
        seen.alias("observations"),
        n.alias("checklist_count"),
        F.try_divide(seen.cast("double"), total.cast("double")).alias("observed_pct"),
    )


def species_totals(expected: DataFrame) -> DataFrame:
    """Sums per species over all blocks and months."""
    return expected.groupBy("common_name").agg(
        F.sum("checklist_count").alias("checklist_count"), F.sum("observations").alias("observations")
    )


def weighted_presence(expected: DataFrame, blocks: DataFrame, species: str | Column, month: str) -> DataFrame:
    """Share x checklists per block for one species and month; the species may be a scalar subquery."""
    one = expected.filter((F.col("common_name") == species) & (F.col("observation_month") == month))
    return blocks.join(one, BLOCK, "inner").withColumn(
        "observed_pct_weighted", F.col("observed_pct") * F.col("checklist_count")
    )


def fit_beta_prior(df: DataFrame, x: str = "observations", n: str = "checklist_count") -> DataFrame:
    """Beta prior of the rates x/n by the method of moments: one row (alpha, beta, mean)."""
    rate = F.try_divide(F.col(x).cast("double"), F.col(n).cast("double"))
    moments = df.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("variance"))
    weight = F.col("mean") * (1 - F.col("mean")) / F.nullif("variance", F.lit(0.0)) - 1
    return moments.select(
        (F.col("mean") * weight).alias("alpha"), ((1 - F.col("mean")) * weight).alias("beta"), "mean"
    )


def shrink_rates(df: DataFrame, x: str = "observations", n: str = "checklist_count") -> DataFrame:
    """Add the raw rate, the rate shrunk to the prior, and the prior mean.

    The prior is one row; it enters as scalar subqueries, not as a join.
    """
    prior = fit_beta_prior(df, x, n)
    alpha, beta = prior.select("alpha").scalar(), prior.select("beta").scalar()
    return df.withColumns(
        {
            ".raw": F.try_divide(F.col(x).cast("double"), F.col(n).cast("double")),
            ".fitted": (alpha + F.col(x)) / (alpha + beta + F.col(n)),
            "prior_mean": prior.select("mean").scalar(),
        }
    )


@dataclass(frozen=True)
class BetaPrior:
    """A fitted beta prior and how it was found."""

    alpha: float
    beta: float
    steps: int

    @property
    def mean(self) -> float:
        return self.alpha / (self.alpha + self.beta)


def fit_beta_likelihood(df: DataFrame, x: str = "observations", n: str = "checklist_count", tolerance: float = 1e-10,
                        most_steps: int = 500, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> BetaPrior:
    """Beta prior of the rates x/n by the likelihood of the beta-binomial.

    The rows are counted once by (x, n); every step reads only those counts and
    brings five sums to the driver. Newton steps on both parameters, with a
    fixed-point step, which always climbs, where Newton would leave the
    positive numbers or the surface is not curved down. ``keep`` may write and
    reread the counts. An x above its n counts as n, a missing or negative x or
    n leaves the row out, and so does n = 0, which tells nothing.

    Raises ValueError where there is no maximum: rows are lacking, or all rates
    agree so well that the prior is ever narrower.
    """
    counts = df.filter((F.col(x) >= 0) & (F.col(n) > 0)).select(
        F.least(F.col(x), F.col(n)).cast("double").alias("x"), F.col(n).cast("double").alias("n"))
    counts = keep(counts.groupBy("x", "n").agg(F.count("*").cast("double").alias("w")))
    rate, w = F.col("x") / F.col("n"), F.col("w")
    total, mean, square = counts.agg(F.sum("w"), F.sum(w * rate), F.sum(w * rate * rate)).first()
    if not total:
        raise ValueError("no rates to fit a prior to")
    mean = mean / total
    spread = square / total - mean * mean
    if not 0 < mean < 1:
        raise ValueError("all rates are 0 or all are 1: the likelihood has no maximum")
    weight = min(max(mean * (1 - mean) / spread - 1, 0.1), 1e4) if spread > 0 else 1e4
    a, b = mean * weight, (1 - mean) * weight
    for step in range(1, most_steps + 1):
        fa, fb, fab = F.lit(a), F.lit(b), F.lit(a + b)
        y = F.col("n") - F.col("x")
        sums = counts.agg(
            F.sum(w * (digamma(F.col("x") + a) - digamma(fa))), F.sum(w * (digamma(y + b) - digamma(fb))),
            F.sum(w * (digamma(F.col("n") + (a + b)) - digamma(fab))), F.sum(w * (trigamma(F.col("x") + a) - trigamma(fa))),
            F.sum(w * (trigamma(y + b) - trigamma(fb))), F.sum(w * (trigamma(F.col("n") + (a + b)) - trigamma(fab)))).first()
        up_a, up_b, down, bend_a, bend_b, bend = sums
        slope_a, slope_b, h_a, h_b, h_ab = up_a - down, up_b - down, bend_a - bend, bend_b - bend, -bend
        determinant = h_a * h_b - h_ab * h_ab
        new_a, new_b = a * up_a / down, b * up_b / down
        if h_a < 0 and determinant > 0:
            newton_a = a - (h_b * slope_a - h_ab * slope_b) / determinant
            newton_b = b - (h_a * slope_b - h_ab * slope_a) / determinant
            if a / 4 < newton_a < 4 * a and b / 4 < newton_b < 4 * b:
                new_a, new_b = newton_a, newton_b
        moved = max(abs(new_a - a) / a, abs(new_b - b) / b)
        a, b = new_a, new_b
        if moved < tolerance:
            return BetaPrior(a, b, step)
        if a + b > 1e9:
            break
    raise ValueError("the likelihood of the prior has no maximum within reach")


def rate_intervals(df: DataFrame, prior: BetaPrior | None = None, x: str = "observations", n: str = "checklist_count",
                   level: float = 0.95) -> DataFrame:
    """Add ``.alpha1``, ``.beta1``, ``.fitted``, ``.low`` and ``.high``: each rate's posterior and its central interval.

    Without a prior that of the moments fit is taken. Many rows share an (x, n);
    each pair's interval is computed once and joined. A row without x or n, or
    whose x is above n by more than beta, has none.
    """
    if prior is None:
        fitted = fit_beta_prior(df, x, n)
        alpha, beta = fitted.select("alpha").scalar(), fitted.select("beta").scalar()
    else:
        alpha, beta = F.lit(prior.alpha), F.lit(prior.beta)
    pairs = df.select(F.col(x).alias("__x"), F.col(n).alias("__n")).distinct().dropna()
    posterior = pairs.withColumns({".alpha1": alpha + F.col("__x"), ".beta1": beta + F.col("__n") - F.col("__x")})
    a, b = F.col("`.alpha1`"), F.col("`.beta1`")
    # Dealt out by pair, since few rows carry much work.
    dealt = posterior.filter((a > 0) & (b > 0)).repartition("__x", "__n")
    tail = (1 - level) / 2
    bounds = dealt.withColumns({".fitted": a / (a + b), ".low": beta_quantile(tail, a, b), ".high": beta_quantile(1 - tail, a, b)})
    return df.join(bounds, (F.col(x) == F.col("__x")) & (F.col(n) == F.col("__n")), "left").drop("__x", "__n")
