"""Gamma and beta functions as column expressions.

All take and give doubles and stay in built-in functions. Arguments are first
moved up by recurrence, so that the asymptotic series hold to about 1e-13.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the asymptotic series, from the Bernoulli numbers.
LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)
SHIFT = 10
#: Places of the sum for a tail of the beta distribution, per unit of its variable.
PLACES_PER_UNIT = 8


def _series(z: Column, coefficients: tuple[float, ...], first_power: Column) -> Column:
    """first_power * (c0 + c1 / z^2 + c2 / z^4 ...)."""
    inverse = 1 / (z * z)
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * inverse + c
    return first_power * total


def _shifted_sum(x: Column, power: int) -> Column:
    """1 / x^power + ... + 1 / (x + SHIFT - 1)^power."""
    total = F.lit(0.0)
    for k in range(SHIFT):
        term = x + float(k)
        total = total + 1 / (term if power == 1 else term * term)
    return total


def digamma(x: Column) -> Column:
    """The derivative of ln gamma for positive x."""
    z = x + float(SHIFT)
    return F.ln(z) - 0.5 / z + _series(z, DIGAMMA_SERIES, 1 / (z * z)) - _shifted_sum(x, 1)


def trigamma(x: Column) -> Column:
    """The second derivative of ln gamma for positive x."""
    z = x + float(SHIFT)
    return 1 / z + 0.5 / (z * z) + _series(z, TRIGAMMA_SERIES, 1 / (z * z * z)) + _shifted_sum(x, 2)


def ln_gamma(x: Column) -> Column:
    """ln gamma for positive x."""
    z = x + float(SHIFT)
    product = F.lit(1.0)
    for k in range(SHIFT):
        product = product * (x + float(k))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + _series(z, LGAMMA_SERIES, 1 / z) - F.ln(product)


def ln_beta(a: Column, b: Column) -> Column:
    return ln_gamma(a) + ln_gamma(b) - ln_gamma(a + b)


def _tail_places() -> list[tuple[float, float]]:
    """Places and weights of a sum for the integral from 0 to infinity of functions that fall off exponentially.

    The double exponential rule: v -> exp(v - exp(-v)), evenly spaced in v.
    """
    spread = ((v, math.exp(v - math.exp(-v))) for v in (k / PLACES_PER_UNIT for k in range(-4 * PLACES_PER_UNIT, 8 * PLACES_PER_UNIT + 1)))
    return [(s, (1 + math.exp(-v)) * s / PLACES_PER_UNIT) for v, s in spread if s > 1e-18]


def _ln_beta_cdf(u: Column, a: Column, b: Column) -> Column:
    """(ln of the beta distribution function, ln of its slope in u) at x = 1 / (1 + exp(-u)).

    In u the density is log-concave and falls off exponentially on both sides,
    so the tail away from its mode is one sum over fixed places, scaled by the
    slope or the width of the density, however large a and b are.
    """
    left = u <= F.ln(a) - F.ln(b)
    turned = F.struct(F.when(left, a).otherwise(b).alias("a"), F.when(left, b).otherwise(a).alias("b"), F.when(left, u).otherwise(-u).alias("u"))
    places = F.expr("array(" + ", ".join(f"named_struct('s', {s!r}D, 'w', {w!r}D)" for s, w in _tail_places()) + ")")

    def scaled(t: Column) -> Column:
        p = 1 / (1 + F.exp(-t.u))
        steep = F.greatest(t.a - (t.a + t.b) * p, F.sqrt(t.a * t.b / (t.a + t.b)))
        softplus = F.greatest(t.u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t.u)))
        return F.struct(t.a.alias("a"), (t.a + t.b).alias("n"), p.alias("p"), (1 / steep).alias("unit"),
                        (t.a * t.u - (t.a + t.b) * softplus - ln_beta(t.a, t.b)).alias("slope"))

    def tail(t: Column) -> Column:
        def term(total: Column, place: Column) -> Column:
            s = t.unit * place.s
            return total + place.w * F.exp(-t.a * s - t.n * F.log1p(t.p * F.expm1(-s)))

        return F.struct((t.slope + F.ln(t.unit * F.aggregate(places, F.lit(0.0), term))).alias("tail"), t.slope.alias("slope"))

    found = F.transform(F.transform(F.transform(F.array(turned), scaled), tail), lambda t: F.struct(
        F.when(left, t.tail).otherwise(F.log1p(-F.least(F.exp(t.tail), F.lit(1 - 2.0**-53)))).alias("value"), t.slope.alias("slope")))
    return found[0]


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for x in [0, 1] and positive a and b."""
    inside = F.exp(_ln_beta_cdf(F.ln(x) - F.log1p(-x), a, b).getField("value"))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def beta_quantile(level: float, a: Column, b: Column, steps: int = 16) -> Column:
    """The x at which ``beta_cdf`` is ``level``, by Newton steps on the logarithm of the distribution function.

    That logarithm is concave in ln(x / (1 - x)): from the left no step goes
    too far, and a step from the right ends on the left. The work is the same
    for all a and b. Good to about 1e-10 for shapes of 0.05 and more, to 1e-6 for
    lesser ones.
    """
    if level > 0.5:
        return 1 - beta_quantile(1 - level, b, a, steps)
    wanted = math.log(level)
    # The greater of two starts, by the width of the density and by its left tail.
    start = F.greatest(F.ln(a) - F.ln(b) - 2 * F.sqrt(1 / a + 1 / b), (wanted + F.ln(a) + ln_beta(a, b)) / a)

    def step(u: Column, _: Column) -> Column:
        return F.transform(F.array(_ln_beta_cdf(u, a, b)), lambda at: u + (wanted - at.value) * F.exp(at.value - at.slope))[0]

    return 1 / (1 + F.exp(-F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)))
