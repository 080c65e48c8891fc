"""Formulas of power and interval estimates, as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963985


def z(p: float) -> float:
    return NormalDist().inv_cdf(p)


def multiplier(alpha: float = 0.05, power: float = 0.80) -> float:
    return z(1 - alpha / 2) + z(power)


def _checked(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def design_effect(m_bar: Column, icc: Column | float, cv: Column | float = 0.0) -> Column:
    """1 + ((CV^2 + 1) m - 1) ICC; a mean cluster size that isn't positive is an error."""
    icc, cv = (x if isinstance(x, Column) else F.lit(x) for x in (icc, cv))
    return _checked(m_bar > 0, 1 + ((cv * cv + 1) * m_bar - 1) * icc, "mean cluster size must be positive")


def effective_n(n: Column, response: Column, deff: Column) -> Column:
    return n * response / deff


def mde(sum_inverse_n: Column, alpha: float = 0.05, power: float = 0.80) -> Column:
    """Smallest detectable effect from the sum of 1 / effective n over the cells of a contrast."""
    return F.lit(multiplier(alpha, power)) * F.sqrt(sum_inverse_n)


def required_n(target: Column, deff: Column, response: Column | float = 0.55, alpha: float = 0.05, power: float = 0.80) -> Column:
    """Reviews per cell, of four equal cells, to detect `target`."""
    response = response if isinstance(response, Column) else F.lit(response)
    ratio = F.lit(multiplier(alpha, power)) / target
    return 4 * deff * ratio * ratio / response


def scatter(jeans: Column, shirt: Column, tshirt: Column) -> Column:
    """Sum of squared deviations of the classes' positions 0, 1, 2; 0 without observations."""
    n = jeans + shirt + tshirt
    mean = (shirt + 2 * tshirt) / n
    return F.when(n > 0, jeans * mean * mean + shirt * (1 - mean) * (1 - mean) + tshirt * (2 - mean) * (2 - mean)).otherwise(0.0)


def trend_mde(deff: Column, s_men: Column, s_women: Column, per_step: bool = False) -> Column:
    """Smallest detectable difference in trend, per step or over both steps; an error where a gender has no spread."""
    one = F.lit(multiplier()) * F.sqrt(deff * (1 / s_men + 1 / s_women))
    return _checked((s_men > 0) & (s_women > 0), one if per_step else 2 * one, "no spread across the classes")


def within_mde(deff: Column, s: Column) -> Column:
    """Smallest detectable trend within one gender, per step; null without spread."""
    return F.when(s > 0, F.lit(multiplier()) * F.sqrt(deff / s))


def pooled_span(jeans: Column, shirt: Column, tshirt: Column) -> Column:
    """Steps between upper and lower when the upper classes are pooled."""
    upper = shirt + tshirt
    return F.when(upper > 0, (shirt + 2 * tshirt) / upper).otherwise(0.0)


def wilson(hits: Column, n: Column, zed: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a share; (0, 1) without trials."""
    p, zz = hits / n, zed * zed
    centre = p + zz / (2 * n)
    half = F.lit(zed) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - half) / (1 + zz / n)))
    high = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), (centre + half) / (1 + zz / n)))
    return low, high


def gate(low: Column, high: Column, at: float = 0.80) -> Column:
    """PASS when the whole interval is at `at` or above, FAIL when below, else INCONCLUSIVE."""
    return F.when(low >= at, "PASS").when(high < at, "FAIL").otherwise("INCONCLUSIVE")


def multiplier_to(current: Column, target: Column | float) -> Column:
    """How many times the observations are needed for the detectable effect `current` to come down to `target`."""
    return F.pow(current / (target if isinstance(target, Column) else F.lit(target)), F.lit(2.0))


# Fixed value: reviews of the whole corpus.
CORPUS_REVIEWS = 66e6


def scale_factor(scanned: Column) -> Column:
    """How many times larger the corpus is than what was scanned; null where nothing was."""
    return F.when(scanned > 0, F.lit(CORPUS_REVIEWS) / scanned)
