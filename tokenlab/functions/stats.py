"""Exact binomial statistics, in built-in functions where there is a closed form, else in Arrow UDFs over summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.959963984540054
MARGINS = (0.10, 0.05, 0.02, 0.01)


def log_pmf(k: int, n: int, p: float) -> float:
    if p <= 0:
        return 0.0 if k == 0 else -math.inf
    if p >= 1:
        return 0.0 if k == n else -math.inf
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


#: Terms of a tail that are worked out together, and the share of its sum below which a last term ends it.
TERMS, NEGLIGIBLE = 4096, 1e-22


def _outward(k: int, n: int, p: float, step: int) -> float:
    """The probabilities of k, k + step, ... up to an end, summed; k has to lie on that side of the mean.

    There each term is a falling share of the one before, so about the root of n of them count, however large n is; the
    rest, below the sum's last bit, is left out.
    """
    first = math.exp(log_pmf(k, n, p))
    if not first or p <= 0 or p >= 1:
        return first
    end, total, term, at = (n if step > 0 else 0), 1.0, 1.0, k
    while at != end and term > NEGLIGIBLE * total:
        i = np.arange(at, at + step * min(TERMS, abs(end - at)), step, dtype=float)
        share = (n - i) * p / ((i + 1) * (1 - p)) if step > 0 else i * (1 - p) / ((n - i + 1) * p)
        terms = term * np.cumprod(share)
        total, term, at = total + float(terms.sum()), float(terms[-1]), at + step * len(i)
    return first * total


def cdf(k: int, n: int, p: float) -> float:
    """P(X <= k); the tail on k's side of the mean is summed."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return min(1.0, _outward(k, n, p, -1)) if k <= n * p else max(0.0, 1.0 - _outward(k + 1, n, p, 1))


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return min(1.0, _outward(k, n, p, 1)) if 0 < k <= n and k > n * p else max(0.0, 1.0 - cdf(k - 1, n, p))


def _solve(f, rising: bool) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if (f(middle) > 0) == rising:
            high = middle
        else:
            low = middle
    return (low + high) / 2


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Two-sided exact interval; (0, 1) for n = 0."""
    if n <= 0:
        return 0.0, 1.0
    low = 0.0 if k <= 0 else _solve(lambda p: _tail(k, n, p) - alpha / 2, True)
    high = 1.0 if k >= n else _solve(lambda p: cdf(k, n, p) - alpha / 2, False)
    return low, high


def upper_bound(k: int, n: int, alpha: float = 0.05) -> float:
    """One-sided exact upper bound; NaN for n = 0."""
    if n <= 0:
        return math.nan
    return 1.0 if k >= n else _solve(lambda p: cdf(k, n, p) - alpha, False)


def mcnemar(only_a: int, only_b: int) -> float | None:
    """Two-sided exact p over the discordant pairs; None without any."""
    n = only_a + only_b
    return None if not n else min(1.0, 2 * cdf(min(only_a, only_b), n, 0.5))


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def interval_udf(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["low", "high"])


@F.pandas_udf(T.DoubleType())
def upper_udf(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([upper_bound(int(a), int(b)) for a, b in zip(k, n, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def mcnemar_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([mcnemar(int(x), int(y)) for x, y in zip(a, b, strict=True)], dtype=float)


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """Struct low, high, within [0, 1]; nulls where n <= 0 or k is outside 0..n."""
    k, n = k.cast("double"), n.cast("double")
    good = (n > 0) & (k >= 0) & (k <= n)
    safe = F.when(good, n)
    p, zz = k / safe, z * z
    middle, half, scale = p + zz / (2 * safe), z * F.sqrt(p * (1 - p) / safe + zz / (4 * safe * safe)), 1 + zz / safe
    return F.struct(F.greatest(F.lit(0.0), (middle - half) / scale).alias("low"), F.when(good, F.least(F.lit(1.0), (middle + half) / scale)).alias("high"))


def upper_zero(n: Column, alpha: float = 0.05) -> Column:
    """One-sided bound with no event: 1 - alpha**(1/n); null for n <= 0."""
    return F.when(n > 0, 1 - F.pow(F.lit(alpha), 1 / n.cast("double")))


def planned_upper(n: Column, alpha: float = 0.05) -> Column:
    """Two-sided bound with no event; 1 if n <= 0."""
    return F.when(n > 0, 1 - F.pow(F.lit(alpha / 2), 1 / n.cast("double"))).otherwise(F.lit(1.0))


def detectable(n: Column, power: float = 0.8) -> Column:
    """The rate at which one event at least is seen with the given power."""
    return F.when(n > 0, 1 - F.pow(F.lit(1 - power), 1 / n.cast("double")))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for 0 <= k <= n by the ratio of neighbouring terms, in built-in functions.

    Terms are summed relative to the first, in log space, so that large n don't underflow.
    """
    odds = math.log(p / (1 - p))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    first = n.cast("double") * math.log1p(-p)
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.ln((n - i + 1).cast("double") / i.cast("double")) + odds
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    return F.when(k >= n, F.lit(1.0)).when(k < 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.aggregate(steps, start, add)["sum"]))


def mcnemar_native(only_a: Column, only_b: Column) -> Column:
    n, low = only_a + only_b, F.least(only_a, only_b)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * binomial_cdf(low, n, 0.5)))


def tally_bootstrap(values: np.ndarray, counts: np.ndarray, draws: int = 10_000, seed: int = 42, alpha: float = 0.05) -> tuple[float, float, float]:
    """Percentile interval of the mean of values that occur so often, and the share of draws at or below zero.

    Draws with replacement, by their counts of each value; blocks of draws bound memory.
    """
    total = int(counts.sum())
    if not total:
        return math.nan, math.nan, math.nan
    rng, means = np.random.default_rng(seed), []
    block = max(1, (1 << 22) // len(values))
    for at in range(0, draws, block):
        means.append(rng.multinomial(total, counts / total, size=min(block, draws - at)) @ values / total)
    means = np.concatenate(means)
    low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high), float((means <= 0).mean())


def paired_bootstrap(differences: np.ndarray, draws: int = 10_000, seed: int = 42, alpha: float = 0.05) -> tuple[float, float, float]:
    """tally_bootstrap of single differences."""
    return tally_bootstrap(*np.unique(differences, return_counts=True), draws, seed, alpha)


def shown(low: Column, high: Column, decimals: int = 3) -> Column:
    """An interval as text: [0.123,0.456]."""
    return F.format_string(f"[%.{decimals}f,%.{decimals}f]", low, high)
