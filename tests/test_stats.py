"""Golden arithmetic of the published counts, and agreement of native and Python forms."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlab.functions import stats
from tokenlab.operators import resample
from tokenlab.plans import numbers

# Published: eligible, events, two-sided 95 % interval, to six decimals.
INTERVALS = [(3168, 150, 0.040216, 0.055331), (3168, 149, 0.039924, 0.054992), (3168, 1, 0.000008, 0.001757), (3994, 20, 0.003061, 0.007723), (3994, 0, 0.0, 0.000923)]
# Published: eligible, events, one-sided upper bound and detectable rate, to six decimals.
BOUNDS = [(52, 0, 0.055982, 0.030477), (1851, 0, 0.001617, 0.000869), (115, 0, 0.025713, 0.013898), (240, 0, 0.012405, 0.006684), (509, 0, 0.005868, 0.003157), (3168, 1, 0.001497, 0.000508), (24, 0, 0.117346, 0.064861), (115, 1, 0.040586, 0.013898)]
# Published: discordant pairs (all on one side, or one on the other) and p.
MCNEMAR = [(5, 0, 0.0625), (36, 0, 2.91038e-11), (20, 0, 1.90735e-06), (150, 1, 1.06499e-43), (3, 0, 0.25)]


@pytest.mark.parametrize(("n", "k", "low", "high"), INTERVALS)
def test_published_intervals(n, k, low, high):
    assert stats.clopper_pearson(k, n) == pytest.approx((low, high), abs=6e-7)


@pytest.mark.parametrize(("n", "k", "upper", "least"), BOUNDS)
def test_published_bounds(spark, n, k, upper, least):
    assert stats.upper_bound(k, n) == pytest.approx(upper, abs=6e-7)
    row = spark.range(1).select(stats.detectable(F.lit(n)).alias("d"), stats.upper_zero(F.lit(n)).alias("z")).first()
    assert row["d"] == pytest.approx(least, abs=6e-7)
    if not k:
        assert row["z"] == pytest.approx(upper, abs=6e-7)


@pytest.mark.parametrize(("a", "b", "p"), MCNEMAR)
def test_published_mcnemar(spark, a, b, p):
    assert stats.mcnemar(a, b) == pytest.approx(p, rel=1e-5)
    assert spark.range(1).select(stats.mcnemar_native(F.lit(a), F.lit(b))).first()[0] == pytest.approx(p, rel=1e-5)


def test_edges(spark):
    assert stats.clopper_pearson(0, 0) == (0, 1) and stats.clopper_pearson(5, 5)[1] == 1 and stats.clopper_pearson(0, 5)[0] == 0
    assert math.isnan(stats.upper_bound(0, 0)) and stats.mcnemar(0, 0) is None
    r = spark.createDataFrame([(0, 0), (0, 5), (5, 5), (6, 5)], "k long, n long").select("k", "n", stats.wilson(F.col("k"), F.col("n")).alias("w"), stats.upper_zero(F.col("n")).alias("z"), stats.planned_upper(F.col("n")).alias("p")).collect()
    assert r[0]["w"]["high"] is None and r[0]["z"] is None and r[0]["p"] == 1.0
    assert r[1]["w"]["low"] == 0.0 and r[2]["w"]["high"] == 1.0 and r[3]["w"]["high"] is None


def test_tails_are_all_terms_summed():
    whole = lambda k, n, p: math.fsum(math.exp(stats.log_pmf(i, n, p)) for i in range(k + 1))
    for n, ps in ((1, (0.0, 0.3, 1.0)), (7, (0.0, 0.01, 0.5, 0.99, 1.0)), (9000, (0.001, 0.4, 0.999))):
        for p in ps:
            for k in {0, 1, n // 3, int(n * p), min(n, int(n * p) + 1), n - 1, n}:
                assert stats.cdf(k, n, p) == pytest.approx(whole(k, n, p), abs=1e-9)
                assert stats._tail(k, n, p) == pytest.approx(1 - whole(k - 1, n, p), abs=1e-9)


def test_bounds_of_large_counts_work_out_few_terms(monkeypatch):
    """A bound may take no term for each event: 50 halvings would repeat them all."""
    seen, real = [], stats.log_pmf
    monkeypatch.setattr(stats, "log_pmf", lambda *x: seen.append(x) or real(*x))
    for k, n in ((60_000, 200_000), (140_000, 200_000)):
        low, high = stats.clopper_pearson(k, n)
        half = stats.Z95 * math.sqrt(k * (n - k) / n**3)
        assert (k / n - low, high - k / n) == pytest.approx((half, half), rel=0.01) and stats.upper_bound(k, n) < high
    assert len(seen) < 1000
    low, high = stats.clopper_pearson(7_000_000, 20_000_000)
    assert stats._tail(7_000_000, 20_000_000, low) == pytest.approx(0.025, rel=1e-6) == stats.cdf(7_000_000, 20_000_000, high)


def test_native_cdf_is_the_python_one(spark):
    cases = [(k, n, p) for n in (1, 5, 40, 900) for k in (0, 1, n // 2, n) for p in stats.MARGINS]
    for p in stats.MARGINS:
        rows = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long").select("k", "n", stats.binomial_cdf(F.col("k"), F.col("n"), p).alias("c")).collect()
        for r in rows:
            assert r["c"] == pytest.approx(stats.cdf(r["k"], r["n"], p), abs=1e-9)


def test_bootstraps_are_deterministic(spark):
    d = np.array([0, 1, 1, -1, 0, 0, 1, 0], dtype=float)
    assert stats.paired_bootstrap(d, 2000) == stats.paired_bootstrap(d, 2000)
    f = spark.range(200).select((F.col("id") % 3).alias("v"))
    one = sorted(map(tuple, resample.hash_bootstrap(f, 20, 1, "v").collect()))
    assert one == sorted(map(tuple, resample.hash_bootstrap(f.repartition(7), 20, 1, "v").collect()))
    assert 150 < sum(r[1] for r in one) / 20 < 250


def poisson_quantile(u, mean):
    k, p = 0, math.exp(-mean)
    total = p
    while u >= total and k < 500:
        k += 1
        p *= mean / k
        total += p
    return k


def test_hash_bootstrap_of_all_draws(spark):
    """Every draw of a small table, against plain quantiles; groups, nulls and doubles too."""
    rows = [(1, 1, 0.5), (1, 1, 0.5), (1, 1, 0.5), (1, -1, None), (2, 0, 0.25), (2, 1, 2.0), (1, None, 1.0)]
    f = spark.createDataFrame(rows, "g int, v int, x double")
    got = {(r["g"], r["draw"]): (r["n"], r["v"], r["x"]) for r in resample.hash_bootstrap(f, resample.DRAWS, 9, "v", "x", by=("g",)).collect()}
    size = {}
    for r in rows:
        size[r] = size.get(r, 0) + 1

    def weight(d, r):
        key = "|".join("null" if x is None else str(x) for x in r)
        u = int(hashlib.sha256(f"9|{d}|{key}".encode()).hexdigest()[:12], 16) / (1 << 48)
        return poisson_quantile(u, size[r])

    assert len(got) == 2 * resample.DRAWS
    for (g, d), (n, v, x) in got.items():
        own = [(weight(d, r), r[1], r[2]) for r in size if r[0] == g]
        assert (n, v) == (sum(w for w, *_ in own), sum(w * (a or 0) for w, a, _ in own)) and x == pytest.approx(sum(w * (b or 0) for w, _, b in own))


def test_classes_weigh_what_their_rows_do(spark):
    """The interval of a ratio over clusters against resampling rows one by one."""
    rng = np.random.default_rng(5)
    e = rng.integers(0, 4, 900)
    k = rng.binomial(e, 0.3)
    f = spark.createDataFrame([(int(a), int(b)) for a, b in zip(e, k, strict=True)], "e int, k int")
    r = resample.percentile_interval(resample.hash_bootstrap(f, 4000, 3, "e", "k").withColumn("ratio", F.col("k") / F.col("e")), "ratio").first()
    at = rng.integers(0, len(e), (4000, len(e)))
    low, high = np.quantile(k[at].sum(axis=1) / e[at].sum(axis=1), [0.025, 0.975])
    assert (r["low"], r["high"]) == pytest.approx((low, high), abs=0.004) and r["draws"] == 4000
    low, high, p = stats.tally_bootstrap(*np.unique((k - 1).astype(float), return_counts=True), 4000)
    want = np.quantile((k - 1)[at].mean(axis=1), [0.025, 0.975])
    assert (low, high) == pytest.approx(tuple(want), abs=0.01) and 0 <= p <= 1


@pytest.mark.parametrize("name", ["hash_bootstrap_ci", "cluster_bootstrap_hash"])
def test_registered_bootstraps_make_all_draws(spark, name):
    assert numbers.QUERIES[name](spark, "/root/testdata/sf0.001").first()["draws"] == 10_000


def test_seed_summaries_guard_their_input(spark):
    rows = [(p, s, int((p + s) % 3 == 0), 1) for p in range(30) for s in (1, 2, 3)]
    make = lambda r: spark.createDataFrame(r, "problem_id int, seed int, k int, e int")
    got = {r["scope"]: r for r in resample.seed_summary(make(rows), "k", "e", draws=200).collect()}
    assert set(got) == {"all_seeds", "leave_out:1", "leave_out:2", "leave_out:3"} and got["all_seeds"]["estimate"] == pytest.approx(1 / 3, abs=1e-6) and got["all_seeds"]["binomial_wilson95_lower"] is not None
    signed = make([(p, s, k - 1, e) for p, s, k, e in rows])
    assert resample.seed_summary(signed, "k", draws=50).first()["binomial_wilson95_lower"] is None
    for bad, kind in ((rows + rows[:1], "auto"), (rows[1:], "auto"), ([(p, s, 2 * k, e) for p, s, k, e in rows], "binary"), ([(p, s, k, -e) for p, s, k, e in rows], "auto"), ([(p, s, k, 0) for p, s, k, e in rows], "auto"), ([(p, s, None, e) for p, s, k, e in rows], "auto")):
        with pytest.raises(ValueError):
            resample.seed_summary(make(bad), "k", "e", kind, draws=5)


def test_pooled_rates_use_the_pooled_denominator(spark):
    rows = [(1, 1, 1, 1), (2, 1, 0, 0), (1, 2, 1, 3), (2, 2, 0, 0)]
    r = resample.seed_summary(spark.createDataFrame(rows, "problem_id int, seed int, k int, e int"), "k", "e", "nonbinary", draws=50).filter("scope = 'all_seeds'").first()
    assert r["estimate"] == 0.5


def test_registered_numpy_bootstrap_makes_all_draws(spark, monkeypatch):
    made = []
    monkeypatch.setattr(resample, "bootstrap_numpy", lambda *a, draws=10_000, **k: made.append(draws))
    numbers.bootstrap_numpy(spark, "/root/testdata/sf0.001")
    assert made == [10_000]
