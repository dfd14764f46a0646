"""Exact subsets of chains, split nulls, factorial effects and bootstraps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import combinations
from math import comb, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from . import vote
from .attribution import over_all, rate

#: Lists of subsets are formed for so many chains at most; audits count subsets and have no limit.
MOST_CHAINS = 8
#: Draws of the registered bootstraps.
DRAWS = 10_000
#: Groups whose sums by draw a task holds before it gives them out.
GROUPS_HELD = 64


def subsets(n: int, k: int) -> list[list[int]]:
    """All k-subsets of 0..n-1 in lexicographic order."""
    if n > MOST_CHAINS:
        raise ValueError(f"{n} chains: exact subsets are for {MOST_CHAINS} at most")
    return [list(c) for c in combinations(range(n), k)]


def subset_counts(wrong_right: tuple[tuple[int, int], ...], silent: int, k: int) -> tuple[int, int, int, int, int]:
    """All k-subsets of chains, and those whose vote is correct, a tie, lower, upper (see vote.plurality).

    wrong_right: numbers of wrong and of right chains per answer, in order of the answers; silent: chains without an
    answer. Subsets are counted answer by answer, by what decides the vote, so none is formed and n has no limit.
    """
    # Chains taken, votes of the leading answers, the first of them right, all, one, several of them -> subsets.
    ways = {(0, 0, False, False, False, False): 1}
    for wrong, right in wrong_right:
        new: dict[tuple[int, int, bool, bool, bool, bool], int] = {}
        for (taken, most, first, low, high, tie), n in ways.items():
            for t in range(min(wrong + right, k - taken) + 1):
                failed = comb(wrong, t)
                for ok, m in ((False, failed), (True, comb(wrong + right, t) - failed)):
                    if m:
                        led = (first, low, high, tie) if t < most or not t else (first, low and ok, high or ok, True) if t == most else (ok, ok, ok, False)
                        key = (taken + t, max(most, t), *led)
                        new[key] = new.get(key, 0) + n * m
        ways = new
    out = [0] * 5
    for (taken, _, first, low, high, tie), n in ways.items():
        n *= comb(silent, k - taken)
        for i, holds in enumerate((True, first, tie, low, high)):
            out[i] += n * holds
    return tuple(out)


def subset_audit(frame: DataFrame, chains: str, ks: tuple[int, ...]) -> DataFrame:
    """Per problem and k: means over all C(n, k) subsets of the vote's correct, tie, lower, upper.

    Exact for any number of chains, without a shuffle; k above a problem's number of chains give no row.
    """
    rows = frame.select("problem_id", "dataset", F.transform(chains, lambda c: c["answer"].cast("string")).alias("answers"), F.transform(chains, lambda c: c["correct"]).alias("right"))
    names = ("accuracy", "tie_rate", "acc_lower", "acc_upper")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("k", T.IntegerType(), False), T.StructField("n_subsets", T.LongType(), False), *(T.StructField(c, T.DoubleType(), False) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = lru_cache(1 << 16)(subset_counts)
        for batch in batches:
            place, found = [], []
            for i, (answers, right) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                by: dict[str, list[int]] = {}
                for a, ok in zip(answers or (), right or (), strict=True):
                    if a is not None:
                        by.setdefault(a, [0, 0])[bool(ok)] += 1
                n, profile = len(answers or ()), tuple((w, r) for _, (w, r) in sorted(by.items()))
                silent = n - sum(w + r for w, r in profile)
                for k in ks if answers is not None else ():
                    if k <= n:
                        every, *some = counts(profile, silent, k)
                        place.append(i)
                        found.append((k, every, *(x / every for x in some)))
            own = [batch.column(j).take(pa.array(place, pa.int64())) for j in range(2)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[j] for r in found], t) for j, t in enumerate((pa.int32(), pa.int64(), *[pa.float64()] * 4)))], names=schema.names)

    return rows.mapInArrow(run, schema).select("problem_id", "dataset", "k", "n_subsets", *[F.round(c, 6).alias(c) for c in names])


def subset_summary(audit: DataFrame) -> DataFrame:
    return over_all(audit, ["k"], F.count(F.lit(1)).alias("n_problems"), *[F.round(F.avg(c), 6).alias(c) for c in ("accuracy", "tie_rate", "acc_lower", "acc_upper")])


def of_problems(frame: DataFrame, chains: str, n: int) -> DataFrame:
    """The problems that have n chains."""
    return frame.filter(F.size(chains) == n)


def split_null(frame: DataFrame, chains: str, k: int) -> DataFrame:
    """All splits of 2k chains into selector and control: how often a failed selector comes with a right control.

    Every problem has to have 2k chains: another number raises an error where the row is read (with
    of_problems(..., 2k) others are left out knowingly). Assignments are numbered in lexicographic order.
    """
    sets = subsets(2 * k, k)
    wrong = F.raise_error(F.concat(F.lit("a split needs "), F.lit(2 * k), F.lit(" chains, problem "), F.col("problem_id").cast("string"), F.lit(" has "), F.size(chains).cast("string")))
    pairs = F.array(*[F.struct(F.lit(i).alias("assignment"), F.lit(",".join(map(str, s))).alias("selector_indices"), F.array(*[F.lit(x) for x in s]).alias("s"), F.array(*[F.lit(x) for x in range(2 * k) if x not in s]).alias("c")) for i, s in enumerate(sets)])
    rows = frame.select(F.when(F.size(chains) == 2 * k, F.col(chains)).otherwise(wrong).alias(chains), F.explode(pairs).alias("p")).select(chains, "p.*")
    pick = lambda name: F.transform(name, lambda i: F.col(chains)[i])
    rows = rows.select("assignment", "selector_indices", vote.eligibility(pick("s"))["strict_all_wrong"].alias("e"), vote.plurality(pick("c"))["correct"].alias("r"))
    out = rows.groupBy("assignment", "selector_indices").agg(F.count_if("e").alias("n_eligible"), F.count_if(F.col("e") & F.col("r")).alias("repair_count"))
    return out.withColumn("repair_rate", rate(F.col("repair_count"), F.col("n_eligible")))


def factorial(frame: DataFrame, base: str, extended: str) -> DataFrame:
    """Accuracy by dataset, budget and k in (1, max): one chain at random, and the vote of all."""
    rows = frame.select("dataset", F.explode(F.array(*[F.struct(F.lit(n).alias("budget"), F.col(c).alias("ch")) for n, c in (("base", base), ("extended", extended))])).alias("b")).select("dataset", "b.*")
    cells = rows.select("dataset", "budget", F.explode(F.array(F.struct(F.lit("1").alias("k"), vote.pass_at_1(F.col("ch")).alias("x")), F.struct(F.lit("max").alias("k"), vote.plurality("ch")["correct"].cast("double").alias("x")))).alias("c")).select("dataset", "budget", "c.*")
    return over_all(cells, ["budget", "k"], F.round(F.avg("x"), 6).alias("accuracy"))


def factorial_effects(cells: DataFrame) -> DataFrame:
    cell = lambda b, k: F.max(F.when((F.col("budget") == b) & (F.col("k") == k), F.col("accuracy")))
    wide = cells.groupBy("dataset").agg(cell("base", "1").alias("b1"), cell("base", "max").alias("bm"), cell("extended", "1").alias("e1"), cell("extended", "max").alias("em"))
    r = lambda x: F.round(x, 6)
    f = F.col
    return wide.select("dataset", r(f("e1") - f("b1")).alias("token_effect_k1"), r(f("em") - f("bm")).alias("token_effect_kmax"), r(f("bm") - f("b1")).alias("chain_effect_base"), r(f("em") - f("e1")).alias("chain_effect_extended"), r((f("em") - f("bm")) - (f("e1") - f("b1"))).alias("interaction"))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of sha256 of the parts, joined by '|'; the same in any engine."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


#: Standard deviations of a Poisson count that thresholds cover on either side, and counts beside these.
SPREAD, MARGIN = 12, 20


def poisson_steps(n: int) -> tuple[int, np.ndarray]:
    """The least count considered, and the distribution function of a Poisson count of mean n from there on."""
    low = max(0, int(n - SPREAD * n**0.5 - MARGIN))
    k = np.arange(low + 1, int(n + SPREAD * n**0.5 + MARGIN) + 1)
    first = -n + low * log(n) - lgamma(low + 1)
    return low, np.cumsum(np.exp(np.concatenate(([first], first + np.cumsum(log(n) - np.log(k))))))


def hash_bootstrap(values: DataFrame, draws: int, seed: int, *sums: str, by: tuple[str, ...] = ()) -> DataFrame:
    """draw, n and weighted sums per draw, over rows that each count Poisson(1) times.

    One row per unit that is resampled: a problem, or a cluster with its sums. Rows with equal values are one class,
    and a class of n rows weighs Poisson(n) in a draw, which is what its rows' weights come to; so the work grows with
    classes and draws, not with rows. The count is the quantile of a uniform number from the sha256 of seed, draw and
    the class's values: the same wherever it runs, in any engine. Integers are summed as long, others as double; a
    null adds nothing. Every task sums all draws over its classes and holds one sum per draw for GROUPS_HELD groups.
    """
    names = [*by, "draw", "n", *sums]
    classes = values.groupBy(*by, *[F.col(c).alias(f"__s{i}") for i, c in enumerate(sums)]).agg(F.count(F.lit(1)).alias("__n"))
    kinds = [classes.schema[f"__s{i}"].dataType for i in range(len(sums))]
    if any(not isinstance(t, (T.IntegralType, T.FractionalType)) or isinstance(t, T.DecimalType) for t in kinds):
        raise TypeError("sums are of integers or doubles")
    whole = [isinstance(t, T.IntegralType) for t in kinds]
    keyed = classes.select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (*by, *(f"__s{i}" for i in range(len(sums))))]).alias("__key"), *classes.columns)
    schema = T.StructType([*(keyed.schema[c] for c in by), T.StructField("draw", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.LongType() if w else T.DoubleType()) for c, w in zip(sums, whole, strict=True))])
    prefixes = [f"{seed}|{d}|".encode() for d in range(draws)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, list[np.ndarray]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for group, (n, totals) in held.items():
                own = [pa.array([v] * draws, batch.column(1 + i).type) for i, v in enumerate(group)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(range(draws), pa.int32()), pa.array(n), *map(pa.array, totals)], names=names)
            held.clear()

        for batch in batches:
            for key, *rest, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                group, own = tuple(rest[: len(by)]), rest[len(by) :]
                if group not in held:
                    if len(held) >= GROUPS_HELD:
                        yield from out()
                    held[group] = np.zeros(draws, np.int64), [np.zeros(draws, np.int64 if w else float) for w in whole]
                digests = b"".join([sha256(p + key.encode()).digest() for p in prefixes])
                uniform = (np.frombuffer(digests, ">u8")[::4] >> np.uint64(16)).astype(float) / (1 << 48)
                low, steps = poisson_steps(size)
                weight = low + np.searchsorted(steps, uniform, side="right")
                n, totals = held[group]
                n += weight
                for t, v in zip(totals, own, strict=True):
                    if v is not None:
                        t += weight * v
        yield from out()

    return keyed.mapInArrow(run, schema).groupBy(*by, "draw").agg(F.sum("n").cast("long").alias("n"), *[F.sum(s).alias(s) for s in sums])


def percentile_interval(draws: DataFrame, value: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """Exact percentiles (linear interpolation) of a statistic over draws."""
    q = lambda p: F.round(F.percentile(F.col(value).cast("double"), F.lit(p)), 6)
    return draws.groupBy(*by).agg(F.count(value).alias("draws"), q(alpha / 2).alias("low"), q(1 - alpha / 2).alias("high"))


def sampling_intervals(detail: DataFrame, by: str = "dataset") -> DataFrame:
    """dataset, measure, k, n and ci95 (exact, as text): help and harm by vote of all, repairs of complete wrong ones."""
    measures = {"helpful_maj": (F.col("helpful_maj"), F.lit(True)), "harm_maj": (F.col("harm_maj"), F.lit(True)), "repair_rate_maj": (F.col("repaired_maj"), F.col("base_complete_wrong")), "repair_rate_any": (F.col("repaired_any"), F.col("base_complete_wrong"))}
    rows = detail.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), k.alias("hit"), n.alias("inside")) for m, (k, n) in measures.items()])).alias("m")).select(by, "m.*")
    sums = over_all(rows, ["measure"], F.count_if(F.col("hit") & F.col("inside")).alias("k"), F.count_if("inside").alias("n"), by=by)
    return sums.withColumn("ci", stats.interval_udf(F.col("k"), F.col("n"))).select(by, "measure", "k", "n", stats.shown(F.col("ci.low"), F.col("ci.high")).alias("ci95"))


def sampling_bootstrap(detail: DataFrame, draws: int = DRAWS, seed: int = 42, by: str = "dataset") -> DataFrame:
    """dataset, measure, delta and ci95 (bootstrap over problems, as text) of the changes of pass@1 and of the vote."""
    deltas = {"maj_acc_delta": F.col("ext_maj_correct").cast("double") - F.col("base_maj_correct").cast("double"), "pass1_delta": F.col("ext_pass1") - F.col("base_pass1")}
    both = F.array(*[F.struct(F.lit(m).alias("measure"), d.alias("d")) for m, d in deltas.items()])
    rows = detail.select(F.explode(F.array(F.lit("all"), F.col(by))).alias(by), both.alias("m")).select(by, F.explode("m").alias("m")).select(by, "m.*").filter("d is not null")
    drawn = hash_bootstrap(rows, draws, seed, "d", by=(by, "measure")).withColumn("mean", F.col("d") / F.col("n"))
    ci = drawn.groupBy(by, "measure").agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return rows.groupBy(by, "measure").agg(F.round(F.avg("d"), 6).alias("delta")).join(ci, [by, "measure"]).select(by, "measure", "delta", stats.shown(F.col("low"), F.col("high")).alias("ci95"))


def bootstrap_numpy(frame: DataFrame, a: str, b: str, by: str, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """Paired bootstrap of the mean of b - a by group: rows drawn with replacement, as many as there are.

    Only how often each difference occurs matters, so rows are counted by difference first and numpy draws the counts
    (multinomial). A group with as many differences as rows is still one task's, in blocks of draws.
    """
    tally = frame.select(by, (F.col(b).cast("double") - F.col(a).cast("double")).alias("d")).filter("d is not null").groupBy(by, "d").agg(F.count(F.lit(1)).alias("m"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        d, m = pdf["d"].to_numpy(), pdf["m"].to_numpy()
        low, high, p = stats.tally_bootstrap(d, m, draws, seed)
        return pd.DataFrame([(key[0], int(m.sum()), float(d @ m / m.sum()), low, high, p)], columns=[by, "n", "delta", "low", "high", "p_le_zero"])

    return tally.groupBy(by).applyInPandas(run, f"{by} string, n long, delta double, low double, high double, p_le_zero double")


def seed_summary(rows: DataFrame, metric: str, denominator: str | None = None, kind: str = "auto", draws: int = DRAWS, seed: int = 42, key: str = "problem_id", label: str = "seed") -> DataFrame:
    """A row for all seeds and, of several, one per omitted seed: counts, the pooled estimate and two intervals.

    rows: one per problem and seed. The estimate is the sum of the metric over that of the denominator, or over the
    rows without one. cluster_ci95: percentiles of a bootstrap over problems with all their seeds; wilson95: only for
    a binary metric. kind: binary, nonbinary (signed effects), or auto, by the values. Refused: null or non-finite
    values, repeated problems of a seed, seeds with other problems, a metric declared binary that is not, a negative
    denominator, and a binary metric above its denominator.
    """
    if kind not in ("auto", "binary", "nonbinary"):
        raise ValueError(f"unknown kind {kind!r}")
    num, den = F.col(metric).cast("double"), F.lit(1.0) if denominator is None else F.col(denominator).cast("double")
    own = rows.select(F.col(key).alias("__key"), F.col(label).alias("__seed"), num.alias("__num"), den.alias("__den"))
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    per = own.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__seed").alias("seeds"))
    seen = own.agg(F.count(F.lit(1)).alias("n"), F.count_if(~(good("__num") & good("__den"))).alias("odd"), F.coalesce(F.min("__den"), F.lit(0.0)).alias("least"), F.count_if(~F.col("__num").isin(0.0, 1.0)).alias("other"), F.count_if(F.col("__num") > F.col("__den")).alias("above"), F.sort_array(F.collect_set("__seed")).alias("labels")).first()
    labels = seen["labels"]
    if not seen["n"] or seen["odd"]:
        raise ValueError(f"{metric}: no rows" if not seen["n"] else f"{seen['odd']} values that are null or not finite")
    if bad := per.filter((F.col("n") != F.col("seeds")) | (F.col("seeds") != len(labels))).limit(5).collect():
        raise ValueError(f"problems repeated in a seed, or that a seed lacks: {[r['__key'] for r in bad]}")
    if denominator is not None and seen["least"] < 0:
        raise ValueError(f"{denominator} must not be negative")
    if kind == "binary" and seen["other"]:
        raise ValueError(f"{metric} was declared binary but has other values")
    binary = kind == "binary" or (kind == "auto" and not seen["other"])
    if binary and denominator is not None and seen["above"]:
        raise ValueError(f"{metric} has successes outside {denominator}")
    scopes = [("all_seeds", None), *((f"leave_out:{x}", x) for x in labels if len(labels) > 1)]
    inside = F.filter(F.array(*[F.when(F.lit(x is None) | (F.col("__seed") != F.lit(x if x is not None else labels[0])), F.lit(s)) for s, x in scopes]), lambda s: s.isNotNull())
    each = own.select("__key", "__seed", "__num", "__den", F.explode(inside).alias("scope"))
    units = each.groupBy("scope", "__key").agg(F.sum("__num").alias("num"), F.sum("__den").alias("den"))
    drawn = hash_bootstrap(units, draws, seed, "num", "den", by=("scope",)).withColumn("ratio", F.col("num") / F.nullif(F.col("den"), F.lit(0.0)))
    ci = drawn.groupBy("scope").agg(*[F.round(F.percentile("ratio", F.lit(p)), 6).alias(c) for c, p in (("cluster_ci95_lower", 0.025), ("cluster_ci95_upper", 0.975))])
    sums = each.groupBy("scope").agg(F.count_distinct("__seed").alias("n_seeds"), F.count_distinct("__key").alias("n_problems"), F.sum("__num").alias("numerator_count"), F.sum("__den").alias("denominator_count"))
    w = stats.wilson(F.col("numerator_count"), F.col("denominator_count"))
    none = F.lit(None).cast("double")
    out = sums.select("*", rate(F.col("numerator_count"), F.col("denominator_count")).alias("estimate"), (F.round(w["low"], 6) if binary else none).alias("binomial_wilson95_lower"), (F.round(w["high"], 6) if binary else none).alias("binomial_wilson95_upper"))
    return out.join(ci, "scope", "left")
