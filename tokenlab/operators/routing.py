"""Routing between a base and an extended run: masks, curves, costs and router features."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import order
from .attribution import rate

FRACTIONS = tuple(round(0.05 * i, 2) for i in range(21))


def ranked(frame: DataFrame, score: str, tie: str | None = None, position: str = "problem_id") -> DataFrame:
    """frame with rank (from 1) by descending score, then descending tie, then position, and n, without one big task.

    Rows are dealt by ranges of the whole order (score, tie, position), so rows with one score are split as well; the
    frame is worked out once. Positions have to be unique.
    """
    by = [F.col(score).desc_nulls_last(), *([F.col(tie).desc_nulls_last()] if tie else []), F.col(position).asc_nulls_last()]
    rows = order.numbered(frame, *by)
    # One row: safe to broadcast.
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))


def fraction_rows(*fractions: float) -> Column:
    """The fractions as an array of doubles; as decimals they would round k otherwise."""
    return F.array(*[F.lit(float(f)) for f in fractions])


def top_fraction_curve(frame: DataFrame, base: str, extended: str, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """fraction, routed, accuracy, gain over random: the ceil(f * n) first rows of a ranked frame go to the extended run.

    Accuracies need no row per fraction: flags are summed by the smallest fraction that takes the row in.
    """
    k = F.transform(fraction_rows(*fractions), lambda f: F.struct(f.alias("f"), F.ceil(f * F.col("n")).alias("k")))
    first = F.try_element_at(F.filter(k, lambda x: F.col("rank") <= x["k"]), F.lit(1))["f"]
    by = frame.select("n", first.alias("from"), F.col(base).cast("int").alias("b"), F.col(extended).cast("int").alias("x"))
    sums = by.groupBy("from", "n").agg(F.sum("b").alias("b"), F.sum("x").alias("x"), F.count(F.lit(1)).alias("rows"))
    grid = sums.select("n", "from", "b", "x", "rows", F.explode(fraction_rows(*fractions)).alias("fraction"))
    inside = F.coalesce(F.col("from") <= F.col("fraction"), F.lit(False))
    out = grid.groupBy("fraction", "n").agg(F.sum(F.when(inside, F.col("rows")).otherwise(0)).alias("routed"), F.sum(F.when(inside, F.col("x")).otherwise(F.col("b"))).alias("right"), F.sum("b").alias("b"), F.sum("x").alias("x"))
    random = (F.col("b") + F.col("routed") / F.col("n") * (F.col("x") - F.col("b"))) / F.col("n")
    accuracy = F.col("right") / F.col("n")
    return out.select("fraction", "n", "routed", F.round(accuracy, 6).alias("accuracy"), F.round(random, 6).alias("random_accuracy"), F.round(accuracy - random, 6).alias("gain_vs_random"))


def costs(fraction: Column, base_cap: int, long_cap: int) -> dict[str, Column]:
    """Caps spent per problem and what is saved against always extending; a rerun may cost more than that."""
    resume, rerun = base_cap + fraction * (long_cap - base_cap), base_cap + fraction * long_cap
    return {"resume_cost": F.round(resume, 6), "rerun_cost": F.round(rerun, 6), "resume_saving": F.round(1 - resume / long_cap, 6), "rerun_saving": F.round(1 - rerun / long_cap, 6)}


#: Standard deviations on either side of its mean, and counts beside these, within which a drawn count is looked for.
SPREAD, MARGIN = 12, 20


def drawn_count(n: int, hits: int, k: int, uniform: np.ndarray) -> np.ndarray:
    """Quantiles of a hypergeometric count: of k rows drawn from n without replacement, how many are among `hits`."""
    least, most = max(0, k - (n - hits)), min(hits, k)
    mean = hits * k / n if n else 0.0
    spread = SPREAD * (mean * (1 - hits / n) * (n - k) / max(n - 1, 1)) ** 0.5 + MARGIN if n else 0
    low, high = max(least, int(mean - spread)), min(most, int(mean + spread))
    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    x = np.arange(low, high)
    ratio = np.log(hits - x) + np.log(k - x) - np.log(x + 1) - np.log(n - hits - k + x + 1)
    chance = np.exp(choose(hits, low) + choose(n - hits, k - low) - choose(n, k) + np.concatenate(([0.0], np.cumsum(ratio))))
    return np.minimum(low + np.searchsorted(np.cumsum(chance), uniform, side="left"), high)


def drawn_uniforms(seed: int, draws: int, *parts) -> np.ndarray:
    """A number in [0, 1) for each draw: the first 48 bits of sha256 of seed, draw and parts, joined by '|'."""
    digests = [hashlib.sha256("|".join(map(str, (seed, d, *parts))).encode()).digest() for d in range(draws)]
    return np.array([int.from_bytes(x[:6], "big") for x in digests], dtype=float) / (1 << 48)


def drawn_baseline(frame: DataFrame, base: str, extended: str, by: str, fractions: tuple[float, ...] = FRACTIONS, draws: int = 500, seed: int = 42, rounding: str = "ceil") -> DataFrame:
    """by, fraction, k, draws, and mean, deviation and central 95 % of the accuracy when k rows drawn at random are routed.

    k = ceil(fraction * n), or with rounding half_even the nearest. Accuracy depends only on how many of the drawn rows
    are gained (only the extended run is right) and lost (only the base run is), so each draw is two hypergeometric
    counts, from numbers that any engine can repeat; the cost is draws times the root of k for each group and fraction.
    """
    b, x = F.coalesce(F.col(base), F.lit(False)), F.coalesce(F.col(extended), F.lit(False))
    sums = frame.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(b).alias("b"), F.count_if(~b & x).alias("g"), F.count_if(b & ~x).alias("l"))
    size = F.col("fraction") * F.col("n")
    k = (F.ceil(size) if rounding == "ceil" else F.bround(size)).cast("long")
    grid = sums.select("*", F.explode(fraction_rows(*fractions)).alias("fraction")).withColumn("k", F.least(k, F.col("n"))).select(by, "fraction", "n", "b", "g", "l", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group, fraction, n, right, gain, lost, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g = drawn_count(n, gain, size, drawn_uniforms(seed, draws, "gained", group, size))
                second, taken = drawn_uniforms(seed, draws, "lost", group, size), np.zeros(draws, dtype=np.int64)
                for v in np.unique(g).tolist():
                    taken[g == v] = drawn_count(n - gain, lost, size - v, second[g == v])
                accuracy = (right + g - taken) / n
                rows.append((group, fraction, size, draws, *(float(round(v, 6)) for v in (accuracy.mean(), accuracy.std(), *np.quantile(accuracy, [0.025, 0.975])))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.column(0).type, pa.float64(), pa.int64(), pa.int32(), *[pa.float64()] * 4], strict=True)], names=[by, *_DRAWN])

    kind = T.StructType([grid.schema[by], *(T.StructField(c, t) for c, t in zip(_DRAWN, [T.DoubleType(), T.LongType(), T.IntegerType(), *[T.DoubleType()] * 4], strict=True))])
    return grid.repartition(by, "fraction").mapInArrow(run, kind)


_DRAWN = ("fraction", "k", "draws", "mean_accuracy", "sd_accuracy", "low", "high")


def rule_router(frame: DataFrame, rules: dict[str, Column], base: str, extended: str, base_cap: int, long_cap: int) -> DataFrame:
    """A row per rule: share routed, accuracy and costs."""
    rows = frame.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(m, F.lit(False)).alias("mask"), F.col(base).alias("b"), F.col(extended).alias("x")) for k, m in rules.items()])).alias("r")).select("r.*")
    out = rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("mask").alias("routed"), rate(F.count_if(F.when(F.col("mask"), F.col("x")).otherwise(F.col("b"))), F.count(F.lit(1))).alias("accuracy"))
    return out.select("*", *[c.alias(k) for k, c in costs(F.col("routed") / F.col("n"), base_cap, long_cap).items()])


def threshold_sweep(frame: DataFrame, score: str, base: str, extended: str, base_cap: int, long_cap: int, thresholds: tuple[float, ...] = tuple(round(0.05 * i, 2) for i in range(1, 20))) -> DataFrame:
    """Rows whose score is above a threshold (strictly) go to the extended run."""
    each = frame.select(F.col(score).alias("s"), F.col(base).alias("b"), F.col(extended).alias("x"), F.explode(fraction_rows(*thresholds)).alias("threshold"))
    mask = F.col("s") > F.col("threshold")
    out = each.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(mask).alias("routed"), rate(F.count_if(F.when(mask, F.col("x")).otherwise(F.col("b"))), F.count(F.lit(1))).alias("accuracy"))
    return out.select("*", *[c.alias(k) for k, c in costs(F.col("routed") / F.col("n"), base_cap, long_cap).items()])


def baselines(frame: DataFrame, base: str, extended: str) -> DataFrame:
    """Always base, always extended, and the oracle that extends only where it helps."""
    b, x, n = F.col(base), F.col(extended), F.count(F.lit(1))
    rows = frame.agg(F.array(*[F.struct(F.lit(k).alias("baseline"), rate(F.count_if(m), n).alias("accuracy"), rate(F.count_if(r), n).alias("routed_fraction")) for k, m, r in (("always_base", b, F.lit(False)), ("always_extended", x, F.lit(True)), ("oracle", b | x, ~b & x))]).alias("r"))
    return rows.select(F.explode("r").alias("r")).select("r.*")


def cost_accounting(frame: DataFrame, base_cap: int, long_cap: int, fractions: tuple[float, ...] = (0.2, 0.3, 0.4)) -> DataFrame:
    """Caps and actual tokens by strategy. frame: base_ok, long_ok, base_cut, base_boxed, base_tokens, long_tokens.

    A continuation costs what the extended run has more, never below zero, and only where the base run was cut. For
    top fractions of an unknown router only caps are known.
    """
    f, n = F.col, F.count(F.lit(1)).cast("double")
    more = F.when(f("base_cut"), F.greatest(f("long_tokens") - f("base_tokens"), F.lit(0))).otherwise(0)

    def rule(name: str, mask: Column) -> Column:
        r = F.count_if(mask) / n
        rerun, resume = base_cap + r * long_cap, base_cap + r * (long_cap - base_cap)
        return strategy(name, r, F.count_if(F.when(mask, f("long_ok")).otherwise(f("base_ok"))) / n, rerun, resume, F.avg(f("base_tokens") + F.when(mask, f("long_tokens")).otherwise(0)), F.avg(f("base_tokens") + F.when(mask, more).otherwise(0)))

    def strategy(name: str, r, accuracy, rerun, resume, actual_rerun, actual_resume) -> Column:
        none = F.lit(None).cast("double")
        values = {"route_fraction": r, "accuracy": accuracy, "cap_budget_rerun": rerun, "savings_rerun_pct": 100 * (1 - rerun / long_cap), "cap_budget_resume": resume, "savings_resume_pct": 100 * (1 - resume / long_cap), "actual_tokens_rerun": actual_rerun, "estimated_actual_tokens_resume": actual_resume}
        return F.struct(F.lit(name).alias("strategy"), *[(none if v is None else F.round(v.cast("double"), 6)).alias(k) for k, v in values.items()])

    d = lambda x: F.lit(float(x))
    rows = [
        strategy("fixed_medium", d(0), F.count_if("base_ok") / n, d(base_cap), d(base_cap), F.avg("base_tokens"), F.avg("base_tokens")),
        strategy("fixed_long_no_medium_pass", d(1), F.count_if("long_ok") / n, d(long_cap), d(long_cap), F.avg("long_tokens"), F.avg("long_tokens")),
        rule("rule_hit_max", f("base_cut")),
        rule("rule_no_boxed", ~f("base_boxed")),
    ]
    for x in fractions:
        r = F.ceil(F.lit(float(x)) * n) / n
        rows.append(strategy(f"any_router_top{int(x * 100)}pct_cap_only", r, None, base_cap + r * long_cap, base_cap + r * (long_cap - base_cap), None, None))
    return frame.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def selected_slices(frame: DataFrame, base: str, extended: str, fractions: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """What the top max(1, round-half-even(f * n)) rows of a ranked frame hold."""
    each = frame.select("rank", "n", F.col(base).alias("b"), F.col(extended).alias("x"), F.explode(fraction_rows(*fractions)).alias("fraction"))
    inside = F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("fraction") * F.col("n")))
    return each.filter(inside).groupBy("fraction").agg(F.count(F.lit(1)).alias("n_selected"), rate(F.count_if("b"), F.count(F.lit(1))).alias("base_acc"), rate(F.count_if("x"), F.count(F.lit(1))).alias("ext_acc"), F.count_if(~F.col("b") & F.col("x")).alias("helpful"), F.count_if(F.col("b") & ~F.col("x")).alias("harmful"))


def error_mining(frame: DataFrame, score: str, label: str, position: str = "problem_id", most: int = 80) -> DataFrame:
    """The first `most` mistakes of a score in all, by kind, then descending score: high without the label, low with it.

    High and low are the exact outer fifths.
    """
    high, low = order.exact_quantiles(frame, score, 0.8, 0.2)
    kind = F.when((F.col(score) >= F.lit(high)) & ~F.col(label), "high_score_not_helpful").when((F.col(score) <= F.lit(low)) & F.col(label), "low_score_helpful")
    rows = frame.select(position, F.col(score).alias("score"), kind.alias("kind")).filter("kind is not null")
    first = rows.orderBy("kind", F.col("score").desc(), position).limit(most)
    # At most `most` rows.
    return first.withColumn("place", F.row_number().over(Window.orderBy("kind", F.col("score").desc(), position)))


def best_efficiency(curve: DataFrame, gain: str, cost: str, key: str) -> DataFrame:
    """The point with the most gain per cost; ties to the smaller key."""
    value = F.col(gain) / F.greatest(F.col(cost), F.lit(1e-6))
    best = F.max(F.struct(value.alias("efficiency"), (-F.col(key)).alias("neg"), F.col(gain).alias("gain"), F.col(cost).alias("cost")))
    return curve.agg(best.alias("b")).select((-F.col("b.neg")).alias(key), F.col("b.gain").alias(gain), F.col("b.cost").alias(cost), F.round("b.efficiency", 6).alias("efficiency"))


def router_features(frame: DataFrame, chains: str, question: str | None = None, plain: str = "F", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Ten features of a problem's base run; question_chars only with the name of the question's column.

    is_math: the data set is another than `plain`. keep: more columns of the frame, which need no join then.
    """
    ch, n = F.col(chains), F.size(chains)
    tokens = F.transform(ch, lambda c: c["token_count"].cast("double"))
    cut = F.size(F.filter(ch, lambda c: ~c["complete"]))
    total = F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x * x)
    mean = total / n
    boxed = F.size(F.filter(ch, lambda c: c["answer"].isNotNull()))
    return frame.filter(n > 0).select(
        "problem_id", cut.cast("long").alias("cap_hits"), F.round(cut / n, 6).alias("cap_hit_fraction"), F.array_max(tokens).alias("max_tokens"), F.round(mean, 6).alias("mean_tokens"), F.array_min(tokens).alias("min_tokens"),
        F.round(F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))), 4).alias("std_tokens"), F.round(boxed / n, 6).alias("boxed_fraction"),
        *([] if question is None else [F.char_length(F.coalesce(F.col(question), F.lit(""))).cast("long").alias("question_chars")]), "math_level", (F.col("dataset") != plain).cast("int").alias("is_math"), *keep,
    )
