"""Votes, eligibility and attribution on small chains, against a plain Python vote."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlab.operators import attribution as at
from tokenlab.operators import order, resample, routing, vote

CHAIN = T.ArrayType(T.StructType([T.StructField("answer", T.StringType()), T.StructField("correct", T.BooleanType()), T.StructField("complete", T.BooleanType()), T.StructField("token_count", T.IntegerType()), T.StructField("finish_reason", T.StringType())]))
ROW = T.StructType([T.StructField("problem_id", T.IntegerType()), T.StructField("dataset", T.StringType()), *[T.StructField(x, CHAIN) for x in "abc"]])


def chain(answer, correct=False, complete=True, tokens=10, finish="stop"):
    return (answer, correct, complete, tokens, finish)


def frame(spark, rows):
    return spark.createDataFrame([(i, d, a, b, c) for i, (d, a, b, c) in enumerate(rows)], ROW)


def plain_vote(chains):
    n = Counter(a for a, *_ in chains if a is not None)
    if not n:
        return (None, False, False, False, False)
    best = sorted(a for a in n if n[a] == max(n.values()))
    ok = [any(c for a, c, *_ in chains if a == w) for w in best]
    return (best[0], ok[0], len(best) > 1, all(ok), any(ok))


def random_chains(rng):
    return [chain(rng.choice([None, "", "A", "B", "C"]), rng.random() < 0.5, rng.random() < 0.8) for _ in range(rng.randint(0, 8))]


def test_votes_match_plain_python_both_ways(spark):
    rng = random.Random(1)
    rows = [("x", random_chains(rng), [], []) for _ in range(150)]
    f = frame(spark, rows)
    want = {i: plain_vote(a) for i, (_, a, _, _) in enumerate(rows)}
    got = {r["problem_id"]: tuple(r["v"]) for r in f.select("problem_id", vote.plurality("a").alias("v")).collect()}
    assert got == want
    by_rows = vote.plurality_by_rows(f.select("problem_id", F.explode("a").alias("c")).select("problem_id", "c.*"), ["problem_id"])
    assert {r["problem_id"]: tuple(r)[1:] for r in by_rows.collect()} == {i: v for i, v in want.items() if rows[i][1]}


def test_ties_take_the_smallest_and_bound_the_rest(spark):
    rows = [("x", [chain("A"), chain("B", True)], [], []), ("x", [chain("A", True), chain("A"), chain("B")], [], []), ("x", [], [], []), ("x", [chain(None)], [], []), ("x", [chain("A"), chain("B", True), chain("C", True)], [], [])]
    got = [tuple(r["v"]) for r in frame(spark, rows).select("problem_id", vote.plurality("a").alias("v")).orderBy("problem_id").collect()]
    assert got == [("A", False, True, False, True), ("A", True, False, True, True), (None, False, False, False, False), (None, False, False, False, False), ("A", False, True, False, True)]


def test_empty_answers_vote_only_in_the_plain_variant(spark):
    f = frame(spark, [("x", [chain(""), chain(""), chain("B", True)], [], [])])
    r = f.select(vote.plurality("a").alias("p"), vote.plurality("a", drop_empty=True).alias("t")).first()
    assert r["p"]["winner"] == "" and r["t"]["winner"] == "B" and r["t"]["correct"]


def test_eligibility_and_first_chain(spark):
    rows = [
        ("x", [chain("A"), chain("B")], [], []),
        ("x", [chain("A"), chain("B", True), chain("B", True)], [], []),
        ("x", [chain("A"), chain(None)], [], []),
        ("x", [chain("A", complete=False), chain("B")], [], []),
        ("x", [], [], []),
    ]
    got = [tuple(r["e"]) for r in frame(spark, rows).select("problem_id", vote.eligibility(F.col("a")).alias("e")).orderBy("problem_id").collect()]
    assert got == [(True, True, True), (False, False, True), (False, False, True), (False, False, False), (False, False, False)]


def test_any_repair_of_a_wrong_first_chain_may_start_from_a_right_vote(spark):
    f = frame(spark, [("x", [chain("A"), chain("B", True), chain("B", True)], [chain("B", True)], [chain("B", True)])])
    rows = {r["definition"]: r for r in at.three_arm_detail(f).collect()}
    assert rows["first_chain_wrong"]["long_repair_any"] and not rows["strict_all_wrong"]["long_repair_any"]


def test_identities_of_the_summary(spark):
    rng = random.Random(2)
    f = frame(spark, [(rng.choice("xy"), random_chains(rng), random_chains(rng), random_chains(rng)) for _ in range(200)])
    for r in at.three_arm_summary(at.three_arm_detail(f)).collect():
        assert r["long_repair_count"] - r["samecap_repair_count"] == r["incremental_helpful_count"] - r["incremental_harmful_count"]
        assert (r["samecap_repair_rate"] is None) == (r["n_eligible"] == 0)
    for r in at.harm_detail(f).collect():
        assert not r["certain_harm"] or r["harm"]
        assert not r["harm"] or r["possible_harm"]
    total = at.sampling_repair_summary(at.sampling_repair_detail(f, "a", "c")).filter("dataset = 'all'").first()
    parts = [total[k] for k in ("helpful_from_complete_wrong", "helpful_from_mixed", "helpful_from_complete_other")]
    states = at.sampling_repair_detail(f, "a", "c").filter("helpful_maj and base_completion_state = 'all_truncated'").count()
    assert abs(sum(parts) + states / total["helpful_taxonomy_n"] - 1) < 1e-5


@pytest.mark.parametrize(("count", "finish", "kept"), [(99, "length", True), (100, "stop", True), (100, "length", False), (140, "stop", False), (100, None, False)])
def test_control_censors_at_the_cap(spark, count, finish, kept):
    f = frame(spark, [("x", [chain("A")], [], [chain("B", True, True, count, finish)])])
    r = at.same_budget_control(f, "a", "c", 100).filter("dataset = 'all'").first()
    assert (r["real_repairs"], r["control_repairs"], r["censored_chains"]) == (1, int(kept), int(not kept))


def test_subsets_of_all_chains_are_the_vote(spark):
    rng = random.Random(3)
    f = frame(spark, [("x", [chain(rng.choice("AB"), rng.random() < 0.5) for _ in range(4)], [], []) for _ in range(30)])
    votes = {r["problem_id"]: float(r["v"]) for r in f.select("problem_id", vote.plurality("a")["correct"].alias("v")).collect()}
    assert {r["problem_id"]: r["accuracy"] for r in resample.subset_audit(f, "a", (4,)).collect()} == votes
    assert len(resample.subsets(8, 4)) == 70
    with pytest.raises(ValueError):
        resample.subsets(9, 4)


def test_subsets_of_many_chains_are_all_counted(spark):
    """More than 8 chains; votes of every subset, formed one by one."""
    rng = random.Random(5)
    sets = [[chain(rng.choice(["A", "B", "", None]), rng.random() < 0.4) for _ in range(n)] for n in (9, 9, 10, 12, 3, 0)]
    f = frame(spark, [("x", s, [], []) for s in sets])
    got = {(r["problem_id"], r["k"]): tuple(r)[3:] for r in resample.subset_audit(f, "a", (1, 2, 4)).collect()}
    want = {}
    for i, s in enumerate(sets):
        for k in (1, 2, 4):
            if each := [plain_vote(c)[1:] for c in combinations(s, k)]:
                want[i, k] = (len(each), *(sum(v) / len(each) for v in zip(*each, strict=True)))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and want[3, 4][0] == 495
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=6e-7)
    assert resample.subset_counts(((90, 0), (0, 110)), 0, 2) == (19900, 110 * 109 // 2, 9900, 110 * 109 // 2, 110 * 109 // 2 + 9900)


def test_split_null_counts_splits(spark):
    f = frame(spark, [("x", [chain("A"), chain("A"), chain("B", True), chain("B", True)], [], [])])
    rows = {r["selector_indices"]: (r["n_eligible"], r["repair_count"]) for r in resample.split_null(f, "a", 2).collect()}
    assert rows["0,1"] == (1, 1) and rows["2,3"] == (0, 0) and len(rows) == 6
    more = f.unionByName(frame(spark, [("x", [chain("A")] * 3, [], [])]))
    with pytest.raises(Exception, match="needs 4 chains"):
        resample.split_null(more, "a", 2).collect()
    assert len(resample.split_null(resample.of_problems(more, "a", 4), "a", 2).collect()) == 6


def test_top_fraction_rounds_in_binary(spark):
    """0.55 * 800 is a little above 440 in doubles, so 441 rows are routed."""
    f = spark.range(800).select(F.col("id").alias("problem_id"), (F.col("id") % 7).cast("double").alias("s"), F.lit(False).alias("b"), F.lit(True).alias("x"))
    ranked = routing.ranked(f, "s")
    assert ranked.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (1, 800, 800)
    curve = {r["fraction"]: r for r in routing.top_fraction_curve(ranked, "b", "x").collect()}
    assert curve[0.55]["routed"] == 441 and curve[0.0]["routed"] == 0 and curve[1.0]["accuracy"] == 1.0


def test_ranks_split_a_common_score(spark):
    rows = spark.range(5000).select(F.col("id").alias("problem_id"), F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 2).cast("double")).alias("s"), F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("int")).alias("t"))
    key = lambda r: (r["s"] is None, -(r["s"] or 0), r["t"] is None, -(r["t"] or 0), r["problem_id"])
    want = {r["problem_id"]: i + 1 for i, r in enumerate(sorted(rows.collect(), key=key))}
    assert {r["problem_id"]: r["rank"] for r in routing.ranked(rows, "s", "t").collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = order.dealt(rows.filter("s = 1"), F.col("s").desc(), F.col("problem_id")).groupBy("__part").count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 2 * 2500 / 4
        assert {r["problem_id"]: r["rank"] for r in routing.ranked(rows, "s", "t").collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("at_once", [1_000_000, 100, 2])
def test_quantiles_are_exact_however_many_values(spark, monkeypatch, at_once):
    """Spread values, two values, one, heavy ties, infinities: bracketing ends and is exact."""
    import numpy as np

    monkeypatch.setattr(order, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    qs = (0, 0.2, 0.5, 0.81, 1)
    columns = {"spread": np.round(rng.normal(size=2000), 2), "halves": np.arange(1000) % 2 + 1.0, "constant": np.full(500, 7.0), "ties": np.where(np.arange(1500) % 50 == 0, rng.normal(size=1500), 3.0), "ends": np.array([-np.inf] * 300 + [0.5] * 5 + [np.inf] * 300)}
    for x in columns.values():
        f = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        with np.errstate(invalid="ignore"):
            want = [np.sort(x)[int(q * (len(x) - 1))] if np.isinf(x).any() else float(np.quantile(x, q)) for q in qs]
        assert order.exact_quantiles(f, "x", *qs) == pytest.approx(want, abs=1e-12)
    assert order.exact_quantile(f.limit(0), "x", 0.5) is None


def test_errors_of_two_valued_scores_are_mined(spark):
    """Two million rows of 0 and 1: more than are sorted at once, and no bracket between them."""
    f = spark.range(2_000_000).select(F.col("id").alias("problem_id"), (F.col("id") % 2).cast("double").alias("s"), (F.col("id") % 3 == 0).alias("y"))
    rows = routing.error_mining(f, "s", "y", most=5).orderBy("place").collect()
    assert [(r["kind"], r["score"], r["problem_id"]) for r in rows] == [("high_score_not_helpful", 1.0, i) for i in (1, 5, 7, 11, 13)]


def test_error_mining_keeps_so_many_in_all(spark):
    f = spark.range(1000).select(F.col("id").alias("problem_id"), (F.col("id") / 1000).alias("s"), (F.col("id") % 2 == 0).alias("y"))
    rows = routing.error_mining(f, "s", "y").orderBy("place").collect()
    assert len(rows) == 80 and {r["kind"] for r in rows} == {"high_score_not_helpful"} and [r["problem_id"] for r in rows][:2] == [999, 997]


def test_lost_answers_are_high_only_above_the_bound(spark):
    f = spark.range(20).select(F.lit("x").alias("dataset"), F.lit(True).alias("base_ok"), (F.col("id") > 0).alias("long_ok"))
    assert at.correct_to_wrong(f).first()["verdict"] == "moderate" and at.correct_to_wrong(f, high=0.049).first()["verdict"] == "high"


def test_rerunning_can_cost_more_than_extending(spark):
    f = spark.createDataFrame([(True, True)], "b boolean, x boolean")
    r = routing.rule_router(f, {"all": F.lit(True)}, "b", "x", 50, 100).first()
    assert r["rerun_saving"] == -0.5 and r["resume_saving"] == 0.0


def test_drawn_counts_are_hypergeometric():
    """Quantiles of the count against sums of exact chances; moments of many draws."""
    from fractions import Fraction
    from math import comb

    import numpy as np

    for n, hits, k in [(10, 4, 5), (50, 0, 9), (50, 50, 9), (30, 12, 30), (30, 12, 0), (400, 37, 150), (1, 1, 1)]:
        total, cdf = Fraction(0), []
        for x in range(k + 1):
            total += Fraction(comb(hits, x) * comb(n - hits, k - x), comb(n, k))
            cdf.append(float(total))
        u = np.linspace(0.001, 0.999, 97)
        want = [next(x for x in range(k + 1) if cdf[x] >= v - 1e-12) for v in u]
        assert routing.drawn_count(n, hits, k, u).tolist() == want
    big = routing.drawn_count(10**8, 3 * 10**7, 10**6, routing.drawn_uniforms(1, 2000, "x"))
    assert abs(big.mean() - 300_000) < 60 and 400 < big.std() < 500


def test_drawn_accuracies_are_near_their_expectation(spark):
    rows = spark.range(3000).select(F.lit("x").alias("dataset"), (F.col("id") % 3 == 0).alias("b"), (F.col("id") % 2 == 0).alias("x"))
    for r in routing.drawn_baseline(rows, "b", "x", "dataset", (0.0, 0.25, 1.0), rounding="half_even").collect():
        expected = (1000 + r["k"] / 3000 * 500) / 3000
        assert abs(r["mean_accuracy"] - expected) < 0.001 and r["low"] <= r["mean_accuracy"] <= r["high"] and (r["sd_accuracy"] > 0) == (r["fraction"] == 0.25)
