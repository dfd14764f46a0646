"""Attribution of changes between an independent run (a), a cut one (b) and an extended one (c).

Frames have one row per problem with dataset and arrays of chains; summaries cover all problems and each dataset in
one pass by grouping sets. Rates without a denominator are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vote

DEFINITIONS = ("strict_all_wrong", "plurality_wrong", "first_chain_wrong")
HARM_DEFINITIONS = ("complete_plurality_correct", "complete_all_correct")
CONTRASTS = {"A_to_B_resampling": ("a", "b"), "A_to_C_combined": ("a", "c"), "B_to_C_tokens": ("b", "c")}


def count(flag: Column) -> Column:
    return F.count_if(flag)


def rate(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, null if bottom is 0; six decimals, so that engines agree."""
    return F.round(top.cast("double") / F.nullif(bottom, F.lit(0)), 6)


def over_all(frame: DataFrame, keys: list[str], *sums: Column, by: str = "dataset") -> DataFrame:
    """Aggregates by keys for each value of `by`, and for all as 'all'."""
    sets = [[F.col(k) for k in keys], [F.col(k) for k in [*keys, by]]]
    out = frame.groupingSets(sets, *keys, by).agg(F.grouping(by).alias("__all"), *sums)
    return out.withColumn(by, F.when(F.col("__all") == 1, "all").otherwise(F.col(by))).drop("__all")


def voted(arms: DataFrame, *names: str) -> DataFrame:
    """arms with vote_x (a struct) and any_x for each named array of chains."""
    return arms.select("*", *[vote.plurality(n).alias(f"vote_{n}") for n in names], *[vote.any_correct(F.col(n)).alias(f"any_{n}") for n in names])


def three_arm_detail(arms: DataFrame) -> DataFrame:
    """A row per problem and definition of a failed run a: repairs at the same cap (b) and extended (c), and what c adds."""
    base = voted(arms, "a", "b", "c").withColumn("eligibility", vote.eligibility(F.col("a"), F.col("vote_a.correct")))
    rows = base.select("*", F.explode(F.array(*[F.struct(F.lit(d).alias("definition"), F.col(f"eligibility.{d}").alias("eligible")) for d in DEFINITIONS])).alias("d")).select("*", "d.*")
    eligible, b, c = F.col("eligible"), F.col("vote_b.correct"), F.col("vote_c.correct")
    # A first chain can be wrong while another is right; elsewhere a repair needs that none was.
    fresh = F.when(F.col("definition") == "first_chain_wrong", F.lit(True)).otherwise(~F.col("any_a"))
    return rows.select(
        "problem_id", "dataset", "definition", "eligible",
        F.col("vote_a.correct").alias("base_plurality_correct"), F.col("any_a").alias("base_any_correct"),
        b.alias("samecap_plurality_correct"), c.alias("long_plurality_correct"),
        (eligible & b).alias("samecap_repair_plurality"), (eligible & c).alias("long_repair_plurality"),
        (eligible & fresh & F.col("any_b")).alias("samecap_repair_any"), (eligible & fresh & F.col("any_c")).alias("long_repair_any"),
        (eligible & ~b & c).alias("incremental_plurality_helpful"), (eligible & b & ~c).alias("incremental_plurality_harmful"),
    )


def three_arm_summary(detail: DataFrame) -> DataFrame:
    f = F.col
    sums = over_all(
        detail, ["definition"],
        F.count(F.lit(1)).alias("n_problems"), count(f("eligible")).alias("n_eligible"),
        count(f("samecap_repair_plurality")).alias("samecap_repair_count"), count(f("long_repair_plurality")).alias("long_repair_count"),
        count(f("incremental_plurality_helpful")).alias("incremental_helpful_count"), count(f("incremental_plurality_harmful")).alias("incremental_harmful_count"),
        count(f("samecap_repair_any")).alias("samecap_any_repair_count"), count(f("long_repair_any")).alias("long_any_repair_count"),
    )
    n = f("n_eligible")
    return sums.select("*", rate(f("samecap_repair_count"), n).alias("samecap_repair_rate"), rate(f("long_repair_count"), n).alias("long_repair_rate"), rate(f("long_repair_count") - f("samecap_repair_count"), n).alias("incremental_token_effect"))


def harm_detail(arms: DataFrame) -> DataFrame:
    """A row per problem, contrast and definition of a right run a: harm from source to target, certain and possible.

    Who is eligible is decided on a for every contrast; harm also needs the source's vote to be right.
    """
    base = voted(arms, "a", "b", "c").withColumn("right", vote.complete_correct(F.col("a"), F.col("vote_a.correct")))
    cases = F.array(*[F.struct(F.lit(k).alias("contrast"), F.col(f"vote_{s}").alias("source"), F.col(f"vote_{t}").alias("target")) for k, (s, t) in CONTRASTS.items()])
    whose = F.array(*[F.struct(F.lit(d).alias("definition"), F.col(f"right.{d}").alias("eligible")) for d in HARM_DEFINITIONS])
    rows = base.select("problem_id", "dataset", F.explode(cases).alias("k"), whose.alias("w")).select("problem_id", "dataset", "k.*", F.explode("w").alias("w")).select("problem_id", "dataset", "contrast", "source", "target", "w.*")
    e, s, t = F.col("eligible"), F.col("source"), F.col("target")
    return rows.select("problem_id", "dataset", "contrast", "definition", "eligible", (e & s["correct"] & ~t["correct"]).alias("harm"), (e & s["lower"] & ~t["upper"]).alias("certain_harm"), (e & s["upper"] & ~t["lower"]).alias("possible_harm"))


def harm_summary(detail: DataFrame) -> DataFrame:
    sums = over_all(detail, ["contrast", "definition"], count(F.col("eligible")).alias("n_eligible"), count(F.col("harm")).alias("harm_count"), count(F.col("certain_harm")).alias("certain_harm_count"), count(F.col("possible_harm")).alias("possible_harm_count"))
    return sums.withColumn("harm_rate", rate(F.col("harm_count"), F.col("n_eligible")))


def expanded_repair_detail(arms: DataFrame, base: str = "b", extended: str = "c") -> DataFrame:
    """Two runs: a row per problem and definition, with repairs by vote, by any chain and by tie bounds."""
    rows = voted(arms, base, extended).withColumn("eligibility", vote.eligibility(F.col(base), F.col(f"vote_{base}.correct")))
    rows = rows.select("*", F.explode(F.array(*[F.struct(F.lit(d).alias("definition"), F.col(f"eligibility.{d}").alias("eligible")) for d in DEFINITIONS])).alias("d")).select("*", "d.*")
    e, x = F.col("eligible"), F.col(f"vote_{extended}")
    fresh = F.when(F.col("definition") == "first_chain_wrong", F.lit(True)).otherwise(~F.col(f"any_{base}"))
    return rows.select("problem_id", "dataset", "definition", "eligible", (e & x["correct"]).alias("repair_plurality"), (e & fresh & F.col(f"any_{extended}")).alias("repair_any"), (e & x["lower"]).alias("repair_tie_lower"), (e & x["upper"]).alias("repair_tie_upper"))


def expanded_repair_summary(detail: DataFrame) -> DataFrame:
    kinds = ("plurality", "any", "tie_lower", "tie_upper")
    sums = over_all(detail, ["definition"], F.count(F.lit(1)).alias("n_problems"), count(F.col("eligible")).alias("n_eligible"), *[count(F.col(f"repair_{k}")).alias(f"repair_{k}_count") for k in kinds])
    return sums.select("*", rate(F.col("n_eligible"), F.col("n_problems")).alias("eligible_rate"), *[rate(F.col(f"repair_{k}_count"), F.col("n_eligible")).alias(f"repair_{k}_rate") for k in kinds])


def sampling_repair_detail(arms: DataFrame, base: str = "b", extended: str = "c") -> DataFrame:
    """Two runs, a row per problem: votes, ties, completion state of the base run, help, harm and repair."""
    b, x = F.col(f"vote_{base}"), F.col(f"vote_{extended}")
    state = vote.completion_state(F.col(base))
    own = voted(arms, base, extended).withColumn("state", state)
    wrong = F.col("state") == "all_complete_answered_wrong"
    return own.select(
        "problem_id", "dataset",
        vote.pass_at_1(F.col(base)).alias("base_pass1"), vote.pass_at_1(F.col(extended)).alias("ext_pass1"),
        b["correct"].alias("base_maj_correct"), b["tie"].alias("base_maj_tied"), x["correct"].alias("ext_maj_correct"), x["tie"].alias("ext_maj_tied"),
        x["lower"].alias("ext_maj_correct_all_tie"), x["upper"].alias("ext_maj_correct_any_tie"),
        F.col("state").alias("base_completion_state"), F.exists(base, lambda c: ~c["complete"]).alias("base_truncated"), wrong.alias("base_complete_wrong"),
        (~b["correct"] & x["correct"]).alias("helpful_maj"), (b["correct"] & ~x["correct"]).alias("harm_maj"),
        (wrong & x["correct"]).alias("repaired_maj"), (wrong & F.col(f"any_{extended}")).alias("repaired_any"),
        (wrong & x["lower"]).alias("repaired_tie_lower"), (wrong & x["upper"]).alias("repaired_tie_upper"),
    )


def sampling_repair_summary(detail: DataFrame) -> DataFrame:
    """By dataset and for all: accuracies and their changes, help, harm, repair, and where help comes from."""
    f, n = F.col, F.count(F.lit(1))
    helpful = count(f("helpful_maj"))
    state = lambda s: count(f("helpful_maj") & (f("base_completion_state") == s))
    return over_all(
        detail, [],
        n.alias("n"), F.round(F.avg("base_pass1"), 6).alias("base_pass1"), F.round(F.avg("ext_pass1"), 6).alias("ext_pass1"), F.round(F.avg("ext_pass1") - F.avg("base_pass1"), 6).alias("pass1_delta"),
        rate(count(f("base_maj_correct")), n).alias("base_maj_acc"), rate(count(f("ext_maj_correct")), n).alias("ext_maj_acc"), rate(count(f("ext_maj_correct")) - count(f("base_maj_correct")), n).alias("maj_acc_delta"),
        rate(count(f("base_maj_tied")), n).alias("base_maj_tie_rate"), rate(count(f("ext_maj_tied")), n).alias("ext_maj_tie_rate"),
        rate(count(f("ext_maj_correct_all_tie")), n).alias("ext_maj_acc_tie_lower"), rate(count(f("ext_maj_correct_any_tie")), n).alias("ext_maj_acc_tie_upper"),
        rate(helpful, n).alias("helpful_maj_rate"), rate(count(f("harm_maj")), n).alias("harm_maj_rate"), rate(count(f("base_truncated")), n).alias("base_trunc_rate"),
        count(f("base_complete_wrong")).alias("n_complete_wrong"), count(f("repaired_maj")).alias("repair_count_maj"), count(f("repaired_any")).alias("repair_count_any"),
        count(f("repaired_tie_lower")).alias("repair_count_maj_tie_lower"), count(f("repaired_tie_upper")).alias("repair_count_maj_tie_upper"),
        rate(count(f("repaired_maj")), count(f("base_complete_wrong"))).alias("repair_rate_maj"), rate(count(f("repaired_any")), count(f("base_complete_wrong"))).alias("repair_rate_any"),
        rate(count(f("helpful_maj") & f("base_truncated")), helpful).alias("helpful_from_truncated"), rate(state("all_complete_answered_wrong"), helpful).alias("helpful_from_complete_wrong"),
        rate(state("mixed_truncated_complete"), helpful).alias("helpful_from_mixed"), rate(state("complete_other"), helpful).alias("helpful_from_complete_other"), helpful.alias("helpful_taxonomy_n"),
    )


def same_budget_control(arms: DataFrame, base: str = "a", extended: str = "c", cap: int = 35) -> DataFrame:
    """Real repairs of the extended run beside those of a control in which chains beyond the base cap are censored."""
    kept = lambda c: F.coalesce((c["token_count"] < cap) | ((c["token_count"] == cap) & (c["finish_reason"] == "stop")), F.lit(False))
    controlled = arms.withColumn(
        "control",
        F.transform(extended, lambda c: c.withField("answer", F.when(kept(c), c["answer"])).withField("correct", c["correct"] & kept(c)).withField("complete", c["complete"] & kept(c)).withField("finish_reason", F.when(kept(c), c["finish_reason"]).otherwise("length"))),
    )
    rows = voted(controlled, base, extended, "control").withColumn("eligible", vote.eligibility(F.col(base), F.col(f"vote_{base}.correct"))["strict_all_wrong"])
    e, x, k = F.col("eligible"), F.col(f"vote_{extended}.correct"), F.col("vote_control.correct")
    chains = F.sum(F.size(extended)).cast("long")
    cut = F.sum(F.size(F.filter(extended, lambda c: ~kept(c)))).cast("long")
    return over_all(rows, [], F.count(F.lit(1)).alias("n"), count(e).alias("n_eligible"), count(e & x).alias("real_repairs"), count(e & k).alias("control_repairs"), count(e & x & ~k).alias("token_dependent_repairs"), cut.alias("censored_chains"), rate(cut, chains).alias("censored_chain_rate"))


def first_chain(chains: str) -> Column:
    return F.try_element_at(F.col(chains), F.lit(1))


def utility(base_ok: Column, long_ok: Column, base_cut: Column, base_boxed: Column) -> Column:
    """already_solved, long_harm, no_utility, completion_recovery or reasoning_recovery."""
    return (
        F.when(base_ok & long_ok, "already_solved").when(base_ok, "long_harm").when(~long_ok, "no_utility").when(base_cut | ~base_boxed, "completion_recovery").otherwise("reasoning_recovery")
    )


def transition(base_ok: Column, long_ok: Column) -> Column:
    return F.concat(F.when(base_ok, "C").otherwise("W"), F.lit("->"), F.when(long_ok, "C").otherwise("W"))


def first_chain_frame(arms: DataFrame, base: str = "b", extended: str = "c") -> DataFrame:
    """Greedy view of two runs: their first chains' correctness, cut-off, readable answer and tokens."""
    b, x = first_chain(base), first_chain(extended)
    return arms.select("problem_id", "dataset", "math_level", b["correct"].alias("base_ok"), x["correct"].alias("long_ok"), (~b["complete"]).alias("base_cut"), b["answer"].isNotNull().alias("base_boxed"), b["token_count"].alias("base_tokens"), x["token_count"].alias("long_tokens"))


def budget_pair_scaling(arms: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """First chains under pairs of caps (medium, long), cut from the extended run's."""
    first = arms.select("problem_id", "dataset", first_chain("c").alias("f"))
    each = first.select("dataset", "f", F.explode(F.array(*[F.struct(F.lit(m).alias("medium"), F.lit(x).alias("long")) for m, x in pairs])).alias("p")).select("dataset", "p.*", "f")
    fits = lambda cap: F.col("f.token_count") <= F.col(cap)
    m, x = F.col("f.correct") & fits("medium"), F.col("f.correct") & fits("long")
    n = F.count(F.lit(1))
    return over_all(each, ["medium", "long"], n.alias("n"), rate(count(m), n).alias("medium_acc"), rate(count(x), n).alias("long_acc"), count(~m & x).alias("helpful"), count(m & ~x).alias("harmful"), rate(count(~fits("medium")), n).alias("medium_hit_max_rate"))


def mechanism_summary(frame: DataFrame, base_cap: int, long_cap: int) -> DataFrame:
    """Key and value of 19 measures over the greedy view, as text with six decimals."""
    f, n = F.col, F.count(F.lit(1)).cast("double")
    helpful, cbw = ~f("base_ok") & f("long_ok"), ~f("base_ok") & ~f("base_cut") & f("base_boxed")
    base, long, hits = count(f("base_ok")), count(f("long_ok")), count(f("base_cut"))
    number = lambda x: F.format_string("%.6f", x)
    part = lambda a, b: F.when(b > 0, number(F.round(a / b, 6)))
    whole = lambda x: x.cast("long").cast("string")
    metrics = {
        "n": whole(n), "medium_budget": F.lit(str(base_cap)), "long_budget": F.lit(str(long_cap)), "medium_acc": part(base, n), "long_acc": part(long, n), "gain": part(long - base, n),
        "helpful_count": whole(count(helpful)), "helpful_rate": part(count(helpful), n), "medium_hit_max_count": whole(hits), "medium_hit_max_rate": part(hits, n),
        "helpful_incomplete_frac": part(count(helpful & (f("base_cut") | ~f("base_boxed"))), count(helpful)), "helpful_hitmax_frac": part(count(helpful & f("base_cut")), count(helpful)),
        "complete_but_wrong_count": whole(count(cbw)), "complete_but_wrong_rate": part(count(cbw), n), "complete_but_wrong_fixed": whole(count(cbw & f("long_ok"))), "complete_but_wrong_fix_rate": part(count(cbw & f("long_ok")), count(cbw)),
        "hitmax_rule_routed": part(hits, n), "hitmax_rule_acc": part(count(F.when(f("base_cut"), f("long_ok")).otherwise(f("base_ok"))), n),
        "random_same_fraction_acc_expected": part(base + hits / n * (long - base), n),
    }
    row = frame.agg(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()]).alias("m"))
    return row.select(F.explode("m").alias("m")).select("m.*")


def complete_wrong_summary(frame: DataFrame) -> DataFrame:
    """Complete but wrong first chains by subset (strict: not cut; relaxed: readable or not); 0 where a subset is empty."""
    wrong = ~F.col("base_ok") & ~F.col("base_cut")
    subsets = F.array(F.struct(F.lit("strict").alias("subset"), (wrong & F.col("base_boxed")).alias("inside")), F.struct(F.lit("relaxed").alias("subset"), wrong.alias("inside")))
    rows = frame.select("*", F.explode(subsets).alias("s")).select("*", "s.*")
    i, n = F.col("inside"), F.count(F.lit(1))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return over_all(rows, ["subset"], n.alias("n"), count(i).alias("n_subset"), rate(count(i), n).alias("subset_rate"), zero(rate(count(i & F.col("long_ok")), count(i))).alias("fixed_rate"), zero(F.round(F.avg(F.when(i, F.col("base_tokens"))), 6)).alias("mean_tokens"))


def transition_counts(frame: DataFrame) -> DataFrame:
    kind = frame.select("dataset", transition(F.col("base_ok"), F.col("long_ok")).alias("t"))
    helpful, harmful = count(F.col("t") == "W->C"), count(F.col("t") == "C->W")
    return over_all(kind, [], F.count(F.lit(1)).alias("n"), helpful.alias("helpful"), harmful.alias("harmful"), (helpful - harmful).alias("net"))


def correct_to_wrong(frame: DataFrame, low: float = 0.02, high: float = 0.05) -> DataFrame:
    """Share of right answers that get lost: high above `high` only, low below `low`, else moderate."""
    lost, right = count(F.col("base_ok") & ~F.col("long_ok")), count(F.col("base_ok"))
    out = over_all(frame, [], F.count(F.lit(1)).alias("n"), right.alias("n_correct"), lost.alias("n_lost"))
    share = F.col("n_lost") / F.greatest(F.col("n_correct"), F.lit(1))
    return out.select("*", F.round(share, 6).alias("chr"), F.when(share > high, "high").when(share < low, "low").otherwise("moderate").alias("verdict"))


def paired_counts(rows: DataFrame, reference: str, target: str, *keys: str) -> DataFrame:
    """The 2x2 table of two flags."""
    r, t = F.col(reference), F.col(target)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count(r & t).alias("both"), count(r & ~t).alias("reference_only"), count(~r & t).alias("target_only"), count(~r & ~t).alias("neither"))


def strict_relaxed_summary(detail: DataFrame) -> DataFrame:
    """Accuracy, help and harm by setting (strict, relaxed) for each data set and all; detail as of runs.relaxed_detail."""
    settings = F.array(*[F.struct(F.lit(k).alias("setting"), F.col(f"{k}_medium_correct").alias("p"), F.col(f"{k}_long_correct").alias("q")) for k in ("strict", "relaxed")])
    rows = detail.select("dataset", F.explode(settings).alias("s")).select("dataset", "s.*")
    p, q, n = F.col("p"), F.col("q"), F.count(F.lit(1))
    return over_all(rows, ["setting"], n.alias("n"), rate(count(p), n).alias("medium_acc"), rate(count(q), n).alias("long_acc"), rate(count(~p & q), n).alias("helpful_ml_rate"), rate(count(p & ~q), n).alias("long_harm_rate"))
