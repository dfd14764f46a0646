"""Queries on votes and attribution, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution as at
from ..operators import vote
from ..sources.tables import materialise
from . import adapter, runs

QUERIES, ORACLES = {}, {}
_DEFS3 = "(SELECT *, unnest(['strict_all_wrong', 'plurality_wrong', 'first_chain_wrong']) AS definition FROM three)"
_DEFS = "(VALUES ('strict_all_wrong'), ('plurality_wrong'), ('first_chain_wrong')) d(definition)"
_ELIGIBLE = "CASE definition WHEN 'strict_all_wrong' THEN {p}strict{s} WHEN 'plurality_wrong' THEN {p}plurality{t} ELSE {p}first{u} END"
_A = "CASE definition WHEN 'strict_all_wrong' THEN strict_all_wrong WHEN 'plurality_wrong' THEN plurality_wrong ELSE first_chain_wrong END"
_B = "CASE definition WHEN 'strict_all_wrong' THEN b_strict WHEN 'plurality_wrong' THEN b_plurality ELSE b_first END"


def query(sql: str | None = None):
    """Register a query under its function's name, and its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: str) -> str:
    return f"round({x}, 6)"


def ratio(top: str, bottom: str) -> str:
    return f"round(CAST({top} AS DOUBLE) / nullif({bottom}, 0), 6)"


def n_if(x: str) -> str:
    return f"count(*) FILTER (WHERE {x})"


ALL = "CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE dataset END AS dataset"

_WIDE = adapter.SQL + "SELECT problem_id, dataset, winner, ok AS correct, tie, low AS vote_lower, high AS vote_upper FROM votes WHERE arm = 'C'"


@query(_WIDE)
def plurality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = at.voted(adapter.arms(spark, sf_dir), "c")
    return v.select("problem_id", "dataset", "vote_c.winner", "vote_c.correct", "vote_c.tie", F.col("vote_c.lower").alias("vote_lower"), F.col("vote_c.upper").alias("vote_upper"))


@query(adapter.SQL + "SELECT problem_id, arm, winner, ok AS correct, tie, low AS vote_lower, high AS vote_upper FROM votes WHERE n_chains > 0 AND arm <> 'B'")
def plurality_vote_rows(spark, sf_dir):
    frame = adapter.arms(spark, sf_dir)
    rows = adapter.chain_rows(frame, "a").unionByName(adapter.chain_rows(frame, "c"))
    v = vote.plurality_by_rows(rows, ["problem_id", "arm"])
    return v.withColumnRenamed("lower", "vote_lower").withColumnRenamed("upper", "vote_upper")


@query(
    adapter.SQL
    + """, t AS (SELECT problem_id, CASE WHEN answer <> 'R' THEN answer END AS answer, bool_or(correct) AS ok, count(*) AS n FROM chains WHERE arm = 'C' AND answer IS NOT NULL GROUP BY ALL),
    t2 AS (SELECT * FROM t WHERE answer IS NOT NULL), m AS (SELECT *, max(n) OVER (PARTITION BY problem_id) AS most FROM t2), w AS (SELECT problem_id, min(answer) AS winner, arg_min(ok, answer) AS ok FROM m WHERE n = most GROUP BY ALL)
    SELECT p.problem_id, w.winner, coalesce(w.ok, false) AS correct FROM problems p LEFT JOIN w USING (problem_id)"""
)
def plurality_truthy(spark, sf_dir):
    """Empty answers don't vote either; here R stands for an empty answer."""
    arms = adapter.arms(spark, sf_dir).withColumn("c", F.transform("c", lambda c: c.withField("answer", F.when(c["answer"] == "R", "").otherwise(c["answer"]))))
    return arms.select("problem_id", vote.plurality("c", drop_empty=True).alias("v")).select("problem_id", "v.winner", "v.correct")


@query(
    adapter.SQL
    + f"""SELECT problem_id, arm, n_chains, {r6("pass1")} AS pass1, any_ok AS any_correct, ok AS maj_correct, tie AS maj_tied, {r6("cut_rate")} AS hit_max_rate,
    CASE WHEN all_cut THEN 'all_truncated' WHEN some_cut THEN 'mixed_truncated_complete' WHEN all_answered AND NOT any_ok THEN 'all_complete_answered_wrong' ELSE 'complete_other' END AS completion_state
    FROM votes WHERE arm <> 'C'"""
)
def run_stats(spark, sf_dir):
    frame = adapter.arms(spark, sf_dir)
    both = frame.select("problem_id", F.explode(F.array(*[F.struct(F.lit(x.upper()).alias("arm"), F.col(x).alias("ch")) for x in ("a", "b")])).alias("r")).select("problem_id", "r.*")
    v, ch = vote.plurality("ch"), F.col("ch")
    both = both.withColumn("v", v)
    cut = F.size(F.filter(ch, lambda c: ~c["complete"]))
    return both.select(
        "problem_id", "arm", F.size(ch).cast("long").alias("n_chains"), F.round(vote.pass_at_1(ch), 6).alias("pass1"), vote.any_correct(ch).alias("any_correct"), F.col("v.correct").alias("maj_correct"),
        F.col("v.tie").alias("maj_tied"), F.round(F.when(F.size(ch) > 0, cut / F.size(ch)), 6).alias("hit_max_rate"), vote.completion_state(ch).alias("completion_state"),
    )


@query(adapter.SQL + f"SELECT {ALL}, count(*) AS n_problems, {r6('avg(pass1)')} AS pass1, {ratio(n_if('any_ok'), 'count(*)')} AS any_rate FROM votes WHERE arm = 'C' GROUP BY GROUPING SETS ((), (dataset))")
def pass_at_1(spark, sf_dir):
    rows = adapter.arms(spark, sf_dir).select("dataset", vote.pass_at_1(F.col("c")).alias("p"), vote.any_correct(F.col("c")).alias("any"))
    return at.over_all(rows, [], F.count(F.lit(1)).alias("n_problems"), F.round(F.avg("p"), 6).alias("pass1"), at.rate(at.count(F.col("any")), F.count(F.lit(1))).alias("any_rate"))


# Answers spelled in several ways, which agreement takes as one: with grouped thousands, decimals, blanks, an exponent.
_SPELLED = "CASE l_linenumber % 6 WHEN 0 THEN '1,00' || d WHEN 1 THEN ' 100' || d || '.0 ' WHEN 2 THEN '100' || d WHEN 3 THEN '1.00' || d || 'E3' WHEN 4 THEN 'About ' || d END"


@query(
    f"""WITH c AS (SELECT l_orderkey AS problem_id, {_SPELLED} AS answer FROM (SELECT *, CAST(l_suppkey % 2 AS INTEGER) AS d FROM lineitem)), b AS (SELECT problem_id, replace(regexp_replace(lower(answer), '\\s+', '', 'g'), ',', '') AS x FROM c),
    k AS (SELECT problem_id, coalesce(printf('%.10g', TRY_CAST(x AS DOUBLE)), x) AS x FROM b), t AS (SELECT problem_id, x, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT problem_id, CAST(sum(n) AS BIGINT) AS total, sum(n) FILTER (WHERE x IS NOT NULL) AS valid, max(n) FILTER (WHERE x IS NOT NULL) AS most, count(x) AS n_unique FROM t GROUP BY ALL)
    SELECT problem_id, n_unique, coalesce({r6("CAST(most AS DOUBLE) / valid")}, 0) AS agreement_rate, coalesce({r6("CAST(valid AS DOUBLE) / total")}, 0) AS extraction_rate, coalesce({r6("CAST(most AS DOUBLE) / total")}, 0) AS majority_confidence FROM g"""
)
def agreement_g3(spark, sf_dir):
    d, form = (F.col("l_suppkey") % 2).cast("string"), F.col("l_linenumber") % 6
    spelled = F.when(form == 0, F.concat(F.lit("1,00"), d)).when(form == 1, F.concat(F.lit(" 100"), d, F.lit(".0 "))).when(form == 2, F.concat(F.lit("100"), d)).when(form == 3, F.concat(F.lit("1.00"), d, F.lit("E3"))).when(form == 4, F.concat(F.lit("About "), d))
    chains = adapter.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("problem_id")).agg(F.collect_list(F.struct(spelled.alias("answer"))).alias("c"))
    a = chains.select("problem_id", vote.agreement(F.col("c")).alias("a")).select("problem_id", "a.*")
    return a.select("problem_id", "n_unique", *[F.round(x, 6).alias(x) for x in ("agreement_rate", "extraction_rate", "majority_confidence")])


@query("SELECT count(*) AS n_records, count(*) FILTER (WHERE k = 1 AND n > 1) AS n_same, round(CAST(count(*) FILTER (WHERE k = 1 AND n > 1) AS DOUBLE) / nullif(count(*), 0), 6) AS same_rate, coalesce(count(*) FILTER (WHERE k = 1 AND n > 1) > 0.2::DOUBLE * count(*), false) AS fails FROM (SELECT conv_id, count(*) AS n, count(DISTINCT text) AS k FROM conversations GROUP BY conv_id)")
def diversity_guard(spark, sf_dir):
    """Records whose chains are all alike; a run with more than a fifth of them fails."""
    each = adapter.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), (F.min("text") == F.max("text")).alias("same"))
    same = at.count(F.col("same") & (F.col("n") > 1))
    return each.agg(F.count(F.lit(1)).alias("n_records"), same.alias("n_same"), at.rate(same, F.count(F.lit(1))).alias("same_rate"), F.coalesce(same > 0.2 * F.count(F.lit(1)), F.lit(False)).alias("fails"))


@query(adapter.SQL + f"SELECT {ALL}, arm, count(*) AS n, {n_if('tie')} AS n_tied, {ratio(n_if('low'), 'count(*)')} AS acc_lower, {ratio(n_if('ok'), 'count(*)')} AS acc, {ratio(n_if('high'), 'count(*)')} AS acc_upper FROM votes GROUP BY GROUPING SETS ((arm), (arm, dataset))")
def vote_tie_bounds(spark, sf_dir):
    v = at.voted(adapter.arms(spark, sf_dir), "a", "b", "c")
    rows = v.select("dataset", F.explode(F.array(*[F.struct(F.lit(x.upper()).alias("arm"), F.col(f"vote_{x}").alias("v")) for x in "abc"])).alias("r")).select("dataset", "r.arm", "r.v.*")
    n = F.count(F.lit(1))
    return at.over_all(rows, ["arm"], n.alias("n"), at.count(F.col("tie")).alias("n_tied"), *[at.rate(at.count(F.col(c)), n).alias(k) for c, k in (("lower", "acc_lower"), ("correct", "acc"), ("upper", "acc_upper"))])


@query(adapter.SQL + "SELECT v.problem_id, CASE WHEN n_chains > 0 THEN (SELECT string_agg(CASE WHEN correct THEN '1' ELSE '0' END, '' ORDER BY chain_index) FROM chains c WHERE c.problem_id = v.problem_id AND c.arm = 'A') END AS verdicts, CASE WHEN n_chains > 0 THEN any_ok END AS any_correct, CASE WHEN n_chains > 0 THEN ok END AS majority FROM votes v WHERE arm = 'A'")
def sample_orm_stats(spark, sf_dir):
    """Verdicts of a problem's samples in order; null without a run."""
    v = at.voted(adapter.arms(spark, sf_dir), "a")
    some = F.size("a") > 0
    verdicts = F.array_join(F.transform("a", lambda c: F.when(c["correct"], "1").otherwise("0")), "")
    return v.select("problem_id", F.when(some, verdicts).alias("verdicts"), F.when(some, F.col("any_a")).alias("any_correct"), F.when(some, F.col("vote_a.correct")).alias("majority"))


@query(adapter.SQL + f"SELECT problem_id, dataset, definition, {_A} AS eligible FROM votes, {_DEFS} WHERE arm = 'A'")
def eligibility_long(spark, sf_dir):
    e = adapter.arms(spark, sf_dir).select("problem_id", "dataset", vote.eligibility(F.col("a")).alias("e")).select("problem_id", "dataset", "e.*")
    return e.unpivot(["problem_id", "dataset"], list(at.DEFINITIONS), "definition", "eligible")


_DETAIL = (
    adapter.SQL
    + f""", detail AS (SELECT problem_id, dataset, definition, e AS eligible, a_ok AS base_plurality_correct, a_any AS base_any_correct, b_ok AS samecap_plurality_correct, c_ok AS long_plurality_correct,
    e AND b_ok AS samecap_repair_plurality, e AND c_ok AS long_repair_plurality, e AND (definition = 'first_chain_wrong' OR NOT a_any) AND b_any AS samecap_repair_any,
    e AND (definition = 'first_chain_wrong' OR NOT a_any) AND c_any AS long_repair_any, e AND NOT b_ok AND c_ok AS incremental_plurality_helpful, e AND b_ok AND NOT c_ok AS incremental_plurality_harmful
    FROM (SELECT *, {_A} AS e FROM {_DEFS3}))"""
)


@query(
    _DETAIL
    + """SELECT problem_id, dataset, definition, eligible, base_plurality_correct, base_any_correct, samecap_plurality_correct, long_plurality_correct, samecap_repair_plurality, long_repair_plurality, samecap_repair_any, long_repair_any,
    incremental_plurality_helpful, incremental_plurality_harmful FROM detail"""
)
def three_arm_detail(spark, sf_dir):
    return at.three_arm_detail(adapter.paired(spark, sf_dir))


@query(
    _DETAIL
    + f"""SELECT {ALL}, definition, count(*) AS n_problems, {n_if("eligible")} AS n_eligible, {n_if("samecap_repair_plurality")} AS samecap_repair_count, {n_if("long_repair_plurality")} AS long_repair_count,
    {n_if("incremental_plurality_helpful")} AS incremental_helpful_count, {n_if("incremental_plurality_harmful")} AS incremental_harmful_count, {n_if("samecap_repair_any")} AS samecap_any_repair_count, {n_if("long_repair_any")} AS long_any_repair_count,
    {ratio(n_if("samecap_repair_plurality"), n_if("eligible"))} AS samecap_repair_rate, {ratio(n_if("long_repair_plurality"), n_if("eligible"))} AS long_repair_rate,
    {ratio("(" + n_if("long_repair_plurality") + " - " + n_if("samecap_repair_plurality") + ")", n_if("eligible"))} AS incremental_token_effect
    FROM detail GROUP BY GROUPING SETS ((definition), (definition, dataset))"""
)
def three_arm_summary(spark, sf_dir):
    return at.three_arm_summary(at.three_arm_detail(adapter.paired(spark, sf_dir)))


_HARM = (
    adapter.SQL
    + """, harm AS (SELECT problem_id, dataset, contrast, definition, e AS eligible, e AND s_ok AND NOT t_ok AS harm, e AND s_low AND NOT t_high AS certain_harm, e AND s_high AND NOT t_low AS possible_harm FROM (
    SELECT problem_id, dataset, contrast, definition, CASE definition WHEN 'complete_plurality_correct' THEN complete_plurality_correct ELSE complete_all_correct END AS e,
    CASE WHEN contrast LIKE 'A%' THEN a_ok ELSE b_ok END AS s_ok, CASE WHEN contrast LIKE 'A%' THEN a_low ELSE b_low END AS s_low, CASE WHEN contrast LIKE 'A%' THEN a_high ELSE b_high END AS s_high,
    CASE WHEN contrast LIKE '%to_B%' THEN b_ok ELSE c_ok END AS t_ok, CASE WHEN contrast LIKE '%to_B%' THEN b_low ELSE c_low END AS t_low, CASE WHEN contrast LIKE '%to_B%' THEN b_high ELSE c_high END AS t_high
    FROM (SELECT *, unnest(['complete_plurality_correct', 'complete_all_correct']) AS definition FROM (SELECT *, unnest(['A_to_B_resampling', 'A_to_C_combined', 'B_to_C_tokens']) AS contrast FROM three))))"""
)


@query(_HARM + "SELECT problem_id, dataset, contrast, definition, eligible, harm, certain_harm, possible_harm FROM harm")
def three_arm_harm(spark, sf_dir):
    return at.harm_detail(adapter.paired(spark, sf_dir))


@query(_HARM + f"SELECT {ALL}, contrast, definition, {n_if('eligible')} AS n_eligible, {n_if('harm')} AS harm_count, {n_if('certain_harm')} AS certain_harm_count, {n_if('possible_harm')} AS possible_harm_count, {ratio(n_if('harm'), n_if('eligible'))} AS harm_rate FROM harm GROUP BY GROUPING SETS ((contrast, definition), (contrast, definition, dataset))")
def harm_summary(spark, sf_dir):
    return at.harm_summary(at.harm_detail(adapter.paired(spark, sf_dir)))


_EXPANDED = adapter.SQL + f", x AS (SELECT problem_id, dataset, definition, e AS eligible, e AND c_ok AS repair_plurality, e AND (definition = 'first_chain_wrong' OR NOT b_any) AND c_any AS repair_any, e AND c_low AS repair_tie_lower, e AND c_high AS repair_tie_upper FROM (SELECT *, {_B} AS e FROM {_DEFS3}))"


@query(_EXPANDED + "SELECT problem_id, dataset, definition, eligible, repair_plurality, repair_any, repair_tie_lower, repair_tie_upper FROM x")
def expanded_repair_detail(spark, sf_dir):
    return at.expanded_repair_detail(adapter.paired(spark, sf_dir))


@query(
    _EXPANDED
    + f"SELECT {ALL}, definition, count(*) AS n_problems, {n_if('eligible')} AS n_eligible, {ratio(n_if('eligible'), 'count(*)')} AS eligible_rate, "
    + ", ".join(f"{n_if('repair_' + k)} AS repair_{k}_count, {ratio(n_if('repair_' + k), n_if('eligible'))} AS repair_{k}_rate" for k in ("plurality", "any", "tie_lower", "tie_upper"))
    + " FROM x GROUP BY GROUPING SETS ((definition), (definition, dataset))"
)
def expanded_repair_summary(spark, sf_dir):
    return at.expanded_repair_summary(at.expanded_repair_detail(adapter.paired(spark, sf_dir)))


_SAMPLING = (
    adapter.SQL
    + """, s AS (SELECT *, base_completion_state = 'all_complete_answered_wrong' AS cw FROM (SELECT *, CASE WHEN b_all_cut THEN 'all_truncated' WHEN b_some_cut THEN 'mixed_truncated_complete'
    WHEN b_answered AND NOT b_any THEN 'all_complete_answered_wrong' ELSE 'complete_other' END AS base_completion_state FROM three)),
    detail AS (SELECT problem_id, dataset, b_pass1 AS base_pass1, c_pass1 AS ext_pass1, b_ok AS base_maj_correct, b_tie AS base_maj_tied, c_ok AS ext_maj_correct, c_tie AS ext_maj_tied, c_low AS ext_maj_correct_all_tie,
    c_high AS ext_maj_correct_any_tie, base_completion_state, b_some_cut AS base_truncated, cw AS base_complete_wrong, NOT b_ok AND c_ok AS helpful_maj, b_ok AND NOT c_ok AS harm_maj,
    cw AND c_ok AS repaired_maj, cw AND c_any AS repaired_any, cw AND c_low AS repaired_tie_lower, cw AND c_high AS repaired_tie_upper FROM s)"""
)


@query(
    _SAMPLING
    + """SELECT problem_id, dataset, base_pass1, ext_pass1, base_maj_correct, base_maj_tied, ext_maj_correct, ext_maj_tied, ext_maj_correct_all_tie, ext_maj_correct_any_tie, base_completion_state, base_truncated, base_complete_wrong,
    helpful_maj, harm_maj, repaired_maj, repaired_any, repaired_tie_lower, repaired_tie_upper FROM detail"""
)
def sampling_repair_detail(spark, sf_dir):
    return at.sampling_repair_detail(adapter.paired(spark, sf_dir))


@query(
    _SAMPLING
    + f"""SELECT {ALL}, count(*) AS n, {r6("avg(base_pass1)")} AS base_pass1, {r6("avg(ext_pass1)")} AS ext_pass1, {r6("avg(ext_pass1) - avg(base_pass1)")} AS pass1_delta, {ratio(n_if("base_maj_correct"), "count(*)")} AS base_maj_acc,
    {ratio(n_if("ext_maj_correct"), "count(*)")} AS ext_maj_acc, {ratio("(" + n_if("ext_maj_correct") + " - " + n_if("base_maj_correct") + ")", "count(*)")} AS maj_acc_delta, {ratio(n_if("base_maj_tied"), "count(*)")} AS base_maj_tie_rate,
    {ratio(n_if("ext_maj_tied"), "count(*)")} AS ext_maj_tie_rate, {ratio(n_if("ext_maj_correct_all_tie"), "count(*)")} AS ext_maj_acc_tie_lower, {ratio(n_if("ext_maj_correct_any_tie"), "count(*)")} AS ext_maj_acc_tie_upper,
    {ratio(n_if("helpful_maj"), "count(*)")} AS helpful_maj_rate, {ratio(n_if("harm_maj"), "count(*)")} AS harm_maj_rate, {ratio(n_if("base_truncated"), "count(*)")} AS base_trunc_rate, {n_if("base_complete_wrong")} AS n_complete_wrong,
    {n_if("repaired_maj")} AS repair_count_maj, {n_if("repaired_any")} AS repair_count_any, {n_if("repaired_tie_lower")} AS repair_count_maj_tie_lower, {n_if("repaired_tie_upper")} AS repair_count_maj_tie_upper,
    {ratio(n_if("repaired_maj"), n_if("base_complete_wrong"))} AS repair_rate_maj, {ratio(n_if("repaired_any"), n_if("base_complete_wrong"))} AS repair_rate_any,
    {ratio(n_if("helpful_maj AND base_truncated"), n_if("helpful_maj"))} AS helpful_from_truncated, {ratio(n_if("helpful_maj AND base_complete_wrong"), n_if("helpful_maj"))} AS helpful_from_complete_wrong,
    {ratio(n_if("helpful_maj AND base_completion_state = 'mixed_truncated_complete'"), n_if("helpful_maj"))} AS helpful_from_mixed, {ratio(n_if("helpful_maj AND base_completion_state = 'complete_other'"), n_if("helpful_maj"))} AS helpful_from_complete_other,
    {n_if("helpful_maj")} AS helpful_taxonomy_n FROM detail GROUP BY GROUPING SETS ((), (dataset))"""
)
def sampling_repair_summary(spark, sf_dir):
    return at.sampling_repair_summary(at.sampling_repair_detail(adapter.paired(spark, sf_dir)))


@query(_SAMPLING + f"SELECT base_completion_state, count(*) AS n, {n_if('helpful_maj')} AS helpful, {n_if('harm_maj')} AS harmful, {ratio('count(*)', '(SELECT count(*) FROM detail)')} AS share FROM detail GROUP BY ALL")
def completion_taxonomy(spark, sf_dir):
    d = at.sampling_repair_detail(adapter.paired(spark, sf_dir))
    by = d.groupBy("base_completion_state").agg(F.count(F.lit(1)).alias("n"), at.count(F.col("helpful_maj")).alias("helpful"), at.count(F.col("harm_maj")).alias("harmful"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("base_completion_state", "n", "helpful", "harmful", at.rate(F.col("n"), F.col("total")).alias("share"))


@query(
    adapter.SQL
    + f""", kept AS (SELECT problem_id, dataset, answer, correct, token_count <= 35 AS kept FROM chains WHERE arm = 'C'), kt AS (SELECT problem_id, answer, count(*) AS n, bool_or(correct) AS ok FROM kept WHERE kept AND answer IS NOT NULL GROUP BY ALL),
    km AS (SELECT *, max(n) OVER (PARTITION BY problem_id) AS most FROM kt), kw AS (SELECT problem_id, arg_min(ok, answer) AS ok FROM km WHERE n = most GROUP BY ALL),
    ks AS (SELECT problem_id, count(*) AS n, {n_if("NOT kept")} AS cut FROM kept GROUP BY ALL),
    j AS (SELECT dataset, strict_all_wrong AS e, c_ok AS x, coalesce(kw.ok, false) AS k, ks.n, ks.cut FROM three JOIN ks USING (problem_id) LEFT JOIN kw USING (problem_id))
    SELECT {ALL}, count(*) AS n, {n_if("e")} AS n_eligible, {n_if("e AND x")} AS real_repairs, {n_if("e AND k")} AS control_repairs, {n_if("e AND x AND NOT k")} AS token_dependent_repairs, CAST(sum(cut) AS BIGINT) AS censored_chains,
    {ratio("sum(cut)", "sum(n)")} AS censored_chain_rate FROM j GROUP BY GROUPING SETS ((), (dataset))"""
)
def same_budget_control(spark, sf_dir):
    return at.same_budget_control(adapter.paired(spark, sf_dir), "a", "c", adapter.BASE_CAP)


_FIRST = (
    adapter.SQL
    + """, greedy AS (SELECT b.problem_id, b.dataset, b.math_level, b.correct AS base_ok, c.correct AS long_ok, NOT b.complete AS base_cut, b.answer IS NOT NULL AS base_boxed, b.token_count AS base_tokens, c.token_count AS long_tokens
    FROM chains b JOIN chains c USING (problem_id) JOIN three USING (problem_id) WHERE b.arm = 'B' AND c.arm = 'C' AND b.chain_index = 0 AND c.chain_index = 0)"""
)


def _greedy(spark, sf_dir):
    return at.first_chain_frame(adapter.paired(spark, sf_dir))


@query(_FIRST + "SELECT problem_id, CASE WHEN base_ok AND long_ok THEN 'already_solved' WHEN base_ok THEN 'long_harm' WHEN NOT long_ok THEN 'no_utility' WHEN base_cut OR NOT base_boxed THEN 'completion_recovery' ELSE 'reasoning_recovery' END AS utility, CAST(NOT base_ok AND long_ok AS INTEGER) AS utility_label FROM greedy")
def utility_taxonomy(spark, sf_dir):
    f = F.col
    return _greedy(spark, sf_dir).select("problem_id", at.utility(f("base_ok"), f("long_ok"), f("base_cut"), f("base_boxed")).alias("utility"), (~f("base_ok") & f("long_ok")).cast("int").alias("utility_label"))


@query(
    adapter.SQL
    + f""", f AS (SELECT dataset, token_count, correct FROM chains JOIN (SELECT problem_id FROM three) USING (problem_id) WHERE arm = 'C' AND chain_index = 0),
    p AS (SELECT dataset, medium, long, correct AND token_count <= medium AS m, correct AND token_count <= long AS x, token_count > medium AS h FROM f, (VALUES (15, 25), (25, 35), (35, 50)) v(medium, long))
    SELECT {ALL}, medium, long, count(*) AS n, {ratio(n_if("m"), "count(*)")} AS medium_acc, {ratio(n_if("x"), "count(*)")} AS long_acc, {n_if("NOT m AND x")} AS helpful, {n_if("m AND NOT x")} AS harmful, {ratio(n_if("h"), "count(*)")} AS medium_hit_max_rate
    FROM p GROUP BY GROUPING SETS ((medium, long), (medium, long, dataset))"""
)
def budget_pair_scaling(spark, sf_dir):
    return at.budget_pair_scaling(adapter.paired(spark, sf_dir), [(15, 25), (25, 35), (35, 50)])


def _metric(name: str, value: str) -> str:
    return f"SELECT '{name}' AS metric, {value} AS value FROM m"


_part = lambda a, b: f"CASE WHEN {b} > 0 THEN printf('%.6f', round(CAST({a} AS DOUBLE) / {b}, 6)) END"


@query(
    _FIRST
    + f""", m AS (SELECT count(*) AS n, {n_if("base_ok")} AS b, {n_if("long_ok")} AS l, {n_if("NOT base_ok AND long_ok")} AS h, {n_if("base_cut")} AS hits, {n_if("NOT base_ok AND long_ok AND (base_cut OR NOT base_boxed)")} AS hi,
    {n_if("NOT base_ok AND long_ok AND base_cut")} AS hh, {n_if("NOT base_ok AND NOT base_cut AND base_boxed")} AS cbw, {n_if("NOT base_ok AND NOT base_cut AND base_boxed AND long_ok")} AS fixed, {n_if("CASE WHEN base_cut THEN long_ok ELSE base_ok END")} AS routed FROM greedy) """
    + " UNION ALL ".join(
        _metric(k, v)
        for k, v in {
            "n": "CAST(n AS VARCHAR)", "medium_budget": "'35'", "long_budget": "'50'", "medium_acc": _part("b", "n"), "long_acc": _part("l", "n"), "gain": _part("(l - b)", "n"), "helpful_count": "CAST(h AS VARCHAR)", "helpful_rate": _part("h", "n"),
            "medium_hit_max_count": "CAST(hits AS VARCHAR)", "medium_hit_max_rate": _part("hits", "n"), "helpful_incomplete_frac": _part("hi", "h"), "helpful_hitmax_frac": _part("hh", "h"), "complete_but_wrong_count": "CAST(cbw AS VARCHAR)",
            "complete_but_wrong_rate": _part("cbw", "n"), "complete_but_wrong_fixed": "CAST(fixed AS VARCHAR)", "complete_but_wrong_fix_rate": _part("fixed", "cbw"), "hitmax_rule_routed": _part("hits", "n"), "hitmax_rule_acc": _part("routed", "n"),
            "random_same_fraction_acc_expected": _part("(b + CAST(hits AS DOUBLE) / n * (l - b))", "n"),
        }.items()
    )
)
def mechanism_summary(spark, sf_dir):
    return at.mechanism_summary(_greedy(spark, sf_dir), adapter.BASE_CAP, adapter.LONG_CAP)


@query(
    _FIRST
    + f""", s AS (SELECT *, NOT base_ok AND NOT base_cut AND (subset = 'relaxed' OR base_boxed) AS i FROM greedy, (VALUES ('strict'), ('relaxed')) v(subset))
    SELECT {ALL}, subset, count(*) AS n, {n_if("i")} AS n_subset, {ratio(n_if("i"), "count(*)")} AS subset_rate, coalesce({ratio(n_if("i AND long_ok"), n_if("i"))}, 0) AS fixed_rate, coalesce({r6("avg(base_tokens) FILTER (WHERE i)")}, 0) AS mean_tokens
    FROM s GROUP BY GROUPING SETS ((subset), (subset, dataset))"""
)
def complete_wrong_summary(spark, sf_dir):
    return at.complete_wrong_summary(_greedy(spark, sf_dir))


@query(_FIRST + f"SELECT {ALL}, count(*) AS n, {n_if('NOT base_ok AND long_ok')} AS helpful, {n_if('base_ok AND NOT long_ok')} AS harmful, {n_if('NOT base_ok AND long_ok')} - {n_if('base_ok AND NOT long_ok')} AS net FROM greedy GROUP BY GROUPING SETS ((), (dataset))")
def transition_counts(spark, sf_dir):
    return at.transition_counts(_greedy(spark, sf_dir))


_ABC = adapter.SQL + ", g AS (SELECT problem_id, dataset, a_ok AS base_ok, c_ok AS long_ok FROM three)"


@query(_ABC + f", k AS (SELECT {ALL}, count(*) AS n, {n_if('base_ok')} AS n_correct, {n_if('base_ok AND NOT long_ok')} AS n_lost FROM g GROUP BY GROUPING SETS ((), (dataset))) SELECT *, {r6('CAST(n_lost AS DOUBLE) / greatest(n_correct, 1)')} AS chr, CASE WHEN CAST(n_lost AS DOUBLE) / greatest(n_correct, 1) > 0.05::DOUBLE THEN 'high' WHEN CAST(n_lost AS DOUBLE) / greatest(n_correct, 1) < 0.02::DOUBLE THEN 'low' ELSE 'moderate' END AS verdict FROM k")
def chr_rate(spark, sf_dir):
    v = at.voted(adapter.paired(spark, sf_dir), "a", "c")
    return at.correct_to_wrong(v.select("dataset", F.col("vote_a.correct").alias("base_ok"), F.col("vote_c.correct").alias("long_ok")))


@query(_ABC + f"SELECT dataset, count(*) AS n, {n_if('base_ok AND long_ok')} AS both, {n_if('base_ok AND NOT long_ok')} AS reference_only, {n_if('NOT base_ok AND long_ok')} AS target_only, {n_if('NOT base_ok AND NOT long_ok')} AS neither FROM g GROUP BY ALL")
def paired_2x2(spark, sf_dir):
    v = at.voted(adapter.paired(spark, sf_dir), "a", "c")
    return at.paired_counts(v.select("dataset", F.col("vote_a.correct").alias("r"), F.col("vote_c.correct").alias("t")), "r", "t", "dataset")


# Chains as texts: line items of an order, in five forms; the gold answer is from the customer's key.
_WRITTEN = """WITH w AS (SELECT l_orderkey AS problem_id, CASE WHEN o_orderstatus = 'F' THEN 'gsm8k' ELSE 'math' END AS dataset, CAST(o_custkey % 50 + 1 AS INTEGER) AS g, l_linestatus AS status, CAST(l_quantity AS INTEGER) AS tokens,
    CASE WHEN l_partkey % 3 = 0 THEN CAST(o_custkey % 50 + 1 AS INTEGER) ELSE CAST(l_quantity AS INTEGER) END AS v, CAST(l_suppkey % 5 AS INTEGER) AS form,
    row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag) AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT *, v = g AS same, dataset = 'gsm8k' AS numeric, CASE WHEN dataset = 'gsm8k' THEN CAST(v AS VARCHAR) ELSE CASE form WHEN 0 THEN CAST(v AS VARCHAR) WHEN 1 THEN v || '^circ' WHEN 3 THEN v || 'cm' WHEN 4 THEN v || 'degrees' END END AS answer FROM w)"""
_FORMS = ("\\boxed{%s}", "\\boxed{%s^\\circ}", "about %s", "\\boxed{%s\\text{ cm}}", "\\boxed{%s\\text{degrees}}")


def _written(spark, sf_dir, status: str, cap: int) -> DataFrame:
    """The run of a line status, in a table, as checks of ids and of fields read it too: a chain beyond the cap ends early
    and without a box."""
    o = adapter.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("problem_id"), F.when(F.col("o_orderstatus") == "F", "gsm8k").otherwise("math").alias("dataset"), (F.col("o_custkey") % 50 + 1).cast("int").cast("string").alias("g"))
    o = o.select("problem_id", "dataset", F.lit(None).cast("int").alias("math_level"), F.lit("?").alias("question"), F.when(F.col("dataset") == "gsm8k", F.concat(F.lit("so #### "), "g")).otherwise(F.concat(F.lit("\\boxed{"), "g", F.lit("}"))).alias("answer"), "g")
    lines = adapter.table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status).groupBy(F.col("l_orderkey").alias("problem_id")).agg(F.array_sort(F.collect_list(F.struct(*adapter.ORDER))).alias("lines"))

    def chain(x):
        tokens = x["l_quantity"].cast("int")
        v = F.when(x["l_partkey"] % 3 == 0, F.col("g")).otherwise(tokens.cast("string"))
        said = F.element_at(F.array(*[F.format_string(f, v) for f in _FORMS]), (x["l_suppkey"] % 5).cast("int") + 1)
        return F.struct(F.when(tokens > cap, F.concat(F.lit("about "), v)).otherwise(said).alias("text"), F.least(tokens, F.lit(cap)).alias("token_count"), F.when(tokens > cap, "length").otherwise("stop").alias("finish_reason"))

    return materialise(o.join(lines, "problem_id").withColumn("chains", F.transform("lines", chain)).drop("lines", "g"), "run")


@query(
    _WRITTEN
    + f""", d AS (SELECT dataset, same AND (numeric OR form = 0) AND (numeric OR tokens <= 35) AS sm, same AND (numeric OR form = 0) AS sl, same AND (numeric OR (tokens <= 35 AND form <> 3)) AS rm, same AND (numeric OR form <> 3) AS rl FROM x WHERE status = 'O' AND place = 1),
    s AS (SELECT dataset, 'strict' AS setting, sm AS p, sl AS q FROM d UNION ALL SELECT dataset, 'relaxed', rm, rl FROM d)
    SELECT {ALL}, setting, count(*) AS n, {ratio(n_if("p"), "count(*)")} AS medium_acc, {ratio(n_if("q"), "count(*)")} AS long_acc, {ratio(n_if("NOT p AND q"), "count(*)")} AS helpful_ml_rate, {ratio(n_if("p AND NOT q"), "count(*)")} AS long_harm_rate
    FROM s GROUP BY GROUPING SETS ((setting), (setting, dataset))"""
)
def strict_relaxed_summary(spark, sf_dir):
    """First chains at caps 35 and 50, by the whole verifier and its relaxed rule for units and numbers."""
    return at.strict_relaxed_summary(runs.relaxed_detail(_written(spark, sf_dir, "O", 35), _written(spark, sf_dir, "O", 50), 35, 50))


@query(
    _WRITTEN
    + f""", a AS (SELECT problem_id FROM x WHERE status = 'F' GROUP BY problem_id HAVING bool_and(tokens <= 35) AND bool_and(answer IS NOT NULL) AND NOT bool_or(same AND (numeric OR form = 0))),
    c AS (SELECT problem_id, unnest([0, 1]) AS relaxed, answer AS strict, same AND (numeric OR form = 0) AS ok, same AND NOT numeric AND form = 2 AS late, CAST(v AS VARCHAR) AS said FROM x SEMI JOIN a USING (problem_id) WHERE status = 'O'),
    t AS (SELECT problem_id, relaxed, CASE WHEN relaxed = 1 THEN coalesce(strict, said) ELSE strict END AS answer, bool_or(ok OR (relaxed = 1 AND late)) AS ok, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY problem_id, relaxed) AS most FROM t WHERE answer IS NOT NULL),
    v AS (SELECT problem_id, relaxed, arg_min(ok, answer) AS ok FROM m WHERE n = most GROUP BY ALL), pool AS (SELECT problem_id FROM a SEMI JOIN c USING (problem_id)),
    s AS (SELECT count(*) AS n, {n_if("p.ok")} AS k, {n_if("r.ok")} AS r FROM pool b LEFT JOIN v p ON p.problem_id = b.problem_id AND p.relaxed = 0 LEFT JOIN v r ON r.problem_id = b.problem_id AND r.relaxed = 1)
    SELECT n AS n_eligible, k AS strict_plurality_repair, r AS relaxed_plurality_repair, r - k AS hidden_by_strict_matching FROM s"""
)
def hidden_repair_audit(spark, sf_dir):
    """Repairs that only a last number shows; recorded verdicts are checked against strict scoring."""
    pick = lambda d, n: d.select("problem_id", F.col("chains").alias(n))
    a, long = runs.scored(_written(spark, sf_dir, "F", 35), 35), _written(spark, sf_dir, "O", 50)
    c = runs.scored(long, 50)
    arms = a.withColumnRenamed("chains", "a").join(pick(c, "c"), "problem_id").withColumn("b", F.col("a"))
    return runs.verifier_audit(at.three_arm_detail(arms), long, 50).drop("upper95")
