"""Queries on statistics, resampling and routing, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import attribution as at
from ..operators import evaluate, resample, routing, vote
from . import adapter
from .votes import _FIRST, _HARM, _SAMPLING, ALL, n_if, r6, ratio

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- statistics -----------------------------------------------------------------------------------------------------
_TREE = adapter.SQL + f", k AS (SELECT {ALL}, math_level, count(*) AS n, {n_if('c_ok')} AS k FROM three GROUP BY GROUPING SETS ((math_level), (math_level, dataset)))"


def _counts(spark, sf_dir):
    v = at.voted(adapter.paired(spark, sf_dir), "c")
    return at.over_all(v, ["math_level"], F.count(F.lit(1)).alias("n"), at.count(F.col("vote_c.correct")).alias("k"))


def _duck_cdf(k: str, n: str, p: str) -> str:
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))"
    return f"least(1, list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: {term})))"


def _bisected(counts: str, keys: str, columns: str) -> str:
    """DuckDB: exact bounds of k of n by 42 halvings of [0, 1]; counts is a CTE prefix that ends in a relation k."""
    lower, upper = f"1 - {_duck_cdf('k - 1', 'n', '((lo + hi) / 2)')} > 0.025::DOUBLE", f"{_duck_cdf('k', 'n', '((lo2 + hi2) / 2)')} > {{alpha}}::DOUBLE"
    upper = upper.format(alpha="{alpha}")
    steps = f"""bis AS (SELECT {keys}, n, k, 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2 FROM k UNION ALL
    SELECT {keys}, n, k, step + 1, CASE WHEN {lower} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN {lower} THEN (lo + hi) / 2 ELSE hi END,
    CASE WHEN {upper} THEN (lo2 + hi2) / 2 ELSE lo2 END, CASE WHEN {upper} THEN hi2 ELSE (lo2 + hi2) / 2 END FROM bis WHERE step < 42)"""
    return counts.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + steps + f" SELECT {columns} FROM bis WHERE step = 42"


_LOW = "CASE WHEN n = 0 OR k = 0 THEN 0.0::DOUBLE ELSE (lo + hi) / 2 END"
_HIGH = "CASE WHEN n = 0 OR k = n THEN 1.0::DOUBLE ELSE (lo2 + hi2) / 2 END"


@query(_bisected(_TREE, "dataset, math_level", f"dataset, math_level, n, k, {r6(_LOW)} AS ci_low, {r6(_HIGH)} AS ci_high").replace("{alpha}", "0.025"))
def cp_interval(spark, sf_dir):
    """Exact two-sided intervals; golden arithmetic is in the tests."""
    c = _counts(spark, sf_dir).withColumn("ci", stats.interval_udf(F.col("k"), F.col("n")))
    return c.select("dataset", "math_level", "n", "k", F.round("ci.low", 6).alias("ci_low"), F.round("ci.high", 6).alias("ci_high"))


_HARM_COUNTS = _HARM + f", k AS (SELECT {ALL}, contrast, definition, {n_if('eligible')} AS n, {n_if('harm')} AS k, {n_if('certain_harm')} AS ch, {n_if('possible_harm')} AS ph FROM harm GROUP BY GROUPING SETS ((contrast, definition), (contrast, definition, dataset)))"


@query(_bisected(_HARM_COUNTS, "dataset, contrast, definition, ch, ph", f"contrast, definition, dataset, n AS n_eligible, k AS harm_count, {ratio('k', 'n')} AS harm_rate, {r6(_LOW)} AS ci95_low, {r6(_HIGH)} AS ci95_high, ch AS certain_harm_count, ph AS possible_harm_count").replace("{alpha}", "0.025"))
def harm_summary_ci(spark, sf_dir):
    h = at.harm_summary(at.harm_detail(adapter.paired(spark, sf_dir))).withColumn("ci", stats.interval_udf(F.col("harm_count"), F.col("n_eligible")))
    return h.select("contrast", "definition", "dataset", "n_eligible", "harm_count", "harm_rate", F.round("ci.low", 6).alias("ci95_low"), F.round("ci.high", 6).alias("ci95_high"), "certain_harm_count", "possible_harm_count")


@query(_bisected(_TREE.replace(n_if("c_ok"), n_if("NOT c_ok")), "dataset, math_level", f"dataset, math_level, n, n - k AS k, {r6(_HIGH)} AS error_upper95").replace("{alpha}", "0.05"))
def upper_bound_exact(spark, sf_dir):
    c = _counts(spark, sf_dir)
    return c.select("dataset", "math_level", "n", "k", F.round(stats.upper_udf(F.col("n") - F.col("k"), F.col("n")), 6).alias("error_upper95"))


@query(_TREE + f" SELECT dataset, math_level, n, {r6('1 - pow(0.05::DOUBLE, 1.0::DOUBLE / n)')} AS upper_zero, {r6('1 - pow(0.025::DOUBLE, 1.0::DOUBLE / n)')} AS planned_upper FROM k")
def upper_zero_event(spark, sf_dir):
    return _counts(spark, sf_dir).select("dataset", "math_level", "n", F.round(stats.upper_zero(F.col("n")), 6).alias("upper_zero"), F.round(stats.planned_upper(F.col("n")), 6).alias("planned_upper"))


_Z = "1.959963984540054::DOUBLE"
_P = "CAST(k AS DOUBLE) / n"


@query(
    _TREE
    + f""" SELECT dataset, math_level, n, k, {r6(f"greatest(0, ({_P} + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt({_P} * (1 - {_P}) / n + {_Z} * {_Z} / (4.0::DOUBLE * n * n))) / (1 + {_Z} * {_Z} / n))")} AS low,
    {r6(f"least(1, ({_P} + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt({_P} * (1 - {_P}) / n + {_Z} * {_Z} / (4.0::DOUBLE * n * n))) / (1 + {_Z} * {_Z} / n))")} AS high FROM k"""
)
def wilson_ci(spark, sf_dir):
    c = _counts(spark, sf_dir).withColumn("w", stats.wilson(F.col("k"), F.col("n")))
    return c.select("dataset", "math_level", "n", "k", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(
    _HARM
    + f", s AS (SELECT contrast, definition, {n_if('eligible')} AS n, {n_if('harm')} AS k FROM harm GROUP BY ALL) SELECT contrast, definition, n, k, "
    + ", ".join(f"{r6('CASE WHEN k >= n THEN 1.0 ELSE ' + _duck_cdf('k', 'n', f'{m}::DOUBLE') + ' END')} AS p_margin_{int(m * 100)}" for m in stats.MARGINS)
    + " FROM s"
)
def equivalence_p(spark, sf_dir):
    """P(X <= k) if the rate were the margin, for each margin."""
    s = at.harm_detail(adapter.paired(spark, sf_dir)).groupBy("contrast", "definition").agg(at.count(F.col("eligible")).alias("n"), at.count(F.col("harm")).alias("k"))
    return s.select("*", *[F.round(stats.binomial_cdf(F.col("k"), F.col("n"), m), 6).alias(f"p_margin_{int(m * 100)}") for m in stats.MARGINS])


@query(_TREE + f" SELECT dataset, math_level, n, {r6('1 - pow(1 - 0.8::DOUBLE, 1.0::DOUBLE / n)')} AS detectable_rate FROM k")
def detectable_rate(spark, sf_dir):
    return _counts(spark, sf_dir).select("dataset", "math_level", "n", F.round(stats.detectable(F.col("n")), 6).alias("detectable_rate"))


@query(
    adapter.SQL
    + f""", d AS (SELECT math_level, {n_if("a_ok AND NOT c_ok")} AS only_reference, {n_if("c_ok AND NOT a_ok")} AS only_target FROM three GROUP BY ALL)
    SELECT *, CASE WHEN only_reference + only_target > 0 THEN {r6("least(1, 2 * " + _duck_cdf("least(only_reference, only_target)", "(only_reference + only_target)", "0.5::DOUBLE") + ")")} END AS p FROM d"""
)
def mcnemar_exact(spark, sf_dir):
    v = at.voted(adapter.paired(spark, sf_dir), "a", "c").select("math_level", F.col("vote_a.correct").alias("a"), F.col("vote_c.correct").alias("c"))
    d = v.groupBy("math_level").agg(F.count_if(F.col("a") & ~F.col("c")).alias("only_reference"), F.count_if(F.col("c") & ~F.col("a")).alias("only_target"))
    return d.select("*", F.round(stats.mcnemar_native(F.col("only_reference"), F.col("only_target")), 6).alias("p"))


@query(_TREE.replace("c_ok", "strict_all_wrong") + f", e AS (SELECT dataset, math_level, n, k, floor(CAST(k AS DOUBLE) * seeds) AS expected, seeds FROM k, (VALUES (1), (2), (3), (5)) v(seeds)) SELECT dataset, math_level, n, k, seeds, CAST(expected AS BIGINT) AS expected_eligible, {r6('CASE WHEN expected > 0 THEN 1 - pow(0.025::DOUBLE, 1.0::DOUBLE / expected) ELSE 1.0 END')} AS planned_upper FROM e")
def seed_plan(spark, sf_dir):
    """Bounds that more seeds would give if none of the eligible problems had an event."""
    e = at.over_all(adapter.paired(spark, sf_dir).withColumn("e", vote.eligibility(F.col("a"))["strict_all_wrong"]), ["math_level"], F.count(F.lit(1)).alias("n"), at.count(F.col("e")).alias("k"))
    e = e.select("*", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3, 5)])).alias("seeds")).withColumn("expected_eligible", F.floor(F.col("k").cast("double") * F.col("seeds")))
    return e.select("dataset", "math_level", "n", "k", "seeds", "expected_eligible", F.round(stats.planned_upper(F.col("expected_eligible")), 6).alias("planned_upper"))


# --- seeds and temperatures -----------------------------------------------------------------------------------------
_SEEDS = "CASE l_suppkey % 3 WHEN 0 THEN 42 WHEN 1 THEN 314159 ELSE 271828 END"
_SEEDED = f"""
WITH r AS (SELECT l_orderkey AS problem_id, {_SEEDS} AS seed, count(*) AS n, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL),
whole AS (SELECT problem_id FROM r GROUP BY problem_id HAVING count(*) = 3), kept AS (SELECT * FROM r SEMI JOIN whole USING (problem_id))
"""


def _seeded(spark, sf_dir):
    """A row per problem and seed, of problems that all three seeds have."""
    rows = adapter.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("problem_id"), F.when(F.col("l_suppkey") % 3 == 0, 42).when(F.col("l_suppkey") % 3 == 1, 314159).otherwise(271828).alias("seed"), "l_returnflag")
    by = rows.groupBy("problem_id", "seed").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    packed = by.groupBy("problem_id").agg(F.collect_list(F.struct("seed", "a", "b")).alias("s")).filter(F.size("s") == 3)
    return packed.select("problem_id", F.explode("s").alias("s")).select("problem_id", "s.*")


@query(_SEEDED + f"SELECT seed, count(*) AS n_problems, {n_if('a')} AS n_eligible, {n_if('a AND b')} AS k, {ratio(n_if('a AND b'), n_if('a'))} AS rate FROM kept GROUP BY GROUPING SETS ((seed), ())")
def seed_pooled(spark, sf_dir):
    """Counts by seed, and summed over all (null seed)."""
    rows = _seeded(spark, sf_dir)
    out = rows.groupingSets([[F.col("seed")], []], "seed").agg(F.count(F.lit(1)).alias("n_problems"), at.count(F.col("a")).alias("n_eligible"), at.count(F.col("a") & F.col("b")).alias("k"))
    return out.withColumn("rate", at.rate(F.col("k"), F.col("n_eligible")))


@query(
    "SELECT l_shipdate IS NULL AS unknown, round(l_tax, 2) AS temperature, CASE l_suppkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS model, count(*) AS n, count(DISTINCT l_suppkey % 3) AS seeds, count(*) FILTER (WHERE l_returnflag = 'A') AS n_eligible, "
    "count(*) FILTER (WHERE l_returnflag = 'A' AND l_discount > 0.05) AS helpful FROM lineitem GROUP BY ALL"
)
def temperature_table(spark, sf_dir):
    """A model by temperature table; temperatures come from the rows."""
    t = adapter.table(spark, sf_dir, "lineitem")
    model = F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd")
    by = t.groupBy(F.col("l_shipdate").isNull().alias("unknown"), F.round("l_tax", 2).alias("temperature"), model.alias("model"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("l_suppkey") % 3).alias("seeds"), F.count_if(F.col("l_returnflag") == "A").alias("n_eligible"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.05)).alias("helpful"))


# --- resampling -----------------------------------------------------------------------------------------------------
_SUBSETS = (
    adapter.SQL
    + """, few AS (SELECT problem_id, dataset, n_chains AS n FROM votes WHERE arm = 'C' AND n_chains > 0),
    masks AS (SELECT problem_id, dataset, n, m, bit_count(m) AS k FROM (SELECT *, unnest(range(1, CAST(1 << n AS BIGINT))) AS m FROM few) WHERE bit_count(m) IN (1, 2, 4)),
    picked AS (SELECT m.problem_id, m.dataset, m.k, m.m, c.answer, c.correct FROM masks m JOIN chains c ON c.problem_id = m.problem_id AND c.arm = 'C' AND (m.m >> c.chain_index) & 1 = 1),
    pt AS (SELECT problem_id, k, m, answer, count(*) AS n, bool_or(correct) AS ok FROM picked WHERE answer IS NOT NULL GROUP BY ALL), pm AS (SELECT *, max(n) OVER (PARTITION BY problem_id, m) AS most FROM pt),
    pw AS (SELECT problem_id, m, arg_min(ok, answer) AS ok, count(*) > 1 AS tie, bool_and(ok) AS low, bool_or(ok) AS high FROM pm WHERE n = most GROUP BY ALL),
    audit AS (SELECT m.problem_id, m.dataset, CAST(m.k AS INTEGER) AS k, count(*) AS n_subsets, round(avg(CAST(coalesce(ok, false) AS INTEGER)), 6) AS accuracy, round(avg(CAST(coalesce(tie, false) AS INTEGER)), 6) AS tie_rate,
        round(avg(CAST(coalesce(low, false) AS INTEGER)), 6) AS acc_lower, round(avg(CAST(coalesce(high, false) AS INTEGER)), 6) AS acc_upper FROM masks m LEFT JOIN pw USING (problem_id, m) GROUP BY ALL)
    """
)


@query(_SUBSETS + "SELECT * FROM audit")
def subset_audit_k(spark, sf_dir):
    return resample.subset_audit(adapter.arms(spark, sf_dir), "c", (1, 2, 4))


@query(_SUBSETS + f"SELECT {ALL}, k, count(*) AS n_problems, {r6('avg(accuracy)')} AS accuracy, {r6('avg(tie_rate)')} AS tie_rate, {r6('avg(acc_lower)')} AS acc_lower, {r6('avg(acc_upper)')} AS acc_upper FROM audit GROUP BY GROUPING SETS ((k), (k, dataset))")
def subset_summary(spark, sf_dir):
    return resample.subset_summary(resample.subset_audit(adapter.arms(spark, sf_dir), "c", (1, 2, 4)))


@query(
    adapter.SQL
    + f""", four AS (SELECT problem_id FROM votes WHERE arm = 'A' AND n_chains = 4), a AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS assignment, i, j FROM range(4) x(i), range(4) y(j) WHERE i < j),
    p AS (SELECT a.*, c.problem_id, chain_index IN (i, j) AS selector, answer, correct, complete FROM a, chains c SEMI JOIN four USING (problem_id) WHERE arm = 'A'),
    s AS (SELECT assignment, i, j, problem_id, bool_and(complete) AND bool_and(answer IS NOT NULL) AND NOT bool_or(correct) AS e FROM p WHERE selector GROUP BY ALL),
    t AS (SELECT assignment, problem_id, answer, count(*) AS n, bool_or(correct) AS ok FROM p WHERE NOT selector AND answer IS NOT NULL GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY assignment, problem_id) AS most FROM t),
    w AS (SELECT assignment, problem_id, arg_min(ok, answer) AS ok FROM m WHERE n = most GROUP BY ALL)
    SELECT CAST(s.assignment AS INTEGER) AS assignment, i || ',' || j AS selector_indices, {n_if("e")} AS n_eligible, {n_if("e AND coalesce(ok, false)")} AS repair_count, {ratio(n_if("e AND coalesce(ok, false)"), n_if("e"))} AS repair_rate
    FROM s LEFT JOIN w USING (assignment, problem_id) GROUP BY ALL"""
)
def split_null(spark, sf_dir):
    return resample.split_null(resample.of_problems(adapter.arms(spark, sf_dir), "a", 4), "a", 2)


_CELLS = adapter.SQL + f", x AS (SELECT dataset, 'base' AS budget, '1' AS k, b_pass1 AS v FROM three UNION ALL SELECT dataset, 'base', 'max', CAST(b_ok AS INTEGER) FROM three UNION ALL SELECT dataset, 'extended', '1', c_pass1 FROM three UNION ALL SELECT dataset, 'extended', 'max', CAST(c_ok AS INTEGER) FROM three), cells AS (SELECT {ALL}, budget, k, {r6('avg(v)')} AS accuracy FROM x GROUP BY GROUPING SETS ((budget, k), (budget, k, dataset)))"


@query(_CELLS + " SELECT * FROM cells")
def factorial_cells(spark, sf_dir):
    return resample.factorial(adapter.paired(spark, sf_dir), "b", "c")


@query(
    _CELLS
    + """, w AS (SELECT dataset, max(accuracy) FILTER (WHERE budget = 'base' AND k = '1') AS b1, max(accuracy) FILTER (WHERE budget = 'base' AND k = 'max') AS bm, max(accuracy) FILTER (WHERE budget = 'extended' AND k = '1') AS e1, max(accuracy) FILTER (WHERE budget = 'extended' AND k = 'max') AS em FROM cells GROUP BY ALL)
    SELECT dataset, round(e1 - b1, 6) AS token_effect_k1, round(em - bm, 6) AS token_effect_kmax, round(bm - b1, 6) AS chain_effect_base, round(em - e1, 6) AS chain_effect_extended, round((em - bm) - (e1 - b1), 6) AS interaction FROM w"""
)
def factorial_effects(spark, sf_dir):
    return resample.factorial_effects(resample.factorial(adapter.paired(spark, sf_dir), "b", "c"))


def _duck_bootstrap(rows: str, key: str, sums: list[str], seed: int, draws: int = resample.DRAWS) -> str:
    """DuckDB: CTEs drawn(draw, n, sums) over a relation of one row per unit; rows with equal sums are one class."""
    u = f"CAST(CAST('0x' || substr(sha256(concat_ws('|', {seed}, draw, {key})), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE"
    given = ", ".join(sums)
    return f"""classes AS (SELECT {given}, count(*) AS size FROM {rows} GROUP BY ALL),
    counts AS (SELECT *, unnest(range(CAST(greatest(0, trunc(size - {resample.SPREAD} * sqrt(size) - {resample.MARGIN})) AS BIGINT), CAST(trunc(size + {resample.SPREAD} * sqrt(size) + {resample.MARGIN}) AS BIGINT) + 1)) AS w FROM classes),
    steps AS (SELECT *, sum(exp(-size + w * ln(size) - lgamma(w + 1))) OVER (PARTITION BY {given} ORDER BY w) AS upto FROM counts),
    bounds AS (SELECT *, lag(upto, 1, -1.0) OVER (PARTITION BY {given} ORDER BY w) AS beyond, lead(w) OVER (PARTITION BY {given} ORDER BY w) IS NULL AS last FROM steps),
    uniform AS (SELECT {given}, draw, {u} AS u FROM classes, range({draws}) r(draw)),
    drawn AS (SELECT draw, sum(w) AS n, {", ".join(f"sum(w * {x}) AS {x}" for x in sums)} FROM uniform JOIN bounds USING ({given}) WHERE u >= beyond AND (u < upto OR last) GROUP BY draw)"""


def _difference_ci(spark, sf_dir, draws):
    v = at.voted(adapter.paired(spark, sf_dir), "b", "c")
    d = v.select((F.col("vote_c.correct").cast("int") - F.col("vote_b.correct").cast("int")).alias("delta"))
    return resample.percentile_interval(resample.hash_bootstrap(d, draws, 42, "delta").withColumn("mean", F.col("delta") / F.col("n")), "mean")


@query(
    adapter.SQL
    + f""", d AS (SELECT CAST(c_ok AS INTEGER) - CAST(b_ok AS INTEGER) AS delta FROM three), {_duck_bootstrap("d", "delta", ["delta"], 42)}
    SELECT count(*) AS draws, {r6("quantile_cont(CAST(delta AS DOUBLE) / n, 0.025)")} AS low, {r6("quantile_cont(CAST(delta AS DOUBLE) / n, 0.975)")} AS high FROM drawn"""
)
def hash_bootstrap_ci(spark, sf_dir):
    return _difference_ci(spark, sf_dir, resample.DRAWS)


_CLUSTER = _SEEDED + f", p AS (SELECT problem_id, seed, CAST(a AS INTEGER) AS e, CAST(a AND b AS INTEGER) AS k FROM kept)"


def _ratio_ci(spark, sf_dir, draws):
    rows = _seeded(spark, sf_dir).groupBy("problem_id").agg(F.sum(F.col("a").cast("int")).alias("e"), F.sum((F.col("a") & F.col("b")).cast("int")).alias("k"))
    out = resample.hash_bootstrap(rows, draws, 7, "e", "k").withColumn("ratio", F.col("k") / F.nullif(F.col("e"), F.lit(0)))
    return resample.percentile_interval(out, "ratio")


@query(
    _CLUSTER
    + f""", c AS (SELECT CAST(sum(e) AS BIGINT) AS e, CAST(sum(k) AS BIGINT) AS k FROM p GROUP BY problem_id), {_duck_bootstrap("c", "e, k", ["e", "k"], 7)}
    SELECT count(CAST(k AS DOUBLE) / nullif(e, 0)) AS draws, {r6("quantile_cont(CAST(k AS DOUBLE) / nullif(e, 0), 0.025)")} AS low, {r6("quantile_cont(CAST(k AS DOUBLE) / nullif(e, 0), 0.975)")} AS high FROM drawn"""
)
def cluster_bootstrap_hash(spark, sf_dir):
    """Problems are resampled with all their seeds; the statistic is a ratio of sums."""
    return _ratio_ci(spark, sf_dir, resample.DRAWS)


_SCOPES = "('all_seeds', -1), ('leave_out:42', 42), ('leave_out:271828', 271828), ('leave_out:314159', 314159)"
_DUCK_WILSON = "({p} + {s} * 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / (2 * d) {s2} 1.959963984540054::DOUBLE * sqrt({p} * (1 - {p}) / d + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / (4.0::DOUBLE * d * d))) / (1 + 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE / d)"


@query(
    _CLUSTER
    + f""", own AS (SELECT scope, problem_id, seed, e, k FROM p, (VALUES {_SCOPES}) v(scope, omitted) WHERE seed <> omitted),
    c AS (SELECT scope, CAST(sum(k) AS DOUBLE) AS num, CAST(sum(e) AS DOUBLE) AS den FROM own GROUP BY scope, problem_id), {_duck_bootstrap("c", "scope, num, den", ["scope", "num", "den"], 42).replace("sum(w * scope) AS scope", "scope").replace("GROUP BY draw)", "GROUP BY draw, scope)")},
    ci AS (SELECT scope, {r6("quantile_cont(num / nullif(den, 0), 0.025)")} AS cluster_ci95_lower, {r6("quantile_cont(num / nullif(den, 0), 0.975)")} AS cluster_ci95_upper FROM drawn GROUP BY scope),
    s AS (SELECT scope, count(DISTINCT seed) AS n_seeds, count(DISTINCT problem_id) AS n_problems, CAST(sum(k) AS DOUBLE) AS numerator_count, CAST(sum(e) AS DOUBLE) AS denominator_count FROM own GROUP BY scope), x AS (SELECT *, denominator_count AS d FROM s)
    SELECT scope, n_seeds, n_problems, numerator_count, denominator_count, {ratio("numerator_count", "denominator_count")} AS estimate, {r6("greatest(0, " + _DUCK_WILSON.format(p="(numerator_count / d)", s="1", s2="-") + ")")} AS binomial_wilson95_lower, {r6("least(1, " + _DUCK_WILSON.format(p="(numerator_count / d)", s="1", s2="+") + ")")} AS binomial_wilson95_upper, cluster_ci95_lower, cluster_ci95_upper FROM x JOIN ci USING (scope)"""
)
def seed_summary(spark, sf_dir):
    """A conditional rate pooled over seeds, and without each of them, with its intervals."""
    rows = _seeded(spark, sf_dir).select("problem_id", "seed", F.col("a").cast("int").alias("e"), (F.col("a") & F.col("b")).cast("int").alias("k"))
    return resample.seed_summary(rows, "k", "e")


@query(_CLUSTER + f" SELECT o.omitted, {n_if('e = 1')} AS n_eligible, CAST(sum(k) AS BIGINT) AS k, {ratio('sum(k)', 'sum(e)')} AS rate FROM p, (SELECT DISTINCT seed AS omitted FROM p) o WHERE seed <> omitted GROUP BY ALL")
def leave_one_seed_out(spark, sf_dir):
    """Each seed's rows go to the estimates that omit another one; no join."""
    rows = _seeded(spark, sf_dir).withColumn("omitted", F.explode(F.array(F.lit(42), F.lit(314159), F.lit(271828)))).filter("omitted <> seed")
    out = rows.groupBy("omitted").agg(F.count_if("a").alias("n_eligible"), F.count_if(F.col("a") & F.col("b")).alias("k"))
    return out.withColumn("rate", at.rate(F.col("k"), F.col("n_eligible")))


@query(
    _bisected(
        _SAMPLING
        + f""", u AS (SELECT dataset, unnest([{{'m': 'helpful_maj', 'h': helpful_maj, 'i': true}}, {{'m': 'harm_maj', 'h': harm_maj, 'i': true}}, {{'m': 'repair_rate_maj', 'h': repaired_maj, 'i': base_complete_wrong}}, {{'m': 'repair_rate_any', 'h': repaired_any, 'i': base_complete_wrong}}]) AS x FROM detail),
        k AS (SELECT {ALL}, x.m AS measure, {n_if("x.i")} AS n, {n_if("x.h AND x.i")} AS k FROM u GROUP BY GROUPING SETS ((x.m), (x.m, dataset)))""",
        "dataset, measure", f"dataset, measure, k, n, printf('[%.3f,%.3f]', {_LOW}, {_HIGH}) AS ci95",
    ).replace("{alpha}", "0.025")
)
def sampling_repair_intervals(spark, sf_dir):
    return resample.sampling_intervals(at.sampling_repair_detail(adapter.paired(spark, sf_dir)))


@query(
    _SAMPLING
    + """, r AS (SELECT unnest(['all', dataset]) AS dataset, CAST(ext_maj_correct AS INTEGER) - CAST(base_maj_correct AS INTEGER) AS v, ext_pass1 - base_pass1 AS p FROM detail), w AS (SELECT dataset, 'maj_acc_delta' AS measure, CAST(v AS DOUBLE) AS d FROM r UNION ALL SELECT dataset, 'pass1_delta', p FROM r WHERE p IS NOT NULL), """
    + _duck_bootstrap("w", "dataset, measure, d", ["dataset", "measure", "d"], 42).replace("sum(w * dataset) AS dataset, sum(w * measure) AS measure", "dataset, measure").replace("GROUP BY draw)", "GROUP BY draw, dataset, measure)")
    + f""", ci AS (SELECT dataset, measure, quantile_cont(d / n, 0.025) AS low, quantile_cont(d / n, 0.975) AS high FROM drawn GROUP BY ALL)
    SELECT dataset, measure, {r6("avg(d)")} AS delta, printf('[%.3f,%.3f]', any_value(low), any_value(high)) AS ci95 FROM w JOIN ci USING (dataset, measure) GROUP BY dataset, measure"""
)
def sampling_repair_bootstrap(spark, sf_dir):
    return resample.sampling_bootstrap(at.sampling_repair_detail(adapter.paired(spark, sf_dir)))


@query()
def bootstrap_numpy(spark, sf_dir):
    v = at.voted(adapter.paired(spark, sf_dir), "b", "c").select("problem_id", "dataset", F.col("vote_b.correct").cast("int").alias("b"), F.col("vote_c.correct").cast("int").alias("c"))
    return resample.bootstrap_numpy(v, "b", "c", "dataset")


# --- routing --------------------------------------------------------------------------------------------------------
_ROUTE = adapter.SQL + ", r AS (SELECT problem_id, dataset, math_level, b_ok AS base_ok, c_ok AS long_ok, b_cut_rate AS score, b_max AS tie, b_some_cut AS any_cut, b_all_cut AS all_cut, b_answered AS answered FROM three)"


def _routes(spark, sf_dir):
    v = at.voted(adapter.paired(spark, sf_dir), "b", "c")
    cut, n = F.size(F.filter("b", lambda c: ~c["complete"])), F.size("b")
    return v.select(
        "problem_id", "dataset", F.col("vote_b.correct").alias("base_ok"), F.col("vote_c.correct").alias("long_ok"), (cut / n).alias("score"), F.array_max(F.transform("b", lambda c: c["token_count"])).alias("tie"),
        (cut > 0).alias("any_cut"), (cut == n).alias("all_cut"), F.forall("b", lambda c: c["answer"].isNotNull()).alias("answered"),
    )


_FR = ", ".join(f"({f}::DOUBLE)" for f in routing.FRACTIONS)
_COSTS = "round(35 + f * 15, 6) AS resume_cost, round(35 + f * 50, 6) AS rerun_cost, round(1 - (35 + f * 15) / 50, 6) AS resume_saving, round(1 - (35 + f * 50) / 50, 6) AS rerun_saving"


@query(
    _ROUTE
    + f""", k AS (SELECT *, row_number() OVER (ORDER BY score DESC, tie DESC, problem_id) AS rank, count(*) OVER () AS n FROM r),
    g AS (SELECT fraction, n, {n_if("rank <= ceil(fraction * n)")} AS routed, {n_if("CASE WHEN rank <= ceil(fraction * n) THEN long_ok ELSE base_ok END")} AS ok, {n_if("base_ok")} AS b, {n_if("long_ok")} AS x FROM k, (VALUES {_FR}) v(fraction) GROUP BY ALL)
    SELECT fraction, n, routed, {r6("CAST(ok AS DOUBLE) / n")} AS accuracy, {r6("(b + CAST(routed AS DOUBLE) / n * (x - b)) / n")} AS random_accuracy, {r6("CAST(ok AS DOUBLE) / n - (b + CAST(routed AS DOUBLE) / n * (x - b)) / n")} AS gain_vs_random FROM g"""
)
def top_fraction_curve(spark, sf_dir):
    return routing.top_fraction_curve(routing.ranked(_routes(spark, sf_dir), "score", "tie"), "base_ok", "long_ok")


@query(
    _ROUTE
    + f""", m AS (SELECT rule, base_ok, long_ok, CASE rule WHEN 'any_cap_hit' THEN any_cut WHEN 'every_cap_hit' THEN all_cut WHEN 'unanswered' THEN NOT answered ELSE any_cut OR NOT answered END AS mask FROM r, (VALUES ('any_cap_hit'), ('every_cap_hit'), ('unanswered'), ('either')) v(rule)),
    s AS (SELECT rule, count(*) AS n, {n_if("mask")} AS routed, {ratio(n_if("CASE WHEN mask THEN long_ok ELSE base_ok END"), "count(*)")} AS accuracy FROM m GROUP BY ALL) SELECT rule, n, routed, accuracy, {_COSTS} FROM (SELECT *, CAST(routed AS DOUBLE) / n AS f FROM s)"""
)
def cap_hit_router(spark, sf_dir):
    f = F.col
    rules = {"any_cap_hit": f("any_cut"), "every_cap_hit": f("all_cut"), "unanswered": ~f("answered"), "either": f("any_cut") | ~f("answered")}
    return routing.rule_router(_routes(spark, sf_dir), rules, "base_ok", "long_ok", 35, 50)


_TH = ", ".join(f"({round(0.05 * i, 2)}::DOUBLE)" for i in range(1, 20))


@query(_ROUTE + f", s AS (SELECT threshold, count(*) AS n, {n_if('score > threshold')} AS routed, {ratio(n_if('CASE WHEN score > threshold THEN long_ok ELSE base_ok END'), 'count(*)')} AS accuracy FROM r, (VALUES {_TH}) v(threshold) GROUP BY ALL) SELECT threshold, n, routed, accuracy, {_COSTS} FROM (SELECT *, CAST(routed AS DOUBLE) / n AS f FROM s)")
def threshold_sweep(spark, sf_dir):
    return routing.threshold_sweep(_routes(spark, sf_dir), "score", "base_ok", "long_ok", 35, 50)


@query(_ROUTE + f" SELECT 'always_base' AS baseline, {ratio(n_if('base_ok'), 'count(*)')} AS accuracy, 0.0::DOUBLE AS routed_fraction FROM r UNION ALL SELECT 'always_extended', {ratio(n_if('long_ok'), 'count(*)')}, 1.0::DOUBLE FROM r UNION ALL SELECT 'oracle', {ratio(n_if('base_ok OR long_ok'), 'count(*)')}, {ratio(n_if('NOT base_ok AND long_ok'), 'count(*)')} FROM r")
def fixed_oracle_baselines(spark, sf_dir):
    return routing.baselines(_routes(spark, sf_dir), "base_ok", "long_ok")


@query(_ROUTE + f", s AS (SELECT dataset, count(*) AS n, {n_if('base_ok')} AS b, {n_if('long_ok')} AS x FROM r GROUP BY ALL) SELECT dataset, fraction, {r6('(b + ceil(fraction * n) / n * (x - b)) / n')} AS expected_accuracy FROM s, (VALUES {_FR}) v(fraction)")
def random_expected(spark, sf_dir):
    """What routing k rows at random comes to, in closed form."""
    s = _routes(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_ok").alias("b"), F.count_if("long_ok").alias("x"))
    s = s.select("*", F.explode(routing.fraction_rows(*routing.FRACTIONS)).alias("fraction"))
    return s.select("dataset", "fraction", F.round((F.col("b") + F.ceil(F.col("fraction") * F.col("n")) / F.col("n") * (F.col("x") - F.col("b"))) / F.col("n"), 6).alias("expected_accuracy"))


# Two hypergeometric counts for each draw: gained rows, then lost ones among the rest, by quantiles of hashed numbers.
_LOG_CHOOSE = "(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1))"


def _cdf(n: str, g: str, k: str) -> str:
    c = lambda a, b: _LOG_CHOOSE.format(a=a, b=b)
    low = f"greatest(0, {k} - ({n} - {g}))"
    pmf = f"list_transform(range({low}, least({g}, {k}) + 1), lambda x: exp({c(g, 'x')} + {c(f'({n} - {g})', f'({k} - x)')} - {c(n, k)}))"
    return f"SELECT {{cols}}, {low} AS low, list_transform(range(1, len(p) + 1), lambda i: list_sum(p[:i])) AS cdf FROM (SELECT *, {pmf} AS p FROM {{of}})"


def _uniform(what: str) -> str:
    return f"CAST(CAST('0x' || substr(sha256('42|' || draw || '|{what}|' || dataset || '|' || k), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE"


@query(
    _ROUTE
    + f""", s AS (SELECT dataset, count(*) AS n, {n_if("base_ok")} AS b, {n_if("NOT base_ok AND long_ok")} AS g, {n_if("base_ok AND NOT long_ok")} AS l FROM r GROUP BY ALL),
    q AS (SELECT dataset, fraction, n, b, g, l, CAST(ceil(fraction * n) AS BIGINT) AS k FROM s, (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) v(fraction)),
    c AS ({_cdf("n", "g", "k").format(cols="dataset, fraction", of="q")}),
    d AS (SELECT q.*, draw, low + len(list_filter(cdf, lambda v: v < u)) AS x FROM (SELECT *, {_uniform("gained")} AS u FROM q, range(500) t(draw)) q JOIN c USING (dataset, fraction)),
    m AS (SELECT DISTINCT dataset, fraction, n - g AS n, l AS g, k - x AS k, x FROM d), e AS ({_cdf("n", "g", "k").format(cols="dataset, fraction, x", of="m")}),
    f AS (SELECT d.*, low + len(list_filter(cdf, lambda v: v < w)) AS y FROM (SELECT *, {_uniform("lost")} AS w FROM d) d JOIN e USING (dataset, fraction, x)),
    a AS (SELECT *, CAST(b + x - y AS DOUBLE) / n AS accuracy FROM f)
    SELECT dataset, fraction, k, CAST(500 AS INTEGER) AS draws, {r6("avg(accuracy)")} AS mean_accuracy, {r6("stddev_pop(accuracy)")} AS sd_accuracy, {r6("quantile_cont(accuracy, 0.025)")} AS low, {r6("quantile_cont(accuracy, 0.975)")} AS high FROM a GROUP BY ALL"""
)
def random_drawn(spark, sf_dir):
    """What routing k rows at random comes to, in 500 draws."""
    return routing.drawn_baseline(_routes(spark, sf_dir), "base_ok", "long_ok", "dataset", (0.1, 0.3, 0.5))


def _cost_row(name: str, r: str, acc: str, rerun: str, resume: str, a: str, b: str) -> str:
    v = {"route_fraction": r, "accuracy": acc, "cap_budget_rerun": rerun, "savings_rerun_pct": f"100 * (1 - ({rerun}) / 50)", "cap_budget_resume": resume, "savings_resume_pct": f"100 * (1 - ({resume}) / 50)", "actual_tokens_rerun": a, "estimated_actual_tokens_resume": b}
    return f"SELECT '{name}' AS strategy, " + ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {k}" for k, x in v.items()) + " FROM t"


def _cost_rule(name: str, p: str) -> str:
    return _cost_row(name, f"{p}_r", f"{p}_acc", f"35 + {p}_r * 50", f"35 + {p}_r * 15", f"{p}_rerun", f"{p}_resume")


def _cost_sums(p: str, mask: str) -> str:
    return f"{n_if(mask)} / CAST(count(*) AS DOUBLE) AS {p}_r, {n_if(f'CASE WHEN {mask} THEN long_ok ELSE base_ok END')} / CAST(count(*) AS DOUBLE) AS {p}_acc, avg(base_tokens + CASE WHEN {mask} THEN long_tokens ELSE 0 END) AS {p}_rerun, avg(base_tokens + CASE WHEN {mask} AND base_cut THEN greatest(long_tokens - base_tokens, 0) ELSE 0 END) AS {p}_resume"


@query(
    _FIRST
    + f", t AS (SELECT CAST(count(*) AS DOUBLE) AS n, {n_if('base_ok')} AS b, {n_if('long_ok')} AS x, avg(base_tokens) AS bt, avg(long_tokens) AS lt, {_cost_sums('h', 'base_cut')}, {_cost_sums('u', '(NOT base_boxed)')} FROM greedy) "
    + " UNION ALL ".join(
        [
            _cost_row("fixed_medium", "0", "b / n", "35.0", "35.0", "bt", "bt"),
            _cost_row("fixed_long_no_medium_pass", "1", "x / n", "50.0", "50.0", "lt", "lt"),
            _cost_rule("rule_hit_max", "h"),
            _cost_rule("rule_no_boxed", "u"),
            *[_cost_row(f"any_router_top{p}pct_cap_only", f"ceil({p / 100}::DOUBLE * n) / n", "NULL", f"35 + ceil({p / 100}::DOUBLE * n) / n * 50", f"35 + ceil({p / 100}::DOUBLE * n) / n * 15", "NULL", "NULL") for p in (20, 30, 40)],
        ]
    )
)
def cost_accounting(spark, sf_dir):
    return routing.cost_accounting(at.first_chain_frame(adapter.paired(spark, sf_dir)), 35, 50)


@query(_ROUTE + f", k AS (SELECT *, row_number() OVER (ORDER BY score DESC, tie DESC, problem_id) AS rank, count(*) OVER () AS n FROM r) SELECT fraction, count(*) AS n_selected, {ratio(n_if('base_ok'), 'count(*)')} AS base_acc, {ratio(n_if('long_ok'), 'count(*)')} AS ext_acc, {n_if('NOT base_ok AND long_ok')} AS helpful, {n_if('base_ok AND NOT long_ok')} AS harmful FROM k, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) v(fraction) WHERE rank <= greatest(1, round_even(fraction * n, 0)) GROUP BY ALL")
def selected_slices(spark, sf_dir):
    return routing.selected_slices(routing.ranked(_routes(spark, sf_dir), "score", "tie"), "base_ok", "long_ok")


@query("WITH e AS (SELECT event_id, value, event_type IN (SELECT min(event_type) FROM events) AS label FROM events), q AS (SELECT quantile_cont(value, 0.8) AS hi, quantile_cont(value, 0.2) AS lo FROM e), k AS (SELECT event_id, value AS score, CASE WHEN value >= hi AND NOT label THEN 'high_score_not_helpful' WHEN value <= lo AND label THEN 'low_score_helpful' END AS kind FROM e, q) SELECT event_id, score, kind, CAST(row_number() OVER (ORDER BY kind, score DESC, event_id) AS INTEGER) AS place FROM k WHERE kind IS NOT NULL QUALIFY place <= 80")
def error_mining(spark, sf_dir):
    e = adapter.table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    first = F.broadcast(e.agg(F.min("event_type").alias("first")))
    return routing.error_mining(e.crossJoin(first).withColumn("label", F.col("event_type") == F.col("first")), "value", "label", "event_id")


@query("WITH e AS (SELECT event_id, value, user_id < 3 AS label FROM events), q AS (SELECT quantile_cont(value, 0.8) AS hi, quantile_cont(value, 0.2) AS lo FROM e), k AS (SELECT event_id, value AS score, CASE WHEN value >= hi AND NOT label THEN 'high_score_not_helpful' WHEN value <= lo AND label THEN 'low_score_helpful' END AS kind FROM e, q) SELECT event_id, score, kind, CAST(row_number() OVER (ORDER BY kind, score DESC, event_id) AS INTEGER) AS place FROM k WHERE kind IS NOT NULL QUALIFY place <= 100000")
def error_mining_all(spark, sf_dir):
    """All mistakes in order, both kinds."""
    e = adapter.table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") < 3).alias("label"))
    return routing.error_mining(e, "value", "label", "event_id", 100_000)


_CURVE = ORACLES["top_fraction_curve"]


@query(f"WITH curve AS ({_CURVE}) SELECT fraction, gain_vs_random, fraction AS cost, round(gain_vs_random / greatest(fraction, 1e-6), 6) AS efficiency FROM curve ORDER BY gain_vs_random / greatest(fraction, 1e-6) DESC, fraction LIMIT 1")
def best_efficiency(spark, sf_dir):
    return routing.best_efficiency(top_fraction_curve(spark, sf_dir).withColumn("cost", F.col("fraction")), "gain_vs_random", "cost", "fraction")


_FEATURES = (
    adapter.SQL
    + """, c AS (SELECT problem_id, dataset, math_level, count(*) AS n, count(*) FILTER (WHERE NOT complete) AS cut, max(token_count) AS mx, min(token_count) AS mn, CAST(sum(token_count) AS DOUBLE) AS s, CAST(sum(token_count * token_count) AS DOUBLE) AS q, count(answer) AS boxed FROM chains WHERE arm = 'B' GROUP BY ALL)"""
)


@query(
    _FEATURES
    + """ SELECT problem_id, cut AS cap_hits, round(CAST(cut AS DOUBLE) / n, 6) AS cap_hit_fraction, CAST(mx AS DOUBLE) AS max_tokens, round(s / n, 6) AS mean_tokens, CAST(mn AS DOUBLE) AS min_tokens, round(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 4) AS std_tokens, round(CAST(boxed AS DOUBLE) / n, 6) AS boxed_fraction,
    length(o_orderpriority) AS question_chars, math_level, CAST(dataset <> 'F' AS INTEGER) AS is_math FROM c JOIN orders ON o_orderkey = problem_id"""
)
def router_features(spark, sf_dir):
    """The priority stands for the question."""
    return routing.router_features(_asked(spark, sf_dir, adapter.arms(spark, sf_dir)), "b", "question")


def _asked(spark, sf_dir, arms):
    return arms.join(adapter.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("problem_id"), F.col("o_orderpriority").alias("question")), "problem_id")


def _evaluated(spark, sf_dir, kinds=("logistic", "forest")):
    v = _asked(spark, sf_dir, at.voted(adapter.paired(spark, sf_dir), "b", "c"))
    rows = routing.router_features(v, "b", "question", keep=(F.col("vote_b.correct").alias("base_ok"), F.col("vote_c.correct").alias("long_ok")))
    return evaluate.evaluate(rows.withColumn("record_id", F.col("problem_id")), adapter.BASE_CAP, adapter.LONG_CAP, kinds=kinds)


@query()
def routing_evaluation(spark, sf_dir):
    """Every method and share routed; the learned routers' scores are of this library's own folds and trees."""
    return _evaluated(spark, sf_dir)[0]


@query(
    adapter.SQL
    + f""", r AS (SELECT t.problem_id, b_ok AS base_ok, c_ok AS long_ok, cut, b_max AS mx FROM three t JOIN (SELECT problem_id, count(*) FILTER (WHERE NOT complete) AS cut FROM chains WHERE arm = 'B' GROUP BY ALL) USING (problem_id)),
    k AS (SELECT *, row_number() OVER (ORDER BY cut DESC, mx DESC, problem_id) AS rank, count(*) OVER () AS n FROM r),
    g AS (SELECT fraction, n, {n_if("rank <= ceil(fraction * n)")} AS routed, {n_if("CASE WHEN rank <= ceil(fraction * n) THEN long_ok ELSE base_ok END")} AS ok, {n_if("base_ok")} AS b, {n_if("long_ok")} AS x FROM k, (VALUES {_FR}) v(fraction) GROUP BY ALL),
    m AS (SELECT 'cap_hit_rank' AS method, fraction AS f, round(CAST(ok AS DOUBLE) / n, 6) AS accuracy, {r6("CAST(ok AS DOUBLE) / n - (b + CAST(routed AS DOUBLE) / n * (x - b)) / n")} AS gain_vs_random FROM g
        UNION ALL SELECT 'random', fraction, {r6("(b + CAST(routed AS DOUBLE) / n * (x - b)) / n")}, 0.0::DOUBLE FROM g UNION ALL SELECT 'fixed_base', 0.0::DOUBLE, {ratio(n_if("base_ok"), "count(*)")}, NULL FROM r UNION ALL SELECT 'fixed_extended', 1.0::DOUBLE, {ratio(n_if("long_ok"), "count(*)")}, NULL FROM r
        UNION ALL SELECT 'route_every_cap_hit', CAST({n_if("cut > 0")} AS DOUBLE) / count(*), {ratio(n_if("CASE WHEN cut > 0 THEN long_ok ELSE base_ok END"), "count(*)")}, NULL FROM r)
    SELECT method, round(f, 6) AS route_fraction, accuracy, gain_vs_random, round(1 - (35 + f * 15) / 50, 6) AS resume_saving, round(1 - (35 + f * 50) / 50, 6) AS rerun_saving FROM m"""
)
def routing_rules(spark, sf_dir):
    """The evaluation without learned routers."""
    return _evaluated(spark, sf_dir, ())[0]


@query(
    _ROUTE
    + f""" SELECT count(*) AS n_records, {ratio(n_if("base_ok"), "count(*)")} AS base_accuracy, {ratio(n_if("long_ok"), "count(*)")} AS extended_accuracy, {ratio(n_if("any_cut"), "count(*)")} AS cap_hit_fraction, {n_if("NOT base_ok AND long_ok")} AS n_routable_flips, {n_if("base_ok AND NOT long_ok")} AS n_routable_reversals,
    {ratio("(" + n_if("long_ok") + " - " + n_if("base_ok") + ")", "count(*)")} AS fixed_long_gain, least({n_if("NOT base_ok AND long_ok")}, {n_if("base_ok OR NOT long_ok")}) >= 5 AS learned_router_fitted FROM r"""
)
def routing_summary(spark, sf_dir):
    return _evaluated(spark, sf_dir, ("logistic",))[1]
