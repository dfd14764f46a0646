"""Run records over the driver's tables, which hold none: orders are problems and their line items chains.

Line status F is the independent arm A (cap 35), O the extended arm C (cap 50); arm B is C cut at cap 35. A chain's
answer is its return flag, if it has a discount and is complete; the gold answer comes from the customer's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_CAP, LONG_CAP = 35, 50
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chains(lines: Column, status: str, cap: int) -> Column:
    own = F.filter(lines, lambda x: x["l_linestatus"] == status)

    def chain(x: Column, i: Column) -> Column:
        tokens = x["l_quantity"].cast("int")
        complete = tokens <= cap
        answer = F.when(complete & (x["l_discount"] > 0), x["l_returnflag"])
        return F.struct(
            i.alias("chain_index"),
            F.least(tokens, F.lit(cap)).alias("token_count"),
            F.when(complete, "stop").otherwise("length").alias("finish_reason"),
            complete.alias("complete"),
            answer.alias("answer"),
            F.coalesce(answer == F.col("gold"), F.lit(False)).alias("correct"),
            F.when(complete, x["l_returnflag"]).alias("fallback"),
        )

    return F.transform(own, chain)


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per problem: problem_id, dataset, math_level, gold, and its chains in a, b and c (empty if none).

    One shuffle of the line items and one of the orders, both by order key.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("problem_id")).agg(F.array_sort(F.collect_list(F.struct(*ORDER, "l_linestatus"))).alias("lines"))
    problems = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("problem_id"),
        F.col("o_orderstatus").alias("dataset"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("math_level"),
        F.when(F.col("o_custkey") % 3 == 0, "A").when(F.col("o_custkey") % 3 == 1, "N").otherwise("R").alias("gold"),
    )
    both = problems.join(lines, "problem_id", "left")
    out = both.select("problem_id", "dataset", "math_level", "gold", _chains(F.col("lines"), "F", BASE_CAP).alias("a"), _chains(F.col("lines"), "O", BASE_CAP).alias("b"), _chains(F.col("lines"), "O", LONG_CAP).alias("c"))
    none = F.array().cast(out.schema["a"].dataType)
    return out.select("problem_id", "dataset", "math_level", "gold", *[F.coalesce(x, none).alias(x) for x in ("a", "b", "c")])


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that have both an independent and an extended run."""
    return arms(spark, sf_dir).filter((F.size("a") > 0) & (F.size("c") > 0))


def chain_rows(frame: DataFrame, arm: str) -> DataFrame:
    return frame.select("problem_id", "dataset", "math_level", "gold", F.lit(arm.upper()).alias("arm"), F.explode(arm).alias("chain")).select("problem_id", "dataset", "math_level", "gold", "arm", "chain.*")


#: The same in DuckDB: chains and votes by problem and arm, for the oracles.
SQL = """
WITH problems AS (
    SELECT o_orderkey AS problem_id, o_orderstatus AS dataset, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS math_level,
        CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS gold FROM orders
), lines AS (
    SELECT l_orderkey AS problem_id, l_linestatus AS status, CAST(l_quantity AS INTEGER) AS tokens, CASE WHEN l_discount > 0 THEN l_returnflag END AS flag, l_returnflag AS raw,
        CAST(row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag) - 1 AS INTEGER) AS chain_index
    FROM lineitem
), caps AS (
    SELECT * FROM (VALUES ('A', 'F', 35), ('B', 'O', 35), ('C', 'O', 50)) v(arm, status, cap)
), chains AS (
    SELECT p.problem_id, dataset, math_level, gold, arm, chain_index, least(tokens, cap) AS token_count, tokens <= cap AS complete,
        CASE WHEN tokens <= cap THEN flag END AS answer, coalesce(CASE WHEN tokens <= cap THEN flag END = gold, false) AS correct, CASE WHEN tokens <= cap THEN raw END AS fallback
    FROM lines JOIN caps USING (status) JOIN problems p USING (problem_id)
), tally AS (
    SELECT problem_id, arm, answer, count(*) AS n, bool_or(correct) AS ok FROM chains WHERE answer IS NOT NULL GROUP BY ALL
), best AS (
    SELECT *, max(n) OVER (PARTITION BY problem_id, arm) AS most FROM tally
), won AS (
    SELECT problem_id, arm, min(answer) AS winner, arg_min(ok, answer) AS ok, count(*) > 1 AS tie, bool_and(ok) AS low, bool_or(ok) AS high FROM best WHERE n = most GROUP BY ALL
), sums AS (
    SELECT problem_id, arm, count(*) AS n, bool_or(correct) AS any_ok, avg(CAST(correct AS INTEGER)) AS pass1, bool_and(complete) AS all_complete,
        bool_and(answer IS NOT NULL) AS all_answered, bool_and(correct) AS all_ok, bool_and(NOT complete) AS all_cut, bool_or(NOT complete) AS some_cut,
        avg(CAST(NOT complete AS INTEGER)) AS cut_rate, sum(token_count) AS tokens, max(token_count) AS max_tokens, min(token_count) AS min_tokens,
        arg_min(complete AND answer IS NOT NULL AND NOT correct, chain_index) AS first_wrong
    FROM chains GROUP BY ALL
), votes AS (
    SELECT p.*, coalesce(s.n, 0) AS n_chains, w.winner, coalesce(w.ok, false) AS ok, coalesce(w.tie, false) AS tie, coalesce(w.low, false) AS low, coalesce(w.high, false) AS high,
        coalesce(any_ok, false) AS any_ok, pass1, coalesce(all_complete, false) AS all_complete, coalesce(all_answered, false) AS all_answered, coalesce(all_ok, false) AS all_ok,
        coalesce(all_cut, false) AS all_cut, coalesce(some_cut, false) AS some_cut, cut_rate, tokens, max_tokens, min_tokens,
        coalesce(all_complete AND all_answered AND NOT any_ok, false) AS strict_all_wrong,
        coalesce(all_complete AND all_answered AND NOT coalesce(w.ok, false), false) AS plurality_wrong, coalesce(first_wrong, false) AS first_chain_wrong
    FROM (SELECT *, unnest(['A', 'B', 'C']) AS arm FROM problems) p LEFT JOIN sums s ON s.problem_id = p.problem_id AND s.arm = p.arm
        LEFT JOIN won w ON w.problem_id = p.problem_id AND w.arm = p.arm
), three AS (
    SELECT problem_id, dataset, math_level,
        bool_or(strict_all_wrong) FILTER (WHERE arm = 'A') AS strict_all_wrong, bool_or(plurality_wrong) FILTER (WHERE arm = 'A') AS plurality_wrong, bool_or(first_chain_wrong) FILTER (WHERE arm = 'A') AS first_chain_wrong,
        bool_or(any_ok) FILTER (WHERE arm = 'A') AS a_any, bool_or(ok) FILTER (WHERE arm = 'A') AS a_ok, bool_or(low) FILTER (WHERE arm = 'A') AS a_low,
        bool_or(high) FILTER (WHERE arm = 'A') AS a_high, bool_or(tie) FILTER (WHERE arm = 'A') AS a_tie, max(pass1) FILTER (WHERE arm = 'A') AS a_pass1,
        bool_or(any_ok) FILTER (WHERE arm = 'B') AS b_any, bool_or(ok) FILTER (WHERE arm = 'B') AS b_ok, bool_or(low) FILTER (WHERE arm = 'B') AS b_low,
        bool_or(high) FILTER (WHERE arm = 'B') AS b_high, bool_or(tie) FILTER (WHERE arm = 'B') AS b_tie, max(pass1) FILTER (WHERE arm = 'B') AS b_pass1,
        bool_or(any_ok) FILTER (WHERE arm = 'C') AS c_any, bool_or(ok) FILTER (WHERE arm = 'C') AS c_ok, bool_or(low) FILTER (WHERE arm = 'C') AS c_low,
        bool_or(high) FILTER (WHERE arm = 'C') AS c_high, bool_or(tie) FILTER (WHERE arm = 'C') AS c_tie, max(pass1) FILTER (WHERE arm = 'C') AS c_pass1,
        bool_or(all_complete AND ok) FILTER (WHERE arm = 'A') AS complete_plurality_correct, bool_or(all_complete AND all_ok) FILTER (WHERE arm = 'A') AS complete_all_correct, bool_or(all_complete) FILTER (WHERE arm = 'B') AS b_complete,
        bool_or(all_cut) FILTER (WHERE arm = 'B') AS b_all_cut, bool_or(some_cut) FILTER (WHERE arm = 'B') AS b_some_cut, bool_or(some_cut) FILTER (WHERE arm = 'A') AS a_some_cut,
        bool_or(all_cut) FILTER (WHERE arm = 'A') AS a_all_cut, bool_or(all_answered) FILTER (WHERE arm = 'A') AS a_answered, bool_or(all_answered) FILTER (WHERE arm = 'B') AS b_answered,
        max(cut_rate) FILTER (WHERE arm = 'B') AS b_cut_rate, max(tokens) FILTER (WHERE arm = 'B') AS b_tokens, max(tokens) FILTER (WHERE arm = 'C') AS c_tokens,
        max(max_tokens) FILTER (WHERE arm = 'B') AS b_max, max(min_tokens) FILTER (WHERE arm = 'B') AS b_min, max(n_chains) FILTER (WHERE arm = 'B') AS n_chains,
        max(n_chains) FILTER (WHERE arm = 'A') AS a_chains, bool_or(strict_all_wrong) FILTER (WHERE arm = 'B') AS b_strict, bool_or(plurality_wrong) FILTER (WHERE arm = 'B') AS b_plurality,
        bool_or(first_chain_wrong) FILTER (WHERE arm = 'B') AS b_first
    FROM votes GROUP BY problem_id, dataset, math_level HAVING max(n_chains) FILTER (WHERE arm = 'A') > 0 AND max(n_chains) FILTER (WHERE arm = 'C') > 0
)
"""
