"""Queries over run records in JSONL: made from the driver's tables with known faults, written, read back and judged.

An order with two line items and more of both statuses is a problem; its first two of status F are the chains of arm A
(cap 35), those of status O of arm C (cap 50), and arm B is C cut at 35 tokens. Faults go by the order's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import request_seed
from ..operators import integrity, plugins
from ..sources import aligned, blocks, ledger, records
from ..sources.tables import materialise, new_folder
from . import adapter, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BASE_CAP, LONG_CAP, CHAINS = 35, 50, 2
SEEDS = {"a": 11, "c": 12}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


_SQL = """WITH l AS (SELECT l_orderkey AS k, l_linestatus AS s, CAST(l_quantity AS INTEGER) AS tokens, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag) - 1 AS INTEGER) AS i FROM lineitem),
    e AS (SELECT k, any_value(o_orderstatus) AS dataset FROM l JOIN orders ON o_orderkey = k GROUP BY k HAVING count(*) FILTER (WHERE s = 'F') >= 2 AND count(*) FILTER (WHERE s = 'O') >= 2),
    c AS (SELECT k, dataset, s, i, tokens FROM l JOIN e USING (k) WHERE i < 2)"""


def ids_of(part: Column, tokens: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), tokens), lambda i: ((part * 31 + i) % 1000).cast("int"))


def spelled(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems, in a table: __k, dataset and what the chains of a and c are made from.

    The line items are shuffled once, however many runs a query makes; of each order four pairs of numbers stay.
    Line items that agree as far as the pair goes in their order give the same pair: the rest of the order is left out.
    """
    order = adapter.ORDER[: adapter.ORDER.index("l_quantity") + 1]
    # Rows are dealt as they are: lists of a few of them would be sorted and spilled before the shuffle, and be no smaller.
    rows = adapter.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("__k"), *order, "l_linestatus").repartition("__k")
    lines = rows.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct(*order, "l_linestatus"))).alias("lines"))
    of = lambda s: F.filter("lines", lambda x: x["l_linestatus"] == s)
    first = lambda s: F.transform(F.slice(of(s), 1, CHAINS), lambda x: F.struct(x["l_quantity"].alias("l_quantity"), x["l_partkey"].alias("l_partkey")))
    own = lines.select("__k", first("F").alias("a"), first("O").alias("c")).filter((F.size("a") == CHAINS) & (F.size("c") == CHAINS))
    orders = adapter.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("__k"), F.col("o_orderstatus").alias("dataset"))
    return materialise(own.join(orders, "__k"), "eligible")


def run(problems: DataFrame, arm: str, cap: int) -> DataFrame:
    """A run without faults of eligible problems, with the order's key as __k."""
    seed = SEEDS[arm]
    problem = F.concat(F.lit("o"), F.col("__k").cast("string"))

    def chain(x: Column, i: Column) -> Column:
        tokens = F.least(x["l_quantity"].cast("int"), F.lit(cap))
        ids = ids_of(x["l_partkey"], tokens)
        return F.struct(spelled(ids).alias("text"), tokens.alias("token_count"), F.when(x["l_quantity"] > cap, "length").otherwise("stop").alias("finish_reason"), i.alias("chain_index"), request_seed(F.lit(seed), problem, i).alias("request_seed"), ids.alias("token_ids"))

    policy = F.struct(F.lit(None).cast("long").alias("engine_seed"), F.lit(None).cast("decimal(20,0)").alias("request_seed"), F.lit(seed).cast("long").alias("base_seed"), F.lit("per_problem_per_chain_sha256").alias("mode"))
    signature = F.struct(F.lit("m").alias("model"), F.lit("s").alias("model_snapshot_sha256"), F.create_map(F.lit("python"), F.lit("3")).alias("runtime_versions"), F.lit("t").alias("prompt_template"), F.lit("p").alias("prompt_sha256"), F.lit(True).alias("store_token_ids"))
    budget = F.struct(F.lit(cap).alias("max_new_tokens"), F.lit(CHAINS).alias("n_chains"), F.lit(0.5).alias("temperature"), F.lit(0.9).alias("top_p"), F.lit(seed).cast("long").alias("seed"), F.lit(None).cast("string").alias("mode"), policy.alias("seed_policy"), signature.alias("run_signature"))
    made = problems.select("__k", problem.alias("problem_id"), "dataset", F.concat(F.lit("q"), F.col("__k").cast("string")).alias("question"), F.lit("#### 1").alias("answer"), F.transform(arm, chain).alias("chains"), budget.alias("budget"))
    wide = F.from_json(F.to_json("budget"), records.BUDGET)
    return made.withColumn("budget", wide).withColumn("chains", F.from_json(F.to_json("chains"), records.RUN["chains"].dataType))


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as JSONL in the shared folder, compressed, read back strictly."""
    path = new_folder(rows.sparkSession, name)
    rows.drop("__k").write.json(path, compression="gzip")
    return records.read_jsonl(rows.sparkSession, path)


def cut(c: DataFrame) -> DataFrame:
    return runs.reconstruct(c, BASE_CAP, spelled)


@query(_SQL + """SELECT 'o' || k AS problem_id, unnest(CASE k % 13 WHEN 1 THEN ['independent_seed', 'disjoint_seeds'] WHEN 2 THEN ['exact_prefix'] WHEN 3 THEN ['question'] WHEN 4 THEN ['decoding'] WHEN 5 THEN ['declared_prefix']
        WHEN 6 THEN ['ids', 'dataset', 'question', 'answer', 'caps', 'chain_counts', 'decoding', 'declared_prefix', 'seed_policy', 'exact_prefix', 'token_counts', 'chain_identity'] WHEN 7 THEN ['token_counts'] WHEN 8 THEN ['chain_identity'] WHEN 9 THEN ['caps', 'chain_counts'] END) AS rule FROM e WHERE k % 13 BETWEEN 1 AND 9""")  # fmt: skip
def protocol_records(spark, sf_dir):
    """The whole protocol between three arms: independent A, B the exact prefix of C, with a fault of each kind."""
    problems = eligible(spark, sf_dir)
    k, c, a = F.col("__k") % 13, run(problems, "c", LONG_CAP), run(problems, "a", BASE_CAP)
    same = F.transform("chains", lambda x, i: x.withField("request_seed", request_seed(F.lit(SEEDS["c"]), F.col("problem_id"), i)))
    a = a.withColumn("chains", F.when(k == 1, same).otherwise(F.col("chains")))
    a = a.withColumn("budget", F.when(k == 1, F.col("budget").withField("seed_policy.base_seed", F.lit(SEEDS["c"]).cast("long"))).when(k == 9, F.col("budget").withField("max_new_tokens", F.lit(BASE_CAP - 1))).otherwise(F.col("budget")))
    a = a.withColumn("chains", F.when(k == 9, F.slice("chains", 1, 1)).otherwise(F.col("chains")))
    b = cut(c).filter(k != 6).withColumn("question", F.when(k == 3, F.lit("other")).otherwise(F.col("question")))
    b = b.withColumn("budget", F.when(k == 4, F.col("budget").withField("temperature", F.lit(0.7))).when(k == 5, F.col("budget").withField("mode", F.lit(None).cast("string"))).otherwise(F.col("budget")))
    other = F.transform("chains", lambda x: x.withField("token_ids", F.transform(x["token_ids"], lambda t, i: F.when(i == 0, t + 1).otherwise(t))))
    b = b.withColumn("chains", F.when(k == 2, other).when(k == 7, F.transform("chains", lambda x: x.withField("token_count", x["token_count"] + 1))).when(k == 8, F.transform("chains", lambda x: x.withField("chain_index", x["chain_index"] + 1))).otherwise(F.col("chains")))
    return integrity.protocol_violations(written(a, "arm-a"), written(b, "arm-b"), written(c, "arm-c"), BASE_CAP, LONG_CAP)


@query(_SQL + """, f AS (SELECT 'a' AS file, 'o' || k AS key, unnest(CASE k % 7 WHEN 1 THEN ['chain_count'] WHEN 2 THEN ['chains', 'chain_indexes'] WHEN 3 THEN ['signature_fields'] WHEN 4 THEN ['chains', 'unique_seeds'] WHEN 5 THEN ['duplicate_id'] END) AS rule FROM e WHERE k % 7 BETWEEN 1 AND 5)
    SELECT * FROM f UNION ALL SELECT '*', 'o' || k, 'metadata_differs' FROM e WHERE k % 7 = 6 UNION ALL SELECT 'a', '2', 'budget_differs' WHERE EXISTS (SELECT 1 FROM e WHERE k % 7 = 3)
    UNION ALL SELECT 'a', CAST(count(*) + count(*) FILTER (WHERE k % 7 = 5) AS VARCHAR), 'row_count' FROM e HAVING count(*) FILTER (WHERE k % 7 = 5) > 0""")  # fmt: skip
def file_validation(spark, sf_dir):
    """Files of a rerun: records, ids, budgets, numbers of rows, and what files tell of one problem."""
    problems = eligible(spark, sf_dir)
    k, a, c = F.col("__k") % 7, run(problems, "a", BASE_CAP), run(problems, "c", LONG_CAP)
    turned = F.transform("chains", lambda x, i: x.withField("chain_index", 1 - i))
    alike = F.transform("chains", lambda x: x.withField("request_seed", F.col("chains")[0]["request_seed"]))
    a = a.withColumn("chains", F.when(k == 1, F.slice("chains", 1, 1)).when(k == 2, turned).when(k == 4, alike).otherwise(F.col("chains")))
    a = a.withColumn("budget", F.when(k == 3, F.col("budget").withField("run_signature.prompt_sha256", F.lit(None).cast("string"))).otherwise(F.col("budget")))
    a = a.unionByName(a.filter(k == 5))
    c = c.withColumn("answer", F.when(k == 6, F.lit("#### 2")).otherwise(F.col("answer")))
    read = {"a": written(a, "file-a"), "c": written(c, "file-c")}
    return integrity.validate_files(read, read["c"].count())


@query(_SQL + """, m AS (SELECT k, CASE k % 9 WHEN 1 THEN 'malformed' WHEN 2 THEN 'chain_count' WHEN 3 THEN 'budget' WHEN 4 THEN 'seed_policy' WHEN 5 THEN 'problem' WHEN 6 THEN 'chains' ELSE 'valid' END AS outcome FROM e), w AS (SELECT outcome FROM m UNION ALL SELECT 'valid' FROM m WHERE k % 9 = 7)
    SELECT outcome, count(*) AS n, any_value((SELECT count(*) FROM m WHERE outcome = 'valid')) AS n_kept FROM w GROUP BY outcome""")  # fmt: skip
def resume_records(spark, sf_dir):
    """What a resumed run may keep of its file's lines: broken, foreign, faulty and repeated ones told apart."""
    c = run(eligible(spark, sf_dir), "c", LONG_CAP)
    k, chains = F.col("__k") % 9, F.col("chains")
    faulty = F.transform(chains, lambda x: x.withField("request_seed", x["request_seed"] - 1))
    rows = c.withColumn("chains", F.when(k == 2, F.slice("chains", 1, 1)).when(k == 6, faulty).otherwise(chains))
    rows = rows.withColumn("budget", F.when(k == 3, F.col("budget").withField("top_p", F.lit(0.8))).when(k == 4, F.col("budget").withField("seed_policy.base_seed", F.lit(99).cast("long"))).otherwise(F.col("budget")))
    rows = rows.withColumn("question", F.when(k == 5, F.lit("other")).otherwise(F.col("question")))
    text = F.to_json(F.struct(*[x for x in rows.columns if x != "__k"]))
    lines = rows.select(F.explode(F.when(k == 7, F.array(text, text)).when(k == 1, F.array(F.substring(text, 1, 40))).otherwise(F.array(text))).alias("value"))
    path = new_folder(spark, "resume")
    lines.write.text(path, compression="gzip")
    problems = c.select("problem_id", F.col("__k").alias("position"), "dataset", "question", "answer", F.lit(None).cast("int").alias("math_level"))
    budget = {"max_new_tokens": LONG_CAP, "n_chains": CHAINS, "temperature": 0.5, "top_p": 0.9, "seed": SEEDS["c"]}
    policy = {"engine_seed": None, "request_seed": None, "base_seed": SEEDS["c"], "mode": "per_problem_per_chain_sha256"}
    kept, counts = integrity.resume(records.numbered_lines(spark, path, records.RUN), problems, budget, policy, {"model": "m", "store_token_ids": True})
    return counts.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("n_kept"))))  # one row


@query(_SQL + """SELECT dataset, count(*) AS n_chains, count(*) FILTER (WHERE tokens > 35) AS n_cut, CAST(sum(least(tokens, 35)) AS BIGINT) AS tokens, count(*) FILTER (WHERE tokens >= 35) AS n_at_cap, CAST(count(*) FILTER (WHERE tokens <= 35) AS BIGINT) AS n_same_text FROM c WHERE s = 'O' GROUP BY dataset""")
def prefix_runs(spark, sf_dir):
    """The extended run as it would have been at the base cap, from token ids that are stored, written and read back."""
    c = written(run(eligible(spark, sf_dir), "c", LONG_CAP), "long")
    b = written(cut(c), "prefix")
    both = b.select("problem_id", "dataset", F.posexplode("chains").alias("i", "p")).join(c.select("problem_id", F.posexplode("chains").alias("i", "q")), ["problem_id", "i"])
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    p, q = F.col("p"), F.col("q")
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_chains"), count(F.startswith(q["text"], p["text"]) & (q["token_count"] > p["token_count"])).alias("n_cut"), F.sum(p["token_count"]).alias("tokens"), count(p["token_count"] == BASE_CAP).alias("n_at_cap"), count(p["text"] == q["text"]).alias("n_same_text"))


@query(_SQL + """, p AS (SELECT k, dataset, i, max(tokens) FILTER (WHERE s = 'F') AS x, max(tokens) FILTER (WHERE s = 'O') AS z FROM c GROUP BY ALL)
    SELECT dataset, count(DISTINCT k) AS n_records, CAST(sum(least(x, 35)) AS BIGINT) AS tokens_a, CAST(sum(least(z, 35)) AS BIGINT) AS tokens_b, CAST(sum(z) AS BIGINT) AS tokens_c, count(*) AS n_prefixes FROM p GROUP BY dataset""")  # fmt: skip
def aligned_scan(spark, sf_dir):
    """Three single files in canonical order, in compressed blocks, read side by side without a shuffle."""
    # The small rows that runs are made from are sorted, not the records.
    problems = eligible(spark, sf_dir).orderBy(F.concat(F.lit("o"), F.col("__k").cast("string")))
    c = run(problems, "c", LONG_CAP)
    folder = new_folder(spark, "aligned")
    paths = {k: f"{folder}/{k}.jsonl{blocks.SUFFIX}" for k in "abc"}
    for k, rows in (("a", run(problems, "a", BASE_CAP)), ("b", cut(c)), ("c", c)):
        ledger.write_one(rows.drop("__k"), paths[k])
    rows = aligned.read_aligned(spark, records.RUN, ordered=True, **paths)
    tokens = lambda x: F.aggregate(x["chains"], F.lit(0), lambda s, y: s + y["token_count"])
    prefix = F.size(F.filter(F.zip_with("b.chains", "c.chains", lambda p, q: F.slice(q["token_ids"], 1, BASE_CAP) == p["token_ids"]), lambda x: x))
    return rows.groupBy("a.dataset").agg(F.count(F.lit(1)).alias("n_records"), *[F.sum(tokens(F.col(k))).alias(f"tokens_{k}") for k in "abc"], F.sum(prefix).alias("n_prefixes"))


@query(adapter.SQL + """, s AS (SELECT problem_id, answer, sum(token_count) AS t, bool_or(correct) AS ok FROM chains WHERE arm = 'C' AND answer IS NOT NULL GROUP BY ALL), w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY t DESC, answer) = 1)
    SELECT problem_id, w.answer AS winner, coalesce(w.ok, false) AS correct, CAST(n AS INTEGER) AS n FROM (SELECT problem_id, count(*) AS n FROM chains WHERE arm = 'C' GROUP BY problem_id) LEFT JOIN w USING (problem_id)""")
def vote_table_function(spark, sf_dir):
    """A vote rule that a user brings, called from SQL as a table function over partitions."""
    plugins.register_rules(spark)
    adapter.chain_rows(adapter.arms(spark, sf_dir), "c").select("problem_id", "chain_index", "answer", "correct", "token_count").createOrReplaceTempView("tokenlab_chains")
    return spark.sql("SELECT * FROM vote_by(TABLE(SELECT * FROM tokenlab_chains) PARTITION BY problem_id ORDER BY (chain_index), 'most_tokens')")
