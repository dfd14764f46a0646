"""Stand-ins for generation engines, which are outside this library: deterministic runs by hash, and continuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import request_seed
from ..operators.resample import hash_uniform


def mock_runs(problems: DataFrame, cap: int, n_chains: int, base_seed: int) -> DataFrame:
    """problems with chains: each problem's chains get their own seed, and tokens, length and answer follow from it.

    Tokens that fit the cap are kept; a longer chain ends by length.
    """

    def chain(i: Column) -> Column:
        seed = request_seed(F.lit(base_seed), F.col("problem_id"), i)
        u = hash_uniform(seed, F.lit("length"))
        size = (u * 2 * cap).cast("int") + 1
        ids = F.transform(F.sequence(F.lit(1), F.least(size, F.lit(cap))), lambda j: (hash_uniform(seed, j) * 1000).cast("int"))
        text = F.concat(F.lit("tokens "), F.array_join(ids.cast("array<string>"), " "), F.when(size <= cap, F.concat(F.lit(" \\boxed{"), (hash_uniform(seed, F.lit("answer")) * 3).cast("int").cast("string"), F.lit("}"))).otherwise(""))
        return F.struct(
            text.alias("text"), F.size(ids).alias("token_count"), F.when(size <= cap, "stop").otherwise("length").alias("finish_reason"), F.lit(None).cast("string").alias("stop_reason"),
            i.alias("chain_index"), seed.alias("request_seed"), ids.alias("token_ids"),
        )

    return problems.withColumn("chains", F.transform(F.sequence(F.lit(0), F.lit(n_chains - 1)), chain))


def mock_step_scores(key: Column, n: int) -> Column:
    """n scores in [0.4, 0.9) by hash."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.4 + 0.5 * hash_uniform(key, i))


def continue_truncated(runs: DataFrame, continuations: DataFrame) -> DataFrame:
    """runs whose first chain was cut, with the continuation's text and tokens added; others stay as they are.

    continuations: problem_id, more_text, more_ids, more_finish.
    """
    first = F.col("chains")[0]
    cut = first["finish_reason"] == "length"
    both = runs.join(continuations, "problem_id", "left")
    ids = F.concat(first["token_ids"], F.coalesce("more_ids", F.array().cast("array<int>")))
    longer = first.withField("text", F.concat(first["text"], F.coalesce("more_text", F.lit("")))).withField("token_ids", ids).withField("token_count", F.size(ids)).withField("finish_reason", F.coalesce("more_finish", first["finish_reason"]))
    both = both.withColumn("resume", F.struct(cut.alias("continued"), first["token_count"].alias("medium_tokens"), F.when(cut, F.size(F.coalesce("more_ids", F.array().cast("array<int>")))).otherwise(0).alias("continuation_tokens")))
    return both.withColumn("chains", F.when(cut, F.array(longer)).otherwise(F.col("chains"))).drop("more_text", "more_ids", "more_finish")


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int, *strata: str) -> DataFrame:
    """n rows (of each stratum) by order of a hash of seed and key: the same wherever it runs."""
    from pyspark.sql import Window

    order = Window.partitionBy(*strata).orderBy(hash_uniform(F.lit(seed), F.col(key)), key)
    if not strata:
        return rows.orderBy(hash_uniform(F.lit(seed), F.col(key)), key).limit(n)
    return rows.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= n).drop("__place")


def integer_answers(problems: DataFrame, per_source: int) -> DataFrame:
    r"""Problems whose answers are whole numbers of 0..999, as \boxed{n}; fails unless each source has per_source of them."""
    bare = F.regexp_extract("answer", r"^(?:\\boxed\{\s*)?([0-9]{1,3})(?:\s*\})?$", 1)
    kept = problems.withColumn("__n", bare).filter(F.col("__n") != "").withColumn("answer", F.concat(F.lit("\\boxed{"), F.col("__n").cast("int").cast("string"), F.lit("}"))).drop("__n")
    if bad := kept.groupBy("source").count().filter(F.col("count") != per_source).limit(5).collect():
        raise ValueError(f"sources with another number of answers: {[tuple(r) for r in bad]}")
    return kept
