"""Plurality votes over chains: array-local (default) and relational, with tie bounds.

A chain is a struct with at least answer (null if it can't be read), correct and complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import g3_answer
from ..functions.answers import once as let


def plurality(chains: Column | str, drop_empty: bool = False) -> Column:
    """Struct winner, correct, tie, lower, upper of an array of chains, without a shuffle.

    Null answers don't vote (nor empty ones with drop_empty). The winner is the smallest of the most frequent
    answers; it is correct if one of its chains is. lower: all winners are correct; upper: one is. Without a valid
    answer all are false and the winner is null.
    """
    chains = F.col(chains) if isinstance(chains, str) else chains
    valid = F.filter(chains, lambda c: c["answer"].isNotNull() & ((c["answer"] != "") if drop_empty else F.lit(True)))

    def tally(v: Column) -> Column:
        answers = F.array_distinct(F.transform(v, lambda c: c["answer"]))
        return F.transform(answers, lambda a: F.struct((-F.size(F.filter(v, lambda c: c["answer"] == a))).alias("n"), a.alias("a"), F.exists(v, lambda c: (c["answer"] == a) & c["correct"]).alias("ok")))

    def result(best: Column) -> Column:
        first = F.array_min(best)
        return F.struct(
            first["a"].alias("winner"),
            F.coalesce(first["ok"], F.lit(False)).alias("correct"),
            (F.size(best) > 1).alias("tie"),
            ((F.size(best) > 0) & F.forall(best, lambda w: F.coalesce(w["ok"], F.lit(False)))).alias("lower"),
            F.coalesce(F.exists(best, lambda w: w["ok"]), F.lit(False)).alias("upper"),
        )

    # Every intermediate result is bound once; Spark would work it out again wherever it is named.
    none = F.array().cast("array<struct<n:int,a:string,ok:boolean>>")
    counts = F.coalesce(let(valid, tally), none)
    return let(counts, lambda cs: let(F.array_min(cs)["n"], lambda most: let(F.filter(cs, lambda w: w["n"] == most), result)))


def plurality_by_rows(chains: DataFrame, keys: list[str], drop_empty: bool = False) -> DataFrame:
    """The same vote over one row per chain, for groups of any size: two aggregations and one exchange of keys.

    Groups with no valid answer come out with all false.
    """
    valid = F.col("answer").isNotNull() & ((F.col("answer") != "") if drop_empty else F.lit(True))
    tally = chains.groupBy(*keys, F.when(valid, F.col("answer")).alias("answer")).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("correct", F.lit(False))).alias("ok"))
    tally = tally.withColumn("n", F.when(F.col("answer").isNotNull(), F.col("n")).otherwise(0))
    top = tally.withColumn("most", F.max("n").over(Window.partitionBy(*keys)))
    top = top.withColumn("wins", (F.col("n") == F.col("most")) & F.col("answer").isNotNull())
    first = F.min(F.when(F.col("wins"), F.struct(F.col("answer").alias("a"), F.col("ok").alias("ok"))))
    won = F.col("wins")
    return top.groupBy(*keys).agg(
        first["a"].alias("winner"),
        F.coalesce(first["ok"], F.lit(False)).alias("correct"),
        (F.count_if(won) > 1).alias("tie"),
        F.coalesce(F.bool_and(F.when(won, F.col("ok"))), F.lit(False)).alias("lower"),
        F.coalesce(F.bool_or(F.when(won, F.col("ok"))), F.lit(False)).alias("upper"),
    )


def any_correct(chains: Column) -> Column:
    return F.coalesce(F.exists(chains, lambda c: c["correct"]), F.lit(False))


def pass_at_1(chains: Column) -> Column:
    """Mean correctness; null without chains."""
    n = F.size(chains)
    return F.when(n > 0, F.size(F.filter(chains, lambda c: c["correct"])).cast("double") / n)


def eligibility(chains: Column, correct: Column | None = None) -> Column:
    """Struct of the three definitions of a failed base run: strict_all_wrong, plurality_wrong, first_chain_wrong.

    strict: all chains complete and readable, none correct. plurality: all complete and readable, and the vote is
    wrong. first: the first chain alone is complete, readable and wrong. None holds without chains. correct: the vote's
    verdict, where it is known already.
    """
    correct = plurality(chains)["correct"] if correct is None else correct
    some = F.size(chains) > 0
    complete = F.forall(chains, lambda c: c["complete"])
    answered = F.forall(chains, lambda c: c["answer"].isNotNull())
    first = F.try_element_at(chains, F.lit(1))
    return F.struct(
        F.coalesce(some & complete & answered & ~any_correct(chains), F.lit(False)).alias("strict_all_wrong"),
        F.coalesce(some & complete & answered & ~correct, F.lit(False)).alias("plurality_wrong"),
        F.coalesce(first["complete"] & first["answer"].isNotNull() & ~first["correct"], F.lit(False)).alias("first_chain_wrong"),
    )


def complete_correct(chains: Column, correct: Column | None = None) -> Column:
    """Struct complete_plurality_correct, complete_all_correct: all chains complete, and the vote or all are right.

    correct: the vote's verdict, where it is known already.
    """
    correct = plurality(chains)["correct"] if correct is None else correct
    whole = (F.size(chains) > 0) & F.forall(chains, lambda c: c["complete"])
    return F.struct(
        F.coalesce(whole & correct, F.lit(False)).alias("complete_plurality_correct"),
        F.coalesce(whole & F.forall(chains, lambda c: c["correct"]), F.lit(False)).alias("complete_all_correct"),
    )


def completion_state(chains: Column) -> Column:
    """all_truncated, mixed_truncated_complete, all_complete_answered_wrong or complete_other."""
    cut = F.size(F.filter(chains, lambda c: ~c["complete"]))
    wrong = (F.size(chains) > 0) & F.forall(chains, lambda c: c["answer"].isNotNull()) & ~any_correct(chains)
    return F.when((cut > 0) & (cut == F.size(chains)), "all_truncated").when(cut > 0, "mixed_truncated_complete").when(wrong, "all_complete_answered_wrong").otherwise("complete_other")


def agreement(chains: Column) -> Column:
    """G3 features: share of the commonest answer among readable ones, distinct answers, share readable, confidence.

    Answers are compared in the form of answers.g3_answer, so "1,000" and "1000.0" are one. Without a readable answer
    all are 0.
    """

    def measured(found: Column) -> Column:
        kinds = F.array_distinct(found)
        most = F.coalesce(F.array_max(F.transform(kinds, lambda a: F.size(F.filter(found, lambda x: x == a)))), F.lit(0))
        n, total = F.size(found), F.greatest(F.size(chains), F.lit(1))
        share = lambda x, of: F.when(n > 0, x / of).otherwise(F.lit(0.0))
        return F.struct(share(most, n).alias("agreement_rate"), F.size(kinds).cast("long").alias("n_unique"), share(n, total).alias("extraction_rate"), share(most, total).alias("majority_confidence"))

    return let(F.transform(F.filter(chains, lambda c: c["answer"].isNotNull()), lambda c: g3_answer(c["answer"])), measured)
