"""Rules that a user brings: vote rules as table functions, verifiers as functions of SQL, classifiers by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import learn

#: A vote rule: from a group's chains, in order, to the winning answer (or None).
Rule = Callable[[list[dict]], str | None]


def most_tokens(chains: list[dict]) -> str | None:
    """The answer on which the most tokens were spent; of equal ones the smallest."""
    sums: dict[str, int] = {}
    for c in chains:
        if c["answer"] is not None:
            sums[c["answer"]] = sums.get(c["answer"], 0) + (c.get("token_count") or 0)
    return min(sums, key=lambda a: (-sums[a], a)) if sums else None


def first_complete(chains: list[dict]) -> str | None:
    """The answer of the first chain that has one."""
    return next((c["answer"] for c in chains if c["answer"] is not None), None)


RULES: dict[str, Rule] = {"most_tokens": most_tokens, "first_complete": first_complete}


def vote_table(rules: dict[str, Rule]):
    """The class of a table function over TABLE(...) PARTITION BY key: the key, winner, correct and n of each group.

    Its arguments are the table and the rule's name. The table needs answer (a string) and correct (a boolean), and its
    first column is the key, by which it has to be partitioned; a missing column, another type or an unknown rule fails
    while the query is planned. A group is one task's, held as rows.
    """

    class Votes:
        @staticmethod
        def analyze(table: AnalyzeArgument, rule: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(table.dataType, T.StructType) or not table.isTable:
                raise ValueError("the first argument is TABLE(...)")
            fields = {f.name.lower(): f.dataType for f in table.dataType}
            for name, kind in (("answer", T.StringType()), ("correct", T.BooleanType())):
                if fields.get(name) != kind:
                    raise ValueError(f"the table needs {name} of type {kind.simpleString()}, not {fields[name].simpleString() if name in fields else 'none'}")
            if not rule.isConstantExpression or rule.value not in rules:
                raise ValueError(f"unknown rule {rule.value!r}; there are {', '.join(sorted(rules))}")
            key = table.dataType[0]
            return AnalyzeResult(T.StructType([T.StructField(key.name, key.dataType), T.StructField("winner", T.StringType()), T.StructField("correct", T.BooleanType()), T.StructField("n", T.IntegerType())]))

        def __init__(self):
            self.key, self.rows, self.rule = None, [], None

        def eval(self, table, rule: str):
            row = table.asDict()
            self.key, self.rule = table[0], rule
            self.rows.append({k.lower(): v for k, v in row.items()})

        def terminate(self):
            if self.rule is not None:
                winner = rules[self.rule](self.rows)
                right = any(r["correct"] for r in self.rows if r["answer"] == winner) if winner is not None else False
                yield self.key, winner, right, len(self.rows)

    return Votes


def register_rules(spark: SparkSession, name: str = "vote_by", **more: Rule) -> None:
    """Make name(TABLE(chains) PARTITION BY key ORDER BY (...), 'rule') callable from SQL, with RULES and more."""
    for k, f in more.items():
        if not callable(f):
            raise TypeError(f"{k} is no function")
    spark.udtf.register(name, F.udtf(vote_table(RULES | more)))


def register_verifier(spark: SparkSession, name: str, verify: Callable[[str | None, str | None], bool], seconds: float = 3.0) -> None:
    """Make name(text, gold) callable from SQL: a struct of correct and timed_out, for a function of two texts.

    An answer that is no boolean is an error; a call over its time is recorded, not judged.
    """
    from ..functions import symbols

    @F.pandas_udf("correct boolean, timed_out boolean")
    def run(text: pd.Series, gold: pd.Series) -> pd.DataFrame:
        out = []
        for t, g in zip(text, gold, strict=True):
            try:
                with symbols.deadline(seconds):
                    right = verify(t, g)
            except symbols.TimedOut:
                out.append((None, True))
                continue
            if not isinstance(right, bool):
                raise TypeError(f"{name} gave {right!r} instead of a boolean")
            out.append((right, False))
        return pd.DataFrame(out, columns=["correct", "timed_out"], dtype=object)

    spark.udf.register(name, run)


def register_classifier(kind: str, make: Callable) -> None:
    """Let learn's functions take kind: make(n, c, seed, **columns) gives an estimator of pyspark.ml with probabilities."""
    if kind in learn.CLASSIFIERS:
        raise ValueError(f"{kind} is there already")
    learn.CLASSIFIERS[kind] = make
