"""Secrets in whole texts: patterns, and character Markov models that tell random strings from identifiers.

DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import row_struct
from .spans import matches_of, slim, spans_of, with_matches

# Fixed patterns, by kind in the order in which spans with one start are listed. Those of the first three match what
#   assign (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)
#   access AKIA[A-Z0-9]+
#   hex    [0-9a-f]+
# match (but for runs of hex digits that are too short), without backtracking.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+",
}
BASE_KINDS = ("assign", "access", "hex")
# A text without these holds no span of the kind, and the passes over it are spared.
NEEDS = {
    "assign": lambda t: t.rlike(r"""(?i:word|passwd|secret|token|key)["']?\x20*[:=]"""),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike(PATTERNS["hex"]),
    "random": lambda t: t.rlike(PATTERNS["random"]),
}
# Fixed bounds: characters of an assigned value and of an access key.
LEAST_VALUE, LEAST_ACCESS = 6, 20
OUT = (*(f"n_{k}" for k in PATTERNS), "base_spans", "all_spans", "top_score")

#: Labelled samples of each class from which the models learn, at most.
MOST_SAMPLES = 4096
#: Random strings that are made, beside those found in texts.
MADE_SAMPLES = 1024
#: Log-likelihood ratio (natural, in thousandths) from which a token counts as random: it outweighs odds of 1 to 10 000.
LEAST_RATIO = 9210
# The models' states are the printable ASCII characters, of which the patterns let 68 into values.
_STATES, _SYMBOLS = 96, 68
# Counts of a symbol before any sample, and of a state's symbols as they are in all states together.
_PRIOR, _BACK = 0.5, 8.0


@dataclass(frozen=True)
class Model:
    """ratios[96 * a + b]: 1000 * ln of how much likelier b follows a in random strings than in identifiers, floored.

    States are code points less 32; the state before a string is 0.
    """

    ratios: tuple[int, ...]

    def ratio(self, value: str) -> str:
        """SQL for the log-likelihood ratio of a value of printable ASCII, in thousandths."""
        table = f"cast(split('{','.join(map(str, self.ratios))}', ',') as array<int>)"
        step = f"named_struct('p', ascii(x) - 32, 's', a.s + {table}[a.p * {_STATES} + ascii(x) - 32])"
        return f"aggregate(filter(split({value}, ''), x -> x <> ''), named_struct('p', 0, 's', 0L), (a, x) -> {step}, a -> a.s)"


def labelled_samples(docs: DataFrame, text_col: str = "text", most: int = MOST_SAMPLES, made: int = MADE_SAMPLES) -> DataFrame:
    """value, random: distinct strings of both classes, at most `most` of each from the texts of docs, by md5.

    Random are access keys, hex runs and assigned values of 16 characters and more with a digit, and `made` strings in
    base 64 that are digests of numbers. Ordinary are other tokens of 16 characters and more. Null texts are empty.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")

    def found(kind: str, group: int, t: Column) -> Column:
        return F.when(NEEDS[kind](t), F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(group))).otherwise(none)

    t = F.col("t")
    values = F.filter(found("assign", 1, t), lambda v: (F.length(v) >= 16) & v.rlike("[0-9]"))
    keys = F.filter(found("access", 0, t), lambda v: F.length(v) >= LEAST_ACCESS)
    random = F.concat(values, keys, found("hex", 0, t))
    bare = reduce(lambda x, k: F.when(NEEDS[k](x), F.regexp_replace(x, PATTERNS[k], " ")).otherwise(x), BASE_KINDS, t)
    some = texts.select(F.explode(random).alias("value")).distinct().orderBy(F.md5("value")).limit(most)
    digests = docs.sparkSession.range(made).select(F.base64(F.unhex(F.sha2(F.concat(F.lit("random:"), F.col("id")), 256))).alias("value"))
    others = texts.select(bare.alias("t")).select(F.explode(found("random", 0, F.col("t"))).alias("value")).distinct().orderBy(F.md5("value")).limit(most)
    return some.union(digests).select("value", F.lit(True).alias("random")).union(others.select("value", F.lit(False).alias("random")))


def learn(samples: DataFrame) -> Model:
    """Chances of transitions in both classes from samples (value, random), smoothed by those of symbols in all states.

    Characters other than printable ASCII are left out, null values and labels too. Without samples all ratios are 0.
    At most two rows for each pair of characters come to the driver.
    """
    chars = F.filter(F.split("value", ""), lambda x: (x != "") & (F.ascii(x) > 32) & (F.ascii(x) < 127))
    codes = samples.filter("random is not null").select("random", F.transform(chars, lambda x: F.ascii(x) - 32).alias("c"))
    steps = codes.filter("size(c) > 0").select("random", F.explode(F.expr(f"transform(c, (x, i) -> if(i = 0, 0, c[greatest(i - 1, 0)]) * {_STATES} + x)")).alias("step"))
    n = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    rows = {(x, a): sum(n.get((x, a * _STATES + b), 0) for b in range(_STATES)) for x in (True, False) for a in range(_STATES)}
    columns = {(x, b): sum(n.get((x, a * _STATES + b), 0) for a in range(_STATES)) for x in (True, False) for b in range(_STATES)}
    total = {x: sum(rows[x, a] for a in range(_STATES)) for x in (True, False)}

    def chance(x: bool, a: int, b: int) -> float:
        return (n.get((x, a * _STATES + b), 0) + _BACK * ((columns[x, b] + _PRIOR) / (total[x] + _PRIOR * _SYMBOLS))) / (rows[x, a] + _BACK)

    def ratio(a: int, b: int) -> int:
        return math.floor(1000 * math.log(chance(True, a, b) / chance(False, a, b)))

    return Model(tuple(ratio(a, b) for a in range(_STATES) for b in range(_STATES)))


def find_secrets(docs: DataFrame, model: Model, text_col: str = "text", least_ratio: int = LEAST_RATIO) -> DataFrame:
    """docs with counts by kind, base_spans, all_spans (arrays of kind, start, end, score) and top_score.

    Positions are code points from 0, the end exclusive. Matches of a kind are leftmost and don't overlap; those that
    fail their check (length of the assigned value, of the key) are dropped without another try; spans of different
    kinds may overlap. score is the log-likelihood ratio of the assigned value or the match in thousandths: base kinds
    stay whatever it is, tokens of 16 characters and more are `random` spans from least_ratio on. A null text is
    empty; top_score is null without spans. Columns of docs stay, but those named like the new ones are replaced; an
    empty table gives no rows. One pass over the rows, no shuffle.
    """
    kinds = list(PATTERNS)
    out = with_matches(docs.select(row_struct(docs, OUT).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), PATTERNS, NEEDS)
    # No ' in the SQL text: what stands between the first sign and the value.
    value = r"regexp_extract(c.m, r'[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)', 1)"
    valid = {"assign": f"length({value}) >= {LEAST_VALUE}", "access": f"length(c.m) >= {LEAST_ACCESS}", "hex": "true", "random": "true"}
    spans = []
    for place, k in enumerate(kinds):
        one = spans_of(k, place, matches_of(k, valid[k]), model.ratio(value if k == "assign" else "c.m"))
        spans.append(F.expr(one if k in BASE_KINDS else f"filter({one}, s -> s.score >= {least_ratio})").alias(f"f_{k}"))
    out = out.select("row", *spans)
    base = F.array_sort(F.concat(*[f"f_{k}" for k in BASE_KINDS]))
    every = F.array_sort(F.concat(*[f"f_{k}" for k in kinds]))
    out = out.select("row", *[F.size(f"f_{k}").cast("long").alias(f"n_{k}") for k in kinds], base.alias("b"), every.alias("v"))
    return out.select("row.*", *[f"n_{k}" for k in kinds], slim("b").alias("base_spans"), slim("v").alias("all_spans"), F.array_max("v.score").alias("top_score"))

