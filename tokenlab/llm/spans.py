"""Where the matches of a pattern stand in whole texts. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_matches(texts: DataFrame, patterns: dict[str, str], needs: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """texts (with the column t) and what matches_of() reads: by kind, the matches of its pattern and their places.

    needs: by kind, a cheap test that a text with a match passes; the others are spared the passes over them. What lies
    between matches gives, with the matches' lengths, their places; lengths are summed by blocks of 256 matches, so that
    a text with very many takes little more than linear time.
    """
    kinds, none = list(patterns), F.array().cast("array<string>")
    out = texts.select("*", *[F.when(needs[k](F.col("t")), F.regexp_extract_all("t", F.lit(patterns[k]), F.lit(0))).otherwise(none).alias(f"m_{k}") for k in kinds])
    out = out.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("t", patterns[k])).otherwise(none).alias(f"g_{k}") for k in kinds])
    out = out.select("*", *[F.expr(f"zip_with(slice(g_{k}, 1, size(m_{k})), m_{k}, (g, m) -> bigint(length(g) + length(m)))").alias(f"s_{k}") for k in kinds])
    out = out.select("*", *[F.expr(f"if(size(s_{k}) = 0, array(), transform(sequence(0, (size(s_{k}) - 1) div 256), b -> aggregate(slice(s_{k}, int(b) * 256 + 1, 256), 0L, (a, x) -> a + x)))").alias(f"b_{k}") for k in kinds])
    return out.select("*", *[F.expr(f"transform(b_{k}, (x, i) -> aggregate(slice(b_{k}, 1, i), 0L, (a, y) -> a + y))").alias(f"p_{k}") for k in kinds])


def matches_of(kind: str, valid: str) -> str:
    """SQL for the matches of a kind that are valid (SQL over a candidate c with its match c.m): an array of m, e (end)."""
    end = f"p_{kind}[c.i div 256] + aggregate(slice(s_{kind}, int((c.i div 256) * 256 + 1), c.i % 256 + 1), 0L, (a, x) -> a + x)"
    found = f"filter(transform(m_{kind}, (m, i) -> named_struct('m', m, 'i', i)), c -> {valid})"
    return f"transform({found}, c -> named_struct('m', c.m, 'e', {end}))"


def spans_of(kind: str, place: int, matches: str, score: str) -> str:
    """SQL for spans of matches (see matches_of), with their scores (SQL over c); sorted, they go by start, then place."""
    return f"transform({matches}, c -> named_struct('start', c.e - length(c.m), 'place', {place}, 'kind', '{kind}', 'end', c.e, 'score', {score}))"


def slim(spans: str) -> Column:
    """Spans without their place."""
    return F.expr(f"transform({spans}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'score', s.score))")


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
