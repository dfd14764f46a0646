"""Numbering rows in a whole order, and exact order statistics, without one big task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise

#: Values of which an exact quantile is taken at once.
AT_ONCE = 1_000_000


def dealt(frame: DataFrame, *by: Column) -> DataFrame:
    """frame, in a table, with __part and __place: ranges of the order, and the place (from 1) within one's range.

    The rows are written first, so that sampling the ranges doesn't work them out again. Ranges are as many as the
    session's shuffle partitions; where the order is total, rows that tie in its first columns are split too.
    """
    rows = materialise(frame, "rows").repartitionByRange(*by).sortWithinPartitions(*by)
    return materialise(rows.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id() % (1 << 33) + 1), "dealt")


def before(rows: DataFrame, sums: dict[str, Column], *by: str) -> DataFrame:
    """For each __part (and by): the sums over the parts before it. One row for each part, so it is small."""
    each = rows.groupBy(*by, "__part").agg(*[c.alias(k) for k, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*by, "__part", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums])


def numbered(frame: DataFrame, *by: Column, name: str = "rank") -> DataFrame:
    """frame with its rows' numbers from 1 in the order of by, which should be total."""
    rows = dealt(frame, *by)
    out = rows.join(F.broadcast(before(rows, {"__before": F.count(F.lit(1))})), "__part")
    return out.withColumn(name, F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")


def _at(rows: DataFrame, n: int, k: int) -> float:
    """The k-th (from 0) of n values x in order.

    Two values of the column bracket the place; rows left are those strictly on one side of one or between them, so
    each pass takes some away, however many values are equal.
    """
    x = F.col("x")
    while n > AT_ONCE:
        low, high = rows.approxQuantile("x", [max(0.0, k / n - 0.01), min(1.0, k / n + 0.01)], 0.002)
        below, equal, inside, top = rows.agg(F.count_if(x < low), F.count_if(x == low), F.count_if((x > low) & (x < high)), F.count_if((x == high) & (x > low))).first()
        if k < below:
            rows, n = rows.filter(x < low), below
        elif k < below + equal:
            return low
        elif k < below + equal + inside:
            rows, n, k = rows.filter((x > low) & (x < high)), inside, k - below - equal
        elif k < below + equal + inside + top:
            return high
        else:
            rows, n, k = rows.filter(x > high), n - below - equal - inside - top, k - below - equal - inside - top
    return float(sorted(r["x"] for r in rows.collect())[k])


def exact_quantile(frame: DataFrame, column: str, q: float) -> float | None:
    """The exact quantile (linear interpolation) of a column's values, null without any.

    Nulls and NaN play no part; between infinities of both signs there is none.
    """
    return exact_quantiles(frame, column, q)[0]


def exact_quantiles(frame: DataFrame, column: str, *qs: float) -> list[float | None]:
    """exact_quantile() for each q; the column is worked out once."""
    rows = materialise(frame.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)"), "values")
    n = rows.count()
    if not n:
        return [None] * len(qs)
    known: dict[int, float] = {}

    def value(k: int) -> float:
        if k not in known:
            known[k] = _at(rows, n, k)
        return known[k]

    out = []
    for q in qs:
        k = min(int(q * (n - 1)), n - 1)
        part = q * (n - 1) - k
        low = value(k)
        high = value(k + 1) if part > 0 and k + 1 < n else low
        out.append(low if high == low else low + (high - low) * part)
    return [None if math.isnan(x) else float(x) for x in out]
