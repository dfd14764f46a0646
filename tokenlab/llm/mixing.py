"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, row_struct

OUT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _key(value: Column) -> Column:
    """Text of a value for hashing; null differs from every string."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """One row per source: its size, its target and its offset in [0, 1).

    sizes: columns source, source_size. Sources in code point order, null last, take the weights in turn.
    Together the targets are share[0]/share[1] of all sizes; none is above `most` times its source's size, and
    what lies above goes to the others by weight. That fixpoint is found without iterating: with sources in order
    of limit / weight, a source is at its limit exactly if the level that the sources from it on would share
    reaches it. Conditions are compared in whole numbers. One row per source is all that meets in one task here.
    """
    num, den = share
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("decimal(38,0)")
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    placed = placed.select("source", "source_size", "place", w.alias("weight"), (F.col("source_size") * most).cast("decimal(38,0)").alias("limit"))
    order = Window.orderBy((F.col("limit").cast("double") / F.col("weight").cast("double")), "place")
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = placed.select(
        "*",
        (F.sum(F.col("source_size").cast("decimal(38,0)")).over(every) * num).cast("decimal(38,0)").alias("all"),
        (F.coalesce(F.sum("limit").over(before), F.lit(0).cast("decimal(38,0)")) * den).cast("decimal(38,0)").alias("gone"),
        F.sum("weight").over(after).cast("decimal(38,0)").alias("open"),
    )
    full = (F.col("limit") * F.col("open") * den).cast("decimal(38,0)") <= (F.col("weight") * (F.col("all") - F.col("gone"))).cast("decimal(38,0)")
    run = run.withColumn("full", full)
    level = F.first(F.when(~F.col("full"), F.struct("all", "gone", "open")), ignorenulls=True).over(every)
    run = run.withColumn("level", level)
    shared = (F.col("weight") * (F.col("level.all") - F.col("level.gone"))).cast("double") / (F.col("level.open") * den).cast("double")
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("offset"), _key(F.col("source"))).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return run.select("source", "source_size", target.alias("target"), offset.alias("offset"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies * size), by systematic sampling.

    Every document of a source expects target / source_size copies. The expected copies are prefix-summed over the
    source's documents, one offset drawn per source is added, and a document is taken once per whole number that
    its stretch of the sum crosses. Documents go in order of size, so that a source's taken words miss its target
    by about one long document at most.

    The expectation is the same for all documents of a source, so the prefix sum is that times a rank, and the rank
    is found without bringing a source together: documents are counted by (source, size class, salt), counts are
    summed over the classes before, and ranks run only within a class and salt. A source that holds a third of all
    rows is so spread over thousands of groups. Reruns agree: order and offsets come from md5 of ids and sources.

    size_col: a column that holds the sizes already; else the words of text_col are counted.
    Null or empty text: size 0, nothing taken in words. A null source is one source. Null ids sort together. Rows
    that repeat an id are documents of their own. An empty table gives no rows. Columns of docs stay, but those
    named like the new ones are replaced.
    """
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long")) if size_col else word_count(F.col(text_col))
    digest = F.md5(_key(F.col("id")).cast("binary"))
    bits = F.length(F.bin("size"))
    # The size's bit length and its next four bits, in whole numbers: the same on every machine.
    size_class = bits * 16 + F.when(bits > 5, F.expr("shiftright(size, length(bin(size)) - 5) & 15")).otherwise(F.col("size") % 16)
    own = docs.select(row_struct(docs, OUT).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), size.alias("size"))
    # A key without nulls, so that ranks and the join with the bins can share one shuffle of the rows.
    own = own.select("*", size_class.cast("int").alias("class"), digest.alias("digest"), _key(F.col("source")).alias("from"))
    own = own.select("*", (F.conv(F.substring("digest", 1, 2), 16, 10).cast("int") % 64).alias("salt"))
    bins = own.groupBy("from", "source", "class", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    sources = source_targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    order = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("from", "source", "class", "salt", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    bins = bins.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("from", "class", "salt", "before", "source_size", "target", "offset")
    inside = Window.partitionBy("from", "class", "salt").orderBy("size", "digest", "id")
    placed = own.withColumn("rank", F.row_number().over(inside)).join(bins, ["from", "class", "salt"])
    rank = (F.col("rank") + F.col("before")).cast("double")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    placed = placed.select("row", "size", "source_size", "target", "offset", rank.alias("rank"), each.alias("each"))
    crossed = F.floor(F.col("each") * F.col("rank") + F.col("offset")) - F.floor(F.col("each") * (F.col("rank") - 1.0) + F.col("offset"))
    placed = placed.withColumn("copies", F.least(crossed.cast("long"), F.lit(most).cast("long")))
    return placed.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Every document as often as mix() takes it; copy counts from 1."""
    some = mixed.filter(F.col("copies") > 0)
    return some.select(*[F.col(f"`{c}`") for c in columns if c.lower() != "copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
