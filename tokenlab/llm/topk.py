"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, released

#: Bytes of query vectors that are broadcast at a time.
BLOCK_BYTES = 32 << 20
#: Candidates that share one dense score array.
CANDIDATES = 1 << 13
#: Scores are sums of 64-bit products where these can't leave 64 bits, else of Python's whole numbers, up to this.
MOST_SCORE = 10**38 - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and values: floor(scale * x) of every component, x as double.

    Vectors that are null or hold a null or non-finite component take no part; neither do those with an id of null.
    """
    x = F.col("vector")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return own.filter(F.col("vec_id").isNotNull() & x.isNotNull() & whole).select("vec_id", F.transform(x, lambda v: F.floor(v * float(scale)).cast("long")).alias("values"))


def postings(lists: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (candidates that hold it, their weights); zero weights are left out."""
    sizes = np.array([len(v) for v in lists])
    flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = flat != 0
    row, term, flat = row[some], term[some], flat[some]
    order = np.argsort(term, kind="stable")
    row, term, flat = row[order], term[order], flat[order]
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else []
    return {int(term[a]): (row[a:b], flat[a:b]) for a, b in zip(starts, [*starts[1:], len(term)], strict=True)}


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids: a partition, then an order of what may be among them."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        may = np.flatnonzero(scores >= least)
    else:
        may = np.arange(len(ids))
    if scores.dtype == object:
        return np.array(sorted(may, key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return may[np.lexsort((ids[may], -scores[may]))[:k]]


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Query vectors with a number and their id, in blocks of bounded size; one block is on the driver at a time."""
    block, size = [], 0
    for number, r in enumerate(queries.toLocalIterator()):
        v = np.array(r["values"], dtype=np.int64)
        block.append((number, r["vec_id"], v))
        size += v.nbytes + 64
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _largest(v: np.ndarray) -> int:
    return max(abs(int(v.min())), abs(int(v.max()))) if len(v) else 0


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query's vector.

    Candidates are all rows with another id than the query's; if fewer than k, all. Ties go to the smaller vec_id.
    A dimension is a term: each query scatters its weight times a term's posting weights into one dense score array
    per chunk of candidates, a partition selects k of each, and the tasks' selections are merged. Dimensions that
    one of two vectors lacks count as 0. is_query is evaluated on vec_id.

    Queries go out in blocks of BLOCK_BYTES; each block's selection is written before the next one is sent, so one
    block is held at a time. Memory per task: one chunk of candidates, its score array and k rows per query. Rows
    that repeat an id are candidates of their own; of queries that repeat one, each different vector answers for
    itself, with ranks of its own. Scores are exact: a score beyond 64 bits ranks by its value and is shown as the
    nearest 64-bit number. A scaled component beyond 64 bits counts as the nearest 64-bit number.
    """
    spark = vectors.sparkSession
    whole = quantised(vectors, id_col, vector_col, scale)
    out = None
    for block in _blocks(whole.filter(is_query).distinct()):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            kept = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in queries]
            tops = [_largest(w) for _, _, w in queries]
            for batch in batches:
                for at in range(0, batch.num_rows, CANDIDATES):
                    part = batch.slice(at, CANDIDATES)
                    ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    lists = part.column(1)
                    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    lists = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    terms, top = postings(lists), _largest(flat) * int(np.diff(ends).max(initial=0))
                    exact = None
                    for q, (_, query, weights) in enumerate(queries):
                        fits = top * tops[q] < 1 << 62
                        if not fits and exact is None:
                            exact = {t: (rows, values.astype(object)) for t, (rows, values) in terms.items()}
                        scores = np.zeros(len(ids), dtype=np.int64 if fits else object)
                        for t in np.flatnonzero(weights):
                            if int(t) in terms:
                                rows, values = (terms if fits else exact)[int(t)]
                                scores[rows] += (weights[t] if fits else int(weights[t])) * values
                        other = ids != query
                        names, scores = np.concatenate((kept[q][0], ids[other])), np.concatenate((kept[q][1], scores[other]))
                        chosen = best(names, scores, k)
                        kept[q] = names[chosen], scores[chosen]
            sizes = [len(x) for x, _ in kept]
            if sum(sizes):
                scores = [Decimal(max(-MOST_SCORE, min(MOST_SCORE, int(x)))) for _, s in kept for x in s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q for q, _, _ in queries], sizes), pa.int64()), pa.array(np.repeat([i for _, i, _ in queries], sizes), pa.int64()), pa.array(np.concatenate([x for x, _ in kept]), pa.int64()), pa.array(scores, pa.decimal128(38, 0))],
                    names=["q", "query_id", "vec_id", "exact"],
                )

        found = materialise(whole.mapInArrow(released(search), "q long, query_id long, vec_id long, exact decimal(38,0)"), "topk")
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("exact").desc(), "vec_id"))
    low, high = F.lit(Decimal(-(1 << 63))), F.lit(Decimal((1 << 63) - 1))
    return out.select("query_id", place.alias("rank"), "vec_id", F.greatest(low, F.least(high, "exact")).cast("long").alias("score")).filter(F.col("rank") <= k)
