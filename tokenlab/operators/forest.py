"""Random forests over classes of equal rows, grown level by level."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise

#: Values that a feature is cut into, classes of a block, and the least gain of a split.
BINS, BLOCK, GAIN = 32, 2048, 1e-12


class Forest:
    """Trees on bootstrap samples of all rows, each node split by the best of a drawn root of the features (Gini).

    Equal rows are one class. A row is drawn Poisson(1) times for a tree, so a class of n rows is Poisson(n) times: that
    is the same sample as row by row, and so are counts and impurities, at a cost that goes by the classes. Classes lie
    in blocks by hash, drawn again from the seed and the block's number for each level, so a forest depends on the rows
    alone. A level is one job: counts by tree, node, drawn feature and value, then the best splits, tree by tree. A task
    holds these counts for all trees, 256 KB a tree at most of depth 8 with up to 16 features; only splits go to the driver.

    A leaf holds `least` drawn rows at least. Features of up to BINS values are cut between any two, others at quantiles.
    """

    def __init__(self, trees: int, depth: int, least: int, seed: int, labelCol: str = "label", featuresCol: str = "features", weightCol: str = "weight"):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.label, self.features, self.weight = labelCol, featuresCol, weightCol

    def getNumTrees(self) -> int:
        return self.trees

    def fit(self, rows: DataFrame) -> ForestModel:
        """rows: labels of 0 and 1, features (a vector), and a weight that is the same for all rows of a label."""
        rows = rows.select(F.col(self.label).cast("int").alias("y"), vector_to_array(F.col(self.features)).alias("x"), F.col(self.weight).cast("double").alias("w"))
        tally = materialise(rows.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("low"), F.max("w").alias("high")), "classes")
        sums = tally.groupBy("y").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.size("x")).alias("width")).collect()
        if not sums or any(r["y"] not in (0, 1) or r["low"] != r["high"] for r in sums):
            raise ValueError("a forest needs rows, labels 0 and 1, and one weight for all rows of a label")
        weights = np.zeros(2)
        total = np.zeros(2)
        for r in sums:
            weights[r["y"]], total[r["y"]] = r["low"], r["n"]
        cuts = self.cuts(rows, tally, sums[0]["width"])
        model = ForestModel(self, cuts, float(total[1] * weights[1] / (total @ weights)))
        self.grow(model, self.blocks(tally, cuts, sum(r["classes"] for r in sums)), weights)
        return model

    def cuts(self, rows: DataFrame, tally: DataFrame, width: int) -> list[np.ndarray]:
        """For each feature the values that rows may be cut at: up to and including one is left."""
        values = tally.select(F.posexplode("x").alias("f", "v")).distinct()
        few = {r["f"] for r in values.groupBy("f").count().collect() if r["count"] <= BINS}
        known: dict[int, list[float]] = {f: [] for f in range(width)}
        # At most BINS values of each feature.
        for r in values.filter(F.col("f").isin(*few)).collect() if few else []:
            known[r["f"]].append(r["v"])
        many = [f for f in range(width) if f not in few]
        grid = [i / BINS for i in range(1, BINS)]
        found = rows.agg(*[F.percentile_approx(F.col("x")[f], grid, 10_000) for f in many]).first() if many else []
        out = [(lambda v: (v[1:] + v[:-1]) / 2)(np.unique(known[f])) for f in range(width)]
        for f, quantiles in zip(many, found, strict=True):
            out[f] = np.unique(quantiles)
        return out

    def blocks(self, tally: DataFrame, cuts: list[np.ndarray], classes: int) -> DataFrame:
        """block, labels, numbers of rows and features' bins of up to about BLOCK classes, in a table."""
        n = ceil(classes / BLOCK)
        block = F.pmod(F.xxhash64("y", "x"), F.lit(n)).cast("int").alias("block")
        lists = tally.repartition(min(n, 4 * tally.sparkSession.sparkContext.defaultParallelism), block).groupBy(block).agg(F.sort_array(F.collect_list(F.struct("y", "x", "n"))).alias("c"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    y, x, n = batch.column(1).slice(i, 1).flatten().flatten()
                    bins = binned(x, cuts)
                    yield pa.RecordBatch.from_pydict({"block": batch.column(0).slice(i, 1), "y": [y.to_numpy().astype(np.uint8).tobytes()], "n": [n.to_numpy().astype(np.int64).tobytes()], "bins": [bins.tobytes()]})

        return materialise(lists.mapInArrow(pack, "block int, y binary, n binary, bins binary"), "blocks")

    def grow(self, model: ForestModel, blocks: DataFrame, weights: np.ndarray) -> None:
        trees, least, seed, width = self.trees, self.least, self.seed, len(model.cuts)
        drawn, parts = ceil(sqrt(width)), min(trees, blocks.sparkSession.sparkContext.defaultParallelism)
        # Nodes are numbered as in a heap, from 1. Those that a split may still pay for are open.
        live = np.zeros((trees, 2 << self.depth), dtype=bool)
        live[:, 1] = True
        gains = np.zeros((trees, width))
        for level in range(self.depth):
            first = 1 << level
            if not live[:, first : 2 * first].any():
                break
            feature, cut = model.feature, model.cut
            choice = np.random.Generator(np.random.Philox(key=[seed, (1 << 40) + level])).random((trees, first, width)).argsort(axis=2)[:, :, :drawn].astype(np.int16)

            def count(batches: Iterator[pa.RecordBatch], level=level, first=first, feature=feature, cut=cut, choice=choice, live=live) -> Iterator[pa.RecordBatch]:
                size, sums = first * drawn * BINS * 2, {}
                for batch in batches:
                    for block, y, n, bins in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        y, n = np.frombuffer(y, np.uint8), np.frombuffer(n, np.int64)
                        bins = np.frombuffer(bins, np.uint8).reshape(len(y), width)
                        random = np.random.Generator(np.random.Philox(key=[seed, block]))
                        for t in range(trees):
                            times = random.poisson(n)
                            node = landed(bins, feature[t], cut[t], level)
                            rows = np.flatnonzero(live[t][node] & (node >= first) & (times > 0))
                            if not len(rows):
                                continue
                            at, b, label, weight = node[rows] - first, bins[rows], y[rows], times[rows]
                            held = sums.setdefault(t, np.zeros(size))
                            for j in range(drawn):
                                key = ((at * drawn + j) * BINS + np.take_along_axis(b, choice[t, at, j][:, None], 1)[:, 0]) * 2 + label
                                held += np.bincount(key, weights=weight, minlength=size)
                for t, held in sums.items():
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "counts": [held.tobytes()]})

            def best(batches: Iterator[pa.RecordBatch], first=first) -> Iterator[pa.RecordBatch]:
                sums: dict[int, np.ndarray] = {}
                for batch in batches:
                    for t, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        sums[t] = sums.get(t, 0) + np.frombuffer(held)
                for t, held in sums.items():
                    yield splits(t, held.reshape(first, drawn, BINS, 2), weights, least)

            found = blocks.mapInArrow(count, "tree int, counts binary").repartition(parts, "tree").mapInArrow(best, _SPLIT).toArrow()
            t, node, slot, bin_, l0, l1, r0, r1, gain = (c.to_numpy() for c in found.columns)
            left, right = np.stack([l0, l1], axis=1), np.stack([r0, r1], axis=1)
            if level == 0:
                model.chance[t, 1] = share(left + right, weights)
            ok = gain > GAIN
            t, node, slot, bin_, left, right, gain = (v[ok] for v in (t, node, slot, bin_, left, right, gain))
            f = choice[t, node, slot]
            model.feature[t, first + node], model.cut[t, first + node] = f, bin_
            np.add.at(gains, (t, f), gain * ((left + right) @ weights))
            for side, counts in enumerate((left, right)):
                child = 2 * (first + node) + side
                model.chance[t, child] = share(counts, weights)
                live[t, child] = (counts.sum(axis=1) >= 2 * least) & (counts > 0).all(axis=1)
        each = gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
        model.featureImportances = DenseVector(each.sum(axis=0) / max(each.sum(), 1e-300))


class ForestModel:
    """Features (-1 at leaves), bins and shares of label 1 by tree and node."""

    def __init__(self, forest: Forest, cuts: list[np.ndarray], chance: float):
        shape = forest.trees, 2 << forest.depth
        self.column, self.depth, self.cuts = forest.features, forest.depth, cuts
        self.feature, self.cut, self.chance = np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.full(shape, chance)
        self.featureImportances = DenseVector(np.zeros(len(cuts)))

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with probability, a vector: the trees' mean."""
        depth, cuts, feature, cut, chance = self.depth, self.cuts, self.feature, self.cut, self.chance

        @F.arrow_udf("double")
        def mean(x: pa.Array) -> pa.Array:
            bins = binned(x, cuts)
            total = np.zeros(len(bins))
            for t in range(len(feature)):
                total += chance[t][landed(bins, feature[t], cut[t], depth)]
            return pa.array(total / len(feature))

        p = mean(vector_to_array(F.col(self.column)))
        return rows.withColumn("__p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).drop("__p")


_SPLIT = "tree int, node int, slot int, bin int, l0 double, l1 double, r0 double, r1 double, gain double"


def binned(x: pa.Array, cuts: list[np.ndarray]) -> np.ndarray:
    """For each row of features the number of cuts below its values."""
    values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
    return np.stack([np.searchsorted(c, values[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def landed(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of a tree that each row comes to after so many levels, or the leaf before."""
    node, rows = np.ones(len(bins), dtype=np.int32), np.arange(len(bins))
    for _ in range(levels):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + (bins[rows, f] > cut[node]), node)
    return node


def share(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    mass = counts * weights
    return mass[:, 1] / np.maximum(mass.sum(axis=1), 1e-300)


def splits(tree: int, counts: np.ndarray, weights: np.ndarray, least: int) -> pa.RecordBatch:
    """The best split of each node with rows. counts: by node, drawn feature, bin and label."""
    nodes = np.flatnonzero(counts[:, 0].any(axis=(1, 2)))
    left = counts[nodes].cumsum(axis=2)
    right = left[:, :, -1:] - left

    def impure(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mass = c * weights
        whole = mass.sum(axis=-1)
        return whole, 1 - ((mass / np.maximum(whole, 1e-300)[..., None]) ** 2).sum(axis=-1)

    (a, x), (b, y), (n, z) = impure(left), impure(right), impure(left[:, :, -1:])
    gain = np.where((left.sum(axis=-1) >= least) & (right.sum(axis=-1) >= least), z - (a * x + b * y) / np.maximum(n, 1e-300), -1.0).reshape(len(nodes), -1)
    at = gain.argmax(axis=1)
    i, slot, cut = np.arange(len(nodes)), at // BINS, at % BINS
    l, r = left[i, slot, cut], right[i, slot, cut]  # noqa: E741
    whole = [np.full(len(nodes), tree), nodes, slot, cut]
    return pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in whole), *(pa.array(v) for v in (l[:, 0], l[:, 1], r[:, 0], r[:, 1], gain[i, at]))], names=[c.split()[0] for c in _SPLIT.split(", ")])
