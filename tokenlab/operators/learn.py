"""Folds, ranking measures and classifiers with out-of-fold scores."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise
from . import order
from .forest import Forest

#: Words that must not be in the names of features.
BANNED = ("label", "long", "correct", "gold", "answer_key", "utility")

#: Trees of a forest.
TREES = 200


def leakage_guard(columns: list[str], banned: tuple[str, ...] = BANNED) -> None:
    bad = [c for c in columns if any(b in c.lower() for b in banned)]
    if bad:
        raise ValueError(f"features that give the label away: {bad}")


def check_features(frame: DataFrame, key: str, label: str, features: list[str]) -> None:
    """One pass: keys unique and not null, labels 0 or 1, features finite."""
    finite = [F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf"))) for f in features]
    row = frame.agg(F.count(F.lit(1)), F.count_distinct(key), F.count_if(~F.col(label).isin(0, 1) | F.col(label).isNull()), sum(finite, F.lit(0))).first()
    if row[0] != row[1] or row[2] or row[3]:
        raise ValueError(f"{row[0] - row[1]} repeated or null keys, {row[2]} labels that aren't 0 or 1, {row[3]} features that aren't finite")


def constant_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_values (nulls count as one) and keep, in one pass."""
    sizes = frame.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    return sizes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("n_values")) for c in columns])).alias("x")).select("x.column", "x.n_values", (F.col("x.n_values") > 1).alias("keep"))


def drop_constant(frame: DataFrame, columns: list[str]) -> DataFrame:
    kept = {r["column"] for r in constant_columns(frame, columns).filter("keep").collect()}
    return frame.select([c for c in frame.columns if c not in columns or c in kept])


def _digest(seed: int, key: str):
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"), 256)


def stratified_folds(frame: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """frame with fold: rows of each label dealt in turn, in order of a hash of seed and key."""
    rows = order.numbered(frame.withColumn("__h", _digest(seed, key)), F.col(label), F.col("__h"), F.col(key), name="__i")
    # A row for each label.
    first = F.broadcast(rows.groupBy(F.col(label).alias("__l")).agg(F.min("__i").alias("__first")))
    return rows.join(first, F.col(label).eqNullSafe(F.col("__l"))).withColumn("fold", ((F.col("__i") - F.col("__first")) % k).cast("int")).drop("__h", "__i", "__l", "__first")


def group_folds(frame: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """frame with fold, the same for all rows of a group; groups are stratified by their largest label."""
    groups = stratified_folds(frame.groupBy(group).agg(F.max(label).alias("__label")), group, "__label", k, seed).select(F.col(group).alias("__g"), "fold")
    return frame.join(groups, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


#: Counts of a label are classed exactly below this, and by this many values for each doubling from there on.
FINE = 32


def spread_groups(classes: list[tuple[int, tuple[float, ...]]], k: int) -> list[list[int]]:
    """Folds of the groups of each class (its number of groups, its mean rows of each label) that exceed a multiple of k.

    Classes go by their rows, largest first; a group goes to the fold in which the labels' shares stay most even, of
    equal ones to that with fewer rows, then the first.
    """
    labels = len(classes[0][1]) if classes else 0
    total = [sum(m * h[i] for m, h in classes) or 1.0 for i in range(labels)]
    held = [[sum((m // k) * h[i] for m, h in classes) for i in range(labels)] for _ in range(k)]
    out: list[list[int]] = [[] for _ in classes]
    for c in sorted(range(len(classes)), key=lambda c: (-sum(classes[c][1]), classes[c][1], c)):
        m, h = classes[c]
        for _ in range(m % k):

            def cost(f: int, h=h) -> tuple[float, float, int]:
                # The sum of squares of a fold's share grows by this; sums over all other folds don't depend on it.
                return round(sum(((held[f][i] + h[i]) / total[i]) ** 2 - (held[f][i] / total[i]) ** 2 for i in range(labels)), 12), sum(held[f]), f

            best = min((f for f in range(k) if f not in out[c]), key=cost)
            out[c].append(best)
            held[best] = [held[best][i] + h[i] for i in range(labels)]
    return out


def balanced_group_folds(frame: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """frame with fold, the same for all rows of a group, so that folds have as even counts of each label (0 or 1) as whole
    groups allow.

    Groups with one histogram of labels are a class (counts from FINE on by their leading bits, so there is a bounded
    number of classes). A class's groups, in order of a hash, go to all folds in turn; what is left over from whole
    turns is placed one by one on the driver, largest first (spread_groups). Null groups are one group; rows with
    another label count as rows of neither.
    """
    counts = frame.groupBy(group).agg(*[F.count_if(F.col(label) == v).alias(f"__n{v}") for v in (0, 1)])
    leading = lambda c: F.expr(f"if({c} < {FINE}, {c}, {c} - {c} % shiftleft(1L, int(floor(log2({c}))) - {FINE.bit_length() - 2}))")
    counts = materialise(counts.select(F.col(group).alias("__g"), "__n0", "__n1", leading("__n0").alias("__c0"), leading("__n1").alias("__c1"), F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")).cast("binary"), 256).alias("__h")), "groups")
    found = sorted((r["__c0"], r["__c1"], r["m"], (r["a"], r["b"])) for r in counts.groupBy("__c0", "__c1").agg(F.count(F.lit(1)).alias("m"), F.avg("__n0").alias("a"), F.avg("__n1").alias("b")).collect())
    rest = spread_groups([(m, h) for *_, m, h in found], k)
    # One row for each class.
    table = F.broadcast(frame.sparkSession.createDataFrame([(a, b, m, r) for (a, b, m, _), r in zip(found, rest, strict=True)], "__c0 long, __c1 long, __m long, __rest array<int>"))
    numbered = order.numbered(counts, F.col("__c0"), F.col("__c1"), F.col("__h"), F.col("__g"), name="__i")
    first = F.broadcast(numbered.groupBy("__c0", "__c1").agg(F.min("__i").alias("__first")))
    placed = numbered.join(first, ["__c0", "__c1"]).join(table, ["__c0", "__c1"]).withColumn("__i", F.col("__i") - F.col("__first"))
    turns = F.col("__m") - F.col("__m") % k
    fold = F.when(F.col("__i") < turns, F.col("__i") % k).otherwise(F.try_element_at("__rest", (F.col("__i") - turns + 1).cast("int")))
    folds = placed.select("__g", fold.cast("int").alias("fold"))
    return frame.join(folds, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def fold_number(frame: DataFrame, label: str, k: int = 5) -> int:
    """k, or the rows of the smallest label if they are fewer."""
    return min([k, *(r["n"] for r in frame.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect())])


def auc(frame: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Exact area under the ROC curve (Mann-Whitney, ties half), from counts by distinct score.

    Rows are summed by score first, and the scores dealt by ranges, so that an ordered pass sees the distinct scores
    of one range only; the ranges before come in as sums.
    """
    rows = frame.filter(F.col(score).isNotNull()).select(*by, F.col(score).alias("__s"), F.col(label).alias("__y"))
    tally = order.dealt(rows.groupBy(*by, "__s").agg(F.count_if(F.col("__y") == 1).alias("__p"), F.count_if(F.col("__y") == 0).alias("__n")), F.col("__s"))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = tally.select(*by, "__part", "__p", "__n", (F.col("__p") * (inside + F.col("__n") / 2)).alias("__w")).groupBy(*by, "__part").agg(F.sum("__p").alias("__p"), F.sum("__n").alias("__n"), F.sum("__w").alias("__w"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = sums.select(*by, "__p", "__n", (F.col("__w") + F.col("__p") * earlier).alias("__w")).groupBy(*by).agg(F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"), F.sum("__w").alias("__w"))
    return out.select(*by, "n_pos", "n_neg", F.round(F.col("__w") / F.nullif((F.col("n_pos") * F.col("n_neg")).cast("double"), F.lit(0.0)), 6).alias("auc"))


def correlations(frame: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, Pearson correlation with the label, and means by label, in one pass; by descending |r| on show."""
    y = F.col(label).cast("double")
    cells = [F.struct(F.lit(f).alias("feature"), F.round(F.corr(F.col(f).cast("double"), y), 6).alias("r"), F.round(F.avg(F.when(y == 1, F.col(f))), 6).alias("mean_pos"), F.round(F.avg(F.when(y == 0, F.col(f))), 6).alias("mean_neg")) for f in features]
    return frame.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def class_weight(label: Column, sizes: dict) -> Column:
    """n / (2 * rows of the label)."""
    total, weight = sum(sizes.values()), F.lit(1.0)
    for value, size in sizes.items():
        weight = F.when(label == value, F.lit(total / (2.0 * size))).otherwise(weight)
    return weight


def scaling(rows: DataFrame, features: list[str], *by: str) -> DataFrame:
    """n and, for each feature, mean and population variance; one pass for all folds and labels."""
    x = lambda f: F.col(f).cast("double")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x(f)).alias(f"m_{f}") for f in features], *[F.var_pop(x(f)).alias(f"v_{f}") for f in features])


def _logistic(n: int, c: float, seed: int, iterations: int = 200, **columns):
    return LogisticRegression(regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=iterations, **columns)


def _forest(n: int, c: float, seed: int, **columns):
    return Forest(TREES, 8, 5, seed, **columns)


def _deep(n: int, c: float, seed: int, **columns):
    """As many trees as the routing evaluation grows, to the greatest depth that Spark's trees have, down to single rows."""
    return RandomForestClassifier(numTrees=300, maxDepth=30, minInstancesPerNode=1, seed=seed, **columns)


def _boosted(n: int, c: float, seed: int, **columns):
    return GBTClassifier(maxIter=20, maxDepth=4, seed=seed, **columns)


#: Estimators by name; plugins.register_classifier adds others.
CLASSIFIERS = {"logistic": _logistic, "forest": _forest, "deep_forest": _deep, "boosted": _boosted}


def classifier(kind: str, n: int, c: float = 1.0, seed: int = 42):
    """logistic (L2 of strength 1 / (c * n) on the mean loss), forest, deep_forest, boosted or one that was registered, all
    with weights."""
    if kind not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {kind!r}; there are {', '.join(sorted(CLASSIFIERS))}")
    return CLASSIFIERS[kind](n, c, seed, labelCol="label", featuresCol="features", weightCol="weight")


#: Classifiers that minimise a weighted sum over rows: equal rows may come as one, with their number as weight. Forests
#: draw rows for each tree, so there they may not; a Forest counts equal rows itself, and draws how many of them it takes.
SUMMED = {"logistic"}


def tallied(rows: DataFrame, features: list[str], kind: str, *by: str) -> DataFrame:
    """by, label and features to train on; for a kind of SUMMED one row for all equal ones, with their number as __rows."""
    if kind not in SUMMED:
        return rows.select(*by, "label", *features)
    return materialise(rows.groupBy(*by, "label", *features).agg(F.count(F.lit(1)).alias("__rows")), "tally")


class Fitted:
    """A model fitted on some rows, with the scaling that it learned."""

    def __init__(self, train: DataFrame, features: list[str], kind: str, sums: list, seed: int = 42):
        """train: label (double) and features, as of tallied(). sums: rows of scaling() by label, of the rows behind train."""
        self.features, n = features, sum(r["n"] for r in sums)
        self.scale = {}
        if kind == "logistic":
            for f in features:
                mean = sum(r["n"] * r[f"m_{f}"] for r in sums) / n
                self.scale[f] = mean, (sum(r["n"] * (r[f"v_{f}"] + (r[f"m_{f}"] - mean) ** 2) for r in sums) / n) ** 0.5 or 1.0
        sizes: dict[float, int] = {}
        for r in sums:
            sizes[r["label"]] = sizes.get(r["label"], 0) + r["n"]
        weight = class_weight(F.col("label"), sizes)
        train = train.withColumn("weight", weight * F.col("__rows") if "__rows" in train.columns else weight).drop("__rows")
        self.model = classifier(kind, n, seed=seed).fit(self.assembled(train))

    def assembled(self, rows: DataFrame) -> DataFrame:
        scaled = rows.select(*[c for c in rows.columns if c not in self.scale], *[((F.col(f) - m) / s).alias(f) for f, (m, s) in self.scale.items()])
        return VectorAssembler(inputCols=self.features, outputCol="features").transform(scaled)

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with probability; without the features."""
        out = self.model.transform(self.assembled(rows)).withColumn("probability", vector_to_array("probability")[1])
        return out.drop("features", "rawPrediction", "prediction", "weight", *self.features)


def out_of_fold(frame: DataFrame, features: list[str], label: str, kind: str = "logistic", k: int = 5, seed: int = 42) -> DataFrame:
    """frame (with fold) and probability: every row scored by a model that didn't see its fold.

    The frame is worked out once, into a table; sizes and moments of all folds come from one aggregation of it, and so do
    the tallies of equal rows that a SUMMED kind trains on. Models of tallies are many short jobs, so the folds' are fitted
    side by side.
    """
    leakage_guard(features)
    base = materialise(frame.withColumn("label", F.col(label).cast("double")), "folds")
    sums = scaling(base, features, "fold", "label").collect()
    train = tallied(base, features, kind, "fold")
    fit = lambda fold: Fitted(train.filter(F.col("fold") != fold).drop("fold"), features, kind, [r for r in sums if r["fold"] != fold], seed)
    with ThreadPoolExecutor(k if kind in SUMMED | {"forest"} else 1) as pool:
        models = list(pool.map(fit, range(k)))
    return reduce(DataFrame.unionByName, [m.score(base.filter(F.col("fold") == fold)) for fold, m in enumerate(models)])


def enough_groups(frame: DataFrame, group: str, label: str, k: int = 5) -> bool:
    """Whether both labels have rows of k groups at least, which folds by group need."""
    row = frame.agg(*[F.count_distinct(F.when(F.col(label) == v, F.col(group))) for v in (1, 0)]).first()
    return min(row) >= k


def grouped_scores(frame: DataFrame, features: list[str], label: str, group: str, kind: str = "logistic", k: int = 5, seed: int = 42) -> tuple[DataFrame, bool]:
    """frame with probability, out of folds by group, and whether it was fitted: with fewer than k groups in a label,
    all are 0."""
    if not enough_groups(frame, group, label, k):
        return frame.withColumn("probability", F.lit(0.0)), False
    return out_of_fold(group_folds(frame, group, label, k, seed), features, label, kind, k, seed), True


#: Columns that tell the data set, which transfer between data sets must not use.
DOMAIN = ("g1_is_gsm8k", "g1_is_math", "q_is_math", "is_math", "math_level", "q_math_level")


def holdout(frame: DataFrame, features: list[str], label: str, train_on, kind: str = "logistic", domain: tuple[str, ...] = DOMAIN) -> DataFrame:
    """Rows that train_on doesn't hold, scored by a model fitted on those that it does: cross-domain transfer.

    Features that tell the domain are dropped.
    """
    features = [f for f in features if f not in domain]
    leakage_guard(features)
    base = materialise(frame.withColumn("fold", F.when(train_on, F.lit(1)).otherwise(F.lit(0))).withColumn("label", F.col(label).cast("double")), "holdout")
    train = base.filter("fold = 1")
    return Fitted(tallied(train, features, kind), features, kind, scaling(train, features, "label").collect()).score(base.filter("fold = 0"))


def shuffled(frame: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """frame with a column's values dealt anew among rows, in the order of a hash: for permutation importance."""
    deal = lambda rows, s: order.numbered(rows.withColumn("__h", _digest(s, key)), F.col("__h"), F.col(key), name="__i").drop("__h")
    a, b = deal(frame, -seed - 1), deal(frame.select(key, F.col(column).alias("__v")), seed).select("__i", "__v")
    return a.join(b, "__i").drop("__i", column).withColumnRenamed("__v", column)


def importances(frame: DataFrame, features: list[str], label: str, seed: int = 42) -> list[tuple[str, float]]:
    """A forest's feature importances."""
    base = materialise(frame.select(F.col(label).cast("double").alias("label"), *features), "importances")
    fitted = Fitted(base, features, "forest", scaling(base, features, "label").collect(), seed)
    return sorted(zip(features, map(float, fitted.model.featureImportances.toArray()), strict=True), key=lambda x: -x[1])


def permutation_importance(frame: DataFrame, features: list[str], label: str, key: str, repeats: int = 10, seed: int = 42, k: int = 0) -> list[tuple[str, float, float]]:
    """feature, mean and deviation of the loss of AUC when a feature's values are dealt anew, most first.

    For a forest fitted on the whole frame, or with k folds (of the frame's fold) for forests on the rest, each by its
    own fold.
    """
    leakage_guard(features)
    keep = ["label", key, *features, *(["fold"] if k else [])]
    base = materialise(frame.withColumn("label", F.col(label).cast("double")).select(*keep), "permutation")
    losses: dict[str, list[float]] = {f: [] for f in features}
    for fold in range(k or 1):
        train, test = (base.filter(F.col("fold") != fold), base.filter(F.col("fold") == fold)) if k else (base, base)
        fitted = Fitted(train.select("label", *features), features, "forest", scaling(train, features, "label").collect(), seed)
        area = lambda d, fitted=fitted: auc(fitted.score(d), "probability", "label").first()["auc"]
        whole = area(test)
        for f in features:
            losses[f] += [(whole or 0.0) - (area(shuffled(test, f, key, seed + r)) or 0.0) for r in range(repeats)]
    found = [(f, sum(x) / len(x), (sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x)) ** 0.5) for f, x in losses.items()]
    return sorted(found, key=lambda x: -x[1])


def verdict(area: float, abort: float = 0.60, warn: float = 0.65, go: float = 0.70) -> str:
    """NO-GO below abort, WARNING below warn, CONDITIONAL below go, else GO."""
    return "NO-GO" if area < abort else "WARNING" if area < warn else "CONDITIONAL" if area < go else "GO"
