"""Evaluation of routers between a base and an extended run: by cap hits and by learned scores, with a summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise
from . import learn, routing
from .attribution import rate

#: Features of routing.router_features that routers learn from.
ROUTER_FEATURES = ("cap_hits", "cap_hit_fraction", "max_tokens", "mean_tokens", "min_tokens", "std_tokens", "boxed_fraction", "question_chars", "math_level", "is_math")


def evaluate(frame: DataFrame, base_cap: int, long_cap: int, features: tuple[str, ...] = ROUTER_FEATURES, key: str = "record_id", group: str = "problem_id", fractions: tuple[float, ...] = routing.FRACTIONS, seed: int = 42, kinds: tuple[str, ...] = ("logistic", "forest")) -> tuple[DataFrame, DataFrame]:
    """The curve, a row per method and share routed, and a summary of one row.

    frame: key (unique), group, base_ok, long_ok and the features, of which cap_hits and max_tokens are needed. Methods:
    fixed_base, fixed_extended, route_every_cap_hit, random (its expectation), cap_hit_rank (cap hits, then tokens),
    and learned_logistic and learned_forest: scores out of folds by group, ties by cap hits; 0 for all, and the summary
    says so, where a class has fewer groups than folds. The first rows of a rank are routed, ceil(share * n) of them.
    A record that no cap cut has to be the same in both runs; others are an error.
    """
    base = materialise(frame.select(key, group, "base_ok", "long_ok", *[F.col(f).cast("double").alias(f) for f in features]).withColumn("flips", (~F.col("base_ok") & F.col("long_ok")).cast("int")), "routes")
    odd = base.filter("cap_hits = 0 and base_ok <> long_ok").limit(5).collect()
    if odd:
        raise ValueError(f"records that no cap cut differ between the runs: {[r[key] for r in odd]}")
    ranks = {"cap_hit_rank": routing.ranked(base, "cap_hits", "max_tokens", key)}
    fitted = True
    for kind in kinds:
        # Ties need the cap hits, which are a feature too.
        scored, ok = learn.grouped_scores(base.withColumn("tie", F.col("cap_hits")), list(features), "flips", group, kind, seed=seed)
        fitted &= ok
        ranks[f"learned_{kind}"] = routing.ranked(materialise(scored.select(key, "base_ok", "long_ok", "tie", "probability"), "scores"), "probability", "tie", key)
    curves = [(name, routing.top_fraction_curve(r, "base_ok", "long_ok", fractions)) for name, r in ranks.items()]
    shown = [c.select(F.lit(name).alias("method"), F.col("fraction").alias("route_fraction"), "accuracy", "gain_vs_random") for name, c in curves]
    shown.append(curves[0][1].select(F.lit("random").alias("method"), F.col("fraction").alias("route_fraction"), F.col("random_accuracy").alias("accuracy"), F.lit(0.0).alias("gain_vs_random")))
    n, hit, none = F.count(F.lit(1)), F.col("cap_hits") > 0, F.lit(None).cast("double")
    rows = [("fixed_base", F.lit(0.0), F.count_if("base_ok")), ("fixed_extended", F.lit(1.0), F.count_if("long_ok")), ("route_every_cap_hit", F.count_if(hit).cast("double") / n, F.count_if(F.when(hit, F.col("long_ok")).otherwise(F.col("base_ok"))))]
    fixed = base.agg(F.array(*[F.struct(F.lit(k).alias("method"), f.alias("route_fraction"), rate(ok, n).alias("accuracy"), none.alias("gain_vs_random")) for k, f, ok in rows]).alias("r"))
    shown.append(fixed.select(F.explode("r").alias("r")).select("r.*"))
    curve = reduce(DataFrame.unionByName, shown)
    cost = routing.costs(F.col("route_fraction"), base_cap, long_cap)
    curve = curve.select("method", F.round("route_fraction", 6).alias("route_fraction"), "accuracy", "gain_vs_random", cost["resume_saving"].alias("resume_saving"), cost["rerun_saving"].alias("rerun_saving"))
    gain = F.count_if("long_ok") - F.count_if("base_ok")
    summary = base.agg(
        n.alias("n_records"), rate(F.count_if("base_ok"), n).alias("base_accuracy"), rate(F.count_if("long_ok"), n).alias("extended_accuracy"), rate(F.count_if(hit), n).alias("cap_hit_fraction"), F.sum("flips").alias("n_routable_flips"),
        F.count_if(F.col("base_ok") & ~F.col("long_ok")).alias("n_routable_reversals"), rate(gain, n).alias("fixed_long_gain"), F.lit(fitted).alias("learned_router_fitted"),
    )
    return curve, summary
