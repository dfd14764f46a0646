"""Rules over run records as tables of violations: one row per rule and record, empty if all holds."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import request_seed
from ..sources.records import canonical


def canonical_dict(value: dict) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule for every rule that a row breaks; a rule that comes to null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def require_none(found: DataFrame, what: str) -> None:
    if bad := found.limit(5).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in bad]}")


def valid_chain(chain: Column, index: Column, problem: Column, budget: Column) -> Column:
    """Whether a stored chain can be used again: text, tokens within the cap, place, ending, ids, seed by policy."""
    policy = budget["seed_policy"]
    ids = chain["token_ids"]
    seed = (
        F.when(policy["mode"] == "per_problem_per_chain_sha256", chain["request_seed"] == request_seed(policy["base_seed"], problem, index))
        .when(policy["mode"] == "per_request_single_chain", chain["request_seed"].eqNullSafe(policy["request_seed"]))
        .when(policy["mode"] == "engine_only_multi_sample", chain["request_seed"].isNull())
        .otherwise(False)
    )
    with_ids = F.when(ids.isNull(), ~F.coalesce(budget["run_signature"]["store_token_ids"], F.lit(False))).otherwise((F.size(ids) == chain["token_count"]) & F.forall(ids, lambda x: x.isNotNull()))
    ok = chain["text"].isNotNull() & chain["token_count"].between(0, budget["max_new_tokens"]) & (chain["chain_index"] == index) & chain["finish_reason"].isin("stop", "length") & with_ids & seed
    return F.coalesce(ok, F.lit(False))


def record_rules() -> dict[str, Column]:
    """Structure of one run record."""
    chains, budget = F.col("chains"), F.col("budget")
    each = F.forall(F.transform(chains, lambda c, i: valid_chain(c, i, F.col("problem_id"), budget)), lambda x: x)
    return {
        "id": F.col("problem_id").isNotNull(), "question": F.col("question").isNotNull(), "answer": F.col("answer").isNotNull(),
        "chain_count": F.size(chains) == budget["n_chains"], "chains": each, "run_signature": budget["run_signature"].isNotNull() & budget["run_signature"]["model"].isNotNull(),
    }


#: What a run's signature has to tell.
REQUIRED_SIGNATURE = ("model", "model_snapshot_sha256", "runtime_versions", "prompt_template", "prompt_sha256")


def resume(lines: DataFrame, problems: DataFrame, budget: dict, policy: dict, signature: dict) -> tuple[DataFrame, DataFrame]:
    """Completed records that a resumed run may keep, and what became of all lines.

    lines: as of records.numbered_lines with the run schema. A line counts if it can be read and holds all rules: the
    number of chains, the budget's caps and decoding, the seed policy, the run signature, the problem's data set,
    question, answer and level, and every chain's own (valid_chain). Of several valid lines of a problem the last one
    stays, with the problem's order (column position of problems). The second table counts lines by rule: malformed,
    each rule first broken, and valid.
    """
    r = F.col("r")
    own, told = r["budget"], problems.select(F.col("problem_id").alias("__id"), "position", F.struct("dataset", "question", "answer", F.coalesce("math_level", F.lit(0)).alias("math_level")).alias("told"))
    rows = lines.join(told, r["problem_id"] == F.col("__id"), "left")
    same = lambda c, v: c.isNull() if v is None else F.coalesce(c == F.lit(v), F.lit(False))
    every = lambda conditions: F.array_min(F.array(*conditions)) if conditions else F.lit(True)
    parsed = F.from_json(F.lit(canonical_dict(signature)), lines.schema["r"].dataType["budget"].dataType["run_signature"].dataType)
    fields = {k: parsed[k] for k in signature}
    each = F.forall(F.transform(r["chains"], lambda c, i: valid_chain(c, i, r["problem_id"], own)), lambda x: x)
    rules = {
        "malformed": r["_corrupt_record"].isNull() & r["problem_id"].isNotNull(),
        "chain_count": F.coalesce(F.size(r["chains"]), F.lit(0)) == budget["n_chains"],
        "budget": every([same(own[k], budget.get(k)) for k in ("max_new_tokens", "n_chains", "temperature", "top_p", "seed")]),
        "seed_policy": every([same(own["seed_policy"][k], policy.get(k)) for k in ("engine_seed", "request_seed", "base_seed", "mode")]),
        "signature": every([canonical(F.struct(own["run_signature"][k].alias("v"))).eqNullSafe(canonical(F.struct(v.alias("v")))) for k, v in fields.items()]),
        "problem": F.col("told").isNotNull() & F.struct(r["dataset"], r["question"], r["answer"], F.coalesce(r["math_level"], F.lit(0))).eqNullSafe(F.col("told")),
        "chains": F.coalesce(each, F.lit(False)),
    }
    broken = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()], F.lit("valid"))
    judged = rows.withColumn("outcome", broken)
    last = Window.partitionBy("__id").orderBy(F.col("file").desc(), F.col("at").desc())
    kept = judged.filter("outcome = 'valid'").withColumn("__k", F.row_number().over(last)).filter("__k = 1")
    fields = [f for f in lines.schema["r"].dataType.names if f != "_corrupt_record"]
    return kept.select("position", *[r[f].alias(f) for f in fields]), judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def file_rules(lines: DataFrame) -> dict[str, Column]:
    """Rules of one record in a file of a rerun, beyond record_rules: readable, a whole signature, chains in order."""
    chains, budget = F.col("chains"), F.col("budget")
    order = F.transform(chains, lambda c: c["chain_index"].cast("int"))
    policy = budget["seed_policy"]["mode"]
    seeds = F.transform(chains, lambda c: c["request_seed"])
    return record_rules() | {
        "signature_fields": F.array_min(F.array(*[budget["run_signature"][k].isNotNull() for k in REQUIRED_SIGNATURE])),
        "chain_indexes": order == F.when(F.size(chains) > 0, F.sequence(F.lit(0), F.size(chains) - 1)).otherwise(F.array().cast("array<int>")),
        "unique_seeds": F.when(policy == "per_problem_per_chain_sha256", F.size(F.array_distinct(seeds)) == F.size(chains)).otherwise(policy.isin("per_request_single_chain", "engine_only_multi_sample")),
    }


def validate_files(runs: dict[str, DataFrame], expected_rows: int | None = None) -> DataFrame:
    """file, key and rule for whatever is wrong with the record files of a rerun; empty if all holds.

    Per record: file_rules. Per file: repeated ids, more than one budget, another number of rows than expected.
    Across files: a problem with other data set, question, answer or level.
    """
    found, told = [], []
    for name, run in runs.items():
        own = F.lit(name).alias("file")
        found.append(violations(run, "problem_id", file_rules(run)).select(own, F.col("problem_id").cast("string").alias("key"), "rule"))
        found.append(run.groupBy("problem_id").count().filter("count > 1").select(own, F.col("problem_id").cast("string").alias("key"), F.lit("duplicate_id").alias("rule")))
        b = F.col("budget")
        signature = F.struct(*[b[k].alias(k) for k in ("max_new_tokens", "n_chains", "temperature", "top_p", "seed_policy", "mode", "deterministic_sampling", "run_signature")])
        sums = run.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(canonical(signature)).alias("budgets"))
        if expected_rows is not None:
            found.append(sums.filter(F.col("n") != expected_rows).select(own, F.col("n").cast("string").alias("key"), F.lit("row_count").alias("rule")))
        found.append(sums.filter("budgets > 1").select(own, F.col("budgets").cast("string").alias("key"), F.lit("budget_differs").alias("rule")))
        told.append(run.select(own, "problem_id", F.struct("dataset", "question", "answer", F.coalesce("math_level", F.lit(0)).alias("math_level")).alias("told")))
    every = reduce(DataFrame.unionByName, told)
    odd = every.groupBy("problem_id").agg(F.count_distinct(canonical(F.col("told"))).alias("n")).filter("n > 1")
    found.append(odd.select(F.lit("*").alias("file"), F.col("problem_id").cast("string").alias("key"), F.lit("metadata_differs").alias("rule")))
    return reduce(DataFrame.unionByName, found)


def same_frames(frames: dict[str, DataFrame], *keys: str, value: str = "dataset") -> DataFrame:
    """seed, key and rule where seeds' tables differ: repeated keys, keys that a seed lacks, another data set."""
    n = len(frames)
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(label).alias("seed"), F.to_json(F.struct(*keys)).alias("key"), F.col(value).alias("v")) for label, d in frames.items()])
    per = rows.groupBy("key", "seed").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("v"))
    whole = per.groupBy("key").agg(F.count(F.lit(1)).alias("seeds"), (F.count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("kinds"))
    return per.filter("m > 1").select("seed", "key", F.lit("duplicate").alias("rule")).unionByName(whole.filter(F.col("seeds") < n).select(F.lit("*").alias("seed"), "key", F.lit("missing").alias("rule"))).unionByName(whole.filter("kinds > 1").select(F.lit("*").alias("seed"), "key", F.lit(f"{value}_differs").alias("rule")))


def bind_models(signatures: dict[str, list[dict]], expected: dict[str, str] | None = None) -> dict[str, dict]:
    """The one signature of each model's runs; fails if runs of a model differ, if the model is not the expected one
    (by the last part of its path), or if two models are the same snapshot."""
    out, seen = {}, {}
    for model, found in signatures.items():
        kinds = {canonical_dict(s): s for s in found}
        if len(kinds) != 1:
            raise ValueError(f"runs of {model} have {len(kinds)} signatures")
        (one,) = kinds.values()
        name = one["model"].rstrip("/").rpartition("/")[2]
        if expected and expected.get(model, name) != name:
            raise ValueError(f"the folder of {model} holds runs of {name}")
        if (other := seen.setdefault(one["model_snapshot_sha256"], model)) != model:
            raise ValueError(f"{model} and {other} are the same model")
        out[model] = one
    return out


def decoding(budget: Column) -> Column:
    """What has to agree for runs to be comparable."""
    return F.struct(budget["temperature"].alias("temperature"), budget["top_p"].alias("top_p"), budget["n_chains"].alias("n_chains"), canonical(budget["run_signature"]).alias("signature"))


def three_arms(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """One row per id with the three records, null where an arm lacks it."""
    pack = lambda d, n: d.select("problem_id", F.struct(*d.columns).alias(n))
    return pack(a, "a").join(pack(b, "b"), "problem_id", "full").join(pack(c, "c"), "problem_id", "full")


def protocol_violations(a: DataFrame, b: DataFrame, c: DataFrame, base_cap: int, long_cap: int) -> DataFrame:
    """That a is independent and b is the exact token prefix of c, rule by rule."""
    if not 0 < base_cap < long_cap:
        raise ValueError("0 < base_cap < long_cap")
    x, y, z = F.col("a"), F.col("b"), F.col("c")
    seeds = lambda r: F.transform(r["chains"], lambda ch: ch["request_seed"])
    check = F.col("__pairs")
    rules = {
        "ids": x.isNotNull() & y.isNotNull() & z.isNotNull(),
        **{f: x[f].eqNullSafe(y[f]) & x[f].eqNullSafe(z[f]) for f in ("dataset", "question", "answer")},
        "caps": (x["budget"]["max_new_tokens"] == base_cap) & (y["budget"]["max_new_tokens"] == base_cap) & (z["budget"]["max_new_tokens"] == long_cap),
        "chain_counts": (F.size(x["chains"]) == x["budget"]["n_chains"]) & (F.size(y["chains"]) == y["budget"]["n_chains"]) & (F.size(z["chains"]) == z["budget"]["n_chains"]),
        "decoding": (decoding(x["budget"]) == decoding(y["budget"])) & (decoding(y["budget"]) == decoding(z["budget"])),
        "declared_prefix": (y["budget"]["mode"] == "reconstructed_token_prefix") & (y["budget"]["reconstructed_from"]["source_cap"] == long_cap),
        "seed_policy": canonical(y["budget"]["seed_policy"]) == canonical(z["budget"]["seed_policy"]),
        "independent_seed": x["budget"]["seed_policy"]["base_seed"] != z["budget"]["seed_policy"]["base_seed"],
        "disjoint_seeds": F.forall(seeds(x), lambda s: s.isNotNull()) & F.forall(seeds(z), lambda s: s.isNotNull()) & ~F.arrays_overlap(seeds(x), seeds(z)),
        "exact_prefix": F.forall(check, lambda t: F.coalesce(F.slice(t["q"]["token_ids"], 1, base_cap) == t["p"]["token_ids"], F.lit(False))),
        "token_counts": F.forall(check, lambda t: F.coalesce((t["p"]["token_count"] == F.size(t["p"]["token_ids"])) & (t["q"]["token_count"] == F.size(t["q"]["token_ids"])), F.lit(False))),
        "chain_identity": F.forall(check, lambda t: t["p"]["chain_index"].eqNullSafe(t["q"]["chain_index"]) & t["p"]["request_seed"].eqNullSafe(t["q"]["request_seed"])),
    }
    # What no rule compares, texts above all, stays out of the shuffle.
    compared = lambda d: d.select("problem_id", "dataset", "question", "answer", "budget", F.transform("chains", lambda ch: F.struct(*[ch[f].alias(f) for f in ("token_count", "chain_index", "request_seed", "token_ids")])).alias("chains"))
    rows = three_arms(compared(a), compared(b), compared(c)).withColumn("__pairs", F.zip_with("b.chains", "c.chains", lambda m, n: F.struct(m.alias("p"), n.alias("q"))))
    return violations(rows, "problem_id", rules)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that come more than once; conflicting: their rows differ.

    Rows differ if their least and greatest hashes do: one aggregation by the keys, with two numbers for each.
    """
    digest = F.xxhash64(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.min(digest) < F.max(digest)).alias("conflicting")).filter("n > 1")


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def collisions(rows: DataFrame, seed: str, *by: str) -> DataFrame:
    """n, distinct, duplicates and highest multiplicity of seeds; seeds are counted first, so a common one does no harm."""
    counts = rows.groupBy(*by, seed).agg(F.count(F.lit(1)).alias("m"))
    return counts.groupBy(*by).agg(F.sum("m").alias("n"), F.count(seed).alias("n_unique"), F.max("m").alias("max_multiplicity")).withColumn("n_duplicate", F.col("n") - F.col("n_unique"))


def resume_todo(problems: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return problems.join(done.select(key).distinct(), key, "left_anti")


def relabel_counts(old: DataFrame, new: DataFrame, keys: list[str], label: str) -> DataFrame:
    """How often a recomputed label differs from the stored one; ids that one side lacks are counted apart."""
    both = old.select(*keys, F.col(label).alias("old"), F.lit(1).alias("l")).join(new.select(*keys, F.col(label).alias("new"), F.lit(1).alias("r")), keys, "full")
    inside = F.col("l").isNotNull() & F.col("r").isNotNull()
    return both.agg(F.count_if(inside).alias("n"), F.count_if(inside & ~F.col("old").eqNullSafe(F.col("new"))).alias("n_changed"), F.count_if(inside & F.col("old").isNull() & F.col("new").isNotNull()).alias("n_filled"), F.count_if(~inside).alias("n_unmatched"))


def budget_audit(chains: DataFrame, cap: int, *by: str) -> DataFrame:
    """Tokens against a cap."""
    return chains.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.max("token_count").alias("max_tokens"), F.round(F.avg((~F.col("complete")).cast("int")), 6).alias("hit_max_fraction"), F.count_if(F.col("token_count") > cap).alias("over_max_count"))


def continuation_violations(source: DataFrame, resumed: DataFrame, base_cap: int, long_cap: int) -> DataFrame:
    """That a resumed run begins with its source and counts its tokens."""
    x, y, m = F.col("s.chains")[0], F.col("r.chains")[0], F.col("r.resume")
    rows = source.select("problem_id", F.struct(*source.columns).alias("s")).join(resumed.select("problem_id", F.struct(*resumed.columns).alias("r")), "problem_id", "full")
    cut = x["finish_reason"] == "length"
    return violations(
        rows,
        "problem_id",
        {
            "ids": F.col("s").isNotNull() & F.col("r").isNotNull(), "continued_if_cut": m["continued"] == cut, "text_begins": F.startswith(y["text"], x["text"]), "medium_tokens": m["medium_tokens"] == x["token_count"],
            "total_tokens": y["token_count"] == m["medium_tokens"] + m["continuation_tokens"], "caps": (x["token_count"] <= base_cap) & (y["token_count"] <= long_cap), "unchanged_if_complete": cut | (x["text"] == y["text"]),
        },
    )

