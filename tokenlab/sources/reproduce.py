"""What a folder of runs was made with, and whether data and configuration fit before anything runs."""

from __future__ import annotations

import json
import platform
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from . import files, records

#: What is told of a run that recorded nothing.
UNRECORDED = "legacy_or_unrecorded"
PACKAGES = ("pyspark", "pyarrow", "numpy", "pandas")
#: Files of the manifest itself, which it leaves out.
OWN = "reproducibility_manifest.json"


def packages(names: tuple[str, ...] = PACKAGES) -> dict[str, str]:
    def version(name: str) -> str:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return "not_installed"

    return {n: version(n) for n in names}


def run_files(spark: SparkSession, root: str, glob: str = "inference_*.jsonl") -> DataFrame:
    """A row for each run file below root: path, n_records, what all its records tell of budgets, seed policies and run
    signatures (distinct JSON texts, UNRECORDED for none), and its request seeds: n_seeds, n_unique,
    n_duplicate_assignments, max_seed_multiplicity.

    All records are read, not the first alone: a file that mixes budgets shows more than one. A seed's occurrences are
    counted before they meet by file, so a common one does no harm. A malformed line fails.
    """
    reader = spark.read.schema(records.RUN).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    rows = reader.json(root).select(F.col("_metadata.file_path").alias("path"), "budget", F.transform(F.coalesce("chains", F.array().cast(records.RUN["chains"].dataType)), lambda c: c["request_seed"]).alias("seeds"))
    told = lambda c: F.sort_array(F.collect_set(F.coalesce(F.to_json(c), F.lit(UNRECORDED))))
    b = F.col("budget")
    each = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_records"), told(b).alias("budgets"), told(b["seed_policy"]).alias("seed_policies"), told(b["run_signature"]).alias("run_signatures"))
    seeds = integrity.collisions(rows.select("path", F.explode("seeds").alias("seed")).filter("seed is not null"), "seed", "path")
    seeds = seeds.select("path", F.col("n").alias("n_seeds"), "n_unique", F.col("n_duplicate").alias("n_duplicate_assignments"), F.col("max_multiplicity").alias("max_seed_multiplicity"))
    return each.join(seeds, "path", "left").na.fill(0, ["n_seeds", "n_unique", "n_duplicate_assignments", "max_seed_multiplicity"])


def reproducibility(spark: SparkSession, root: str, configuration: dict | None = None, out: str | None = None, names: tuple[str, ...] = PACKAGES) -> dict:
    """Manifest of a folder: interpreter, platform, packages, configuration, every file below it (path relative to root,
    bytes, lines, sha256), and its run files by relative path. out: also written there as one JSON file.

    Rows that come to the driver are one for each file.
    """
    base = files.listing(spark, root)
    prefix = {path: name for name, path, *_ in base}
    short = lambda p: prefix.get(p) or prefix.get(p.replace("file:///", "file:/")) or p
    artifacts = sorted(({**r.asDict(), "path": short(r["path"])} for r in files.manifest(spark, root).collect()), key=lambda r: r["path"])
    runs = {short(r["path"]): {k: v for k, v in r.asDict().items() if k != "path"} for r in run_files(spark, root).collect()}
    modes = sorted({json.loads(p).get("mode", UNRECORDED) if p != UNRECORDED else p for r in runs.values() for p in r["seed_policies"]})
    made = {"python": platform.python_version(), "platform": platform.platform(), "packages": packages(names), "configuration": configuration or {}, "seed_policy_modes": modes, "files": [a for a in artifacts if not a["path"].endswith(OWN)], "runs": dict(sorted(runs.items()))}
    if out:
        files.write_text(spark, out, json.dumps(made, indent=1, sort_keys=True))
    return made


def preflight(spark: SparkSession, configuration: dict, problems: DataFrame | None = None, runs: dict[str, DataFrame] | None = None, prompt_tokens=None) -> list[str]:
    """What stands in the way of a run, as texts; empty if nothing does.

    configuration: inference.budgets by name (max_new_tokens, n_chains, ...), inference.max_model_len and
    inference.store_token_ids, and dataset: expected rows by data set (an int, or levels and n_per_level, or n_samples).
    problems: the data. Rules: budgets as records.check_budgets has them, caps below the model's length with the longest
    prompt (prompt_tokens: from the question column to its tokens), stored token ids, unique ids, no empty required
    field, as many rows of each data set as told. runs: earlier outputs by budget; each needs the problems' ids, texts
    and answers, and its number of chains in every record, not in a sample.
    """
    found: list[str] = []
    inference = configuration["inference"]
    budgets, longest = inference["budgets"], inference.get("max_model_len")
    try:
        records.check_budgets({k: {"temperature": 0.0, "top_p": 1.0} | b for k, b in budgets.items()})
    except ValueError as e:
        found.append(str(e))
    if not inference.get("store_token_ids", False):
        found.append("inference.store_token_ids must be true, so that lower caps can be reconstructed")
    for name, b in budgets.items():
        if longest is not None and int(b["max_new_tokens"]) >= int(longest):
            found.append(f"{name}: max_new_tokens leaves no room for the prompt within max_model_len ({longest})")
        if int(b["n_chains"]) < 1:
            found.append(f"{name}: n_chains must be positive")
    if problems is None:
        return found
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    tokens = F.max(prompt_tokens(F.col("question"))) if prompt_tokens else F.lit(None).cast("long")
    row = problems.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("problem_id").alias("ids"), F.count_if(empty("problem_id") | empty("question") | empty("answer")).alias("empty"), tokens.alias("tokens")).first()
    if row["n"] != row["ids"]:
        found.append(f"{row['n'] - row['ids']} problems without an id of their own")
    if row["empty"]:
        found.append(f"{row['empty']} problems with empty required fields")
    if row["tokens"] is not None and longest is not None:
        most = max(int(b["max_new_tokens"]) for b in budgets.values())
        if row["tokens"] + most > int(longest):
            found.append(f"the longest prompt ({row['tokens']}) and the largest budget ({most}) exceed max_model_len ({longest})")
    sizes = {r["dataset"]: r["n"] for r in problems.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name, told in configuration.get("dataset", {}).items():
        wanted = told if isinstance(told, int) else told["n_samples"] if "n_samples" in told else len(told["levels"]) * told["n_per_level"]
        if sizes.get(name, 0) != wanted:
            found.append(f"{name}: {sizes.get(name, 0)} problems, {wanted} expected")
    for name, run in (runs or {}).items():
        if odd := integrity.id_differences(problems, run, "problem_id").limit(3).collect():
            found.append(f"{name}: its problems differ from the data: {[r['problem_id'] for r in odd]}")
        both = run.alias("r").join(problems.alias("p"), "problem_id")
        same = F.least(*[F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("dataset", "question", "answer")])
        sums = both.agg(F.count_if(~same).alias("odd"), F.count_if(F.coalesce(F.size("r.chains"), F.lit(0)) < int(budgets[name]["n_chains"])).alias("few")).first()
        if sums["odd"]:
            found.append(f"{name}: {sums['odd']} records tell another data set, question or answer")
        if sums["few"]:
            found.append(f"{name}: {sums['few']} records have too few chains")
    return found
