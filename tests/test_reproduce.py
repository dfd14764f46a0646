"""Manifests of folders of runs, and checks before a run."""

import hashlib
import json

from pyspark.sql import functions as F

from tokenlab.sources import records, reproduce


def run_file(folder, name, seeds, budget, n=1):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"problem_id": f"p{i}", "chains": [{"request_seed": s} for s in seeds], "budget": budget}) + "\n" for i in range(n)))


def test_manifest_tells_of_the_requested_folder_only(spark, tmp_path):
    policy = {"mode": "per_problem_per_chain_sha256"}
    root = tmp_path / "requested"
    run_file(root / "model", "inference_test.jsonl", [7, 7, 9], {"seed_policy": policy})
    run_file(root / "other", "inference_more.jsonl", [2**63 + 1], {"max_new_tokens": 5, "seed_policy": policy, "run_signature": {"model": "m"}}, 2)
    run_file(root / "old", "inference_old.jsonl", [None], None)
    run_file(tmp_path / "elsewhere/model", "inference_other.jsonl", [1], {"seed_policy": {"mode": "wrong"}})
    (root / "notes.txt").write_text("one\n")
    out = str(root / reproduce.OWN)
    for _ in range(2):  # its own file is left out
        made = reproduce.reproducibility(spark, str(root), {"a": 1}, out, ("pyspark", "no-such-package"))
    assert [f["path"] for f in made["files"]] == ["model/inference_test.jsonl", "notes.txt", "old/inference_old.jsonl", "other/inference_more.jsonl"]
    assert made["files"][1]["sha256"] == hashlib.sha256(b"one\n").hexdigest() and made["packages"]["no-such-package"] == "not_installed" and made["packages"]["pyspark"] != "not_installed"
    one, more, old = (made["runs"][k] for k in ("model/inference_test.jsonl", "other/inference_more.jsonl", "old/inference_old.jsonl"))
    assert (one["n_duplicate_assignments"], one["max_seed_multiplicity"], one["n_seeds"]) == (1, 2, 3) and one["run_signatures"] == [reproduce.UNRECORDED]
    assert json.loads(one["seed_policies"][0])["mode"] == policy["mode"] and json.loads(one["budgets"][0])["seed_policy"]["mode"] == policy["mode"]
    assert (more["n_records"], more["n_duplicate_assignments"]) == (2, 1) and json.loads(more["run_signatures"][0])["model"] == "m"
    assert (old["n_seeds"], old["budgets"]) == (0, [reproduce.UNRECORDED]) and made["seed_policy_modes"] == [reproduce.UNRECORDED, policy["mode"]]
    assert json.loads((root / reproduce.OWN).read_text())["runs"].keys() == made["runs"].keys()


def test_a_file_that_mixes_budgets_shows_both(spark, tmp_path):
    folder = tmp_path / "m"
    run_file(folder, "inference_a.jsonl", [1], {"max_new_tokens": 5})
    text = (folder / "inference_a.jsonl").read_text()
    (folder / "inference_a.jsonl").write_text(text + text.replace("5", "6"))
    assert len(reproduce.run_files(spark, str(tmp_path)).first()["budgets"]) == 2


CONFIG = {"inference": {"budgets": {"short": {"max_new_tokens": 10, "n_chains": 2}, "long": {"max_new_tokens": 20, "n_chains": 2}}, "max_model_len": 40, "store_token_ids": True}, "dataset": {"gsm8k": {"n_samples": 3}, "math": {"levels": [1, 2], "n_per_level": 1}}}


def problems(spark, extra=()):
    rows = [(f"g{i}", "gsm8k", "what is it", "#### 1") for i in range(3)] + [(f"m{i}", "math", "what", "1") for i in range(2)] + list(extra)
    return spark.createDataFrame(rows, "problem_id string, dataset string, question string, answer string")


def test_nothing_stands_in_the_way(spark):
    p = problems(spark)
    run = p.withColumn("chains", F.array(F.lit(1), F.lit(2)))
    words = lambda q: F.size(F.split(q, " "))
    assert reproduce.preflight(spark, CONFIG, p, {"short": run}, words) == [] and reproduce.preflight(spark, CONFIG) == []


def test_each_fault_is_told(spark):
    p = problems(spark, [("g0", "gsm8k", " ", "#### 1"), ("x", "aime", "q " * 30, None)])
    run = problems(spark).filter("problem_id <> 'm1'").withColumn("answer", F.when(F.col("problem_id") == "g1", "other").otherwise(F.col("answer"))).withColumn("chains", F.when(F.col("problem_id") == "g2", F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))))
    bad = {"inference": {"budgets": {"short": {"max_new_tokens": 10, "n_chains": 0}, "long": {"max_new_tokens": 50, "n_chains": 2}}, "max_model_len": 40}, "dataset": {"gsm8k": 3}}
    told = " | ".join(reproduce.preflight(spark, bad, p, {"long": run}, lambda q: F.size(F.split(q, " "))))
    for said in ("store_token_ids", "long: max_new_tokens leaves no room", "short: n_chains must be positive", "1 problems without an id", "2 problems with empty", "exceed max_model_len", "gsm8k: 4 problems, 3 expected", "long: its problems differ", "long: 2 records tell another", "long: 1 records have too few chains"):
        assert said in told, (said, told)
    assert records.RUN["chains"] is not None
