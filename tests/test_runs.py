"""From JSONL run records to the tables of an attribution."""

import json

import pytest
from pyspark.sql import functions as F

from tokenlab.operators import integrity
from tokenlab.plans import runs
from tokenlab.sources import records


def record(pid, base_seed, cap, texts, mode=None):
    import hashlib

    seed = lambda i: int.from_bytes(hashlib.sha256(f"{base_seed}\0{pid}\0{i}".encode()).digest()[:8], "big")
    chains = [{"text": " ".join(map(str, ids[:cap])), "token_count": min(len(ids), cap), "finish_reason": "length" if len(ids) > cap else "stop", "chain_index": i, "request_seed": seed(i), "token_ids": ids[:cap]} for i, ids in enumerate(texts)]
    policy = {"base_seed": base_seed, "mode": "per_problem_per_chain_sha256"}
    budget = {"max_new_tokens": cap, "n_chains": len(texts), "temperature": 0.5, "top_p": 0.9, "mode": mode, "seed_policy": policy, "run_signature": {"model": "m", "store_token_ids": True}}
    return {"problem_id": pid, "dataset": "gsm8k", "question": "q", "answer": "#### 3", "math_level": 1, "chains": chains, "budget": budget}


@pytest.fixture
def paths(tmp_path):
    """p1: wrong in a, right once extended. p2: right everywhere. p3: right in a, wrong in b and c."""
    a = [record("p1", 1, 2, [[1], [1]]), record("p2", 1, 2, [[3], [3]]), record("p3", 1, 2, [[3], [3]])]
    c = [record("p1", 2, 4, [[1, 1, 3], [2, 2, 3]]), record("p2", 2, 4, [[3], [3]]), record("p3", 2, 4, [[4], [4]])]
    out = {}
    for k, rows in (("a", a), ("c", c)):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        out[k] = str(tmp_path / f"{k}.jsonl")
    return out


def test_whole_analysis_from_files(spark, paths, tmp_path):
    runs.main(["three-arm", "--a", paths["a"], "--c", paths["c"], "--base-cap", "2", "--long-cap", "4", "--out", str(tmp_path / "out")])
    rows = {(r["dataset"], r["definition"]): r for r in records.read_csv(spark, str(tmp_path / "out/three_arm_summary")).collect()}
    one = rows["all", "strict_all_wrong"]
    assert (one["n_problems"], one["n_eligible"], one["samecap_repair_count"], one["long_repair_count"], one["incremental_helpful_count"]) == ("3", "1", "0", "1", "1")
    harm = {(r["dataset"], r["contrast"], r["definition"]): r for r in records.read_csv(spark, str(tmp_path / "out/three_arm_harm_summary")).collect()}
    assert harm["all", "A_to_B_resampling", "complete_plurality_correct"]["harm_count"] == "1" and harm["all", "B_to_C_tokens", "complete_plurality_correct"]["harm_count"] == "0"


def test_checkpoint_gives_the_same_and_reconstruction_is_a_prefix(spark, paths, tmp_path):
    a, c = (records.read_jsonl(spark, paths[k]) for k in "ac")
    spelled = lambda ids: F.concat(F.array_join(ids.cast("array<string>"), " "), F.lit("�"))
    b = runs.reconstruct(c, 2, spelled)
    assert integrity.protocol_violations(a, b, c, 2, 4).count() == 0
    assert b.filter("problem_id = 'p1'").first()["chains"][0]["text"] == "1 1"
    key = lambda d: sorted(map(str, d.collect()))
    plain = runs.three_arm(a, b, c, 2, 4)
    for _ in range(2):
        kept = runs.three_arm(a, b, c, 2, 4, str(tmp_path / "point"))
        assert all(key(plain[k]) == key(kept[k]) for k in plain)


def test_a_broken_protocol_stops_it(spark, paths):
    a, c = (records.read_jsonl(spark, paths[k]) for k in "ac")
    with pytest.raises(ValueError, match="protocol"):
        runs.three_arm(c, runs.reconstruct(c, 2, lambda ids: ids.cast("string")), c, 2, 4)


def test_problems_without_chains_vote_false(spark, paths):
    run = records.read_jsonl(spark, paths["a"]).withColumn("chains", F.when(F.col("problem_id") == "p1", F.array().cast(records.RUN["chains"].dataType)).otherwise(F.col("chains")))
    got = {r["problem_id"]: len(r["chains"]) for r in runs.scored(run, 2).collect()}
    assert got == {"p1": 0, "p2": 2, "p3": 2}
