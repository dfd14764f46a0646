"""Readers, resume, protocol rules, manifests, learning and streams."""

import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlab.functions import answers
from tokenlab.operators import evaluate, forest, integrity, learn, text
from tokenlab.plans import features
from tokenlab.sources import engines, files, generate, records
from tokenlab.streaming import runs


def budget(cap, base_seed, mode=None, source=None):
    policy = {"engine_seed": None, "request_seed": None, "base_seed": base_seed, "mode": "per_problem_per_chain_sha256"}
    return {"max_new_tokens": cap, "n_chains": 2, "temperature": 0.5, "top_p": 0.9, "seed": base_seed, "mode": mode, "seed_policy": policy, "run_signature": {"model": "m", "store_token_ids": True, "runtime_versions": {"python": "3"}}, "reconstructed_from": {"source_name": "long", "source_cap": source}}


def seed(base, pid, i):
    return int.from_bytes(hashlib.sha256(f"{base}\0{pid}\0{i}".encode()).digest()[:8], "big")


def chain(pid, i, base, ids, cap):
    ids = ids[:cap]
    return {"text": "t" * len(ids), "token_count": len(ids), "finish_reason": "length" if len(ids) == cap else "stop", "chain_index": i, "request_seed": seed(base, pid, i), "token_ids": ids}


def record(pid, base, cap, mode=None, source=None, ids=(1, 2, 3)):
    return {"problem_id": pid, "dataset": "gsm8k", "question": "q", "answer": "#### 1", "chains": [chain(pid, i, base, list(ids), cap) for i in range(2)], "budget": budget(cap, base, mode, source)}


def write(path, rows, tail=""):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)
    return str(path)


@pytest.fixture
def arms(spark, tmp_path):
    made = {"a": [record("p1", 1, 2)], "b": [record("p1", 2, 2, "reconstructed_token_prefix", 4)], "c": [record("p1", 2, 4)]}
    return made, lambda: [records.read_jsonl(spark, write(tmp_path / f"{k}.jsonl", v)) for k, v in made.items()]


def test_protocol_holds_and_each_break_is_named(spark, arms):
    made, read = arms
    rules = lambda: {r["rule"] for r in integrity.protocol_violations(*read(), 2, 4).collect()}
    assert rules() == set()
    made["b"][0]["chains"][0]["token_ids"] = [9, 2]
    assert rules() == {"exact_prefix"}
    made["b"] = [record("p1", 2, 2, "reconstructed_token_prefix", 4)]
    made["a"] = [record("p1", 2, 2)]
    assert rules() == {"independent_seed", "disjoint_seeds"}
    made["a"] = [record("p2", 1, 2)]
    assert "ids" in rules()
    with pytest.raises(ValueError):
        integrity.require_none(integrity.protocol_violations(*read(), 2, 4), "protocol")


def test_record_rules(spark, tmp_path):
    good, short, bad = record("p1", 1, 4), record("p2", 1, 4), record("p3", 1, 4)
    short["chains"].pop()
    bad["chains"][1]["request_seed"] = 5
    rows = records.read_jsonl(spark, write(tmp_path / "r.jsonl", [good, short, bad]))
    assert sorted(map(tuple, integrity.violations(rows, "problem_id", integrity.record_rules()).collect())) == [("p2", "chain_count"), ("p3", "chains")]


def test_strict_lenient_and_last_valid(spark, tmp_path):
    rows = [record("p1", 1, 4), record("p1", 1, 4), record("p2", 1, 4)]
    path = write(tmp_path / "r.jsonl", rows, '{"problem_id": "p9", \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parsing"):
        records.read_jsonl(spark, path).collect()
    lenient = records.read_jsonl(spark, path, strict=False)
    assert lenient.count() == 3 and records.malformed(spark, path).count() == 1
    with pytest.raises(ValueError, match="p1"):
        records.require_unique(lenient, "problem_id")
    kept = records.keep_last(lenient, ["problem_id"], [F.monotonically_increasing_id()], F.size("chains") == 2)
    assert sorted(r["problem_id"] for r in kept.collect()) == ["p1", "p2"]


def test_ids_never_intersect_silently(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "problem_id string"), spark.createDataFrame([("y",), ("z",)], "problem_id string")
    with pytest.raises(ValueError):
        records.require_same_ids(a, b, "problem_id")
    assert sorted(map(tuple, integrity.id_differences(a, b, "problem_id").collect())) == [("x", "left"), ("z", "right")]


def test_checkpoint_and_cache(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").alias("problem_id"))
    point = records.Checkpoint(spark, str(tmp_path / "c"), "s1")
    assert point.todo(rows, "problem_id").count() == 5
    point.add(rows.filter("problem_id < 3"))
    assert point.todo(rows, "problem_id").count() == 2
    with pytest.raises(ValueError):
        records.Checkpoint(spark, str(tmp_path / "c"), "s2").done()
    asked = []

    def compute(missing):
        asked.append(missing.count())
        return missing.withColumn("v", F.col("problem_id") * 2)

    for n in (3, 5):
        assert records.cached(spark, rows.filter(f"problem_id < {n}"), ["problem_id"], str(tmp_path / "k"), compute).count() == n
    assert asked == [3, 2]
    assert records.cached(spark, rows.filter("problem_id < 2"), ["problem_id"], str(tmp_path / "k"), compute, version="2").count() == 2 and asked == [3, 2, 2]


def test_writers_of_one_cache_keep_one_row_a_key(spark, tmp_path):
    """A writer that finds others' additions when it commits drops its own repeats; timed-out rows are not kept."""
    rows, path = spark.range(6).select(F.col("id").alias("k")), str(tmp_path / "k")
    value = lambda d, v: d.withColumn("v", F.lit(v)).withColumn("timed_out", F.col("k") == 5)

    def slow(missing):
        # Meanwhile another writer scores keys 2 to 4.
        records.cached(spark, rows.filter("k between 2 and 4"), ["k"], path, lambda d: value(d, 1), settled="not timed_out")
        return value(missing, 2)

    got = {r["k"]: (r["v"], r["timed_out"]) for r in records.cached(spark, rows, ["k"], path, slow, settled="not timed_out").collect()}
    assert got == {0: (2, False), 1: (2, False), 2: (1, False), 3: (1, False), 4: (1, False), 5: (2, True)}
    again = {r["k"]: r["v"] for r in records.cached(spark, rows, ["k"], path, lambda d: value(d, 3).withColumn("timed_out", F.lit(False)), settled="not timed_out").collect()}
    assert again == {0: 2, 1: 2, 2: 1, 3: 1, 4: 1, 5: 3}
    from tokenlab.sources import ledger

    assert ledger.read(spark, f"{path}/1/unsettled", "k long").count() == 1
    stored = spark.read.parquet(*[f"{path}/1/parts/{p['name']}" for own in ledger.manifest(f"{path}/1")["batches"].values() for p in own])
    assert stored.count() == stored.select("k").distinct().count() == 6


def test_manifest_and_tables(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.txt").write_text("one\ntwo\n")
    r = files.manifest(spark, str(tmp_path / "d")).first()
    assert (r["bytes"], r["lines"], r["sha256"]) == (8, 2, hashlib.sha256(b"one\ntwo\n").hexdigest())
    assert records.tree_digest(files.manifest(spark, str(tmp_path / "d"))).first()["files"] == 1
    rows = spark.createDataFrame([("a", True, 1.0)], "k string, f boolean, x double")
    for kind in ("csv", "json", "parquet"):
        records.write_table(rows, str(tmp_path / kind), kind)
    back = records.read_csv(spark, str(tmp_path / "csv"))
    assert back.select(records.text_flag(F.col("f"))).first()[0] is True and records.select_one(back, k="a")["x"] == "1.0"
    with pytest.raises(ValueError):
        records.select_one(back, k="b")
    assert records.markdown([{"k": "a", "x": 0.0625}], ["k", "x"]).endswith("| a | 0.062 |")


def test_large_files_stream_and_snapshots_are_cached(spark, tmp_path, monkeypatch):
    (tmp_path / "m/sub").mkdir(parents=True)
    (tmp_path / "m/b.bin").write_bytes(bytes(range(256)) * 5000 + b"tail")
    (tmp_path / "m/sub/a.txt").write_text("one\ntwo\n")
    small = sorted(map(tuple, files.manifest(spark, str(tmp_path / "m")).collect()))
    monkeypatch.setattr(files, "WHOLE", 3)
    monkeypatch.setattr(files, "BLOCK", 1000)
    assert sorted(map(tuple, files.manifest(spark, str(tmp_path / "m")).collect())) == small
    want = hashlib.sha256(b"b.bin\0" + (tmp_path / "m/b.bin").read_bytes() + b"sub/a.txt\0one\ntwo\n").hexdigest()
    cache = str(tmp_path / "cache")
    assert files.snapshot_sha256(spark, str(tmp_path / "m"), cache) == want
    monkeypatch.setattr(files, "_feed", lambda *a: pytest.fail("read again"))
    assert files.snapshot_sha256(spark, str(tmp_path / "m"), cache) == want
    monkeypatch.undo()
    (tmp_path / "m/sub/a.txt").write_text("one\ntwo")
    assert files.snapshot_sha256(spark, str(tmp_path / "m"), cache) != want
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        files.snapshot_sha256(spark, str(tmp_path / "none"))
    feed = files._feed
    monkeypatch.setattr(files, "_feed", lambda s, p, d: (feed(s, p, d), (tmp_path / "m/b.bin").write_bytes(b"other")))
    with pytest.raises(RuntimeError):
        files.snapshot_sha256(spark, str(tmp_path / "m"))


def test_one_file_in_canonical_order(spark, tmp_path):
    path = str(tmp_path / "out/r.jsonl")
    rows = spark.range(100).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("problem_id")).repartition(7)
    for n in (100, 40):
        files.write_one_jsonl(rows.filter(f"problem_id < 'p{n:03d}'"), path, "problem_id")
        assert [json.loads(x)["problem_id"] for x in open(path)] == [f"p{i:03d}" for i in range(n)]
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["r.jsonl"]


def test_problems_need_their_fields(spark, tmp_path):
    good = {"problem_id": "a", "dataset": "math", "question": "q", "answer": "1"}
    assert records.read_problems(spark, write(tmp_path / "p.jsonl", [good])).count() == 1
    for rows in ([good, good], [good | {"answer": None}], [{k: v for k, v in good.items() if k != "question"}]):
        with pytest.raises(ValueError):
            records.read_problems(spark, write(tmp_path / "p.jsonl", rows))


def test_resume_keeps_the_last_valid_record(spark, tmp_path):
    """Every rule has a line that breaks it alone; of valid lines of a problem the last one stays."""
    ok = lambda pid, **k: record(pid, 1, 4, **k)
    rows = {n: ok(f"p{i}") for i, n in enumerate(["chain_count", "budget", "seed_policy", "signature", "problem", "chains"])}
    rows["chain_count"]["chains"].pop()
    rows["budget"]["budget"]["top_p"] = 0.8
    rows["seed_policy"]["budget"]["seed_policy"]["base_seed"] = 9
    rows["signature"]["budget"]["run_signature"]["runtime_versions"] = {"python": "2"}
    rows["problem"]["question"] = "another"
    rows["chains"]["chains"][0]["token_count"] = 5
    first, last = ok("p7"), ok("p7")
    last["chains"][0]["text"] = "last"
    late = ok("p7")
    late["chains"].pop()
    path = write(tmp_path / "r.jsonl", [*rows.values(), first, last, late, ok("p6"), ok("gone")], '{"problem_id": "p8", \n\n')
    problems = spark.createDataFrame([(f"p{i}", i, "gsm8k", "q", "#### 1", None) for i in range(9)], "problem_id string, position int, dataset string, question string, answer string, math_level int")
    b = budget(4, 1)
    kept, counts = integrity.resume(records.numbered_lines(spark, path, records.RUN), problems, b, b["seed_policy"], b["run_signature"])
    got = kept.orderBy("position").collect()
    assert [r["problem_id"] for r in got] == ["p6", "p7"] and got[1]["chains"][0]["text"] == "last"
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"valid": 3, "chain_count": 2, "problem": 2, "malformed": 1, **{n: 1 for n in ("budget", "seed_policy", "signature", "chains")}}


def test_files_of_a_rerun(spark, tmp_path):
    def whole(pid, base, cap):
        r = record(pid, base, cap)
        r["budget"]["run_signature"] |= {"model_snapshot_sha256": "s", "prompt_template": "p", "prompt_sha256": "h"}
        return r

    read = lambda rows: records.read_jsonl(spark, write(tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl", rows))
    found = lambda n=None, **runs: sorted((r["file"], r["rule"]) for r in integrity.validate_files({k: read(v) for k, v in runs.items()}, n).collect())
    assert found(2, x=[whole("p1", 1, 4), whole("p2", 1, 4)], y=[whole("p1", 2, 4), whole("p2", 2, 4)]) == []
    odd = whole("p1", 1, 4)
    odd["question"] = "other"
    swapped = whole("p2", 1, 4)
    swapped["chains"][0]["chain_index"] = 7
    assert found(2, x=[whole("p1", 1, 4)], y=[odd, odd, swapped]) == [("*", "metadata_differs"), ("x", "row_count"), ("y", "chain_indexes"), ("y", "chains"), ("y", "duplicate_id"), ("y", "row_count")]
    assert found(x=[whole("p1", 1, 4), whole("p2", 1, 3)]) == [("x", "budget_differs")] and found(x=[record("p1", 1, 4)]) == [("x", "signature_fields")]


def test_seed_frames_and_models_are_bound(spark):
    make = lambda rows: spark.createDataFrame(rows, "problem_id string, dataset string")
    base = [("a", "x"), ("b", "y")]
    rules = lambda **f: sorted(r["rule"] for r in integrity.same_frames({k: make(v) for k, v in f.items()}, "problem_id").collect())
    assert rules(s1=base, s2=base) == [] and rules(s1=base, s2=base[:1]) == ["missing"] and rules(s1=base, s2=[("a", "z"), ("b", "y")]) == ["dataset_differs"] and rules(s1=base, s2=[*base, base[0]]) == ["duplicate"]
    one, two = {"model": "/m/one", "model_snapshot_sha256": "1"}, {"model": "/m/two", "model_snapshot_sha256": "2"}
    assert set(integrity.bind_models({"q": [one, one], "l": [two]}, {"q": "one"})) == {"q", "l"}
    for bad, expected in (({"q": [one, two]}, {}), ({"q": [one]}, {"q": "two"}), ({"q": [one], "l": [one]}, {})):
        with pytest.raises(ValueError):
            integrity.bind_models(bad, expected)


def test_engines_make_chains_by_seed(spark):
    """Chains carry the policy's seeds in order; an engine that runs over the cap is refused."""

    def factory():
        return lambda prompts, seeds, cap: [{"text": f"{p[-3:]}{s % 10}", "token_ids": [s % 7] * min(cap, 1 + s % 5), "finish_reason": "stop"} for p, s in zip(prompts, seeds, strict=True)]

    p = spark.createDataFrame([(f"p{i}", f"question {i}") for i in range(5)], "problem_id string, question string")
    rows = engines.generate(p, factory, 4, 3, 7, "default", at_once=2).orderBy("problem_id").collect()
    for r in rows:
        assert [(c["chain_index"], int(c["request_seed"])) for c in r["chains"]] == [(i, seed(7, r["problem_id"], i)) for i in range(3)]
        assert all(c["text"] == f"er:{int(c['request_seed']) % 10}" and c["token_count"] == len(c["token_ids"]) <= 4 for c in r["chains"])
    with pytest.raises(Exception, match="fit the request"):
        engines.generate(p, lambda: lambda prompts, seeds, cap: [{"text": "", "token_ids": [0] * (cap + 1), "finish_reason": "length"} for _ in prompts], 4, 1, 7).collect()


def test_names_fall_back_and_groups_keep_their_order(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "b"))
    name, rows = engines.first_that_loads(spark, [str(tmp_path / "a"), str(tmp_path / "b")], lambda s, n: s.read.parquet(n))
    assert name.endswith("b") and rows.count() == 3
    with pytest.raises(ValueError):
        engines.first_that_loads(spark, [str(tmp_path / "a")], lambda s, n: s.read.parquet(n))
    own = spark.createDataFrame([(0, "z"), (1, "a"), (2, "z"), (3, "m")], "i int, g string")
    assert [r["g"] for r in records.by_first_appearance(own.select("g").distinct(), own, "g", "i").collect()] == ["z", "a", "m"]
    assert [r["i"] for r in records.smoke(own, 2, "i").collect()] == [0, 1] and records.smoke(own, None).count() == 4
    odd = records.expected_records(own, {"z": {"i": 0}, "q": {"i": 1}}, "g").collect()
    assert [tuple(r) for r in odd] == [("z", "i", "0", "2")]


def test_prefixes_split_by_a_third_run(spark):
    run = lambda texts, n: spark.createDataFrame([(f"p{i}", "d", [{"text": t, "token_count": n, "finish_reason": None}]) for i, t in enumerate(texts)], "problem_id string, dataset string, chains array<struct<text:string,token_count:int,finish_reason:string>>")
    a, b, c = run(["ab", "xy"], 2), run(["abc", "xz"], 3), run(["", ""], 9)
    plain = {r["problem_id"]: r for r in text.prefix_runs(a, b, 5).collect()}
    assert plain["p0"]["is_prefix"] and plain["p1"]["lcp"] == 1 and not plain["p0"]["split_hit_max"]
    assert all(r["split_hit_max"] and not r["a_hit_max"] for r in text.prefix_runs(a, b, 5, c, 9).collect())
    with pytest.raises(ValueError):
        text.prefix_runs(a, b.limit(1), 5)


def test_router_evaluation(spark):
    """Learned routers beat chance where features tell; with too few groups they are not fitted; unequal records stop it."""
    rows = spark.range(400).select(F.col("id").alias("record_id"), (F.col("id") % 80).alias("problem_id"), (F.col("id") % 4).cast("double").alias("cap_hits"), (F.col("id") % 7).cast("double").alias("max_tokens"), (F.col("id") % 2 == 0).alias("base_ok"))
    rows = rows.withColumn("long_ok", F.when(F.col("cap_hits") == 3, True).otherwise(F.col("base_ok")))
    curve, summary = evaluate.evaluate(rows, 5, 10, ("cap_hits", "max_tokens"), kinds=("logistic",))
    s = summary.first()
    assert (s["n_records"], s["n_routable_flips"], s["n_routable_reversals"], s["learned_router_fitted"]) == (400, 100, 0, True)
    at = {(r["method"], round(r["route_fraction"], 2)): r for r in curve.collect()}
    assert at["learned_logistic", 0.25]["accuracy"] == at["cap_hit_rank", 0.25]["accuracy"] == at["fixed_extended", 1.0]["accuracy"] == 0.75 and at["random", 0.25]["accuracy"] == 0.5625
    assert at["route_every_cap_hit", 0.75]["accuracy"] == 0.75 and at["fixed_base", 0.0]["rerun_saving"] == 0.5
    few = rows.withColumn("problem_id", F.col("record_id") % 4)
    assert not evaluate.evaluate(few, 5, 10, ("cap_hits", "max_tokens"), kinds=("logistic",))[1].first()["learned_router_fitted"]
    with pytest.raises(ValueError):
        evaluate.evaluate(rows.withColumn("long_ok", ~F.col("base_ok")), 5, 10, ("cap_hits", "max_tokens"), kinds=())


def test_budgets():
    good = {"max_new_tokens": 5, "n_chains": 1, "temperature": 0, "top_p": 1}
    records.check_budgets({"short": good})
    for k, v in (("max_new_tokens", True), ("n_chains", 0), ("temperature", float("inf")), ("top_p", 0)):
        with pytest.raises(ValueError):
            records.check_budgets({"short": good | {k: v}})


def test_generation_is_a_function_of_the_seed(spark):
    p = spark.createDataFrame([("p1",), ("p2",)], "problem_id string")
    one, two = (generate.mock_runs(p, 10, 3, s).select("problem_id", F.to_json("chains")).orderBy("problem_id").collect() for s in (1, 1))
    assert one == two and one != generate.mock_runs(p, 10, 3, 2).select("problem_id", F.to_json("chains")).orderBy("problem_id").collect()
    short = generate.mock_runs(p, 10, 1, 1)
    more = spark.createDataFrame([("p1", " more", [7, 8], "stop"), ("p2", " more", [7], "stop")], "problem_id string, more_text string, more_ids array<int>, more_finish string")
    assert integrity.continuation_violations(short, generate.continue_truncated(short, more), 10, 20).count() == 0


def test_text_features(spark):
    r = spark.createDataFrame([("abcd", "abXd", ""), ("", "x", None), ("same", "same!", "one\n\ntwo")], "a string, b string, t string")
    o = text.prefix_overlap(r, "a", "b").collect()
    assert [(x["lcp"], x["ratio"], x["is_prefix"], x["diverges"]) for x in o] == [(2, 0.5, False, True), (0, 1.0, True, False), (4, 1.0, True, False)]
    assert [x[0] for x in r.select(text.steps(F.col("t"))).collect()] == [[], [], ["one", "two"]]
    said = spark.createDataFrame([("Add two. Then we multiply it by three. Done.",), ("One. Two. Three four five! Six; seven\u00a0eight nine? ten",), ("a\r\n\r\nb\n \nc",), ("l1\n\n",), ("x ## y ##",)], "t string")
    assert [x[0] for x in said.select(text.steps(F.col("t"))).collect()] == [["Add two. Then we multiply it by three.", "Done."], ["One. Two. Three four five!", "Six; seven eight nine?", "ten"], ["a", "b\n \nc"], ["l1"], ["x ## y ##"]]
    assert said.select(text.steps(F.col("t"), "##")).collect()[4][0] == ["x", "y"]
    g2 = spark.createDataFrame([([0.2, 0.3],), ([],), (None,), ([0.5],)], "s array<double>").select(*text.step_scores(F.col("s"))).collect()
    assert [(x["g2_high"], x["g2_steps"], x["g2_mean"]) for x in g2] == [(0.0, 2, 0.25), (1.0, 1, 0.5), (1.0, 1, 0.5), (1.0, 1, 0.5)]
    assert text.PROMPTS["r1"].count("｜") == 6 and r.select(text.prompt(F.lit("q"), "r1_math")).first()[0].endswith("\\boxed{}.<｜Assistant｜><think>\n")
    f = r.select(*text.output_features(F.col("t"), F.lit(1))).collect()
    assert [x["line_count"] for x in f] == [0, 0, 3]



def test_long_lines_split_in_one_pass(spark):
    """A line of 20 000 sentences is read once, by one pattern; with least_words 1 no blank begins a sentence."""
    long = spark.createDataFrame([("a. b c\u00a0d. " * 20_000 + "e",), ("w " * 40_000,), ("A. b; c d",)], "t string")
    cut = text.steps(F.col("t"))
    assert "regexp_extract_all" in str(cut) and "aggregate(" not in str(cut)
    assert [r["n"] for r in long.select(F.size(cut).alias("n")).collect()] == [20_001, 1, 1]
    assert long.select(cut).first()[0][:2] == ["a. b c d."] * 2 and long.select(text.steps(F.col("t"), least_words=1)).collect()[2][0] == ["A.", "b;", "c d"]


def test_boxes_without_braces_inside_are_read_by_one_pattern(spark, monkeypatch):
    """Braces are counted part by part only where the pattern can't tell; splitting happens once for a text."""
    texts = ["\\boxed{1} or \\boxed{ 7 }.", "\\boxed{\\frac{1}{2}}", "\\boxed{3} then \\boxed{open", "\\boxed{3} then \\boxed{a{b{c}}}", "\\boxed{a \\boxed{b}}", "\\boxed {x} y", "\\boxed{", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(answers.boxed(F.col("t"))).collect()] == ["7", "\\frac{1}{2}", "3", "a{b{c}}", "b", "{x}", None, None]
    monkeypatch.setattr(answers, "_closed", lambda rest: F.raise_error(F.lit("braces were counted")).cast("string"))
    assert [r[0] for r in frame.limit(2).select(answers.boxed(F.col("t"))).collect()] == ["7", "\\frac{1}{2}"]


def test_equal_rows_train_a_logistic_model_once(spark, monkeypatch):
    """Rows repeated under other keys weigh more but are no more rows to train on; forests draw from all rows."""
    one = spark.range(60).select("id", (F.col("id") % 6).cast("double").alias("x"), ((F.col("id") % 6 + F.col("id") % 2 * 3) > 4).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("fold"))
    many = one.crossJoin(spark.range(9).withColumnRenamed("id", "i")).select((F.col("id") + 60 * F.col("i")).alias("id"), "x", "label", "fold")
    seen, real = {}, learn.Fitted.assembled
    def assembled(self, rows):
        if "weight" in rows.columns:
            seen.setdefault(kind, []).append(rows.count())
        return real(self, rows)
    monkeypatch.setattr(learn.Fitted, "assembled", assembled)
    kind = "logistic"
    a, b = ({(r["id"] % 60): r["probability"] for r in learn.out_of_fold(d, ["x"], "label", k=3).collect()} for d in (one, many))
    # Strength of the penalty goes by the rows: n times as many rows, n times as weak.
    plain = learn.LogisticRegression(regParam=1.0 / 360, standardization=False, maxIter=200, labelCol="label", featuresCol="features", weightCol="weight")
    assert max(seen["logistic"]) <= 2 * 12 and a.keys() == b.keys()
    rows = many.filter("fold <> 0").withColumn("label", F.col("label").cast("double"))
    sums = learn.scaling(rows, ["x"], "label").collect()
    weights = rows.withColumn("weight", learn.class_weight(F.col("label"), {r["label"]: r["n"] for r in sums}))
    n = sum(r["n"] for r in sums)
    mean = sum(r["n"] * r["m_x"] for r in sums) / n
    deviation = (sum(r["n"] * (r["v_x"] + (r["m_x"] - mean) ** 2) for r in sums) / n) ** 0.5
    model = plain.fit(learn.VectorAssembler(inputCols=["z"], outputCol="features").transform(weights.withColumn("z", (F.col("x") - mean) / deviation)))
    for r in many.filter("fold = 0 and id < 60").collect():
        margin = model.coefficients[0] * (r["x"] - mean) / deviation + model.intercept
        assert b[r["id"]] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)
    kind = "forest"
    monkeypatch.setattr(learn, "TREES", 2)
    learn.out_of_fold(many, ["x"], "label", "forest", k=3)
    assert seen["forest"] == [360] * 3

def test_forests_cost_what_their_classes_do(spark):
    """Rows repeated under other keys are more to draw from, but no more classes; a rerun grows the same trees."""
    one = spark.range(240).select((F.col("id") % 12).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"), ((F.col("id") % 12 > 6) != (F.col("id") % 7 == 0)).cast("double").alias("label"), F.lit(1.0).alias("weight"))
    many = one.crossJoin(spark.range(9)).drop("id")
    made, real = [], forest.Forest.blocks

    def blocks(self, tally, cuts, classes):
        out = real(self, tally, cuts, classes)
        made.append((classes, sum(int(n) for r in out.collect() for n in np.frombuffer(r["n"], np.int64))))
        return out

    assembled = lambda d: learn.VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(d)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(forest.Forest, "blocks", blocks)
        patch.setattr(learn, "TREES", 20)
        a, b, c = (learn.classifier("forest", 0).fit(assembled(d)) for d in (one, many, many.repartition(3)))
    (few, n), (same, m), _ = made
    assert few == same <= 120 and (n, m) == (240, 2160)
    p = [r["probability"][1] for r in b.transform(assembled(many)).collect()]
    y = [r["label"] for r in many.collect()]
    assert np.mean([(v > 0.5) == (w > 0.5) for v, w in zip(p, y, strict=True)]) > 0.8
    assert (b.feature == c.feature).all() and (b.chance == c.chance).all() and a.featureImportances[0] > a.featureImportances[1]


def test_best_splits_hold_so_many_rows():
    counts = np.zeros((2, 1, forest.BINS, 2))
    counts[1, 0, 0], counts[1, 0, 1], counts[1, 0, 2] = (4, 0), (3, 0), (0, 6)
    for least, want in ((5, (1, 0, 1, 7, 0, 0, 6)), (7, None)):
        (row,) = forest.splits(3, counts, np.array([1.0, 2.0]), least).to_pylist()
        assert row["tree"] == 3 and (row["gain"] < 0 if want is None else tuple(row[k] for k in ("node", "slot", "bin", "l0", "l1", "r0", "r1")) == want)


def test_learning(spark):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.rand(1)).alias("x"), F.rand(2).alias("z"), F.lit(1).alias("one"))
    folds = learn.stratified_folds(rows, "id", "label", 5)
    assert {tuple(r) for r in folds.groupBy("fold", "label").count().select("count").collect()} == {(30,)}
    area = learn.auc(learn.out_of_fold(folds, ["x", "z"], "label"), "probability", "label").first()["auc"]
    assert area > 0.95 and [learn.verdict(x) for x in (area, 0.69, 0.65, 0.64, 0.6, 0.59)] == ["GO", "CONDITIONAL", "CONDITIONAL", "WARNING", "WARNING", "NO-GO"]
    moved = learn.shuffled(rows, "x", "id", 3)
    assert sorted(r["x"] for r in moved.collect()) == sorted(r["x"] for r in rows.collect()) and moved.join(rows.select("id", F.col("x").alias("old")), "id").filter("x = old").count() < 30
    few = rows.withColumn("g", F.when(F.col("label") == 1, F.col("id") % 3).otherwise(F.col("id")))
    zero, fitted = learn.grouped_scores(few, ["x"], "label", "g")
    assert not fitted and {r["probability"] for r in zero.collect()} == {0.0} and learn.grouped_scores(rows, ["x"], "label", "id")[1]
    assert learn.auc(rows.withColumn("s", F.lit(1.0)), "s", "label").first()["auc"] == 0.5
    assert learn.auc(rows.filter("label = 1"), "x", "label").first()["auc"] is None
    assert "one" not in learn.drop_constant(rows, ["x", "one"]).columns
    with pytest.raises(ValueError):
        learn.leakage_guard(["long_correct"])
    with pytest.raises(ValueError):
        learn.check_features(rows.unionByName(rows.limit(1)), "id", "label", ["x"])
    groups = learn.group_folds(rows.withColumn("g", F.floor(F.col("id") / 10)), "g", "label", 5)
    assert groups.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    gains = {f: m for f, m, _ in learn.permutation_importance(rows, ["x", "z"], "label", "id", repeats=1)}
    own = {f: m for f, m, _ in learn.permutation_importance(folds, ["x", "z"], "label", "id", repeats=1, k=2)}
    assert gains["x"] > gains["z"] and own["x"] > own["z"] and learn.importances(rows, ["x", "z"], "label")[0][0] == "x"
    assert learn.holdout(rows, ["x"], "label", F.col("id") < 200).count() == 100


def test_stream_adds_each_key_once_and_agrees_with_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/1.jsonl", [record("p1", 1, 4), record("p2", 1, 4)])
    target, point = str(tmp_path / "out"), str(tmp_path / "point")
    stream = lambda: runs.append_new(runs.read_runs(spark, str(tmp_path / "in")), ["problem_id"], target, point, lambda d: d.select("problem_id")).awaitTermination()
    stream()
    write(tmp_path / "in/2.jsonl", [record("p2", 1, 4), record("p3", 1, 4)])
    stream()
    assert sorted(r["problem_id"] for r in spark.read.parquet(target).collect()) == ["p1", "p2", "p3"]


def test_window_stream_is_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = runs.tumbling(events)
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = runs.tumbling(stream, late="400 days").writeStream.outputMode("complete").format("memory").queryName("votes").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("votes")) == key(batch)


@pytest.mark.parametrize("kind", ["lr_oof", "rf_oof"])
def test_registered_classifiers_learn_as_much_as_the_reference(spark, monkeypatch, kind):
    """Five folds, and forests of 200 trees."""
    seen = []

    def spy(frame, features, label, kind="logistic", k=5, seed=42):
        seen.append((k, sorted(r["fold"] for r in frame.select("fold").distinct().collect())))
        return frame.withColumn("probability", F.lit(0.5))

    monkeypatch.setattr(learn, "out_of_fold", spy)
    features.QUERIES[kind](spark, "/root/testdata/sf0.001")
    assert seen == [(5, [0, 1, 2, 3, 4])]
    assert learn.classifier("forest", 0).getNumTrees() >= 200


@pytest.mark.parametrize("seed", range(4))
def test_balanced_folds_are_within_a_group_of_the_best(spark, seed):
    """Counts of each label by fold, against the average: no fold is off by more than the largest group has of it."""
    import random

    rng = random.Random(seed)
    rows, sizes = [], {}
    for g in range(rng.choice([7, 60, 200])):
        a, b = (rng.choice([0, 1, 2, 3, 7, 40]), rng.choice([0, 1, 1, 2, 30])) if seed else (2, 1)
        sizes[g] = (a, b)
        rows += [(g, 0)] * a + [(g, 1)] * b
    rows += [(None, 0), (None, 1)]
    frame = spark.createDataFrame(rows, "g int, y int")
    got = learn.balanced_group_folds(frame, "g", "y", 5)
    by_group = {r["g"]: r["f"] for r in got.groupBy("g").agg(F.collect_set("fold").alias("f")).collect()}
    assert all(len(f) == 1 and 0 <= f[0] < 5 for f in by_group.values()) and got.count() == len(rows)
    for y in (0, 1):
        n = [got.filter(f"y = {y} and fold = {f}").count() for f in range(5)]
        assert max(n) - sum(n) / 5 <= max(s[y] for s in sizes.values()) and sum(n) / 5 - min(n) <= max(s[y] for s in sizes.values())
    assert {r["g"]: r["f"] for r in learn.balanced_group_folds(frame.repartition(3), "g", "y", 5).groupBy("g").agg(F.collect_set("fold").alias("f")).collect()} == by_group


def test_leftover_groups_are_placed_as_evenly_as_any_way(spark):
    """Few groups of one label: the greedy deal is within one group of the best of all deals."""
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(20):
        sizes = [rng.randint(1, 9) for _ in range(6)]
        classes = [(1, (float(s),)) for s in sizes]
        folds = [f[0] for f in learn.spread_groups(classes, 3)]
        spread = lambda deal, sizes=sizes: max(t := [sum(s for s, f in zip(sizes, deal, strict=True) if f == k) for k in range(3)]) - min(t)
        best = min(spread(d) for d in itertools.product(range(3), repeat=6))
        assert spread(folds) <= best + max(sizes)
    assert learn.fold_number(spark.createDataFrame([(0,), (0,), (0,), (1,), (1,)], "y int"), "y", 5) == 2


def shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_runs_of_one_query_share_a_shuffle_and_are_written_compressed(spark, tmp_path):
    from tokenlab.plans import recorded

    problems = recorded.eligible(spark, "/root/testdata/sf0.001")
    arms = [recorded.run(problems, "a", 35), recorded.cut(recorded.run(problems, "c", 50))]
    assert [shuffles(x) for x in arms] == [0, 0] and problems.count() > 0
    read = recorded.written(arms[0], "test-arm")
    names = read.inputFiles()
    assert names and all(n.endswith(".gz") for n in names) and read.count() == problems.count()
    pick = lambda d: sorted(map(str, d.select("problem_id", "dataset", "question", "answer", "chains", "budget").collect()))
    assert pick(read) == pick(arms[0])


def test_protocol_shuffles_no_text(spark, monkeypatch):
    from tokenlab.plans import recorded

    problems = recorded.eligible(spark, "/root/testdata/sf0.001")
    a, c = recorded.run(problems, "a", 35), recorded.run(problems, "c", 50)
    joined, real = [], integrity.three_arms
    monkeypatch.setattr(integrity, "three_arms", lambda *arms: joined.extend(arms) or real(*arms))
    assert integrity.protocol_violations(a, recorded.cut(c), c, 35, 50).count() == 0
    assert len(joined) == 3 and all("text" not in d.schema["chains"].dataType.elementType.names for d in joined)


def test_aligned_files_are_written_from_sorted_problems(spark, monkeypatch):
    """The records themselves are neither sorted nor made a second time to sample ranges."""
    from tokenlab.plans import recorded

    orders, real = [], recorded.ledger.write_one
    monkeypatch.setattr(recorded.ledger, "write_one", lambda rows, path, *order: orders.append(order) or real(rows, path, *order))
    assert recorded.aligned_scan(spark, "/root/testdata/sf0.001").count() and orders == [()] * 3


def test_aligned_files_take_a_tenth_of_their_lines(spark, monkeypatch):
    """Each file is smaller on disk than a tenth of its lines."""
    from tokenlab.plans import recorded

    sizes, real = [], recorded.ledger.write_one

    def spy(rows, path, *order):
        real(rows, path, *order)
        sizes.append((os.path.getsize(path.removeprefix("file://")), rows.agg(F.sum(F.length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))).first()[0]))

    monkeypatch.setattr(recorded.ledger, "write_one", spy)
    assert recorded.aligned_scan(spark, "/root/testdata/sf0.001").count()
    assert len(sizes) == 3 and all(0 < size < lines / 10 for size, lines in sizes)


def test_line_items_are_shuffled_without_the_rest_of_their_order(spark, monkeypatch):
    """And as they are, not in lists that are sorted and spilled before the shuffle."""
    from tokenlab.plans import recorded

    plans, real = [], recorded.materialise
    monkeypatch.setattr(recorded, "materialise", lambda d, name: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(d, name))
    assert recorded.eligible(spark, "/root/testdata/sf0.001").count()
    (plan,) = plans
    assert "l_quantity" in plan and "RepartitionByExpression" in plan and not any(x in plan.split("Relation")[0] for x in ("l_extendedprice", "l_shipdate", "l_returnflag"))


def test_lines_to_resume_are_written_compressed(spark, monkeypatch):
    from tokenlab.plans import recorded

    read, real = [], records.numbered_lines
    monkeypatch.setattr(recorded.records, "numbered_lines", lambda s, path, schema: read.append(s.read.text(path).inputFiles()) or real(s, path, schema))
    assert recorded.resume_records(spark, "/root/testdata/sf0.001").count() and read[0] and all(x.endswith(".gz") for x in read[0])


def test_written_runs_are_made_once(spark):
    from tokenlab.plans import votes

    long = votes._written(spark, "/root/testdata/sf0.001", "O", 50)
    assert long.count() and shuffles(long) == 0


def test_duplicate_keys_are_one_aggregation(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 1, "a"), (2, 1, "b"), (2, 1, None), (3, 1, None), (3, 1, None), (4, 1, "a"), (None, 1, "a"), (None, 1, "c")], "k long, l int, v string")
    found = integrity.duplicate_keys(rows, "k", "l")
    assert {(r["k"], r["n"], r["conflicting"]) for r in found.collect()} == {(1, 2, False), (2, 3, True), (3, 2, False), (None, 2, True)}
    assert found._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2
