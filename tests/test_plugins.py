"""Rules that users bring, and votes over streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tokenlab.operators import learn, plugins, vote
from tokenlab.streaming import votes

CHAINS = "problem_id string, chain_index int, answer string, correct boolean, token_count int"


def test_a_rule_of_a_test_runs_from_sql(spark):
    rows = [("p", 0, "a", False, 5), ("p", 1, "b", True, 9), ("p", 2, "a", True, 3), ("q", 0, None, False, 1), ("r", 1, "x", False, 1), ("r", 0, "y", True, 1)]
    spark.createDataFrame(rows, CHAINS).createOrReplaceTempView("t_chains")
    plugins.register_rules(spark, "vote_by", last=lambda chains: chains[-1]["answer"])
    ask = lambda rule, table="TABLE(SELECT * FROM t_chains)": {r["problem_id"]: (r["winner"], r["correct"], r["n"]) for r in spark.sql(f"SELECT * FROM vote_by({table} PARTITION BY problem_id ORDER BY (chain_index), '{rule}')").collect()}
    assert ask("most_tokens") == {"p": ("b", True, 3), "q": (None, False, 1), "r": ("x", False, 2)}
    assert ask("last") == {"p": ("a", True, 3), "q": (None, False, 1), "r": ("x", False, 2)}
    assert ask("first_complete")["r"] == ("y", True, 2)
    for rule, table, said in [("none", "TABLE(SELECT * FROM t_chains)", "unknown rule"), ("last", "TABLE(SELECT problem_id, chain_index, answer FROM t_chains)", "needs correct"), ("last", "TABLE(SELECT problem_id, chain_index, 1 AS answer, correct FROM t_chains)", "needs answer of type string, not int")]:
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM vote_by({table} PARTITION BY problem_id ORDER BY (chain_index), '{rule}')")
    with pytest.raises(TypeError):
        plugins.register_rules(spark, broken=3)


def test_a_verifier_of_a_test_runs_from_sql(spark):
    def slow(text, gold):
        while text == "stuck":
            pass
        return text == gold

    plugins.register_verifier(spark, "same_text", slow, seconds=0.2)
    got = spark.sql("SELECT t, v.correct, v.timed_out FROM (SELECT t, same_text(t, 'a') AS v FROM VALUES ('a'), ('b'), ('stuck'), (CAST(NULL AS STRING)) x(t))").collect()
    assert {r["t"]: (r["correct"], r["timed_out"]) for r in got} == {"a": (True, False), "b": (False, False), "stuck": (None, True), None: (False, False)}
    plugins.register_verifier(spark, "no_verdict", lambda t, g: "yes")
    with pytest.raises(Exception, match="instead of a boolean"):
        spark.sql("SELECT no_verdict('a', 'b')").collect()


def test_a_classifier_of_a_test_scores_out_of_folds(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    plugins.register_classifier("stump", lambda n, c, seed, **columns: DecisionTreeClassifier(maxDepth=1, seed=seed, **columns))
    try:
        rows = spark.range(400).select(F.col("id"), (F.col("id") % 2).cast("double").alias("x"), F.rand(1).alias("noise"), (F.col("id") % 2).cast("int").alias("y"))
        scored = learn.out_of_fold(learn.stratified_folds(rows, "id", "y", 3), ["x", "noise"], "y", "stump", 3)
        assert learn.auc(scored, "probability", "label").first()["auc"] == 1.0
        with pytest.raises(ValueError, match="there already"):
            plugins.register_classifier("stump", None)
    finally:
        del learn.CLASSIFIERS["stump"]
    with pytest.raises(ValueError, match="unknown classifier"):
        learn.classifier("stump", 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_votes_are_those_of_a_batch_in_any_order(spark, tmp_path, seed):
    """Chains in shuffled files, some of them twice, late, or corrected by a higher revision that may come first."""
    rng = random.Random(seed)
    rows = [{"problem_id": f"p{p}", "chain_index": i, "answer": rng.choice(["a", "b", "c", None]), "correct": rng.random() < 0.4, "revision": 0} for p in range(12) for i in range(rng.randint(1, 7))]
    fixed = [dict(r, answer=rng.choice(["a", "b"]), correct=True, revision=1) for r in rng.sample(rows, 10)]
    sent = rows + fixed + rng.sample(rows, 8)
    rng.shuffle(sent)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run(batch):
        for k, piece in enumerate(batch):
            (folder / f"{seed}-{time.time_ns()}-{k}.json").write_text("".join(json.dumps(r) + "\n" for r in piece))
        stream = spark.readStream.schema("problem_id string, chain_index int, answer string, correct boolean, revision long").option("maxFilesPerTrigger", 1).json(str(folder))
        q = votes.vote_changes(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start(out)
        assert q.awaitTermination(120)

    half = len(sent) // 2
    run([sent[:half]])
    run([sent[half:], sent[:half]])  # started again: late chains, and a file that repeats the first
    last = {}
    for r in sorted(sent, key=lambda r: r["revision"]):
        last[r["problem_id"], r["chain_index"]] = r
    frame = spark.createDataFrame([(k[0], r["answer"], r["correct"]) for k, r in last.items()], "problem_id string, answer string, correct boolean")
    packed = frame.groupBy("problem_id").agg(F.collect_list(F.struct("answer", "correct")).alias("c")).select("problem_id", vote.plurality("c").alias("v"), F.size("c").alias("n"))
    want = {(r["problem_id"], r["v"]["winner"], r["v"]["correct"], r["v"]["tie"], r["n"]) for r in packed.collect()}
    changes = spark.read.parquet(out)
    got = votes.current(changes).collect()
    assert {(r["problem_id"], r["winner"], r["correct"], r["tie"], r["n"]) for r in got} == want and len(got) == len(want)
    assert changes.filter("change = -1").count() > 0


def test_a_quiet_problem_is_told_final(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"problem_id": "p", "chain_index": 0, "answer": "a", "correct": True, "revision": 0}) + "\n")
    stream = spark.readStream.schema("problem_id string, chain_index int, answer string, correct boolean, revision long").json(str(folder))
    q = votes.vote_changes(stream, 1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "point")).trigger(processingTime="2 seconds").start(out)
    try:
        for _ in range(40):
            time.sleep(1)
            if q.exception():
                raise q.exception()
            found = [r.asDict() for r in spark.read.schema(votes.CHANGES).parquet(out).collect()] if list((tmp_path / "out").glob("*.parquet")) else []
            if any(r["final"] for r in found):
                break
    finally:
        q.stop()
    assert [(r["winner"], r["final"]) for r in votes.current(spark.createDataFrame(found, votes.CHANGES)).collect()] == [("a", True)]
