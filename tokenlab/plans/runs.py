"""From run records to attribution: scoring of chains, prefix reconstruction, and the whole three-arm analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, verify
from ..functions.answers import cap_hit
from ..operators import attribution as at
from ..operators import integrity, text, vote
from ..sources import files, records


def scored(run: DataFrame, cap: int, relaxed: bool = False) -> DataFrame:
    """problem_id, dataset, math_level, chains: each chain with complete, answer and correct, in order of its place.

    A chain that the cap cut is not complete, but its answer counts if it has one. Problems without chains stay, with
    an empty array. relaxed: each chain also has those of the relaxed rule (a last number where no answer is found), as
    its field relaxed.
    """
    rows = run.select("problem_id", F.col("answer").alias("gold"), "dataset", F.posexplode("chains").alias("place", "c")).select("problem_id", "gold", "dataset", "place", "c.text", "c.token_count", "c.finish_reason")
    marked = verify.score_rows(rows, relaxed=relaxed).withColumn("complete", ~cap_hit(F.col("finish_reason"), F.col("token_count"), cap))
    more = [F.struct(F.col("relaxed_answer").alias("answer"), F.coalesce("relaxed_correct", F.lit(False)).alias("correct")).alias("relaxed")] if relaxed else []
    chain = F.struct(F.col("place").alias("chain_index"), "token_count", "finish_reason", "complete", "answer", F.coalesce("correct", F.lit(False)).alias("correct"), *more)
    packed = marked.groupBy("problem_id").agg(F.array_sort(F.collect_list(chain)).alias("chains"))
    both = run.select("problem_id", "dataset", "math_level").join(packed, "problem_id", "left")
    return both.withColumn("chains", F.coalesce("chains", F.array().cast(packed.schema["chains"].dataType)))


def reconstruct(run: DataFrame, cap: int, decode: Callable[[Column], Column]) -> DataFrame:
    """The run as it would have been at a lower cap: token prefixes, their text decoded, and the budget declared so.

    decode: from token ids to text. A character that the cut leaves incomplete is dropped.
    """

    def cut(c: Column) -> Column:
        short = text.lower_cap(c, cap)
        decoded = F.regexp_replace(decode(short["token_ids"]), "�$", "")
        return F.when(F.size(c["token_ids"]) > cap, short.withField("text", decoded)).otherwise(short)

    source = F.struct(F.lit(None).cast("string").alias("source_name"), F.col("budget.max_new_tokens").alias("source_cap"))
    budget = F.col("budget").withField("max_new_tokens", F.lit(cap)).withField("mode", F.lit("reconstructed_token_prefix")).withField("reconstructed_from", source)
    return run.withColumn("chains", F.transform("chains", cut)).withColumn("budget", budget)


def arms(a: DataFrame, b: DataFrame, c: DataFrame, base_cap: int, long_cap: int) -> DataFrame:
    """One row per problem with the scored chains of all three runs; the id sets have to be equal."""
    records.require_same_ids(a, b, "problem_id")
    records.require_same_ids(b, c, "problem_id")
    x, y, z = scored(a, base_cap), scored(b, base_cap), scored(c, long_cap)
    pick = lambda d, n: d.select("problem_id", F.col("chains").alias(n))
    return x.withColumnRenamed("chains", "a").join(pick(y, "b"), "problem_id").join(pick(z, "c"), "problem_id")


def three_arm(a: DataFrame, b: DataFrame, c: DataFrame, base_cap: int, long_cap: int, checkpoint: str | None = None) -> dict[str, DataFrame]:
    """The four tables of an attribution: detail, summary, harm_detail and harm_summary (with exact intervals).

    The protocol is checked first. With a checkpoint path, scored problems are kept there and not scored again.
    """
    integrity.require_none(integrity.protocol_violations(a, b, c, base_cap, long_cap), "protocol")
    if checkpoint is None:
        frame = arms(a, b, c, base_cap, long_cap)
    else:
        point = records.Checkpoint(a.sparkSession, checkpoint, f"{base_cap}|{long_cap}")
        left = [point.todo(d, "problem_id") for d in (a, b, c)]
        if not left[0].isEmpty():
            point.add(arms(*left, base_cap, long_cap))
        frame = point.done().join(a.select("problem_id"), "problem_id", "left_semi")
    detail, harm = at.three_arm_detail(frame), at.harm_detail(frame)
    summary = at.harm_summary(harm).withColumn("ci", stats.interval_udf(F.col("harm_count"), F.col("n_eligible")))
    summary = summary.select("contrast", "dataset", "definition", "n_eligible", "harm_count", "harm_rate", F.col("ci.low").alias("ci95_low"), F.col("ci.high").alias("ci95_high"), "certain_harm_count", "possible_harm_count")
    return {"three_arm_detail": detail, "three_arm_summary": at.three_arm_summary(detail), "three_arm_harm_detail": harm, "three_arm_harm_summary": summary}


def relaxed_detail(medium: DataFrame, long: DataFrame, medium_cap: int, long_cap: int) -> DataFrame:
    """A row per problem: verdicts of the first chains of two runs, strict and relaxed (units, numbers, a last number).

    Both runs need the same problems with the same data set, question and answer, and a chain each.
    """
    records.require_same_ids(medium, long, "problem_id")
    pack = lambda d, n: d.select("problem_id", F.struct("dataset", "question", "answer", F.try_element_at("chains", F.lit(1)).alias("c")).alias(n))
    both = pack(medium, "m").join(pack(long, "x"), "problem_id")
    rules = {**{f: F.col(f"m.{f}").eqNullSafe(F.col(f"x.{f}")) for f in ("dataset", "question", "answer")}, "chains": F.col("m.c").isNotNull() & F.col("x.c").isNotNull()}
    integrity.require_none(integrity.violations(both, "problem_id", rules), "runs differ")
    caps = {"m": medium_cap, "x": long_cap}
    rows = both.select("problem_id", "m.dataset", F.col("m.answer").alias("gold"), *[c for a, n in (("m", "medium"), ("x", "long")) for c in (F.col(f"{a}.c.text").alias(f"{n}_text"), F.col(f"{a}.c.token_count").alias(f"{n}_tokens"), cap_hit(F.col(f"{a}.c.finish_reason"), F.col(f"{a}.c.token_count"), caps[a]).alias(f"{n}_hit_max"))])
    for n in ("medium", "long"):
        rows = verify.score_rows(rows, f"{n}_text", capped=f"{n}_hit_max", relaxed=True)
        rows = rows.select("*", F.col("units_correct").alias(f"relaxed_{n}_correct"), F.col("correct").alias(f"strict_{n}_correct"), F.col("answer").alias(f"strict_{n}_prediction"), F.coalesce(F.col(f"{n}_text").contains("\\boxed"), F.lit(False)).alias(f"{n}_has_boxed")).drop(*verify.SCORE.names)
    helpful = [(F.col(f"{k}_long_correct") & ~F.col(f"{k}_medium_correct")).alias(f"{k}_helpful_ml") for k in ("strict", "relaxed")]
    return rows.select("*", *helpful, *[(F.col(f"relaxed_{n}_correct") != F.col(f"strict_{n}_correct")).alias(f"{n}_changed_by_relaxed") for n in ("medium", "long")])


def verifier_audit(detail: DataFrame, long: DataFrame, cap: int) -> DataFrame:
    """One row: repairs among problems that the strict verifier finds all wrong, and those only a relaxed rule sees.

    detail: three_arm_detail as recorded; long: the extended run. A recorded verdict that strict scoring does not
    reproduce is an error: then no rate is reported. Problems without a run count as eligible only.
    """
    told = detail.filter("definition = 'strict_all_wrong' and eligible").select("problem_id", "long_plurality_correct")
    relaxed = F.transform("chains", lambda c: F.struct(c["relaxed"]["answer"].alias("answer"), c["relaxed"]["correct"].alias("correct")))
    both = scored(long, cap, relaxed=True).withColumn("relaxed", relaxed).select("problem_id", vote.plurality("chains")["correct"].alias("s"), vote.plurality("relaxed")["correct"].alias("r"))
    rows = told.join(both, "problem_id", "left")
    odd = F.count_if(F.col("s") != F.col("long_plurality_correct"))
    sums = rows.agg(F.count(F.lit(1)).alias("n_eligible"), F.count_if("s").alias("strict_plurality_repair"), F.count_if("r").alias("relaxed_plurality_repair"), odd.alias("odd"))
    checked = F.when(F.col("odd") == 0, F.col("n_eligible")).otherwise(F.raise_error(F.concat(F.lit("strict scoring disagrees with recorded verdicts of problems: "), F.col("odd").cast("string"))).cast("long"))
    hidden = F.col("relaxed_plurality_repair") - F.col("strict_plurality_repair")
    return sums.select(checked.alias("n_eligible"), "strict_plurality_repair", "relaxed_plurality_repair", hidden.alias("hidden_by_strict_matching")).withColumn("upper95", F.round(stats.upper_udf(F.greatest("hidden_by_strict_matching", F.lit(0)), "n_eligible"), 6))


def main(argv: list[str] | None = None) -> None:
    """Command line: three-arm over JSONL runs, or a manifest of a folder."""
    import argparse

    parser = argparse.ArgumentParser(prog="tokenlab")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("three-arm", help="attribute changes between an independent, a cut and an extended run")
    for name in ("--a", "--c", "--out"):
        run.add_argument(name, required=True)
    run.add_argument("--b", help="the cut run; without it, it is reconstructed from c")
    run.add_argument("--base-cap", type=int, required=True)
    run.add_argument("--long-cap", type=int, required=True)
    run.add_argument("--checkpoint")
    listed = sub.add_parser("manifest", help="sizes, lines and digests of all files below a folder")
    for name in ("--path", "--out"):
        listed.add_argument(name, required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tokenlab").getOrCreate()
    if args.command == "manifest":
        records.write_table(files.manifest(spark, args.path), args.out, "csv")
        return
    a, c = (records.require_unique(records.read_jsonl(spark, x), "problem_id") for x in (args.a, args.c))
    spelled = lambda ids: F.array_join(ids.cast("array<string>"), " ")  # noqa: E731  stands in for a tokenizer's decoding
    b = records.require_unique(records.read_jsonl(spark, args.b), "problem_id") if args.b else reconstruct(c, args.base_cap, spelled)
    for name, rows in three_arm(a, b, c, args.base_cap, args.long_cap, args.checkpoint).items():
        records.write_table(rows, f"{args.out}/{name}", "csv", one=name.endswith("summary"))
