"""Schemas, readers and writers of run records, manifests and checkpoints."""

from __future__ import annotations

import uuid
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SIGNATURE = struct(model=S, model_snapshot_sha256=S, runtime_versions=T.MapType(S, S), prompt_template=S, prompt_sha256=S, store_token_ids=B, dtype=S, max_model_len=I, trust_remote_code=B)
SEED_POLICY = struct(engine_seed=L, request_seed=T.DecimalType(20, 0), base_seed=L, mode=S)
BUDGET = struct(max_new_tokens=I, n_chains=I, temperature=D, top_p=D, seed=L, mode=S, deterministic_sampling=B, seed_policy=SEED_POLICY, run_signature=SIGNATURE, reconstructed_from=struct(source_name=S, source_cap=I))
CHAIN = struct(text=S, token_count=I, finish_reason=S, stop_reason=S, chain_index=I, request_seed=T.DecimalType(20, 0), token_ids=T.ArrayType(I), avg_logprob=D, avg_logprob_margin=D)
PROBLEM = struct(problem_id=S, dataset=S, source=S, source_split=S, question=S, answer=S, math_level=I, math_type=S)
RUN = T.StructType([*PROBLEM.fields, T.StructField("chains", T.ArrayType(CHAIN)), T.StructField("budget", BUDGET), T.StructField("resume", struct(continued=B, medium_tokens=I, continuation_tokens=I))])
SCORED = struct(problem_id=S, dataset=S, short_chains=T.ArrayType(struct(step_scores=T.ArrayType(D), mean=D, min=D, var=D, chain_score=D, orm_correct=B, extracted_answer=S, token_count=I)), utility_label=I)
FEATURES = struct(problem_id=S, dataset=S, label=I, features=T.MapType(S, T.MapType(S, D)))

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = RUN, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are passed over. Strict: a malformed line fails; else it is left out."""
    reader = spark.read.option("ignoreLeadingWhiteSpace", True)
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    parsed = _lines(spark, path, schema).filter(F.col("r")[CORRUPT].isNull())
    return parsed.select(*[F.col("r")[f].alias(f) for f in schema.names])


def _lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """file, line and r: the line read leniently, with what can't be read in a column of its own."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, S)])
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    return lines.withColumn("r", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))


def malformed(spark: SparkSession, path: str | list[str], schema: T.StructType = RUN) -> DataFrame:
    """The lines that the lenient reader leaves out, with their file."""
    return _lines(spark, path, schema).filter(F.col("r")[CORRUPT].isNotNull()).select("file", "line")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, after a check that no key is null or comes twice."""
    bad = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.coalesce(*[F.col(k).isNull() for k in keys]))
    if examples := bad.limit(5).collect():
        raise ValueError(f"keys repeated or null: {[tuple(r) for r in examples]}")
    return rows


def keep_last(rows: DataFrame, keys: list[str], order: list, valid=None) -> DataFrame:
    """The last row of each key by order, among valid ones: only the key and the order are compared in the shuffle."""
    kept = rows if valid is None else rows.filter(valid)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return kept.withColumn("__place", place).filter(F.col("__place") == 1).drop("__place")


def require_same_ids(a: DataFrame, b: DataFrame, *keys: str) -> None:
    """Fail unless both have the same set of keys; nothing is ever silently intersected."""
    x, y = a.select(*keys).distinct().withColumn("left", F.lit(1)), b.select(*keys).distinct().withColumn("right", F.lit(1))
    odd = x.join(y, list(keys), "full").filter("left is null or right is null").limit(5).collect()
    if odd:
        raise ValueError(f"ids that only one side has: {[tuple(r) for r in odd]}")


PROBLEM_FIELDS = ("dataset", "question", "answer")


def read_problems(spark: SparkSession, path: str | list[str], required: tuple[str, ...] = ("problem_id", *PROBLEM_FIELDS)) -> DataFrame:
    """Problems from JSONL, strictly read: ids unique, required fields there and not null."""
    rows = require_unique(read_jsonl(spark, path, PROBLEM), "problem_id")
    odd = rows.filter(F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required], F.lit("")) != "").limit(5).collect()
    if odd:
        raise ValueError(f"problems without {required}: {[r['problem_id'] for r in odd]}")
    return rows


def numbered_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """file, at (where its split begins, then the place among the lines read), line and r (null fields if unreadable).

    (file, at) is the order of lines in each file: a split starts at a byte, and Spark numbers a split's lines as it
    reads them.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, S)])
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place")).alias("at"))
    return lines.filter(F.trim("line") != "").withColumn("r", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))


def smoke(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in order, for a trial run; all without n."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def expected_records(runs: DataFrame, told: dict[str, dict], key: str) -> DataFrame:
    """Rows of runs that are not as a configuration tells: key, field, told and found; keys that it lacks are left alone."""
    spark = runs.sparkSession
    cells = [(k, f, str(v)) for k, fields in told.items() for f, v in fields.items()]
    wanted = F.broadcast(spark.createDataFrame(cells, f"{key} string, field string, told string"))
    names = sorted({f for fields in told.values() for f in fields})
    found = runs.select(F.col(key).cast("string").alias(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("found")) for f in names])).alias("x")).select(key, "x.*")
    return found.join(wanted, [key, "field"]).filter(~F.col("told").eqNullSafe(F.col("found"))).select(key, "field", "told", "found")


def by_first_appearance(groups: DataFrame, rows: DataFrame, group: str, position: str) -> DataFrame:
    """groups in the order in which their values first appear in rows."""
    first = rows.groupBy(group).agg(F.min(position).alias("__first"))
    return groups.join(first, group, "left").orderBy(F.col("__first").asc_nulls_last(), group).drop("__first")


def select_one(rows: DataFrame, **criteria) -> dict:
    """The single row that meets the criteria."""
    for k, v in criteria.items():
        rows = rows.filter(F.col(k) == v)
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no row' if not found else 'more than one row'} for {criteria}")
    return found[0].asDict()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Typed by a schema; else all strings."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def text_flag(value):
    """True and False as text; "1" and "0" too; null for anything else."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "1", "1.0"), True).when(low.isin("false", "0", "0.0"), False)


def write_jsonl(rows: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """In canonical order if one is given. Spark's commit replaces all files at once or none."""
    (rows.orderBy(*order) if order else rows).write.mode(mode).json(path)


def write_table(rows: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite", one: bool = True) -> None:
    """csv with a header, json, parquet or text (one string column); a summary as one file, details (one=False) as many.

    The one file is written by a task of its own, behind a shuffle, so that the work before it keeps its tasks.
    """
    one = (rows.repartition(1) if one else rows).write.mode(mode)
    {"csv": lambda: one.option("header", True).csv(path), "json": lambda: one.json(path), "parquet": lambda: one.parquet(path), "text": lambda: one.text(path)}[kind]()


def markdown(rows: list, columns: list[str], decimals: int = 3) -> str:
    """Summary rows as a table; numbers are formatted here, as engines round halves differently."""
    show = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows])


def load_config(path: str) -> dict:
    return yaml.safe_load(Path(path).read_text())


def check_budgets(budgets: dict[str, dict]) -> None:
    """Positive whole numbers, a finite temperature of 0 or more, top_p in (0, 1]."""
    for name, b in budgets.items():
        for key in ("max_new_tokens", "n_chains"):
            if isinstance(b[key], bool) or not isinstance(b[key], int) or b[key] < 1:
                raise ValueError(f"{name}: {key} has to be a positive whole number")
        if isinstance(b["temperature"], bool) or not 0 <= b["temperature"] < float("inf"):
            raise ValueError(f"{name}: temperature")
        if isinstance(b["top_p"], bool) or not 0 < b["top_p"] <= 1:
            raise ValueError(f"{name}: top_p")


def tree_digest(files: DataFrame) -> DataFrame:
    """One digest over all files in order of path, from their own digests."""
    rows = files.agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "bytes"))).alias("f"))
    return rows.select(F.size("f").cast("long").alias("files"), F.sha2(F.array_join(F.transform("f", lambda x: F.concat_ws("\x00", x["path"], x["sha256"], x["bytes"])), "\n").cast("binary"), 256).alias("sha256"))


def canonical(value) -> str:
    """A struct as JSON text, maps by key: equal for equal values."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def cached(spark: SparkSession, wanted: DataFrame, keys: list[str], path: str, compute, version: str = "1", settled: str | None = None) -> DataFrame:
    """A table of computed values that grows: what it lacks of wanted keys is computed and added; all wanted is returned.

    compute gets the missing keys and returns them with values. version: of what computes; another one misses. settled:
    a condition on results; others (a verification that ran out of time) are returned and noted in a log of their own,
    but never kept as values, so that they are computed again. Every addition is a version of a log that one writer can
    claim: a writer that was slower drops what others have added meanwhile and tries again, so a key has one row
    whoever computes it. Files are sorted by key and carry Bloom filters on it, which lookups use.
    """
    from . import ledger
    from .tables import materialise

    home = f"{path.rstrip('/')}/{version}"
    wanted = wanted.select(*keys).distinct()
    results, values = None, None
    for _ in range(ledger.TRIES):
        state = ledger.manifest(home)
        parts = [f"{home}/parts/{p['name']}" for own in state["batches"].values() for p in own]
        have = spark.read.parquet(*parts) if parts else None
        missing = wanted if have is None else wanted.join(have.select(*keys), keys, "left_anti")
        if results is None:
            results = materialise(compute(missing), "computed")
            values = results if settled is None else results.filter(settled)
        new = values if have is None else values.join(have.select(*keys), keys, "left_anti")
        if new.isEmpty():
            break
        name = f"{uuid.uuid4().hex}.parquet"
        writer = new.dropDuplicates(keys).sort(*keys).write
        for k in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{home}/parts/{name}")
        if ledger.commit(home, name, [{"name": name, "rows": -1, "bytes": -1}], after=state["version"]):
            have = spark.read.parquet(*parts, f"{home}/parts/{name}")
            break
    else:
        raise RuntimeError(f"{path}: other writers were faster {ledger.TRIES} times")
    out = results.limit(0) if have is None else have.join(wanted, keys, "left_semi").select(*results.columns)
    if settled is None:
        return out
    open_ = results.filter(f"not coalesce(({settled}), false)").dropDuplicates(keys)
    if not open_.isEmpty():
        ledger.append(open_.select(*keys), f"{home}/unsettled", uuid.uuid4().hex)
    return out.unionByName(open_.join(out.select(*keys), keys, "left_anti"))


class Checkpoint:
    """Progress of a resumable job, as a table: results by key under one signature of the inputs."""

    def __init__(self, spark: SparkSession, path: str, signature: str):
        self.spark, self.path, self.signature = spark, path, signature

    def done(self) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None
        if other := rows.filter(F.col("signature") != self.signature).limit(1).collect():
            raise ValueError(f"the checkpoint is of other inputs: {other[0]['signature']}")
        return rows.drop("signature")

    def todo(self, rows: DataFrame, *keys: str) -> DataFrame:
        done = self.done()
        return rows if done is None else rows.join(done.select(*keys).distinct(), list(keys), "left_anti")

    def add(self, results: DataFrame) -> None:
        results.withColumn("signature", F.lit(self.signature)).write.mode("append").parquet(self.path)


def input_signature(spark: SparkSession, paths: list[str], *parameters) -> str:
    """sha256 over names, sizes and times of the files and the parameters."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "length", F.unix_micros("modificationTime")))), lambda x: F.to_json(x)), "\n"), F.lit("\n" + "\n".join(map(repr, parameters))))
    return files.agg(F.sha2(text.cast("binary"), 256).alias("s")).first()["s"]
