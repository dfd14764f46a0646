"""Five stages from raw documents to a mix: each works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlab.llm import decontam, langid, lines, mixing, neardup
from tokenlab.llm.shared import materialise


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator adds, and those names by their own."""
    names = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _own(docs: DataFrame, names: dict[str, str], **new: Column) -> DataFrame:
    """docs under their own names again; new: columns that take another value."""
    return docs.select(*[new.get(c, F.col(f"`{n}`")).alias(c) for c, n in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those with a null text or without a letter go."""
    model = langid.learn(langid.training_rows(docs))
    apart, names = _apart(docs)
    return _own(langid.identify(apart, model, names["text"]).filter("lang_pred <> 'und'"), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are repeated elsewhere; n_chars follows."""
    apart, names = _apart(docs)
    done = lines.drop_repeated_lines(apart, id_col=names["doc_id"], text_col=names["text"])
    return _own(done, names, text=F.col("kept_text"), n_chars=F.char_length("kept_text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies."""
    return neardup.keep_one(docs, neardup.near_duplicates(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    apart, names = _apart(docs)
    marked = decontam.mark_leaks(apart, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names["text"])
    return _own(marked.filter("leak_matches is null"), names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, numbered by copy (which replaces a column of that name)."""
    apart, names = _apart(docs)
    out = mixing.emit(mixing.mix(apart, id_col=names["doc_id"], text_col=names["text"], source_col=names["source"]), apart.columns)
    return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items() if c.lower() != "copy"], "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

# Trained models and verification around seeds are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages, a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
