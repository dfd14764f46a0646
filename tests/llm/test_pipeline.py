"""The pipeline, stage by stage, against plain versions of what each has to do."""

import re

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tokenlab.llm import queries
from tokenlab.llm.shared import materialise

DATA = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, docs := stage(spark, docs, DATA).cache())
        assert name == "mixing" or docs.columns == columns
    before, after = seen["language_id"]
    letters = {r["doc_id"] for r in before.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert {r["doc_id"] for r in after.collect()} == letters
    before, after = seen["line_dedup"]
    assert before.count() == after.count() and all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen["near_dedup"]
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", r["text"].lower())] for i in range(max(1, len(w) - 4))} for r in before.collect()}
    kept = [r["doc_id"] for r in after.collect()]
    pairs = [(a, b) for i, a in enumerate(kept) for b in kept[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not pairs and set(kept) <= set(sets)
    for gone in set(sets) - set(kept):
        assert any(x != gone and len(sets[gone] & sets[x]) >= 0.8 * len(sets[gone] | sets[x]) for x in sets)
    before, after = seen["decontamination"]
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    holds = {r["doc_id"] for r in before.collect() if any(f" {i} " in f" {' '.join(re.findall(r'\w+', r['text'].lower()))} " for i in items)}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == holds
    before, after = seen["mixing"]
    assert after.groupBy("doc_id").count().filter("count > 2").count() == 0
    assert after.filter(after["copy"] == 1).count() <= before.count()


def test_run_agrees_with_the_stages(spark):
    """run() is the stages one after the other, each on the table that the one before it left."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), f"test-{name}")
    key = lambda d: sorted(map(str, d.select("doc_id", "copy", "n_chars", "text", "source", "lang").collect()))
    assert key(corpus_pipeline.run(spark, DATA)) == key(docs) and docs.count() > 100


ODD_DOCS = [
    (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "word " * 60_000, "en", "s", 300_000, "x"), (3, "word " * 60_000, "en", "s", 300_000, "x"), (3, "another text of the same id, which stays", "en", "s", 40, "x"),
    (None, "a text without an id", "fr", "s", 20, "x"), (None, None, None, None, None, None), (5, "!!! 123", "de", None, 7, "x"), (6, "tie tie", "en", "t", 7, "y"), (7, "tie tie", "en", "t", 7, "y"),
]
CLASHES = ("row", "score", "n_lines", "kept_text", "label", "hash", "leak_item", "leaks", "size", "copies", "Target")


def odd_docs(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for c in CLASHES[1:]:
        d = d.withColumn(c, F.lit(f"own {c}"))
    return d


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_stand_odd_and_empty_tables(spark, name):
    """Nulls in any column, empty and very long texts, repeats, ties, and columns named like those that operators add."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd_docs(spark, ODD_DOCS)
    out = stage(spark, docs, DATA)
    got = [r.asDict() for r in out.collect()]
    ids = sorted((r["doc_id"] for r in got), key=str)
    every = sorted((r[0] for r in ODD_DOCS), key=str)
    want = {
        "language_id": sorted([3, 3, 3, None, 6, 7], key=str), "line_dedup": every, "decontamination": every,
        "near_dedup": sorted([1, 3, 3, None, None, 5, 6], key=str),
    }
    if name == "mixing":
        assert set(docs.columns) < set(out.columns) and all(ids.count(i) <= 2 * every.count(i) for i in set(ids))
    else:
        assert ids == want[name] and out.columns == docs.columns
    assert all(r[c] == f"own {c}" for r in got for c in CLASHES[1:]) and {r["row"] for r in got} <= {"x", "y", None}
    assert stage(spark, odd_docs(spark, []), DATA).count() == 0


def test_a_leak_with_substitutions_goes(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()["text"].split()
    changed = ["changed" if i % 9 == 4 else w for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "quite clean"), (2, " ".join(["before", *changed, "after"]))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, DATA).collect()] == [1]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, DATA), c.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    assert sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
