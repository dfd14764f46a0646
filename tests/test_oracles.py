"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from tokenlab.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(float(v), 8)) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_anchor_counts(spark):
    rows = {r["definition"]: r for r in registry.QUERIES["three_arm_summary"](spark, "/root/testdata/sf0.01").filter("dataset = 'all'").collect()}
    want = {"strict_all_wrong": (2580, 744, 825, 190, 109), "plurality_wrong": (3306, 945, 1047, 239, 137), "first_chain_wrong": (5130, 1476, 1653, 383, 206)}
    for k, v in want.items():
        r = rows[k]
        assert (r["n_eligible"], r["samecap_repair_count"], r["long_repair_count"], r["incremental_helpful_count"], r["incremental_harmful_count"]) == v
