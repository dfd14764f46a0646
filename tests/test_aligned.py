"""Aligned scans, appends that count once, single files written by tasks."""

import json
import os
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenlab.sources import aligned, blocks, ledger

SCHEMA = "problem_id string, v int, pad string"


def write(path, ids, tag, pad=lambda i: "x" * (i * 37 % 90), end="\n"):
    path.write_text("".join(json.dumps({"problem_id": p, "v": i, "pad": tag + pad(i)}) + "\n" for i, p in enumerate(ids)).rstrip("\n") + end)
    return str(path)


@pytest.mark.parametrize("end", ["\n", ""])
@pytest.mark.parametrize("split", [200, 4096, 64 << 20])
def test_files_are_read_side_by_side(spark, tmp_path, split, end):
    ids = [f"p{i:04d}" for i in range(300)]
    a, b, c = (write(tmp_path / f"{k}.jsonl", ids, k, pad, end) for k, pad in (("a", lambda i: "y" * (i % 7)), ("b", lambda i: "é" * (i * 13 % 400)), ("c", lambda i: "")))
    rows = aligned.read_aligned(spark, SCHEMA, split=split, ordered=True, a=a, b=b, c=c)
    got = rows.orderBy("record").collect()
    assert [r["problem_id"] for r in got] == ids and [r["record"] for r in got] == list(range(300))
    assert all(r[k]["v"] == i and r[k]["pad"].startswith(k) for i, r in enumerate(got) for k in "abc")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    if split == 200:
        parts = {r["p"] for r in rows.select(F.spark_partition_id().alias("p")).collect()}
        assert len(parts) > 30


@pytest.mark.parametrize("split", [150, 64 << 20])
def test_what_is_not_aligned_is_found(spark, tmp_path, split):
    ids = [f"p{i:04d}" for i in range(60)]
    good = write(tmp_path / "a.jsonl", ids, "a")
    for name, other, said in [("moved", ids[:20] + [ids[21], ids[20]] + ids[22:], "different ids"), ("short", ids[:-1], "ends before record 59"), ("long", [*ids, "p9999"], "ends before record 60"), ("none", [*ids[:30], None, *ids[31:]], "record 30 of .* has no problem_id")]:
        bad = write(tmp_path / f"{name}.jsonl", other, "b")
        with pytest.raises(Exception, match=said):
            aligned.read_aligned(spark, SCHEMA, split=split, a=good, b=bad).collect()
    again = [*ids[:41], ids[40], *ids[41:]]
    x, y = write(tmp_path / "x.jsonl", again, "x"), write(tmp_path / "y.jsonl", again, "y")
    with pytest.raises(Exception, match="record 41 repeats"):
        aligned.read_aligned(spark, SCHEMA, split=split, a=x, b=y).collect()
    far = [*ids, ids[3]]
    x, y = write(tmp_path / "x.jsonl", far, "x"), write(tmp_path / "y.jsonl", far, "y")
    with pytest.raises(Exception, match="repeats an id or is out of order"):
        aligned.read_aligned(spark, SCHEMA, split=split, ordered=True, a=x, b=y).collect()
    (tmp_path / "e.jsonl").write_text("")
    empty = str(tmp_path / "e.jsonl")
    assert aligned.read_aligned(spark, SCHEMA, split=split, a=empty, b=empty).collect() == []
    with pytest.raises(Exception, match="ends before record 0"):
        aligned.read_aligned(spark, SCHEMA, split=split, a=good, b=empty).collect()


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.range(100).select(F.col("id").cast("string").alias("problem_id"), F.col("id").cast("int").alias("v"), F.lit(None).cast("string").alias("pad"))
    for _ in range(3):
        ledger.append(rows.repartition(4), path, "first")
    ledger.append(rows.withColumn("v", F.col("v") + 1000), path, "second")
    got = ledger.read(spark, path, SCHEMA).collect()
    assert len(got) == 200 and sorted(r["v"] for r in got) == [*range(100), *range(1000, 1100)] and ledger.versions(path) == [1, 2]
    assert ledger.read(spark, path, SCHEMA, ["second"]).count() == 100 and ledger.read(spark, str(tmp_path / "no"), SCHEMA).count() == 0
    assert ledger.vacuum(path) == 0


def test_killed_attempts_leave_nothing_that_counts(spark, tmp_path):
    """A job that dies half way, after some parts are written, adds no record; the next attempt adds each once."""
    path = str(tmp_path / "ledger")
    broken = F.when(F.col("id") == 77, F.raise_error(F.lit("killed"))).otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 100, 1, 4).select(F.col("id").cast("string").alias("problem_id"), F.col("id").cast("int").alias("v"), broken.alias("pad"))
    with pytest.raises(Exception, match="killed"):
        ledger.append(rows, path, "b")
    assert ledger.manifest(path)["batches"] == {} and ledger.read(spark, path, SCHEMA).count() == 0
    ledger.append(rows.withColumn("pad", F.lit("")), path, "b")
    assert ledger.read(spark, path, SCHEMA).count() == 100
    ledger.vacuum(path)
    assert ledger.read(spark, path, SCHEMA).count() == 100 and len(os.listdir(f"{path}/parts")) == 4


def test_writers_at_once_all_count(tmp_path):
    path = str(tmp_path / "ledger")
    threads = [threading.Thread(target=ledger.commit, args=(path, f"b{i % 6}", [{"name": str(i), "rows": 1, "bytes": 1}])) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    state = ledger.manifest(path)
    assert sorted(state["batches"]) == [f"b{i}" for i in range(6)] and state["version"] == 6 and len(ledger.versions(path)) == 6


def test_one_file_in_order(spark, tmp_path):
    path = tmp_path / "one.jsonl"
    path.write_text("old")
    rows = spark.range(0, 5000, 1, 8).select(F.col("id"), F.repeat(F.lit("é"), (F.col("id") % 9).cast("int")).alias("t")).orderBy(F.rand(3))
    ledger.write_one(rows, str(path), "id")
    got = [json.loads(line) for line in path.read_text().splitlines()]
    assert [r["id"] for r in got] == list(range(5000)) and got[8]["t"] == "é" * 8
    assert os.listdir(tmp_path) == ["one.jsonl"]
    ledger.write_one(rows.limit(0), str(path))
    assert path.read_text() == ""


def pack(path, block):
    """A plain file in compressed blocks beside it."""
    out = f"{path}{blocks.SUFFIX}"
    with open(path, "rb") as f, open(out, "wb") as g:
        g.writelines(data for data, _ in blocks.pack((line.rstrip(b"\n") for line in f), block))
    return out


@pytest.mark.parametrize("split,which", [(40, "abc"), (700, "abc"), (700, "ab"), (700, "c"), (64 << 20, "abc")])
def test_compressed_files_are_read_side_by_side(spark, tmp_path, split, which):
    """Blocks of one line, of some and of all; plain files beside them."""
    ids = [f"p{i:04d}" for i in range(300)]
    pads = {"a": lambda i: "y" * (i % 7), "b": lambda i: "é" * (i * 13 % 400), "c": lambda i: ""}
    paths = {k: write(tmp_path / f"{k}.jsonl", ids, k, pad) for k, pad in pads.items()}
    if split == 40:
        ids, paths = ids[:9], {k: write(tmp_path / f"{k}.jsonl", ids[:9], k, pad) for k, pad in pads.items()}
    paths |= {k: pack(paths[k], {"a": 500, "b": 1, "c": 9000}[k] if split > 40 else 1) for k in which}
    rows = aligned.read_aligned(spark, SCHEMA, split=split, ordered=True, **paths)
    got = rows.select("*", F.spark_partition_id().alias("part")).orderBy("record").collect()
    assert [r["problem_id"] for r in got] == ids and [r["record"] for r in got] == list(range(len(ids)))
    assert all(r[k]["v"] == i and r[k]["pad"] == k + pads[k](i) for i, r in enumerate(got) for k in "abc")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    parts = len({r["part"] for r in got})
    # Of nine blocks of a line, cuts come behind the first line of all but the first.
    assert parts == 8 if split == 40 else parts > 8 if split == 700 else parts == 1


@pytest.mark.parametrize("split", [100, 64 << 20])
def test_what_is_not_aligned_is_found_in_compressed_files(spark, tmp_path, split):
    ids = [f"p{i:04d}" for i in range(12)]
    file = lambda name, own: pack(write(tmp_path / f"{name}.jsonl", own, name), 90)
    good = file("a", ids)
    for name, other, said in [("moved", [*ids[:5], ids[6], ids[5], *ids[7:]], "different ids"), ("short", ids[:-1], "ends before record 11"), ("long", [*ids, "p9999"], "ends before record 12"), ("none", [*ids[:7], None, *ids[8:]], "record 7 of .* has no problem_id")]:
        with pytest.raises(Exception, match=said):
            aligned.read_aligned(spark, SCHEMA, split=split, a=good, b=file(name, other)).collect()
    again = [*ids[:6], ids[5], *ids[6:]]
    with pytest.raises(Exception, match="record 6 repeats"):
        aligned.read_aligned(spark, SCHEMA, split=split, a=file("x", again), b=file("y", again)).collect()
    empty = file("empty", [])
    os.truncate(empty, 0)
    assert aligned.read_aligned(spark, SCHEMA, split=split, a=empty, b=empty).collect() == []
    with pytest.raises(Exception, match="ends before record 0"):
        aligned.read_aligned(spark, SCHEMA, split=split, a=good, b=empty).collect()
    os.truncate(good, os.path.getsize(good) - 3)
    with pytest.raises(Exception, match="cut short"):
        aligned.read_aligned(spark, SCHEMA, split=64 << 20, a=good, b=good).collect()
    (tmp_path / "other.zst").write_bytes(b"no blocks in here, but more than the bytes of a head")
    with pytest.raises(Exception, match="no block at byte 0"):
        aligned.read_aligned(spark, SCHEMA, a=str(tmp_path / "other.zst")).collect()


def test_one_compressed_file_in_order(spark, tmp_path):
    """Any reader of zstd can read it; its parts are compressed too, and gone afterwards."""
    path = tmp_path / "one.jsonl.zst"
    rows = spark.range(0, 5000, 1, 8).select(F.col("id"), F.repeat(F.lit("é"), (F.col("id") % 9).cast("int")).alias("t")).orderBy(F.rand(3))
    ledger.write_one(rows, str(path), "id")
    with pa.input_stream(str(path), compression="zstd") as f:
        got = [json.loads(line) for line in f.read().decode().splitlines()]
    assert [r["id"] for r in got] == list(range(5000)) and got[8]["t"] == "é" * 8
    assert os.listdir(tmp_path) == ["one.jsonl.zst"] and path.stat().st_size < 40_000
    ledger.write_one(rows.limit(0), str(path))
    assert path.read_bytes() == b""


def test_blocks_are_found_in_any_range(tmp_path):
    path = pack(write(tmp_path / "a.jsonl", [f"p{i}" for i in range(50)], "a"), 200)
    with pa.OSFile(path) as f:
        whole = list(blocks.heads(f, path, 0, f.size()))
        assert len(whole) > 5 and sum(n for *_, n in whole) == 50 and whole[-1][1] == f.size()
        for step in (1, 7, 61, 1000):
            found = [x for at in range(0, f.size(), step) for x in blocks.heads(f, path, at, min(at + step, f.size()))]
            assert found == whole
