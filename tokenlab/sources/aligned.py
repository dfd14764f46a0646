"""Aligned JSONL files read side by side: a data source that cuts all files at common records, without a shuffle.

Files are plain, or compressed in blocks (blocks.py) if their names end in .zst.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import blocks
from .ledger import _uri

#: Bytes of the first file for one partition, and bytes that are read together.
SPLIT, CHUNK = 64 << 20, 4 << 20
#: Rows of a batch.
ROWS = 512
_SCHEMA = "key string, record long, {}"


class Misaligned(ValueError):
    pass


def _ranges(spark: SparkSession, paths: list[str], split: int) -> DataFrame:
    """file (its number), start and end of ranges of all files, dealt to tasks."""
    rows = []
    for i, path in enumerate(paths):
        store, own = fs.FileSystem.from_uri(path)
        size = store.get_file_info(own).size or 0
        rows += [(i, start, min(start + split, size)) for start in range(0, size, split)]
    frame = spark.createDataFrame(rows, "file int, start long, stop long")
    return frame.repartition(max(1, len(rows)), "file", "start") if rows else frame


def _line_ends(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of a range, with where each begins."""
    store, own = fs.FileSystem.from_uri(path)
    with store.open_input_file(own) as f:
        f.seek(start)
        while start < stop:
            data = f.read(min(CHUNK, stop - start))
            if not data:
                return
            yield start, data
            start += len(data)


def splits(spark: SparkSession, paths: list[str], split: int = SPLIT) -> list[dict]:
    """Where partitions begin: record number, and in each file an offset and the number of lines to pass over there.

    Tasks count the line ends of each block; the first file's blocks say at which records to cut, and tasks look for
    these records' offsets within the one block of each other file that holds them. Bytes are read twice at most. Of
    compressed files only the heads of blocks are read, and lines within a block are passed over by the reader. The
    driver sees a row per block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blocks.packed(paths[file]):
                    store, own = fs.FileSystem.from_uri(paths[file])
                    with store.open_input_file(own) as f:
                        found = [(file, *x) for x in blocks.heads(f, paths[file], start, stop)]
                else:
                    found = [(file, start, stop, stop - start, sum(data.count(b"\n") for _, data in _line_ends(paths[file], start, stop)))]
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x, strict=True)) for x in found], kind)

    kind = pa.schema([("file", pa.int32()), *[(c, pa.int64()) for c in ("start", "stop", "bytes", "n")]])
    counted = sorted(tuple(r) for r in _ranges(spark, paths, split).mapInArrow(count, "file int, start long, stop long, bytes long, n long").collect())
    before, at = [], {}
    for file, *_, n in counted:
        before.append(at.get(file, 0))
        at[file] = before[-1] + n
    # A cut behind the first line end of blocks of the first file, `split` bytes of lines apart: records wanted in all files.
    cuts, since = [], 0
    for seen, (file, _, _, size, n) in zip(before, counted, strict=True):
        if file == 0:
            if since >= split and n:
                cuts.append(seen + 1)
                since = 0
            since += size
    wanted, out = [], {}
    for seen, (file, start, stop, _, n) in zip(before, counted, strict=True):
        own = cuts[bisect_right(cuts, seen) : bisect_right(cuts, seen + n)]
        if blocks.packed(paths[file]):
            for c in own:
                out.setdefault(c, {})[file] = (start, c - seen)
        elif own:
            wanted.append((file, seen, start, stop, own))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, seen, start, stop, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, places = list(own), []
                for at, data in _line_ends(paths[file], start, stop):
                    n = data.count(b"\n")
                    while left and left[0] <= seen + n:
                        end = -1
                        for _ in range(left[0] - seen):
                            end = data.index(b"\n", end + 1)
                        places.append(at + end + 1)
                        left.pop(0)
                    seen += n
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(places), pa.int32()), pa.array(own[: len(places)], pa.int64()), pa.array(places, pa.int64())], names=["file", "record", "offset"])

    if wanted:
        frame = spark.createDataFrame(wanted, "file int, seen long, start long, stop long, own array<long>").repartition(len(wanted), "file", "start")
        for r in frame.mapInArrow(find, "file int, record long, offset long").collect():
            out.setdefault(r["record"], {})[r["file"]] = (r["offset"], 0)
    # A record that some file lacks is found by the reader, as the end of that file.
    whole = [{"record": 0, "offsets": [0] * len(paths), "over": [0] * len(paths)}]
    return whole + [{"record": c, "offsets": [out[c][i][0] for i in range(len(paths))], "over": [out[c][i][1] for i in range(len(paths))]} for c in cuts if len(out.get(c, {})) == len(paths)]


class _Partition(InputPartition):
    """Where a partition begins; the offsets and the record at which the next one does, None for the last."""

    def __init__(self, here: dict, after: dict | None):
        self.record, self.offsets, self.over = here["record"], here["offsets"], here["over"]
        self.ends = after["offsets"] if after else [None] * len(self.offsets)
        self.rows = after["record"] - self.record if after else None

    def lines(self, paths: list[str]) -> list[_Lines | _BlockLines]:
        of = lambda path, start, over, stop: _BlockLines(path, start, over, self.rows) if blocks.packed(path) else _Lines(path, start, stop)
        return [of(*x) for x in zip(paths, self.offsets, self.over, self.ends, strict=True)]


class _Lines:
    """Lines of a range of a file; `before` is the line that ends where the range begins."""

    def __init__(self, path: str, start: int, stop: int | None):
        store, own = fs.FileSystem.from_uri(path)
        self.file, self.path = store.open_input_file(own), path
        self.left = (self.file.size() if stop is None else stop) - start
        self.rest, self.lines, self.at, self.before = b"", [], 0, None
        back = CHUNK
        while start and self.before is None:
            self.file.seek(max(0, start - back))
            lines = self.file.read(min(back, start)).split(b"\n")
            if len(lines) > 2 or back >= start:
                self.before = lines[-2]
            back *= 4
        self.file.seek(start)

    def next(self) -> bytes | None:
        while self.at >= len(self.lines):
            data = self.file.read(min(CHUNK, self.left)) if self.left > 0 else b""
            if not data:
                last, self.rest = self.rest, b""
                return last or None
            self.left -= len(data)
            self.lines = (self.rest + data).split(b"\n")
            self.rest, self.at = self.lines.pop(), 0
        self.at += 1
        return self.lines[self.at - 1]


class _BlockLines:
    """The same of a file in blocks: what comes after `over` lines of the block at start, `rows` lines or all."""

    def __init__(self, path: str, start: int, over: int, rows: int | None):
        store, own = fs.FileSystem.from_uri(path)
        self.file, self.path, self.left = store.open_input_file(own), path, rows
        self.lines, self.at, self.before = [], 0, None
        self.file.seek(start)
        if over:
            self.lines, self.at = blocks.unpack(self.file, path), over
            self.before = self.lines[over - 1]

    def next(self) -> bytes | None:
        if self.left == 0:
            return None
        while self.at >= len(self.lines):
            self.lines, self.at = blocks.unpack(self.file, self.path), 0
            if self.lines is None:
                self.lines = []
                return None
        if self.left is not None:
            self.left -= 1
        self.at += 1
        return self.lines[self.at - 1]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.key, self.ordered = json.loads(options["paths"]), options["key"], options["ordered"] == "true"
        self.splits = json.loads(options["splits"])

    def partitions(self) -> list[InputPartition]:
        return [_Partition(*x) for x in zip(self.splits, [*self.splits[1:], None], strict=True)]

    def _id(self, line: bytes, path: str, record: int) -> str:
        found = json.loads(line).get(self.key) if line.strip() else None
        if found is None:
            raise Misaligned(f"record {record} of {path} has no {self.key}")
        return str(found)

    def read(self, partition: _Partition) -> Iterator[pa.RecordBatch]:
        files = partition.lines(self.paths)
        record, rows, seen = partition.record, [], set()
        last = self._id(files[0].before, files[0].path, record - 1) if files[0].before is not None else None
        while True:
            lines = [f.next() for f in files]
            if None in lines:
                if any(line is not None for line in lines):
                    raise Misaligned(f"{self.paths[lines.index(None)]} ends before record {record}")
                break
            ids = [self._id(line, path, record) for line, path in zip(lines, self.paths, strict=True)]
            if len(set(ids)) > 1:
                raise Misaligned(f"record {record} has different ids: {ids}")
            if ids[0] in seen or ids[0] == last or (self.ordered and last is not None and ids[0] < last):
                raise Misaligned(f"record {record} repeats an id or is out of order: {ids[0]}")
            if not self.ordered:
                seen.add(ids[0])
            last = ids[0]
            rows.append((ids[0], record, *[line.decode() for line in lines]))
            record += 1
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * len(self.paths)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "record", *[f"r{i}" for i in range(len(self.paths))]])


class AlignedJsonl(DataSource):
    """key, record (its number) and the line of each file."""

    @classmethod
    def name(cls) -> str:
        return "aligned_jsonl"

    def schema(self) -> str:
        return _SCHEMA.format(", ".join(f"r{i} string" for i in range(len(json.loads(self.options["paths"])))))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_aligned(spark: SparkSession, schema, key: str = "problem_id", ordered: bool = False, split: int = SPLIT, **paths: str) -> DataFrame:
    """key, record, and a struct for each named file, of the records that stand in the same place of all files.

    The files are read side by side, partition by partition, without a shuffle; the job fails at the first record whose
    ids differ, that a file lacks, or that has no id. Repeated ids are found within a partition and at its borders;
    with ordered (ids ascending in each file, as the canonical order has them) wherever they are. Blank lines are
    records without an id; an empty last line is none.
    """
    uris = [_uri(p) for p in paths.values()]
    spark.dataSource.register(AlignedJsonl)
    lines = spark.read.format("aligned_jsonl").options(paths=json.dumps(uris), key=key, ordered=str(ordered).lower(), splits=json.dumps(splits(spark, uris, split))).load()
    return lines.select(F.col("key").alias(key), "record", *[F.from_json(f"r{i}", schema, {"mode": "FAILFAST"}).alias(n) for i, n in enumerate(paths)])
