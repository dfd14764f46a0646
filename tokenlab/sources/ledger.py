"""Appends that count once, and single files written by tasks: a data source with its own commit protocol."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import blocks

#: Bytes that are copied together.
CHUNK = 8 << 20
#: Attempts to add a version beside other writers.
TRIES = 50


def _uri(path: str) -> str:
    """path with its scheme; Hadoop writes local ones with a single slash."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return f"file://{path[5:]}"
    return path if "://" in path else f"file://{path}"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(_uri(path).rstrip("/"))


def versions(path: str) -> list[int]:
    store, own = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{own}/log", allow_not_found=True))
    return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".json"))


def manifest(path: str) -> dict:
    """batches (by name, their parts with numbers of rows and bytes) of the last version; without any, none."""
    numbers = versions(path)
    if not numbers:
        return {"version": 0, "batches": {}}
    store, own = _store(path)
    with store.open_input_file(f"{own}/log/{numbers[-1]:010d}.json") as f:
        return json.loads(f.read()) | {"version": numbers[-1]}


def _claim(store: fs.FileSystem, name: str, data: bytes) -> bool:
    """Write a file unless it is there already: whole and by one writer only."""
    if isinstance(store, fs.LocalFileSystem):
        import os

        part = f"{name}.{uuid.uuid4().hex[:12]}"
        with open(part, "wb") as f:
            f.write(data)
        try:
            os.link(part, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    # Elsewhere the writer whose bytes stay has won; each names itself in them.
    if store.get_file_info(name).type != fs.FileType.NotFound:
        return False
    with store.open_output_stream(name) as f:
        f.write(data)
    with store.open_input_file(name) as f:
        return f.read() == data


def commit(path: str, batch: str, parts: list[dict], after: int | None = None) -> bool:
    """Add a batch to the log as its next version; False if the batch is there already, whoever wrote it.

    after: the version that the batch was made from; False too if there is a later one by now.
    """
    store, own = _store(path)
    store.create_dir(f"{own}/log", recursive=True)
    for _ in range(TRIES):
        state = manifest(path)
        if batch in state["batches"] or (after is not None and state["version"] != after):
            return False
        wanted = {"batches": state["batches"] | {batch: parts}, "writer": uuid.uuid4().hex}
        if _claim(store, f"{own}/log/{state['version'] + 1:010d}.json", json.dumps(wanted).encode()):
            return True
    raise RuntimeError(f"{path}: other writers were faster {TRIES} times")


@dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: int
    size: int
    number: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.batch, self.packed = options["path"], options["batch"], options.get("packed") == "true"

    def write(self, iterator) -> WriterCommitMessage:
        """One part of lines, under a name that no other attempt has; it counts once a version lists it."""
        from pyspark import TaskContext

        store, own = _store(self.path)
        store.create_dir(f"{own}/parts", recursive=True)
        name, rows, size = f"{uuid.uuid4().hex}.jsonl", 0, 0
        lines = (row[0].encode() for row in iterator)
        with store.open_output_stream(f"{own}/parts/{name}", compression=None) as f:
            for data, n in blocks.pack(lines) if self.packed else ((line + b"\n", 1) for line in lines):
                f.write(data)
                rows, size = rows + n, size + len(data)
        return _Part(name, rows, size, TaskContext.get().partitionId())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        if not commit(self.path, self.batch, [{"name": m.name, "rows": m.rows, "bytes": m.size} for m in parts if m.rows]):
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, own = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{own}/parts/{m.name}")


class Ledger(DataSource):
    """Lines in parts, of which a log of versions tells those that count."""

    @classmethod
    def name(cls) -> str:
        return "ledger_jsonl"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a ledger is only appended to")
        return _Writer(self.options)


def append(rows: DataFrame, path: str, batch: str, nulls: bool = True) -> None:
    """Add rows as JSON lines under a batch's name; a batch that is there already is not added again.

    Attempts that are killed or repeated leave parts that no version lists; vacuum() removes them. nulls: whether fields
    that are null are written.
    """
    _append(rows, path, batch, nulls)


def _append(rows: DataFrame, path: str, batch: str, nulls: bool, packed: bool = False) -> None:
    rows.sparkSession.dataSource.register(Ledger)
    lines = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": str(not nulls).lower()}).alias("line"))
    lines.write.format("ledger_jsonl").mode("append").options(path=_uri(path), batch=batch, packed=str(packed).lower()).save()


def read(spark: SparkSession, path: str, schema, batches: list[str] | None = None) -> DataFrame:
    """Rows of all batches (or some), of the last version as the call finds it."""
    own = manifest(path)["batches"]
    names = [f"{_uri(path).rstrip('/')}/parts/{p['name']}" for b, parts in own.items() if batches is None or b in batches for p in parts]
    return spark.read.schema(schema).option("mode", "FAILFAST").json(names) if names else spark.createDataFrame([], schema)


def vacuum(path: str) -> int:
    """Remove parts that no version lists; only while nobody writes. The number of parts removed."""
    store, own = _store(path)
    listed = {p["name"] for parts in manifest(path)["batches"].values() for p in parts}
    gone = [f for f in store.get_file_info(fs.FileSelector(f"{own}/parts", allow_not_found=True)) if f.base_name not in listed]
    for f in gone:
        store.delete_file(f.path)
    return len(gone)


def write_one(rows: DataFrame, path: str, *order: str, nulls: bool = True) -> None:
    """Rows as one JSONL file in canonical order, which replaces an earlier one at once; tasks copy the bytes.

    Parts are written in order through a ledger of their own. Their sizes tell where each belongs, so tasks write the
    parts side by side into one file; a rename puts it in place. A repeated task writes the same bytes to the same
    place. For file systems that can be written at an offset (local and mounted ones); others are refused. A path that
    ends in .zst gets compressed blocks of lines.
    """
    spark, target = rows.sparkSession, _uri(path)
    store, own = _store(target)
    if not isinstance(store, fs.LocalFileSystem):
        raise ValueError(f"{path}: only a mounted file system can be written by many tasks at once")
    staged, part = f"{target}.{uuid.uuid4().hex[:8]}.parts", f"{own}.{uuid.uuid4().hex[:8]}.tmp"
    _append(rows.orderBy(*order) if order else rows, staged, "all", nulls, blocks.packed(path))
    parts, at, places = manifest(staged)["batches"]["all"], 0, []
    for p in parts:
        places.append((f"{_store(staged)[1]}/parts/{p['name']}", at, p["bytes"]))
        at += p["bytes"]
    with open(part, "wb") as f:
        f.truncate(at)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(name, "rb") as source, open(part, "r+b") as out:
                    out.seek(start)
                    while data := source.read(CHUNK):
                        out.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["bytes"])

    if places:
        frame = spark.createDataFrame(places, "name string, start long, bytes long").repartition(len(places), "name")
        copied = frame.mapInArrow(copy, "bytes long").agg(F.sum("bytes")).first()[0]
        if copied != at:
            raise RuntimeError(f"{copied} bytes of {at} were copied")
    store.move(part, own)
    store.delete_dir(_store(staged)[1])
