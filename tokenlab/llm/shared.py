"""Helpers that the corpus operators share: the shared folder, tables in it, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the session names none, as in local tests, a temporary one is set. On a cluster that is refused: executors
    would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tokenlab-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_MADE: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; removed when Python ends."""
    path = f"{shared_dir(spark)}/tokenlab-{name}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(remove_folders)
    _MADE.append((spark, path))
    return path


def remove_folders() -> None:
    """Delete every folder that new_folder() has named in this process."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_struct(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of docs but those named in `without` (names that an operator is about to add)."""
    low = {x.lower() for x in without}
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in low])


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """A column's texts, of which `rows` are Python objects at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which freed memory goes back to the system: Python workers stay for the next task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


class WordHashes(dict):
    """word -> 64-bit hash, remembered for words seen before.

    What it holds is bounded in bytes: words of more than `longest` characters are not remembered, and it is emptied
    when it grows past `most` words.
    """

    def __init__(self, most: int = 1 << 17, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


_TOKEN, _GAP = re.compile(r"\w+"), re.compile(r"\W")


def token_pieces(text: str | None, size: int = 1 << 20) -> Iterator[list[str]]:
    """Lower-cased runs of word characters of a whole text, in lists of bounded size; no run is cut."""
    low, at = (text or "").lower(), 0
    while at < len(low):
        gap = _GAP.search(low, at + size) if len(low) > at + size else None
        end = gap.start() if gap else len(low)
        if found := _TOKEN.findall(low, at, end):
            yield found
        at = end


def token_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of a text's tokens."""
    parts = [np.fromiter(map(hashes.__getitem__, p), dtype=np.uint64, count=len(p)) for p in token_pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
