"""Files as bytes: digests that stream whatever the size, fingerprints of folders, single files that appear at once.

All go through Hadoop's file systems, so paths of any store that Spark reads will do. Bytes are read and digested in
the JVM, a block at a time; the driver's Python sees digests only.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger

BLOCK = 8 << 20
#: Larger files than this are digested by the driver in blocks; smaller ones by the executors, whole.
WHOLE = 256 << 20


def _at(spark: SparkSession, path: str):
    """File system and path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def listing(spark: SparkSession, root: str) -> list[tuple[str, str, int, int]]:
    """(relative path, path, bytes, time) of a file, or of all files below a folder, in order of the relative path."""
    fs, target = _at(spark, root)
    whole = fs.getFileStatus(target)
    if whole.isFile():
        return [(target.getName(), whole.getPath().toString(), whole.getLen(), whole.getModificationTime())]
    base, found, files = whole.getPath().toString().rstrip("/") + "/", [], fs.listFiles(target, True)
    while files.hasNext():
        f = files.next()
        path = f.getPath().toString()
        found.append((path.removeprefix(base), path, f.getLen(), f.getModificationTime()))
    return sorted(found)


def _feed(spark: SparkSession, path: str, digest) -> None:
    jvm = spark.sparkContext._jvm
    fs, target = _at(spark, path)
    stream = jvm.java.security.DigestInputStream(fs.open(target), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, jvm.java.io.OutputStream.nullOutputStream(), BLOCK, True)


def _hex(digest) -> str:
    return bytes(digest.digest()).hex()


def _sha256(spark: SparkSession):
    return spark.sparkContext._jvm.java.security.MessageDigest.getInstance("SHA-256")


def manifest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, bytes, lines (line feeds), sha256 of every file below a folder.

    Files up to WHOLE bytes are read by the executors, larger ones streamed; a folder that is empty gives no rows.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    text = F.decode("content", "ISO-8859-1")
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    # The length is pushed down, so larger files are not read here.
    out = files.filter(F.col("length") <= WHOLE).select("path", F.col("length").alias("bytes"), lines.cast("long").alias("lines"), F.sha2("content", 256).alias("sha256"))
    for r in files.filter(F.col("length") > WHOLE).select("path", "length").collect():
        digest = _sha256(spark)
        _feed(spark, r["path"], digest)
        fs, target = _at(spark, r["path"])
        stream = fs.open(target)
        stream.seek(r["length"] - 1)
        ended = stream.read() == 10
        stream.close()
        rows = spark.read.option("lineSep", "\n").text(r["path"]).agg(F.count(F.lit(1)).alias("n"))
        big = rows.select(F.lit(r["path"]).alias("path"), F.lit(r["length"]).cast("long").alias("bytes"), (F.col("n") - F.lit(0 if ended else 1)).alias("lines"), F.lit(_hex(digest)).alias("sha256"))
        out = out.unionByName(big)
    return out


def snapshot_sha256(spark: SparkSession, root: str, cache: str | None = None, again: bool = False) -> str:
    """One digest of a model's snapshot: each file's relative path, NUL and bytes, in order of the path.

    cache: a folder that keeps digests by the files' names, sizes and times; again: don't trust it. Fails if there is
    no file, or if the files change while they are read.
    """
    files = listing(spark, root)
    state = [[name, size, time] for name, _, size, time in files]
    if not files:
        raise ValueError(f"no files in {root}")
    kept = f"{cache.rstrip('/')}/{hashlib.sha256(root.rstrip('/').encode()).hexdigest()}.json" if cache else None
    if kept and not again:
        fs, target = _at(spark, kept)
        if fs.exists(target):
            known = json.loads(spark.sparkContext._jvm.org.apache.hadoop.io.Text.decode(fs.open(target).readAllBytes()))
            if known["files"] == state:
                return known["sha256"]
    digest = _sha256(spark)
    for name, path, *_ in files:
        digest.update(bytearray(name.encode() + b"\0"))
        _feed(spark, path, digest)
    if [[name, size, time] for name, _, size, time in listing(spark, root)] != state:
        raise RuntimeError(f"{root} changed while it was read")
    value = _hex(digest)
    if kept:
        write_text(spark, kept, json.dumps({"files": state, "sha256": value}, sort_keys=True))
    return value


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, which replaces an earlier one at once."""
    fs, target = _at(spark, path)
    fs.mkdirs(target.getParent())
    _, part = _at(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    _swap(spark, part, target)


def _swap(spark: SparkSession, part, target) -> None:
    """Rename over what is there, which the file contexts of HDFS and of local disks do in one step."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, target, options)


def write_one_jsonl(rows: DataFrame, path: str, *order: str) -> None:
    """Rows as one JSONL file in canonical order, which replaces an earlier one at once.

    Spark writes the parts in order and in parallel. On a mounted file system tasks copy them into one file side by
    side (ledger.write_one); elsewhere the driver's file system strings them together, a block at a time.
    """
    spark = rows.sparkSession
    if _at(spark, path)[0].getScheme() == "file":
        ledger.write_one(rows, path, *order, nulls=False)
        return
    folder = f"{path}.{uuid.uuid4().hex[:8]}.parts"
    (rows.orderBy(*order) if order else rows).write.json(folder)
    fs, target = _at(spark, path)
    _, part = _at(spark, f"{folder}.tmp")
    out = fs.create(part, True)
    for name, piece, *_ in listing(spark, folder):
        if name.startswith("part-"):
            stream = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(piece))
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, BLOCK, False)
            stream.close()
    out.close()
    _swap(spark, part, target)
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)
