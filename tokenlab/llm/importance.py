"""Importance resampling towards a target: hashed n-grams by suffix arrays of word ids, Gumbel top-k."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, released, row_struct

#: Words of which one suffix array is made, and bytes of a text that are split together.
BLOCK, BYTES = 1 << 19, 1 << 20
#: Texts whose buckets are sent together.
ROWS = 1024
OUT = ("n_words", "n_features", "weight", "score", "rank")

# Words are digits, letters a-z, and whatever is not ASCII; A-Z are lower-cased, all else parts them.
_WORDS = bytes(b if b >= 0x80 or chr(b) in digits + ascii_lowercase else 0x20 for b in bytes.maketrans(ascii_uppercase.encode(), ascii_lowercase.encode()))


class _Ids(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def stretches(text: str | None, lap: int) -> Iterator[tuple[list[bytes], int]]:
    """Words of a whole text in lists of bounded size, and how many of them the list before held too (at most lap)."""
    data, at, held = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS), 0, []
    while at < len(data):
        end = data.find(b" ", at + BYTES)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        if words:
            yield held + words, len(held)
            held = (held + words)[-lap:] if lap else []
        at = end + 1


def run_buckets(words: list[bytes], left: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of each run of 1 to `order` words by its first word's place and its length; -1 where a text ends before.

    left: words from each place to its text's end. Places are sorted by their first `order` word ids (a suffix array cut
    to that depth). Neighbours that agree in n words hold the same n-gram, so each maximal run of such neighbours is
    hashed once, and its bucket goes to all places of the run.
    """
    vocabulary = _Ids()
    ids = np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int32, count=len(words))
    ahead = np.full((order, len(ids)), -1, dtype=np.int32)
    for k in range(order):
        ahead[k, : max(0, len(ids) - k)] = ids[k:]
        ahead[k, left <= k] = -1
    suffixes = np.lexsort(ahead[::-1]) if order > 1 else np.argsort(ids, kind="stable")
    out = np.full((len(ids), order), -1, dtype=np.int32)
    differ = np.zeros(max(0, len(ids) - 1), dtype=bool)
    for k in range(order):
        column = ahead[k, suffixes]
        differ |= column[1:] != column[:-1]
        starts = np.flatnonzero(np.append(True, differ))[: len(ids)]
        whole = column[starts] >= 0
        found = [zlib.crc32(b" ".join(words[i : i + k + 1])) % buckets for i in suffixes[starts[whole]].tolist()]
        of_run = np.full(len(starts), -1, dtype=np.int32)
        of_run[whole] = found
        out[suffixes, k] = np.repeat(of_run, np.diff(np.append(starts, len(ids))))
    return out


def features(docs: DataFrame, order: int = 1, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """row (docs' columns but the text and those of OUT), n_words, buckets: of all runs of 1 to `order` words of each text.

    A null text has none. Suffix arrays are over blocks of a partition's texts, of bounded size; a longer text is taken
    in stretches that overlap by order - 1 words. buckets: crc32 of the run's UTF-8 bytes, words joined by a space.
    """
    bare = all(c.lower() in (text_col.lower(), *OUT) for c in docs.columns)
    row = F.struct(F.lit(0).alias("none")) if bare else row_struct(docs, (text_col, *OUT))
    shaped = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))

    def of_texts(texts: list[str | None]) -> tuple[list[list[np.ndarray]], list[int]]:
        made, counts = [[] for _ in texts], [0] * len(texts)
        words, parts = [], []  # parts: text, words, of these repeated by the next stretch

        def flush() -> None:
            left = np.concatenate([np.arange(n, 0, -1) for _, n, _ in parts])
            got, at = run_buckets(words, left, order, buckets), 0
            for row, n, known in parts:
                own = got[at : at + n].copy()
                # Runs inside the words that the stretch before held are counted there.
                for k in range(known):
                    own[: max(0, known - k), k] = -1
                made[row].append(own[own >= 0])
                at += n
            words.clear()
            parts.clear()

        for row, text in enumerate(texts):
            for own, known in stretches(text, order - 1):
                words.extend(own)
                parts.append((row, len(own), known))
                counts[row] += len(own) - known
                if len(words) >= BLOCK:
                    flush()
        if parts:
            flush()
        return made, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                made, counts = of_texts(own.column(1).to_pylist())
                sizes = [sum(map(len, m)) for m in made]
                values = np.concatenate([x for m in made for x in m] or [np.zeros(0, dtype=np.int32)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(counts, pa.int64()), lists], names=["row", "n_words", "buckets"])

    kind = T.StructType([shaped.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))])
    return shaped.mapInArrow(released(run), kind)


def bucket_counts(featured: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features each bucket holds: a task counts all it reads into one array, at most `buckets` sums come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in featured.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the corpus, one added to each count."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weigh(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, n_words, n_features, weight: the floored mean of the gains of a document's features (without any: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            sums = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])))
            total = sums[ends] - sums[ends - sizes]
            weight = np.where(sizes > 0, total // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(weight, pa.int64())], names=["row", "n_words", "n_features", "weight"])

    kind = T.StructType([featured.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    return featured.select("row", "n_words", "buckets").mapInArrow(released(run), kind)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of sha256 of seed:id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def draw(weighed: DataFrame, id_col: str, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """weighed with score (weight and Gumbel noise) and rank, of the drawn ones: a sample without replacement by weight.

    Of the N rows with min_words words and more, floor(percent * N / 100) of the highest scores are drawn; ties go to
    the smaller id (null ids first; rows that repeat an id stand in any order). Scores are whole numbers of a bounded
    range, so rows are counted by score, which tells how many stand above each; only drawn scores' rows are sorted,
    each score's for itself.
    """
    scored = materialise(weighed.withColumn("score", F.col("weight") + gumbel(F.col(f"row.`{id_col}`"), seed)), "scored")
    fit = scored.filter(F.col("n_words") >= min_words)
    counts = sorted((tuple(r) for r in fit.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    take, above, drawn = percent * sum(n for _, n in counts) // 100, 0, []
    for score, n in counts:
        if above >= take:
            break
        drawn.append((score, above))
        above += n
    in_reach = (F.col("n_words") >= min_words) & (F.col("score") >= (drawn[-1][0] if drawn else 1 << 62))
    table = scored.sparkSession.createDataFrame(drawn, "score long, above long")
    place = F.row_number().over(Window.partitionBy("score").orderBy(f"row.`{id_col}`"))
    ranked = scored.filter(in_reach).join(F.broadcast(table), "score").withColumn("rank", F.col("above") + place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.union(scored.filter(~in_reach).select("*", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_features, weight, score and rank (null: not drawn).

    weight tells how much likelier a document's n-grams are in target than in docs (see features, gains, weigh, draw).
    Features of docs are worked out once, into a table in the shared folder. Columns named like the new ones are
    replaced, others stay; null and empty texts weigh 0 and are not drawn; repeated rows are documents of their own;
    empty tables on either side are fine.
    """
    featured = materialise(features(docs, order, buckets, text_col), "features")
    gain = gains(bucket_counts(featured, buckets), bucket_counts(features(target.select(target_col), order, buckets, target_col), buckets))
    return draw(weigh(featured, gain), id_col, percent, min_words, seed).select("row.*", *OUT)
