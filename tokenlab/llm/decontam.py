"""Benchmark decontamination by spaced-seed hashing with verification around hits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import WordHashes, materialise, mixed, released, texts_of, token_hashes, token_pieces

#: Fixed masks over token positions: 1 is compared, 0 may differ.
MASKS = ("1110111", "11010011011", "110010100111")
#: A leak has this many matching tokens at least, in a stretch where a mismatch costs as much as two matches bring.
LEAST_MATCHES, MISMATCH = 12, 2
#: Items of fewer tokens than the shortest mask have to match whole; items below SCALED tokens in a share of them.
EXACT, SCALED, SHARE = min(map(len, MASKS)), 16, 0.75
#: Whatever passes the share in a short item has so many equal tokens in a row.
SHORT_MASK = "111"
#: A benchmark of so many tokens at most is broadcast whole; the seeds of a larger one are joined by shuffle.
BLOCK_TOKENS = 1 << 20
#: Bits of the filter over a larger benchmark's seeds: so many per seed, up to 2**MOST_BITS; and keys of documents
#: with a hit that are broadcast at most.
BITS_PER_SEED, MOST_BITS, MOST_KEYS = 16, 31, 1 << 20
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)], dtype=np.uint64)
OUT = ("leak_item", "leak_matches", "leak_start", "leak_end", "leaks")


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


@dataclass
class Block:
    """Some benchmark items: numbers of their tokens, and for each mask the hashes of all places, sorted."""

    vocabulary: dict[str, int]
    items: list[Any]  # ids
    tokens: list[np.ndarray]
    seeds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]  # mask -> hash, item's place, token position
    longest: int


def needed(length: int) -> int:
    """Matching tokens that make a leak of an item of so many tokens."""
    return length if length < EXACT else LEAST_MATCHES if length >= SCALED else min(LEAST_MATCHES, ceil(SHARE * length))


def masks(length: int) -> tuple[str, ...]:
    """Masks by which an item of so many tokens is looked up."""
    return ("1" * length,) if length < EXACT else (*MASKS, SHORT_MASK) if needed(length) < LEAST_MATCHES else MASKS


def seed_hashes(tokens: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose compared tokens are all known (not negative), and their hashes."""
    at = _offsets(mask)
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    known = tokens >= 0
    whole = known[at[0] : at[0] + n].copy()
    for o in at[1:]:
        whole &= known[o : o + n]
    place = np.flatnonzero(whole)
    hashes = np.zeros(len(place), dtype=np.uint64)
    for k, o in enumerate(at):
        hashes += (tokens[place + o].astype(np.uint64) + np.uint64(1)) * _FACTORS[k] ^ (hashes >> np.uint64(29))
    return place, hashes


def build(items: list[tuple[Any, list[str]]]) -> Block:
    vocabulary: dict[str, int] = {}
    tokens = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64) for _, words in items]
    seeds = {}
    for mask in dict.fromkeys(m for t in tokens for m in masks(len(t))):
        parts = [(h, np.full(len(p), i), p) for i, t in enumerate(tokens) if mask in masks(len(t)) for p, h in [seed_hashes(t, mask)]]
        h, i, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        seeds[mask] = h[order], i[order], p[order]
    return Block(vocabulary, [n for n, _ in items], tokens, seeds, max(map(len, tokens), default=0))


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """The best stretch where doc[i] stands against item[i - shift]: matching tokens, start, end in doc."""
    a, b = max(0, shift), min(len(doc), shift + len(item))
    same = doc[a:b] == item[a - shift : b - shift]
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -MISMATCH))))
    lowest = np.minimum.accumulate(total)
    gain = total - lowest
    # Of ends that are as good, the last in a short item, where two more matches can decide.
    end = len(gain) - 1 - int(gain[::-1].argmax()) if needed(len(item)) < LEAST_MATCHES else int(gain.argmax())
    start = int(total[: end + 1].argmin())
    return int(same[start:end].sum()), a + start, a + end


def near(doc: np.ndarray, block: Block) -> dict[int, tuple[int, int, int]]:
    """Leaks in one stretch of a document, by item's place: the best overlap with each, the earlier of equal ones."""
    hits = set()
    for mask, (hashes, item, place) in block.seeds.items():
        at, own = seed_hashes(doc, mask)
        if not len(at) or not len(hashes):
            continue
        a, b = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
        for k in np.flatnonzero(b > a):
            hits.update(zip(item[a[k] : b[k]].tolist(), (at[k] - place[a[k] : b[k]]).tolist(), strict=True))
    return confirmed(doc, hits, block.tokens)


def confirmed(doc: np.ndarray, hits: set[tuple[int, int]], items) -> dict[int, tuple[int, int, int]]:
    """Of hits (item, shift) those whose overlap is a leak: the best of each item."""
    out: dict[int, tuple[int, int, int]] = {}
    for i, shift in hits:
        n, start, end = overlap(doc, items[i], shift)
        if n >= needed(len(items[i])) and (i not in out or (-n, start) < (-out[i][0], out[i][1])):
            out[i] = n, start, end
    return out


def ordered(found: dict[Any, tuple[int, int, int]]) -> list[tuple[Any, int, int, int]]:
    """Leaks (item id, matches, start, end), the one with the most matches first, ties to the smaller id, null last."""
    return sorted(((i, *x) for i, x in found.items()), key=lambda r: (-r[1], r[0] is None, r[0] if r[0] is not None else 0, r[2]))


def search(text: str | None, block: Block) -> list[tuple[Any, int, int, int]]:
    """All leaks of a whole text: item id, matches, start, end (token positions)."""
    found, tail, begun = {}, np.zeros(0, dtype=np.int64), 0
    for words in token_pieces(text):
        get = block.vocabulary.get
        own = np.concatenate((tail, np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))))
        for i, (n, start, end) in near(own, block).items():
            item = block.items[i]
            if item not in found or (-n, begun + start) < (-found[item][0], found[item][1]):
                found[item] = n, begun + start, begun + end
        # So much of the next stretch is read again that no item is cut.
        tail = own[-2 * block.longest :] if block.longest else own[:0]
        begun += len(own) - len(tail)
    return ordered(found)


def _columns(rows: list[list[tuple]], kind: T.DataType) -> list[pa.Array]:
    """The columns OUT for the leaks of each row."""
    item = to_arrow_type(kind)
    first = [r[0] if r else (None,) * 4 for r in rows]
    each = pa.struct([("item", item), ("matches", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    lists = [[dict(zip(("item", "matches", "start", "end"), x, strict=True)) for x in r] for r in rows]
    return [pa.array([f[k] for f in first], item if not k else pa.int64()) for k in range(4)] + [pa.array(lists, pa.list_(each))]


def _added(kind: T.DataType) -> list[T.StructField]:
    long = T.LongType()
    each = T.StructType([T.StructField("item", kind), *(T.StructField(c, long) for c in ("matches", "start", "end"))])
    return [T.StructField("leak_item", kind), *(T.StructField(c, long) for c in OUT[1:4]), T.StructField("leaks", T.ArrayType(each))]


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with leaks, all overlaps with benchmark items (the best of each), and the best one in columns of its own.

    leak_item, leak_matches, leak_start, leak_end: item id, equal tokens, and token positions in the document; null
    without a leak. leak_matches tells, as an item's id may be null; ids keep their type. Ties go to the smaller id.

    Tokens are lower-cased runs of word characters. Hashes of the tokens that each fixed mask keeps are joined with
    those of the benchmark's places; around every hit the texts are compared on the hit's alignment, and the best
    stretch counts if it has LEAST_MATCHES equal tokens (of items below SCALED tokens the SHARE of the item's length),
    a mismatch costing MISMATCH of them. So an overlap stands single substituted words. Items shorter than the
    shortest mask count where the whole item stands word by word.

    A benchmark of BLOCK_TOKENS tokens at most is broadcast, and documents are read in one pass without a shuffle. The
    seeds of a larger one are joined by shuffle with those of the documents (joined_leaks). Whole texts are read, in
    stretches that overlap. Of items with equal tokens that with the smallest id counts; a null or empty item is none.
    A null or empty text has no leak, rows that repeat are marked alike, an empty table gives no rows. Columns of docs
    stay, but those named like the new ones are replaced.
    """
    spark, kind = docs.sparkSession, benchmark.schema[item_id].dataType
    docs = docs.drop(*OUT)
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    size = rows.agg(F.sum(F.regexp_count("t", F.lit(r"(?U)\w+")))).first()[0] or 0
    if size > BLOCK_TOKENS:
        return joined_leaks(docs, rows, kind, text_col)
    items, seen = [], set()
    for r in rows.orderBy(F.col("i").asc_nulls_last(), "t").collect():
        words = [w for p in token_pieces(r["t"]) for w in p]
        if words and tuple(words) not in seen:
            seen.add(tuple(words))
            items.append((r["i"], words))
    shared = spark.sparkContext.broadcast(build(items))
    place = docs.columns.index(text_col)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [search(text, own) for text in texts_of(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(found, kind)], names=[*batch.schema.names, *OUT])

    return docs.mapInArrow(released(mark), T.StructType([*docs.schema.fields, *_added(kind)]))


def _seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of all places of a text of hashed tokens under a mask; masks don't share them."""
    at = _offsets(mask)
    n = max(0, len(tokens) - len(mask) + 1)
    out = np.full(n, int(mask, 2) + (len(mask) << 32), dtype=np.uint64)
    for o in at:
        out = mixed(out ^ tokens[o : o + n])
    return out


def joined_leaks(docs: DataFrame, rows: DataFrame, kind: T.DataType, text_col: str) -> DataFrame:
    """mark_leaks for a benchmark (rows: i, t) of any size.

    Documents are told apart by 128 bits of their text. Their seeds pass a filter of bounded size over the benchmark's
    seeds and are joined with these by shuffle; the texts of documents with a hit come in again, by a broadcast of
    their keys if there are MOST_KEYS at most, and each hit is compared with its item.
    """
    spark = docs.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            tokens = [token_hashes(t, hashes) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in tokens], pa.binary()), pa.array([len(x) for x in tokens], pa.int64())], names=["i", "tokens", "n"])

    schema = T.StructType([T.StructField("i", kind), T.StructField("tokens", T.BinaryType()), T.StructField("n", T.LongType())])
    items = rows.mapInArrow(released(hashed), schema).filter("n > 0").groupBy("tokens", "n").agg(F.min("i").alias("i"))
    items = materialise(items.select(F.xxhash64("tokens", F.lit(1)).alias("item"), "i", "tokens", "n"), "items")
    sizes = items.agg(F.max("n").alias("longest"), F.sum("n").alias("all"), F.collect_set(F.least("n", F.lit(SCALED))).alias("lengths")).first()
    kinds = list(dict.fromkeys(m for n in sorted(sizes["lengths"]) for m in masks(n)))

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                tokens = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                for mask in masks(len(tokens)):
                    own = _seeds(tokens, mask)
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), item)), pa.array(np.arange(len(own)))], names=["seed", "item", "place"])

    seeds = materialise(items.mapInArrow(released(planted), "seed long, item long, place long"), "seeds")
    bits = min(MOST_BITS, max(16, (BITS_PER_SEED * sizes["all"] * 4).bit_length()))

    def word(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << 13, dtype=np.uint8)
        at = table.column("bit").to_numpy()
        np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bytes": pa.array([own.tobytes()], pa.binary())})

    spot = F.shiftrightunsigned(F.col("seed"), 64 - bits)
    chunks = seeds.select(F.shiftright(spot, 16).cast("int").alias("chunk"), (spot % (1 << 16)).cast("int").alias("bit")).distinct().groupBy("chunk").applyInArrow(word, "chunk int, bytes binary")
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in chunks.toLocalIterator():
        table[r["chunk"] << 13 : (r["chunk"] + 1) << 13] = np.frombuffer(r["bytes"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(table)

    def sown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), shared.value
        for batch in batches:
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                tokens = token_hashes(text, hashes)
                for mask in kinds:
                    own = _seeds(tokens, mask)
                    spot = own >> np.uint64(64 - bits)
                    at = np.flatnonzero(known[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), a)), pa.array(np.full(len(at), b)), pa.array(own[at].view(np.int64)), pa.array(at)], names=["a", "b", "seed", "at"])

    keyed = docs.withColumn("__a", F.xxhash64(text_col)).withColumn("__b", F.xxhash64(F.lit(7), text_col))
    slim = keyed.select(F.col("__a").alias("a"), F.col("__b").alias("b"), F.col(text_col).alias("text")).filter("text is not null")
    met = slim.mapInArrow(released(sown), "a long, b long, seed long, at long").join(seeds, "seed")
    hits = materialise(met.select("a", "b", "item", (F.col("at") - F.col("place")).alias("shift")).distinct(), "hits")
    keys = hits.select("a", "b").distinct()
    texts = slim.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys.hint("merge"), ["a", "b"], "left_semi").dropDuplicates(["a", "b"])
    pairs = hits.groupBy("a", "b", "item").agg(F.collect_list("shift").alias("shifts")).join(items.select("item", "i", "tokens"), "item").join(texts, ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for a, b, item, shifts, data, text in zip(*[batch.column(k) if k == 4 else batch.column(k).to_pylist() if k < 5 else texts_of(batch.column(k)) for k in range(6)], strict=True):
                doc, own = token_hashes(text, hashes), np.frombuffer(data.as_buffer(), dtype=np.uint64)
                if found := confirmed(doc, {(0, s) for s in shifts}, [own]):
                    out.append((a, b, item, *found[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], to_arrow_type(kind)), *(pa.array([r[k] for r in out], pa.int64()) for k in (3, 4, 5))], names=["a", "b", "item", "matches", "start", "end"])

    each = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("item", kind), *(T.StructField(c, T.LongType()) for c in ("matches", "start", "end"))])
    found = materialise(pairs.select("a", "b", "i", "shifts", "tokens", "text").mapInArrow(released(compare), each), "leaks")
    # Most matches first, then the smaller id, null last.
    rank = F.struct((-F.col("matches")).alias("m"), F.col("item").isNull().alias("none"), "item", "start", "end")
    packed = found.groupBy("a", "b").agg(F.array_sort(F.collect_list(rank)).alias("r")).select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.transform("r", lambda x: F.struct(x["item"].alias("item"), (-x["m"]).alias("matches"), x["start"].alias("start"), x["end"].alias("end"))).alias("leaks"))
    both = keyed.join(packed, ["__a", "__b"], "left").drop("__a", "__b")
    none = F.array().cast(_added(kind)[-1].dataType)
    out = both.withColumn("leaks", F.coalesce("leaks", none))
    return out.select(*docs.columns, *[F.try_element_at("leaks", F.lit(1))[c].alias(f"leak_{c}") for c in ("item", "matches", "start", "end")], "leaks")
