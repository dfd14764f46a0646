"""Collocations: phrases counted by slots of minimal perfect hashes, scored by their weakest cut."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .eliasfano import load, mapped, save
from .ngramlm import _merged, _planes, _unique, _unplanes
from .perfecthash import PerfectHash
from .shared import materialise, mixed, new_folder, released, texts_of

#: Words that a task counts together, bytes of a text that are split together.
BLOCK, BYTES = 1 << 20, 1 << 20
#: Bytes of text for one range of counted hashes (at least RANGES of them), stretches into which a task cuts its range.
RANGE_BYTES, RANGES, STRETCHES = 32 << 20, 8, 16
#: Candidates of one perfect hash, about, and the least number of these.
SHARD_KEYS, SHARDS = 1 << 16, 16
#: Bytes of counts that a task gathers, and of files that it holds where they can't be mapped.
HELD = 64 << 20
#: Partial sums of a shard's counts in the first step of summing.
SALTS = 16
#: Of a hash, so many low bits are left out where only an upper bound of a count is wanted.
DROPPED = 16

_MIX = np.uint64(0x9DDFEA08EB382D69)
# Fixed: A-Z are lower-cased, pieces end at . , ; : ! ? and line ends, words at spaces and tabs.
_FOLD = bytes.maketrans(ascii_uppercase.encode() + b"\t.,;:!?\n\x0b\x0c\r", ascii_lowercase.encode() + b" " + b"\n" * 10)
_BREAK, _NOTHING = -1, -2


class _Ids(dict):
    """word -> number, in order of appearance; piece ends and empty words apart."""

    def __init__(self):
        super().__init__({b"\n": _BREAK, b"": _NOTHING})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 2
        return n


def hashes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def seeds_of(langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of languages; no word begins with a line end, so none has these."""
    return hashes_of([b"\n" + lang.encode("utf-8", "surrogatepass") for lang in langs])


def first_key(seeds: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases of one word, from the hashes of language and word."""
    return mixed(words ^ seeds)


def next_key(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases that are longer by a word."""
    return mixed(keys * _MIX + words)


@dataclass
class Phrases:
    """All occurrences of phrases of n words of one language: keys, and the places of their first words among ids."""

    block: Block
    lang: str
    n: int
    keys: np.ndarray
    at: np.ndarray
    ids: np.ndarray

    def checks(self, at: np.ndarray) -> np.ndarray:
        """A second key of the phrases at some places, from other hashes of the same words."""
        own = first_key(seeds_of([self.lang])[1], self.block.hashes[1][self.ids[at]])
        for k in range(1, self.n):
            own = next_key(own, self.block.hashes[1][self.ids[at + k]])
        return own

    def texts(self, at: np.ndarray) -> pa.Array:
        """The phrases at some places."""
        words = [self.block.words.take(pa.array(self.ids[at + k])) for k in range(self.n)]
        return words[0] if self.n == 1 else pc.binary_join_element_wise(*words, " ")


@dataclass
class Block:
    """Word numbers of some texts of each language, ended by breaks; the first `known` of a language are counted already."""

    words: pa.Array
    hashes: tuple[np.ndarray, np.ndarray]
    parts: dict[str, tuple[np.ndarray, int]]

    def phrases(self, longest: int) -> Iterator[Phrases]:
        """By language and number of words: all occurrences within pieces."""
        hashes = np.append(self.hashes[0], np.uint64(0))
        for lang, (ids, known) in self.parts.items():
            own = hashes[ids]
            keys, inside = first_key(seeds_of([lang])[0], own), ids >= 0
            for n in range(1, longest + 1):
                if n > 1:
                    keys, inside = next_key(keys[:-1], own[n - 1 :]), inside[:-1] & (ids[n - 1 :] >= 0)
                at = np.flatnonzero(inside)
                at = at[at + n > known]
                yield Phrases(self, lang, n, keys[at], at, ids)


def blocks(batches: Iterator[pa.RecordBatch], longest: int, size: int | None = None) -> Iterator[Block]:
    """Whole texts (columns lang, text) in blocks of bounded size; a text that goes on repeats its last words."""
    size, ids, parts, known, n = size or BLOCK, _Ids(), {}, {}, 0

    def made() -> Block:
        words = [w for w, i in ids.items() if i >= 0]
        return Block(pa.array(words, pa.binary()).cast(pa.string()), hashes_of(words), {k: (np.concatenate(p), known.get(k, 0)) for k, p in parts.items()})

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            data, at = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), 0
            while at < len(data):
                end = data.find(b" ", at + BYTES)
                end = len(data) if end < 0 else end
                words = data[at:end].replace(b"\n", b" \n ").split(b" ")
                at = end + 1
                own = np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words))
                own = own[own != _NOTHING]
                if at >= len(data):
                    own = np.append(own, np.int32(_BREAK))
                parts.setdefault(lang, []).append(own)
                n += len(own)
                if n >= size:
                    block = made()
                    yield block
                    tail = block.parts[lang][0][-(longest - 1) :] if at < len(data) and longest > 1 else []
                    kept = [block.words[int(i)].as_py().encode() if i >= 0 else b"\n" for i in tail]
                    ids, parts, known, n = _Ids(), {}, {}, 0
                    if kept:
                        parts[lang], known[lang] = [np.array([ids[w] for w in kept], dtype=np.int32)], len(kept)
    if parts:
        yield made()


def _put(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write a file under another name and move it: attempts at one task leave one whole file, the same whoever wins."""
    other = f"{path}.{uuid.uuid4().hex[:12]}"
    save(other, arrays)
    store, own = fs.FileSystem.from_uri(path)
    store.move(fs.FileSystem.from_uri(other)[1], own)


@dataclass
class Files:
    """Numbered files that hold equal ranges of keys, ascending; there: which of them exist."""

    folder: str
    name: str
    there: np.ndarray
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def path(self, s: int) -> str:
        return f"{self.folder}/{self.name}-{s}.bin"

    def arrays(self, s: int) -> dict[str, np.ndarray]:
        """A file's arrays; mapped ones stay open, of others HELD bytes about."""
        if s not in self._open:
            if not mapped(self.path(s)):
                while len(self._open) and sum(a.nbytes for x in self._open.values() for a in x.values()) > HELD:
                    del self._open[next(iter(self._open))]
            self._open[s] = load(self.path(s))
        return self._open[s]

    def ranges(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Of sorted keys: file, from, to, for the files that exist."""
        width = (1 << 64) // len(self.there)
        cuts = np.append(np.searchsorted(keys, np.array([s * width for s in range(len(self.there))], dtype=np.uint64)), len(keys))
        for s in np.flatnonzero((np.diff(cuts) > 0) & self.there).tolist():
            yield s, int(cuts[s]), int(cuts[s + 1])


def _shard(key: Column, shards: int) -> Column:
    """The range of a key (as a signed long) among `shards`, a power of two."""
    bits = shards.bit_length() - 1
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def _power(n: int, least: int) -> int:
    """The least power of two that is n and `least` at least."""
    return 1 << max(n - 1, least - 1, 0).bit_length()


def upper_bounds(texts: DataFrame, longest: int, least: int, folder: str) -> tuple[Files, DataFrame, int]:
    """Hashes whose phrases occur `least` times together: files of these, words of each language, and their number.

    All phrases of up to `longest` words are hashed, sorted and counted block by block, and go as runs of hashes to
    the task of their range. No frequent phrase is lost, and its parts are as frequent; few others remain.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = _power(size // RANGE_BYTES + 1, RANGES)
    ranges = parts * STRETCHES
    bounds = np.array([(i * ((1 << 64) // ranges)) >> DROPPED for i in range(ranges)], dtype=np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, longest):
            found, rows = [], []
            for p in block.phrases(longest):
                found.append(p.keys >> np.uint64(DROPPED))
                if p.n == 1:
                    rows.append((-1, p.lang, len(p.keys), None, None))
            keys, n = _unique(np.concatenate(found))
            cuts = np.append(np.searchsorted(keys, bounds), len(keys))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                own, times = keys[cuts[s] : cuts[s + 1]], n[cuts[s] : cuts[s + 1]]
                rows.append((s, None, 0, _planes(np.diff(own, prepend=np.uint64(0))), _planes(times.astype(np.uint32))))
            yield _rows(rows, ["shard", "lang", "n", "keys", "counts"], [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, runs, shard, held = [], [], None, 0

        def close() -> None:
            keys, n = _merged(runs)
            kept.append(keys[n >= least])
            runs.clear()

        for batch in batches:
            for s, lang, n, keys, counts in zip(*(batch.column(i) for i in range(5)), strict=True):
                if s.as_py() < 0:
                    yield _rows([(-1, lang.as_py(), n.as_py())], ["part", "lang", "n"], [pa.int32(), pa.string(), pa.int64()])
                    continue
                if s.as_py() != shard:
                    if runs:
                        close()
                    shard, held = s.as_py(), 0
                runs.append((np.cumsum(_unplanes(keys.as_buffer(), np.uint64), dtype=np.uint64), _unplanes(counts.as_buffer(), np.uint32)))
                held += len(runs[-1][0])
                if held >= max(1 << 20, len(runs[0][0])):
                    runs[:], held = [_merged(runs)], 0
        if runs:
            close()
        if shard is not None:
            keys = np.concatenate(kept)
            _put(f"{folder}/bounds-{shard // STRETCHES}.bin", {"keys": keys})
            yield _rows([(shard // STRETCHES, None, len(keys))], ["part", "lang", "n"], [pa.int32(), pa.string(), pa.int64()])

    counted = texts.mapInArrow(released(count), "shard int, lang string, n long, keys binary, counts binary")
    part = F.when(F.col("shard") < 0, F.pmod(F.xxhash64("lang", F.spark_partition_id()), F.lit(parts))).otherwise(F.expr(f"shard div {STRETCHES}"))
    spread = counted.withColumn("part", part.cast("int")).repartitionById(parts, F.col("part")).sortWithinPartitions("shard").drop("part")
    made = materialise(spread.mapInArrow(released(merge), "part int, lang string, n long"), "bounds")
    there, total = np.zeros(parts, dtype=bool), 0
    for r in made.filter("part >= 0").collect():
        there[r["part"]], total = True, total + r["n"]
    return Files(folder, "bounds", there), made.filter("part < 0").groupBy("lang").agg(F.sum("n").alias("n")), total


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def candidates(texts: DataFrame, bounds: Files, longest: int) -> DataFrame:
    """key, check, lang, phrase of each phrase whose hash is in bounds; a task gives each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = np.zeros(0, dtype=np.uint64)  # what this task has given already: both keys as one, sorted
        for block in blocks(batches, longest):
            new = [given]
            for p in block.phrases(longest):
                keys, first = np.unique(p.keys, return_index=True)
                hits = [np.zeros(0, dtype=np.int64)]
                for s, a, b in bounds.ranges(keys):
                    known, own = bounds.arrays(s)["keys"], keys[a:b] >> np.uint64(DROPPED)
                    if len(known):
                        hits.append(a + np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own))
                hits = np.concatenate(hits)
                at = p.at[first[hits]]
                checks = p.checks(at)
                both = mixed(keys[hits] ^ mixed(checks))
                fresh = np.flatnonzero(given[np.minimum(np.searchsorted(given, both), len(given) - 1)] != both) if len(given) else np.arange(len(both))
                new.append(both[fresh])
                hits, at, checks = hits[fresh], at[fresh], checks[fresh]
                yield pa.RecordBatch.from_arrays([pa.array(keys[hits].view(np.int64)), pa.array(checks.view(np.int64)), pa.repeat(pa.scalar(p.lang, pa.string()), len(hits)), p.texts(at)], names=_FOUND)
            given = np.sort(np.concatenate(new))

    return texts.mapInArrow(released(run), "key long, check long, lang string, phrase string")


_FOUND = ["key", "check", "lang", "phrase"]


def build(found: DataFrame, number: int, folder: str) -> Files:
    """A perfect hash for each range of candidates' keys, with the stored keys and phrase of each slot.

    Files of the same candidates are the same. A shard's task drops repeats as they gather.
    """
    shards = _power(number // SHARD_KEYS + 1, SHARDS)

    def distinct(rows: pa.Table) -> pa.Table:
        keys, checks = (rows.column(i).to_numpy().view(np.uint64) for i in range(2))
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        return rows.take(pa.array(order[np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))[: len(order)]])).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(4)[0].as_py()
            held.append(pa.Table.from_batches([batch.select(_FOUND)]))
            size += batch.num_rows
            if size > max(1 << 18, 2 * held[0].num_rows):
                held, size = [distinct(pa.concat_tables(held))], 0
        if shard is None:
            return
        rows = distinct(pa.concat_tables(held))
        keys, checks = (rows.column(i).to_numpy().view(np.uint64) for i in range(2))
        single = np.append(True, keys[1:] != keys[:-1])
        # Different phrases of one key: those after the first take slots behind all others.
        table, slot = PerfectHash.build(keys[single]), np.empty(len(keys), dtype=np.int64)
        slot[single] = table.slot(keys[single])
        slot[~single] = np.arange(single.sum(), len(keys))
        by_slot = np.argsort(slot)
        own = {"keys": keys[by_slot], "checks": checks[by_slot], "single": np.array([single.sum()], dtype=np.int64)}
        for name in ("lang", "phrase"):
            stored = rows.column(name).take(pa.array(by_slot)).combine_chunks().cast(pa.large_string())
            stored = stored.chunk(0) if isinstance(stored, pa.ChunkedArray) else stored
            own |= {f"{name}.ends": np.frombuffer(stored.buffers()[1], dtype=np.int64)[: len(keys) + 1], f"{name}.data": np.frombuffer(stored.buffers()[2] or b"", dtype=np.uint8)}
        _put(f"{folder}/phrases-{shard}.bin", table.arrays() | own)
        yield _rows([(shard,)], ["shard"], [pa.int32()])

    # One shard for each partition.
    spread = found.withColumn("shard", _shard(F.col("key"), shards)).repartitionById(shards, F.col("shard"))
    there = np.zeros(shards, dtype=bool)
    for r in materialise(spread.mapInArrow(released(run), "shard int"), "phrases").collect():
        there[r["shard"]] = True
    return Files(folder, "phrases", there)


def stored(table: dict[str, np.ndarray], name: str) -> pa.Array:
    """Languages or phrases of a shard, by slot."""
    return pa.Array.from_buffers(pa.large_string(), len(table["keys"]), [None, pa.py_buffer(table[f"{name}.ends"]), pa.py_buffer(table[f"{name}.data"])])


def slots(table: dict[str, np.ndarray], keys: np.ndarray, checks_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Slots of phrases in a shard, -1 for those that aren't there: both stored keys have to be the same.

    checks_of gives second keys of some of them, by number: of those whose first key is stored.
    """
    own = PerfectHash.of(table).slot(keys)
    at = np.flatnonzero((own >= 0) & (table["keys"][own] == keys)) if len(table["keys"]) else np.zeros(0, dtype=np.int64)
    checks, out = checks_of(at), np.full(len(keys), -1, dtype=np.int64)
    out[at] = np.where(table["checks"][own[at]] == checks, own[at], -1)
    for s in range(int(table["single"][0]), len(table["keys"])):
        out[at[(table["keys"][s] == keys[at]) & (table["checks"][s] == checks)]] = s
    return out


def count(texts: DataFrame, phrases: Files, longest: int, folder: str) -> Files:
    """Counts by slot: each task counts into arrays of its own, which are added up in two steps."""

    def emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for s, n in sums.items():
            at = np.flatnonzero(n)
            yield _rows([(s, _planes(np.diff(at, prepend=0)), _planes(n[at]))], _SUM, [pa.int32(), pa.binary(), pa.binary()])
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for block in blocks(batches, longest):
            for p in block.phrases(longest):
                keys, first, times = np.unique(p.keys, return_index=True, return_counts=True)
                for s, a, b in phrases.ranges(keys):
                    table = phrases.arrays(s)
                    starts = p.at[first[a:b]]
                    own = slots(table, keys[a:b], lambda i, p=p, starts=starts: p.checks(starts[i]))
                    if s not in sums:
                        sums[s] = np.zeros(len(table["keys"]), dtype=np.int64)
                    sums[s][own[own >= 0]] += times[a:b][own >= 0]
            if sum(x.nbytes for x in sums.values()) > HELD:
                yield from emit(sums)
        yield from emit(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        shard, total = None, None
        for batch in batches:
            for s, at, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if s != shard:
                    if shard is not None:
                        yield shard, total
                    shard, total = s, np.zeros(len(phrases.arrays(s)["keys"]), dtype=np.int64)
                total[np.cumsum(_unplanes(at.as_buffer(), np.int64))] += _unplanes(n.as_buffer(), np.int64)
        if shard is not None:
            yield shard, total

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, n in add(batches):
            yield from emit({s: n})

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, n in add(batches):
            _put(f"{folder}/counts-{s}.bin", {"counts": n})
            yield _rows([(s,)], ["shard"], [pa.int32()])

    kind, shards = "shard int, slots binary, counts binary", len(phrases.there)
    sums = texts.mapInArrow(released(run), kind).withColumn("salt", F.spark_partition_id() % SALTS)
    sums = sums.repartition(shards, "shard", "salt").sortWithinPartitions("shard", "salt").drop("salt").mapInArrow(partly, kind)
    sums = sums.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(released(wholly), "shard int")
    there = np.zeros(shards, dtype=bool)
    for r in materialise(sums, "counts").collect():
        there[r["shard"]] = True
    return Files(folder, "counts", there)


_SUM = ["shard", "slots", "counts"]


def read_cuts(texts: DataFrame, phrases: Files, counts: Files, longest: int, least: int, cover: int) -> DataFrame:
    """lang, phrase, a, l, r, score and covered (shorter phrases that this one makes superfluous) of each frequent phrase.

    Counts of parts are read by slot. Arithmetic is in whole numbers without bound.
    """
    shards = len(phrases.there)

    def looked_up(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        out, order = np.zeros(len(keys), dtype=np.int64), np.argsort(keys, kind="stable")
        for s, a, b in phrases.ranges(keys[order]):
            at = order[a:b]
            own = slots(phrases.arrays(s), keys[at], lambda i, at=at: checks[at[i]])
            out[at[own >= 0]] = counts.arrays(s)["counts"][own[own >= 0]]
        return out

    def of_shard(s: int) -> Iterator[pa.RecordBatch]:
        table, n = phrases.arrays(s), counts.arrays(s)["counts"]
        often = pa.array(np.flatnonzero(n >= least))
        langs, whole = stored(table, "lang").take(often).to_pylist(), stored(table, "phrase").take(often).to_pylist()
        by_size: dict[int, list[tuple[str, list[str], int]]] = {}
        for lang, phrase, a in zip(langs, whole, n[often.to_numpy()].tolist(), strict=True):
            words = phrase.split(" ")
            if len(words) > 1:
                by_size.setdefault(len(words), []).append((lang, words, a))
        for m, own in by_size.items():
            seeds = seeds_of([lang for lang, _, _ in own])
            word = [hashes_of([words[i].encode("utf-8", "surrogatepass") for _, words, _ in own]) for i in range(m)]
            found: dict[tuple[int, int], list[int]] = {}
            for i in range(m):
                pair = [first_key(seeds[x], word[i][x]) for x in range(2)]
                for k in range(1, m - i + 1):
                    if k > 1:
                        pair = [next_key(pair[x], word[i + k - 1][x]) for x in range(2)]
                    if k < m:
                        found[i, k] = looked_up(*pair).tolist()
            rows = []
            for j, (lang, words, a) in enumerate(own):
                score, k = min((1_000_000 * a * a // (found[0, k][j] * found[k, m - k][j]), k) for k in range(1, m))
                covered = {" ".join(words[i : i + x]) for (i, x), f in found.items() if x > 1 and 100 * a >= cover * f[j]}
                rows.append((lang, " ".join(words), a, found[0, k][j], found[k, m - k][j], score, sorted(covered)))
            yield _rows(rows, ["lang", "phrase", "a", "l", "r", "score", "covered"], [pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if counts.there[s]:
                    yield from of_shard(s)

    ids = texts.sparkSession.range(0, shards, 1, shards)
    return ids.mapInArrow(released(run), "lang string, phrase string, a long, l long, r long, score long, covered array<string>")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's `most` best phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    Words end at spaces and tabs, phrases stay within pieces (ended by . , ; : ! ? and line ends), A-Z are lower-cased.
    a: occurrences of the phrase, at least `least`; l and r: of the two parts of its weakest cut (the smallest floor of
    10^6 a^2 / (l r), of equal ones the first); n: words of the language. Phrases inside a longer one that has `cover`
    hundredths of their occurrences are dropped. Order: score, then a, descending, then the phrase's bytes. A null
    language is `und`, a null text empty; other columns play no part, rows that repeat count again, an empty table gives
    no rows.

    Three passes over the texts: upper bounds by hash, the candidates' words, counts by slot. Every task reads all
    candidates' files, a range at a time.
    """
    folder = new_folder(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    bounds, totals, number = upper_bounds(texts, longest, least, folder)
    phrases = build(candidates(texts, bounds, longest), number, folder)
    counts = count(texts, phrases, longest, folder)
    cuts = materialise(read_cuts(texts, phrases, counts, longest, least, cover), "cuts")
    covered = cuts.select("lang", F.explode("covered").alias("phrase")).distinct()
    left = cuts.drop("covered").join(covered, ["lang", "phrase"], "left_anti").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "salt"], ["lang"]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return left.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
