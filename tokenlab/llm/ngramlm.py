"""Language-model scoring with an Elias-Fano n-gram trie in memory-mapped levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .eliasfano import EliasFano, load, mapped, save
from .shared import materialise, mixed, new_folder, released

#: Documents for one shard of the vocabulary, which is cut by the top bits of the words' hashes.
SHARD_DOCS = 65_536
#: Tokens of training text for one shard of a higher level.
SHARD_TOKENS = 6_000_000
#: Numbers that a task gathers before it sorts and emits or merges them.
CHUNK, MERGE = 1 << 20, 1 << 20
#: Tokens that are looked up together.
STRETCH = 1 << 20
#: Bytes of a level's files that a worker holds where they can't be mapped.
HELD = 256 << 20
#: Logarithms are stored in 16 bits, as multiples of this below zero.
QUANTUM = 1 / 2048
#: Bytes of text that are hashed together.
BYTES = 1 << 19
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# Random numbers by byte, the same for both cases of A-Z and none for white space, and by place.
_BYTES = np.where(_SPACES, 0, mixed(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1))
_PLACES = mixed(np.arange(64, dtype=np.uint64)) | np.uint64(1)
#: The hash of the end, which no word is: that of a sum over nothing, of length 0.
END = mixed(mixed(np.zeros(1, dtype=np.uint64)))[0]


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-logs / QUANTUM), 65535).astype(np.uint16)


def _planes(x: np.ndarray) -> bytes:
    """Little-endian numbers byte plane by byte plane; planes of small differences compress to little."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _unique(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how often they occur or the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sums = np.diff(np.append(starts, len(keys))) if counts is None else np.add.reduceat(counts, starts)
    return keys[starts], sums.astype(np.int64)


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of distinct keys and their counts as one, merged by ranges of about CHUNK keys.

    So little more is held than the runs and the result. Counts take 32 bits unless their sums may need more.
    """
    if len(runs) == 1:
        return runs[0]
    # Of every 1024 keys of a run one: between two limits, a run has at most 1024 keys more than these tell.
    step = max(1, CHUNK >> 10)
    limits = np.sort(np.concatenate([k[1023::1024] for k, _ in runs]))[step::step]
    cuts = [np.concatenate(([0], np.searchsorted(k, limits), [len(k)])) for k, _ in runs]
    most, size = sum(int(n.max()) for _, n in runs if len(n)), sum(len(k) for k, _ in runs)
    keys, counts, at = np.empty(size, dtype=np.uint64), np.empty(size, dtype=np.uint32 if most < 1 << 32 else np.uint64), 0
    for i in range(len(limits) + 1):
        k, n = _unique(np.concatenate([r[0][c[i] : c[i + 1]] for r, c in zip(runs, cuts, strict=True)]), np.concatenate([r[1][c[i] : c[i + 1]] for r, c in zip(runs, cuts, strict=True)]).astype(np.int64))
        keys[at : at + len(k)], counts[at : at + len(k)] = k, n
        at += len(k)
    return keys[:at], counts[:at]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a column, each text's followed by the end's, and how many each text has.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A word's hash is the sum of a random number
    for each byte times one for its place, mixed with its length: computed from the column's bytes, a bounded number
    at a time, without an object for each word. A null text is empty.
    """
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    hashes, starts, at = [], [], int(ends[0]) if len(ends) else 0
    while at < (int(ends[-1]) if len(ends) else 0):
        to = min(at + BYTES, int(ends[-1]))
        while to < ends[-1]:  # behind the last white space or text's end, or further on until there is one
            cut = np.flatnonzero(_SPACES[data[at:to]])
            text = int(ends[np.searchsorted(ends, to, side="right") - 1])
            cut = max(at + int(cut[-1]) + 1 if len(cut) else at, text)
            if cut > at:
                to = cut
                break
            to = min(to + BYTES, int(ends[-1]))
        own = data[at:to]
        word = ~_SPACES[own]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = ends[np.searchsorted(ends, at) : np.searchsorted(ends, to)] - at
        first[inner] = word[inner]
        s = np.flatnonzero(first)
        if len(s):
            place = np.arange(s[0], len(own)) - np.repeat(s, np.diff(np.append(s, len(own))))
            times = _PLACES[np.minimum(place, len(_PLACES) - 1)]
            far = np.flatnonzero(place >= len(_PLACES))
            times[far] = mixed(place[far].astype(np.uint64)) | np.uint64(1)
            sums = np.add.reduceat(_BYTES[own[s[0] :]] * times, s - s[0])
            length = np.add.reduceat(word[s[0] :].astype(np.uint64), s - s[0])
            hashes.append(mixed(sums ^ mixed(length)))
            starts.append(s + at)
        at = to
    found = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    before = np.searchsorted(np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64), ends[1:])
    return np.insert(found, before, END), np.diff(before, prepend=0) + 1


@dataclass
class Level:
    """One level of the trie, in shards of ascending key ranges; files are mapped when first used."""

    bounds: np.ndarray  # smallest key of each shard, the first 0
    starts: np.ndarray  # number of entries before each shard, and of all
    paths: list[str]
    extra: list[str] = field(default_factory=list)  # a second file of each shard
    _open: dict = field(default_factory=dict, repr=False)
    _held: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}, "_held": {}}

    def arrays(self, s: int) -> dict[str, np.ndarray]:
        """A shard's arrays. Mapped ones stay open; of those read into memory the last few do, HELD bytes about."""
        if s not in self._open:
            own = self._open[s] = load(self.paths[s]) | (load(self.extra[s]) if self.extra else {})
            if not mapped(self.paths[s]):
                self._held[s] = sum(a.nbytes for a in own.values())
                while sum(self._held.values()) > HELD and len(self._held) > 1:
                    gone = next(iter(self._held))
                    del self._held[gone]
                    for k in [k for k in self._open if k == gone or (isinstance(k, tuple) and k[0] == gone)]:
                        del self._open[k]
        return self._open[s]

    def coded(self, s: int, name: str) -> EliasFano:
        own = self.arrays(s)
        if (s, name) not in self._open:
            self._open[s, name] = EliasFano.of(own, name)
        return self._open[s, name]

    def _split(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if not len(shard):
            return
        # Few shards: 16 bits sort by radix.
        order = np.argsort(shard.astype(np.uint16) if len(self.paths) < 1 << 16 else shard, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            for k in range(a, b, 1 << 16):
                yield int(shard[order[a]]), order[k : min(k + (1 << 16), b)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys among all entries, -1 for those that aren't there."""
        places, back = self.find_distinct(keys)
        return places[back]

    def find_distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the distinct keys, which are looked up in order, and for each key which of them it is."""
        keys, back = np.unique(keys, return_inverse=True)
        out = np.full(len(keys), -1, dtype=np.int64)
        cuts = np.append(np.searchsorted(keys, self.bounds), len(keys))
        for s in np.flatnonzero(np.diff(cuts)):
            for k in range(cuts[s], cuts[s + 1], 1 << 15):
                at = slice(k, min(k + (1 << 15), cuts[s + 1]))
                own = self.coded(int(s), "keys").find(keys[at])
                out[at] = np.where(own >= 0, own + self.starts[s], -1)
        return out, back

    def take(self, name: str, places: np.ndarray) -> np.ndarray:
        """An array's values at places of entries."""
        out = np.zeros(len(places), dtype=np.int64)
        for s, at in self._split(np.searchsorted(self.starts, places, side="right") - 1):
            out[at] = self.arrays(s)[name][places[at] - self.starts[s]]
        return out

    def access(self, name: str, places: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
        """A coded sequence's values at places of entries, plus the shard's offset."""
        out = np.zeros(len(places), dtype=np.uint64)
        for s, at in self._split(np.searchsorted(self.starts, places, side="right") - 1):
            out[at] = self.coded(s, name).access(places[at] - self.starts[s]) + (np.uint64(0) if offsets is None else offsets[s])
        return out

    def by_range(self, ranges: np.ndarray, name: str, nodes: np.ndarray) -> np.ndarray:
        """Values for nodes of the level below, of which each shard holds a range: its arrays start at ranges[s]."""
        out = np.zeros(len(nodes), dtype=np.int64)
        for s, at in self._split(np.searchsorted(ranges, nodes, side="right") - 1):
            own, values = nodes[at] - ranges[s], self.arrays(s)[name]
            inside = own < len(values)  # shards without entries have no file, and their nodes 0
            out[at[inside]] = values[own[inside]]
        return out


@dataclass
class Model:
    """vocabulary: hashes and counts. Bigrams: key rank * V + rank. Trigrams: the bigram's pointer plus the last
    word's place among the successors of the middle word. V: words; total: training tokens; end: rank of the end."""

    vocabulary: Level
    V: int
    total: int
    end: int
    bigrams: Level | None = None
    ranks: np.ndarray | None = None  # first rank of each bigram shard, and V
    bases: np.ndarray | None = None  # offset of the trigram pointers of each bigram shard, and their end
    trigrams: Level | None = None
    nodes: np.ndarray | None = None  # first bigram of each trigram shard, and the number of bigrams

    def word_logs(self, ranks: np.ndarray) -> np.ndarray:
        """The lowest level: log10 of (count + 0.5) / (N + 0.5 * (V + 1)), an unknown word with count 0."""
        counts = np.zeros(len(ranks))
        known = ranks >= 0
        counts[known] = self.vocabulary.take("counts", ranks[known])
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.V + 1)))

    def first(self, ranks: np.ndarray) -> np.ndarray:
        """The first bigram of each word: its monotone pointer."""
        out = np.zeros(len(ranks), dtype=np.int64)
        for s, at in self.bigrams._split(np.searchsorted(self.ranks, ranks, side="right") - 1):
            out[at] = self.bigrams.coded(s, "pointers").access(ranks[at] - self.ranks[s]).astype(np.int64) + self.bigrams.starts[s]
        return out

    @property
    def kind(self) -> type:
        """What ranks are written as; the largest number stands for an unknown word."""
        return np.uint32 if self.V < (1 << 32) - 1 else np.uint64

    def written(self, ranks: np.ndarray) -> np.ndarray:
        return np.where(ranks < 0, np.iinfo(self.kind).max, ranks).astype(self.kind)

    def read(self, data: pa.Buffer) -> np.ndarray:
        ranks = np.frombuffer(data, dtype=self.kind)
        return np.where(ranks == np.iinfo(self.kind).max, -1, ranks.astype(np.int64))

    def facts(self, ranks: np.ndarray) -> list[np.ndarray]:
        """Of each token: rank, log10 probability alone, log10 weight of unseen successors, first bigram.

        They are worked out once for each word of the stretch.
        """
        words, back = np.unique(ranks, return_inverse=True)
        weight, first, known = np.zeros(len(words)), np.zeros(len(words), dtype=np.int64), words >= 0
        if self.bigrams is not None and known.any():
            weight[known] = -QUANTUM * self.bigrams.by_range(self.ranks, "backoff", words[known])
            first[known] = self.first(words[known])
        return [ranks, *(x[back] for x in (self.word_logs(words), weight, first))]

    def bigram_places(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the distinct bigrams of a stretch (-1: not there; the first stands for those with an unknown word),
        and for each token but the first which of them ends there."""
        a, b = ranks[:-1], ranks[1:]
        which = np.zeros(len(a), dtype=np.int64)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        places, which[both] = self.bigrams.find_distinct(a[both].astype(np.uint64) * np.uint64(self.V) + b[both].astype(np.uint64))
        which[both] += 1
        return np.append(-1, places), which

    def score(self, ranks: np.ndarray, alone: np.ndarray, back: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token but the first, given the two before; facts() of all tokens."""
        if self.bigrams is None:
            return alone[1:].copy()
        places, which = self.bigram_places(ranks)
        there = np.flatnonzero(places >= 0)
        logs = np.zeros(len(places))
        logs[there] = -QUANTUM * self.bigrams.take("logs", places[there])
        seen = places[which] >= 0
        out = np.where(seen, logs[which], alone[1:] + back[:-1])
        if self.trigrams is None:
            return out
        # A trigram's key: the pointer of its first two words plus the place of the third among the second's successors.
        base, more = np.zeros(len(places), dtype=np.uint64), np.zeros(len(places))
        more[there] = -QUANTUM * self.trigrams.by_range(self.nodes, "backoff", places[there])
        some = np.flatnonzero(more < 0)
        base[some] = self.bigrams.access("base", places[some], self.bases)
        context = np.append(0, which[:-1])  # the bigram before, which ends in this one's first word
        has = more[context] < 0
        out = out + more[context]
        both = np.flatnonzero(has & seen)
        third = self.trigrams.find(base[context[both]] + (places[which[both]] - first[:-1][both]).astype(np.uint64))
        found = third >= 0
        out[both[found]] = -QUANTUM * self.trigrams.take("logs", third[found])
        return out


def _emit(keys: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted keys of one chunk: a row for each shard that has some."""
    keys, counts = _unique(keys)
    cuts = np.append(np.searchsorted(keys, bounds), len(keys))
    for s in np.flatnonzero(np.diff(cuts)):
        own, n = keys[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]].astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([_planes(np.diff(own, prepend=np.uint64(0)))], pa.binary()), pa.array([_planes(n)], pa.binary())], names=["shard", "keys", "counts"])


_COUNTED = "shard int, keys binary, counts binary"


def _count_words(texts: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Hashes of all words, counted by chunk and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, size = [], 0
        for batch in batches:
            keys.append(word_hashes(batch.column(0))[0])
            size += len(keys[-1])
            if size >= CHUNK:
                yield from _emit(np.concatenate(keys), bounds)
                keys, size = [], 0
        if size:
            yield from _emit(np.concatenate(keys), bounds)

    return texts.mapInArrow(released(run), _COUNTED)


def encode(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs without the text, with __ranks: the ranks of its words and the end, as bytes (see Model.written).

    So texts are taken apart and looked up once, whatever reads their words after that.
    """
    column = docs.columns.index(text_col)
    names = [c for c in docs.columns if keep_text or c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            hashes, sizes = word_hashes(batch.column(column))
            ranks = np.concatenate([own.written(own.vocabulary.find(hashes[k : k + STRETCH])) for k in range(0, max(1, len(hashes)), STRETCH)])
            places = np.concatenate(([0], np.cumsum(sizes))) * ranks.itemsize
            out = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(ranks)]).cast(pa.binary())
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if keep_text or i != column]
            yield pa.RecordBatch.from_arrays([*kept, out], names=[*names, "__ranks"])

    return docs.mapInArrow(released(run), T.StructType([*(docs.schema[c] for c in names), T.StructField("__ranks", T.BinaryType())]))


def _count(encoded: DataFrame, model: Callable[[], Model], bounds: np.ndarray, keys_of: Callable[[np.ndarray], np.ndarray], before: int = 1) -> DataFrame:
    """Keys of all texts, counted by chunk and shard.

    keys_of gets ranks of stretches of end, words, end, words, end ...; each repeats the last `before`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, size = model(), [], 0
        parts, length = [np.array([own.end])], 0

        def flush() -> None:
            nonlocal parts, length, size
            ranks = np.concatenate(parts)
            for at in range(0, len(ranks) - 1, STRETCH):
                keys.append(keys_of(ranks[max(0, at + 1 - before) : at + 1 + STRETCH]))
                size += len(keys[-1])
            parts, length = [ranks[-before:]], 0

        for batch in batches:
            for data in batch.column(0):
                parts.append(own.read(data.as_buffer()))
                length += len(parts[-1])
                if length >= STRETCH:
                    flush()
                    if size >= CHUNK:
                        yield from _emit(np.concatenate(keys), bounds)
                        keys, size = [], 0
        if length:
            flush()
        if size:
            yield from _emit(np.concatenate(keys), bounds)

    return encoded.select("__ranks").mapInArrow(released(run), _COUNTED)


def _build(counted: DataFrame, shards: int, folder: str, make: Callable[[int, np.ndarray, np.ndarray], tuple[dict[str, np.ndarray], int]], name: str) -> list[tuple]:
    """Merge the chunks of each shard, write its file, and return (shard, path, entries, total count, number) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # No key is in two shards, so a shard's rows are merged as they come, and its file is written at its end.
        def close() -> pa.RecordBatch:
            k, n = _merged(runs)
            runs.clear()
            arrays, number = make(shard, k, n)
            entries = arrays["keys.meta"][0]
            path = f"{folder}/{name}-{shard}-{np.random.default_rng().integers(1 << 62)}.bin"
            save(path, arrays)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([entries], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([number], pa.int64())], names=["shard", "path", "entries", "tokens", "number"])

        shard, runs, size = None, [], 0
        for batch in batches:
            for i, s in enumerate(batch.column(0).to_pylist()):
                if s != shard:
                    if shard is not None:
                        yield close()
                    shard, runs, size = s, [], 0
                runs.append((np.cumsum(_unplanes(batch.column(1)[i].as_buffer(), np.uint64), dtype=np.uint64), _unplanes(batch.column(2)[i].as_buffer(), np.uint32)))
                size += len(runs[-1][0])
                if size >= max(MERGE, len(runs[0][0])):  # as much again as is merged already
                    runs, size = [_merged(runs)], 0
        if shard is not None:
            yield close()

    spread = counted.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    made = materialise(spread.mapInArrow(released(run), "shard int, path string, entries long, tokens long, number long"), name)
    return sorted(tuple(r) for r in made.collect())


def _level(made: list[tuple], bounds: np.ndarray) -> tuple[Level, np.ndarray]:
    """The level of those shards that have entries, and their places among the bounds."""
    at = np.array([m[0] for m in made], dtype=np.int64)
    low = bounds[at].copy() if len(at) else bounds[:0]
    if len(low):
        low[0] = 0
    return Level(low, np.concatenate(([0], np.cumsum([m[2] for m in made]))).astype(np.int64), [m[1] for m in made]), at


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


def learn_words(docs: DataFrame, text_col: str = "text") -> Model:
    """The lowest level of the trie, from all texts of docs (null: empty): the words' hashes and counts."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    size = 4 << max(0, texts.count() // SHARD_DOCS).bit_length()
    bounds = np.array([i * ((1 << 64) // size) for i in range(size)], dtype=np.uint64)

    def make_words(_, keys, counts):
        return EliasFano.build(keys).arrays("keys") | {"counts": counts}, 0

    made = _build(_count_words(texts, bounds), size, new_folder(spark, "words"), make_words, "words")
    vocabulary, _ = _level(made, bounds)
    model = Model(vocabulary, int(vocabulary.starts[-1]), sum(m[3] for m in made), -1)
    if model.V:
        model.end = int(vocabulary.find(np.array([END], dtype=np.uint64))[0])
    return model


def learn(docs: DataFrame, text_col: str = "text", order: int = 3, shard_tokens: int = SHARD_TOKENS, least: int = 1) -> Model:
    """Build the trie from all texts of docs (null: empty). Its files are in the shared folder."""
    words = learn_words(docs, text_col)
    if not words.V or order < 2:
        return words
    return learn_orders(materialise(encode(docs.select(text_col), words, text_col), "ranks"), words, order, shard_tokens, least)


def learn_orders(encoded: DataFrame, words: Model, order: int = 3, shard_tokens: int = SHARD_TOKENS, least: int = 1) -> Model:
    """The levels above the words, from texts of encode().

    Each level is counted over the whole corpus: tasks emit counted keys chunk by chunk, packed by shard; a task
    per shard merges them and writes the shard's file. Shards hold whole contexts. Smoothing is Witten-Bell: with
    c the context's count, K that of its kept continuations and t their number, a continuation counted n has
    (n + (c - K + t) * p) / (c + t), with p from the level below; another one has (c - K + t) / (c + t) * p.
    All n-grams are kept; with `least` above 1, trigrams seen less often are left to the bigrams. The driver holds one
    row per shard.
    """
    if not words.V:
        return words
    spark = encoded.sparkSession
    folder = new_folder(spark, "trie")
    model = replace(words)
    V, total = model.V, model.total

    # Bigrams: a shard is a range of first words.
    shards = max(1, min(V, -(-total // shard_tokens)))
    firsts = np.array([i * V // shards for i in range(shards + 1)], dtype=np.int64)
    bounds = firsts[:-1].astype(np.uint64) * np.uint64(V)
    below = spark.sparkContext.broadcast(model)

    def make_bigrams(s, keys, counts):
        own = below.value
        a, b = (keys // np.uint64(V)).astype(np.int64), (keys % np.uint64(V)).astype(np.int64)
        width = firsts[s + 1] - firsts[s]
        number = np.bincount(a - firsts[s], minlength=width)  # successors of each word
        of = np.repeat(np.arange(width), number)
        context = np.zeros(width)
        some = np.flatnonzero(number)
        context[some] = own.vocabulary.take("counts", some + firsts[s])
        kept = np.bincount(of, weights=counts, minlength=width)
        spare, whole = context - kept + number, np.maximum(context + number, 1)
        logs = np.empty(len(keys), dtype=np.uint16)
        for k in range(0, len(keys), CHUNK):
            at = slice(k, k + CHUNK)
            logs[at] = quantise(np.log10((counts[at] + spare[of[at]] * 10.0 ** own.word_logs(b[at])) / whole[of[at]]))
        backoff = np.zeros(width)
        backoff[some] = np.log10(spare[some] / whole[some])
        pointers = np.concatenate(([0], np.cumsum(number))).astype(np.uint64)
        return EliasFano.build(keys).arrays("keys") | EliasFano.build(pointers).arrays("pointers") | {"logs": logs, "backoff": quantise(backoff), "counts": _small(counts), "second": b.astype(np.uint32 if V < 1 << 32 else np.uint64)}, 0

    pairs = lambda x: x[:-1].astype(np.uint64) * np.uint64(V) + x[1:].astype(np.uint64)
    made = _build(_count(encoded, lambda: below.value, bounds, pairs), shards, folder, make_bigrams, "bigrams")
    model.bigrams, at = _level(made, bounds)
    model.ranks = np.append(firsts[at], V)
    model.ranks[0] = 0
    if order < 3:
        return model
    # Pointers into the trigrams: a bigram has as many places there as its second word has successors.
    two = spark.sparkContext.broadcast(model)

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = two.value
        for batch in batches:
            for s in batch.column(0).to_pylist():
                second = np.asarray(own.bigrams.arrays(s)["second"]).astype(np.int64)
                room = np.concatenate([_successors(own, second[k : k + CHUNK]) for k in range(0, len(second), CHUNK)])
                base = np.concatenate(([0], np.cumsum(room)))
                path = f"{folder}/base-{s}-{np.random.default_rng().integers(1 << 62)}.bin"
                save(path, EliasFano.build(base[:-1].astype(np.uint64)).arrays("base"))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([path]), pa.array([int(base[-1])], pa.int64())], names=["shard", "path", "size"])

    order_by = spark.range(len(made)).select(F.col("id").cast("int").alias("shard")).repartitionById(len(made), F.col("shard"))
    based = sorted(tuple(r) for r in materialise(order_by.mapInArrow(point, "shard int, path string, size long"), "bases").collect())
    model.bigrams.extra = [r[1] for r in based]
    model.bases = np.concatenate(([0], np.cumsum([r[2] for r in based]))).astype(np.uint64)

    # Trigrams: a shard is a range of bigrams.
    B = int(model.bigrams.starts[-1])
    shards = max(1, min(B, -(-total // shard_tokens)))
    nodes = np.array([i * B // shards for i in range(shards + 1)], dtype=np.int64)
    bounds = model.bigrams.access("base", nodes[:-1], model.bases)
    keep = np.flatnonzero(np.append(np.diff(bounds) > 0, True))
    nodes, bounds, shards = np.append(nodes[:-1][keep], B), bounds[keep], len(keep)
    nodes[0], bounds[0] = 0, 0
    both = spark.sparkContext.broadcast(model)

    def triples(x):
        own = both.value
        words, back = np.unique(x[1:-1], return_inverse=True)
        first = own.first(words)[back]
        places, which = own.bigram_places(x)
        going = x[1:-1] != own.end  # nothing goes on over an end
        if least > 1:  # a trigram is as rare as its bigrams at least
            often = np.append(False, own.bigrams.take("counts", places[1:]) >= least)
            going &= often[which[:-1]] & often[which[1:]]
        at = np.flatnonzero(going)
        used = np.zeros(len(places), dtype=bool)
        used[which[at]] = True
        used = np.flatnonzero(used)
        base = np.zeros(len(places), dtype=np.uint64)
        base[used] = own.bigrams.access("base", places[used], own.bases)
        return base[which[at]] + (places[which[at + 1]] - first[at]).astype(np.uint64)

    def make_trigrams(s, keys, counts):
        own = both.value
        if least > 1:
            some = counts >= least
            keys, counts = keys[some], counts[some]
        low, high = nodes[s], nodes[s + 1]
        number, kept, of = np.zeros(high - low, dtype=np.int64), np.zeros(high - low, dtype=np.int64), np.empty(len(keys), dtype=np.int32 if high - low < 1 << 31 else np.int64)
        # By stretches of bigrams, and of trigrams: what is worked out takes no more memory than the shard itself.
        for k in range(low, high, CHUNK):
            base = own.bigrams.access("base", np.arange(k, min(k + CHUNK, high)), own.bases)
            a, b = np.searchsorted(keys, base[0]) if k > low else 0, len(keys) if k + CHUNK >= high else np.searchsorted(keys, own.bigrams.access("base", np.array([k + CHUNK]), own.bases)[0])
            of[a:b] = np.searchsorted(base, keys[a:b], side="right") - 1 + (k - low)
        for k in range(0, len(keys), CHUNK):
            at = of[k : k + CHUNK]
            number += np.bincount(at, minlength=len(number))
            kept += np.bincount(at, weights=counts[k : k + CHUNK], minlength=len(kept)).astype(np.int64)
        logs, backoff = np.empty(len(keys), dtype=np.uint16), np.zeros(high - low, dtype=np.uint16)
        for k in range(0, len(keys), CHUNK):
            at, nodes_of = of[k : k + CHUNK], of[k : k + CHUNK].astype(np.int64) + low
            context = own.bigrams.take("counts", nodes_of).astype(float)
            last = own.first(own.bigrams.take("second", nodes_of)) + (keys[k : k + CHUNK] - own.bigrams.access("base", nodes_of, own.bases)).astype(np.int64)
            spare, whole = context - kept[at] + number[at], context + number[at]
            logs[k : k + CHUNK] = quantise(np.log10((counts[k : k + CHUNK] + spare * 10.0 ** (-QUANTUM * own.bigrams.take("logs", last))) / whole))
            # 0 stands for a bigram that no trigram continues.
            backoff[at] = np.maximum(quantise(np.log10(spare / whole)), 1)
        return EliasFano.build(keys).arrays("keys") | {"logs": logs, "backoff": backoff}, 0

    made = _build(_count(encoded, lambda: both.value, bounds, triples, 2), shards, folder, make_trigrams, "trigrams")
    model.trigrams, at = _level(made, bounds)
    if not made:
        model.trigrams = None
        return model
    model.nodes = np.append(nodes[:-1][at], B)
    model.nodes[0] = 0
    return model


def _successors(model: Model, ranks: np.ndarray) -> np.ndarray:
    """How many bigrams start with each word."""
    out = np.zeros(len(ranks), dtype=np.int64)
    for s, at in model.bigrams._split(np.searchsorted(model.ranks, ranks, side="right") - 1):
        pointers, own = model.bigrams.coded(s, "pointers"), ranks[at] - model.ranks[s]
        out[at] = (pointers.access(own + 1) - pointers.access(own)).astype(np.int64)
    return out


NEW = ("n_tokens", "n_known", "base_score", "score")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, base_score and score: sums of log10 over a text's words and one end.

    base_score takes each token alone, score the trie's probabilities, which begin from the end token as context.
    Whole texts are read, a bounded number of tokens at a time; a null text is empty, rows that repeat score alike, an
    empty table gives no rows. Every task maps the trie's files into memory; only their names are broadcast. Columns
    of docs stay, but those named like the new ones are replaced.
    """
    return score_encoded(encode(docs.drop(*NEW), model, text_col, True), model)


def score_encoded(encoded: DataFrame, model: Model) -> DataFrame:
    """score() for texts of encode(); their ranks go."""
    names = [c for c in encoded.columns if c != "__ranks"]
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sums, k = np.zeros((batch.num_rows, 4)), 0
            data = batch.column(len(names))
            # Documents stand one after another. No trigram continues an end, so the end of one is the only context
            # that the first token of the next has.
            while k < batch.num_rows:
                parts, first, length = [np.array([own.end])], k, 0
                while k < batch.num_rows and length < STRETCH:
                    parts.append(own.read(data[k].as_buffer()))
                    length += len(parts[-1])
                    k += 1
                ranks = np.concatenate(parts)
                starts = np.cumsum([0, *map(len, parts[1:-1])])
                values = [np.concatenate(x) for x in zip(*[_scored(own, ranks, at, STRETCH) for at in range(0, len(ranks) - 1, STRETCH)], strict=True)]
                for c, v in enumerate((np.ones(length), ranks[1:] >= 0, *values)):
                    sums[first:k, c] = np.add.reduceat(v.astype(float), starts)
            added = [pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)), pa.array(sums[:, 2]), pa.array(sums[:, 3])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], names=[*names, *NEW])

    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    slim = encoded.select(*[F.col(f"`{c}`") for c in names], "__ranks")
    return slim.mapInArrow(released(run), T.StructType([*(encoded.schema[c] for c in names), *(T.StructField(c, t) for c, t in zip(NEW, kinds, strict=True))]))


def _scored(model: Model, ranks: np.ndarray, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of n tokens after place `at`, alone and with the two tokens before each as context."""
    back = min(at, 1)
    facts = model.facts(ranks[at - back : at + 1 + n])
    return facts[1][1 + back :], model.score(*facts)[back:]
