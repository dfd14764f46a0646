"""MinHash near-duplicate detection with DartMinHash signatures and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WordHashes, materialise, mixed, released, texts_of, token_hashes

SHINGLE = 5
BANDS, ROWS = 28, 6
#: Darts are thrown over stretches of time that double, from this one on.
FIRST_TIME = 2.0**-12
#: Cells (element, unit of weight) that one batch of signatures holds.
CELLS = 1 << 19
#: Members of a bucket's largest group with which the members of its other groups are compared first.
HUBS = 8
#: Standard errors by which the signature may understate a pair's similarity before the pair is compared by text.
SLACK = 4.0
#: Strays and members of a bucket that are compared together, and shingles that either of them has about.
CHUNK_STRAYS, CHUNK_MEMBERS, CHUNK_SHINGLES = 256, 1024, 1 << 18
#: Copies of one text from which its class is broadcast: at least so many, and more than a share of all rows that at
#: most MOST_HOT texts can have.
LEAST_HOT, MOST_HOT = 256, 1 << 16
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def shingles(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the distinct runs of SHINGLE tokens, sorted; a shorter text is one run."""
    if not len(tokens):
        return tokens
    n = max(1, len(tokens) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(tokens))):
        h = h + mixed(tokens[k : k + n] * _FACTORS[k])
    return np.unique(mixed(h))


def fingerprint(tokens: np.ndarray, text: str | None) -> int:
    """64 bits of the token sequence; of the text itself where it has no tokens. As a signed number."""
    if not len(tokens):
        tokens = np.frombuffer((text or "").strip().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) ^ np.uint64(1 << 63)
    at = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    return int(mixed(np.array([mixed(tokens + at * _FACTORS[0]).sum(dtype=np.uint64)], dtype=np.uint64)).view(np.int64)[0])


def _counts(mean: float) -> np.ndarray:
    """Thresholds of a 64-bit hash at which a Poisson count of this mean reaches 1, 2, ..."""
    k = np.arange(int(mean + 12 * np.sqrt(mean) + 20))
    logs = -mean + k * np.log(mean) - np.concatenate(([0.0], np.cumsum(np.log(np.maximum(k[1:], 1)))))
    return (np.minimum(np.cumsum(np.exp(logs)), 1 - 2.0**-53) * 2.0**64).astype(np.uint64)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures of weighted sets: for each coordinate the time of its earliest dart, as bits.

    elements, weights, owner: the sets' elements (64-bit hashes), their weights (above 0) and which set they are in.
    For each element and unit of its weight, darts fall as a Poisson process whose randomness is a hash of element,
    unit, stretch of time and dart, so that sets share the darts of what they share; each dart hits one of k
    coordinates. A dart beyond the element's weight misses. Time goes on by doubling stretches until all
    coordinates of a set are hit: later darts can't be earlier. The times of two sets agree in a coordinate with
    the probability of their weighted Jaccard similarity. Sets without elements keep the largest value throughout.
    """
    units = np.ceil(weights).astype(np.int64)
    cell_of = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(cell_of)) - np.repeat(np.cumsum(units) - units, units)
    cells = mixed(elements[cell_of] + unit.astype(np.uint64) * _FACTORS[1])
    room = np.minimum(weights[cell_of] - unit, 1.0)
    at = owner[cell_of]
    out = np.full(n * k, np.uint64(0xFFFFFFFFFFFFFFFF))
    begin, end, stretch = 0.0, FIRST_TIME, 0
    while len(cells):
        steps = _counts(k * (end - begin))
        drawn = mixed(cells ^ np.uint64((stretch + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        hit = np.flatnonzero(drawn >= steps[0])
        number = np.searchsorted(steps, drawn[hit], side="right")
        which = np.repeat(hit, number)
        dart = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
        h = mixed(drawn[which] + dart.astype(np.uint64) * _FACTORS[2])
        more = mixed(h ^ _FACTORS[3])
        inside = (more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < room[which]
        which, h, more = which[inside], h[inside], more[inside]
        time = begin + (end - begin) * ((h >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        place = at[which] * k + (((more >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, place, time.view(np.uint64))
        open_sets = (out.reshape(n, k) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
        going = open_sets[at]
        cells, room, at = cells[going], room[going], at[going]
        begin, end, stretch = end, end * 2, stretch + 1
    return out.reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands hashes of `rows` coordinates each, signed; bands never share a key but by chance."""
    parts = signatures.reshape(len(signatures), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _FACTORS[4], parts.shape[:2])
    for r in range(rows):
        h = mixed(h ^ mixed(parts[:, :, r] + np.uint64(r)))
    return h.view(np.int64)


def nibble_words(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 coordinates to a word, signed."""
    nibbles = (mixed(signatures) & np.uint64(15)).astype(np.uint64)
    nibbles = np.hstack([nibbles, np.zeros((len(nibbles), -nibbles.shape[1] % 16), dtype=np.uint64)]).reshape(len(nibbles), -1, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def _most_different(least: float, k: int, slack: float) -> int:
    """Coordinates whose four bits may differ at this similarity, `slack` standard errors above the expectation."""
    differ = (1 - least) * 15 / 16
    return int(min(k, k * differ + slack * np.sqrt(k * differ * (1 - differ))))


def _may_be_similar(least: float, k: int, slack: float) -> Column:
    """Whether a pair (columns n, bits; m, marks) can have the similarity: by the sets' sizes, which is exact, and by
    the coordinates whose four bits differ, within `slack` standard errors."""
    words = [F.col("bits")[i].bitwiseXOR(F.col("marks")[i]) for i in range(-(-k // 16))]
    folded = [x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)) for x in words]
    found = sum((F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))) for x in folded), F.lit(0))
    return (F.least("n", "m") >= F.greatest("n", "m") * least) & (found <= _most_different(least, k, slack))


def sketch(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, hash (of the text), node (fingerprint), n (shingles), bits and keys (none without tokens), in one pass."""

    def signed(sets: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        elements = np.concatenate(sets)
        signatures = dart_signatures(elements, np.ones(len(elements)), owner, len(sets), bands * rows)
        words, keys = nibble_words(signatures), band_keys(signatures, bands, rows)
        return [w if len(x) else w[:0] for w, x in zip(words, sets, strict=True)], [k if len(x) else k[:0] for k, x in zip(keys, sets, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            nodes, sizes, lists, sets, cells = [], [], ([], []), [], 0
            for text in texts_of(batch.column(2)):
                tokens = token_hashes(text, hashes)
                nodes.append(fingerprint(tokens, text))
                sets.append(shingles(tokens))
                sizes.append(len(sets[-1]))
                cells += sizes[-1]
                if cells >= CELLS or len(nodes) == batch.num_rows:
                    for have, new in zip(lists, signed(sets), strict=True):
                        have.extend(new)
                    sets, cells = [], 0
            packed = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in y]))), pa.int32()), pa.array(np.concatenate(y) if y else [], pa.int64())) for y in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *packed], names=["id", "hash", "node", "n", "bits", "keys"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return slim.mapInArrow(released(run), "id long, hash long, node long, n long, bits array<long>, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, shingles (sorted 64-bit hashes as bytes) of the wanted nodes. wanted: node and the id of a row that has it.

    A repeated id can bring another text; the fingerprint tells. The join is by shuffle whatever the sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                tokens = token_hashes(text, hashes)
                if fingerprint(tokens, text) == node:
                    nodes.append(node)
                    sets.append(shingles(tokens).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.join(wanted.hint("merge"), "id").select("node", "text").mapInArrow(released(run), "node long, shingles binary").dropDuplicates(["node"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label: the smallest node connected with it, for the nodes of edges (a, b).

    Every node takes the smallest label among its neighbours and its own, then its label's label; labels so reach
    over twice the distance with each round. Each round is a table in the shared folder, so lineage stays short.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialise(new.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), f"{name}-labels")
        if new.filter("label < old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of `least` or more; empty ones have none."""
    small, large = sorted((len(x), len(y)))
    if not small or small < least * large:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= least * (len(x) + len(y) - common)


def _verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets of shingles have a Jaccard similarity of `least` or more.

    pairs: a, b, hub (one of the two), load (rows of the bucket that they met in). The members of a hub are cut into
    parts of about CHUNK_MEMBERS by hash; a part streams behind its hub's set, so a task holds two sets.
    """
    member = F.when(F.col("hub") == F.col("b"), F.col("a")).otherwise(F.col("b"))
    rows = pairs.select("hub", "load", member.alias("member"))
    rows = rows.select("hub", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("load") / CHUNK_MEMBERS)).cast("int").alias("part"))
    asked = rows.join(sets, F.col("member") == F.col("node")).select("hub", "part", F.lit(1).alias("place"), "member", "shingles")
    hubs = rows.select("hub", "part").distinct().join(sets, F.col("hub") == F.col("node")).select("hub", "part", F.lit(0).alias("place"), F.col("hub").alias("member"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            hub, place, node = (batch.column(c).to_numpy() for c in (0, 2, 3))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, data in enumerate(batch.column(4)):
                one = np.frombuffer(data.as_buffer(), dtype=np.uint64)
                if place[i]:
                    keep[i] = _similar(one, own, least)
                else:
                    own = one.copy()
            a, b = np.minimum(hub, node)[keep], np.maximum(hub, node)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = hubs.unionByName(asked).repartition("hub", "part").sortWithinPartitions("hub", "part", "place")
    return dealt.mapInArrow(released(run), "a long, b long")


def _differ(bits: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Coordinates of each row whose four bits differ from those of one."""
    x = bits ^ one
    x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & np.uint64(0x1111111111111111)
    return np.bitwise_count(x).sum(axis=1)


class _Chunk:
    """Strays and members of one bucket: columns key, node, label, stray, n, bits, keys, asks."""

    def __init__(self, table: pa.Table, least: float, most: int):
        self.node, self.label, self.size = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        self.stray, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("stray", "asks"))
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        self.bits, self.keys, self.key = flat("bits").view(np.uint64), np.sort(flat("keys"), axis=1), table.column("key")[0].as_py()
        self.asking, self.members, self.least, self.most = np.flatnonzero(asks), np.flatnonzero(~asks), least, most

    def candidates(self, i: int) -> np.ndarray:
        """Members of other groups that may be similar to stray i, most similar first; each pair once, in the bucket
        with the smallest key that both are in."""
        m = self.members
        differ = _differ(self.bits[m], self.bits[i])
        may = (differ <= self.most) & (self.label[m] != self.label[i]) & ~(self.stray[m] & (self.node[m] < self.node[i]))
        may &= np.minimum(self.size[m], self.size[i]) >= self.least * np.maximum(self.size[m], self.size[i])
        at, differ = m[may], differ[may]
        if len(at):
            # Keys are in order, so the first that both have is the smallest.
            both = np.isin(self.keys[at], self.keys[i])
            own = self.keys[at, both.argmax(axis=1)] == self.key
            at, differ = at[own], differ[own]
        return at[np.argsort(differ, kind="stable")]


_ROW = "key long, sc int, mc int, node long, label long, stray boolean, n long, bits array<long>, keys array<long>, asks boolean"


def _survivors(placed: DataFrame, least: float, most: int) -> DataFrame:
    """Rows of chunks of strays and members that are in a pair that may be similar: by ids and signatures, without texts.

    placed: key, node, label, stray, n, bits, keys. Strays and members of a bucket are cut into chunks by hash, and a
    task compares one chunk with another, so that rows grow with the number of chunks rather than of pairs.
    """
    wide = lambda rows, size, top: F.greatest(F.lit(1), F.ceil(rows / top), F.ceil(size / CHUNK_SHINGLES)).cast("int")
    sizes = placed.groupBy(F.col("key").alias("k")).agg(wide(F.count_if("stray"), F.sum(F.when(F.col("stray"), F.col("n")).otherwise(0)), CHUNK_STRAYS).alias("ns"), wide(F.count(F.lit(1)), F.sum("n"), CHUNK_MEMBERS).alias("nm"))
    # A table of its own, so that the join can be split where a bucket is large.
    rows = placed.join(materialise(sizes, "chunks"), F.col("key") == F.col("k")).drop("k")
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["node", "label", "stray", "n", "bits", "keys"]
    strays = rows.filter("stray").select("key", chunk("ns").alias("sc"), each("nm").alias("mc"), *columns, F.lit(True).alias("asks"))
    members = rows.select("key", each("ns").alias("sc"), chunk("nm").alias("mc"), *columns, F.lit(False).alias("asks"))

    def run(table: pa.Table) -> pa.Table:
        own, wanted = _Chunk(table, least, most), np.zeros(table.num_rows, dtype=bool)
        for i in own.asking:
            if len(found := own.candidates(i)):
                wanted[found] = wanted[i] = True
        return table.filter(pa.array(wanted)).select(_NAMES)

    return strays.unionByName(members).groupBy("key", "sc", "mc").applyInArrow(run, _ROW)


_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _cross(found: DataFrame, sets: DataFrame, least: float, most: int) -> DataFrame:
    """Links (a, b) among the survivors: one for each stray and group, if there is one.

    Both sides of a pair of chunks have CHUNK_SHINGLES shingles about, which bounds what a task holds.
    """

    def run(table: pa.Table) -> pa.Table:
        own = _Chunk(table, least, most)
        known = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("shingles")]
        out = []
        for i in own.asking:
            linked = set()
            for j in own.candidates(i):
                if own.label[j] not in linked and _similar(known[i], known[j], least):
                    linked.add(own.label[j])
                    out.append((min(own.node[i], own.node[j]), max(own.node[i], own.node[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return found.join(sets, "node").groupBy("key", "sc", "mc").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", name: str = "near", slack: float = SLACK) -> DataFrame:
    """id, hash, node, label, class_id, class_size: one row per row of docs, whose groups are of near-copies.

    Tokens are lower-cased runs of word characters. Texts with equal tokens are one node. Nodes whose sets of
    five-token shingles have a Jaccard similarity of `least` or more are linked, and groups are what links connect.
    label: the smallest node of the group; class_id: the smallest id; class_size: its rows; hash: xxhash64 of the text.

    Candidates share a band of their DartMinHash signatures. In each bucket all members are compared with one hub
    rather than with each other. Members that this leaves apart from the largest group of their bucket are compared
    with HUBS of its members, and what is still apart then with every member of another group in the bucket, chunk
    by chunk. Pairs within one group need no comparison, so a bucket of thousands of near-copies of one text costs
    about one comparison each, and no link between groups is lost. Candidates are compared by ids and signatures
    first: a pair has to pass by the sizes of its sets and by four bits of each coordinate, within `slack` standard
    errors (infinite: no filter). What passes is compared by its whole sets of shingles. At a similarity of just 0.8,
    28 bands of 6 find a pair with a probability of 0.9998, at 0.85 with 0.999998; more bands of fewer rows find more.

    Ids have to be integers. A null id takes no part in groups but through equal tokens: it gets their class_id, or
    null. Null and empty texts and those without word characters are copies of texts equal but for white space at the
    ends. Rows that repeat an id are kept apart. Other columns of docs don't matter. An empty table gives no rows.
    """
    sketched = materialise(sketch(docs, bands, rows, id_col, text_col), f"{name}-sketch")
    every = sketched.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    nodes = every.filter("id is not null")
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    several = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("load")).filter("load > 1")
    members = materialise(buckets.join(several, "key").join(nodes.select("node", "n", "bits"), "node"), f"{name}-members")
    sets = materialise(shingle_sets(docs, members.select("node").distinct().join(nodes.select("node", "id"), "node"), id_col, text_col), f"{name}-sets")
    alike = _may_be_similar(least, bands * rows, slack)

    def with_hubs(of: DataFrame, hubs: DataFrame, apart: Column) -> DataFrame:
        """Pairs of members with their bucket's hub (node, n, bits) that may be similar."""
        hubs = hubs.select(F.col("key").alias("hub_key"), F.col("hub.node").alias("b"), F.col("hub.n").alias("m"), F.col("hub.bits").alias("marks"), *[c for c in hubs.columns if c not in ("key", "hub")])
        met = of.join(hubs, (F.col("key") == F.col("hub_key")) & apart & alike)
        return met.groupBy(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("z")).agg(F.min("b").alias("hub"), F.max("load").alias("load")).withColumnRenamed("z", "b")

    hubs = members.groupBy("key").agg(F.min(F.struct("node", "n", "bits")).alias("hub"))
    tried = materialise(with_hubs(members, hubs, F.col("node") != F.col("b")), f"{name}-pairs")
    links = materialise(_verify(tried, sets, least), f"{name}-links")
    for step in range(2):
        labels = components(links, f"{name}-{step}")
        placed = members.join(labels, "node", "left").select("key", "node", "n", "bits", "load", F.coalesce("label", "node").alias("label"))
        apart = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
        # In a bucket of two, the pair has been compared.
        placed = materialise(placed.filter("load > 2").join(apart.select("key"), "key"), f"{name}-placed")
        if placed.isEmpty():
            break
        # The group with the most members of a bucket is where most others belong; its members stay.
        picks = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "n", "bits")).alias(f"pick{i}") for i in range(HUBS)] if not step else []
        sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), *picks)
        each = F.array_distinct(F.array(*[F.struct(f"pick{i}.node", f"pick{i}.n", f"pick{i}.bits") for i in range(HUBS)])) if not step else F.lit(0)
        main = sizes.groupBy("key").agg(F.max(F.struct("size", F.col("label").alias("main"), each.alias("hubs"))).alias("top")).select("key", "top.main", "top.hubs")
        if not step:
            some = main.select("key", "main", F.explode("hubs").alias("hub"))
            new = materialise(with_hubs(placed, some, F.col("label") != F.col("main")).join(tried.select("a", "b"), ["a", "b"], "left_anti"), f"{name}-pairs")
            found = _verify(new, sets, least)
        else:
            marked = placed.join(main.select("key", "main"), "key").withColumn("stray", F.col("label") != F.col("main")).drop("main", "load")
            most = _most_different(least, bands * rows, slack)
            near = materialise(_survivors(marked.join(nodes.select("node", "keys"), "node"), least, most), f"{name}-near")
            found = _cross(near, sets, least, most)
        links = links.unionByName(materialise(found, f"{name}-links"))
        if step:
            labels = components(links, f"{name}-last")
    of = every.select("node", "id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = of.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = materialise(of.select("node", "label", "copies").join(classes, "label"), f"{name}-classes")
    # Texts with very many copies: no more than MOST_HOT of them, so their classes can be broadcast.
    hot = F.col("copies") > max(LEAST_HOT, sketched.count() // MOST_HOT)
    wide = F.struct("label", "class_id", "class_size").alias("of")
    rest = sketched.select("id", "hash", "node").join(F.broadcast(named.filter(hot).select("node", wide)), "node", "left")
    cold = rest.filter("of is null").drop("of").join(named.filter(~hot).select("node", wide), "node")
    return rest.filter("of is not null").unionByName(cold).select("id", "hash", "node", "of.*")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each group of near_duplicates(): that with the smallest id stays.

    Where that id has several rows in the group, that with the smallest hash of its text stays, once. Rows with a null
    id all stay. Columns of docs stay as they are.
    """
    stay = groups.filter("id is not null").groupBy("label").agg(F.min(F.struct("id", "hash")).alias("first")).select(F.col("first.id").alias("stay_id"), F.col("first.hash").alias("stay_hash")).distinct()
    own = docs.filter(F.col(id_col).isNotNull())
    packed = own.select(F.col(id_col).cast("long").alias("stay_id"), F.xxhash64(text_col).alias("stay_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = Window.partitionBy("stay_id", "stay_hash").orderBy(F.xxhash64("row"))
    kept = packed.join(stay, ["stay_id", "stay_hash"]).withColumn("place", F.row_number().over(first)).filter("place = 1")
    return kept.select("row.*").unionByName(docs.filter(F.col(id_col).isNull()))
