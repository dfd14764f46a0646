"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, released, texts_of

#: Labelled rows to learn from, at most; chosen by hash of the id. It bounds what the driver holds: a few numbers for
#: each of these rows and each feature or voter found in them. Every other step covers all rows.
MOST_LABELLED = 12_000
#: A feature is taken if its log-odds ratio less two standard errors is at least this.
LEAST_BOUND = 2.0
#: Lengths of beginnings of words, and of those that several words of a text share.
BEGINNINGS, STEMS = range(4, 9), range(3, 9)
#: Features whose documents overlap more than this are one voter.
SAME = 0.5
#: Voters that each know about half of the lexicon.
HALVES = 8
#: Voters count as one witness from this correlation on, given the class; and from this one on before anything is known.
#: Below, correlation is mostly that of kinds of toxic texts, whose words come together.
LEAST_CORRELATION, CLOSE = 0.6, 0.8
_WORD = re.compile(r"\w+")
#: Voters by pattern rather than by lexicon, over the original text: for toxicity, and what has to be absent for a vote against.
PATTERNS = {"shouting": (re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{2,}\b){3,}"), re.compile(r"\b[A-Z]{4,}\b")), "runs": (re.compile(r"([!?])\1{2,}"), re.compile(r"[!?]"))}


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(found: set[str]) -> set[str]:
    """Of a text's words: =word, ^beginning, and #stem where two words begin with it and go on."""
    out = {"=" + w for w in found}
    out.update("^" + w[:n] for w in found for n in BEGINNINGS if len(w) >= n)
    shared = Counter(w[:n] for w in found for n in STEMS if len(w) > n)
    out.update("#" + s for s, n in shared.items() if n > 1)
    return out


def patterns(text: str | None) -> list[int]:
    """Votes by pattern: 1 for toxicity, -1 against, 0 for none."""
    return [1 if text and there.search(text) else -1 if not text or not nothing.search(text) else 0 for there, nothing in PATTERNS.values()]


@dataclass
class Model:
    """Weights by feature and the bias; and what the label model found: by voter, P(vote = -1, 0, 1) given clean and
    given toxic, its correlations with the others given the label, and the share of its vote that counts."""

    weights: dict[str, float]
    bias: float
    voters: list[str] = field(default_factory=list)
    given_clean: np.ndarray | None = None
    given_toxic: np.ndarray | None = None
    correlations: np.ndarray | None = None
    shares: np.ndarray | None = None

    def of(self, word: str) -> tuple[float, tuple[str, ...]] | None:
        """The weight of a word and its beginnings, and those of its stems that have one; None for most words."""
        total = sum(self.weights.get(f, 0.0) for f in ("=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)))
        stems = tuple(s for n in STEMS if len(word) > n and (s := "#" + word[:n]) in self.weights)
        return (total, stems) if total or stems else None

    def score(self, found: set[str], cache: dict[str, tuple[float, tuple[str, ...]] | None]) -> float:
        hits = []
        for word in found:
            if word not in cache:
                if len(cache) > 1 << 18:
                    cache.clear()
                if len(word) > 64:
                    hits.append((word, self.of(word)))
                    continue
                cache[word] = self.of(word)
            if (known := cache[word]) is not None:
                hits.append((word, known))
        # In one order, so that sums agree bit by bit from run to run.
        total, stems = self.bias, Counter()
        for _, known in sorted(hits, key=lambda h: h[0]):
            if known is not None:
                total += known[0]
                stems.update(known[1])
        total += sum(self.weights[s] for s, n in sorted(stems.items()) if n > 1)
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """text, toxic of `most` labelled documents at most, by hash of the id; written once, as it is read twice.

    Of labels that repeat an id the largest counts; documents that repeat one are rows of their own.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    # A top-k by hash; the bound makes it fit to broadcast.
    few = known.orderBy(F.xxhash64("id"), "id").limit(most)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialise(own.join(F.broadcast(few), "id").select("id", "text", "toxic"), "labelled")


def mine(sample: DataFrame, toxic_docs: int, clean_docs: int) -> list[str]:
    """The lexicon: features whose documents are toxic far more often than others, best first.

    By the log-odds ratio less two standard errors, which has to be LEAST_BOUND at least: a common word with a slight
    tilt, of which there are many by chance, doesn't reach it, a rare one that decides does from a few documents on.
    Labels are used here, to find words; how far to trust them is up to the label model.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = features(words(text))
                n.update(found)
                if toxic:
                    bad.update(found)
        names = list(n)
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[x] for x in part], pa.int64()), pa.array([bad[x] for x in part], pa.int64())], names=["f", "n", "bad"])

    counts = sample.select("text", "toxic").mapInArrow(released(count), "f string, n long, bad long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    good = F.col("n") - F.col("bad")
    odds = F.log((F.col("bad") + 0.5) / (F.lit(toxic_docs) - F.col("bad") + 0.5)) - F.log((good + 0.5) / (F.lit(clean_docs) - good + 0.5))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (good + 0.5))
    best = counts.filter("bad > 0").select("f", (odds - 2 * error).alias("z")).filter(F.col("z") >= LEAST_BOUND)
    return [r["f"] for r in best.orderBy(F.col("z").desc(), "f").collect()]


def families(rows: list[np.ndarray], n: int) -> np.ndarray:
    """Which voter each of n features belongs to: features that mostly occur in the same documents are one."""
    sets = [np.zeros(0, dtype=np.int64) for _ in range(n)]
    if rows:
        at, of = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        order = np.argsort(of, kind="stable")
        sets = np.split(at[order], np.searchsorted(of[order], np.arange(1, n)))
    out = np.arange(n)
    first: list[int] = []
    for i in range(n):  # best first, so a voter is named by its best feature
        for j in first:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both > SAME * (len(sets[i]) + len(sets[j]) - both):
                out[i] = j
                break
        else:
            first.append(i)
    return np.unique(out, return_inverse=True)[1]


def votes_of(rows: list[np.ndarray], marks: np.ndarray, family: np.ndarray, lexicon: list[str]) -> tuple[np.ndarray, list[str]]:
    """Documents x voters, each 1 for toxicity, -1 against or 0, and the voters' names.

    A lexicon voter votes for toxicity where one of its features is, and abstains elsewhere. HALVES voters know about
    half of the lexicon each: they vote against where nothing of theirs is, for from two families on, and abstain in
    between. Pattern voters vote either way.
    """
    n = int(family.max()) + 1 if len(family) else 0
    own = np.zeros((len(rows), n), dtype=np.int8)
    for i, r in enumerate(rows):
        own[i, family[r]] = 1
    names = [lexicon[int(np.flatnonzero(family == j)[0])] for j in range(n)]
    halves = np.array([[crc32(f"{k}|{name}".encode()) >> 7 & 1 for name in names] for k in range(HALVES)], dtype=np.int64).reshape(HALVES, n)
    known = own @ halves.T
    every = np.hstack([own, np.where(known == 0, -1, np.where(known > 1, 1, 0)).astype(np.int8), marks.astype(np.int8)])
    return every, [*names, *(f"half {k}" for k in range(HALVES)), *PATTERNS]


def label_model(votes: np.ndarray, start: np.ndarray | None = None, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A generative model of votes, fitted without labels: posteriors, P(vote | class 0), P(vote | class 1) (voters x
    (-1, 0, 1)), correlations of voters given the class, and shares.

    Each row has a hidden class, and a voter votes -1, 0 or 1 with probabilities that depend on it: its accuracy both
    ways and how often it abstains. EM estimates these from how voters agree; a start (posteriors, else the majority
    of votes) only decides which of several fits it ends in, as where groups of voters never meet.
    Then correlations that the class does not explain are estimated from what is left of the votes, and each voter
    counts for the share 1 / (the sum of its correlations from LEAST_CORRELATION on, with itself 1), as k voters that
    always agree count as one; EM goes on with these shares. Voters that agree almost always, by the plain
    correlation, share from the beginning.
    """
    kinds = [(votes == s).astype(np.float32) for s in (-1, 0, 1)]
    flat = votes.astype(np.float32)

    def given(q: np.ndarray) -> np.ndarray:
        p = np.array([q @ k + 0.5 for k in kinds], dtype=np.float64)
        return p / p.sum(axis=0)

    def fit(q: np.ndarray, shares: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
            ratio = np.log(given(q) / given(1 - q)) * shares
            logit = np.log(prior / (1 - prior)) + sum(k @ r for k, r in zip(kinds, ratio, strict=True))
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            done = np.abs(new - q).max() < 1e-6
            q = new
            if done:
                break
        return q

    def related(*weights: np.ndarray) -> np.ndarray:
        """Correlations of what a class's means leave of the votes, over classes by size."""
        out = np.zeros((votes.shape[1], votes.shape[1]))
        for w in weights:
            left = flat - (w @ flat) / max(w.sum(), 1e-9)
            cov = (left * w[:, None]).T @ left / max(w.sum(), 1e-9)
            spread = np.sqrt(np.diag(cov)) + 1e-6
            out += w.mean() * cov / np.outer(spread, spread)
        np.fill_diagonal(out, 1.0)
        return out

    def counted(correlations: np.ndarray, least: float) -> np.ndarray:
        return 1 / np.where(correlations >= least, correlations, 0).sum(axis=1)

    if start is None:
        start = np.where(votes.sum(axis=1, dtype=np.int64) > 0, 0.9, 0.1)
    # Near copies of one voter would be taken for the class itself.
    q = fit(start, counted(related(np.ones(len(votes), dtype=np.float32)), CLOSE))
    correlations = related(q, 1 - q)
    shares = counted(correlations, LEAST_CORRELATION)
    q = fit(q, shares)
    return q, given(1 - q).T, given(q).T, correlations, shares


def fit_linear(rows: list[np.ndarray], target: np.ndarray, n: int, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam; rows hold each document's feature numbers."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    w, bias = np.zeros(n), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(at, weights=w[flat], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        grad = np.append(np.bincount(flat, weights=error[at], minlength=n) + decay * w / 10, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, bias = w - move[:n], bias - move[n]
    return w, bias


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled documents. labels: the rows to learn from only.

    Labels find the lexicon (mine) and tell the label model which of its classes is meant: it starts from them, but
    what it fits is votes only. The classifier learns its posteriors over the features of the lexicon. With no labels,
    or one kind only, or no lexicon, every score is the base rate.
    """
    sample = labelled_sample(docs, labels, most, id_col, text_col, label_col)
    sizes = {r["toxic"] != 0: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    lexicon = mine(sample, bad, good) if bad and good else []
    if not lexicon:
        rate = (bad + 0.5) / (bad + good + 1)
        return Model({}, float(np.log(rate / (1 - rate))) if bad else -5.0)
    number = {f: i for i, f in enumerate(lexicon)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks = [], []
            for text in texts_of(batch.column(1)):
                rows.append(np.array(sorted(number[f] for f in features(words(text)) if f in number), dtype=np.int32).tobytes())
                marks.append(np.array(patterns(text), dtype=np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(marks, pa.binary()), batch.column(2)], names=["id", "rows", "marks", "toxic"])

    got = sample.select("id", "text", "toxic").mapInArrow(released(encode), T.StructType([sample.schema["id"], *T._parse_datatype_string("rows binary, marks binary, toxic int").fields])).toPandas().sort_values(["id", "rows"], kind="stable")
    rows = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in got["rows"]]
    marks = np.array([np.frombuffer(x, dtype=np.int8) for x in got["marks"]])
    votes, voters = votes_of(rows, marks, families(rows, len(lexicon)), lexicon)
    told = got["toxic"].to_numpy() != 0
    posterior, clean, toxic, correlations, shares = label_model(votes, np.where(told, 0.9, 0.1))
    if posterior[told].mean() < posterior[~told].mean():
        posterior, clean, toxic = 1 - posterior, toxic, clean
    w, bias = fit_linear(rows, posterior, len(lexicon))
    return Model({f: float(w[i]) for f, i in number.items() if w[i]}, float(bias), voters, clean, toxic, correlations, shares)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts score by the classifier's bias. Whole texts are read; rows that repeat score alike. Columns
    of docs stay, but those named like the new ones are replaced. The model's weights come from MOST_LABELLED rows at
    most, which bounds the broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights, model.bias))
    docs = docs.drop("score", "predicted")
    place = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in batches:
            scores = [own.score(words(text), cache) for text in texts_of(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(released(predict), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
