"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .eliasfano import load, save
from .shared import fold, new_folder, texts_of

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: The matrix is broadcast up to this many bytes; a larger one is mapped from a file in the shared folder.
MOST_BYTES = 256 << 20
PIECE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def has_letter(text: str) -> bool:
    """Whether one character is a letter; the pattern also finds fractions and superscripts."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text between blanks, in pieces of bounded size.

    Case doesn't matter; ASCII other than letters is a blank, and several are one. Each piece goes on with the last
    characters of the one before, so that no n-gram is lost or added where it begins.
    """
    low, most = text.lower(), max(ORDERS)
    before = np.array([32], dtype=np.uint64)
    for at in range(0, len(low) + 1, PIECE):
        piece = low[at : at + PIECE]
        codes = np.frombuffer((piece if at + PIECE <= len(low) else piece + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(codes < 128, _ASCII[np.minimum(codes, 127)], codes).astype(np.uint64)
        codes = np.concatenate((before, codes))
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        old = len(before) - (1 if not at else 0)  # the first blank belongs to the n-grams of the first piece
        out, run = [], np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, most + 1):
            run = (run[: len(codes) - n + 1] * np.uint64(1 << 21)) + codes[n - 1 :]
            if n in ORDERS:
                # Of n-grams that end in what is new.
                own = run[max(0, old - n + 1) :]
                out.append((((own + np.uint64(n)) * _MIX) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
        before = codes[-(most - 1) :]
        yield np.concatenate(out)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the (buckets + 1) x languages matrix of log-probabilities; the last row holds the priors.

    Counts cover every row of docs that has a text and a language. Tasks count for themselves; what reaches the
    driver is one number per bucket and language, however many documents there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS + 1, dtype=np.int64)
                for part in buckets(text):
                    seen[lang][:BUCKETS] += np.bincount(part, minlength=BUCKETS)
                seen[lang][BUCKETS] += 1
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS + 1, len(langs)))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    grams, numbers = table[:BUCKETS], table[BUCKETS:]
    grams = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS))
    return langs, np.vstack([grams, np.log(numbers / numbers.sum())]).astype(np.float32)


def score_text(text: str, matrix: np.ndarray) -> np.ndarray:
    """Posterior of each language. The orders overlap, so each counts for its share only.

    A text is a sparse row of counts: only the matrix's rows of buckets that it has are read.
    """
    total = np.zeros(matrix.shape[1])
    for at in buckets(text):
        for k in range(0, len(at), PIECE):
            total += matrix[at[k : k + PIECE]].sum(axis=0, dtype=np.float64)
    total = total / len(ORDERS) + matrix[BUCKETS]
    odds = np.exp(total - total.max())
    return odds / odds.sum()


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior of lang_pred).

    A text that is null or has no letter, and any text if no language was learned, gets `und` and score 0. Ties go
    to the language that sorts first. Whole texts are read, in pieces of bounded size. Columns of docs stay, but
    those named like the new ones are replaced. The model is broadcast if it takes MOST_BYTES at most; else the
    workers map it from a file in the shared folder.
    """
    langs, matrix = model
    large = matrix.nbytes > MOST_BYTES
    if large:
        path = f"{new_folder(docs.sparkSession, 'languages')}/matrix.bin"
        save(path, {"flat": matrix.reshape(-1)})
    shared = docs.sparkSession.sparkContext.broadcast(path if large else matrix)
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(shared.value)["flat"].reshape(BUCKETS + 1, -1) if large else shared.value
        for batch in batches:
            names, scores = [], []
            for text in texts_of(batch.column(place)):
                if text is None or not langs or not has_letter(text):
                    names.append("und")
                    scores.append(0.0)
                else:
                    post = score_text(text, table)
                    names.append(langs[int(post.argmax())])
                    scores.append(float(post.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose fold isn't 0; a null id has no fold and isn't learned from."""
    return docs.filter(fold(F.col(id_col)) != 0)
