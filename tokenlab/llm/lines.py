"""Line deduplication over whole documents. DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_CHARS, materialise, row_struct

OUT = ("n_lines", "n_dropped", "kept_text")
#: Documents for one slice of a key.
SLICE = 1 << 16


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(SPACE_CHARS))
    # lower() has a fast path for ASCII; elsewhere it would change other letters too.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, slices: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses lines: id, th (hash of its text), and words: the bitmap of dropped lines.

    The bitmap is an array of (word, bits): bits of 64 lines each, words without a dropped line left out.

    Key hashes are range-partitioned together with a slice of the id, with the secondary sort by descending id and
    position. Ranges keep the slices of a rare key in one partition and cut a key that many documents share between
    slices. A first stream over each (key, slice) finds its first occurrence (the largest id) and its number of
    documents; with min_docs of them there, all others can go at once. What is then undecided is a few documents
    per slice, so the second stream, over each key, reads a few documents for each slice. Without a number there is a
    slice for every SLICE documents, so neither stream meets more than about that many of one key.
    """
    slices = slices or max(16, docs.count() // SLICE)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = slim.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", F.trim("line", F.lit(SPACE_CHARS))).filter(F.char_length("key") >= min_chars)
    key = line_key(F.col("line"))
    hashed = lines.select("id", "th", "pos", key.alias("key")).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), "id", "th", "pos"
    )
    # Written once, as finding the ranges reads the rows a second time and would read the texts again.
    hashed = materialise(hashed, "lines").repartitionByRange("h1", "h2", "slice")
    part = Window.partitionBy("h1", "h2", "slice")
    stream = part.orderBy(F.col("id").desc_nulls_last(), "pos")
    first = hashed.select("*", F.row_number().over(stream).alias("row"))
    first = first.select("*", F.dense_rank().over(part.orderBy(F.col("id").desc_nulls_last())).alias("doc"))
    first = first.select("*", F.max("doc").over(part).alias("docs"))
    gone = (F.col("docs") >= min_docs) & (F.col("doc") > 1)
    sure = first.filter(gone).select("id", "th", "pos")
    rest = first.filter(~gone).select("h1", "h2", "id", "th", "pos", F.when(F.col("row") == 1, F.col("docs")).otherwise(0).alias("weight"))
    whole = Window.partitionBy("h1", "h2")
    rest = rest.select("id", "th", "pos", F.sum("weight").over(whole).alias("n"), F.max("id").over(whole).alias("last"))
    rest = rest.filter((F.col("n") >= min_docs) & ~F.col("id").eqNullSafe(F.col("last"))).select("id", "th", "pos")
    drops = sure.unionByName(rest).repartition("id", "th")
    bits = drops.groupBy("id", "th", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return bits.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, slices: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept_text.

    Texts are split at line feeds; a null or empty text is one empty line. A line whose key (see line_key) has at
    least min_chars code points and occurs in at least min_docs documents goes, unless its document has the largest
    id of those that hold the key; in that one, all its lines with the key stay. Rows that repeat an id count as
    one document. A null id is a document below all others. Keys are compared by 128 bits of hash. Columns of docs
    stay, but those named like the new ones are replaced; an empty table gives no rows.
    """
    maps = drop_bitmaps(docs, min_chars, min_docs, slices, id_col, text_col)
    own = docs.select(row_struct(docs, OUT).alias("row"), F.col(id_col).alias("own_id"), F.coalesce(F.col(text_col), F.lit("")).alias("own_text"))
    own = own.withColumn("own_th", F.xxhash64("own_text"))
    both = own.join(maps, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left")
    both = both.select("row", "own_text", "words", F.split("own_text", "\n").alias("lines"), F.map_from_entries("words").alias("by_word"))
    dense = F.expr("transform(sequence(0L, (size(lines) - 1) div 64), w -> coalesce(by_word[w], 0L))")
    both = both.select("row", "own_text", "lines", "words", F.when(F.col("words").isNotNull(), dense).alias("dense"))
    left = F.expr("array_join(filter(lines, (x, i) -> (shiftright(dense[i div 64], i % 64) & 1) = 0), '\n')")
    return both.select(
        "row.*",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.expr("aggregate(words, 0L, (a, w) -> a + bit_count(w.bits))"), F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("dense").isNull(), F.col("own_text")).otherwise(left).alias("kept_text"),
    )
