"""Corpus operators on odd tables and against brute force."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenlab.llm import decontam, eliasfano, langid, lines, mixing, neardup, ngramlm, pii, queries, shared, topk, toxicity, warc, zipdir

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Nulls everywhere, empty and very long texts, ties, repeated rows.
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, LONG, "en", "s", len(LONG)), (4, LONG, "en", "s", len(LONG)), (4, LONG, "en", "s", len(LONG)), (None, "a text without an id that is long enough", "fr", "s", 1),
    (None, None, None, None, None), (5, "!!! 123", "de", None, 7), (6, "tie tie", "en", "t", 7), (7, "tie tie", "en", "t", 7), (4, "another text of a repeated id", "en", "u", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("mine")).withColumn("n_lines", F.lit(9)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- mixing ---------------------------------------------------------------------------------------------------------
def water(sizes, weights=(3, 1, 2)):
    """Shares of 150 % by weight, the excess over twice the size handed on until there is none."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= 2 * sizes[s]}
        if not full:
            return target | {s: left * w[s] / total for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mixing_targets_and_takes(spark):
    rng = random.Random(5)
    table = [(i, "w " * rng.choice([0, 1, 5, 40, 900]), None, rng.choice(["a", "b", "c", "é", "z", None, ""]), 0) for i in range(1500)]
    got = rows(mixing.mix(spark.createDataFrame(table, DOCS)))
    size = collections.Counter()
    for _, t, _, s, _ in table:
        size[s] += len(t.split())
    want, taken = water(size), collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["size"] == len(r["text"].split()) and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"]
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * 900
    again = rows(mixing.mix(spark.createDataFrame(table, DOCS).repartition(7)))
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_mixing_odd_and_empty(odd, empty):
    got = rows(mixing.mix(odd))
    assert len(got) == len(ODD) and all(r["score"] == "mine" for r in got)
    assert all(r["taken"] == 0 for r in got if not r["size"])
    assert mixing.mix(empty).count() == 0
    assert mixing.emit(mixing.mix(odd), odd.columns).count() == sum(r["copies"] for r in got)


# --- lines ----------------------------------------------------------------------------------------------------------
def test_lines_keep_the_last_holder_and_read_whole_texts(spark):
    line = "This line is long enough to be compared: 40 chars"
    table = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\n{line}") for i in range(12)] + [(3, f"own 3\n{line}"), (None, line), (90, "short\n" * 50), (91, None), (92, "")]
    table += [(100 + i, "\n".join([f"x{j}" for j in range(200)] + [line])) for i in range(3)]
    got = rows(lines.drop_repeated_lines(spark.createDataFrame(table, "doc_id long, text string")))
    assert len(got) == len(table)
    for r in got:
        own = (r["text"] or "").split("\n")
        gone = [x for x in own if x.strip().lower() == line.lower() and r["doc_id"] != 102]
        assert (r["n_lines"], r["n_dropped"]) == (len(own), len(gone))
        assert r["kept_text"] == "\n".join(x for x in own if x not in gone)


def test_lines_four_documents_are_too_few(spark):
    line = "x" * 40
    assert sum(r["n_dropped"] for r in rows(lines.drop_repeated_lines(spark.createDataFrame([(i % 4, line + "\n" + line) for i in range(8)], "doc_id long, text string")))) == 0


def test_lines_odd_and_empty(odd, empty):
    got = rows(lines.drop_repeated_lines(odd))
    assert len(got) == len(ODD) and all(r["n_lines"] == 1 and r["score"] == "mine" for r in got)
    assert lines.drop_repeated_lines(empty).count() == 0


# --- personal data --------------------------------------------------------------------------------------------------
def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_personal_data_matches_the_patterns(spark):
    rng = random.Random(9)
    pieces = ["a.b@c.d-e", "a@b", "x@y.z%q@r.s", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.255", "4111 1111 1111 1111", "4111-1111 1111-1111", "4111111111111112", "+1 (523) 555-1055", "+49.30(12)", "++1 234 567 890", " ", "é", "漢", "\n", "12", "-", ".", "@", "😀"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "x"]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "9" * 50_000, "a@" * 30_000, "1.1." * 30_000, "a@b.c " * 2000]
    got = rows(pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base_spans"]] == base_spans(r["text"] or "")


def test_checksums_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 here", "DE89370400440532013001", "ssn 123-45-6789", "order 123-45-6789", "card 4111111111111111", "4111111111111111"]
    got = {r["doc_id"]: r for r in rows(pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [got[i]["n_iban"] for i in range(2)] == [1, 0] and [got[i]["n_ssn"] for i in (2, 3)] == [1, 0] and got[4]["top_score"] > got[5]["top_score"]


def test_personal_data_odd_and_empty(odd, empty):
    got = rows(pii.find_personal_data(odd))
    assert len(got) == len(ODD) and pii.find_personal_data(empty).count() == 0
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base_spans"]] == base_spans(r["text"] or "") and (r["top_score"] == 0.0) == (not r["all_spans"])
        assert all(r[f"n_{k}"] == sum(s["kind"] == k for s in r["all_spans"]) for k in pii.PATTERNS)


# --- names that operators add ------------------------------------------------------------------------------------------
ADDED = {
    "mixing": (lambda d: mixing.mix(d), mixing.OUT), "lines": (lambda d: lines.drop_repeated_lines(d), lines.OUT), "pii": (lambda d: pii.find_personal_data(d), pii.OUT),
    "decontam": (lambda d: decontam.mark_leaks(d, d.select(F.lit(1).alias("item_id"), F.lit("one two three four five six seven eight").alias("text")).limit(1)), decontam.OUT),
    "langid": (lambda d: langid.identify(d, langid.learn(d)), ("lang_pred", "score")), "toxicity": (lambda d: toxicity.score(d, toxicity.Model({"=tie": 9.0}, -4.0)), ("score", "predicted")),
    "ngramlm": (lambda d: ngramlm.score(d, ngramlm.learn(d)), ngramlm.NEW),
}


@pytest.mark.parametrize("name", sorted(ADDED))
def test_columns_named_like_new_ones_are_replaced(spark, name):
    """Also in another case; all other columns stay, and a repeated row comes out as often as it went in."""
    make, new = ADDED[name]
    docs = spark.createDataFrame([(1, "tie tie", "en", "s", 7), (1, "tie tie", "en", "s", 7), (2, None, None, None, None)], DOCS)
    plain, clashing = make(docs), docs
    for i, c in enumerate(new):
        clashing = clashing.withColumn(c.upper() if i % 2 else c, F.lit("mine"))
    out = make(clashing)
    assert [c.lower() for c in out.columns] == [c.lower() for c in plain.columns] and [t for _, t in out.dtypes] == [t for _, t in plain.dtypes]
    show = lambda d: sorted(str(tuple(f"{v:.6g}" if isinstance(v, float) else v for v in r)) for r in d.collect())
    assert show(out) == show(plain) and len(show(out)) == 3


# --- search ---------------------------------------------------------------------------------------------------------
def test_top_k_is_exact_with_ties(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 6) / 7]) for i in range(400)] + [(500 + i, [0.5] * 6) for i in range(40)] + [(700, None), (800, [None, 1.0]), (900, [float("nan")]), (1000, [float("inf")]), (1100, []), (1200, [1.0, 1.0]), (None, [1.0])]
    f = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    good = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    got = collections.defaultdict(list)
    for r in rows(topk.top_k(f, F.col("vec_id") % 100 == 0)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in good if i % 100 == 0}
    for q, found in got.items():
        scored = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=False)), c) for c in good if c != q)[:10]
        assert sorted(found) == [(k + 1, c, -s) for k, (s, c) in enumerate(scored)]


def test_top_k_of_repeated_ids_and_large_values(spark):
    """Two vectors with one id answer apart; products beyond 64 bits rank by their values."""
    f = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"] >> 20) for r in rows(topk.top_k(f, F.col("vec_id") == 0)))
    assert got == [(0, 1, 1, 2), (0, 1, 2, 3), (0, 2, 1, 1), (0, 2, 2, 1)]
    big = [(0, [2.0**40, 1.0]), (1, [2.0**40, 5.0]), (2, [2.0**40, 6.0]), (3, [-(2.0**45), 0.0]), (4, [1.0, 1.0])]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)))
    assert got == [(1, 2, 2**63 - 1), (2, 1, 2**63 - 1), (3, 4, 2**60 + 2**20), (4, 3, -(2**63))]


def test_top_k_few_and_empty(spark):
    f = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert rows(topk.top_k(f, F.col("vec_id") % 100 == 0)) == [{"query_id": 0, "rank": 1, "vec_id": 1, "score": 1024 * 1024}]
    assert topk.top_k(f.limit(0), F.lit(True)).count() == 0


# --- language -------------------------------------------------------------------------------------------------------
def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(d.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()


def test_language_reads_over_the_borders_of_pieces(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é1 .漢 xß") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    whole = [np.sort(np.concatenate(list(langid.buckets(t)))) for t in texts]
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert all((np.sort(np.concatenate(list(langid.buckets(t)))) == w).all() for t, w in zip(texts, whole, strict=True))


def test_a_large_matrix_is_mapped_from_a_file(odd, monkeypatch):
    model = langid.learn(odd)
    key = lambda: sorted(map(str, langid.identify(odd, model).collect()))
    one = key()
    monkeypatch.setattr(langid, "MOST_BYTES", 10)
    assert key() == one


def test_letters():
    assert not langid.has_letter("½ ² _ 1 !") and langid.has_letter("½a") and langid.has_letter("漢")


def test_language_odd_and_empty(odd, empty):
    model = langid.learn(odd)
    got = rows(langid.identify(odd, model))
    assert len(got) == len(ODD)
    for r in got:
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"])) and 0 <= r["score"] <= 1
    assert langid.identify(empty, model).count() == 0 and langid.learn(empty)[0] == []
    assert {r["lang_pred"] for r in rows(langid.identify(odd, langid.learn(empty)))} == {"und"}


# --- toxicity -------------------------------------------------------------------------------------------------------
def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    table, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        body = [word() for _ in range(rng.randint(5, 60))]
        if bad:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["nasty", "vile"]) if i % 12 else "lowei" + word())
        table.append((i, " ".join(body)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks.filter(shared.fold(F.col("doc_id")) != 0))
    got = rows(toxicity.score(docs, model).join(marks, "doc_id").filter(shared.fold(F.col("doc_id")) == 0))
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)


def test_label_model_finds_accuracies_and_correlations():
    """Voters of known accuracy that vote both ways or abstain, two of them nearly copies of a third; no labels."""
    rng = np.random.default_rng(7)
    n, accuracy, silent = 12_000, [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7], [0.2, 0.5, 0.3, 0.1, 0.4, 0.6, 0.0]
    y = rng.random(n) < 0.3
    votes = np.array([np.where(rng.random(n) < a, 2 * y - 1, 1 - 2 * y) * (rng.random(n) >= s) for a, s in zip(accuracy, silent, strict=True)]).T
    copies = [np.where(rng.random(n) < 0.95, votes[:, 6], -votes[:, 6]) for _ in range(2)]
    votes = np.column_stack([votes, *copies]).astype(np.int8)
    q, clean, toxic, correlations, shares = toxicity.label_model(votes)
    for j, (a, s) in enumerate(zip(accuracy, silent, strict=True)):
        assert toxic[j] == pytest.approx([(1 - a) * (1 - s), s, a * (1 - s)], abs=0.04) and clean[j] == pytest.approx([a * (1 - s), s, (1 - a) * (1 - s)], abs=0.04)
    told = np.array([np.corrcoef(votes[y == c, 6], votes[y == c, 7])[0, 1] for c in (False, True)])
    assert correlations[6, 7] == pytest.approx(told @ [0.7, 0.3], abs=0.06) and abs(correlations[:6, :6] - np.eye(6)).max() < 0.1
    assert (shares[:6] == 1).all() and shares[6:] == pytest.approx([1 / 3] * 3, abs=0.06)
    assert ((q > 0.5) == y).mean() > 0.95
    # Taking the three copies for three witnesses does worse.
    plain = np.log(toxic / clean)
    naive = np.log(0.3 / 0.7) + sum(plain[j][votes[:, j] + 1] for j in range(9))
    assert ((q > 0.5) == y).mean() > ((naive > 0) == y).mean()


def test_toxicity_odd_and_empty(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int")
    got = rows(toxicity.score(odd, toxicity.learn(odd, none)))
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert toxicity.score(empty, toxicity.learn(empty, none)).count() == 0


# --- decontamination ------------------------------------------------------------------------------------------------
def test_leaks_stand_substitutions_and_clean_texts_stay(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 400
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(30) for _ in range(20)]
    table, leaked = [], set()
    for i in range(300):
        body = say(200)
        if i % 5 == 0:
            item = list(items[i % 20])
            for k in range(6, 30, 8):
                item[k] = "changed"
            body[100:100] = item
            leaked.add(i)
        table.append((i, " ".join(body)))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)] + [(99, None), (98, "too short"), (None, "x")], "item_id long, text string")
    got = {r["doc_id"]: r for r in rows(decontam.mark_leaks(docs, benchmark)) if r["leak_item"] is not None}
    assert set(got) == leaked and all(r["leak_item"] == i % 20 and r["leak_matches"] >= 20 and 95 <= r["leak_start"] <= 108 for i, r in got.items())


def test_leaks_keep_ids_of_any_kind_and_all_items(spark, monkeypatch):
    """String ids, a null id, an item that stands twice, several items in one text; broadcast and by join."""
    say = lambda k: " ".join(f"q{k}x{j}" for j in range(20))
    items = [("b", say(0)), ("a", say(0)), (None, say(1)), ("c", say(2)), ("d", "a six word item just here"), ("e", None), ("f", "")]
    texts = [say(0), f"x {say(1)} y", f"{say(2)} and {say(0)} z z", "so a six word item just here it is", None, "", "clean", say(0)]
    docs = spark.createDataFrame([(i, t, "mine", 7) for i, t in enumerate(texts)], "doc_id long, text string, leak_item string, leaks int")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for tokens in (1 << 20, 10):
        monkeypatch.setattr(decontam, "BLOCK_TOKENS", tokens)
        got = {r["doc_id"]: (r["leak_item"], r["leak_matches"], r["leak_start"], r["leak_end"], [x["item"] for x in r["leaks"]]) for r in rows(decontam.mark_leaks(docs, benchmark))}
        none = (None, None, None, None, [])
        assert got == {0: ("a", 20, 0, 20, ["a"]), 1: (None, 20, 1, 21, [None]), 2: ("a", 20, 21, 41, ["a", "c"]), 3: ("d", 6, 1, 7, ["d"]), 4: none, 5: none, 6: none, 7: ("a", 20, 0, 20, ["a"])}


def test_leaks_by_join_are_those_of_the_broadcast(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda: sorted(tuple(r) for r in decontam.mark_leaks(docs, benchmark).select("doc_id", "leak_item", "leak_matches", "leak_start", "leak_end").collect())
    one = key()
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 10)
    assert key() == one
    monkeypatch.setattr(decontam, "MOST_KEYS", 0)
    assert key() == one and sum(r[2] is not None for r in one) > 10


def test_short_items_leak_too(spark):
    """Verbatim items of 1 to 15 tokens, one substituted word in those of 8 and more wherever it is, and no less."""
    words = {n: [f"w{n}x{i}" for i in range(n)] for n in range(1, 16)}
    around, table, want = [f"z{i}" for i in range(30)], [], {}
    for n, own in words.items():
        for p in (None, *range(n)):
            text = [*around, *(w if i != p else "other" for i, w in enumerate(own)), *around]
            if p is None or n >= 8 or n < 7:
                table.append((len(table), " ".join(text)))
                if p is None or n >= 8:
                    want[len(table) - 1] = n
    docs, benchmark = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in words.items()], "item_id long, text string")
    got = {r["doc_id"]: r for r in rows(decontam.mark_leaks(docs, benchmark)) if r["leak_item"] is not None}
    assert {i: r["leak_item"] for i, r in got.items()} == want
    assert all(r["leak_start"] >= 30 and r["leak_matches"] >= decontam.needed(r["leak_item"]) for r in got.values())


def test_leaks_by_join_in_very_long_texts(spark, odd, empty, monkeypatch):
    benchmark = spark.createDataFrame([(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(6)], "item_id long, text string")
    text = "filler " * 300_000 + " ".join(f"q4x{j}" for j in range(20))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 40)
    got = {r["doc_id"]: (r["leak_item"], r["leak_matches"], r["leak_start"]) for r in rows(decontam.mark_leaks(docs, benchmark))}
    assert got == {1: (4, 20, 300_000), 2: (None, None, None), 3: (None, None, None)}
    assert decontam.mark_leaks(odd, benchmark).filter("leak_item is not null").count() == 0 and decontam.mark_leaks(empty, benchmark).count() == 0
    assert decontam.mark_leaks(odd, benchmark.limit(0)).count() == len(ODD)


# --- near copies ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("share", "weight"), [(0.5, 1.0), (0.8, 1.0), (0.8, 2.5)])
def test_darts_estimate_weighted_similarity(share, weight):
    rng = np.random.default_rng(1)
    n = 400
    c = int(2 * share / (1 + share) * n)
    a = rng.integers(0, 2**63, n).astype(np.uint64)
    b = np.concatenate((a[:c], rng.integers(0, 2**63, n - c).astype(np.uint64)))
    s = neardup.dart_signatures(np.concatenate((a, b)), np.full(2 * n, weight), np.repeat([0, 1], n), 2, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(c / (2 * n - c), abs=0.03)


def brute_groups(table):
    """class of each row by all pairs with a similarity of 0.8 or more."""
    key = lambda t: tuple(re.findall(r"\w+", (t or "").lower())) or ("!", (t or "").strip())
    sets = {}
    for _, t in table:
        k = key(t)
        sets[k] = {k[i : i + 5] for i in range(max(1, len(k) - 4))} if k[0] != "!" else set()
    names, up = list(sets), {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for i, t in table:
        if i is not None:
            r = root(key(t))
            least[r] = min(i, least.get(r, i))
    return sorted(((i, least.get(root(key(t)))) for i, t in table), key=str)


def test_near_duplicates_match_brute_force(spark):
    """A family whose members are often below the bound to each other, so that strays and chunks come in."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    table = []
    for family in range(4):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(60):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            table.append((len(table), " ".join(own)))
    table += [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(40)] + [(2000, None), (2001, ""), (2002, "!!"), (2003, " !! "), (2004, "two words"), (2005, "Two, words"), (None, "two words"), (None, "nobody else says this"), (3000, table[0][1].upper())]
    rng.shuffle(table)
    got = sorted(((r["id"], r["class_id"]) for r in rows(neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")))), key=str)
    assert got == brute_groups(table)


def test_one_stays_of_each_group_whatever_its_id(spark):
    """Rows with one id and different texts: each group keeps one row, that with its smallest id."""
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "quite another text that stands alone here")
    docs = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 3), (6, b, 4), (7, c, 5), (None, c, 6)], "doc_id long, text string, label int")
    kept = sorted((r["doc_id"] is None, r["doc_id"], r["label"]) for r in neardup.keep_one(docs, neardup.near_duplicates(docs)).collect())
    assert kept == [(False, 3, 1), (False, 5, 3), (False, 7, 5), (True, None, 6)]


def test_strays_meet_in_chunks_and_without_the_filter(spark, monkeypatch):
    """Chains of near-copies in one bucket, cut into small chunks; an infinite slack leaves the same groups."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    table = []
    for start in range(6):
        own = [rng.choice(words) for _ in range(120)]
        for step in range(25):
            own = list(own)
            own[rng.randrange(120)] = f"n{start}x{step}"
            table.append((len(table), " ".join(own)))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    want = brute_groups(table)
    for chunk, slack in ((3, 4.0), (1024, float("inf"))):
        monkeypatch.setattr(neardup, "CHUNK_STRAYS", chunk)
        monkeypatch.setattr(neardup, "CHUNK_MEMBERS", chunk)
        monkeypatch.setattr(neardup, "HUBS", 1)
        got = sorted(((r["id"], r["class_id"]) for r in rows(neardup.near_duplicates(docs, slack=slack))), key=str)
        assert got == want


def test_near_duplicates_odd_and_empty(odd, empty):
    groups = neardup.near_duplicates(odd)
    got = rows(groups)
    assert len(got) == len(ODD) and all(r["class_id"] == 3 for r in got if r["id"] == 3)
    kept = neardup.keep_one(odd, groups)
    assert collections.Counter(r["doc_id"] for r in rows(kept) if r["doc_id"] is not None) == collections.Counter({r["label"]: r["class_id"] for r in got if r["id"] is not None}.values())
    assert neardup.near_duplicates(empty).count() == 0


# --- language model -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("n", "top"), [(1, 1), (1, 2**64 - 1), (2, 5), (1000, 1000), (5000, 300), (20000, 2**40), (100, 2**64 - 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e = eliasfano.EliasFano.build(v)
    q = np.concatenate((v, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, 2**64 - 1], dtype=np.uint64)))
    place, same = e.successor(q)
    assert (e.all() == v).all() and (place == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all()


def test_elias_fano_runs(tmp_path):
    v = np.unique(np.concatenate([np.arange(20_000), 10**12 + np.arange(5) * 10**9]).astype(np.uint64))
    path = f"file://{tmp_path}/e.bin"
    eliasfano.save(path, eliasfano.EliasFano.build(v).arrays("k"))
    e = eliasfano.EliasFano.of(eliasfano.load(path), "k")
    assert (e.find(v) == np.arange(len(v))).all() and (e.find(v + np.uint64(1)) >= 0).sum() == np.isin(v + np.uint64(1), v).sum()


@pytest.mark.parametrize("stretch", [64, 128, 1 << 18])
def test_elias_fano_by_stretches(monkeypatch, stretch):
    monkeypatch.setattr(eliasfano, "STRETCH", stretch)
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (63, 1 << 40), (64, (1 << 63) - 1), (65, 200), (5000, 1 << 62), (300, 3)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        assert (eliasfano.EliasFano.build(v).all() == v).all()


@pytest.mark.parametrize("chunk", [1, 1 << 11, 1 << 20])
def test_runs_are_merged_by_ranges(monkeypatch, chunk):
    """Whatever the ranges, counts of equal keys add up, beyond 32 bits too."""
    monkeypatch.setattr(ngramlm, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    for kind in (np.uint32, np.uint64):
        keys = [np.unique(rng.integers(0, 20_000, n, dtype=np.uint64)) for n in (1, 9000, 3000, 5000)]
        runs = [(k, rng.integers(1, 1 << 32, len(k)).astype(kind)) for k in keys]
        want = {}
        for k, n in runs:
            for a, b in zip(k.tolist(), n.tolist(), strict=True):
                want[a] = want.get(a, 0) + b
        k, n = ngramlm._merged(runs)
        assert k.tolist() == sorted(want) and n.tolist() == [want[a] for a in sorted(want)]


@pytest.mark.parametrize("size", [1, 7, 1 << 19])
def test_words_are_hashed_as_bytes(monkeypatch, size):
    """Equal words have equal hashes wherever they stand; words are those of bytes.split, lower-cased A-Z."""
    monkeypatch.setattr(ngramlm, "BYTES", size)
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "B", "é", "É", " ", "\t", "\n", "\x0b", "\x1c", "漢", "ab", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "x" * 300, "y " + "x" * 300, "X" * 299]
    column = pa.array(["skip", *texts]).slice(1)
    hashes, sizes = ngramlm.word_hashes(column)
    want = [w for t in texts for w in [*(t or "").encode().lower().split(), b""]]
    assert len(hashes) == len(want) == sizes.sum() and sizes.tolist() == [len((t or "").encode().split()) + 1 for t in texts]
    assert len(set(zip(hashes.tolist(), want, strict=True))) == len(set(want)) == len(set(hashes.tolist())) and hashes[-1] == ngramlm.END


def lm(texts, train, least):
    """The same smoothing with dictionaries."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [re.findall("[^\x20\x09-\x0d]+", low(t)) + [""] for t in texts]
    c1, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for i in train:
        s = ["", *tokens[i]]
        c1.update(tokens[i])
        c2.update(zip(s, s[1:], strict=False))
        c3.update(zip(s, s[1:], s[2:], strict=False))
    kept = {g: n for g, n in c3.items() if n >= least and g[1] != ""}
    n, v = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 0.5) / (n + 0.5 * (v + 1))
    by2, by3 = collections.defaultdict(list), collections.defaultdict(list)
    for (a, _), k in c2.items():
        by2[a].append(k)
    for g, k in kept.items():
        by3[g[:2]].append(k)

    def p2(a, b):
        return p1(b) if a not in c1 else (c2[a, b] + (c1[a] - sum(by2[a]) + len(by2[a])) * p1(b)) / (c1[a] + len(by2[a]))

    def p3(a, b, c):
        if (a, b) not in c2 or b == "":
            return p2(b, c)
        t = by3[a, b]
        return (kept.get((a, b, c), 0) + (c2[a, b] - sum(t) + len(t)) * p2(b, c)) / (c2[a, b] + len(t))

    out = []
    for t in tokens:
        s = ["", *t]
        full = math.log10(p2("", s[1])) + sum(math.log10(p3(*g)) for g in zip(s, s[1:], s[2:], strict=False))
        out.append((len(t), sum(w in c1 for w in t), sum(math.log10(p1(w)) for w in t), full))
    return n, out


@pytest.mark.parametrize(("shard_tokens", "least"), [(300, 1), (300, 2), (10**7, 1)])
def test_language_model_matches_dictionaries(spark, monkeypatch, shard_tokens, least):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "B", "c", "d d", "é", "E f g", "a b"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "unseen words only", "a " * 3000]
    monkeypatch.setattr(ngramlm, "STRETCH", 64)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [i for i in range(len(texts)) if i % 5]
    model = ngramlm.learn(docs.filter("doc_id % 5 <> 0"), shard_tokens=shard_tokens, least=least)
    total, want = lm(texts, train, least)
    assert model.total == total
    for r in rows(ngramlm.score(docs, model)):
        n, known, base, full = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (n, known) and r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] == pytest.approx(full, abs=2e-3 * n)


def test_language_model_odd_and_empty(odd, empty):
    got = rows(ngramlm.score(odd, ngramlm.learn(empty)))
    assert len(got) == len(ODD) and all(r["base_score"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in got)
    assert ngramlm.score(empty, ngramlm.learn(odd)).count() == 0
    assert all(r["score"] < 0 for r in rows(ngramlm.score(odd, ngramlm.learn(odd))))


# --- archives -------------------------------------------------------------------------------------------------------
PAGES = [(1, "http://x/1", "same"), (2, "http://x/2", "same"), (5, None, "same"), (3, "http://x/ 3\r\nX: y", "öther 😀"), (4, "u", None), (6, "u", ""), (None, "u", "same"), (7, "v", "z" * 300_000), (7, "v", "z" * 300_000)]


def test_archives_round_trip(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = shared.new_folder(spark, "test")
    made = warc.write_archives(warc.assign(pages), folder, roll_bytes=600)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in rows(warc.read_archives(made))), key=str)
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        b, first = (h or "").encode(), i == last[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else last[h or ""], bytearray(b) if first else None))
    assert got == sorted(want, key=str) and made.count() > 1
    small = rows(warc.round_trip(pages, least_bytes=100))
    assert sum(r["record_type"] == "revisit" for r in small) == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("before", [b"", b"#!stub\n" * 9])
def test_foreign_archives_without_an_index(method, before):
    packed = [warc.record(i, f"u{i}", b"payload %d" % i * 50, None) for i in range(40)]
    raw = io.BytesIO()
    raw.write(before)
    with zipfile.ZipFile(raw, "a", method) as z:
        z.writestr("other.txt", "x")
        with z.open("archive/a.warc.gz", "w", force_zip64=True) as f:
            f.write(b"".join(packed))
        z.comment = b"a comment PK\x05\x06 in it"
    data = raw.getvalue()
    read = lambda at, n: data[at : at + n]
    assert list(warc.stored_records(read, len(data))) == packed
    assert [m.name for m in zipdir.members(read, len(data), window=50)] == ["other.txt", "archive/a.warc.gz"]


def test_zip64_directory():
    """More members than 16 bits count."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(66_000):
            z.writestr(f"{i}", "")
    data = raw.getvalue()
    found = list(zipdir.members(lambda at, n: data[at : at + n], len(data)))
    assert len(found) == 66_000 and found[-1].start(lambda at, n: data[at : at + n]) <= len(data)
    with pytest.raises(ValueError):
        list(zipdir.members(lambda at, n: b"no zip"[at : at + n], 6))


def test_tampered_payload_is_refused():
    import gzip

    bad = gzip.compress(gzip.decompress(warc.record(1, "u", b"hello", None)).replace(b"hello", b"hallo"))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(bad)


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", shared.fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
