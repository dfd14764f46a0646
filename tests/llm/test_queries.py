"""The ten queries over the smallest tables: their contracts, and brute force where SQL has no word for it."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tokenlab.llm import decontam, langid, neardup, pii, queries

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(spark, name, folder=SMALL):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def results(spark):
    """Every query's rows, run once."""
    got = {}

    def of(name):
        if name not in got:
            df = queries.QUERIES[name](spark, SMALL)
            got[name] = (df.dtypes, [r.asDict() for r in df.collect()])
        return got[name]

    return of


CONTRACTS = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op5_exact_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6_minhash": {"doc_id": "bigint", "class_id": "bigint"},
    "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_and_rows(spark, results, name):
    kinds, rows = results(name)
    assert CONTRACTS[name].items() <= dict(kinds).items()
    key, source = ("page_id", "pages") if name == "op10_warc" else ("doc_id", "documents")
    if name != "op5_exact_topk":
        assert sorted(r[key] for r in rows) == sorted(r[key] for r in table(spark, source))
    if "held_out" in CONTRACTS[name]:
        out = 1 if name == "op3_lm_scoring" else 0
        assert all(r["held_out"] == (fold(r["doc_id"]) == out) for r in rows)


# --- decontamination: every item on every alignment ------------------------------------------------------------------
def words(text):
    return re.findall(r"\w+", (text or "").lower())


def best_stretch(doc, item, shift):
    best, run = (0, 0, 0), []
    for i in range(max(0, shift), min(len(doc), shift + len(item))):
        run.append((i, doc[i] == item[i - shift]))
    for a in range(len(run)):
        value = n = 0
        for b in range(a, len(run)):
            value += 1 if run[b][1] else -decontam.MISMATCH
            n += run[b][1]
            if value > best[0] and run[a][1]:
                best = (value, n, run[a][0])
    return best


def test_leaks_are_those_of_all_alignments(spark):
    """Whatever an exhaustive comparison finds with a margin over the bound is found, and nothing below the bound."""
    got = {r["doc_id"]: r for r in queries.op2_decontamination(spark, SMALL).collect()}
    items = [(r["item_id"], words(r["text"])) for r in table(spark, "benchmark")]
    common = collections.Counter(w for _, i in items for w in set(i))
    docs = [(r["doc_id"], words(r["text"])) for r in table(spark, "documents")]
    docs = [d for d in docs if len(d[1]) < 3000]
    found, strong = set(), set()
    for i, doc in docs:
        at = collections.defaultdict(list)
        for p, w in enumerate(doc):
            if w in common:
                at[w].append(p)
        for _, item in items:
            shifts = collections.Counter(p - q for q, w in enumerate(item) for p in at.get(w, ()))
            for shift, n in shifts.items():
                if n >= decontam.LEAST_MATCHES:
                    value, matches, _ = best_stretch(doc, item, shift)
                    if matches >= decontam.LEAST_MATCHES:
                        found.add(i)
                        if value >= decontam.LEAST_MATCHES:
                            strong.add(i)
    mine = {i for i, _ in docs} & set(got)
    assert strong <= mine <= found and len(strong) >= 3


# --- language: plain Python Bayes over the same n-grams ---------------------------------------------------------------
def test_language_is_plain_naive_bayes(spark, results):
    def grams(text):
        s = " "
        for ch in text.lower() + " ":
            ch = ch if ord(ch) >= 128 or ch.isalpha() else " "
            if not (ch == " " and s[-1] == " "):
                s += ch
        out = []
        for n in langid.ORDERS:
            for i in range(len(s) - n + 1):
                key = 0
                for ch in s[i : i + n]:
                    key = (key * (1 << 21) + ord(ch)) & (1 << 64) - 1
                out.append(((key + n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48)
        return out

    docs = table(spark, "documents")
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for d in docs:
        if fold(d["doc_id"]) and d["text"] is not None and d["lang"] is not None:
            counts[d["lang"]].update(grams(d["text"]))
            texts[d["lang"]] += 1
    total = {k: sum(c.values()) for k, c in counts.items()}
    got = {r["doc_id"]: r for r in results("op7_language_id")[1]}
    for d in docs:
        if d["text"] is None or not any(ch.isalpha() for ch in d["text"]):
            assert (got[d["doc_id"]]["lang_pred"], got[d["doc_id"]]["score"]) == ("und", 0.0)
            continue
        own = grams(d["text"])
        logs = {k: math.log(texts[k] / sum(texts.values())) + sum(math.log((c[g] + langid.SMOOTHING) / (total[k] + langid.SMOOTHING * langid.BUCKETS)) for g in own) / len(langid.ORDERS) for k, c in counts.items()}
        top = max(logs.values())
        post = {k: math.exp(v - top) for k, v in logs.items()}
        best = max(sorted(post), key=post.get)
        r = got[d["doc_id"]]
        assert r["score"] == pytest.approx(post[r["lang_pred"]] / sum(post.values()), abs=0.02)
        assert r["lang_pred"] == best or post[best] / sum(post.values()) < 0.55


# --- near copies: all pairs of documents --------------------------------------------------------------------------------
def test_groups_of_real_documents(spark):
    """All pairs with a common shingle of a thousand documents; recall of links is measured and groups are equal."""
    docs = table(spark, "documents", MORE)
    key = lambda t: tuple(words(t)) or ("!", (t or "").strip())
    nodes = {}
    for d in docs:
        nodes.setdefault(key(d["text"]), []).append(d["doc_id"])
    keys = list(nodes)
    sets = [{k[i : i + 5] for i in range(max(1, len(k) - 4))} if k[0] != "!" else set() for k in keys]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = collections.Counter()
    for h in holders.values():
        for x in range(len(h)):
            for y in range(x):
                shared[h[y], h[x]] += 1
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        up[root(a)] = root(b)
    least, size = {}, collections.Counter()
    for i, k in enumerate(keys):
        least[root(i)] = min([*nodes[k], least.get(root(i), 1 << 62)])
        size[root(i)] += len(nodes[k])
    want = sorted((d, least[root(i)], size[root(i)]) for i, k in enumerate(keys) for d in nodes[k])
    got = sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in queries.op6_minhash(spark, MORE).collect())
    of = {d: c for d, c, _ in got}
    together = sum(of[nodes[keys[a]][0]] == of[nodes[keys[b]][0]] for a, b in links)
    assert len(links) >= 5 and together == len(links)
    assert got == want


# --- personal data: base spans of all documents, and the added ones ---------------------------------------------------
def test_added_spans_are_confirmed(spark, results):
    texts = {d["doc_id"]: d["text"] or "" for d in table(spark, "documents")}
    for r in results("op9_pii")[1]:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        t = texts[r["doc_id"]]
        base = [x for x in spans if x[0] in pii.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(":".join(x) for x in base).encode()).hexdigest()
        assert collections.Counter(x[0] for x in base) == collections.Counter({k: r[f"n_{k}"] for k in pii.BASE_KINDS if r[f"n_{k}"]})
        for kind, a, b in spans:
            own = t[int(a) : int(b)]
            if kind == "iban":
                bare = own.replace(" ", "")
                assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
            if kind == "ssn":
                assert re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", own)


# --- the rest: held-out checks -----------------------------------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark):
    told = {r["doc_id"]: r["toxic"] for r in table(spark, "labels", "/root/testdata/sf0.1") if r["toxic"] is not None}
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").collect()
    hits = [(r["predicted"], told[r["doc_id"]]) for r in rows if r["doc_id"] in told]
    bad = [p for p, t in hits if t]
    good = [p for p, t in hits if not t]
    assert len(bad) > 50 and np.mean(bad) >= 0.85 and np.mean(good) <= 0.02


def test_model_scores_are_probabilities(results):
    """Over all texts, the trie does better than single words, and totals are the training tokens."""
    _, rows = results("op3_lm_scoring")
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert {r["train_tokens"] for r in rows} == {sum(r["n_tokens"] for r in rows if not r["held_out"])}
    assert all(r["n_known"] == r["n_tokens"] for r in rows if not r["held_out"]) and all(r["score"] <= 0 for r in rows)
