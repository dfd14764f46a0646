"""The corpus operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, importance, langid, lines, mixing, neardup, ngramlm, pii, secrets, topk, toxicity, warc
from .shared import fold, materialise
from .spans import joined


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = materialise(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")), "sizes")
    mixed = mixing.mix(sized, size_col="words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.mark_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return marked.filter("leak_matches is not null").select("doc_id", F.col("leak_item").alias("item_id"), "leak_matches", "leak_start", "leak_end", F.col("leaks.item").alias("item_ids"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, train = _table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id")) != 1
    words = ngramlm.learn_words(docs.filter(train))
    # Texts are taken apart once, for counting and for scoring.
    ranks = materialise(ngramlm.encode(docs, words), "ranks")
    model = ngramlm.learn_orders(ranks.filter(train), words)
    held_out = F.coalesce(~train, F.lit(True))
    return ngramlm.score_encoded(ranks, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = lines.drop_repeated_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), "class_id", "class_size")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(langid.training_rows(docs))
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(fold(F.col("doc_id")) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs)
    return found.select(
        "doc_id", *[f"n_{k}" for k in pii.PATTERNS], F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("all_spans").alias("spans"), "top_score"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.learn(secrets.labelled_samples(docs)))
    return found.select("doc_id", *[f"n_{k}" for k in secrets.BASE_KINDS], F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("all_spans").alias("spans"), "n_random", "top_score")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_pii that SQL can express."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_lm_scoring that SQL can express."""
    return op3_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_topk": op5_exact_topk,
    "op6_minhash": op6_minhash,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_resampling": op12_resampling,
    "op13_secrets": op13_secrets,
    "pii_base": pii_base,
    "lm_base": lm_base,
}

# crc32 of an id's text, modulo 5.
_FOLD = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) % 5"""

ORACLES: dict[str, str] = {
    # A match is the first place of its text behind the match before, as an earlier one would have matched there.
    "pii_base": r"""
        WITH RECURSIVE kinds AS (
            SELECT * FROM (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) v(place, kind, pattern)
        ), found AS (
            SELECT doc_id, place, kind, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), pattern, 0) AS m FROM documents, kinds
        ), spans AS (
            SELECT doc_id, place, kind, t, m, 1 AS i, instr(t, m[1]) - 1 AS s FROM found WHERE len(m) > 0
            UNION ALL SELECT doc_id, place, kind, t, m, i + 1, s + length(m[i]) + instr(substr(t, CAST(s + length(m[i]) + 1 AS BIGINT)), m[i + 1]) - 1 FROM spans WHERE i < len(m)
        ), judged AS (
            SELECT doc_id, place, kind, s, s + length(m[i]) AS e, regexp_replace(m[i], '[^0-9]', '', 'g') AS d, m[i] AS x FROM spans
        ), good AS (
            SELECT * FROM judged WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0
                WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(d[-k] AS INTEGER) ELSE 2 * CAST(d[-k] AS INTEGER) - CASE WHEN d[-k] > '4' THEN 9 ELSE 0 END END)) % 10 = 0
                ELSE length(d) BETWEEN 9 AND 15 END
        ), packed AS (
            SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
                string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS joined FROM good GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(joined, '')) AS base_sha256 FROM documents LEFT JOIN packed USING (doc_id)
    """.replace("\\\\", "\\"),
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
        places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        f AS (
            SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM (
                SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM places, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws)
            ) GROUP BY ALL
        ), cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
        cuts AS (
            SELECT lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c JOIN f x USING (lang) JOIN f y USING (lang)
            WHERE x.k = cut AND x.phrase = array_to_string(ws[1 : cut], ' ') AND y.k = c.k - cut AND y.phrase = array_to_string(ws[cut + 1 : c.k], ' ')
        ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        parts AS (SELECT lang, array_to_string(ws[i : i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM cand WHERE k = 3) GROUP BY ALL),
        n AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
        kept AS (SELECT best.* FROM best LEFT JOIN parts USING (lang, phrase) WHERE k = 3 OR longer IS NULL OR 100 * longer < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
        FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
    """,
    # crc32 of UTF-8 bytes by their hex digits.
    "op12_resampling": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), b AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
        ), dw AS (SELECT doc_id, unnest(words) AS w FROM d), own AS (SELECT doc_id, w, count(*) AS n FROM dw GROUP BY ALL),
        hashed AS (
            SELECT w, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(length(hex(w)) // 2), lambda i: CAST('0x' || substr(hex(w), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
                lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
            FROM (SELECT w FROM own UNION SELECT w FROM b)
        ), s AS (SELECT bucket, sum(n) AS s FROM own JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY bucket),
        sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0) + 10000::DOUBLE AS ss, coalesce((SELECT sum(t) FROM t), 0) + 10000::DOUBLE AS tt),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1::DOUBLE) * ss / ((coalesce(s, 0) + 1::DOUBLE) * tt))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), sums
        ), weighed AS (
            SELECT doc_id, sum(n) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM own JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (doc_id)
        ), ranked AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS fit FROM scored)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM ranked
    """,
    # Learned ratios included: the same samples by md5, the same counts of transitions.
    "op13_secrets": r"""
        WITH RECURSIVE kinds AS (
            SELECT * FROM (VALUES (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
                (1, 'access', 'AKIA[A-Z0-9]+', 0), (2, 'hex', '[0-9a-f]+', 0), (3, 'random', '[A-Za-z0-9+/_-]{16,}={0,2}', 0)) v(place, kind, pattern, part)
        ), found AS (
            SELECT doc_id, place, kind, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), pattern, 0) AS m, regexp_extract_all(coalesce(text, ''), pattern, part) AS v FROM documents, kinds WHERE kind <> 'hex'
            UNION ALL SELECT doc_id, place, kind, coalesce(text, ''), m, m FROM documents, kinds, LATERAL (SELECT list_filter(regexp_extract_all(coalesce(text, ''), pattern, 0), lambda x: length(x) >= 24) AS m) WHERE kind = 'hex'
        ), values_of AS (
            SELECT doc_id, place, kind, unnest(v) AS v FROM found
        ), bare AS (
            SELECT regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), (SELECT pattern FROM kinds WHERE place = 0), ' ', 'g'), 'AKIA[A-Z0-9]+', ' ', 'g'), '[0-9a-f]{24,}', ' ', 'g') AS t FROM documents
        ), secret AS (
            SELECT v FROM (SELECT DISTINCT v FROM values_of WHERE kind = 'assign' AND length(v) >= 16 AND regexp_matches(v, '[0-9]') OR kind = 'access' AND length(v) >= 20 OR kind = 'hex') ORDER BY md5(v) LIMIT 4096
        ), others AS (
            SELECT v FROM (SELECT DISTINCT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_-]{16,}={0,2}')) AS v FROM bare) ORDER BY md5(v) LIMIT 4096
        ), samples AS (
            SELECT true AS random, v FROM secret UNION ALL SELECT true, to_base64(unhex(sha256('random:' || i))) FROM range(1024) r(i) UNION ALL SELECT false, v FROM others
        ), steps AS (
            SELECT random, CASE WHEN i = 1 THEN 32 ELSE ascii(v[i - 1]) END AS a, ascii(v[i]) AS b, count(*) AS n FROM (SELECT random, v, unnest(range(1, length(v) + 1)) AS i FROM samples) GROUP BY ALL
        ), sums AS (
            SELECT a, coalesce(sum(n) FILTER (WHERE random), 0) AS r, coalesce(sum(n) FILTER (WHERE NOT random), 0) AS o FROM steps GROUP BY a
        ), symbols AS (
            SELECT b, coalesce(sum(n) FILTER (WHERE random), 0) AS r, coalesce(sum(n) FILTER (WHERE NOT random), 0) AS o FROM steps GROUP BY b
        ), whole AS (
            SELECT coalesce(sum(n) FILTER (WHERE random), 0) AS r, coalesce(sum(n) FILTER (WHERE NOT random), 0) AS o FROM steps
        ), pairs AS (
            SELECT a, b, coalesce(sum(n) FILTER (WHERE random), 0) AS r, coalesce(sum(n) FILTER (WHERE NOT random), 0) AS o FROM steps GROUP BY a, b
        ), tokens AS (
            SELECT DISTINCT v FROM values_of
        ), rated AS (
            SELECT v, CAST(sum(CAST(floor(1000 * ln(((coalesce(p.r, 0) + 8.0::DOUBLE * ((coalesce(y.r, 0) + 0.5::DOUBLE) / (w.r + 34.0::DOUBLE))) / (coalesce(s.r, 0) + 8.0::DOUBLE))
                / ((coalesce(p.o, 0) + 8.0::DOUBLE * ((coalesce(y.o, 0) + 0.5::DOUBLE) / (w.o + 34.0::DOUBLE))) / (coalesce(s.o, 0) + 8.0::DOUBLE)))) AS BIGINT)) AS BIGINT) AS ratio
            FROM (SELECT v, CASE WHEN i = 1 THEN 32 ELSE ascii(v[i - 1]) END AS a, ascii(v[i]) AS b FROM (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM tokens))
            LEFT JOIN pairs p USING (a, b) LEFT JOIN sums s USING (a) LEFT JOIN symbols y USING (b), whole w GROUP BY v
        ), spans AS (
            SELECT doc_id, place, kind, t, m, v, 1 AS i, instr(t, m[1]) - 1 AS s FROM found WHERE len(m) > 0
            UNION ALL SELECT doc_id, place, kind, t, m, v, i + 1, s + length(m[i]) + instr(substr(t, CAST(s + length(m[i]) + 1 AS BIGINT)), m[i + 1]) - 1 FROM spans WHERE i < len(m)
        ), good AS (
            SELECT doc_id, place, kind, s, s + length(m[i]) AS e, ratio FROM spans JOIN rated ON rated.v = spans.v[i]
            WHERE CASE kind WHEN 'assign' THEN length(spans.v[i]) >= 6 WHEN 'access' THEN length(m[i]) >= 20 WHEN 'random' THEN ratio >= 9210 ELSE true END
        ), packed AS (
            SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'random') AS n_random, max(ratio) AS top_score,
                string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (WHERE place < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS every FROM good GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random, top_score, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
        FROM documents LEFT JOIN packed USING (doc_id)
    """,
    "lm_base": rf"""
        WITH t AS (
            SELECT doc_id, {_FOLD} = 1 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS words FROM documents
        ), w AS (SELECT doc_id, held_out, unnest(words) AS word FROM t), own AS (SELECT doc_id, held_out, word, count(*) AS n FROM w GROUP BY ALL),
        c AS (SELECT word, sum(n) AS c FROM own WHERE NOT held_out GROUP BY word), s AS (SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS kinds FROM c)
        SELECT doc_id, held_out, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(coalesce(sum(n) FILTER (WHERE c > 0), 0) AS BIGINT) AS n_known, any_value(total) AS train_tokens,
            round(sum(n * log10((coalesce(c, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * (kinds + 1)))), 3) AS base_score
        FROM own LEFT JOIN c USING (word), s GROUP BY doc_id, held_out
    """.replace("\\\\", "\\"),
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), often AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT doc_id, pos, line, coalesce(doc_id <> last, false) AS gone FROM keyed LEFT JOIN often USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages), h AS (SELECT sha, max(page_id) AS head FROM p GROUP BY sha)
        SELECT page_id, strlen(payload) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
        FROM p JOIN h USING (sha)
    """,
    "op5_exact_topk": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS d FROM good
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
            FROM parts q JOIN parts c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10
    """,
    "op1_mixing": """
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                md5(coalesce('=' || CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM sources
        ), run AS (
            SELECT *, 3 * sum(source_size) OVER () AS whole,
                2 * coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
                sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
            FROM weighed
        ), level AS (
            SELECT *, cap * open * 2 <= weight * (whole - gone) AS filled FROM run
        ), first_open AS (
            SELECT whole AS w, gone AS g, open AS o FROM level WHERE NOT filled ORDER BY cap / weight, place LIMIT 1
        ), targets AS (
            SELECT source, source_size, CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (w - g) AS DOUBLE) / CAST(o * 2 AS DOUBLE) END AS target,
                CAST(CAST('0x' || substr(md5('offset' || coalesce('=' || source, 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS off
            FROM level LEFT JOIN first_open ON true
        ), classed AS (
            SELECT *, len(bin(size)) * 16 + CASE WHEN len(bin(size)) > 5 THEN (size >> (len(bin(size)) - 5)) & 15 ELSE size % 16 END AS class,
                CAST('0x' || substr(digest, 1, 2) AS BIGINT) % 64 AS salt FROM sized
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY class, salt, size, digest, doc_id) AS DOUBLE) AS rank FROM classed
        )
        SELECT doc_id, size, source_size, target,
            CAST(floor(each * rank + off) - floor(each * (rank - 1) + off) AS BIGINT) AS copies,
            CAST(floor(each * rank + off) - floor(each * (rank - 1) + off) AS BIGINT) * size AS taken
        FROM (SELECT r.*, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0::DOUBLE END AS each
              FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
    """.replace("\\\\", "\\"),
}
