"""Queries on scalars, text, learning, integrity, sources and windows of events, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, verify
from ..operators import integrity, learn, text
from ..sources import generate
from ..streaming import runs
from . import adapter
from .votes import n_if, r6, ratio

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- answers --------------------------------------------------------------------------------------------------------
_LAST = "list_last(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '-?[0-9,]+\\.?[0-9]*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL))"


@query(f"SELECT doc_id, {_LAST} AS last_number FROM documents")
def last_number(spark, sf_dir):
    d = adapter.table(spark, sf_dir, "documents")
    return d.select("doc_id", answers.last_number_in(F.col("text")).alias("last_number"))


# A chain's text and its gold answer for the verifier, over line items.
_TEXTS = """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'work ' || CAST(l_partkey AS VARCHAR) || ' gives ' || CASE WHEN l_discount > 0.02 THEN '\\boxed{' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '}' ELSE 'about ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS text,
    'so #### ' || CAST(CAST(l_quantity AS INTEGER) + l_linenumber % 2 AS VARCHAR) AS gold, CAST(l_quantity AS INTEGER) AS q, l_linenumber % 2 AS odd, l_discount FROM lineitem) """


def _texts(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    text_of = F.concat(F.lit("work "), F.col("l_partkey").cast("string"), F.lit(" gives "), F.when(F.col("l_discount") > 0.02, F.concat(F.lit("\\boxed{"), q.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("about "), q.cast("string"))))
    gold = F.concat(F.lit("so #### "), (q + F.col("l_linenumber") % 2).cast("string"))
    return adapter.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text_of.alias("text"), gold.alias("gold"), F.lit("gsm8k").alias("dataset"))


@query(_TEXTS + "SELECT gold, CAST(q + odd AS DOUBLE) AS value, count(*) AS n FROM t GROUP BY ALL")
def gsm8k_gold(spark, sf_dir):
    return _texts(spark, sf_dir).groupBy("gold", answers.gsm8k_gold_number(F.col("gold")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(_TEXTS + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, odd = 0 AS correct, count(*) AS n FROM t GROUP BY ALL")
def gsm8k_verify(spark, sf_dir):
    """The native path: without a box the last number of the text is the answer, and inside one too here."""
    t = _texts(spark, sf_dir)
    return t.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verify.native_gsm8k(F.col("text"), F.col("gold")).alias("correct")).agg(F.count(F.lit(1)).alias("n"))


@query(_TEXTS + "SELECT CAST(q AS VARCHAR) AS answer, odd = 0 AS correct, count(*) AS n FROM t GROUP BY ALL")
def verify_distinct(spark, sf_dir):
    """The full verifier, where the rows are."""
    return verify.score_rows(_texts(spark, sf_dir)).groupBy("answer", "correct").agg(F.count(F.lit(1)).alias("n"))


# Boxes of every kind: flat, nested, after a blank (the word counts, braces and all), an open one after a whole one, none.
_BOXES = """WITH t AS (SELECT CAST(l_quantity AS INTEGER) AS q, l_linenumber % 6 AS form FROM lineitem), b AS (SELECT q, form, CASE form WHEN 0 THEN CAST(q AS VARCHAR) WHEN 1 THEN '\\frac{1}{' || q || '}' WHEN 2 THEN '{' || q || '}'
    WHEN 3 THEN CAST(q AS VARCHAR) WHEN 4 THEN 'b' || q END AS boxed, form <> 5 AS anywhere, form IN (0, 1, 3, 4) AS braced FROM t) """


@query(_BOXES + "SELECT form, boxed, anywhere, braced, count(*) AS n FROM b GROUP BY ALL")
def boxed_extract(spark, sf_dir):
    """The last box whose braces balance."""
    t = adapter.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").cast("string").alias("q"), (F.col("l_linenumber") % 6).alias("form"))
    forms = ["\\boxed{1} or \\boxed{ %s }.", "so \\boxed{\\frac{1}{%s}}", "\\boxed {%s} it is", "\\boxed{%s} then \\boxed{open", "\\boxed{a} \\boxed{b%s} end", "nothing %s"]
    # Each row makes the text of its own form only.
    texts = [F.when(F.col("form") == i, F.concat(F.lit(a), "q", F.lit(b))) for i, (a, b) in enumerate(f.split("%s") for f in forms)]
    t = t.withColumn("text", F.coalesce(*texts))
    return t.groupBy("form", answers.boxed(F.col("text")).alias("boxed"), answers.box_anywhere(F.col("text")).alias("anywhere"), answers.box_braced(F.col("text")).alias("braced")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, regexp_replace(lower(trim('  \\text{' || p_brand || '} $x$ ' || p_type)), '\\\\(?:text|mathrm|mathbf|mathit|left|right)\\{([^{}]*)\\}', '\\1', 'g').regexp_replace('[\\s$\\\\]', '', 'g') AS normalised FROM part")
def normalize_string(spark, sf_dir):
    p = adapter.table(spark, sf_dir, "part")
    return p.select("p_partkey", answers.normalised(F.concat(F.lit("  \\text{"), "p_brand", F.lit("} $x$ "), "p_type")).alias("normalised"))


@query("SELECT l_shipdate IS NULL AS unknown, CASE l_linenumber % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' END AS finish_reason, CAST(l_quantity AS INTEGER) AS tokens, coalesce(CASE l_linenumber % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' END = 'length', CAST(l_quantity AS INTEGER) >= 35) AS hit, coalesce(CASE l_linenumber % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' END = 'length', CAST(l_quantity AS INTEGER) = 35) AS legacy, count(*) AS n FROM lineitem GROUP BY ALL")
def cap_hit(spark, sf_dir):
    t = adapter.table(spark, sf_dir, "lineitem")
    reason, tokens = F.when(F.col("l_linenumber") % 3 == 0, "stop").when(F.col("l_linenumber") % 3 == 1, "length"), F.col("l_quantity").cast("int")
    return t.groupBy(F.col("l_shipdate").isNull().alias("unknown"), reason.alias("finish_reason"), tokens.alias("tokens"), answers.cap_hit(reason, tokens, 35).alias("hit"), answers.cap_hit_legacy(reason, tokens, 35).alias("legacy")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CAST(i AS INTEGER) AS chain_index, CAST(CAST('0x' || substr(sha256('42' || chr(0) || CAST(o_orderkey AS VARCHAR) || chr(0) || CAST(i AS VARCHAR)), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM orders, range(2) r(i)")
def seed_sha256(spark, sf_dir):
    o = adapter.table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("chain_index"))
    return o.select("o_orderkey", "chain_index", answers.request_seed(F.lit(42), F.col("o_orderkey"), F.col("chain_index")).cast("string").alias("seed"))


_SAYS = "'Please reason step by step, and put your final answer within ' || chr(92) || 'boxed{}.'"
_PROMPTS = f"""CASE family WHEN 'qwen' THEN '<|im_start|>system' || chr(10) || {_SAYS} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || q || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
    WHEN 'llama3' THEN '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || {_SAYS} || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || q || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)
    WHEN 'r1' THEN '<' || chr(65372) || 'begin' || chr(9601) || 'of' || chr(9601) || 'sentence' || chr(65372) || '><' || chr(65372) || 'User' || chr(65372) || '>' || q || chr(10) || {_SAYS} || '<' || chr(65372) || 'Assistant' || chr(65372) || '><think>' || chr(10)
    ELSE 'Question: ' || q || chr(10) || 'Answer:' END"""


@query(f"SELECT conv_id, turn, family, sha256({_PROMPTS}) AS prompt_sha256 FROM (SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations WHERE role = 'user'), (VALUES ('qwen'), ('llama3'), ('r1'), ('other')) v(family)")
def prompt_render(spark, sf_dir):
    c = adapter.table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.sha2(text.prompt(F.col("text"), k).cast("binary"), 256).alias("prompt_sha256")) for k in ("qwen", "llama3", "r1", "other")])).alias("p")).select("conv_id", "turn", "p.*")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS q_len_words, length(text) AS q_len_chars, length(regexp_replace(text, '[^0-9]', '', 'g')) AS q_digit_count, CAST(length(lang) AS DOUBLE) AS q_math_level, CAST(lang = 'en' AS INTEGER) AS q_is_math FROM documents")
def question_features(spark, sf_dir):
    """Documents stand for questions; those in English for the data set math."""
    d = adapter.table(spark, sf_dir, "documents")
    return d.select("doc_id", *text.question_features(F.col("text"), F.when(F.col("lang") == "en", "math").otherwise("gsm8k"), F.char_length("lang")))


# --- text -----------------------------------------------------------------------------------------------------------
_T = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_W = "len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> ''))"


@query(
    f"""WITH d AS (SELECT doc_id, {_T} AS t FROM documents), w AS (SELECT *, {_W} AS words FROM d)
    SELECT doc_id, words AS g1_question_len, length(t) AS g1_char_len, {r6("CAST(len(regexp_extract_all(t, '\\b[0-9]+[.,]?[0-9]*\\b')) AS DOUBLE) / greatest(words, 1)")} AS g1_num_density,
    {r6("CAST(len(regexp_extract_all(t, '[-+*/=^%]|\\\\(?:sqrt|frac|cdot|times|div)')) AS DOUBLE) / greatest(words, 1)")} AS g1_op_density, len(regexp_extract_all(t, '\\?')) AS g1_sub_question_count,
    greatest(len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')), 1) AS g1_sentence_count, 1 AS g1_is_gsm8k, 0 AS g1_is_math FROM w"""
)
def g1_features(spark, sf_dir):
    d = adapter.table(spark, sf_dir, "documents")
    return d.select("doc_id", *text.g1_features(F.col("text"), F.lit("gsm8k")))


@query(
    f"""SELECT doc_id, n_chars AS token_count, length(text) AS char_len, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS line_count, CAST(contains(text, '\\boxed') AS INTEGER) AS has_boxed,
    CAST(contains(lower(text), 'therefore') AS INTEGER) AS has_therefore, CAST(contains(lower(text), 'final') AS INTEGER) AS has_final, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digit_count,
    {r6("CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) / greatest(length(text), 1)")} AS digit_density FROM documents"""
)
def output_features(spark, sf_dir):
    return adapter.table(spark, sf_dir, "documents").select("doc_id", *text.output_features(F.col("text"), F.col("n_chars")))


_S = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(
    """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN [0.5::DOUBLE] ELSE list_transform(embedding[1:CAST(1 + vec_id % 5 AS BIGINT)], lambda x: CAST(x AS DOUBLE) + 0.5::DOUBLE) END AS s FROM embeddings), m AS (SELECT *, list_sum(s) / len(s) AS mean FROM e)
    SELECT vec_id, round(mean, 5) AS g2_mean, round(list_min(s), 5) AS g2_min, round(list_sum(list_transform(s, lambda x: (x - mean) * (x - mean))) / len(s), 5) AS g2_var, CASE WHEN mean >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g2_high,
    len(s) AS g2_steps, round(list_max(s) - list_min(s), 5) AS g2_range FROM m"""
)
def g2_features(spark, sf_dir):
    """Up to five components around 0.5 stand for step scores; every seventh vector has none."""
    e = adapter.table(spark, sf_dir, "embeddings")
    own = F.transform(F.slice(F.col("embedding").cast("array<double>"), F.lit(1), (F.col("vec_id") % 5 + 1).cast("int")), lambda x: x + 0.5)
    return e.select("vec_id", *text.step_scores(F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<double>")).otherwise(own)))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:CAST(vec_id % 4 AS BIGINT)], lambda x: CASE WHEN x > 0 THEN CAST(x AS DOUBLE) END) AS p, list_transform(embedding[5:CAST(4 + vec_id % 4 AS BIGINT)], lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings),
    k AS (SELECT *, list_filter(p, lambda x: x IS NOT NULL) AS q FROM e)
    SELECT vec_id, round(coalesce(list_sum(q) / nullif(len(q), 0), 0), 6) AS g4_logprob_mean, round(coalesce(list_min(q), 0), 6) AS g4_logprob_min, round(coalesce(list_sum(m) / nullif(len(m), 0), 0), 6) AS g4_margin_mean, round(coalesce(list_min(m), 0), 6) AS g4_margin_min,
    round(coalesce(CAST(len(q) AS DOUBLE) / nullif(len(p), 0), 0), 6) AS g4_coverage FROM k""")
def g4_features(spark, sf_dir):
    """Components stand for chains' log-probabilities, those not above 0 for missing ones."""
    e = adapter.table(spark, sf_dir, "embeddings")
    n, vector = (F.col("vec_id") % 4).cast("int"), F.col("embedding").cast("array<double>")
    own = F.transform(F.slice(vector, F.lit(1), n), lambda x: F.when(x > 0, x))
    return e.select("vec_id", *[F.round(c, 6).alias(k) for c, k in zip(text.uncertainty(own, F.slice(vector, F.lit(5), n)), ("g4_logprob_mean", "g4_logprob_min", "g4_margin_mean", "g4_margin_min", "g4_coverage"), strict=True)])


@query("WITH e AS (SELECT vec_id, list_transform(embedding[1:CAST(vec_id % 4 AS BIGINT)], lambda x: CAST(x AS DOUBLE)) AS b, list_transform(embedding[5:CAST(4 + vec_id % 4 AS BIGINT)], lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings) SELECT vec_id, round(list_sum(b) / nullif(len(b), 0), 6) AS avg_logprob, round(list_sum(list_transform(range(1, len(b) + 1), lambda i: b[CAST(i AS BIGINT)] - s[CAST(i AS BIGINT)])) / nullif(len(b), 0), 6) AS avg_logprob_margin FROM e")
def logprob_summary(spark, sf_dir):
    """Components stand for the best and second log-probability per token."""
    e = adapter.table(spark, sf_dir, "embeddings")
    n, vector = (F.col("vec_id") % 4).cast("int"), F.col("embedding").cast("array<double>")
    s = text.logprob_summary(F.slice(vector, F.lit(1), n), F.slice(vector, F.lit(5), n))
    return e.select("vec_id", s.alias("s")).select("vec_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("avg_logprob", "avg_logprob_margin")])


@query(f"WITH e AS (SELECT vec_id, {_S} AS s FROM embeddings) SELECT vec_id, round(list_sum(s) / len(s), 5) AS mean, round(list_min(s), 5) AS min, round(s[len(s)], 5) AS last, round(list_product(list_transform(s, lambda x: 1 + x)), 4) AS product FROM e")
def chain_score(spark, sf_dir):
    e = adapter.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    return e.select("vec_id", *[F.round(text.chain_score(F.col("s"), k), 5).alias(k) for k in ("mean", "min", "last")], F.round(text.chain_score(F.transform("s", lambda x: 1 + x), "product"), 4).alias("product"))


_PAIR = """WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), q AS (SELECT conv_id, turn, coalesce(a, '') AS a, coalesce(b, '') AS b FROM p),
l AS (SELECT *, coalesce(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: substr(a, 1, CAST(i AS BIGINT)) = substr(b, 1, CAST(i AS BIGINT)))), 0) AS lcp FROM q),
o AS (SELECT conv_id, turn, lcp, round(CASE WHEN length(a) = 0 THEN 1.0 ELSE CAST(lcp AS DOUBLE) / length(a) END, 6) AS ratio, starts_with(b, a) AS is_prefix, a = b AS is_equal, CASE WHEN length(a) = 0 THEN false ELSE CAST(lcp AS DOUBLE) / length(a) < 0.999::DOUBLE END AS diverges FROM l) """


def _overlaps(spark, sf_dir):
    from pyspark.sql import Window

    c = adapter.table(spark, sf_dir, "conversations")
    p = c.select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b"))
    return text.prefix_overlap(p, "a", "b").drop("a", "b")


@query(_PAIR + "SELECT * FROM o")
def prefix_overlap_detail(spark, sf_dir):
    return _overlaps(spark, sf_dir)


@query(
    _PAIR
    + f""", g AS (SELECT *, unnest(['all', CASE WHEN turn % 2 = 0 THEN 'split_complete' ELSE 'split_truncated' END, 'dataset=' || CAST(conv_id % 3 AS VARCHAR)]) AS "group" FROM o)
    SELECT "group", count(*) AS n, {ratio(n_if("is_prefix"), "count(*)")} AS prefix_rate, {ratio(n_if("is_equal"), "count(*)")} AS equal_rate, {r6("avg(ratio)")} AS mean_ratio, min(ratio) AS min_ratio, {n_if("diverges")} AS n_divergent FROM g GROUP BY ALL"""
)
def prefix_overlap_summary(spark, sf_dir):
    return text.prefix_summary(_overlaps(spark, sf_dir), F.col("turn") % 2 == 0, (F.col("conv_id") % 3).cast("string"))


@query("WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 900 THEN substr(t, 1, 900) || '...' ELSE t END AS snippet FROM d")
def text_snippet(spark, sf_dir):
    return adapter.table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


_TRIM = "list_filter(list_transform({x}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"


@query(
    rf"""WITH RECURSIVE d AS (SELECT doc_id, trim(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
    p AS (SELECT doc_id, t, {_TRIM.format(x=r"string_split(t, chr(10) || chr(10))")} AS paragraphs, {_TRIM.format(x=r"string_split(t, chr(10))")} AS lines, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS words FROM d),
    e AS (SELECT doc_id, words, list_filter(range(1, len(words) + 1), lambda i: regexp_matches(words[CAST(i AS BIGINT)], '[.?!;]$')) AS ends FROM p WHERE len(paragraphs) <= 1 AND len(lines) <= 1 AND t <> ''),
    cuts AS (SELECT doc_id, CAST(0 AS BIGINT) AS a, coalesce(list_min(list_filter(ends, lambda i: i >= 4)), len(words)) AS b FROM e
        UNION ALL SELECT c.doc_id, c.b, coalesce(list_min(list_filter(ends, lambda i: i >= c.b + 4)), len(words)) FROM cuts c JOIN e USING (doc_id) WHERE c.b < len(words)),
    spoken AS (SELECT doc_id, list(array_to_string(words[CAST(a + 1 AS BIGINT):CAST(b AS BIGINT)], ' ') ORDER BY a) AS sentences FROM cuts JOIN e USING (doc_id) GROUP BY doc_id),
    s AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN len(paragraphs) > 1 THEN paragraphs WHEN len(lines) > 1 THEN lines WHEN len(sentences) > 1 THEN sentences ELSE [t] END AS s FROM p LEFT JOIN spoken USING (doc_id))
    SELECT doc_id, len(s) AS n_steps, sha256(coalesce(array_to_string(s, chr(10)), '')) AS steps_sha256 FROM s"""
)
def step_split(spark, sf_dir):
    d = adapter.table(spark, sf_dir, "documents").select("doc_id", text.steps(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_steps"), F.sha2(F.array_join("s", "\n").cast("binary"), 256).alias("steps_sha256"))


@query(
    rf"""WITH RECURSIVE e AS (SELECT doc_id, words, list_filter(range(1, len(words) + 1), lambda i: regexp_matches(words[CAST(i AS BIGINT)], '[.?!;]$')) AS ends FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS words FROM documents)),
    cuts AS (SELECT doc_id, CAST(0 AS BIGINT) AS a, coalesce(list_min(list_filter(ends, lambda i: i >= 4)), len(words)) AS b FROM e WHERE len(words) > 0
        UNION ALL SELECT c.doc_id, c.b, coalesce(list_min(list_filter(ends, lambda i: i >= c.b + 4)), len(words)) FROM cuts c JOIN e USING (doc_id) WHERE c.b < len(words))
    SELECT doc_id, count(a) AS n_steps, sha256(coalesce(string_agg(array_to_string(words[CAST(a + 1 AS BIGINT):CAST(b AS BIGINT)], ' '), chr(10) ORDER BY a), '')) AS steps_sha256 FROM e LEFT JOIN cuts USING (doc_id) GROUP BY doc_id"""
)
def step_split_sentences(spark, sf_dir):
    """Documents as single lines, so that sentences are what is left to split by."""
    one = F.array_join(text.word_list(F.coalesce(F.col("text"), F.lit(""))), " ")
    d = adapter.table(spark, sf_dir, "documents").select("doc_id", text.steps(one).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_steps"), F.sha2(F.array_join("s", "\n").cast("binary"), 256).alias("steps_sha256"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(CAST(l_quantity AS INTEGER), 35) AS token_count, CASE WHEN CAST(l_quantity AS INTEGER) <= 35 THEN 'stop' ELSE 'length' END AS finish_reason, CASE WHEN CAST(l_quantity AS INTEGER) <= 35 THEN 'eos' END AS stop_reason, CAST(list_sum(range(1, least(CAST(l_quantity AS INTEGER), 35) + 1)) AS BIGINT) AS id_sum FROM lineitem")
def lower_cap_prefix(spark, sf_dir):
    """Chains cut at a lower cap by their tokens."""
    q = F.col("l_quantity").cast("int")
    chain = F.struct(F.sequence(F.lit(1), q).alias("token_ids"), q.alias("token_count"), F.lit("stop").alias("finish_reason"), F.lit("eos").alias("stop_reason"))
    t = adapter.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", chain.alias("c"))
    t = t.withColumn("c", text.lower_cap(F.col("c"), 35))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c.token_count", "c.finish_reason", "c.stop_reason", F.aggregate("c.token_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


# --- learning -------------------------------------------------------------------------------------------------------
_LABELLED = """WITH f AS (SELECT doc_id, quality AS label, n_chars, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, len(string_split(text, chr(10))) AS lines, length(text) - length(replace(text, ' ', '')) AS blanks, 1 AS one FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL) """
_FEATURES = ["n_chars", "digits", "lines", "blanks"]


def _labelled(spark, sf_dir):
    d = adapter.table(spark, sf_dir, "documents").join(adapter.table(spark, sf_dir, "labels").filter("quality is not null"), "doc_id")
    t = F.col("text")
    return d.select("doc_id", F.col("quality").alias("label"), "n_chars", F.char_length(F.regexp_replace(t, "[^0-9]", "")).alias("digits"), F.size(F.split(t, "\n")).alias("lines"), (F.char_length(t) - F.char_length(F.replace(t, F.lit(" "), F.lit("")))).alias("blanks"), F.lit(1).alias("one"))


@query(_LABELLED + f", u AS (SELECT 'n_chars' AS feature, n_chars AS s, label FROM f UNION ALL SELECT 'digits', digits, label FROM f UNION ALL SELECT 'lines', lines, label FROM f), k AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY s) + (count(*) OVER (PARTITION BY feature, s) - 1) / 2.0::DOUBLE AS r FROM u), a AS (SELECT feature, {n_if('label = 1')} AS n_pos, {n_if('label = 0')} AS n_neg, sum(r) FILTER (WHERE label = 1) AS rs FROM k GROUP BY ALL) SELECT feature, n_pos, n_neg, {r6('(rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg)')} AS auc FROM a")
def auc_rank(spark, sf_dir):
    f = _labelled(spark, sf_dir).select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").alias("s")) for c in ("n_chars", "digits", "lines")])).alias("x")).select("label", "x.*")
    return learn.auc(f, "s", "label", "feature")


@query(
    "WITH f AS (SELECT lang, quality AS label, n_chars AS s FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), k AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0::DOUBLE AS r FROM f), "
    f"a AS (SELECT lang, {n_if('label = 1')} AS p, {n_if('label = 0')} AS n, sum(r) FILTER (WHERE label = 1) AS rs FROM k GROUP BY ALL) SELECT 'n_chars' AS feature, "
    + ", ".join(f"max({r6('(rs - p * (p + 1) / 2.0::DOUBLE) / nullif(p * n, 0)')}) FILTER (WHERE lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr"))
    + " FROM a"
)
def auc_pivot(spark, sf_dir):
    """AUC of a feature by language, languages as columns."""
    d = adapter.table(spark, sf_dir, "documents").join(adapter.table(spark, sf_dir, "labels").filter("quality is not null"), "doc_id")
    areas = learn.auc(d.select("lang", F.col("quality").alias("label"), F.col("n_chars").alias("s")), "s", "label", "lang")
    return areas.withColumn("feature", F.lit("n_chars")).groupBy("feature").pivot("lang", ["de", "en", "es", "fr"]).agg(F.max("auc"))


@query("SELECT doc_id, quality AS label, CAST((row_number() OVER (PARTITION BY quality ORDER BY sha256('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels WHERE quality IS NOT NULL")
def stratified_folds(spark, sf_dir):
    rows = adapter.table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", F.col("quality").alias("label"))
    return learn.stratified_folds(rows, "doc_id", "label")


@query("WITH g AS (SELECT user_id, max(CAST(value > 100 AS INTEGER)) AS label FROM events GROUP BY ALL), f AS (SELECT user_id, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || CAST(user_id AS VARCHAR)), user_id) - 1) % 5 AS INTEGER) AS fold FROM g) SELECT event_id, user_id, fold FROM events JOIN f USING (user_id)")
def group_folds(spark, sf_dir):
    e = adapter.table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") > 100).cast("int").alias("label"))
    return learn.group_folds(e, "user_id", "label").select("event_id", "user_id", "fold")


@query()
def balanced_folds(spark, sf_dir):
    """Folds by user with even counts of both labels; placing leftover groups is beyond SQL, so tests bound the evenness."""
    e = adapter.table(spark, sf_dir, "events").withColumn("label", (F.col("value") > 50).cast("int"))
    return learn.balanced_group_folds(e, "user_id", "label").select("event_id", "user_id", "fold")


@query(_LABELLED + " SELECT " + "UNION ALL SELECT ".join(f"'{c}' AS feature, {r6(f'corr({c}, label)')} AS r, {r6(f'avg({c}) FILTER (WHERE label = 1)')} AS mean_pos, {r6(f'avg({c}) FILTER (WHERE label = 0)')} AS mean_neg FROM f " for c in _FEATURES))
def feature_label_corr(spark, sf_dir):
    return learn.correlations(_labelled(spark, sf_dir), _FEATURES, "label")


@query(_LABELLED + " SELECT " + "UNION ALL SELECT ".join(f"'{c}' AS \"column\", count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) AS n_values, count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) > 1 AS keep FROM f " for c in [*_FEATURES, "one"]))
def drop_constant_columns(spark, sf_dir):
    return learn.constant_columns(_labelled(spark, sf_dir), [*_FEATURES, "one"])


def _oof(spark, sf_dir, kind):
    f = learn.stratified_folds(_labelled(spark, sf_dir).drop("one"), "doc_id", "label")
    return learn.out_of_fold(f, _FEATURES, "label", kind).select("doc_id", "fold", F.col("label").cast("int").alias("label"), F.round("probability", 4).alias("probability"))


@query()
def lr_oof(spark, sf_dir):
    return _oof(spark, sf_dir, "logistic")


@query()
def rf_oof(spark, sf_dir):
    return _oof(spark, sf_dir, "forest")


# --- integrity ------------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) > 1 AS conflicting FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return integrity.duplicate_keys(adapter.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def idset_diff(spark, sf_dir):
    return integrity.id_differences(adapter.table(spark, sf_dir, "documents"), adapter.table(spark, sf_dir, "labels"), "doc_id")


@query("WITH c AS (SELECT l_orderkey AS problem_id, CAST(l_quantity AS INTEGER) AS tokens, l_returnflag AS f, l_discount AS d FROM lineitem), r AS (SELECT problem_id, max(tokens) AS m, bool_or(d = 0) AS z, count(*) AS n FROM c GROUP BY ALL) SELECT problem_id, 'cap' AS rule FROM r WHERE m > 45 UNION ALL SELECT problem_id, 'answered' FROM r WHERE z UNION ALL SELECT problem_id, 'chain_count' FROM r WHERE n < 2")
def protocol_violations(spark, sf_dir):
    """Rules over packed chains; the full protocol between three arms is in operators.integrity and its tests."""
    c = adapter.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("problem_id")).agg(F.collect_list(F.struct(F.col("l_quantity").cast("int").alias("tokens"), (F.col("l_discount") > 0).alias("answered"))).alias("chains"))
    rules = {"cap": F.forall("chains", lambda c: c["tokens"] <= 45), "answered": F.forall("chains", lambda c: c["answered"]), "chain_count": F.size("chains") >= 2}
    return integrity.violations(c, "problem_id", rules)


@query(adapter.SQL + ", z AS (SELECT b.problem_id, b.chain_index, c.complete AS c_complete, c.token_count AS ct, b.token_count AS bt, b.complete AS bc, b.answer IS NOT DISTINCT FROM c.answer AS same FROM chains b JOIN chains c USING (problem_id, chain_index) WHERE b.arm = 'B' AND c.arm = 'C') SELECT count(*) AS n, count(*) FILTER (WHERE bt = least(ct, 35)) AS n_prefix, count(*) FILTER (WHERE bc AND same) AS n_same_when_uncut, count(*) FILTER (WHERE bc AND NOT same) AS n_broken FROM z")
def prefix_identity(spark, sf_dir):
    """A chain that the lower cap doesn't cut has to be the same in both runs."""
    a = adapter.arms(spark, sf_dir).select(F.explode(F.zip_with("b", "c", lambda b, c: F.struct(b.alias("b"), c.alias("c")))).alias("p")).select("p.*")
    same = F.col("b.answer").eqNullSafe(F.col("c.answer"))
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b.token_count") == F.least("c.token_count", F.lit(35))).alias("n_prefix"), F.count_if(F.col("b.complete") & same).alias("n_same_when_uncut"), F.count_if(F.col("b.complete") & ~same).alias("n_broken"))


@query("WITH s AS (SELECT l_returnflag, l_partkey, count(*) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(sum(m) AS BIGINT) AS n, count(*) AS n_unique, max(m) AS max_multiplicity, CAST(sum(m) - count(*) AS BIGINT) AS n_duplicate FROM s GROUP BY ALL")
def seed_collisions(spark, sf_dir):
    return integrity.collisions(adapter.table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_todo(spark, sf_dir):
    done = adapter.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return integrity.resume_todo(adapter.table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value > 0) WHERE k = 1")
def keep_last_dedupe(spark, sf_dir):
    from ..sources.records import keep_last

    e = adapter.table(spark, sf_dir, "events")
    return keep_last(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], F.col("value") > 0).select("user_id", "event_type", "event_id", "value")


@query("SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS n, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND CAST(d.n_chars > 1500 AS INTEGER) IS DISTINCT FROM l.quality) AS n_changed, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND l.quality IS NULL AND d.n_chars IS NOT NULL) AS n_filled, count(*) FILTER (WHERE d.doc_id IS NULL OR l.doc_id IS NULL) AS n_unmatched FROM labels l FULL JOIN documents d USING (doc_id)")
def relabel_diff(spark, sf_dir):
    new = adapter.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("quality"))
    return integrity.relabel_counts(adapter.table(spark, sf_dir, "labels").select("doc_id", "quality"), new, ["doc_id"], "quality")


@query(adapter.SQL + f"SELECT arm, count(*) AS n, {r6('avg(token_count)')} AS mean_tokens, max(token_count) AS max_tokens, {r6('avg(CAST(NOT complete AS INTEGER))')} AS hit_max_fraction, count(*) FILTER (WHERE token_count > 35) AS over_max_count FROM chains GROUP BY ALL")
def budget_audit(spark, sf_dir):
    a = adapter.arms(spark, sf_dir)
    rows = adapter.chain_rows(a, "a").unionByName(adapter.chain_rows(a, "b")).unionByName(adapter.chain_rows(a, "c"))
    return integrity.budget_audit(rows, 35, "arm")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(CAST('0x' || substr(sha256('42|' || CAST(o_orderkey AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE, o_orderkey) AS k FROM orders) WHERE k <= 80")
def seeded_sample(spark, sf_dir):
    o = adapter.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return generate.seeded_sample(o, 80, "o_orderkey", 42, "o_orderpriority")


# --- windows of events: an extension --------------------------------------------------------------------------------
@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type AS answer, count(*) AS votes, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_votes(spark, sf_dir):
    return runs.tumbling(adapter.table(spark, sf_dir, "events"))


@query("WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS window_start, event_type, value FROM events, range(2) r(k)) SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type AS answer, count(*) AS votes, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def sliding_votes(spark, sf_dir):
    return runs.sliding(adapter.table(spark, sf_dir, "events"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k")
def session_votes(spark, sf_dir):
    return runs.sessions(adapter.table(spark, sf_dir, "events"))
