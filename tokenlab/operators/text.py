"""Text features, prefix overlap, step splitting and prompts, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import ASCII_BLANKS, BLANKS, cap_hit, is_ascii, once, stripped
from ..sources.records import require_same_ids

# Fixed patterns of the question features.
NUMBER_WORDS, OPERATORS = r"\b\d+[\.,]?\d*\b", r"[+\-*/=^%]|\\(?:sqrt|frac|cdot|times|div)"


def word_list(text: Column) -> Column:
    return F.filter(F.when(is_ascii(text), F.split(text, f"{ASCII_BLANKS}+")).otherwise(F.split(text, f"{BLANKS}+")), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(word_list(text))


def g1_features(text: Column, dataset: Column, math_level: Column | None = None) -> list[Column]:
    """Question features: lengths, densities of numbers and operators, questions, sentences, domain flags.

    With math_level, that too, 0 where it is null.
    """
    t = stripped(F.coalesce(text, F.lit("")))
    words = n_words(t)
    per = lambda pattern: F.round(F.regexp_count(t, F.lit(pattern)) / F.greatest(words, F.lit(1)), 6)
    sentences = F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: stripped(s) != ""))
    return [
        words.cast("long").alias("g1_question_len"), F.char_length(t).cast("long").alias("g1_char_len"), per(NUMBER_WORDS).alias("g1_num_density"),
        per(OPERATORS).alias("g1_op_density"), F.regexp_count(t, F.lit(r"\?")).cast("long").alias("g1_sub_question_count"),
        F.greatest(sentences, F.lit(1)).cast("long").alias("g1_sentence_count"), (F.lower(dataset) == "gsm8k").cast("int").alias("g1_is_gsm8k"), (F.lower(dataset) == "math").cast("int").alias("g1_is_math"),
        *([] if math_level is None else [F.coalesce(math_level.cast("double"), F.lit(0.0)).alias("math_level")]),
    ]


def question_features(question: Column, dataset: Column, math_level: Column) -> list[Column]:
    """Five features of a question as it stands: words, characters, digits, level and whether it is of `math`."""
    q = F.coalesce(question, F.lit(""))
    return [
        n_words(q).cast("long").alias("q_len_words"), F.char_length(q).cast("long").alias("q_len_chars"), F.char_length(F.regexp_replace(q, r"\P{Nd}", "")).cast("long").alias("q_digit_count"),
        F.coalesce(math_level.cast("double"), F.lit(0.0)).alias("q_math_level"), F.coalesce(dataset == "math", F.lit(False)).cast("int").alias("q_is_math"),
    ]


def output_features(text: Column, token_count: Column, hit_max: Column | None = None) -> list[Column]:
    """Features of an output; an empty one has no lines. With hit_max, whether the cap cut it, too."""
    t = F.coalesce(text, F.lit(""))
    digits = F.char_length(F.regexp_replace(t, "[^0-9]", ""))
    low = F.lower(t)
    return [
        token_count.cast("long").alias("token_count"), F.char_length(t).cast("long").alias("char_len"), F.when(t == "", 0).otherwise(F.size(F.split(t, "\n"))).cast("long").alias("line_count"),
        t.contains("\\boxed").cast("int").alias("has_boxed"), low.contains("therefore").cast("int").alias("has_therefore"), low.contains("final").cast("int").alias("has_final"),
        digits.cast("long").alias("digit_count"), F.round(digits / F.greatest(F.char_length(t), F.lit(1)), 6).alias("digit_density"),
        *([] if hit_max is None else [F.coalesce(hit_max, F.lit(False)).cast("int").alias("hit_max")]),
    ]


def step_scores(scores: Column) -> list[Column]:
    """G2 features of an array of step scores: mean, least, population variance, steps, range, and high: 1 if the mean
    is 0.5 or more, else 0. Without scores, those of one step of 0.5."""
    some = F.coalesce(F.size(scores) > 0, F.lit(False))
    s = F.transform(F.when(some, scores).otherwise(F.array(F.lit(0.5))), lambda x: x.cast("double"))
    n = F.size(s)
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
    variance = F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    r = lambda x: F.round(x, 5)
    return [r(mean).alias("g2_mean"), r(F.array_min(s)).alias("g2_min"), r(variance).alias("g2_var"), F.when(mean >= 0.5, 1.0).otherwise(0.0).alias("g2_high"), n.cast("long").alias("g2_steps"), r(F.array_max(s) - F.array_min(s)).alias("g2_range")]


def chain_score(scores: Column, how: str) -> Column:
    """mean, min, last or product of step scores; 0.5 without any."""
    out = {
        "mean": F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores), "min": F.array_min(scores), "last": F.try_element_at(scores, F.lit(-1)),
        "product": F.aggregate(scores, F.lit(1.0), lambda a, x: a * x),
    }[how]
    return F.when(F.size(scores) > 0, out).otherwise(F.lit(0.5))


def uncertainty(logprobs: Column, margins: Column) -> list[Column]:
    """G4 features over chains' mean log-probabilities and margins (nulls allowed): means, minima, coverage."""
    some = lambda x: F.filter(x, lambda v: v.isNotNull())
    mean = lambda x: F.when(F.size(some(x)) > 0, F.aggregate(some(x), F.lit(0.0), lambda a, v: a + v) / F.size(some(x))).otherwise(F.lit(0.0))
    low = lambda x: F.coalesce(F.array_min(some(x)), F.lit(0.0))
    return [mean(logprobs).alias("g4_logprob_mean"), low(logprobs).alias("g4_logprob_min"), mean(margins).alias("g4_margin_mean"), low(margins).alias("g4_margin_min"), F.when(F.size(logprobs) > 0, F.size(some(logprobs)) / F.size(logprobs)).otherwise(F.lit(0.0)).alias("g4_coverage")]


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by halving: about 21 comparisons of prefixes, whatever the length."""
    most = F.least(F.char_length(a), F.char_length(b))
    start = F.struct(F.lit(0).alias("lo"), most.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(middle - 1).alias("hi"))

    # Halving a span of n ends after ceil(log2(n + 1)) steps.
    steps = F.sequence(F.lit(1), F.length(F.bin(most.cast("long"))) + 1)
    return F.aggregate(steps, start, halve)["lo"]


def prefix_overlap(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the common prefix, its share of a (1 if a is empty), whether a begins b, equality and divergence."""
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    out = pairs.withColumn("lcp", common_prefix(x, y).cast("long"))
    ratio = F.when(F.char_length(x) == 0, F.lit(1.0)).otherwise(F.col("lcp") / F.char_length(x))
    return out.select("*", F.round(ratio, 6).alias("ratio"), F.startswith(y, x).alias("is_prefix"), (x == y).alias("is_equal"), (ratio < 0.999).alias("diverges"))


def prefix_summary(overlaps: DataFrame, complete: Column, dataset: Column) -> DataFrame:
    """By group: all, split_complete, split_truncated and dataset=..."""
    groups = F.array(F.lit("all"), F.when(complete, "split_complete").otherwise("split_truncated"), F.concat(F.lit("dataset="), dataset))
    rows, n = overlaps.select("*", F.explode(groups).alias("group")), F.count(F.lit(1))
    share = lambda c: F.round(F.count_if(c).cast("double") / n, 6)
    return rows.groupBy("group").agg(n.alias("n"), share("is_prefix").alias("prefix_rate"), share("is_equal").alias("equal_rate"), F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.min("ratio").alias("min_ratio"), F.count_if("diverges").alias("n_divergent"))


def prefix_runs(a: DataFrame, b: DataFrame, a_cap: int, split: DataFrame | None = None, split_cap: int | None = None) -> DataFrame:
    """prefix_overlap of the first chains of two runs, with whether a cap cut a's, and the split run's (a's without one).

    Runs: problem_id, dataset, chains; the id sets have to be equal, which records.require_same_ids checks. The split
    run's ending is what prefix_summary groups by.
    """
    first = lambda d, n, cap: d.select("problem_id", F.try_element_at("chains", F.lit(1)).alias("__c")).select("problem_id", F.col("__c.text").alias(f"{n}_text"), F.col("__c.token_count").alias(f"{n}_tokens"), cap_hit(F.col("__c.finish_reason"), F.col("__c.token_count"), cap).alias(f"{n}_hit_max"))
    for other in (b, *([] if split is None else [split])):
        require_same_ids(a, other, "problem_id")
    rows = a.select("problem_id", "dataset").join(first(a, "a", a_cap), "problem_id").join(first(b, "b", a_cap).drop("b_hit_max"), "problem_id")
    rows = rows.join(first(a if split is None else split, "split", a_cap if split is None else split_cap).drop("split_text"), "problem_id")
    return prefix_overlap(rows, "a_text", "b_text")


def steps(text: Column, delimiter: str = "auto", least_words: int = 4) -> Column:
    """Reasoning steps: paragraphs, else lines, else sentences, else the whole text; by a delimiter, the parts between.

    A sentence ends with a word that ends in . ? ! or ; and is its least_words-th or a later one, so that short
    sentences go with the next; what is left at the end is one more. Nothing of the text is lost.
    """
    t = F.coalesce(text, F.lit(""))
    parts = lambda x, mark: F.filter(F.transform(F.split(x, mark), stripped), lambda p: p != "")
    if delimiter != "auto":
        return parts(t, "\\Q" + delimiter + "\\E")

    def sentences(x: Column) -> Column:
        # One pass: words of the text with one blank between any two, up to the first that may end a sentence.
        spaced = F.when(is_ascii(x), F.regexp_replace(x, f"{ASCII_BLANKS}+", " ")).otherwise(F.regexp_replace(x, f"{BLANKS}+", " "))
        pattern = rf"(?s)(?:[^ ]++ ){{{least_words - 1}}}(?! ).*?[.?!;](?= |\z)|[^ ].*"
        return once(F.regexp_extract_all(spaced, F.lit(pattern), F.lit(0)), lambda s: F.when(F.size(s) > 1, s).otherwise(F.array(x)))

    def split(x: Column) -> Column:
        lines = once(parts(x, "\n"), lambda p: F.when(F.size(p) > 1, p).otherwise(sentences(x)))
        broken = once(parts(x, "\n\n"), lambda p: F.when(F.size(p) > 1, p).otherwise(lines))
        return F.when(x == "", F.array().cast("array<string>")).when(x.contains("\n"), broken).otherwise(sentences(x))

    return once(stripped(F.replace(t, F.lit("\r\n"), F.lit("\n"))), split)


def snippet(text: Column, most: int = 900) -> Column:
    """White space collapsed, cut with dots."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


# Fixed: the system text and the chat formats by model family; {q} is the question.
SYSTEM = "Please reason step by step, and put your final answer within \\boxed{}."
PROMPTS = {
    "qwen": f"<|im_start|>system\n{SYSTEM}<|im_end|>\n<|im_start|>user\n{{q}}<|im_end|>\n<|im_start|>assistant\n",
    "llama3": f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{SYSTEM}<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n{{q}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    "r1": f"<｜begin▁of▁sentence｜><｜User｜>{{q}}\n{SYSTEM}<｜Assistant｜><think>\n",
    "default": "Question: {q}\nAnswer:",
}


def prompt(question: Column, family: str) -> Column:
    """The prompt of a family (with or without the suffix _math); an unknown one gets the default."""
    before, after = PROMPTS.get(family.removesuffix("_math"), PROMPTS["default"]).split("{q}")
    return F.concat(F.lit(before), F.coalesce(question, F.lit("")), F.lit(after))


def lower_cap(chain: Column, cap: int) -> Column:
    """A chain cut at a lower cap: unchanged if it ends below; else its first tokens, finish `length`, no stop reason."""
    ends = F.size(chain["token_ids"]) <= cap
    cut = chain.withField("token_ids", F.slice(chain["token_ids"], 1, cap)).withField("token_count", F.lit(cap)).withField("finish_reason", F.lit("length")).withField("stop_reason", F.lit(None).cast("string"))
    return F.when(ends, chain).otherwise(cut)


def logprob_summary(best: Column, second: Column) -> Column:
    """Struct of the mean of the best log-probability per token and of its margin over the second; nulls without tokens."""
    mean = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x))
    return F.struct(mean(best).alias("avg_logprob"), mean(F.zip_with(best, second, lambda a, b: a - b)).alias("avg_logprob_margin"))
