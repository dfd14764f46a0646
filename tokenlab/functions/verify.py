"""Answers in texts: extraction, canonical forms and equality; plain cases in built-in functions, the rest in an Arrow UDF.

Symbolic equality is that of symbols.py; what can't be read as an expression falls back to a normalised string. Every
verification has SECONDS; one that takes longer is recorded as timed_out, with the verdict that strings give, and can be
scored again with more time.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import answers, symbols

TOLERANCE = 1e-4
#: An exponent from here on beside another power makes a tower that is not worked out.
TOWER = 100
#: Seconds for one verification.
SECONDS = 3.0
#: Scores that a Python worker remembers, of texts up to so many characters.
REMEMBERED, SHORT = 1 << 14, 1 << 12
_PLAIN = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?")


def plain_float(text: str | None) -> float | None:
    """A finite decimal number; no underscores, suffixes or names."""
    text = (text or "").strip()
    if not _PLAIN.fullmatch(text):
        return None
    value = float(text)
    return value if math.isfinite(value) else None


def extract_boxed(text: str | None) -> str | None:
    r"""Content of the last \boxed{...} with balanced braces; without any \boxed{, the word after the last "\boxed "."""
    text = text or ""
    starts = [m.end() for m in re.finditer(r"\\boxed\{", text)]
    for start in reversed(starts):
        depth = 1
        for i in range(start, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if not depth:
                return text[start:i].strip()
    if starts:
        return None
    tail = text.rpartition("\\boxed ")
    return tail[2].split()[0] if tail[1] and tail[2].split() else None


def gsm8k_gold(text: str | None) -> float | None:
    """The number after the first ####."""
    m = re.search(r"####\s*([-\d,.]+)", text or "")
    return plain_float(m[1].replace(",", "")) if m else None


def last_number(text: str | None) -> float | None:
    """The last number in the text, commas aside."""
    for m in reversed(re.findall(r"-?[\d,]+\.?\d*", text or "")):
        if (value := plain_float(m.replace(",", ""))) is not None:
            return value
    return None


def normalise(text: str) -> str:
    """Lower case, without style commands around braces, white space, $ and backslashes."""
    text = re.sub(r"\\(?:text|mathrm|mathbf|mathit|left|right)\{([^{}]*)\}", r"\1", text.strip().lower())
    return re.sub(r"[\s$\\]", "", text)


def has_tower(text: str) -> bool:
    """Two powers or more, one of them with an exponent of TOWER or more."""
    if text.count("^") < 2:
        return False
    return any(int(x) >= TOWER for x in re.findall(r"\^\s*\{?\s*(\d+)", text))


def _entries(text: str) -> list[list[str]] | None:
    """Entries of a matrix by row, or of a tuple as one row."""
    m = re.fullmatch(r"\\begin\{[pbvB]?matrix\}(.*)\\end\{[pbvB]?matrix\}", text.strip(), re.S)
    if m:
        return [[x.strip() for x in row.split("&")] for row in re.split(r"\\\\", m[1].strip()) if row.strip()]
    m = re.fullmatch(r"[(\[](.*)[)\]]", text.strip(), re.S)
    if m and "," in m[1] and not re.search(r"[(\[].*,.*[)\]]", m[1]):
        return [[x.strip() for x in m[1].split(",")]]
    return None


def is_label(text: str) -> bool:
    """A text command, or letters only, two at least."""
    return "\\text" in text or bool(re.fullmatch(r"[A-Za-z][A-Za-z ]+", text.strip()))


def canonical(text: str) -> str:
    """A key that equal answers share; votes count these."""
    if is_label(text) or has_tower(text):
        return normalise(text)
    if rows := _entries(text):
        return ";".join(",".join(canonical(x) for x in row) for row in rows)
    tree = symbols.read(text)
    key = None if tree is None else symbols.key(tree)
    return normalise(text) if key is None else key


def numeric(text: str) -> float | None:
    """A number: plain, or an expression without letters other than commands."""
    if (value := plain_float(text.replace(",", ""))) is not None:
        return value
    if re.search(r"[A-Za-z]", re.sub(r"\\[A-Za-z]+", "", text)) or has_tower(text):
        return None
    tree = symbols.read(text)
    return None if tree is None else symbols.number(tree)


def symbolic_equal(a: str, b: str) -> bool | None:
    """None where one of them can't be read."""
    x, y = _entries(a), _entries(b)
    if x or y:
        if not x or not y or [len(r) for r in x] != [len(r) for r in y]:
            return False if x and y else None
        each = [symbolic_equal(p, q) for r, s in zip(x, y, strict=True) for p, q in zip(r, s, strict=True)]
        return None if None in each else all(each)
    p, q = symbols.read(a), symbols.read(b)
    return None if p is None or q is None else symbols.equal(p, q)


def gsm8k_prediction(text: str | None) -> float | None:
    """A boxed number or expression, else the last number in the box, else the last number in the text."""
    box = extract_boxed(text)
    if box is not None:
        value = numeric(box)
        value = last_number(box) if value is None else value
        if value is not None:
            return value
    return last_number(text)


def verify_gsm8k(text: str | None, gold: str | None, tolerance: float = TOLERANCE) -> bool:
    want = gsm8k_gold(gold)
    got = gsm8k_prediction(text)
    return want is not None and got is not None and abs(got - want) <= tolerance


def verify_math(text: str | None, gold: str | None, tolerance: float = TOLERANCE) -> bool:
    """From cheap to dear: equal strings, towers as strings, canonical forms, numbers (decisive), symbols."""
    a, b = extract_boxed(text), extract_boxed(gold)
    if a is None or b is None:
        return False
    if normalise(a) == normalise(b):
        return True
    if has_tower(a) or has_tower(b):
        return False
    if canonical(a) == canonical(b):
        return True
    x, y = numeric(a), numeric(b)
    if x is not None and y is not None:
        return abs(x - y) <= tolerance
    return symbolic_equal(a, b) is True


def _kind(dataset: str | None) -> str:
    kind = (dataset or "").lower()
    if kind not in ("gsm8k", "math", "aime"):
        raise ValueError(f"unknown dataset {dataset!r}")
    return kind


def verify(text: str | None, gold: str | None, dataset: str | None) -> bool:
    return verify_gsm8k(text, gold) if _kind(dataset) == "gsm8k" else verify_math(text, gold)


def answer_key(text: str | None, dataset: str | None) -> str | None:
    """What votes count: a number in %.10g form for gsm8k, a canonical form elsewhere; None if there is no answer."""
    if _kind(dataset) == "gsm8k":
        value = gsm8k_prediction(text)
        return None if value is None else f"{value:.10g}"
    box = extract_boxed(text)
    return None if box is None else canonical(box)


# Fixed: presentation that the relaxed rule takes off a box: spacing, the degree sign, four units.
_SPACING, _DEGREE = re.compile(r"\\(?:,|;|!|\s)+"), re.compile(r"\^\s*\\circ")
_UNITS = re.compile(r"\\text\{(?:degrees?|edges?|square inches?|sq\.?\s*cm)\}", re.IGNORECASE)
# Fixed: numbers as the relaxed rules find them.
_NUMBERISH, _NUMBER = re.compile(r"-?\d+(?:,\d{3})*(?:\.\d+)?(?:\s*/\s*-?\d+(?:,\d{3})*(?:\.\d+)?)?"), re.compile(r"-?\d+(?:\.\d+)?")


def without_units(box: str) -> str:
    for pattern in (_SPACING, _DEGREE, _UNITS):
        box = pattern.sub("", box)
    return box.strip()


def plain_ratio(text: str | None) -> float | None:
    """A decimal number or a / b of two; commas, $, \\left and \\right aside. A fraction command is none."""
    if text is None:
        return None
    top, slash, bottom = re.sub(r"\\(?:left|right)|[,$]", "", text.strip()).partition("/")
    if not slash:
        return plain_float(top)
    x, y = plain_float(top), plain_float(bottom)
    return x / y if x is not None and y else None


def relaxed_units(text: str | None, gold: str | None, dataset: str | None, capped: bool) -> bool:
    """The strict verdict; for `math` also boxes equal without units, or as numbers; without a box the text's last
    number, but not if the cap cut the text."""
    if verify(text, gold, dataset):
        return True
    if _kind(dataset) != "math":
        return False
    box, want = extract_boxed(text), extract_boxed(gold)
    if box is not None and want is not None and verify_math(f"\\boxed{{{without_units(box)}}}", f"\\boxed{{{without_units(want)}}}"):
        return True
    value = plain_ratio(want)
    if value is None:
        return False
    if box is None and not capped:
        box = (_NUMBERISH.findall(text or "") or [None])[-1]
    got = plain_ratio(box)
    return got is not None and abs(got - value) <= TOLERANCE


def relaxed_answer(text: str | None, dataset: str | None) -> str | None:
    """The strict answer, else the last number in the text, commas aside."""
    strict = answer_key(text, dataset)
    return strict if strict is not None else (_NUMBER.findall((text or "").replace(",", "")) or [None])[-1]


def relaxed_last_number(text: str | None, gold: str | None, dataset: str | None) -> bool:
    """The strict verdict, or without a strict answer the last number against a gold that is a plain number, to 1e-6."""
    if verify(text, gold, dataset):
        return True
    if answer_key(text, dataset) is not None:
        return False
    want = gsm8k_gold(gold) if _kind(dataset) == "gsm8k" else plain_float((extract_boxed(gold) or "").replace(",", ""))
    hits = _NUMBER.findall((text or "").replace(",", ""))
    return want is not None and bool(hits) and abs(float(hits[-1]) - want) <= 1e-6


def cache_key(operation: str, *values, version: str = "1", tolerance: float = TOLERANCE) -> bytes:
    """sha256 over the parts, each behind its length in eight bytes, so that no two lists of parts run together."""
    digest = hashlib.sha256()
    for part in (version, operation, tolerance, *values):
        data = str(part).encode("utf-8", "surrogatepass")
        digest.update(len(data).to_bytes(8, "big") + data)
    return digest.digest()


SCORE = T.StructType([T.StructField("answer", T.StringType()), T.StructField("correct", T.BooleanType()), T.StructField("timed_out", T.BooleanType()), T.StructField("relaxed_answer", T.StringType()), T.StructField("relaxed_correct", T.BooleanType()), T.StructField("units_correct", T.BooleanType())])


def _worked_out(text: str | None, gold: str | None, dataset: str | None, capped: bool) -> tuple:
    return answer_key(text, dataset), verify(text, gold, dataset), False, relaxed_answer(text, dataset), relaxed_last_number(text, gold, dataset), relaxed_units(text, gold, dataset, capped)


def _by_strings(text: str | None, gold: str | None, dataset: str | None) -> tuple:
    """What is left when time is up: boxes as strings."""
    a, b = extract_boxed(text), extract_boxed(gold)
    same = a is not None and b is not None and normalise(a) == normalise(b)
    key = None if a is None else normalise(a)
    return key, same, True, key, same, same


# Raises TimedOut, so that only what was worked out is remembered.
_remembered = lru_cache(REMEMBERED)(_worked_out)


def score(text: str | None, gold: str | None, dataset: str | None, capped: bool = False, seconds: float | None = SECONDS) -> tuple:
    """Answer, verdict, whether time ran out, and answer and verdicts of the relaxed rules (a last number; units)."""
    work = _worked_out if text is not None and len(text) > SHORT else _remembered
    try:
        with symbols.deadline(seconds):
            return work(text, gold, dataset, capped)
    except symbols.TimedOut:
        return _by_strings(text, gold, dataset)


def score_udf(seconds: float = SECONDS):
    """score() over columns; rows with a null data set are passed over."""

    @F.pandas_udf(SCORE)
    def run(text: pd.Series, gold: pd.Series, dataset: pd.Series, capped: pd.Series) -> pd.DataFrame:
        none = (None,) * len(SCORE)
        rows = [none if d is None else score(t, g, d, bool(c), seconds) for t, g, d, c in zip(text, gold, dataset, capped, strict=True)]
        return pd.DataFrame(rows, columns=SCORE.names, dtype=object)

    return run


def _last_box(text: Column) -> Column:
    """What follows the last box's brace; the whole text without one."""
    return F.substring_index(text, "\\boxed{", -1)


def plain_score(text: Column, gold: Column, kind: Column) -> Column:
    """score() where built-in functions can tell it, else null: the answer is a plain number in the last box, or there is
    no box at all and the data set's answers are last numbers (gsm8k), or whole numbers in both boxes.

    Digits other than ASCII and numbers beyond a double are left to score().
    """
    t, g = F.coalesce(text, F.lit("")), F.coalesce(gold, F.lit(""))
    boxes, opened = t.contains("\\boxed"), t.contains("\\boxed{")
    inside = F.regexp_extract(_last_box(t), r"^\s*([-+]?[0-9][0-9,]*(?:\.[0-9]+)?)\s*\}", 1)
    whole = lambda x: F.regexp_extract(_last_box(x), r"^\s*([-+]?[0-9]{1,15})\s*\}", 1)
    number = F.when(opened & (inside != ""), answers.as_number(F.replace(inside, F.lit(","), F.lit("")))).when(~boxes, answers.last_number_in(t))
    want = answers.gsm8k_gold_number(g)
    plain = ~t.rlike(r"[\p{Nd}&&[^0-9]]") & ~g.rlike(r"[\p{Nd}&&[^0-9]]")

    def of_number(x: Column) -> Column:
        answer = answers.ten_digits(x)
        right = F.coalesce(F.abs(x - want) <= F.lit(TOLERANCE), F.lit(False))
        return F.when(F.abs(x) < 1e300, _verdict(answer, right, answer, right))

    none = F.lit(None).cast("string")
    # Without any number there is no answer, strict or relaxed.
    words = ~boxes & ~t.rlike("[0-9]")
    gsm8k = F.when(words, _verdict(none, F.lit(False), none, F.lit(False))).when(number.isNotNull(), answers.once(number, of_number))
    a, b = whole(t), whole(g)
    short = F.when(a != "", a.try_cast("long").cast("string"))
    right = a.try_cast("long") == b.try_cast("long")
    boxed = F.when(opened & g.contains("\\boxed{") & (a != "") & (b != ""), _verdict(short, right, short, right)).when(words, _verdict(none, F.lit(False), none, F.lit(False)))
    return F.when(plain & (kind == "gsm8k"), gsm8k).when(plain & kind.isin("math", "aime"), boxed)


def _verdict(answer: Column, right: Column, relaxed: Column, relaxed_right: Column) -> Column:
    return F.struct(answer.alias("answer"), right.alias("correct"), F.lit(False).alias("timed_out"), relaxed.alias("relaxed_answer"), relaxed_right.alias("relaxed_correct"), right.alias("units_correct"))


def score_rows(rows: DataFrame, text: str = "text", gold: str = "gold", dataset: str = "dataset", capped: str | None = None, relaxed: bool = False, seconds: float = SECONDS) -> DataFrame:
    """rows with answer, correct and timed_out, and with relaxed also relaxed_answer, relaxed_correct and units_correct.

    Built-in functions decide plain cases; only the other rows' texts go to Python, once for all rules, without a
    shuffle. Every worker remembers REMEMBERED verdicts of short texts. capped: a column that says whether a cap cut the
    text, for the rule of units. A null or unknown data set is an error.
    """
    names = SCORE.names if relaxed else SCORE.names[:3]
    kind = F.lower(F.col(dataset))
    kind = F.when(kind.isin("gsm8k", "math", "aime"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown dataset "), F.coalesce(F.col(dataset), F.lit("null")))))
    cut = F.lit(False) if capped is None else F.coalesce(F.col(capped), F.lit(False))
    told = rows.drop(*names).withColumn("__kind", kind).withColumn("__plain", plain_score(F.col(text), F.col(gold), F.col("__kind")))
    rest = lambda c: F.when(F.col("__plain").isNull(), c)
    scored = told.withColumn("__score", score_udf(seconds)(rest(F.col(text)), rest(F.col(gold)), rest(F.col("__kind")), cut))
    out = scored.withColumn("__score", F.coalesce("__plain", "__score"))
    return out.select("*", *[F.col(f"__score.{c}").alias(c) for c in names]).drop("__score", "__plain", "__kind")


def native_gsm8k(text: Column, gold: Column) -> Column:
    """The gsm8k path without boxes, in built-in functions."""
    return F.coalesce(F.abs(answers.last_number_in(text) - answers.gsm8k_gold_number(gold)) <= F.lit(TOLERANCE), F.lit(False))
