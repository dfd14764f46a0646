"""Answers and row predicates in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal number as Python reads one; Java's parser would also take suffixes such as "7d".
_NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
# Fixed: a number as it stands in a text, with grouped thousands and a denominator.
NUMBERISH = r"-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:\s*/\s*-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)?"
#: White space as Python's strip and split see it.
BLANKS = r"(?U)[\s\x1c-\x1f]"
#: Those of them that are ASCII, for texts that are.
ASCII_BLANKS, ASCII_CHARS = r"[\x09-\x0d\x1c-\x20]", " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


def as_number(text: Column) -> Column:
    bare = F.trim(text)
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def last_number_in(text: Column) -> Column:
    """The last number in a text, commas aside."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?[0-9,]+\.?[0-9]*"), F.lit(0))
    numbers = F.filter(F.transform(found, lambda x: as_number(F.replace(x, F.lit(","), F.lit("")))), lambda x: x.isNotNull())
    return F.try_element_at(numbers, F.lit(-1))


def gsm8k_gold_number(text: Column) -> Column:
    """The number after the first ####."""
    return as_number(F.replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"####\s*([-0-9,.]+)", 1), F.lit(","), F.lit("")))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def stripped(text: Column) -> Column:
    """text without white space at its ends, as Python strips it."""
    return F.when(is_ascii(text), F.trim(text, F.lit(ASCII_CHARS))).otherwise(F.regexp_replace(text, f"{BLANKS}+\\z|^{BLANKS}+", ""))


def _closed(rest: Column) -> Column:
    """What stands before the brace that closes one opened just before `rest`; null if none does."""
    parts = F.regexp_extract_all(rest, F.lit(r"[{}]|[^{}]+"), F.lit(0))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        return F.when(s["depth"] == 0, s).otherwise(F.struct(depth.alias("depth"), (s["n"] + F.char_length(part)).alias("n")))

    return once(F.aggregate(parts, start, step), lambda e: F.when(e["depth"] == 0, F.substring(rest, F.lit(1), e["n"] - 1)))


# From the last box on, if its braces hold no other ones, or those no third ones.
_LAST_BOX = r"(?s)^.*\\boxed\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+){0,64}+)\}"


def boxed(text: Column) -> Column:
    r"""verify.extract_boxed in built-in functions: the last \boxed{...} whose braces balance, without any \boxed{ the word
    after the last "\boxed "."""
    text = F.coalesce(text, F.lit(""))

    def nested(parts: Column) -> Column:
        after = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: stripped(_closed(F.array_join(F.slice(parts, i, F.size(parts)), "\\boxed{"))))
        return F.try_element_at(F.filter(after, lambda x: x.isNotNull()), F.lit(-1))

    def word(tails: Column) -> Column:
        return F.when(F.size(tails) > 1, F.nullif(F.try_element_at(F.split(stripped(F.element_at(tails, -1)), f"{BLANKS}+"), F.lit(1)), F.lit("")))

    # A box that the pattern reads is the last that balances, unless a later one balances that it can't read: then
    # what follows it has an opened box that is closed, and the braces are counted.
    def read(found: Column) -> Column:
        later = F.substring(text, F.char_length(found) + 1, F.char_length(text))
        flat = (found != "") & ~later.contains("\\boxed{")
        return F.when(flat, stripped(F.regexp_extract(found, _LAST_BOX, 1))).otherwise(once(F.split(text, r"\\boxed\{"), nested))

    return F.when(text.contains("\\boxed{"), once(F.regexp_extract(text, _LAST_BOX, 0), read)).when(text.contains("\\boxed "), once(F.split(text, r"\\boxed "), word))


def normalised(text: Column) -> Column:
    """verify.normalise in built-in functions."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"\\(?:text|mathrm|mathbf|mathit|left|right)\{([^{}]*)\}", "$1")
    return F.regexp_replace(bare, r"[\s$\\]", "")


def last_numberish(text: Column) -> Column:
    """The last number as it stands: thousands, decimals, a / b with blanks, signs and thousands in both."""
    return F.try_element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBERISH), F.lit(0)), F.lit(-1))


def cap_hit(finish_reason: Column, token_count: Column, cap: Column | int) -> Column:
    """Stopped by the cap: as recorded, else by the number of tokens."""
    return F.coalesce(finish_reason == "length", F.coalesce(token_count, F.lit(0)) >= cap)


def cap_hit_legacy(finish_reason: Column, token_count: Column, cap: Column | int) -> Column:
    """As cap_hit, but without a record only if the tokens are exactly the cap's."""
    return F.coalesce(finish_reason == "length", F.coalesce(token_count, F.lit(0)) == cap)


def box_anywhere(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).contains("\\boxed")


def box_opened(text: Column) -> Column:
    r"""\boxed with a brace, or with white space after it."""
    return F.coalesce(text, F.lit("")).rlike(r"\\boxed\s*\{|\\boxed\s+")


def box_braced(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\\boxed\{")


def once(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ten_digits(number: Column) -> Column:
    """A double in Python's %.10g form: ten significant digits, no zeros at the end, an exponent below 1e-4 and from 1e10."""
    bare = lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)

    def shown(parts: Column) -> Column:
        power = parts[1].cast("int")
        fixed = bare(F.call_function("format_string", F.concat(F.lit("%."), (9 - power).cast("string"), F.lit("f")), number))
        return F.when(power.between(-4, 9), fixed).otherwise(F.concat(bare(parts[0]), F.lit("e"), parts[1]))

    return once(F.split(F.format_string("%.9e", number), "e"), shown)


def g3_answer(text: Column) -> Column:
    """What agreement counts: lower case without white space and commas, numbers in %.10g form."""

    def read(bare: Column) -> Column:
        infinite = F.concat(F.when(F.startswith(bare, F.lit("-")), "-").otherwise(""), F.lit("inf"))
        word = F.when(bare.rlike("^[-+]?inf(inity)?$"), infinite).when(bare.rlike("^[-+]?nan$"), "nan").otherwise(bare)
        number = as_number(F.regexp_replace(bare, "(?<=[0-9])_(?=[0-9])", ""))
        return once(number, lambda n: F.when(n.isNull(), word).when(F.abs(n) == float("inf"), infinite).otherwise(ten_digits(n)))

    return once(F.replace(F.regexp_replace(F.lower(text), f"{BLANKS}+", ""), F.lit(","), F.lit("")), read)


def request_seed(base: Column, problem: Column, chain: Column) -> Column:
    """The first eight bytes of sha256(base, NUL, problem, NUL, chain), as an unsigned number: DECIMAL(20, 0)."""
    nul = F.lit("\x00")
    digest = F.sha2(F.concat(base.cast("string"), nul, problem.cast("string"), nul, chain.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


# Fixed offsets of budgets by name; another name takes 4000 plus its hash.
BUDGET_OFFSETS = {"short": 0, "medium": 1000, "long": 2000, "sample": 3000}


def budget_offset(name: Column) -> Column:
    out = (F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long") % 100_000) + 4000
    for k, v in BUDGET_OFFSETS.items():
        out = F.when(name == k, F.lit(v).cast("long")).otherwise(out)
    return out
