"""Personal data in whole texts: patterns propose, checksums confirm, context scores. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import row_struct
from .spans import joined, matches_of, slim, spans_of, with_matches

# Fixed patterns, by kind in the order in which spans with one start are listed. Those of the first four match what
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
# match, written without backtracking and without a new start inside a run that has failed already, so that time
# stays linear in very long texts and no recursion grows with a match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# A text without these holds no span of the kind, and the passes over it are spared.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
}
BASE_KINDS = ("email", "ip", "card", "phone")
# Fixed scores of a confirmed span, and what a context word near it adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
CONTEXT_GAIN = 0.2
# Fixed context words by kind.
CONTEXT = {
    "email": "e-?mail|contact|mail",
    "ip": "ip|address|host|server",
    "card": "card|credit|debit|visa|mastercard|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
}
OUT = (*(f"n_{k}" for k in PATTERNS), "base_spans", "all_spans", "top_score")

_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
# Luhn: from the right, every second digit counts double, less 9 if above 9.
_LUHN = "aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, int(substr({d}, -i, 1)), 2 * int(substr({d}, -i, 1)) - if(substr({d}, -i, 1) > '4', 9, 0))) % 10 = 0"
# ISO 13616: four leading characters go last, letters count 10 to 35; the number is 1 modulo 97, digit by digit.
_MOD97 = "aggregate(sequence(1, length({b})), 0, (a, i) -> if(substr({b}, i, 1) between '0' and '9', (a * 10 + int(substr({b}, i, 1))) % 97, (a * 100 + ascii(substr({b}, i, 1)) - 55) % 97)) = 1"


def _valid(kind: str) -> str:
    """SQL over a candidate c with its match c.m: whether its checksum or form confirms it."""
    if kind == "ip":
        return rf"c.m rlike r'\A{_OCTET}(?:\.{_OCTET}){{3}}\z'"
    if kind == "card":
        digits = "regexp_replace(c.m, '[^0-9]', '')"
        return f"if(length({digits}) between 12 and 19, {_LUHN.format(d=digits)}, false)"
    if kind == "phone":
        return "length(regexp_replace(c.m, '[^0-9]', '')) between 9 and 15"
    if kind == "iban":
        bare = "concat(substr(replace(c.m, ' ', ''), 5), substr(replace(c.m, ' ', ''), 1, 4))"
        return f"if(length({bare}) between 15 and 34, {_MOD97.format(b=bare)}, false)"
    return "true"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 40, least_score: float = 0.5) -> DataFrame:
    """docs with counts by kind, base_spans, all_spans (arrays of kind, start, end, score) and top_score.

    Positions are code points from 0, the end exclusive. Matches of a kind are leftmost and don't overlap; those
    that fail their check (octets at most 255, Luhn, digits of a phone number, mod 97) are dropped without another
    try. A span scores by its kind, and more if one of the kind's context words stands within `window` characters.
    Base kinds stay whatever their score; of the other kinds those of at least least_score stay. A null text is
    empty. Columns of docs stay, but those named like the new ones are replaced; an empty table gives no rows.
    One pass over the rows, no shuffle.
    """
    kinds = list(PATTERNS)
    out = with_matches(docs.select(row_struct(docs, OUT).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), PATTERNS, NEEDS)
    spans = []
    for order, k in enumerate(kinds):
        around = f"substr(t, int(greatest(1, c.e - length(c.m) - {window} + 1)), length(c.m) + {2 * window})"
        score = f"least(1D, {SCORES[k]}D + if({around} rlike r'(?i)\\b(?:{CONTEXT[k]})\\b', {CONTEXT_GAIN}D, 0D))"
        one = spans_of(k, order, matches_of(k, _valid(k)), score)
        spans.append(F.expr(one if k in BASE_KINDS else f"filter({one}, s -> s.score >= {least_score}D)").alias(f"f_{k}"))
    out = out.select("row", *spans)
    base = F.array_sort(F.concat(*[f"f_{k}" for k in BASE_KINDS]))
    every = F.array_sort(F.concat(*[f"f_{k}" for k in kinds]))
    out = out.select("row", *[F.size(f"f_{k}").cast("long").alias(f"n_{k}") for k in kinds], base.alias("b"), every.alias("v"))
    return out.select("row.*", *[f"n_{k}" for k in kinds], slim("b").alias("base_spans"), slim("v").alias("all_spans"), F.coalesce(F.array_max("v.score"), F.lit(0.0)).alias("top_score"))

