"""Personal data in texts, in DataFrame operations only.

Regular expressions propose spans, leftmost and non-overlapping for each kind. Validators confirm them: digit counts,
the Luhn sum of cards, octet ranges of addresses, the mod-97 remainder of IBANs. Every span gets a score that words
within ``CONTEXT`` characters around it raise or lower. Spans of the base kinds always stay; added kinds (IBANs and social
security numbers) stay from ``MIN_SCORE`` on.

Spark has no function that returns the places of all matches. The text is therefore split at the pattern and the
pieces' lengths, alternating with the matches' lengths, are summed up; time grows in proportion to the matches. The patterns take what they match possessively and
begin at the first character of a run only, which changes no match but keeps them linear on very long runs; texts without
a needed character skip a pattern.

Defined results: a null text is empty and has no spans; every row of the table gives one row, repeated or not; places are
code points; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.blocks import bound, states_before

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
CONTEXT = 40
PAGE = 64
MIN_SCORE = 0.6

# The pattern of each kind and a character every match has.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", ""),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-"),
}
# Score of a span without context, and the context words that raise or lower it by 0.3.
SCORES = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.4}
RAISE = {
    "email": "mail|contact|write|address", "ip": r"\bip\b|address|host|server|login", "card": "card|visa|credit|payment|pay",
    "phone": "phone|call|tel|mobile|fax|contact", "iban": "iban|bank|account|transfer", "ssn": "ssn|social security|tax",
}
LOWER = {"ip": "version|release|section|chapter", "card": "isbn|order|invoice|serial", "phone": "version|isbn", "iban": "serial|part no", "ssn": "part no|order|model"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d, i: (
        F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))))
    return F.aggregate(numbers, F.lit(0), lambda a, d: a + d) % 10 == 0


def _mod97(compact: Column) -> Column:
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))

    def step(rest: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 65, (rest * 10 + (code - 48)) % 97).otherwise((rest * 100 + (code - 55)) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    """Validity of a proposed value; ``when`` keeps the costly sums away from values of a wrong length."""
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)(?:\.|$)){4}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(value) > 40, False).when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        compact = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(compact).between(15, 34), _mod97(compact)).otherwise(False)
    return F.lit(True)


def _found(kind: str, hits: Column, gaps: Column) -> Column:
    """Spans of one kind from the matches and the pieces between them."""
    number = KINDS.index(kind)

    def spans(pairs: Column) -> Column:
        # Places by the lengths alone: a piece between matches, then the match.
        ends = states_before(pairs, F.lit(0), "int", lambda at, x: at + F.length(x["gap"]) + F.length(x["hit"]))

        def span(x: Column, before: Column) -> Column:
            start = before + F.length(x["gap"])
            value = F.struct(start.alias("start"), F.lit(number).alias("number"), (start + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("value"))
            return F.when(_valid(kind, x["hit"]), value)

        return F.array_compact(F.zip_with(pairs, ends, span))

    # Zipped outside the lambdas, so that the text is split once and not once for each match.
    return bound(F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda x: x["hit"].isNotNull()), spans)


def _near(pages: Column, start: Column, length: Column) -> Column:
    """``length`` (at most a page) characters from ``start`` (from 0) on, out of the two pages that hold them."""
    page = F.floor(start / PAGE).cast("int")
    two = F.concat(F.coalesce(F.get(pages, page), F.lit("")), F.coalesce(F.get(pages, page + 1), F.lit("")))
    return F.substring(two, start - page * PAGE + 1, length)


def _scored(pages: Column, span: Column) -> Column:
    """The span with its score."""
    low = F.greatest(span["start"] - CONTEXT, F.lit(0))
    around = F.lower(F.concat(_near(pages, low, span["start"] - low), F.lit(" "), _near(pages, span["end"], F.lit(CONTEXT))))
    score = F.lit(0.0)
    for kind in KINDS:
        value = F.lit(SCORES[kind]) + F.when(around.rlike(RAISE[kind]), 0.3).otherwise(0.0)
        if kind in LOWER:
            value = value - F.when(around.rlike(LOWER[kind]), 0.3).otherwise(0.0)
        score = F.when(span["kind"] == kind, value).otherwise(score)
    score = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)
    return F.struct(span["start"].alias("start"), span["number"].alias("number"), span["end"].alias("end"), span["kind"].alias("kind"), span["value"].alias("value"), score.alias("score"))


def find_personal_data(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with ``spans``: start, number of the kind, end (exclusive), kind, value and score, by start, then kind."""
    content = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "spans"]
    work = docs.select(F.struct(*kept).alias("row"), content.alias("content"))
    digits = F.col("content").rlike("[0-9]")
    for kind, (pattern, needed) in PATTERNS.items():
        may = F.contains("content", F.lit(needed)) if needed else digits
        may = may & digits if kind not in ("email",) else may
        work = work.withColumns({
            f"{kind}_hits": F.when(may, F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")),
            f"{kind}_gaps": F.when(may, F.split("content", pattern, -1)).otherwise(F.array().cast("array<string>")),
        })
    spans = F.concat(*[_found(kind, F.col(f"{kind}_hits"), F.col(f"{kind}_gaps")) for kind in KINDS])
    work = work.select("row", "content", spans.alias("spans"))
    # The text is cut into pages once; a context is taken from two of them, whatever the length of the text.
    pages = F.when(F.size("spans") > 0, F.regexp_extract_all("content", F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)))
    seen = F.struct(pages.alias("pages"), F.array_sort("spans").alias("spans"))
    scored = bound(seen, lambda x: F.transform(x["spans"], lambda s: _scored(x["pages"], s)))
    work = work.select("row", scored.alias("spans"))
    stay = F.filter("spans", lambda s: (s["number"] < len(BASE_KINDS)) | (s["score"] >= min_score))
    return work.select("row.*", stay.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
