"""Column expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Code points that Python's str.strip() takes away (fixed values).
_BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
_URL_NAMESPACE = "6BA7B8119DAD11D180B400C04FD430C8"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """The text without white space (any Unicode kind) at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(_col(c).cast("string"), f"^{_BLANK}+|{_BLANK}+$", ""), F.lit(""))


def folded(c: Column | str) -> Column:
    """``stripped`` in lower case: the form in which identifiers are compared."""
    return F.lower(stripped(c))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100; null where whole is 0 or null."""
    return F.when(whole != 0, part / whole * 100.0)


def banded(score: Column, bands: list[tuple[float, str]], otherwise: str, missing: str) -> Column:
    """Label of the first band (highest first) that the score reaches."""
    out = F.when(score.isNull(), missing)
    for least, label in bands:
        out = out.when(score >= least, label)
    return out.otherwise(otherwise)


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def joined_name(*parts: Column) -> Column:
    """Parts joined by |, null parts empty: the names of review ids."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def strict_date(c: Column | str) -> Column:
    """A date from year-month-day text (dashes or slashes, a time may follow); null if it is none."""
    text = F.trim(_col(c))
    return F.when(text.rlike(r"^[0-9]{1,}[-/][0-9]{1,2}[-/][0-9]{1,2}"), F.regexp_replace(text, "/", "-").try_cast("date"))


def signature(members: Column) -> Column:
    """SHA-256 of an array of member keys, in order and joined by |."""
    return F.sha2(F.array_join(F.array_sort(members), "|"), 256)


def spark_predicate(text: str) -> str:
    """A rule's predicate in Spark's dialect: regexp_matches becomes a partial match with raw patterns whose final $ is the end of the text; the schema prefix goes."""
    text = re.sub(r"\bmain\.", "", text)

    def pattern(m: re.Match) -> str:
        body = m[2]
        if body.endswith("$"):
            body = body[:-1] + r"\z"
        return f"regexp_like({m[1]}, r'{body}')"

    return re.sub(r"\bregexp_matches\(((?:[^(),']|\([^()]*\))+),\s*'([^']*)'\)", pattern, text)
