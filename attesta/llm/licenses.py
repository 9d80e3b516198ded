"""Licence scans: Dice coefficient over word bigrams against licence templates. DataFrame functions only.

A text is normalised to words (lower case; runs of characters other than a-z and 0-9 part them). A
template of w words is compared with every window of w words (with the whole text, if it has fewer):
dice = 2 |A and B| / (|A| + |B|) over the sets of word bigrams. So a notice inside a line, a licence
wrapped over lines, and one inside a longer file are all found. Windows that reach the threshold lie
side by side; of such a run (starts less than w apart) the best window is the hit.

A template of b bigrams can reach the threshold t only with windows of b t / (2 - t) to b (2 - t) / t
bigrams, and only if they share b t / (2 - t) with it at least. Three bounds prune, and lose nothing:

* Of any b - that + 1 bigrams of a template one must be in the text: texts that have none of these
  anchors are done, and so are templates whose anchors a text has none of.
* A window must hold as many positions with bigrams of the template; only windows that do are
  compared. They follow from the sorted list of those positions.
* The size of a window's set must lie within the bounds.

Documents are scanned where they lie: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.license_texts import TEMPLATES

_HIT = "array<struct<start: int, license: string, words: int, shared: int, size: int>>"


def text_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text, in order."""
    words = text_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def least_size(b: int, t: Fraction) -> int:
    return ceil(b * t / (2 - t))


def most_size(b: int, t: Fraction) -> int:
    return floor(b * (2 - t) / t)


def anchors(templates: dict[str, list[str]], t: Fraction) -> dict[str, list[str]]:
    """For each template enough bigrams that every window that reaches t has one of them; rare-looking ones first, shared ones reused."""
    use = Counter(g for grams in templates.values() for g in grams)
    common = {"the", "of", "to", "this", "is", "a", "and", "in", "with", "for", "any", "or", "use"}
    chosen: set[str] = set()
    out = {}
    for name, grams in templates.items():
        need = len(grams) - least_size(len(grams), t) + 1
        out[name] = sorted(grams, key=lambda g: (g not in chosen, sum(w in common for w in g.split()), -len(g), use[g]))[:need]
        chosen.update(out[name])
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def text_bigrams(text: Column) -> Column:
    """Word bigrams of a normalised text, in order, repeated ones too (null: none)."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    pairs = _let(words, lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_compact(pairs)


def _windows(grams: Column, name: str, template: str, t: Fraction) -> Column:
    """Hits of one template among the bigrams of a text."""
    own, w = bigrams(template), len(text_words(template))
    b, need = len(own), least_size(len(own), t)
    lo, hi = F.lit(need), F.lit(most_size(b, t))
    length = F.least(F.size(grams) + 1, F.lit(w))  # words of a window
    none = F.array().cast("array<int>")
    at = F.array_compact(F.transform(grams, lambda g, i: F.when(g.isin(own), i)))

    def starts(p: Column) -> Column:
        def between(j: Column) -> Column:
            first, last = F.greatest(F.get(p, j + (need - 1)) - length + 2, F.lit(0)), F.least(F.get(p, j), F.size(grams) + 1 - length)
            return F.when(first <= last, F.sequence(first, last)).otherwise(none)

        ranges = F.transform(F.sequence(F.lit(0), F.size(p) - need), between)
        return F.when(F.size(p) >= need, F.array_sort(F.array_distinct(F.flatten(ranges)))).otherwise(none)

    def compared(s: Column) -> Column:
        def score(a: Column) -> Column:
            shared = F.when(F.size(a).between(lo, hi), F.size(F.array_intersect(a, _texts(own)))).otherwise(0)
            return F.struct(s.alias("start"), shared.alias("shared"), (F.size(a) + b).alias("size"))

        return _let(F.array_distinct(F.slice(grams, s + 1, length - 1)), score)

    def best(found: Column) -> Column:
        def run(heads: Column) -> Column:
            def of(h: Column, k: Column) -> Column:
                end = F.coalesce(F.get(heads, k + 1), F.size(found))
                return F.array_max(F.transform(F.slice(found, h + 1, end - h), lambda c: F.struct((F.lit(2.0) * c["shared"] / c["size"]).alias("dice"), (-c["start"]).alias("before"), c.alias("hit"))))["hit"]

            return F.transform(heads, of)

        heads = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i)["start"] - F.get(found, i - 1)["start"] >= w))
        hits = _let(heads, run)
        form = F.transform(hits, lambda c: F.struct(c["start"].alias("start"), F.lit(name).alias("license"), length.alias("words"), c["shared"].alias("shared"), c["size"].alias("size")))
        return F.when(F.size(found) > 0, form).otherwise(F.array().cast(_HIT))

    reach = F.filter(F.transform(_let(at, starts), compared), lambda c: 2 * t.denominator * c["shared"] >= t.numerator * c["size"])
    return _let(reach, best)


def licence_hits(grams: Column, templates: dict[str, str] | None = None, threshold: str = "0.8") -> Column:
    """array<struct<start, license, words, shared, size>> by start and licence, of the bigrams that ``text_bigrams`` gives.

    ``start`` counts words from 0, ``words`` are those of the window; dice is 2 shared / size, as
    ``size`` is that of both sets together. Null, empty and licence-free texts give an empty array.
    Templates of fewer than two words are not looked for.
    """
    t = Fraction(threshold)
    texts = {k: v for k, v in (templates or TEMPLATES).items() if bigrams(v)}
    none = F.array().cast(_HIT)
    if not texts:
        return none
    keys = anchors({k: bigrams(v) for k, v in texts.items()}, t)
    every = sorted({g for own in keys.values() for g in own})
    found = [F.when(F.arrays_overlap(grams, _texts(keys[k])), _windows(grams, k, v, t)).otherwise(none) for k, v in texts.items()]
    return F.when(F.arrays_overlap(grams, _texts(every)), F.array_sort(F.flatten(F.array(*found)))).otherwise(none)


def dice_of(hit: Column) -> Column:
    return F.lit(2.0) * hit["shared"] / hit["size"]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: str = "0.8") -> DataFrame:
    """id, n_hits, license, dice, start, hits for every row of ``docs``.

    ``hits`` are all of them; license, dice and start are those of the best (highest dice, then first
    start, then name in alphabetical order), null without a hit. Texts of any length are scanned
    whole; null and empty ones have no hit. Repeated and null ids stay as they are; other columns
    are not read, whatever their names; an empty table gives an empty table.
    """
    grams = docs.select("doc_id", text_bigrams(F.col("text")).alias("grams"))
    hits = grams.select("doc_id", licence_hits(F.col("grams"), templates, threshold).alias("hits"))
    best = F.array_min(F.transform("hits", lambda h: F.struct((-dice_of(h)).alias("less"), h["start"].alias("start"), h["license"].alias("license"))))
    return hits.select("doc_id", "hits", best.alias("best")).select(
        "doc_id", F.size("hits").cast("long").alias("n_hits"), F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice"), F.col("best.start").cast("long").alias("start"), "hits"
    )
