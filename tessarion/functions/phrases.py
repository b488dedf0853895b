"""Phrases: normalising, judging and splitting text, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V

#: Any letter case, Unicode classes: what \w, \s and \b mean in the patterns' own dialect.
ANY = "(?iU)"
#: What (?U)\s means.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def dialect(text: Column, rx: str) -> Column:
    """The pattern to use on ``text``: Unicode classes find in ASCII what plain ones do, and take longer."""
    flags, rest = re.fullmatch(r"\(\?(i?)U\)(.*)", rx, re.S).groups()
    return F.when(F.octet_length(text) == F.char_length(text), F.lit(f"(?{flags}){rest}" if flags else rest)).otherwise(F.lit(rx))


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether one of some lower-case words may be in a text, in any letter case: sure if not, and cheaper than a
    pattern; texts beyond ASCII always may."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(text), F.lit(w))
    return found | (F.octet_length(text) != F.char_length(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each(rows: DataFrame, kept: Sequence[str | Column], array: Column, pos: str, name: str) -> DataFrame:
    """A row for each element of an array, with its place.

    For the inner explode Spark asks in a filter whether the array has elements, which works it out again.  The
    array is a column before: inside of the explode its expressions would not be compiled.
    """
    held = rows.select(*kept, array.alias("each_array"))
    return held.select("*", F.posexplode_outer("each_array").alias(pos, name)).drop("each_array").where(F.col(pos).isNotNull())


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words_of(values) -> str:
    return "|".join(values)


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def without_subordinator(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{ANY}^(?:{words_of(V.SUBORDINATORS)})\s+", ""))


_ARTICLE = rf"{ANY}^(?:{words_of(V.ARTICLES)})\s+"


def has_determiner(raw: Column) -> Column:
    return F.rlike(without_subordinator(squeeze(raw)), F.lit(_ARTICLE))


def normalize_phrase(raw: Column) -> Column:
    """A captured operand cut down to the concept it names."""

    def cut(text: Column, marker: Column) -> Column:
        at = F.position(marker, F.lower(text))
        return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)

    marked = F.rlike(F.lower(squeeze(raw)), F.lit(words_of(V.TAIL_MARKERS)))
    text = F.when(marked, F.aggregate(lits(V.TAIL_MARKERS), squeeze(raw), cut)).otherwise(squeeze(raw))
    text = F.trim(F.regexp_replace(without_subordinator(text), _ARTICLE, ""))
    text = F.btrim(text, F.lit(V.PHRASE_EDGES))
    return F.regexp_replace(text, rf"{ANY}(?:\s+(?:{words_of(V.TRAILING_MODIFIERS)}))+$", "")


def is_usable(phrase: Column) -> Column:
    return (F.length(phrase) >= 2) & ~F.lower(phrase).isin(list(V.STOP_PHRASES)) & (F.size(F.split(phrase, " ")) <= 6)


def is_concept(phrase: Column, determined: Column) -> Column:
    """Whether a phrase plausibly names something: it looks technical, ends in a domain noun, is several
    words without filler, or was written with a determiner."""
    clean = F.transform(F.split(phrase, " "), lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""))
    first, last, n = F.get(clean, F.lit(0)), F.element_at(clean, -1), F.size(clean)
    filler = F.arrays_overlap(clean, lits(V.LEADING_STOPWORDS))
    return (
        F.when((F.length(phrase) == 0) | first.isin(V.LEADING_STOPWORDS), False)
        .when(F.rlike(phrase, F.lit(r"[\p{Lu}\p{Nd}]")), True)
        .when((n == 1) & first.isin(V.NON_CONCEPTS), False)
        .when(last.isin(V.DOMAIN_HEADS), True)
        .when((n >= 2) & ~filler, True)
        .otherwise(determined & ~filler)
    )


def sentences(text: Column) -> Column:
    """Sentences in order; abbreviations do not end one."""
    for k, abbreviation in enumerate(V.ABBREVIATIONS):
        text = F.replace(text, F.lit(abbreviation), F.lit(f"\x00{k}\x00"))
    # a split compiles its pattern for every text
    parts = F.when(F.rlike(text, F.lit(V.SENTENCE_END)), F.split(text, V.SENTENCE_END, -1)).otherwise(F.array(text))

    def restore(part: Column) -> Column:
        for k, abbreviation in enumerate(V.ABBREVIATIONS):
            part = F.replace(part, F.lit(f"\x00{k}\x00"), F.lit(abbreviation))
        return strip(part)

    return F.filter(F.transform(parts, restore), lambda p: p != "")


def clauses(sentence: Column) -> Column:
    """Coordinated clauses of a sentence; the sentence itself if nothing is left."""
    parts = F.filter(F.transform(F.split(sentence, f"{ANY}{V.CLAUSE_END}", -1), strip), lambda p: p != "")
    whole = F.when(strip(sentence) != "", strip(sentence)).otherwise(sentence)
    return F.when(F.rlike(sentence, dialect(sentence, f"{ANY}{V.CLAUSE_END}")), let(parts, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(sentence)))).otherwise(F.array(whole))


def is_negated(sentence: Column) -> Column:
    return F.rlike(sentence, dialect(sentence, ANY + V.NEGATION))


def confidence(target: Column) -> Column:
    """Lower for a text with a hedge word."""
    words = F.regexp_extract_all(F.lower(target), F.lit(r"([a-zA-Z']+)"), F.lit(1))
    return F.when(has_any(target, V.HEDGES) & F.arrays_overlap(words, lits(V.HEDGES)), F.lit(V.HEDGED)).otherwise(F.lit(V.PLAIN))
