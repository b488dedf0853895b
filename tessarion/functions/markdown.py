"""Markdown to chunks, as column expressions: no row is exploded and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .phrases import let, strip

LINE_ENDS = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
#: A fence line opens and the next one closes; one that is never closed takes the rest.
FENCED = r"(?ms)^[^\S\n]*(?:```|~~~)[^\n]*(?:\n|\z)(?:.*?^[^\S\n]*(?:```|~~~)[^\n]*(?:\n|\z)|.*\z)"
TABLE_ROW = r"(?m)^[^\S\n]*\|[^\n]*\|[^\S\n]*(?:\n|\z)"
BULLET = r"^\s*(?:[-*+]|\d+\.)\s+"
ITEM = "\x1d"


def strip_noise(content: Column) -> Column:
    """Text without fenced code and table rows, with ``\\n`` as the only line end."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), LINE_ENDS, "\n")
    return F.regexp_replace(F.regexp_replace(text, FENCED, ""), TABLE_ROW, "")


def blocks(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda b: b != "")


def expand_bullets(block: Column) -> Column:
    """The items of a list, each with its continuation lines; a block without bullets as it is."""

    def expanded(lines: Column, first: Column) -> Column:
        def place(line: Column, i: Column) -> Column:
            bullet = F.rlike(line, F.lit(BULLET))
            text = strip(F.when(bullet, F.regexp_replace(line, BULLET, "")).otherwise(line))
            return F.concat(F.when(bullet | (i + 1 < first), F.lit(ITEM)).otherwise(F.lit(" ")), text)

        items = F.split(F.array_join(F.transform(lines, place), ""), ITEM, -1)
        return F.when(first > 0, F.filter(F.transform(items, strip), lambda x: x != "")).otherwise(F.array(block))

    lines = F.filter(F.split(block, "\n", -1), lambda x: F.rlike(x, F.lit(r"\S")))
    first = lambda found: F.array_position(F.transform(found, lambda x: F.rlike(x, F.lit(BULLET))), True)
    return let(lines, lambda found: let(first(found), lambda at: expanded(found, at)))


def chunks(content: Column) -> Column:
    return F.flatten(F.transform(blocks(strip_noise(content)), expand_bullets))


def merge_labels(parts: Column) -> Column:
    """A chunk that ends in a colon takes the next one along; what was taken is not looked at again.

    One character a chunk says what becomes of it: m merges, c was consumed, n neither.
    """

    def mark(done: Column, part: Column) -> Column:
        merges = F.endswith(part, F.lit(":"))
        return F.concat(done, F.when(F.endswith(done, F.lit("m")), "c").when(merges, "m").otherwise("n"))

    def merged(parts: Column, marks: Column) -> Column:
        def take(part: Column, i: Column) -> Column:
            after = F.get(parts, i + 1)
            sign = F.substr(marks, i + 1, F.lit(1))
            text = F.when((sign == "m") & after.isNotNull(), F.concat(part, F.lit("\n"), after)).otherwise(part)
            return F.struct(sign.alias("sign"), text.alias("text"))

        return F.transform(F.filter(F.transform(parts, take), lambda x: x["sign"] != "c"), lambda x: x["text"])

    return let(parts, lambda found: let(F.aggregate(found, F.lit(""), mark), lambda marks: merged(found, marks)))


def observation(text: Column) -> Column:
    """struct(type, text, header) of a merged chunk."""
    is_header = F.startswith(text, F.lit("#"))
    at = F.position(F.lit("\n"), text)
    head = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    header = strip(F.regexp_replace(head, "^#+", ""))
    body = F.when(at > 0, strip(F.substr(text, at + 1))).otherwise(F.lit(""))
    by_header = F.lit("paragraph")
    for words, kind in reversed(V.HEADER_TYPES):
        by_header = F.when(F.rlike(F.lower(header), F.lit(words)), kind).otherwise(by_header)
    plain = F.when(F.startswith(text, F.lit("Reason:")), "reason").when(F.startswith(text, F.lit("Trade-off:")), "tradeoff").otherwise("paragraph")
    return F.struct(
        F.when(is_header & (body == ""), "header").when(is_header, by_header).otherwise(plain).alias("type"),
        F.when(is_header & (body != ""), body).otherwise(text).alias("text"),
        F.when(is_header, header).alias("header"),
    )


def observations(content: Column) -> Column:
    return F.transform(merge_labels(chunks(content)), observation)
