"""Text functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_case(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    (condition, value), *rest = cases
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def collapse_lines(text: Column) -> Column:
    """Blanks within lines collapsed, empty lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: collapse(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def readable(text: Column) -> Column:
    """Collapsed, without blanks before punctuation."""
    return F.regexp_replace(collapse(text), r"\s+([,.;:!?])", "$1")


def strip_tags(html: Column) -> Column:
    return readable(F.regexp_replace(html, "<[^>]+>", " "))


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256; empty for an empty text."""
    return F.when(text == "", F.lit("")).otherwise(F.substring(F.sha2(text, 256), 1, 16))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def page_count(text: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")


def pages(text: Column, size: int) -> Column:
    """array<struct<page, content, next_page>> of windows of ``size`` characters; pages count from 1."""
    n = page_count(text, size)
    return F.transform(F.sequence(F.lit(1), n), lambda p: F.struct(p.alias("page"), F.substring(text, (p - 1) * size + 1, F.lit(size)).alias("content"), F.when(p < n, p + 1).alias("next_page")))


def word_tokens(text: Column) -> Column:
    """Distinct words and numbers of at least 3 characters from names in any case, sorted, in lower case."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: F.length(x) >= 3)))


def has_word(text: Column, word: str) -> Column:
    """Whether a lower-case text has the whole word; a part is enough for words beyond ASCII."""
    import re

    low = word.lower()
    return text.rlike(rf"(?U)\b{re.escape(low)}\b") if low.isascii() else text.contains(low)


def class_tokens(raw: Column) -> Column:
    """Distinct class tokens without those whose first run of 5 or more hex digits has a digit, sorted."""
    stable = lambda t: ~F.regexp_extract(t, "[0-9a-fA-F]{5,}", 0).rlike("[0-9]")
    return F.array_sort(F.array_distinct(F.filter(F.split(raw, r"\s+"), lambda t: (t != "") & stable(t))))


# Marks of bot protection, by vendor, in the order they are tried.
BOT_VENDORS = (("cloudflare", ("cloudflare",)), ("datadome", ("datadome",)), ("perimeterx", ("perimeterx",)), ("kasada", ("kasada",)), ("akamai", ("akamai",)), ("google", ("recaptcha", "google captcha")), ("hcaptcha", ("hcaptcha",)))


def bot_vendor(text: Column) -> Column:
    low = F.lower(text)
    cases = []
    for vendor, marks in BOT_VENDORS:
        hit = low.contains(marks[0])
        for mark in marks[1:]:
            hit = hit | low.contains(mark)
        cases.append((hit, F.lit(vendor)))
    return ordered_case(cases, F.lit(None).cast("string"))
