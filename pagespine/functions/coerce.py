"""Typed field coercion as built-in column expressions. A value that can't be coerced is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_word, ordered_case

# Fixed values.
ZERO_WORDS = ("free", "complimentary", "gratis")
RATING_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
NUMBER_TOKEN = r"((?<![\w.])[+-]?(?:[$€£¥]\s*)?(?:\d{1,3}(?:,\d{3})+|\d+)(?:[.,]\d+)?%?(?![\w.]))"
LIST_DELIMITER = r"\s*[,;]\s*|\s+and\s+"
MAX_CHARS = {"price": 50, "rating": 50, "number": 50, "datetime": 80, "author": 120, "title": 500, "url": 500}
DATE_PREFIXES = ("posted", "published", "updated", "on")
DATE_WORDS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mon|tue|wed|thu|fri|sat|sun"
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy")


def _last_separator_is_comma(x: Column) -> Column:
    return F.instr(F.reverse(x), ",") < F.instr(F.reverse(x), ".")


def _unpoint(x: Column) -> Column:
    """Both separators: the right one is the decimal point."""
    return F.when(_last_separator_is_comma(x), F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(x, F.lit(","), F.lit("")))


def price(text: Column, currency: str | None = None, require_decimals: bool = False) -> Column:
    """The last number; a lone comma is its decimal point. Without digits, a word for free is 0."""
    low = F.lower(F.trim(text))
    last = F.try_element_at(F.regexp_extract_all(low, F.lit(r"(\d+[.,\d]*)"), 1), F.lit(-1))
    plain = F.when(last.contains(".") & last.contains(","), _unpoint(last)).otherwise(F.replace(last, F.lit(","), F.lit(".")))
    number = plain.try_cast("double")
    if currency:
        number = F.when(text.contains(currency), number)
    if require_decimals:
        number = F.when(last.rlike("[.,]"), number)
    free = has_word(low, ZERO_WORDS[0])
    for word in ZERO_WORDS[1:]:
        free = free | has_word(low, word)
    return F.when(last.isNotNull(), number).when(free, F.lit(0.0))


def rating(text: Column, scale: int = 5) -> Column:
    """A number word, else the count of stars, else the first number; null above the scale."""
    raw = F.trim(text)
    low = F.lower(raw)
    stars = F.length(raw) - F.length(F.translate(raw, "★⭐", ""))
    first = F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    words = [(has_word(low, word), F.lit(float(i + 1))) for i, word in enumerate(RATING_WORDS)]
    return ordered_case([*words, (stars > 0, F.when(stars <= scale, stars.cast("double")))], F.when(first <= scale, first))


def number(text: Column, integer: bool = False) -> Column:
    """Exactly one number in the text, commas between groups of three digits as thousands; else null."""
    found = F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), 1)
    bare = F.translate(F.rtrim(F.trim(F.element_at(found, 1)), F.lit("%")), "$€£¥ ", "")
    grouped = bare.rlike(r"^[+-]?\d+(,\d{3})+$")
    plain = F.when(bare.contains(",") & bare.contains("."), _unpoint(bare)).when(grouped, F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    value = F.when(F.size(found) == 1, plain.try_cast("double"))
    return F.when(value == F.floor(value), value.cast("long")) if integer else value


def items(text: Column, delimiter: str = LIST_DELIMITER) -> Column:
    return F.filter(F.transform(F.split(text, delimiter), lambda x: F.trim(x)), lambda x: x != "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def related(entries: Column) -> Column:
    """Lines ``text (href)`` of an array of struct<text, href>."""
    one = lambda e: F.when(F.coalesce(e["href"], F.lit("")) == "", e["text"]).otherwise(F.concat(e["text"], F.lit(" ("), e["href"], F.lit(")")))
    return F.array_join(F.transform(entries, one), "\n")


def iso_date(text: Column) -> Column:
    """An ISO time in UTC of dates in the supported formats, after labels and what stands before a middle dot.

    A date without an offset is taken as UTC, whatever the session's zone. A label that is itself (part of) a date stays.
    """
    tail = F.element_at(F.split(F.trim(text), "·"), -1)
    bare = F.trim(F.regexp_replace(F.trim(tail), rf"(?i)^(?!({DATE_WORDS})[a-z]*\s*:)[A-Za-z ]+:\s*|^({'|'.join(DATE_PREFIXES)})\s+", ""))
    out = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"

    def read(f):
        time = F.try_to_timestamp(bare, F.lit(f))
        return F.date_format(F.to_utc_timestamp(time, F.current_timezone()) if "X" in f else time, out)

    return F.coalesce(*[read(f) for f in DATE_FORMATS])


def issue(kind: str, value: Column, max_chars: int | None = None, others: tuple[Column, ...] = ()) -> Column:
    """What is wrong with the shape of a value of ``kind`` (numeric, url, text), or null; absence is never wrong."""
    size = F.length(value) > max_chars if max_chars is not None else F.lit(False)
    found = F.regexp_extract_all(value, F.lit(NUMBER_TOKEN), 1)
    cases = {
        "numeric": [(~F.trim(value).rlike("[0-9]"), "no number"), (size, "too long"), (F.size(found) != 1, "extra text")],
        "url": [(~(value.startswith("/") | value.startswith("http")), "not a URL"), (size, "too long")],
        "text": [(size, "too long"), *[(F.trim(o) == F.trim(value), "same as another field") for o in others]],
    }[kind]
    out = ordered_case([(F.coalesce(c, F.lit(False)), F.lit(label)) for c, label in cases], F.lit(None).cast("string"))
    return F.when(value.isNotNull() & (F.trim(value) != ""), out)
