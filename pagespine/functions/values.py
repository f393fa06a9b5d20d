"""Classes of parameter values and path segments, timing buckets, header names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, ordered_case
from .urls import query_pairs, segments

# The classes in the order they are tried, with their patterns.
TIMESTAMP = (r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$", r"^\d{10}$|^\d{13}$")
ID = (r"^\d+$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^(?:[0-9a-fA-F]{2}){4,}$")
SIGNED_TOKEN = r"^[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,})?$"
LONG_TOKEN = r"^[A-Za-z0-9+/_-]{20,}={0,2}$"
ENUM = r"^[A-Za-z][A-Za-z0-9_.-]{0,23}$"
TIMING_BOUNDS = ((50, "instant"), (200, "fast"), (1000, "moderate"), (3000, "slow"))
CREDENTIAL_MARKS = ("authorization", "authenticate", "authentication", "x-auth", "cookie", "token", "api-key", "apikey", "secret", "credential", "password", "signature", "session")


def value_class(value: Column) -> Column:
    """empty, timestamp, id, token, enum or opaque; the first that fits."""
    like = lambda patterns: _any(value.rlike(p) for p in patterns)
    token = value.rlike(SIGNED_TOKEN) | (value.rlike(LONG_TOKEN) & value.rlike("[A-Za-z]") & value.rlike("[0-9]"))
    return ordered_case([(value == "", F.lit("empty")), (like(TIMESTAMP), F.lit("timestamp")), (like(ID), F.lit("id")), (token, F.lit("token")), (value.rlike(ENUM), F.lit("enum"))], F.lit("opaque"))


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def segment_template(segment: Column) -> Column:
    """A placeholder for a segment that is a timestamp, id or token, with its extension; else the segment."""

    def made(decoded, extension, kind):
        told = F.concat(F.lit("{"), kind, F.lit("}"), F.when(extension == "", F.lit("")).otherwise(F.concat(F.lit("."), extension)))
        return F.when(kind.isin("timestamp", "id", "token"), told).otherwise(segment)

    def stem(decoded, extension):
        return F.when(extension == "", decoded).otherwise(F.substring(decoded, F.lit(1), F.length(decoded) - F.length(extension) - 1))

    # each part is computed once: decoded where something is to be decoded, then the extension, then the class
    decoded = F.when(segment.contains("%"), F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)).otherwise(segment)
    return let(decoded, lambda d: let(F.regexp_extract(d, r"\.([A-Za-z0-9]{1,8})$", 1), lambda e: let(value_class(stem(d, e)), lambda k: made(d, e, k))))


def path_template(path: Column) -> Column:
    own = F.transform(segments(path), segment_template)
    return F.when(F.size(own) == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(own, "/"), F.when(path.endswith("/"), F.lit("/")).otherwise(F.lit(""))))


def classed_params(query: Column) -> Column:
    """array<struct<name, value_class>> by name; the first value of a name counts."""
    pairs = F.filter(query_pairs(query), lambda p: p["name"] != "")
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["name"])))
    return F.transform(names, lambda n: F.struct(n.alias("name"), value_class(F.element_at(F.filter(pairs, lambda p: p["name"] == n), 1)["value"]).alias("value_class")))


def timing_bucket(ms: Column) -> Column:
    return F.when(ms.isNull() | (ms < 0), F.lit("unknown")).otherwise(ordered_case([(ms < bound, F.lit(name)) for bound, name in TIMING_BOUNDS], F.lit("very_slow")))


def credential_headers(names: Column) -> Column:
    return F.filter(names, lambda n: _any(n.contains(mark) for mark in CREDENTIAL_MARKS))
