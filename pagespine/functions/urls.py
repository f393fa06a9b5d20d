"""URL functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ordered_case

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*?))?\s*$"

# Query parameters that only track; the first by prefix, the others by name.
TRACKING_PREFIX = "utm_"
TRACKING_NAMES = ("fbclid", "gclid", "_gl", "ref")
# Default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443"}
# Segments and texts that stand for an id, pagination, or content.
PATH_ID = r"(?i)^(?:\d+|[0-9a-f]{8,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[a-z0-9_-]*\d[a-z0-9_-]*)$"
ROUTE_ID = r"(?i)^(?:[0-9]+|[0-9a-f]{8,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$"
ENDPOINT_ID = r"(?i)^(?:[0-9]+|[0-9a-f]{8,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|:redacted)$"
PAGINATION = r"(?i)\b(next|older|more|load more|page\s+\d+)\b|[>»]"
CONTENT_HINT = r"(?i)\b(article|story|post|news|detail|item|product|profile)\b"


def part(url: Column, name: str) -> Column:
    """scheme, host, port, path, query or fragment; empty if the URL has none or isn't one."""
    group = ("scheme", "host", "port", "path", "query", "fragment").index(name) + 1
    return F.regexp_extract(url, _URL, group)


def domain(url: Column) -> Column:
    """The host in lower case without a leading ``www.``; ``unknown`` without a host."""
    host = F.lower(part(url, "host"))
    bare = F.when(host.startswith("www.") & (F.length(host) > 4), F.substring(host, 5, 1 << 20)).otherwise(host)
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit("unknown")).otherwise(bare)


def registered_domain(host: Column) -> Column:
    """The last two labels."""
    labels = F.filter(F.split(F.lower(host), r"\."), lambda x: x != "")
    return F.when(F.size(labels) <= 2, F.lower(host)).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def subdomain(host: Column) -> Column:
    """The labels before the registered domain, or an empty string."""
    labels = F.filter(F.split(F.lower(host), r"\."), lambda x: x != "")
    return F.when(F.size(labels) <= 2, F.lit("")).otherwise(F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 2), "."))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def query_pairs(query: Column) -> Column:
    """array<struct<name, value>> of decoded pairs in order; a name without ``=`` has an empty value."""
    pieces = F.filter(F.split(query, "&"), lambda x: x != "")

    def pair(x: Column) -> Column:
        name = F.substring_index(x, "=", 1)
        rest = F.when(x.contains("="), F.substring(x, F.length(name) + 2, F.lit(1 << 20))).otherwise(F.lit(""))
        return F.struct(_decode(name).alias("name"), _decode(rest).alias("value"))

    return F.transform(pieces, pair)


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _quote(x: Column, safe: str = "") -> Column:
    """Percent-encodes all but letters, digits, ``_.-~`` and ``safe``; a blank becomes ``+`` unless % is safe."""
    out = F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    if "%" in safe:
        out = F.replace(out, F.lit("+"), F.lit("%20"))
    for c in safe:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def canonical(url: Column) -> Column:
    """For crawl identity: http(s) only; lower-case host; no default port, user, fragment; tidy path; sorted query."""
    scheme, host, port, path, query = (part(url, x) for x in ("scheme", "host", "port", "path", "query"))
    scheme, host = F.lower(scheme), F.lower(host)
    default = ordered_case([(scheme == k, F.lit(v)) for k, v in DEFAULT_PORTS.items()], F.lit(""))
    where = F.when((port == "") | (port == default), host).otherwise(F.concat(host, F.lit(":"), port.cast("int").cast("string")))
    kept = F.aggregate(
        F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    tidy = F.concat(F.lit("/"), F.array_join(F.transform(kept, lambda x: _quote(x, "%:@")), "/"))
    tidy = F.when(path.endswith("/") & (tidy != "/"), F.concat(tidy, F.lit("/"))).otherwise(tidy)
    pairs = F.transform(F.array_sort(query_pairs(query)), lambda p: F.concat(_quote(p["name"]), F.lit("="), _quote(p["value"])))
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), where, tidy, tail))


def clean(url: Column, require_https: bool = True, strip_tracking: bool = True, page: Column | None = None) -> Column:
    """A field's URL: https, without tracking parameters, a path joined to its page's site; null for a ``javascript:`` link."""
    raw = F.trim(url)
    if page is not None:
        raw = F.when(raw.startswith("/") & ~raw.startswith("//"), F.concat(F.regexp_extract(page, r"^(https?://[^/?#]+)", 1), raw)).otherwise(raw)
    if require_https:
        raw = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("http://"), F.concat(F.lit("https://"), F.substring(raw, 8, 1 << 20))).otherwise(raw)
    if strip_tracking:
        before, after = F.substring_index(raw, "?", 1), F.regexp_extract(raw, r"\?([^#]*)", 1)
        kept = F.array_join(F.filter(F.split(after, "&"), lambda p: (p != "") & ~is_tracking(p)), "&")
        whole = F.concat(before, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), F.regexp_extract(raw, r"(#.*)$", 1))
        raw = F.when(raw.contains("?") & ~before.contains("#"), whole).otherwise(raw)
    return F.when(~F.lower(F.trim(url)).startswith("javascript:"), raw)


def is_tracking(pair: Column) -> Column:
    name = F.substring_index(pair, "=", 1)
    return name.startswith(TRACKING_PREFIX) | name.isin(*TRACKING_NAMES)


# The path normalisers differ on purpose.


def link_signature(url: Column) -> Column:
    """Segments in lower case with ``{id}`` for ids and ``{slug}`` for a last segment that is long or hyphenated."""
    own = F.transform(segments(part(url, "path")), lambda x: F.lower(F.trim(x)))

    def one(x: Column, i: Column) -> Column:
        suffix = F.regexp_extract(x, r"^.+(\.[^.]+)$", 1)
        stem = F.substring(x, F.lit(1), F.length(x) - F.length(suffix))
        last = i == F.size(own) - 1
        slug = lambda s: last & (s.contains("-") | (F.length(s) >= 16))
        return F.when(x.rlike(PATH_ID), F.lit("{id}")).when((suffix != "") & stem.rlike(PATH_ID), F.concat(F.lit("{id}"), suffix)).when((suffix != "") & slug(stem), F.concat(F.lit("{slug}"), suffix)).when(slug(x), F.lit("{slug}")).otherwise(x)

    return F.array_join(F.transform(own, one), "/")


def path_shape(url: Column) -> Column:
    """The path with ``:id`` for each segment that has a digit."""
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(part(url, "path")), lambda x: F.when(x.rlike("[0-9]"), F.lit(":id")).otherwise(x)), "/"))


def _digit_rich(x: Column) -> Column:
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    return (F.length(x) >= 4) & (digits >= 4) & (digits * 5 >= F.length(x) * 2)


def route_template(url: Column) -> Column:
    """Host and path with ``{id}`` for ids and digit-rich segments."""
    path = part(url, "path")
    own = F.transform(segments(path), lambda x: F.when(x.rlike(ROUTE_ID) | _digit_rich(x), F.lit("{id}")).otherwise(F.lower(x)))
    made = F.concat(F.lit("/"), F.array_join(own, "/"))
    made = F.when(path.endswith("/") & (made != "/"), F.concat(made, F.lit("/"))).otherwise(made)
    port = part(url, "port")
    return F.concat(F.lower(part(url, "host")), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")), made)


def route_signature(url: Column) -> Column:
    """The plain path, or ``/``."""
    path = part(url, "path")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def endpoint_segment(x: Column) -> Column:
    return F.when(x == "", x).when(x.rlike(ENDPOINT_ID) | _digit_rich(x), F.lit("{id}")).otherwise(F.lower(x))


def endpoint(url: Column) -> Column:
    return F.concat(F.lower(part(url, "host")), F.lit("/"), F.array_join(F.transform(segments(part(url, "path")), endpoint_segment), "/"))


def query_signature(query: Column) -> Column:
    """Names of the query's parameters, sorted, ``[]`` after those that repeat."""
    names = F.transform(query_pairs(query), lambda p: p["name"])
    return F.array_join(F.transform(F.array_sort(F.array_distinct(names)), lambda n: F.when(F.size(F.filter(names, lambda m: m == n)) > 1, F.concat(n, F.lit("[]"))).otherwise(n)), ",")


def origin(url: Column) -> Column:
    """Scheme and host without user, final dots and default port (hosts in ASCII)."""
    scheme, host, port = F.lower(part(url, "scheme")), F.lower(F.rtrim(part(url, "host"), F.lit("."))), part(url, "port")
    default = ordered_case([(scheme == k, F.lit(v)) for k, v in DEFAULT_PORTS.items()], F.lit(""))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when((port == "") | (port == default), F.lit("")).otherwise(F.concat(F.lit(":"), port))))


def is_pagination(text: Column) -> Column:
    return text.rlike(PAGINATION)


def link_score(url: Column, text: Column) -> Column:
    """How promising a link is for a crawl."""
    path = part(url, "path")
    hint = F.concat(path, F.lit(" "), text).rlike(CONTENT_HINT)
    return F.when(is_pagination(text), 0.95).when(hint & path.rlike(r"\.html?$"), 0.9).when(hint & (part(url, "query") != ""), 0.85).when(hint, 0.8).otherwise(0.5)


def boosted(score: Column, matches: Column) -> Column:
    """A link's score raised by how many of a target's words it has."""
    return F.when(matches >= 2, F.least(F.lit(1.0), score + 0.40)).when(matches == 1, F.least(F.lit(1.0), score + 0.25)).otherwise(score)
