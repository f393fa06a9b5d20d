"""JSON inside pages and payloads as variants: dotted paths with ``*``, walks through all levels, key skeletons.

Damaged JSON gives nothing, text by text. Members of an object come in the order of their names. All are column expressions
over array<variant>: a step replaces each value by its children, and a walk repeats that until no value has any.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.html import let

_NONE = "array<variant>"
#: Fixed value: how many keys of a payload's shape are shown.
MAX_SHAPE_KEYS = 64


def ld_texts(nodes: Column) -> Column:
    """The texts of a page's JSON-LD scripts, in document order."""
    typed = lambda n: (n["tag"] == "script") & F.contains(F.lower(F.coalesce(n["attrs"]["type"], F.lit(""))), F.lit("ld+json"))
    scripts = lambda s: F.filter(nodes, lambda t: (t["tag"] == "#text") & F.array_contains(s, t["parent"]))
    return let(F.transform(F.filter(nodes, typed), lambda n: n["pre"]), lambda s: F.transform(scripts(s), lambda t: t["text"]))


def strict(text: Column) -> Column:
    """The variant of a JSON text, null for any other.

    The parser alone lets pass what stands behind a whole value. Within brackets that ends too early, or makes more members
    than one, unless it begins with such a bracket itself; then it does within braces.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", _NONE)
    named = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when(named.isNotNull() & (F.size(listed) == 1), F.get(listed, F.lit(0)))


def parsed(texts: Column) -> Column:
    """array<variant> of the texts that are JSON."""
    return F.filter(F.transform(texts, lambda t: strict(t)), lambda v: v.isNotNull())


def _as(value: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(value, path, kind)


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def is_array(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def children(value: Column) -> Column:
    """array<variant>: an object's or array's members; none of anything else."""
    members = F.when(is_object(value), F.map_values(_as(value, "map<string,variant>"))).when(is_array(value), _as(value, _NONE))
    return F.coalesce(members, F.array().cast(_NONE))


def _quoted(name: str) -> str:
    if '"' in name and "'" in name:
        raise ValueError(f"a path's step has both kinds of quotes: {name}")
    return f"$['{name}']" if "'" not in name else f'$["{name}"]'


def path_values(values: Column, path: str) -> Column:
    """What a dotted path leads to from each of the values; ``*`` goes to all members, a number into an array or to that name."""
    for step in (s for s in path.removeprefix("$").removeprefix(".").split(".") if s):
        if step == "*":
            values = F.flatten(F.transform(values, children))
        else:
            values = F.filter(F.transform(values, _member(step)), lambda v: v.isNotNull())
    return values


def _member(step: str):
    """Of a value its member of that name, or at that place."""
    named = _quoted(step)

    def taken(v):
        found = F.when(is_object(v), _as(v, "variant", named))
        return found.when(is_array(v), _as(v, "variant", f"$[{int(step)}]")) if step.isdigit() else found

    return taken


def as_text(value: Column) -> Column:
    """A text as it is, everything else as JSON."""
    return F.when(is_text(value), _as(value, "string")).otherwise(F.to_json(value))


def _levels(text: Column) -> Column:
    """As many steps as the brackets of a text allow levels."""
    return F.sequence(F.lit(0), F.length(text) - F.length(F.translate(text, "[{", "")))


def walk(values: Column, texts: Column) -> Column:
    """All objects at any level within the values, those further out first; ``texts`` are what they were parsed from."""
    start = F.struct(values.alias("level"), F.array().cast(_NONE).alias("found"))

    def deeper(s, _):
        more = F.struct(F.flatten(F.transform(s["level"], children)).alias("level"), F.concat(s["found"], F.filter(s["level"], is_object)).alias("found"))
        return F.when(F.size(s["level"]) == 0, s).otherwise(more)

    return F.aggregate(_levels(F.array_join(texts, " ")), start, deeper, lambda s: s["found"])


def ld_types(nodes: Column) -> Column:
    """The distinct ``@type`` names of a page's structured data, sorted."""

    def types(v):
        t = _as(v, "variant", _quoted("@type"))
        return F.transform(F.filter(F.when(is_array(t), _as(t, _NONE)).otherwise(F.array(t)), lambda x: x.isNotNull() & is_text(x)), lambda x: _as(x, "string"))

    def of(texts):
        objects = walk(parsed(texts), texts)
        return F.array_sort(F.array_distinct(F.flatten(F.transform(objects, lambda v: F.coalesce(types(v), F.array().cast("array<string>"))))))

    return let(ld_texts(nodes), lambda texts: F.when(F.size(texts) == 0, F.array().cast("array<string>")).otherwise(of(texts)))


def json_keys(payload: Column) -> Column:
    """Sorted dotted paths of a JSON text; a list is ``[]`` over all its members. Null for damaged JSON."""
    start = F.struct(F.array(F.struct(F.lit("").alias("at"), strict(payload).alias("v"))).alias("level"), F.array().cast("array<string>").alias("keys"))
    below = "array<struct<at:string,v:variant>>"

    def members(e):
        named = F.transform(F.map_entries(_as(e["v"], "map<string,variant>")), lambda m: F.struct(F.when(e["at"] == "", m["key"]).otherwise(F.concat(e["at"], F.lit("."), m["key"])).alias("at"), m["value"].alias("v")))
        listed = F.transform(_as(e["v"], _NONE), lambda m: F.struct(F.concat(e["at"], F.lit("[]")).alias("at"), m.alias("v")))
        return F.coalesce(F.when(is_object(e["v"]), named).when(is_array(e["v"]), listed), F.array().cast(below))

    def own(e):
        names = F.when(is_object(e["v"]), F.transform(F.map_keys(_as(e["v"], "map<string,variant>")), lambda k: F.when(e["at"] == "", k).otherwise(F.concat(e["at"], F.lit("."), k))))
        return F.coalesce(names.when(is_array(e["v"]), F.array(F.concat(e["at"], F.lit("[]")))), F.array().cast("array<string>"))

    def deeper(s, _):
        more = F.struct(F.flatten(F.transform(s["level"], members)).alias("level"), F.array_distinct(F.concat(s["keys"], F.flatten(F.transform(s["level"], own)))).alias("keys"))
        return F.when(F.size(s["level"]) == 0, s).otherwise(more)

    return F.when(strict(payload).isNotNull(), F.aggregate(_levels(payload), start, deeper, lambda s: F.array_sort(s["keys"])))


def shape_signature(payload: Column) -> Column:
    """struct<digest, keys, truncated> of a JSON text: the digest is over all keys, of which the first ``MAX_SHAPE_KEYS``
    are shown; null if damaged."""
    sign = lambda k: F.when(k.isNotNull(), F.struct(F.substring(F.sha2(F.array_join(k, "\n"), 256), 1, 16).alias("digest"), F.slice(k, 1, MAX_SHAPE_KEYS).alias("keys"), (F.size(k) > MAX_SHAPE_KEYS).alias("truncated")))
    return let(json_keys(payload), sign)
