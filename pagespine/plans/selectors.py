"""Selectors as column expressions over a page's nodes.

CSS: lists of selectors with commas; steps of tag, ``.class``, ``#id``, ``[attr]``, ``[attr=value]`` and with ``^=``, ``$=``,
``*=`` or ``~=``; ``:first-child``, ``:last-child``, ``:only-child``, ``:first-of-type``, ``:nth-child(n)``, ``:nth-last-child(n)`` and
``:nth-of-type(n)`` (also ``odd``, ``even``, ``an+b``), ``:empty``, ``:root``, ``:link``, ``:checked``, ``:disabled``, ``:enabled``, ``:not(...)`` and
``:is(...)`` of simple ones; joined by blanks, ``>``, ``+`` or ``~``; then ``::text`` or ``::attr(name)``. XPath: ``//tag``, ``/tag``, ``[@attr]``,
``[@attr='value']``, ``[contains(@attr, 'x')]``, ``[contains(text(), 'x')]`` or of ``.``, ``[n]``, ``[last()]``, then ``/text()``
or ``/@name``. Other kinds of selector find nothing; a valid selector
that isn't compiled here raises ``Unsupported``, what can't be read another ``ValueError``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.html import below, has_class, let, node_text, subtree

_STEP = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)?(?P<rest>(?:\.[\w-]+|#[\w-]+|\[[^\]]+\]|:[\w-]+(?:\([^()]*\))?)*)")
_PART = re.compile(r"\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[\s*@?(?P<attr>[\w:-]+)\s*(?:(?P<op>[\^$*~]?=)\s*['\"]?(?P<value>[^'\"\]]*)['\"]?\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<of>[^()]*)\))?")
_TOKEN = re.compile(r"(?:\[[^\]]*\]|\([^()]*\)|[^\s>+~\[(])+|[>+~]")
_HOW = {">": "child", "+": "next", "~": "later"}
# What has a role without saying so.
ROLE_SELECTORS = {
    "button": ("button", 'input[type="button"]', 'input[type="submit"]'), "link": ("a[href]",), "textbox": ("input:not([type])", 'input[type="text"]', "textarea"),
    "searchbox": ('input[type="search"]',), "heading": ("h1", "h2", "h3", "h4", "h5", "h6"), "article": ("article",), "main": ("main",), "navigation": ("nav",),
    "list": ("ul", "ol"), "listitem": ("li",), "table": ("table",), "row": ("tr",), "cell": ("td", "th"), "img": ("img",),
}
LEVELS = {"css": 1, "xpath": 2, "regex": 3, "jsonld": 4, "attr": 5, "global_id": 6, "role": 7, "visual": 8}


@dataclass(frozen=True)
class Selector:
    value: str
    kind: str = "css"
    name: str | None = None
    nth: int | None = None


@dataclass(frozen=True)
class Compiled:
    """Alternatives of steps of (how, predicate) and what to take: the node's text, own texts, or an attribute."""

    alternatives: tuple
    take: str
    attribute: str | None = None

    def nodes(self, nodes: Column, within: Column | None = None) -> Column:
        scope = nodes if within is None else F.slice(subtree(nodes, within), F.lit(2), F.greatest(within["last"] - within["pre"], F.lit(0)))

        def any_of(own):
            found = [self._steps(own, F.filter(own, steps[0][1]), steps, 1) for steps in self.alternatives]
            if len(found) == 1:
                return found[0]
            places = F.flatten(F.array(*[F.transform(f, lambda n: n["pre"]) for f in found]))
            return let(places, lambda p: F.filter(own, lambda n: F.array_contains(p, n["pre"])))

        return let(scope, any_of)

    def _steps(self, scope: Column, found: Column, steps: tuple, i: int) -> Column:
        if i == len(steps):
            return found
        how, test = steps[i]
        related = {
            "child": lambda n, a: n["parent"] == a["pre"],
            "below": lambda n, a: below(n, a),
            "next": lambda n, a: (n["parent"] == a["parent"]) & (n["nth"] == a["nth"] + 1),
            "later": lambda n, a: (n["parent"] == a["parent"]) & (n["nth"] > a["nth"]),
        }[how]
        return let(found, lambda b: self._steps(scope, F.filter(scope, lambda n: test(n) & F.exists(b, lambda a: related(n, a))), steps, i + 1))

    def values(self, nodes: Column, within: Column | None = None) -> Column:
        """What the selector yields, in document order."""
        found = self.nodes(nodes, within)
        if self.take == "attr":
            return F.filter(F.transform(found, lambda n: n["attrs"][self.attribute]), lambda v: v.isNotNull())
        if self.take == "own":
            own = lambda n: F.filter(subtree(nodes, n), lambda t: (t["tag"] == "#text") & (t["parent"] == n["pre"]))
            return F.flatten(F.transform(found, lambda n: F.transform(own(n), lambda t: t["text"])))
        return F.transform(found, lambda n: node_text(nodes, n))


class Unsupported(ValueError):
    """A selector that is valid, but outside what is compiled here."""


def _nth(text: str, place=lambda n: n["nth"]):
    """Whether an element has one of the places that ``text`` gives; ``place`` counts from 1."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip(), text.replace(" ", ""))
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not m or not text:
        raise ValueError(f"no place: {text!r}")
    step = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    first = int(m[2] or 0)
    if step == 0:
        return lambda n: (n["nth"] > 0) & (place(n) == first)
    return lambda n: (n["nth"] > 0) & ((place(n) - first) % step == 0) & (((place(n) - first) / step) >= 0)


# Pseudo-classes by what they say of an element alone; those that take places, with what is counted; those that are valid, but
# say something of other elements, or of what a visitor does.
_ALONE = {
    "first-child": lambda n: n["nth"] == 1, "last-child": lambda n: (n["nth"] > 0) & (n["after"] == 0), "only-child": lambda n: (n["nth"] == 1) & (n["after"] == 0), "first-of-type": lambda n: n["same"] == 1,
    "empty": lambda n: n["last"] == n["pre"], "root": lambda n: (n["parent"] < 0) & (n["tag"] != "#text"), "link": lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull(),
    "checked": lambda n: ((n["tag"] == "input") & n["attrs"]["checked"].isNotNull()) | ((n["tag"] == "option") & n["attrs"]["selected"].isNotNull()),
    "disabled": lambda n: n["tag"].isin("button", "input", "select", "textarea", "option", "optgroup", "fieldset") & n["attrs"]["disabled"].isNotNull(),
    "enabled": lambda n: n["tag"].isin("button", "input", "select", "textarea", "option", "optgroup", "fieldset") & n["attrs"]["disabled"].isNull(),
}
_PLACED = {"nth-child": lambda n: n["nth"], "nth-last-child": lambda n: n["after"] + 1, "nth-of-type": lambda n: n["same"]}
_VALID = ("last-of-type", "only-of-type", "nth-last-of-type", "has", "lang", "hover", "active", "focus", "visited", "target", "contains", "scope", "indeterminate", "required", "optional", "any-link", "read-only", "read-write", "focus-within", "focus-visible", "placeholder-shown", "default", "valid", "invalid", "in-range", "out-of-range", "dir")


def _pseudo(name: str, of: str | None):
    if name in _ALONE and of is None:
        return lambda n: F.coalesce(_ALONE[name](n), F.lit(False))
    if name in _PLACED and of:
        return _nth(of, _PLACED[name])
    if name in ("not", "is", "where", "matches") and of:
        found = [m if (m := _STEP.fullmatch(x.strip())) and x.strip() else None for x in of.split(",")]
        if None in found:
            raise Unsupported(f"no simple selectors: {of!r}")
        inner = [_test(m["tag"], m["rest"]) for m in found]
        any_ = lambda n: reduce(lambda a, b: a | b, [F.coalesce(t(n), F.lit(False)) for t in inner])
        return (lambda n: ~any_(n) & (n["tag"] != "#text")) if name == "not" else any_
    if name in _VALID:
        raise Unsupported(f"pseudo-class: {name!r}")
    raise ValueError(f"no pseudo-class: {name!r}")


def _test(tag: str | None, parts: str, more=()):
    wanted = [m.groupdict() for m in _PART.finditer(parts)]
    pseudo = [_pseudo(w["pseudo"], w["of"]) for w in wanted if w["pseudo"]]

    def attribute(n: Column, w: dict) -> Column:
        value = n["attrs"][w["attr"]]
        if w["value"] is None:
            return value.isNotNull()
        own = w["value"].strip()
        hit = {"=": value == own, "^=": value.startswith(own), "$=": value.endswith(own), "*=": value.contains(own), "~=": F.array_contains(F.split(value, r"\s+"), own)}[w["op"]]
        return F.coalesce(hit, F.lit(False)) & F.lit(bool(own) or w["op"] == "=")

    def test(n: Column) -> Column:
        out = n["tag"] == tag.lower() if tag and tag != "*" else n["tag"] != "#text"
        for w in wanted:
            if w["cls"]:
                out = out & has_class(n, w["cls"])
            elif w["id"]:
                out = out & F.coalesce(n["attrs"]["id"] == w["id"], F.lit(False))
            elif w["attr"]:
                out = out & attribute(n, w)
        for p in (*pseudo, *more):
            out = out & p(n)
        return out

    return test


def _alternatives(text: str) -> list[str]:
    """The parts between commas that stand in no brackets."""
    parts, depth = [""], 0
    for c in text:
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def css(text: str) -> Compiled:
    alternatives, take, attribute = [], "text", None
    tidy = re.sub(r"\(([^()]*)\)", lambda m: "(" + re.sub(r"\s*,\s*", ",", m[1].strip()) + ")", text)
    for one in _alternatives(tidy):
        body, _, pseudo = one.strip().partition("::")
        if pseudo:
            take, attribute = ("own", None) if pseudo == "text" else ("attr", pseudo[5:-1])
            if pseudo != "text" and not re.fullmatch(r"attr\([\w:-]+\)", pseudo):
                raise ValueError(f"unsupported selector: {text!r}")
        steps, how = [], "below"
        for token in _TOKEN.findall(body):
            if token in _HOW:
                how = _HOW[token]
                continue
            m = _STEP.fullmatch(token)
            if not m:
                raise ValueError(f"unsupported selector: {text!r}")
            steps.append((how, _test(m["tag"], m["rest"])))
            how = "below"
        if not steps or how != "below" or "".join(_TOKEN.findall(body)) != re.sub(r"\s+(?![^\[(]*[\])])", "", body):
            raise ValueError(f"unsupported selector: {text!r}")
        alternatives.append(tuple(steps))
    return Compiled(tuple(alternatives), take, attribute)


_X_STEP = re.compile(r"(//?)([\w*-]+)((?:\[[^\]]*\])*)")
_X_CONTAINS = re.compile(r"contains\(\s*(@[\w:-]+|text\(\)|\.)\s*,\s*(?:'([^']*)'|\"([^\"]*)\")\s*\)")


def xpath(text: str) -> Compiled:
    take, attribute, body = "text", None, text.strip().lstrip(".")
    if body.endswith("/text()"):
        take, body = "own", body[:-7]
    elif m := re.search(r"/@([\w:-]+)$", body):
        take, attribute, body = "attr", m[1], body[: m.start()]
    steps = []
    for slash, tag, parts in _X_STEP.findall(body):
        plain, more = "", []
        for p in re.findall(r"\[([^\]]*)\]", parts):
            p, place = p.strip(), "nth" if tag == "*" else "same"
            if p.isdigit():
                more.append(lambda n, k=int(p), c=place: n[c] == k)
            elif p == "last()" and tag == "*":
                more.append(lambda n: (n["nth"] > 0) & (n["after"] == 0))
            elif m := _X_CONTAINS.fullmatch(p):
                more.append(_holds(m[1], m[2] if m[2] is not None else m[3]))
            elif p.startswith("@"):
                plain += f"[{p}]"
            else:
                raise ValueError(f"unsupported selector: {text!r}")
        steps.append(("child" if slash == "/" else "below", _test(tag, plain, more)))
    if not steps or "".join("".join(x) for x in _X_STEP.findall(body)) != body:
        raise ValueError(f"unsupported selector: {text!r}")
    return Compiled((tuple(steps),), take, attribute)


#: The whole page's nodes, by the name that ``with_nodes`` gives them, for tests that look at a node's texts.
PAGE_NODES = "nodes"


def _holds(what: str, part: str):
    def test(n: Column) -> Column:
        if what.startswith("@"):
            return F.coalesce(n["attrs"][what[1:]].contains(part), F.lit(False))
        inside = subtree(F.col(PAGE_NODES), n)
        own = F.filter(inside, lambda t: (t["tag"] == "#text") & ((t["parent"] == n["pre"]) if what == "text()" else F.lit(True)))
        texts = F.transform(own, lambda t: t["text"])
        return F.exists(texts, lambda t: t.contains(part)) if what == "text()" else F.array_join(texts, "").contains(part)

    return test


def values(selector: Selector, nodes: Column, within: Column | None = None, max_level: int = 8) -> Column:
    """What one selector yields; nothing for kinds that need more than the page, or that are above ``max_level``."""
    none = F.array().cast("array<string>")
    if selector.value == "NA" or LEVELS[selector.kind] > max_level:
        return none
    if selector.kind == "css":
        return css(selector.value).values(nodes, within)
    if selector.kind == "xpath":
        return xpath(selector.value).values(nodes, within)
    if selector.kind == "attr":
        return css(f"{selector.value}::attr({selector.name})").values(nodes, within)
    if selector.kind == "role":
        return _by_role(selector, nodes, within)
    return none


def _followed_by(found: Column, more: Column) -> Column:
    return let(found, lambda f: F.concat(f, F.filter(more, lambda n: ~F.exists(f, lambda a: a["pre"] == n["pre"]))))


def _by_role(selector: Selector, nodes: Column, within: Column | None) -> Column:
    role = selector.value.strip().lower()
    tests = [f'[role="{role}"]', *ROLE_SELECTORS.get(role, ())]
    # each alternative's matches follow those of the alternatives before it; a node counts once
    found = css(tests[0]).nodes(nodes, within)
    for t in tests[1:]:
        found = _followed_by(found, css(t).nodes(nodes, within))
    if selector.name:
        label = lambda n: F.coalesce(*[F.when(n["attrs"][a] != "", n["attrs"][a]) for a in ("aria-label", "alt", "title", "value")], node_text(nodes, n))
        found = F.filter(found, lambda n: F.lower(label(n)).contains(selector.name.lower()))
    if selector.nth is not None:
        found = F.slice(found, selector.nth + 1, 1)
    return F.transform(found, lambda n: node_text(nodes, n))
