"""Recipes: contracts and selectors told as JSON, their identity, and a store of contracts by what they say.

A recipe is ``{"contract": {"name", "schema_version", "fields": [{"name", "type", "mode", "required", "default"}]}, "selectors": {domain:
{"root": selector, "fields": {field: {"primary", "fallback", "tertiary", "root"}}}}, "metadata": {...}}`` with selectors as
``{"type", "value", "name", "nth"}``. What it says is driver-side and small; what it is applied to is a DataFrame.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract import Contract, Field
from .selectors import LEVELS, Selector

SCHEMA_VERSION = 1
RECIPE_PREFIX = "sha256:"
SLOTS = ("primary", "fallback", "tertiary")
# What tells where a recipe is from, and so isn't part of what it is.
PROVENANCE = {"top": ("recipe_id", "instructions"), "metadata": ("created_at", "created_by", "notes"), "selectors": ("discovered_at", "last_verified_at", "last_failed_at", "updated_at", "failure_count", "url")}


def canonical(value: object) -> str:
    """JSON with sorted names and no blanks; lists keep their order."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _without(value: object, names: tuple[str, ...]) -> object:
    if isinstance(value, dict):
        return {k: _without(v, names) for k, v in value.items() if k not in names}
    return [_without(v, names) for v in value] if isinstance(value, list) else value


def recipe_id(recipe: dict) -> str:
    """A digest of what the recipe says: equal for recipes that differ in provenance or the order of names only."""
    said = {k: v for k, v in recipe.items() if k not in PROVENANCE["top"]}
    if isinstance(said.get("metadata"), dict):
        said["metadata"] = {k: v for k, v in said["metadata"].items() if k not in PROVENANCE["metadata"]}
    if "selectors" in said:
        said["selectors"] = _without(said["selectors"], PROVENANCE["selectors"])
    return RECIPE_PREFIX + hashlib.sha256(canonical(said).encode()).hexdigest()


def loaded(text: str) -> dict:
    """A recipe from JSON, with its id; an id that it states has to be its own."""
    recipe = json.loads(text)
    own = recipe_id(recipe)
    if recipe.get("recipe_id") not in (None, "", own):
        raise ValueError(f"the recipe states the id {recipe['recipe_id']}, and is {own}")
    return recipe | {"recipe_id": own}


def selector(told: dict | str | None) -> Selector | None:
    """A selector; a bare text is CSS, or XPath if it begins with a slash. ``NA`` and nothing are none."""
    if not told or told == "NA":
        return None
    if isinstance(told, str):
        return Selector(told, "xpath" if told.startswith("/") else "css")
    kind = told.get("type", "css")
    if kind not in LEVELS:
        raise ValueError(f"no such kind of selector: {kind!r}")
    return None if told.get("value", "NA") == "NA" else Selector(told["value"], kind, told.get("name"), told.get("nth"))


def root_fingerprint(told: dict | str) -> str:
    """16 hex digits of a root's selector, however it is written."""
    s = selector(told)
    return hashlib.sha256(canonical({"type": s.kind, "value": s.value, "name": s.name, "nth": s.nth} if s else repr(told)).encode()).hexdigest()[:16]


def selectors_for(recipe: dict, domain: str) -> dict | None:
    """The selectors of a domain, or else of the domain above it."""
    known = recipe.get("selectors", {})
    return known.get(domain) or known.get(domain.partition(".")[2] or domain)


def to_contract(recipe: dict, domain: str, overrides: dict | None = None) -> Contract:
    """The contract with the selectors of a domain; ``overrides`` (field to selector) come first in their cascade. A field that is
    ``frozen`` keeps only its own. A field without selectors finds nothing."""
    found = selectors_for(recipe, domain) or {}
    fields = []
    for f in recipe["contract"]["fields"]:
        told = found.get("fields", {}).get(f["name"], {})
        cascade = [s for slot in SLOTS if (s := selector(told.get(slot)))]
        own = selector((overrides or {}).get(f["name"]) or f.get("selector"))
        if own:
            cascade = [own] if f.get("frozen") else [own, *(s for s in cascade if s != own)]
        fields.append(Field(f["name"], tuple(cascade[:3]), f.get("type", "text"), f.get("mode", "first"), selector(told.get("root")), bool(f.get("required")), f.get("default")))
    return Contract(recipe["contract"]["name"], tuple(fields), selector(found.get("root")))


def lint(contract: dict) -> list[str]:
    """What is wrong with a contract's own JSON."""
    version, names = contract.get("schema_version", SCHEMA_VERSION), [f.get("name") for f in contract.get("fields", [])]
    out = [f"schema_version {version} is newer than {SCHEMA_VERSION}"] if version > SCHEMA_VERSION else [f"schema_version {version} is less than 1"] if version < 1 else []
    out += ["no fields"] if not names else []
    return out + [f"field {n!r} stands {names.count(n)} times" for n in dict.fromkeys(names) if names.count(n) > 1]


class Collision(ValueError):
    """An alias that stands for another contract already."""


@dataclass(frozen=True)
class ContractStore:
    """Contracts by a digest of what they say, and by alias: two tables that are only added to, in a folder that all share."""

    spark: SparkSession
    path: str

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def specs(self) -> DataFrame:
        return self._table("specs", "fingerprint string, spec string")

    def aliases(self) -> DataFrame:
        return self._table("aliases", "alias string, fingerprint string")

    def add(self, contract: dict, alias: str | None = None) -> str:
        """The contract's fingerprint; stored once. An alias never changes what it stands for."""
        if wrong := lint(contract):
            raise ValueError("; ".join(wrong))
        said, alias = canonical(contract), alias or contract["name"]
        fingerprint = hashlib.sha256(said.encode()).hexdigest()[:16]
        known = self.aliases().filter(F.col("alias") == alias).first()
        if known and known["fingerprint"] != fingerprint:
            raise Collision(f"{alias!r} stands for {known['fingerprint']}, not {fingerprint}")
        if not self.specs().filter(F.col("fingerprint") == fingerprint).take(1):
            self.spark.createDataFrame([(fingerprint, said)], "fingerprint string, spec string").write.mode("append").parquet(f"{self.path}/specs")
        if not known:
            self.spark.createDataFrame([(alias, fingerprint)], "alias string, fingerprint string").write.mode("append").parquet(f"{self.path}/aliases")
        return fingerprint

    def get(self, name: str) -> dict:
        """By alias or fingerprint."""
        known = self.aliases().filter(F.col("alias") == name).first()
        row = self.specs().filter(F.col("fingerprint") == (known["fingerprint"] if known else name)).first()
        if row is None:
            raise KeyError(f"no contract {name!r}")
        return json.loads(row["spec"])
