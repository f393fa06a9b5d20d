"""What the sinks write: text columns, envelopes, Markdown; and kinds of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the JSONL sink that records can't overwrite; first bytes of kinds of files, in hex.
RESERVED = ("url", "domain", "extracted_at")
MAGIC = (("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("zip", "504B0304"), ("gzip", "1F8B"))


def as_text(df: DataFrame, column: str) -> Column:
    """Nested values as JSON, others as Spark writes them."""
    kind = df.schema[column].dataType.simpleString()
    return F.to_json(F.col(f"`{column}`")) if kind.startswith(("struct", "array", "map")) else F.col(f"`{column}`").cast("string")


def stringified(df: DataFrame, null: str | None = None) -> DataFrame:
    """All columns as strings; nulls stay, or become ``null``."""
    made = [(as_text(df, c), c) for c in df.columns]
    return df.select(*[(F.coalesce(v, F.lit(null)) if null is not None else v).alias(c) for v, c in made])


def append(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Both, columns aligned by name; what one of them lacks is null."""
    return stringified(older).unionByName(stringified(newer), allowMissingColumns=True)


def write(records: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    """Writes records as csv, parquet, jsonl or json (one envelope a row)."""
    if kind == "csv":
        stringified(records, "").write.mode(mode).option("header", True).csv(path)
    elif kind == "parquet":
        stringified(records).write.mode(mode).parquet(path)
    elif kind in ("jsonl", "json"):
        records.write.mode(mode).json(path)
    else:
        raise ValueError(f"no sink for {kind!r}")


def json_rows(records: DataFrame, content: str = "content") -> DataFrame:
    """The fields of ``content`` beside the reserved columns, which win over fields of the same name."""
    own = [c for c in RESERVED if c in records.columns]
    fields = [f for f in records.schema[content].dataType.names if f not in own]
    return records.select(*own, *[F.col(content)[f].alias(f) for f in fields])


def envelopes(records: DataFrame, scope: list[str], order: str, content: str) -> DataFrame:
    """scope and ``envelope``: ``content`` of a single record, else ``items`` in order with their ``item_count``."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))), lambda x: x["c"])
    grouped = records.groupBy(*scope).agg(items.alias("items"), F.count(F.lit(1)).alias("item_count"))
    head = [c for c in scope if c in RESERVED]
    many = F.to_json(F.struct(*head, "items", "item_count"))
    one = F.to_json(F.struct(*head, F.element_at("items", 1).alias("content")))
    return grouped.select(*scope, F.when(F.col("item_count") == 1, one).otherwise(many).alias("envelope"))


def markdown(title: str, fields: list[str]) -> Column:
    """A title, and a section for each field that has a value."""
    parts = [F.concat(F.lit("# "), F.col(title).cast("string"))] + [F.concat(F.lit(f"## {f}\n\n"), F.col(f).cast("string")) for f in fields]
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def file_kind(data: Column) -> Column:
    """By the first bytes, else JSON or HTML by the first character of the text; null if neither tells."""
    start = F.hex(F.substring(data, 1, 16))
    text = F.ltrim(F.try_to_binary(F.base64(F.substring(data, 1, 64)), F.lit("base64")).cast("string"))
    out = None
    for kind, magic in MAGIC:
        out = F.when(start.startswith(magic), kind) if out is None else out.when(start.startswith(magic), kind)
    return out.when(text.rlike(r"^[\[{]"), "json").when(text.rlike(r"(?i)^<(!doctype|html)"), "html")


def is_allowed(kind: Column, allowed: tuple[str, ...]) -> Column:
    """An empty list allows nothing."""
    return F.coalesce(kind.isin(*allowed), F.lit(False)) if allowed else F.lit(False)
