"""URL lists from files and texts, and pages from bytes of unknown encoding."""

from __future__ import annotations

import codecs
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a URL is in free text, and what can't end one.
URL = r"https?://[^\s<>\"]+"
ENDINGS = ".,;:!?)]}'\""


def urls_in_text(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({URL})"), 1), lambda u: F.rtrim(u, F.lit(ENDINGS)))


def urls_in_markdown(text: Column) -> Column:
    """Targets of links in order, then the URLs of the remaining text, each once."""
    link = r"\[[^\]]*\]\((https?://[^)\s]+)[^)]*\)"
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(link), 1), urls_in_text(F.regexp_replace(text, link, " "))))


def urls_in_json(text: str) -> list[str]:
    """URLs of a list of strings or of objects with ``url``, or of an object whose values are such; each once."""
    out: dict[str, None] = {}

    def add(value):
        if isinstance(value, str) and re.fullmatch(URL, value):
            out[value] = None
        elif isinstance(value, list):
            for x in value:
                add(x)
        elif isinstance(value, dict):
            add(value["url"]) if "url" in value else [add(x) for x in value.values() if isinstance(x, (list, dict))]

    add(json.loads(text))
    return list(out)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url, ord of a list in JSON, CSV, Parquet, Markdown or plain text, by the file's extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "parquet"):
        table = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)
        named = [c for c in table.columns if c.lower() == "url"]
        cells = F.array(F.col(f"`{named[0]}`")) if named else urls_in_text(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in table.columns]))
        return table.select(F.explode(cells).alias("url")).filter("url IS NOT NULL").withColumn("ord", F.monotonically_increasing_id())
    whole = spark.read.text(path, wholetext=True)
    if kind == "json":
        return whole.select(F.posexplode(F.udf(urls_in_json, "array<string>", useArrow=False)("value")).alias("ord", "url")).select("url", F.col("ord").cast("long").alias("ord"))
    found = urls_in_markdown(F.col("value")) if kind in ("md", "markdown") else urls_in_text(F.col("value"))
    return whole.select(F.posexplode(found).alias("ord", "url")).select("url", F.col("ord").cast("long").alias("ord"))


_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_META = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def decode(data: bytes | None, header: str | None = None) -> tuple[str | None, str | None]:
    """(text, encoding): by byte order mark, declared charset, the page's own, UTF-8; else Latin-1, told as ``fallback``."""
    if data is None:
        return None, None
    for mark, name in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    found = _META.search(data[:4096])
    for name in (header, found and found[1].decode("ascii"), "utf-8"):
        try:
            return (data.decode(name), codecs.lookup(name).name) if name else 1 / 0
        except (LookupError, UnicodeDecodeError, ZeroDivisionError):
            continue
    return data.decode("latin-1"), "fallback"


def decoded(files: DataFrame, content: str = "content", charset: str | None = None) -> DataFrame:
    """``files`` (as from the binaryFile source) with html and encoding."""

    @F.arrow_udf("struct<html: string, encoding: string>")
    def read(data: pa.Array, headers: pa.Array) -> pa.Array:
        done = [decode(d, h) for d, h in zip(data.to_pylist(), headers.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=["html", "encoding"])

    header = F.col(charset) if charset else F.lit(None).cast("string")
    return files.withColumn("__d", read(F.col(content), header)).select("*", "__d.html", "__d.encoding").drop("__d")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSONL store, and the lines that couldn't be read, which are told rather than lost."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("r._bad IS NULL").select("r.*").drop("_bad"), parsed.filter("r._bad IS NOT NULL").select("value")
