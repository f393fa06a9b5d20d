"""Stores that streams add to: counters of replays, and a log of how pages were classified.

A batch writes its own delta in a folder of its number, so a batch that runs again replaces what it wrote and adds once. Reading adds
deltas up in order; compaction folds those up to a batch into one base, which counts as soon as it is written to the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from . import _folder


def scope_key(url: Column, domain: Column, intent: str = "fetch", browser: str = "default") -> Column:
    """What a replay is kept under: a digest of domain, path, the names of the query's keys, intent and browser."""
    route = F.coalesce(F.when(urls.part(url, "path") != "", urls.part(url, "path")), F.lit("/"))
    query = F.coalesce(urls.query_signature(urls.part(url, "query")), F.lit(""))
    profile = F.when(query == "", route).otherwise(F.concat(route, F.lit("?"), query))
    told = F.to_json(F.struct(F.lit(browser).alias("browser"), domain.alias("domain"), F.lit(intent).alias("intent"), profile.alias("profile"), query.alias("query"), route.alias("route")))
    return F.concat(F.lit("scope:v1:"), F.substring(F.sha2(told, 256), 1, 32))


def deltas(rows: DataFrame, keys: list[str], order: str, verified: str) -> DataFrame:
    """keys, replays, failures, verified, tail, last: of each key how often it was replayed, failed and held, the failures since it last
    held, and the largest ``order``. Partial sums: no key's rows are gathered."""
    good = F.coalesce(F.col(verified), F.lit(False))
    held = rows.groupBy(*keys).agg(F.max(F.when(good, F.col(order))).alias("__held"))
    since = ~good & (F.col("__held").isNull() | (F.col(order) > F.col("__held")))
    sums = [F.count(F.lit(1)).alias("replays"), F.count_if(~good).alias("failures"), F.count_if(good).alias("verified"), F.count_if(since).alias("tail"), F.max(order).alias("last")]
    return rows.join(held, keys).groupBy(*keys).agg(*sums)


def added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas of several batches (with their number in ``batch``) added up: failures count anew after the last batch in which the key held."""
    held = parts.filter("verified > 0").groupBy(*keys).agg(F.max("batch").alias("__held"), F.max_by("tail", "batch").alias("__tail"))
    after = F.when(F.col("__held").isNull() | (F.col("batch") > F.col("__held")), F.col("failures")).otherwise(0)
    joined = parts.join(held, keys, "left")
    sums = [F.sum(c).alias(c) for c in ("replays", "failures", "verified")]
    return joined.groupBy(*keys).agg(*sums, (F.coalesce(F.max("__tail"), F.lit(0)) + F.sum(after)).alias("tail"), F.max("last").alias("last"))


def count_replays(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, verified: str) -> StreamingQuery:
    """Counters by key from a stream of replays."""

    def write(batch: DataFrame, batch_id: int) -> None:
        deltas(batch, keys, order, verified).write.mode("overwrite").parquet(f"{path}/delta={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, path: str) -> tuple[list[tuple[int, str]], list[str]]:
    """(batch, folder) of what counts: the newest whole base and the whole deltas after it; and the folders that no longer do."""
    whole = [(name.split("=")[0], int(name.split("=")[1])) for name in _folder(spark, path).names() if "=" in name and "_SUCCESS" in _folder(spark, f"{path}/{name}").names()]
    base = max((n for kind, n in whole if kind == "base"), default=-1)
    live = [(n, f"{path}/{kind}={n}") for kind, n in whole if (kind, n) == ("base", base) or (kind == "delta" and n > base)]
    return sorted(live), [f"{path}/{kind}={n}" for kind, n in whole if n < base or (kind == "delta" and n == base)]


def read_counters(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    live, _ = _parts(spark, path)
    if not live:
        raise FileNotFoundError(f"no counters in {path}")
    parts = None
    for n, folder in live:
        one = spark.read.parquet(folder).withColumn("batch", F.lit(n))
        parts = one if parts is None else parts.unionByName(one)
    return added(parts, keys)


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Fold all whole deltas into one base; what it holds is removed only after it is written."""
    live, _ = _parts(spark, path)
    if len(live) > 1:
        read_counters(spark, path, keys).write.mode("overwrite").parquet(f"{path}/base={live[-1][0]}")
    for folder in _parts(spark, path)[1]:
        _folder(spark, folder).delete()


def log_classes(pages: DataFrame, references: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A log of how each arriving page was classified against stored references, one folder a batch."""
    from ..operators.references import classified

    def write(batch: DataFrame, batch_id: int) -> None:
        classified(batch, references).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
