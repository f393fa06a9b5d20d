"""Streams: records from arriving page files, URLs seen before, and tables kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..plans.contract import Contract, extract, typed


def pages(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Pages of Parquet files as they arrive; what isn't read yet waits in the folder."""
    schema = "page_id long, url string, html string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def unseen(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """One row of each canonical URL within ``delay`` of event time; older state is dropped by the watermark."""
    keyed = stream.withColumn("canonical", urls.canonical(F.col("url")))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["canonical"])


def write_records(stream: DataFrame, contract: Contract, path: str, checkpoint: str) -> StreamingQuery:
    """Extracts each batch of pages to typed records and writes them as one folder a batch, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        typed(extract(batch, contract), contract).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, "__last.*")


BUCKETS = 64


def keep_newest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """A table of the newest row of each key, in ``buckets`` by a hash of the key; ``read_newest`` reads it.

    A batch rewrites only the buckets of its keys, as ``path/v=N/bucket=B`` with N the batch's number: it merges each with
    the largest version before its own, so running it again gives the same version. Of versions before that, its buckets
    are removed.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = {r["bucket"] for r in own.select("bucket").distinct().collect()}  # at most ``buckets``
            before = {b: [v for v in found if v < batch_id] for b, found in _versions(spark, path).items() if b in touched}
            rows = own
            for b, found in before.items():
                if found:
                    rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v={max(found)}/bucket={b}").withColumn("bucket", F.lit(b)))
            newest(rows, ["bucket", *keys], order).select(*own.columns).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch_id}")
            for b, found in before.items():
                for v in sorted(found)[:-1]:
                    _folder(spark, f"{path}/v={v}/bucket={b}").delete()
        finally:
            own.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _folder:
    """A folder in whatever store Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.store = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.store.listStatus(self.path)] if self.store.exists(self.path) else []

    def delete(self) -> None:
        self.store.delete(self.path, True)


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Of each bucket its versions, of those that were written to the end."""
    out: dict[int, list[int]] = {}
    for name in _folder(spark, path).names():
        inside = _folder(spark, f"{path}/{name}").names() if name.startswith("v=") else []
        for b in inside if "_SUCCESS" in inside else ():
            if b.startswith("bucket="):
                out.setdefault(int(b[7:]), []).append(int(name[2:]))
    return out


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``keep_newest`` keeps: of each bucket its largest version."""
    return spark.read.parquet(*[f"{path}/v={max(found)}/bucket={b}" for b, found in sorted(_versions(spark, path).items())])
