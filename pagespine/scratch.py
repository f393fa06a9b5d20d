"""Tables written between steps: in spark.checkpoint.dir, which the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The shared folder; a local one where none is set and all tasks run in the driver's own process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pagespine-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: what follows reads the table in place of computing it again."""
    path = f"{root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle. What pages are taken apart into has many times the rows that the planner guesses from their
    compressed files; left to it, such a table is broadcast, and the driver can't hold it."""
    return df.hint("shuffle_merge")


def numbered(rows: DataFrame, order: list, out: str) -> DataFrame:
    """Adds the place of each row in ``order``, from 1, without gathering the rows: they are dealt by ranges, sorted and
    written, and a part's places begin behind those of the parts before it."""
    spark = rows.sparkSession
    parts = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = written(parts.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)), "numbered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a part
    starts = F.broadcast(sizes.select("__part", before.alias("__start")))
    return placed.join(starts, "__part").select(*rows.columns, (F.col("__start") + F.col("__at") + 1).alias(out))


def running(rows: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each in ``order``, without one window over them: ranges are summed apart and
    begin with what the ranges before them hold."""
    spark = rows.sparkSession
    parts = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    placed = written(parts.withColumn("__part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a part
    starts = F.broadcast(sums.select("__part", before.alias("__start")))
    own = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__own", own).join(starts, "__part").select(*rows.columns, (F.col("__start") + F.col("__own")).alias(out))
