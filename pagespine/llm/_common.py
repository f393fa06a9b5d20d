"""Helpers shared by the corpus operators: scratch tables, files in the shared folder, bounded memos."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
WORD_SPACE = " \t\n\x0b\x0c\r"
#: Rows that functions over Arrow get at a time where a row is a whole text.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local one where that is unset and all
    tasks run in the driver's own process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pagespine-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors.

    What the write shuffled is removed when it ends, as nothing reads it again. Functions over Arrow get ``batch_rows``
    rows at a time, where given: a batch of texts is held both by Spark and by Python.
    """
    spark = df.sparkSession
    path, held = scratch_path(spark, label), {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        held["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pass_through(df: DataFrame, *made: str) -> list:
    """The columns of ``df`` that no column of ``made`` replaces; names are the same whatever their case."""
    names = {m.lower() for m in made}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in names]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spare(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind as it takes for ``df`` to have no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


FILTER_BITS = 1 << 26
#: With fewer rows than this no key is worth a broadcast.
COUNTED_ROWS = 5_000


def maybe_in(df: DataFrame, key: str, able: DataFrame, able_key: str, out: str) -> DataFrame:
    """Adds the boolean ``out``: whether the long ``key`` (SQL over ``df``) may be among ``able_key`` of ``able``.

    A filter of one bit a key, in words of 64, is broadcast: at most ``FILTER_BITS`` / 64 rows of two integers (tens of
    MB), whatever the corpus. The fuller it is, the more other rows pass; what passes is then joined exactly.
    """
    place, word, bits = f"pmod({{}}, {FILTER_BITS}L)", spare(df, "__word"), spare(df, "__bits")
    theirs = able.selectExpr(f"{place.format(able_key)} AS at").selectExpr(f"at div 64 AS `{word}`", "shiftleft(1L, int(at % 64)) AS bit")
    theirs = theirs.groupBy(word).agg(F.bit_or("bit").alias(bits))
    joined = df.withColumn(word, F.expr(f"{place.format(key)} div 64")).join(F.broadcast(theirs), word, "left")
    return joined.withColumn(out, F.expr(f"coalesce(getbit(`{bits}`, int({place.format(key)} % 64)) = 1, false)")).drop(word, bits)


def join_counted(many: DataFrame, one: DataFrame, key: str | list[str], n: str) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row for each key with ``n``, how many rows of ``many`` have it.

    Keys that hold over a thousandth of the rows (so at most a thousand keys) are broadcast, and their rows stay where
    they are; the others are joined through a shuffle, in which no key is hot.
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    limit = total // 1000
    hot = one.filter(F.col(n) > limit)
    if total < COUNTED_ROWS or not hot.take(1):
        return many.join(one, key)
    return many.join(F.broadcast(hot), key).unionByName(many.join(one.filter(F.col(n) <= limit), key))


def text_key(text: str = "text"):
    """Tells apart rows that share an id; rows with equal id and text are the same document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def filesystem(path: str):
    """pyarrow file system and path of a URI or plain path, usable in tasks."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            path = "/" + path.removeprefix("file:").lstrip("/")
            return fs.LocalFileSystem(), path
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def make_dirs(path: str) -> None:
    where, p = filesystem(path)
    where.create_dir(p, recursive=True)


def open_write(path: str):
    where, p = filesystem(path)
    return where.open_output_stream(p, compression=None)


def open_read(path: str):
    where, p = filesystem(path)
    return where.open_input_file(p)


def task_file(folder: str, suffix: str) -> str:
    """A name for what this task attempt writes; a later attempt takes another, and only the manifest's names count."""
    from pyspark import TaskContext

    return f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}{suffix}"


def runs_of(sizes, limit: int):
    """Split consecutive items into slices whose sizes add up to about ``limit``; a larger item is a slice of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def split_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; run i has counts[i] items, possibly none."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


_kept: dict = {}


def kept(key, make):
    """What a worker keeps from task to task under ``key``, made when first asked for.

    Workers outlive a step, and memos of several operators would add up in them: what another key holds is dropped first.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


class _Codes(dict):
    """Gives each new string the next number and notes it."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, string):
        self.new.append(string)
        self[string] = code = len(self)
        return code


class Memo:
    """Codes of distinct strings with a run of numbers each, made once per worker and bounded in entries.

    ``make(strings)`` returns one list of numbers per string, or the numbers of all strings in one array with arrays of
    the strings' starts and lengths in it. ``look_up(strings)`` returns the runs of all
    strings end to end and their lengths.
    """

    def __init__(self, make, dtype, limit: int = 500_000):
        self.make, self.dtype, self.limit = make, dtype, limit
        self.clear()

    def clear(self):
        self.codes = _Codes()
        self.flat, self.used = np.empty(1 << 16, self.dtype), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _add(self, strings):
        runs, known = self.make(strings), len(self.codes) - len(strings)
        if isinstance(runs, tuple):
            flat, starts, sizes = runs
        else:
            sizes = np.fromiter(map(len, runs), np.int64, len(runs))
            starts = np.cumsum(sizes) - sizes
            flat = np.fromiter(chain.from_iterable(runs), self.dtype, int(sizes.sum()))
        self.starts, self.sizes = _room(self.starts, len(self.codes)), _room(self.sizes, len(self.codes))
        self.sizes[known : len(self.codes)] = sizes
        self.starts[known : len(self.codes)] = self.used + starts
        self.flat = _room(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def look_up(self, strings: list) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > self.limit:
            self.clear()
        at = np.fromiter(map(self.codes.__getitem__, strings), np.int64, len(strings))
        if self.codes.new:
            self._add(self.codes.new)
            self.codes.new = []
        sizes, starts = self.sizes[at], self.starts[at]
        place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.flat[place], sizes


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out
