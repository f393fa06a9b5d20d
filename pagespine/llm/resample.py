"""Importance resampling towards a target distribution, over hashed word n-grams and an integer word dictionary.

Features of a text are its runs of 1 to ``orders`` consecutive words, repeats counted; words are runs of digits, letters
a-z and characters beyond ASCII, after lower-casing A-Z. A block of texts (4 MB, a longer text alone) maps its distinct
words to numbers and so its n-grams to tuples of numbers; each distinct tuple's bytes, joined by blanks, are hashed once
(crc32, which goes on from the hash of the tuple's head), and the hashes' buckets are joined back to every place where
the tuple stands. Only buckets are kept: they are written once, counted by bucket over all documents and over the target,
and read again to weigh each document. A bucket's gain is the smoothed log ratio of its shares, in thousandths; weight is
the floored mean of the gains of a document's features. Gumbel noise from a hash of the id makes the draw without
replacement: the highest scores of the documents with ``min_words`` words or more, ``percent`` of them.

Memory: a block, and one number a bucket; the gains (``buckets`` numbers, a parameter) are the only thing that
reaches the driver. Ranks come from ranges of scores that are sorted apart and counted, so no window holds all rows.

Defined results: a null or empty text has no features, weight 0, and is never drawn. A null id is hashed as an empty
one and comes last among ties. Repeated rows are drawn each; ties between them go by features and weight. An empty table gives
no rows; an empty target still gives gains, of the smoothing alone. Other columns pass through, but one named like a
column made here is replaced; the text does only if ``keep_text``.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagespine.scratch import numbered

from ._common import materialise, pass_through, quoted, spare, split_sum, table
from ._words import blocks, numbered_words, separators

BUCKETS, ORDERS, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
WORD_TABLE = separators(b"0123456789abcdefghijklmnopqrstuvwxyz")


def tuple_buckets(texts: list, orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the texts' n-grams, text by text, how many each text has, and its words."""
    words, ids, sizes = numbered_words(texts, WORD_TABLE)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))  # words from here to the text's end
    tails = [b" " + w for w in words]
    tuples, hashes = ids, np.fromiter(map(crc32, words), np.int64, len(words))
    found, owners, at = [hashes[ids]], [owner], np.arange(len(ids))
    for k in range(2, orders + 1):
        at = at[left[at] >= k]
        distinct, back = np.unique(tuples[at] * len(words) + ids[at + k - 1], return_inverse=True)
        heads, last = hashes[distinct // max(len(words), 1)].tolist(), (distinct % max(len(words), 1)).tolist()
        hashes = np.fromiter(map(crc32, map(tails.__getitem__, last), heads), np.int64, len(distinct))
        tuples = np.full(len(ids), -1)
        tuples[at] = back
        found.append(hashes[back])
        owners.append(owner[at])
    owner = np.concatenate(owners)
    return (np.concatenate(found) % buckets)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(texts)), sizes


def _width(buckets: int):
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def with_buckets(rows: DataFrame, text: str, orders: int, buckets: int, out: str, n_words: str, n_features: str, keep_text: bool = False) -> DataFrame:
    """Adds ``out``, the buckets of a row's features end to end (2 or 4 bytes each), and counts of words and features."""
    raw, width = spare(rows, "__raw"), _width(buckets)
    kept = pass_through(rows, out, n_words, n_features, *([] if keep_text else [text]))
    source = rows.select(*kept, F.col(quoted(text)).cast("binary").alias(raw))
    schema = T.StructType([f for f in source.schema if f.name != raw] + [T.StructField(out, T.BinaryType()), T.StructField(n_words, T.LongType()), T.StructField(n_features, T.LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(raw).to_pylist()
            others = [c for c, name in zip(batch.columns, batch.schema.names) if name != raw]
            for start, end in blocks(texts):
                flat, counts, sizes = tuple_buckets(texts[start:end], orders, buckets)
                data, ends = flat.astype(width).tobytes(), np.cumsum(counts) * width.itemsize
                packed = [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
                made = [pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in others), *made], names=schema.names)

    return source.mapInArrow(run, schema)


def bucket_counts(made: DataFrame, column: str, buckets: int) -> DataFrame:
    """(bucket, n): how often each bucket occurs; every task counts what it reads before the shuffle."""
    width = _width(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return made.select(column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of target and corpus shares, each smoothed by one; a number a bucket."""
    spark = corpus.sparkSession
    sums = [F.broadcast(x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))) for x, name in ((corpus, "all_s"), (target, "all_t"))]  # one row each
    joined = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").crossJoin(sums[0]).crossJoin(sums[1])
    gain = f"CAST(floor(1000 * ln((coalesce(t, 0) + 1D) * (all_s + {buckets}D) / ((coalesce(s, 0) + 1D) * (all_t + {buckets}D)))) AS BIGINT)"
    out = np.zeros(buckets, np.int64)
    for r in joined.select("bucket", F.expr(gain).alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def with_weights(made: DataFrame, column: str, n_features: str, gain: np.ndarray, out: str) -> DataFrame:
    """Replaces the buckets by the floored mean of their gains."""
    width = _width(len(gain))
    schema = T.StructType([f for f in made.schema if f.name != column] + [T.StructField(out, T.LongType())])

    def run(batches):
        for batch in batches:
            flat, counts = np.frombuffer(b"".join(batch.column(column).to_pylist()), width), batch.column(n_features).to_numpy(zero_copy_only=False)
            mean = split_sum(gain[flat], counts) // np.maximum(counts, 1)
            others = [c for c, name in zip(batch.columns, batch.schema.names) if name != column]
            yield pa.RecordBatch.from_arrays([*others, pa.array(mean, pa.int64())], names=schema.names)

    return made.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS, orders: int = ORDERS, min_words: int = MIN_WORDS, keep_text: bool = False) -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn)."""
    column, made = spare(docs, "__buckets"), ("n_words", "n_features", "weight", "score", "rank")
    able = materialise(with_buckets(docs.select(*pass_through(docs, *made)), text, orders, buckets, column, "n_words", "n_features", keep_text), "resample-buckets")
    aims = with_buckets(target.select(F.col(quoted(target_text)).alias("text")), "text", orders, buckets, "buckets", "n_words", "n_features")
    gain = gains(bucket_counts(able, column, buckets), bucket_counts(aims, "buckets", buckets), buckets)
    key = f"coalesce(CAST({quoted(doc_id)} AS STRING), '')"
    noise = f"CAST(floor(-1000 * ln(-ln((CAST(conv(substr(sha2('{seed}:' || {key}, 256), 1, 8), 16, 10) AS BIGINT) + 0.5D) / 4294967296D))) AS BIGINT)"
    weighed = materialise(with_weights(able, column, "n_features", gain, "weight").withColumn("score", F.col("weight") + F.expr(noise)), "resample-weights")
    drawn = weighed.agg((F.count(F.when(F.col("n_words") >= min_words, 1)) * percent / 100).alias("n")).select(F.floor("n").cast("long")).first()[0]
    order = [(F.col("n_words") >= min_words).desc(), F.col("score").desc(), F.col(quoted(doc_id)).asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = numbered(weighed, order, "rank")
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


#: CRC-32 in DuckDB, which has no such function: a table of 256 entries made from the polynomial, one step a byte.
SQL = rf"""
WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, false AS aim FROM documents UNION ALL SELECT -row_number() OVER (), NULL, coalesce(text, ''), true FROM benchmark),
words AS (SELECT rid, doc_id, aim, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
features AS (SELECT rid, aim, unnest(w) AS f FROM words UNION ALL SELECT rid, aim, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
counted AS (SELECT rid, aim, f, count(*) AS n FROM features GROUP BY ALL),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1]::BIGINT, c >> 8)), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM counted), crc_table),
placed AS (SELECT rid, aim, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (NOT aim), 0) AS s, coalesce(sum(n) FILTER (aim), 0) AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sums),
means AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE NOT aim GROUP BY rid),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM words LEFT JOIN means USING (rid) WHERE NOT aim),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_words >= {MIN_WORDS} DESC, score DESC, doc_id, n_features, weight) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM scored WHERE n_words >= {MIN_WORDS}) THEN place END AS rank, n_words FROM ranked
"""
