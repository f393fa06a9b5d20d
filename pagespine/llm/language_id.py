"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is a Spark aggregation of n-gram counts by language and bucket over labelled rows, at most about
``max_docs`` of them, chosen by a hash of their id at a rate of each language's own: rare languages give all their rows,
and the others as many rows each as the bound allows; priors are the languages' shares of all labelled rows. The log-probability matrix has ``BUCKETS`` rows and a column for each language, at
most ``MAX_LANGUAGES``, so the broadcast has a fixed bound. Scoring turns a batch of whole texts into sparse
n-gram counts by numpy and multiplies them with the matrix.

Texts are lower-cased, and every run of characters that aren't letters counts as one blank. Defined results: a text
that is null, empty or has no letter gets ``und`` and score 0, and so does every text if no labelled row was given;
ties go to the first language in order. Rows with null language aren't learned from; rows with a null id are neither
held out nor learned from. Repeated rows get equal results; other columns pass through, but those with the name of an
output are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pass_through, quoted, runs_of, spare, table

BUCKETS = 1 << 15
ORDERS = 3
MAX_LANGUAGES = 256
SMOOTHING = 0.5
SLICE_CHARS = 1 << 20
#: Odd multipliers for the characters of an n-gram.
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str | None]):
    """Bucket of each n-gram and the text it is from, for orders 1 to 3; and which texts have a letter."""
    n = len(texts)
    lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, n) + 2
    joined = "".join(f" {t or ''} " for t in texts)
    x = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(n, dtype=np.int32), lens)
    blank = x == 32
    has = np.bincount(doc[~blank], minlength=n) > 0
    first = np.ones(len(x), bool)
    first[1:] = doc[1:] != doc[:-1]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep |= first
    x, doc = x[keep], doc[keep]
    buckets, docs = [], []
    for k in range(1, ORDERS + 1):
        m = len(x) - k + 1
        if m <= 0:
            break
        h = np.full(m, np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF))
        for j in range(k):
            h = (h ^ x[j : j + m]) * _MIX[j]
            h ^= h >> np.uint32(15)
        same = doc[:m] == doc[k - 1 :]
        buckets.append((h[same] & np.uint32(BUCKETS - 1)).astype(np.int64))
        docs.append(doc[:m][same])
    return buckets, docs, has


def most_of_each(sizes: list[int], total: int) -> int:
    """The most rows of a language, so that all together have about ``total``; at least one."""
    left, most = total, 0
    for i, n in enumerate(sorted(sizes)):
        most = max(1, left // (len(sizes) - i))
        left -= min(n, most)
    return most


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = 40_000, sample_by: str = "doc_id"):
    """Languages, and the matrix of log probabilities with the log priors as its last row.

    ``max_docs`` bounds the expected number of rows learned from; all rows are used where there are fewer. A language of
    few rows whose hashes all fall outside its rate can't be, as such a language's rate is 1.
    """
    spark = labelled.sparkSession
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = usable.groupBy(lang).count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the model's size would have no bound")
    counts_of = {r[lang]: r["count"] for r in sizes}
    langs, most = sorted(counts_of), most_of_each(list(counts_of.values()), max_docs)
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1 << 20, -(-(most << 20) // counts_of[k])))]) if langs else F.create_map()
    if sum(counts_of.values()) > max_docs:
        usable = usable.filter(F.pmod(F.xxhash64(F.col(sample_by), F.lit(7)), F.lit(1 << 20)) < rate[F.col(lang)])
    at = {x: i for i, x in enumerate(langs)}

    def count(batches):
        counts = np.zeros((len(langs), BUCKETS + 1), np.int64)
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in runs_of([len(t) for t in texts], SLICE_CHARS):
                of = np.array([at[x] for x in own[a:b]], np.int64)
                for bucket, doc in zip(*grams(texts[a:b])[:2]):
                    counts[:, :BUCKETS] += np.bincount(of[doc] * BUCKETS + bucket, minlength=len(langs) * BUCKETS).reshape(len(langs), BUCKETS)
                counts[:, BUCKETS] += np.bincount(of, minlength=len(langs))
        k, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[k, bucket], pa.int64())], names=["k", "bucket", "n"])

    counts = np.zeros((BUCKETS + 1, len(langs)))
    if langs:
        found = usable.select(text, lang).mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[found["bucket"], found["k"]] = found["n"]
    grams_of = counts[:BUCKETS].sum(axis=0)
    logs = np.log(counts[:BUCKETS] + SMOOTHING) - np.log(grams_of + SMOOTHING * BUCKETS)
    shares = np.array([counts_of[k] for k in langs], np.float64)
    priors = np.log(shares + 1) - np.log(shares.sum() + max(1, len(langs)))
    return langs, np.vstack([logs, priors])


def score(texts: list[str | None], langs: list[str], matrix: np.ndarray):
    """The likeliest language and its posterior for each text."""
    names, scores = [], []
    columns = np.ascontiguousarray(matrix[:BUCKETS].T)
    for a, b in runs_of([len(t or "") for t in texts], SLICE_CHARS):
        buckets, docs, has = grams(texts[a:b])
        n = b - a
        if not langs:
            names += ["und"] * n
            scores += [0.0] * n
            continue
        logs = np.tile(matrix[BUCKETS], (n, 1))
        for bucket, doc in zip(buckets, docs):
            for k in range(len(langs)):
                logs[:, k] += np.bincount(doc, weights=columns[k][bucket], minlength=n)
        best = logs.argmax(axis=1)
        posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        names += [langs[i] if ok else "und" for i, ok in zip(best, has)]
        scores += np.where(has, posterior, 0.0).tolist()
    return names, scores


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the predicted language and its posterior probability; reads only ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    @F.arrow_udf("struct<lang: string, score: double>")
    def label(column: pa.Array) -> pa.Array:
        names, scores = score(column.to_pylist(), *shared.value)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    made = spare(docs, "__label")
    done = docs.withColumn(made, label(F.col(quoted(text))))
    return done.select(*pass_through(docs, lang_out, score_out), F.col(made)["lang"].alias(lang_out), F.col(made)["score"].alias(score_out))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    langs, matrix = train(docs.filter(fold != 2))
    held = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return predict(held, langs, matrix).select("doc_id", "held_out", "lang_pred", "score")
