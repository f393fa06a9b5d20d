"""Line deduplication across documents, exact and within one edit, by a deletion neighbourhood join.

Lines are what lies between line feeds. Those that have a word take part: one goes if it repeats an earlier line, whatever
its length. Of lines of ``min_chars`` characters or more also those go that are within one edit of an earlier one; in
shorter lines one character may be all that tells two apart (``Item 3``, ``Item 4``). Lines
one character insertion, deletion or substitution apart share a variant:
- substitution: both give the same rest when the character at the same place is deleted: key (rest, place);
- insertion or deletion: the longer line with one character deleted is the shorter line: key (rest).
Each line emits all its variants as hashed keys; equal keys are joined by aggregation to the earliest line under the
key, so a key that many lines share never yields their pairs; the edit distance of each line to its witness is then
verified on the texts. Only lines that can have a partner emit: of two lines one edit apart, one half is equal at its
own end, so a line whose two half keys no other line has can't have one; and cut into ``SEGMENTS``, they are equal but
for one segment, so of the rest those lines go whose keys without one segment no other line has.

Earlier is by (doc_id, text hash, line
number), a null id first, and a line's first occurrence counts. So the earliest stays. Defined results: a null text
stays null and an empty one empty; if all lines go, the text is empty; repeated rows (equal id and text) are one
document, and keep and lose the same lines; other columns pass through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD_SPACE, join_counted, materialise, maybe_in, quoted, runs_of, spare, table, text_key

MIN_CHARS = 30  # for one edit: one character of a short line may be all that tells two lines apart
SLICE_CHARS = 1 << 18
SEGMENTS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def variants(lines: list[str]):
    """(which, keys): for each line the keys of (rest, place) and (rest) for each deleted character, and of itself.

    Rests are hashed by sums of scrambled characters times powers of an odd number: the rest without place i is a
    prefix sum and a suffix sum moved by one power, so a line's keys take time in proportion to its length.
    Returned in three blocks: substitution keys, deletion keys, own keys.
    """
    lens = np.fromiter(map(len, lines), np.int64, len(lines))
    x = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = _scramble(x + np.uint64(1))
    of = np.repeat(np.arange(len(lines)), lens)
    starts = np.cumsum(lens) - lens
    place = np.arange(len(x)) - starts[of]
    longest = int(lens.max()) if len(lens) else 0
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(longest, _ODD))))
    here, moved = x * power[place + 1], x * power[place]
    c, m = np.concatenate(([np.uint64(0)], np.cumsum(here))), np.concatenate(([np.uint64(0)], np.cumsum(moved)))
    at = np.arange(len(x))
    ends = (starts + lens)[of]
    rest = (c[at] - c[starts[of]]) + (m[ends] - m[at + 1])
    size = (lens[of] - 1).astype(np.uint64)
    bare = _scramble(rest ^ _scramble(size))
    placed = _scramble(bare + _scramble(place.astype(np.uint64) + np.uint64(11)))
    own = _scramble((c[starts + lens] - c[starts]) ^ _scramble(lens.astype(np.uint64)))
    return of, placed.view(np.int64), bare.view(np.int64), own.view(np.int64)


def segment_keys(line: str) -> set[int]:
    """Keys of the line without each of its segments; lines one edit apart share one, at the shorter one's length."""
    keys, n = set(), len(line)
    for m in (n, n - 1):
        for q in range(SEGMENTS):
            a, b = m * q // SEGMENTS, m * (q + 1) // SEGMENTS
            digest = xxhash.xxh64(line[:a].encode("utf-8", "surrogatepass"), seed=q)
            digest.update(b"\xff%d\xff" % m)
            digest.update(line[n - (m - b) :].encode("utf-8", "surrogatepass"))
            keys.add(digest.intdigest() - (1 << 63))
    return keys


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Each line with a word: its document and number, the line, and two hashes that stand for it."""
    cut = docs.select(F.col(quoted(doc_id)).alias("doc"), text_key(text).alias("key"), F.posexplode(F.split(F.col(quoted(text)), "\n")).alias("no", "line"))
    return cut.filter(F.col("line").rlike(f"[^{WORD_SPACE}]")).select("*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def _half_keys() -> str:
    """Keys under which a line meets every line one edit away: its first part from the left, or its last part."""
    n, halves = "length(line)", []
    for least in ("{n}", "{n} - 1"):
        m = least.format(n=n)
        halves.append(f"xxhash64('a', left(line, int(({m}) div 2)))")
        halves.append(f"xxhash64('z', right(line, int(({m}) - ({m}) div 2)))")
    return f"array_distinct(array({', '.join(halves)}))"


def doomed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, key, gone): the numbers of the lines to remove, of each document that has any.

    A distinct line goes by the two hashes of its text, or by its first occurrence, ``first``. Joins of keys that very
    many lines share go through ``join_counted``.
    """
    halves = F.when(F.length("line") >= min_chars, F.expr(_half_keys()))  # a shorter line has none, and so no variants
    order = F.struct("doc", "key", "no")
    lines = _lines(docs, text, doc_id).withColumn("halves", halves)
    distinct = materialise(lines.groupBy("h", "g").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.min("halves").alias("halves")), "lines")

    # lines that share a half with another line
    halves = distinct.select("h", "g", "first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1")
    able = materialise(join_counted(halves, shared, "half", "lines").select("h", "g", "first").distinct(), "able")

    # their texts: the scan keeps lines whose bit is set, which are few, so that whole texts aren't shuffled
    able_lines = maybe_in(_lines(docs, text, doc_id).filter(F.length("line") >= min_chars).select("line", "h", "g"), "h", able, "h", "may").filter("may")
    texts = materialise(able_lines.groupBy("h", "g").agg(F.first("line").alias("line")).join(able, ["h", "g"]).select("first", "line"), "able-lines")
    first_type = texts.schema["first"].dataType.simpleString()

    def without_one(batches):
        for batch in batches:
            keys = [segment_keys(line) for line in batch.column(1).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array([x for k in keys for x in k], pa.int64())], names=["first", "segment"])

    rest = texts.mapInArrow(without_one, f"first {first_type}, segment long")
    paired = rest.groupBy("segment").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1")
    texts = materialise(texts.join(join_counted(rest, paired, "segment", "lines").select("first").distinct(), "first", "left_semi"), "paired-lines")

    def emit(batches):
        for batch in batches:
            lines = batch.column(1).to_pylist()
            for a, b in runs_of([len(x) for x in lines], SLICE_CHARS):
                of, placed, bare, own = variants(lines[a:b])
                n = b - a
                which = pa.array(np.concatenate((of, of, np.arange(n))) + a)
                kind = pa.array(np.repeat(np.array([0, 1, 2], np.int8), (len(of), len(of), n)))
                keys = pa.array(np.concatenate((placed, bare, own)))
                yield pa.RecordBatch.from_arrays([keys, kind, batch.column(0).take(which)], names=["variant", "kind", "first"])

    emitted = texts.mapInArrow(emit, f"variant long, kind byte, first {first_type}")
    # substitution keys join with each other; deletion keys with the lines' own keys. A witness is an earlier line.
    placed = emitted.filter("kind = 0")
    earliest = placed.groupBy("variant").agg(F.min("first").alias("w"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    near = join_counted(placed, earliest, "variant", "n").filter("w < first").select("first", "w")
    rests = emitted.filter("kind = 1").select("variant", "first").distinct()
    owns = emitted.filter("kind = 2").select("variant", "first")
    longer_goes = rests.join(owns.withColumnRenamed("first", "w"), "variant").filter("w < first").select("first", "w")
    shorter_goes = owns.join(rests.groupBy("variant").agg(F.min("first").alias("w")), "variant").filter("w < first").select("first", "w")
    claims = materialise(near.unionByName(longer_goes).unionByName(shorter_goes).distinct(), "claims")

    # verify each claim on the texts
    mine, theirs = texts.withColumnRenamed("line", "mine"), texts.select(F.col("first").alias("w"), F.col("line").alias("theirs"))
    asked = claims.groupBy("w").agg(F.count(F.lit(1)).alias("n")).join(theirs, "w")
    verified = join_counted(claims, asked, "w", "n").join(mine, "first").filter("levenshtein(mine, theirs, 1) = 1").select("first").distinct().withColumn("near", F.lit(True))

    verdicts = distinct.join(verified, "first", "left").filter("n > 1 OR near").select("h", "g", "first", "n", F.coalesce("near", F.lit(False)).alias("near"))
    verdicts = materialise(verdicts, "line-verdicts")
    occurrences = maybe_in(_lines(docs, text, doc_id).select("doc", "key", "no", "h", "g"), "h", verdicts, "h", "may").filter("may")
    gone = join_counted(occurrences, verdicts, ["h", "g"], "n").filter(F.col("near") | (order > F.col("first")))
    return materialise(gone.groupBy("doc", "key").agg(F.collect_set("no").alias("gone")), "doomed-lines")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """``docs`` with the doomed lines taken out of ``text``; optionally with the counts of lines and removed lines, which
    replace columns of the same name. Only rows that may lose a line are shuffled."""
    doc, key, gone, at, may, cut = (spare(docs, f"__{x}") for x in ("doc", "key", "gone", "at", "may", "lines"))
    found = doomed(docs, text, doc_id, min_chars).withColumnsRenamed({"doc": doc, "key": key, "gone": gone})
    marked = maybe_in(docs.withColumn(at, text_key(text)), f"xxhash64({quoted(doc_id)}, `{at}`)", found, f"xxhash64(`{doc}`, `{key}`)", may)
    some = marked.filter(may).join(found, F.col(quoted(doc_id)).eqNullSafe(F.col(doc)) & (F.col(at) == F.col(key)), "left").withColumn(cut, F.split(F.col(quoted(text)), "\n"))
    kept = rf"CASE WHEN `{gone}` IS NULL THEN {quoted(text)} ELSE array_join(transform(array_except(sequence(0, size(`{cut}`) - 1), `{gone}`), i -> `{cut}`[i]), '\n') END"
    counts = [x for x in (n_lines, n_removed) if x]

    def columns(own, removed):
        size = F.coalesce(F.size(F.split(F.col(quoted(text)), "\n")).cast("long"), F.lit(0).cast("long"))
        kept_ = [own.alias(c) if c == text else F.col(quoted(c)) for c in docs.columns if c.lower() not in {x.lower() for x in counts}]
        return [*kept_, *([F.when(F.col(quoted(text)).isNull(), 0).otherwise(size).cast("long").alias(n_lines)] if n_lines else []), *([removed.cast("long").alias(n_removed)] if n_removed else [])]

    whole = marked.filter(~F.col(may)).select(*columns(F.col(quoted(text)), F.lit(0)))
    return whole.unionByName(some.select(*columns(F.expr(kept), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)))))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), n_lines="n_lines", n_removed="n_removed")
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
