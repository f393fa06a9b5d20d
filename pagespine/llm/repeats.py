"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else, in the same text or another.

1. Every start of such a string is put under a core that its own bytes choose: the least hash of ``GRAM`` bytes in
   the string, and 184 bytes more on the longer side of it. Equal strings have equal cores, so starts whose core
   occurs once are done. Consecutive starts under one core form a piece: the bytes they need. Equal pieces are one
   entry with a count, so copies are compared once.
2. A core whose different pieces have over ``CORE_BYTES`` together (a passage that stands in very many texts among other
   words each time) is split: its strings go under a wider core, by half of what is left of them on their longer side,
   and so on up to the whole string; equal pieces are made one entry again at each step. So no group grows with the corpus.
3. Pieces are dealt to buckets by their core, as many buckets as the pieces' bytes ask for. A bucket reads its pieces
   as sequences of symbols of ``SYMBOL`` bytes
   (one sequence for each phase), cuts them into shards of bounded size, sorts each shard's suffixes and takes its
   Burrows-Wheeler transform. The transforms are merged by interleave refinement: which shard each row of the merged
   order comes from is refined from one leading symbol to ``LENGTH / SYMBOL`` by stably dealing the rows by their
   preceding symbols, with the borders where leading symbols change; suffixes are never sorted across shards. Rows
   between two borders share ``LENGTH`` bytes: a repeated interval.
4. The starts found are sent back to every text that has the piece; the bytes they cover are cut out. Only texts that
   may have such starts, or whose pieces are asked for, are shuffled.

Equality of symbols, cores and pieces is that of their 64-bit hashes. Defined results: a null text has no bytes;
texts shorter than ``LENGTH`` bytes lose nothing; strings are judged on the input; rows equal in id and text repeat
each other; an empty table gives no row; other columns pass through, but those with the name of an output are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_counted, materialise, maybe_in, pass_through, quoted, runs_of, shuffle_partitions, spare, table, text_key

LENGTH = 400
GRAM = 32
SYMBOL = 200
SIDE = (LENGTH - GRAM) // 2
CORE = SIDE + GRAM
SLICE_BYTES = 1 << 19
SHARD_BYTES = 1 << 18
BUCKET_BYTES = 1 << 19
CORE_BYTES = 1 << 18
#: Rows of whole texts that a task holds as a batch, in Spark and in Python.
BATCH_ROWS = 512
_BASE = 0x9E3779B97F4A7C15
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _bytes_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(base)))))


class Hashes:
    """Hashes of any substrings of a buffer, from prefix sums of scrambled bytes times powers of an odd number."""

    def __init__(self, data: np.ndarray):
        room = 1 << max(20, len(data).bit_length())
        self.inverse = _powers(room, True)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(_bytes_table()[data] * _powers(room, False)[: len(data)])))

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width``, from minima to both sides of every width-th place."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def pieces(buffer: bytes, ends: np.ndarray):
    """(start, n, core, piece) of all pieces of the texts that end at ``ends`` in ``buffer``.

    start is in the buffer, n the number of string starts, core and piece hashes.
    """
    data = np.frombuffer(buffer, np.uint8)
    n = len(data) - LENGTH + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty
    hashes = Hashes(data)
    grams = hashes.all(GRAM)
    low = np.uint64((1 << 24) - 1)
    at = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)[:n]
    at = (at & low).astype(np.int64)
    start = np.arange(n)
    inside = np.zeros(len(data) + 1, bool)
    for a, b in zip(np.concatenate(([0], ends[:-1])), ends):
        inside[a : max(a, b - LENGTH + 1)] = True
    inside = inside[:n]
    left = at - start > SIDE
    change = np.ones(n, bool)
    change[1:] = (at[1:] != at[:-1]) | (left[1:] != left[:-1]) | ~inside[:-1]
    # a text's first start begins a piece, also where no gap lies before it
    own = ends[:-1][ends[:-1] < n]
    change[own] = True
    first = np.flatnonzero(change & inside)
    last = np.append(np.flatnonzero(change)[1:], n)[np.searchsorted(np.flatnonzero(change), first)]
    gone = np.concatenate(([0], np.cumsum(inside)))
    size = gone[last] - gone[first]
    side = left[first]
    core = hashes.of(np.where(side, at[first] - SIDE, at[first]), CORE) ^ side.astype(np.uint64)
    piece = mix(hashes.of(first, size + LENGTH - 1) + size.astype(np.uint64))
    return first, size, core.view(np.int64), piece.view(np.int64)


def wider(body: bytes, n: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) in a piece of the core of each of its ``n`` starts, after ``level`` widenings.

    Each widening takes half of the string's bytes outside, rounded up, on the side that has more of them.
    """
    grams = Hashes(np.frombuffer(body, np.uint8)).all(GRAM)[: LENGTH - GRAM + 1]
    low = np.uint64((1 << 24) - 1)
    at = int(((grams & ~low) | np.arange(len(grams), dtype=np.uint64)).argmin())
    first = at - SIDE if at > SIDE else at
    a, b = np.full(n, first), np.full(n, first + CORE)
    start, left = np.arange(n), LENGTH - CORE
    for _ in range(level):
        step = -(-left // 2)
        before = a - start
        on_left = 2 * before >= left
        a, b, left = np.where(on_left, a - step, a), np.where(on_left, b, b + step), left - step
    return a, b


#: Widenings after which a core is the whole string.
LEVELS = (LENGTH - CORE).bit_length()


def split(body: bytes, n: int, core: int, level: int):
    """(first start, starts, core, piece) of what a piece is split to at ``level``."""
    a, b = wider(body, n, level)
    cuts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    sizes = np.diff(np.append(cuts, n))
    hashes = Hashes(np.frombuffer(body, np.uint8))
    salt = mix(np.array([core & 0xFFFFFFFFFFFFFFFF], np.uint64) + np.uint64(level))
    cores = mix(hashes.of(a[cuts], b[cuts] - a[cuts]) ^ salt)
    pieces_ = mix(hashes.of(cuts, sizes + LENGTH - 1) + sizes.astype(np.uint64))
    return cuts, sizes, cores.view(np.int64), pieces_.view(np.int64)


def _spans(texts: list[bytes]):
    """(which text, offset in it, bytes) in slices of bounded size; a long text comes in parts that overlap by LENGTH - 1."""
    parts = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - LENGTH + 1), SLICE_BYTES)]
    sizes = [min(len(texts[i]) - a, SLICE_BYTES + LENGTH - 1) for i, a in parts]
    for x, y in runs_of(sizes, SLICE_BYTES):
        yield parts[x:y], b"".join(texts[i][a : a + n] for (i, a), n in zip(parts[x:y], sizes[x:y])), np.cumsum(sizes[x:y])


def stable_order(x: np.ndarray) -> np.ndarray:
    """The order that sorts numbers of 0 to 2**32 - 1, equal ones by place: number and place sorted as one."""
    return (np.sort((x.astype(np.uint64) << np.uint64(32)) | np.arange(len(x), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def dense(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones, from 0."""
    order = np.argsort(x)
    lined = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], lined[1:] != lined[:-1]))) if len(x) else 0
    return out


def symbols(strings: list[bytes]):
    """Symbols of all strings at each place where one starts, with the place one symbol on (-1: the end)."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    hashes = Hashes(np.frombuffer(b"".join(strings), np.uint8))
    counts = lens - SYMBOL + 1
    of = np.repeat(np.arange(len(strings)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(lens) - lens, counts) + place
    following = np.where(place + SYMBOL < counts[of], np.arange(len(of)) + SYMBOL, -1)
    return hashes.of(start, SYMBOL), of, place, following


class Shard:
    """A shard's sorted suffixes and its transform.

    Sequences are the strings' phases; row 0 and the following are the sequences' ends, then the suffixes in order,
    ties by sequence. ``rows`` are places of suffixes (-1: an end), ``before`` the symbol before each row's suffix, 0 at
    a sequence's begin.
    """

    def __init__(self, symbol: np.ndarray, place: np.ndarray, following: np.ndarray, of: np.ndarray):
        n = len(symbol)
        sequence = of * SYMBOL + place % SYMBOL
        # ranks by 1, 2, 4, ... leading symbols; an end ranks first
        rank, then, depth = dense(symbol), following, 1
        while depth <= int(place.max(initial=0)) // SYMBOL:
            rank = dense(rank * (n + 1) + np.where(then >= 0, rank[then] + 1, 0))
            then, depth = np.where(then >= 0, then[then], -1), 2 * depth
        order = np.argsort(rank * (int(sequence.max(initial=0)) + 1) + sequence)
        last = np.flatnonzero(following < 0)
        last = last[np.argsort(sequence[last], kind="stable")]
        first = place < SYMBOL
        preceding = np.where(first, 0, symbol[np.maximum(np.arange(n) - SYMBOL, 0)])
        self.rows = np.concatenate((np.full(len(last), -1), order))
        self.before = np.concatenate((symbol[last], preceding[order]))


def merge(shards: list[Shard], depth: int):
    """(shard of each merged row, block of each merged row): rows in one block share ``depth`` leading symbols.

    Each round deals the rows by the symbol before them: the rows that then follow each other begin with that symbol
    and go on as before, so they are in order by one symbol more.
    """
    source = np.repeat(np.arange(len(shards), dtype=np.int32), [len(s.rows) for s in shards])
    before = np.concatenate([s.before for s in shards])
    block = np.zeros(len(source), np.int64)
    for _ in range(depth):
        lined = np.empty_like(before)
        lined[stable_order(source)] = before  # each shard's rows keep their own order
        dealt = stable_order(lined)
        first, then = lined[dealt], block[dealt]
        then[first == 0] = 0  # an end is followed by nothing
        border = np.zeros(len(dealt), np.int64)
        border[1:] = (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        source, block = source[dealt], np.cumsum(border)
    return source, block


def repeated(strings: list[bytes], starts: np.ndarray, counts: np.ndarray, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string which of its first ``starts`` LENGTH-byte strings occur at another place or in another copy."""
    symbol, of, place, following = symbols(strings)
    symbol = dense(symbol) + 1
    bounds = np.searchsorted(of, [a for a, _ in runs_of([len(s) for s in strings], shard_bytes)] + [len(strings)])
    shards = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = following[a:b]
        shards.append(Shard(symbol[a:b], place[a:b], np.where(own >= 0, own - a, -1), of[a:b]))
    source, block = merge(shards, LENGTH // SYMBOL)
    suffix = np.empty(len(source), np.int64)
    suffix[stable_order(source)] = np.concatenate([np.where(s.rows >= 0, s.rows + a, -1) for s, a in zip(shards, bounds)])
    real = suffix >= 0
    suffix, block = suffix[real], block[real]
    able = place[suffix] < starts[of[suffix]]
    suffix, block = suffix[able], block[able]
    times = np.bincount(block, weights=counts[of[suffix]])
    hit = suffix[times[block] > 1]
    masks = [np.zeros(n, bool) for n in starts.tolist()]
    if len(hit):
        flat = np.zeros(int(starts.sum()), bool)
        base = np.cumsum(starts) - starts
        flat[base[of[hit]] + place[hit]] = True
        masks = np.split(flat, np.cumsum(starts)[:-1])
    return masks


def _bodies(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, key, found): for each text with repeats its list of (start, n, mask): of the n string starts from ``start``
    on, which ones, packed."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    bodies = docs.select(F.col(quoted(doc_id)).alias("doc"), text_key(text).alias("key"), F.col(quoted(text)).cast("binary").alias("body"))

    def cut(batches):
        for batch in batches:
            docs_, keys, texts = batch.column(0), batch.column(1), _bodies(batch.column(2))
            for parts, buffer, ends in _spans(texts):
                first, n, core, piece = pieces(buffer, ends)
                of = np.searchsorted(ends, first, "right")
                begin = np.concatenate(([0], ends[:-1]))
                which = np.array([i for i, _ in parts], np.int64)
                offset = np.array([a for _, a in parts], np.int64)
                take = pa.array(which[of])
                yield pa.RecordBatch.from_arrays([docs_.take(take), keys.take(take), pa.array(first - begin[of] + offset[of], pa.int64()), pa.array(n, pa.int32()), pa.array(core), pa.array(piece)], names=["doc", "key", "start", "n", "core", "piece"])

    made = materialise(bodies.filter(F.length("body") >= LENGTH).mapInArrow(cut, f"doc {kind}, key long, start long, n int, core long, piece long"), "pieces", BATCH_ROWS)
    cores = materialise(made.groupBy("core").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("core"), "cores")
    made = materialise(maybe_in(made, "core", cores, "core", "may").filter("may").drop("may"), "shared-pieces")
    distinct = materialise(made.groupBy("core", "piece").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "key", "start", "n")).alias("at")), "distinct-pieces")
    entries = materialise(_shared(distinct, F.col("at.n")), "entries")
    def slices(batches):
        for batch in batches:
            rows = []
            size = 0
            for body, wanted in zip(_bodies(batch.column(0)), batch.column(1).to_pylist()):
                for w in wanted:
                    rows.append((0, w["core"], w["piece"], w["times"], w["n"], w["heavy"], body[w["start"] : w["start"] + w["n"] + LENGTH - 1]))
                    size += w["n"] + LENGTH
                    if size > 8 << 20:
                        yield _batch(rows, _ENTRY)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, _ENTRY)

    def whole(heavy: bool) -> DataFrame:
        """The pieces of such cores with their bytes; rows equal in id and text give them each."""
        own = entries.filter("heavy" if heavy else "NOT heavy").groupBy("at.doc", "at.key").agg(F.collect_list(F.struct("at.start", "at.n", "core", "piece", "times", "heavy")).alias("wanted"))
        own = materialise(own.withColumnsRenamed({"doc": "__doc", "key": "__key"}), "wanted")
        holders = maybe_in(bodies, "xxhash64(doc, key)", own, "xxhash64(__doc, __key)", "may").filter("may")
        holders = holders.join(own, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("key") == F.col("__key"))).select("body", "wanted")
        return holders.mapInArrow(slices, _names(_ENTRY))

    maps: list[DataFrame] = []
    sizes = {r["heavy"]: r["size"] for r in entries.groupBy("heavy").agg(F.sum(F.col("at.n") + LENGTH - 1).alias("size")).collect()}
    total, at_level = sizes.get(False, 0), None
    if True in sizes:
        at_level = materialise(whole(True).dropDuplicates(["core", "piece"]), "piece-bytes", BATCH_ROWS)
    levels = [whole(False)]
    for level in range(1, LEVELS + 1):
        heavy = at_level.filter("heavy") if at_level is not None else None
        if heavy is None or not heavy.take(1):
            break

        def narrow(batches, level=level):
            for batch in batches:
                rows, size = [], 0
                for _, core, piece, times, n, _, body in zip(*(c.to_pylist() for c in batch.columns)):
                    for first, k, c, p in zip(*(x.tolist() for x in split(body, n, core, level))):
                        rows.append((core, piece, first, c, p, times, k, body[first : first + k + LENGTH - 1]))
                        size += k + LENGTH
                    if size > 8 << 20:
                        yield _batch(rows, _SPLIT)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _SPLIT)

        parts = materialise(heavy.mapInArrow(narrow, _names(_SPLIT)), "split-pieces", BATCH_ROWS)
        maps.append(parts.select("core", "piece", "first", "to_core", "to_piece"))
        merged = materialise(parts.groupBy(F.col("to_core").alias("core"), F.col("to_piece").alias("piece")).agg(F.sum("times").alias("times"), F.first("n").alias("n"), F.first("bytes").alias("bytes")), "split-distinct")
        at_level = materialise(_shared(merged, F.col("n")).select(F.lit(level).alias("level"), "core", "piece", "times", "n", (F.col("heavy") & F.lit(level < LEVELS)).alias("heavy"), "bytes"), "piece-bytes")
        levels.append(at_level.filter("NOT heavy"))
        total += levels[-1].agg(F.sum(F.length("bytes"))).first()[0] or 0
    dealt = levels[0]
    for more in levels[1:]:
        dealt = dealt.unionByName(more)
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET_BYTES))

    def meet(key, rows):
        first: dict = {}
        for i, which in enumerate(zip(*(rows.column(c).to_pylist() for c in ("level", "core", "piece")))):
            first.setdefault(which, i)
        if len(first) < rows.num_rows:
            rows = rows.take(pa.array(list(first.values())))
        own = rows.select(["level", "core", "piece", "n"])
        masks = repeated(rows.column("bytes").to_pylist(), rows.column("n").to_numpy().astype(np.int64), rows.column("times").to_numpy().astype(np.float64))
        some = pa.array([bool(m.any()) for m in masks])
        return own.append_column("mask", pa.array([np.packbits(m).tobytes() for m in masks], pa.binary())).filter(some)

    bucket = dealt.withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets))).groupBy("bucket")
    hits = materialise(bucket.applyInArrow(meet, "level int, core long, piece long, n int, mask binary"), "repeats", BATCH_ROWS).withColumn("first", F.lit(0))
    resolved = None  # hits of each level, as hits of the one before it
    for level in range(len(maps), -1, -1):
        own = hits.filter(F.col("level") == level).select("core", "piece", "first", "n", "mask")
        resolved = own if resolved is None else own.unionByName(resolved)
        if level:
            wider_ = maps[level - 1].withColumnRenamed("first", "by")
            inner = resolved.withColumnsRenamed({"core": "to_core", "piece": "to_piece"})
            resolved = wider_.join(inner, ["to_core", "to_piece"]).select("core", "piece", (F.col("first") + F.col("by")).alias("first"), "n", "mask")
    # a piece that very many texts have goes to them where they are
    told = resolved.groupBy("core", "piece").agg(F.collect_list(F.struct("first", "n", "mask")).alias("hits")).join(distinct.select("core", "piece", "times"), ["core", "piece"])
    told = materialise(told, "resolved-repeats")
    back = join_counted(made.select("doc", "key", "start", "core", "piece"), told, ["core", "piece"], "times").select("doc", "key", "start", F.inline("hits"))
    return back.groupBy("doc", "key").agg(F.collect_set(F.struct((F.col("start") + F.col("first")).alias("start"), "n", "mask")).alias("found"))


_ENTRY = {"level": pa.int32(), "core": pa.int64(), "piece": pa.int64(), "times": pa.int64(), "n": pa.int32(), "heavy": pa.bool_(), "bytes": pa.binary()}
_SPLIT = {"core": pa.int64(), "piece": pa.int64(), "first": pa.int32(), "to_core": pa.int64(), "to_piece": pa.int64(), "times": pa.int64(), "n": pa.int32(), "bytes": pa.binary()}


def _shared(pieces: DataFrame, n) -> DataFrame:
    """``pieces`` whose core occurs twice or more, with ``heavy``: whether the core has too many bytes for one group."""
    size = pieces.groupBy("core").agg(F.sum("times").alias("total"), F.sum(n + LENGTH - 1).alias("size"), F.count(F.lit(1)).alias("pieces")).filter("total > 1")
    return join_counted(pieces, size.select("core", "pieces", (F.col("size") > CORE_BYTES).alias("heavy")), "core", "pieces").drop("pieces")


def _names(fields: dict) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{k} {kinds[t]}" for k, t in fields.items())


def _batch(rows, fields: dict):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), fields.values())], names=list(fields))


def cut_out(body: bytes, found) -> tuple[bytes, list[dict]]:
    """What stays of a text, and the runs that go."""
    edge = np.zeros(len(body) + 1, np.int64)
    for f in found:
        at = f["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(f["mask"], np.uint8), count=f["n"]))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + LENGTH, -1)
    covered = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    return np.frombuffer(body, np.uint8)[~covered].tobytes(), [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", kept: str = "kept", spans: str = "spans") -> DataFrame:
    """``docs`` with ``kept``, the bytes that stay, and ``spans``, the (start, end) of the maximal runs that go."""
    at, may, doc, key, found = (spare(docs, f"__{x}") for x in ("at", "may", "doc", "key", "found"))
    hits = materialise(find(docs, text, doc_id).withColumnsRenamed({"doc": doc, "key": key, "found": found}), "found-starts")

    def cut(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        made = []
        for i in range(0, max(1, len(bodies)), BATCH_ROWS):
            done = [cut_out(body, f) if f else (body, []) for body, f in zip(_bodies(bodies.slice(i, BATCH_ROWS)), lists.slice(i, BATCH_ROWS).to_pylist())]
            made.append(pa.StructArray.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], kinds)], names=["kept", "spans"]))
        return pa.concat_arrays(made)

    marked = maybe_in(docs.withColumn(at, text_key(text)), f"xxhash64({quoted(doc_id)}, `{at}`)", hits, f"xxhash64(`{doc}`, `{key}`)", may)
    body = F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b""))
    columns = pass_through(docs, kept, spans)
    some = marked.filter(may).join(hits, F.col(quoted(doc_id)).eqNullSafe(F.col(doc)) & (F.col(at) == F.col(key)), "left")
    some = some.withColumn(found, F.arrow_udf(cut, "struct<kept: binary, spans: array<struct<start: long, end: long>>>")(F.col(quoted(text)).cast("binary"), F.col(found)))
    some = some.select(*columns, F.col(found)["kept"].alias(kept), F.col(found)["spans"].alias(spans))
    none = F.array().cast(some.schema[spans].dataType)
    return marked.filter(~F.col(may)).select(*columns, body.alias(kept), none.alias(spans)).unionByName(some)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
