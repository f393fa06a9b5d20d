"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of tokens and of token pairs are aggregated over the training texts by 64-bit hash. A count c has the level
1 + floor(log2 c); the filter holds the pair with each of the numbers 1 to its level. A scorer finds a pair's level by
asking for 1, 2, ... until the filter says no; level 1 counts as 1, and level l as 1.4 times 2 to the l - 1.
Probabilities are pairs' shares in their first token, interpolated with the token's own smoothed share:

    p(w | v) = (count(v w) + STRENGTH * p(w)) / (count(v) + STRENGTH),    p(w) = (c + 0.5) / (N + 0.5 * (V + 1))

The filter grows with the corpus, so it has no bound for a broadcast of the whole. It is cut into slices by the pair's
hash, as many as the training texts' bytes ask for; each is built by one task and sent to the worker that answers for
it, with the exact counts of its share of the tokens. Texts are scored in blocks of bounded size: a block sends each
slice the distinct hashes that it has of it, gets their levels and counts back, and adds up. This is the one way at
every size; the driver sees totals only.

Tokens are words (runs of characters other than space and U+0009 to U+000D) with A-Z lower-cased, then one end; a pair
also starts at the text's beginning, which counts once for each training text. Defined results: a null or empty text
is the end alone; with no training text all counts are 0, N is 0 and V is 0; rows with a null id are learned from;
repeated rows count each and get equal scores; an empty table gives no row. Other columns but the text pass through;
one with the name of an output is replaced by it. Hashes of 64 bits stand for tokens: two of V tokens share one with
odds V*V/2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Memo, materialise, pass_through, quoted, runs_of, shuffle_partitions, spare, split_sum, table

STRENGTH = 300.0
PROBES = 7
BITS_PER_ENTRY = 10  # about PROBES / ln 2, where a filter is half full
PART_BYTES = 12 << 20  # training text for each slice of the filter
SLICE_CHARS = 1 << 20
BLOCK_CHARS = 3 << 20
HASH_BITS = {False: 64, True: 48}  # of tokens, of pairs
COUNT_ENTRIES = 1 << 20
END, START = np.uint64(xxhash.xxh64_intdigest(b" end", 5)), np.uint64(xxhash.xxh64_intdigest(b" start", 5))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of 48 bits: one of P pairs is taken for a pair of the training texts with odds P/2**48, beside the filter's own."""
    return mix(first * _B + mix(second)) >> np.uint64(16)


def part_of(hashes: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The part of each hash; parts are ranges of hashes, in order."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def dealt(hashes: np.ndarray, bits: int, parts: int):
    """(part, from, to) of sorted hashes."""
    part = part_of(hashes, bits, parts)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
    yield from zip(part[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)])


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned integers, their first bytes first, compressed."""
    data = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()
    return pa.Codec("zstd", 1).compress(data, asbytes=True) if data else b""


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(data, n * size, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def steps(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes as differences, which ``np.cumsum`` undoes."""
    return np.diff(hashes, prepend=np.uint64(0))


class Words:
    """Hashes of the tokens of texts, with a memo of words seen before."""

    def __init__(self):
        digest = xxhash.xxh64_intdigest
        self.memo = Memo(lambda words: [(digest(w, 5),) for w in words], np.uint64, limit=200_000)

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all tokens with the ends, and the number of each text's tokens."""
        words, counts = [], np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = (t or "").encode("utf-8", "surrogatepass").lower().split()
            words += found
            counts[i] = len(found)
        hashes, _ = self.memo.look_up(words)
        return np.insert(hashes, np.cumsum(counts), END), counts + 1

    @staticmethod
    def before(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The token before each, at a text's first the start."""
        out = np.empty_like(tokens)
        out[1:] = tokens[:-1]
        out[np.cumsum(counts) - counts] = START
        return out


_words: list[Words] = []


def _worker_words() -> Words:
    if not _words:
        _words.append(Words())
    return _words[0]


def _combined(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their summed counts."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.empty(0, np.int64)
    return hashes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


def _probe(hashes: np.ndarray, level: int, k: int, size: np.ndarray) -> np.ndarray:
    h = mix(hashes + np.uint64(level * int(_A) & 0xFFFFFFFFFFFFFFFF))
    step = mix(h) | np.uint64(1)
    return (h + np.uint64(k) * step) % size


def build_slice(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of a slice that holds each hash with each number up to its level."""
    levels = levels_of(counts)
    size = np.uint64(max(64, -(-int(levels.sum(dtype=np.int64)) * BITS_PER_ENTRY // 8) * 8))
    bits = np.zeros(int(size), bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = hashes[levels >= level]
        for k in range(PROBES):
            bits[_probe(some, level, k, size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def levels(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The level that a slice gives each of its hashes; 0 where it has none."""
    out, at, level = np.zeros(len(hashes), np.uint8), np.arange(len(hashes)), 0
    size = np.uint64(8 * len(bits))
    while len(at) and len(bits) and level < 64:
        level += 1
        for k in range(PROBES):
            bit = _probe(hashes[at], level, k, size)
            at = at[(bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out[at] = level
    return out


def typical(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(levels > 1, 1.4 * np.exp2(levels.astype(np.float64) - 1), np.minimum(levels, 1).astype(np.float64))


def count(train: DataFrame, text: str, parts: int) -> DataFrame:
    """pairs (boolean), part, n, total, ends, data, counts: for tokens the sorted hashes and their counts, for pairs the
    slice of the filter. Tasks combine their own counts in blocks of bounded size, then send each part its share, packed."""

    def own(batches):
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def send(pairs):
            if not held[pairs]:
                return
            h, c = _combined(*(np.concatenate(x) for x in zip(*held[pairs])))
            held[pairs], size[pairs] = [], 0
            for p, a, b in dealt(h, HASH_BITS[pairs], parts):
                yield pairs, p, b - a, packed(steps(h[a:b])), packed(c[a:b].astype("<u8"))

        def rows(found):
            for block in _blocks(found):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*block), (pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["pairs", "part", "n", "hashes", "counts"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in runs_of([len(t or "") for t in texts], SLICE_CHARS):
                tokens, counts = _worker_words().tokens(texts[a:b])
                for pairs, h in ((False, tokens), (True, pair_hash(Words.before(tokens, counts), tokens))):
                    held[pairs].append(_combined(h, np.ones(len(h), np.int64)))
                    size[pairs] += len(held[pairs][-1][0])
                    if size[pairs] > COUNT_ENTRIES:
                        yield from rows(send(pairs))
        for pairs in (False, True):
            yield from rows(send(pairs))

    def meet(key, rows):
        hs, cs = [], []
        for n, h, c in zip(*(rows.column(x).to_pylist() for x in ("n", "hashes", "counts"))):
            hs.append(np.cumsum(unpacked(h, "<u8", n)))
            cs.append(unpacked(c, "<u8", n).astype(np.int64))
        h, c = _combined(np.concatenate(hs), np.concatenate(cs))
        pairs = key[0].as_py()
        numbers = (len(h), int(c.sum()), 0 if pairs else int(c[h == END].sum()))
        return pa.Table.from_arrays(
            [pa.array([pairs]), pa.array([key[1].as_py()], pa.int32()), *(pa.array([x], pa.int64()) for x in numbers), pa.array([build_slice(h, c) if pairs else h.tobytes()], pa.binary()), pa.array([b"" if pairs else c.astype("<i8").tobytes()], pa.binary())],
            names=["pairs", "part", "n", "total", "ends", "data", "counts"],
        )

    sent = train.select(F.col(quoted(text)).alias("text")).mapInArrow(own, "pairs boolean, part int, n long, hashes binary, counts binary")
    return sent.groupBy("pairs", "part").applyInArrow(meet, "pairs boolean, part int, n long, total long, ends long, data binary, counts binary")


def _blocks(rows, size: int = 256):
    block = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


class Model:
    """The written parts, one row each, and their totals."""

    def __init__(self, parts: DataFrame, n_parts: int):
        self.parts, self.n_parts = parts, n_parts
        sums = parts.filter("NOT pairs").agg(F.sum("n").alias("v"), F.sum("total").alias("n"), F.sum("ends").alias("ends")).first()
        self.v, self.n, self.texts = sums["v"] or 0, sums["n"] or 0, sums["ends"] or 0  # each text has one end, and one start


def train(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> Model:
    size = docs.agg(F.sum(F.octet_length(F.col(quoted(text))))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-size // part_bytes))
    return Model(materialise(count(docs, text, parts), "lm-counts"), parts)


def _counts(h: np.ndarray, c: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The counts of ``tokens`` in the sorted hashes ``h``."""
    if not len(h):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(h, tokens), len(h) - 1)
    return np.where(h[at] == tokens, c[at], 0)


def log_probabilities(c: np.ndarray, c_before: np.ndarray, pair: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    own = (c + 0.5) / (n + 0.5 * (v + 1))
    return np.log10(own), np.log10((pair + STRENGTH * own) / (np.maximum(c_before, pair) + STRENGTH))


def _pairs(known: np.ndarray, tokens: np.ndarray, sizes: np.ndarray):
    """Of texts' tokens as places in ``known``: the distinct pairs' sorted hashes, their first and second token's places
    (of the start: the end of ``known``), and each token's place among the pairs."""
    n = len(known)
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = n
    hashes, place, at = np.unique(pair_hash(np.append(known, START)[before], known[tokens]), return_index=True, return_inverse=True)
    return hashes, before[place], tokens[place], at


def _stream(columns: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, columns.schema) as out:
        out.write_batch(columns)
    return sink.getvalue().to_pybytes()


_MADE = "n_tokens long, n_known long, base_score double, score double, train_tokens long"
_NAMES = [f.split()[0] for f in _MADE.split(", ")]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens, n_known, base_score (tokens alone), score and train_tokens."""
    n, v, texts_n, parts = model.n, model.v, model.texts, model.n_parts
    kept = docs.select(*pass_through(docs, *_NAMES, text))

    def ask(batches):
        """Rows of a block: its own (part under 0) with its texts' tokens, and one for each part that it asks."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, others = batch.column(0).to_pylist(), batch.select(range(1, batch.num_columns))
            for a, b in runs_of([len(t or "") for t in rows], BLOCK_CHARS):
                tokens, sizes = _worker_words().tokens(rows[a:b])
                known, at = np.unique(tokens, return_inverse=True)
                pairs = _pairs(known, at, sizes)[0]
                own = [len(known), len(at), packed(steps(known)), packed(at.astype("<u4")), sizes.astype("<u4").tobytes()]
                out = [(number, False, -1 - number % 997, *own, _stream(others.slice(a, b - a)))]
                for which, hashes in ((False, known), (True, pairs)):
                    out += [(number, which, p, j - i, 0, packed(steps(hashes[i:j])), b"", b"", b"") for p, i, j in dealt(hashes, HASH_BITS[which], parts)]
                for some in _blocks(out):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=names)
                number += 1

    def answer(asked, slice_):
        """The asked rows with what the part has, in place of the hashes; blocks' own rows pass."""
        if not asked.num_rows or asked.column("part")[0].as_py() < 0:
            return asked
        data, counts = (slice_.column(c)[0].as_py() if slice_.num_rows else b"" for c in ("data", "counts"))
        counts = np.frombuffer(counts, "<i8")
        out = []
        for pairs, size, h in zip(*(asked.column(c).to_pylist() for c in ("pairs", "n", "data"))):
            h = np.cumsum(unpacked(h, "<u8", size))
            out.append(packed(levels(np.frombuffer(data, np.uint8), h) if pairs else _counts(np.frombuffer(data, "<u8"), counts, h).astype("<u8")))
        return asked.set_column(names.index("data"), "data", pa.array(out, pa.binary()))

    def finish(key, rows):
        which = rows.column("part").to_numpy()
        own, found = rows.filter(pa.array(which < 0)).to_pylist()[0], rows.filter(pa.array(which >= 0))
        known, tokens = np.cumsum(unpacked(own["data"], "<u8", own["n"])), unpacked(own["tokens"], "<u4", own["m"]).astype(np.int64)
        sizes = np.frombuffer(own["sizes"], "<u4").astype(np.int64)
        pairs, first, second, at = _pairs(known, tokens, sizes)
        by = {(w, p): x for w, p, x in zip(*(found.column(c).to_pylist() for c in ("pairs", "part", "data")))}
        c, level = np.zeros(len(known), "<u8"), np.zeros(len(pairs), np.uint8)
        for w, hashes, out in ((False, known, c), (True, pairs, level)):
            for p, i, j in dealt(hashes, HASH_BITS[w], parts):
                out[i:j] = unpacked(by[w, p], out.dtype.str, j - i)
        c = c.astype(np.int64)
        base, full = log_probabilities(c[second], np.append(c, texts_n)[first], typical(level), n, v)
        of = np.repeat(np.arange(len(sizes)), sizes)
        made = (sizes, split_sum((c[tokens] > 0).astype(np.int64), sizes), np.bincount(of, base[at], len(sizes)), np.bincount(of, full[at], len(sizes)), np.full(len(sizes), n))
        others = pa.ipc.open_stream(own["others"]).read_all()
        return pa.Table.from_arrays([*others.columns, *(pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())))], names=[*others.schema.names, *_NAMES])

    schema = "block long, pairs boolean, part int, n long, m long, data binary, tokens binary, sizes binary, others binary"
    names = [f.split()[0] for f in schema.split(", ")]
    asked = docs.select(F.col(quoted(text)).alias(spare(docs, "__text")), *pass_through(docs, *_NAMES, text)).mapInArrow(ask, schema)
    answers = asked.groupBy("pairs", "part").cogroup(model.parts.select("pairs", "part", "data", "counts").groupBy("pairs", "part")).applyInArrow(answer, schema)
    made = kept.withColumns({f.split()[0]: F.lit(None).cast(f.split()[1]) for f in _MADE.split(", ")}).schema
    return materialise(answers, "lm-answers").groupBy("block").applyInArrow(finish, made)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = score(docs.withColumn("held_out", held), train(docs.filter(~held)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
