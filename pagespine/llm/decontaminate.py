"""Benchmark decontamination by templates: re-parameterised questions match, if their slots do consistently.

Tokens are what white space separates, lower-cased, without punctuation at either end; tokens of nothing else are
left out. A token is a typed placeholder if it is a number (digits, or a number word), a unit of measure, or a name
(capitalised, not first in its sentence or line). A window is ``WINDOW`` tokens in sequence; an item with fewer tokens
is one window. Windows of documents and items are joined by hash, in two ways:
- as templates, if at least half of their ``SHORTEST`` or more tokens are no placeholders: the match is consistent if each value
  in a slot of the item always stands for the same value of the document and the other way round, within the window and
  over the stretch of adjacent windows that align the item with the document in the same way; each stretch is judged by
  itself;
- word for word, whatever their tokens are (numbers, units, names, or few) and whatever stands beside them.
A document with a match is contaminated.

Documents send a window on only if a filter of ``FILTER_BITS`` bits, which holds the items' hashes and is broadcast,
lets it through; the join by hash then decides. Items with equal tokens are one, with the least item_id.

Defined results: a null or empty text has no window and is clean; a null item, or one without tokens, matches nothing;
rows equal in id and text are one document and get equal verdicts; empty tables give no match; other columns pass
through, but those with the name of an output are replaced.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BATCH_ROWS, kept, materialise, maybe_in, pass_through, quoted, runs_of, spare, table, text_key

WINDOW, SHORTEST = 10, 6
FILTER_BITS = 1 << 26
SLICE_CHARS = 1 << 20
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent % °c °f degree degrees kb mb gb tb mph km/h m/s".split())
_NUMBER = re.compile(r"[+\-$€£#]*\d[\d.,:/%]*")
_EDGE = re.compile(r"^[^\w$€£%°+\-]+|[^\w%°]+$")
LITERAL, NUMBER, UNIT, NAME, NOTHING, BREAK = range(6)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Tokens:
    """Per worker: what each distinct raw token is, bounded in entries."""

    def __init__(self, limit: int = 400_000):
        from ._common import _Codes

        self.make, self.limit = _Codes, limit
        self.clear()

    def clear(self):
        self.codes = self.make()
        self.values: list[str] = []
        self.facts = np.empty((0, 4), np.int64)  # kind, hash of the literal, capitalised, ends a sentence

    def look_up(self, raw: list[str]):
        if len(self.codes) > self.limit:
            self.clear()
        at = np.fromiter(map(self.codes.__getitem__, raw), np.int64, len(raw))
        if self.codes.new:
            found = [self._facts(t) for t in self.codes.new]
            self.facts = np.concatenate((self.facts, np.array([x[1:] for x in found], np.int64)))
            self.values += [x[0] for x in found]
            self.codes.new = []
        return at, self.facts[at]

    @staticmethod
    def _facts(raw: str):
        import xxhash

        if raw == "\n":
            return "", BREAK, 0, 0, 1
        core = _EDGE.sub("", raw)
        if not core:
            return "", NOTHING, 0, 0, int(raw[-1:] in ".!?:;") if raw else 0
        low = core.lower()
        low = raw if low == raw else low  # one string for both
        kind = NUMBER if _NUMBER.fullmatch(core) or low in NUMBER_WORDS else UNIT if low in UNITS else LITERAL
        return low, kind, xxhash.xxh64_intdigest(low.encode("utf-8", "replace"), 3) - (1 << 63), int(core[0].isupper()), int(raw[-1] in ".!?:;")


def templates(texts: list[str | None], tokens: Tokens):
    """(doc, code, kind, symbol, word) of every token that counts; symbol is the hash of the literal, or the
    placeholder's number; word is the hash of the token itself."""
    raw, counts = [], []
    for t in texts:
        found = (t or "").replace("\n", " \n ").replace("\t", " ").replace("\r", " ").split(" ")
        raw += found
        counts.append(len(found))
    code, facts = tokens.look_up(raw)
    doc = np.repeat(np.arange(len(texts)), counts)
    kind, word, upper, ends = facts.T
    solid = (kind != NOTHING) | (ends == 1)  # blanks between tokens don't hide the end of a sentence
    code, doc, kind, word, upper, ends = (x[solid] for x in (code, doc, kind, word, upper, ends))
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (ends[:-1] == 1)
    kind = np.where((kind == LITERAL) & (upper == 1) & ~first, NAME, kind)
    real = kind < NOTHING
    code, doc, kind, word = code[real], doc[real], kind[real], word[real]
    return doc, code, kind, np.where(kind == LITERAL, word, kind).astype(np.int64), word


def rolling(symbol: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` symbols."""
    n = len(symbol) - size + 1
    h = np.full(n, np.uint64(size))
    s = symbol.view(np.uint64)
    for j in range(size):
        h ^= s[j : j + n]
        h *= _ODD
        h ^= h >> np.uint64(29)
    return h


def windows(doc: np.ndarray, kind: np.ndarray, symbol: np.ndarray, word: np.ndarray, size: int):
    """(start, exact, hash) of each window within a document: as a template if it has enough literals, and word for word."""
    n = len(doc) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    inside = doc[:n] == doc[size - 1 :]
    literals = np.concatenate(([0], np.cumsum(kind == LITERAL)))
    able = inside & (2 * (literals[size:] - literals[:n]) >= size) if size >= SHORTEST else np.zeros(n, bool)
    template, exact = np.flatnonzero(able), np.flatnonzero(inside)
    hashes = np.concatenate((rolling(symbol, size)[able] if size >= SHORTEST else np.empty(0, np.uint64), ~rolling(word, size)[inside]))
    return np.concatenate((template, exact)), np.repeat([False, True], (len(template), len(exact))), hashes.view(np.int64)


def _worker_tokens() -> Tokens:
    return kept("decontaminate", Tokens)


_ROW = "at int, size int, exact boolean, window long, slots array<string>"


def _rows(texts, keep, sizes):
    """Window rows (which text, at, size, exact, window, slots) whose hash ``keep`` lets through."""
    tokens = _worker_tokens()
    for a, b in runs_of([len(t or "") for t in texts], SLICE_CHARS):
        doc, code, kind, symbol, word = templates(texts[a:b], tokens)
        starts = np.searchsorted(doc, np.arange(b - a))
        for size in sizes:
            at, exact, h = windows(doc, kind, symbol, word, size)
            some = keep(h)
            at, exact, h = at[some], exact[some], h[some]
            slots = [[] if e else [f"{kind[i]}:{tokens.values[code[i]]}" for i in range(x, x + size) if kind[i] != LITERAL] for x, e in zip(at.tolist(), exact.tolist())]
            yield a + doc[at], [pa.array(at - starts[doc[at]], pa.int32()), pa.array([size] * len(at), pa.int32()), pa.array(exact), pa.array(h, pa.int64()), pa.array(slots, pa.list_(pa.string()))]


_ROW_NAMES = ["at", "size", "exact", "window", "slots"]


def item_windows(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, at, size, exact, window, slots: the windows of each distinct item."""

    def cut(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            lengths = np.bincount(templates(texts, _worker_tokens())[0], minlength=len(texts)) if texts else []
            for size in range(1, WINDOW + 1):
                mine = [i for i, n in enumerate(lengths) if min(n, WINDOW) == size]
                for of, columns in _rows([texts[i] for i in mine], lambda h: np.ones(len(h), bool), [size]):
                    own = pa.array([mine[i] for i in of], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(own), *columns], names=["item_id", *_ROW_NAMES])

    distinct = items.select(F.col(quoted(text)).alias("text"), F.col(quoted(item_id)).alias("item_id")).filter("text IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id"))
    kind = items.schema[item_id].dataType.simpleString()
    return distinct.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, {_ROW}")


_filters: dict = {}


def document_windows(docs: DataFrame, wanted: DataFrame, sizes: list[int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, key, at, size, exact, window, slots: the documents' windows that may be among ``wanted``'s.

    The filter has one bit for each of ``FILTER_BITS`` values of a hash; its words are made in Spark, and only those
    with a bit set are gathered: at most ``FILTER_BITS`` / 64, whatever the number of items.
    """
    words = wanted.selectExpr(f"pmod(window, {FILTER_BITS}L) AS at").selectExpr("at div 64 AS word", "shiftleft(1L, int(at % 64)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    shared, name = docs.sparkSession.sparkContext.broadcast((words.column("word").to_numpy(), words.column("bits").to_numpy())), uuid.uuid4().hex

    def keep(h):
        if name not in _filters:
            _filters.clear()
            bits = np.zeros(FILTER_BITS // 64, np.int64)
            word, own = shared.value
            bits[word] = own
            _filters[name] = bits.view(np.uint8)
        at = h & (FILTER_BITS - 1)
        return (_filters[name][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def cut(batches):
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for of, columns in _rows(texts, keep, sizes):
                of = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(of), keys.take(of), *columns], names=["doc", "key", *_ROW_NAMES])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(quoted(doc_id)).alias("doc"), text_key(text).alias("key"), F.col(quoted(text)).alias("text")).mapInArrow(cut, f"doc {kind}, key long, {_ROW}")


def one_to_one(pairs: str) -> str:
    """Whether an array of (a, b) pairs maps each a to one b and each b to one a."""
    return f"(size(array_distinct({pairs})) = size(array_distinct(transform({pairs}, p -> p.a))) AND size(array_distinct({pairs})) = size(array_distinct(transform({pairs}, p -> p.b))))"


def matches(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc, key, item_id, tokens: the matches, with how many tokens of the item the longest stretch covers."""
    own = materialise(item_windows(items, item_text, item_id), "item-windows")
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())
    theirs = document_windows(docs, own.select("window").distinct(), sizes, text, doc_id)
    own = own.select("item_id", F.col("at").alias("item_at"), "size", "exact", "window", F.col("slots").alias("item_slots"))
    met = theirs.join(own, ["window", "size", "exact"]).withColumn("pairs", F.expr("zip_with(item_slots, slots, (a, b) -> named_struct('a', a, 'b', b))"))
    met = materialise(met.filter("size(item_slots) = size(slots)").filter(F.expr(one_to_one("pairs"))).select("doc", "key", "item_id", "size", "exact", "item_at", (F.col("at") - F.col("item_at")).alias("offset"), "pairs"), "met-windows", BATCH_ROWS)
    # a stretch: adjacent windows of one item at one alignment; a document's windows of an item are at most the item's own for each alignment
    placed = Window.partitionBy("doc", "key", "item_id", "size", "exact", "offset").orderBy("item_at")
    stretches = met.withColumn("stretch", F.sum((F.coalesce(F.col("item_at") - F.lag("item_at").over(placed), F.lit(2)) > 1).cast("int")).over(placed))
    runs = stretches.groupBy("doc", "key", "item_id", "size", "exact", "offset", "stretch").agg(F.min("item_at").alias("a"), F.max("item_at").alias("b"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    covered = F.col("b") - F.col("a") + F.col("size")
    return runs.filter(F.expr(one_to_one("pairs"))).groupBy("doc", "key", "item_id").agg(F.max(covered).cast("long").alias("tokens"))


def flag(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", items_out: str = "item_ids", tokens_out: str = "matched_tokens") -> DataFrame:
    """``docs`` with the ids of the items found in each (empty: clean) and the most tokens that one item matches.

    Verdicts are joined by id and text hash to the rows that they may concern; other rows are not shuffled.
    """
    doc, key, found, most, at, may = (spare(docs, f"__{x}") for x in ("doc", "key", "items", "tokens", "at", "may"))
    made = matches(docs, items, text, doc_id, item_text, item_id)
    verdicts = materialise(made.groupBy("doc", "key").agg(F.array_sort(F.collect_set("item_id")).alias(found), F.max("tokens").alias(most)).withColumnsRenamed({"doc": doc, "key": key}), "contaminated")
    marked = maybe_in(docs.withColumn(at, text_key(text)), f"xxhash64({quoted(doc_id)}, `{at}`)", verdicts, f"xxhash64(`{doc}`, `{key}`)", may)
    some = marked.filter(may).join(verdicts, F.col(quoted(doc_id)).eqNullSafe(F.col(doc)) & (F.col(at) == F.col(key)), "left")
    none, zero = F.array().cast(verdicts.schema[found].dataType), F.lit(0).cast("long")
    columns = pass_through(docs, items_out, tokens_out)
    clean = marked.filter(~F.col(may)).select(*columns, none.alias(items_out), zero.alias(tokens_out))
    return clean.unionByName(some.select(*columns, F.coalesce(F.col(found), none).alias(items_out), F.coalesce(F.col(most), zero).alias(tokens_out)))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return flagged.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "matched_tokens")
