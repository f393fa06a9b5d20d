"""Source divergence audit: how far the word use of each source of a language lies from the others', term by term.

Terms are runs of letters a-z and characters beyond ASCII, after lower-casing A-Z. A language keeps the terms that stand
in ``min_docs`` of its documents or more: V of them. A group (a source's documents of one language) gives each kept term
the share p = 1 + floor(1e9 (count + 2) / (N + 2 V)), N being the group's count over kept terms; two shares differ by
floor((p - q)^2 / (p + q)). All of that is integer arithmetic.

A pair of groups sums the differences of all kept terms by a heavy-light split. Terms that many groups have
(``heavy_quarters`` quarters of the language's groups or more) go into dense numpy tiles, terms by groups. For the light ones a
group without the term has a share that depends on the group alone, so the sum starts from the number of light terms
times the difference of these base shares, and sparse posting pairs correct it: a histogram of each group's counts of
light terms corrects for terms that one side has, and each two postings of a term for those that both have. Both
partial sums are integers and are added exactly; the split changes no result. Tiles hold 128 groups and a bounded
number of terms, so a task is bounded whatever the corpus; a language's tile pairs and parts are dealt over the cluster.

Terms are counted in blocks of text before the shuffle, then by (language, source, term) and gathered by (language,
term) into lists with one entry a group. The table of groups is joined by broadcast while it is at most 200,000 rows and
32 MB, and by a shuffle beyond that.

Defined results: null text, language and source are read as empty. Every (language, source) that occurs is a group, also
without terms; a language without kept terms has differences of 0. Repeated rows count each. An empty table gives no rows.
Other columns of the documents are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, quoted, table
from ._words import blocks, numbered_words, separators

MIN_DOCS, TOP = 10, 10
TILE = 128
#: Heavy terms and light terms of one part of a tile pair.
HEAVY_ROWS, LIGHT_ROWS = 2048, 65_536
GROUP_ROWS, GROUP_BYTES = 200_000, 32 << 20
TERM_TABLE = separators(b"abcdefghijklmnopqrstuvwxyz")
BLOCK = 8 << 20


def share(x, d):
    """1 + floor(1e9 x / d) in steps of 1000, so that nothing passes 64 bits while d is below 9e15; 1 where d is 0."""
    x, d = np.asarray(x, np.int64), np.asarray(d, np.int64)
    safe, rest, out = np.maximum(d, 1), np.where(d > 0, x, 0), 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // safe, rest % safe
    return 1 + out


def share_sql(x: str, d: str) -> str:
    """The same as SQL over longs."""
    a, b = f"(1000 * ({x}) % {d})", f"(1000 * (1000 * ({x}) % {d}) % {d})"
    return f"1 + (1000 * ({x}) div {d}) * 1000000 + (1000 * {a} div {d}) * 1000 + 1000 * {b} div {d}"


def differ(p, q):
    return (p - q) * (p - q) // (p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) from (lang, source, text as bytes), counted by blocks and then summed."""

    def run(batches):
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            for start, end in blocks(texts, BLOCK):
                words, ids, sizes = numbered_words(texts[start:end], TERM_TABLE)
                if not words:
                    continue
                groups = {}
                group = np.fromiter((groups.setdefault(x, len(groups)) for x in names[start:end]), np.int64, end - start)
                # each document's distinct terms, then each group's
                own, n = np.unique(np.repeat(np.arange(end - start), sizes) * len(words) + ids, return_counts=True)
                keys, back = np.unique(group[own // len(words)] * len(words) + own % len(words), return_inverse=True)
                counts, found = np.zeros(len(keys), np.int64), np.bincount(back, minlength=len(keys))
                np.add.at(counts, back, n)
                whose, which = keys // len(words), keys % len(words)
                langs, sources = (pa.DictionaryArray.from_arrays(pa.array(whose, pa.int64()), pa.array([g[i] for g in groups], pa.string())).cast(pa.string()) for i in (0, 1))
                terms = pa.DictionaryArray.from_arrays(pa.array(which, pa.int64()), pa.array([w.decode() for w in words], pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(counts), pa.array(found, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    made = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if small else groups, on)


def tile_sums(batch: pa.Table, width: int) -> pa.Table:
    """One part of one tile pair of one language: (lang, i, j, value) for its pairs of groups i < j.

    Rows by kind: 0 the groups of a tile (ids, their denominators, and how many light terms there are), 1 a heavy term's
    counts in a tile, 2 how many light terms of a group have a count, 3 a light term's counts in both tiles.
    """
    lang, a, b, part = (batch.column(x)[0].as_py() for x in ("lang", "a", "b", "part"))
    kinds, tiles = batch.column("kind").to_numpy(), batch.column("tile").to_numpy()
    lists, x, y = (batch.column(k).to_pylist() for k in ("ids", "x", "y"))
    ids, below, base = {}, {}, {}
    for r in np.flatnonzero(kinds == 0):
        order = np.argsort(lists[r])
        ids[tiles[r]], below[tiles[r]] = np.array(lists[r], np.int64)[order], np.array(x[r], np.int64)[order]
        base[tiles[r]], light = share(2, below[tiles[r]]), y[r][0]
    total = np.zeros((len(ids[a]), len(ids[b])), np.int64)
    if part == 0:
        total += light * differ(base[a][:, None], base[b][None, :])
    # heavy terms: dense tiles
    heavy = {}
    rows = np.flatnonzero(kinds == 1)
    if len(rows):
        names = batch.column("term").take(pa.array(rows)).to_pylist()
        place = {t: k for k, t in enumerate(dict.fromkeys(names))}
        for tile in {a, b}:
            heavy[tile] = np.zeros((len(place), len(ids[tile])), np.int64)
        for r, t in zip(rows, names):
            heavy[tiles[r]][place[t], np.searchsorted(ids[tiles[r]], lists[r])] = x[r]
        p, q = (share(heavy[k] + 2, below[k][None, :]) for k in (a, b))
        for i in range(len(ids[a])):
            total[i] += differ(p[:, i : i + 1], q).sum(axis=0)
    # light terms that one side has
    for r in np.flatnonzero(kinds == 2):
        tile = tiles[r]
        i = int(np.searchsorted(ids[tile], lists[r][0]))
        p = share(x[r][0] + 2, below[tile][i])
        if tile == a:
            total[i] += y[r][0] * (differ(p, base[b]) - differ(base[a][i], base[b]))
        if tile == b:
            total[:, i] += y[r][0] * (differ(p, base[a]) - differ(base[b][i], base[a]))
    # light terms that both have
    rows = np.flatnonzero(kinds == 3)
    sizes = np.array([len(lists[r]) for r in rows], np.int64)
    for size in np.unique(sizes):
        chosen = rows[sizes == size]
        who, n = np.array([lists[r] for r in chosen], np.int64), np.array([x[r] for r in chosen], np.int64)
        for u in range(size):
            for v in range(size):
                take = (who[:, u] < who[:, v]) & (who[:, u] // width == a) & (who[:, v] // width == b)
                if take.any():
                    i, j = np.searchsorted(ids[a], who[take, u]), np.searchsorted(ids[b], who[take, v])
                    p, q, bp, bq = share(n[take, u] + 2, below[a][i]), share(n[take, v] + 2, below[b][j]), base[a][i], base[b][j]
                    np.add.at(total, (i, j), differ(p, q) - differ(p, bq) - differ(bp, q) + differ(bp, bq))
    i, j = np.nonzero(ids[a][:, None] < ids[b][None, :])
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "i": pa.array(ids[a][i], pa.int64()), "j": pa.array(ids[b][j], pa.int64()), "value": pa.array(total[i, j], pa.int64())})


def pair_sums(postings: DataFrame, groups: DataFrame, small: bool, heavy_quarters: int = 1) -> DataFrame:
    """(lang, i, j, value) for all pairs i < j of a language's groups.

    ``postings``: (lang, term, groups, list of (id, n)); ``groups``: (lang, id, below, terms) with the language's V in
    ``terms``.
    """
    of_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    split = with_groups(postings, of_lang, ["lang"], small).withColumn("heavy", F.expr(f"4 * size(list) >= {heavy_quarters} * size"))
    split = materialise(split, "divergence-split")
    light = split.filter("NOT heavy")
    n = split.agg(F.count(F.when(F.col("heavy"), 1)).alias("h"), F.count(F.when(~F.col("heavy"), 1)).alias("l")).first()
    parts = max(1, -(-n["h"] // HEAVY_ROWS), -(-n["l"] // LIGHT_ROWS))
    part = F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int")
    tile = F.expr(f"CAST(id div {TILE} AS INT)")
    tiles = F.expr(f"CAST((size - 1) div {TILE} AS INT)")  # the last one

    def both(rows: DataFrame) -> DataFrame:
        """Each row of a tile once for every pair that the tile is in."""
        others = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        return others.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})

    columns = ["lang", "a", "b", "part", "kind", "term", "tile", "ids", "x", "y"]
    none = F.array().cast("array<bigint>")
    counts = light.groupBy("lang").agg(F.count(F.lit(1)).alias("light"))
    base = groups.join(of_lang, "lang").join(counts, "lang", "left").groupBy("lang", tile.alias("tile"), tiles.alias("last"), F.coalesce("light", F.lit(0)).alias("light")).agg(F.collect_list(F.struct("id", "below")).alias("all"))
    base = base.select("lang", "tile", "last", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit("").alias("term"), F.col("all.id").alias("ids"), F.col("all.below").alias("x"), F.array("light").alias("y"))
    dense = split.filter("heavy").select("lang", "term", part.alias("part"), tiles.alias("last"), "list", F.explode(F.sequence(F.lit(0), tiles)).alias("tile"))
    dense = dense.withColumn("list", F.expr(f"filter(list, e -> e.id div {TILE} = tile)")).select("lang", "tile", "last", "part", F.lit(1).alias("kind"), "term", F.col("list.id").alias("ids"), F.col("list.n").alias("x"), none.alias("y"))
    one = light.select("lang", tiles.alias("last"), F.explode("list").alias("e")).groupBy("lang", "last", "e.id", "e.n").agg(F.count(F.lit(1)).alias("terms"))
    one = one.select("lang", tile.alias("tile"), "last", F.pmod(F.xxhash64("id", "n"), F.lit(parts)).cast("int").alias("part"), F.lit(2).alias("kind"), F.lit("").alias("term"), F.array("id").alias("ids"), F.array("n").alias("x"), F.array("terms").alias("y"))
    two = light.filter("size(list) > 1").withColumn("at", F.array_distinct(F.expr(f"transform(list, e -> CAST(e.id div {TILE} AS INT))")))
    two = two.withColumn("a", F.explode("at")).withColumn("b", F.explode("at")).filter("a <= b")
    two = two.withColumn("list", F.expr(f"filter(list, e -> e.id div {TILE} IN (a, b))")).select("lang", "a", "b", part.alias("part"), F.lit(3).alias("kind"), "term", F.col("a").alias("tile"), F.col("list.id").alias("ids"), F.col("list.n").alias("x"), none.alias("y"))
    rows = two.select(*columns)
    for more in (base, dense, one):
        rows = rows.unionByName(both(more).select(*columns))
    width = TILE
    made = rows.groupBy("lang", "a", "b", "part").applyInArrow(lambda batch: tile_sums(batch, width), "lang string, i long, j long, value long")
    return made.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, heavy_quarters: int = 1) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for each other source of the language, all ranks; part
    ``term`` for the terms that the source uses more than its language does, to rank ``top``."""
    names = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    known = docs.select(*names).distinct().withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    known = materialise(known, "divergence-groups")
    n = known.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source")), F.lit(0)).alias("bytes")).first()
    small = n["rows"] <= GROUP_ROWS and n["bytes"] <= GROUP_BYTES
    counts = with_groups(term_counts(docs.select(*names, F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary").alias("text"))), known, ["lang", "source"], small)
    postings = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.collect_list(F.struct("id", "n")).alias("list"))
    postings = materialise(postings.filter(F.col("docs") >= min_docs).drop("docs"), "divergence-postings")
    of_lang = postings.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("lang_n"))
    entries = postings.select("lang", "term", "all_n", F.inline("list"))
    sums = entries.groupBy("lang", "id").agg(F.sum("n").alias("group_n"))
    groups = known.join(sums, ["lang", "id"], "left").join(of_lang, "lang", "left").na.fill(0, ["group_n", "terms", "lang_n"])
    groups = materialise(groups.select("lang", "source", "id", F.expr("group_n + 2 * terms").alias("below"), F.expr("lang_n + 2 * terms").alias("lang_below")), "divergence-sums")
    own = with_groups(entries, groups.drop("source"), ["lang", "id"], small)
    own = own.withColumns({"p": F.expr(share_sql("n + 2", "below")), "q": F.expr(share_sql("all_n + 2", "lang_below"))}).filter("p > q")
    best = Window.partitionBy("lang", "id").orderBy(F.desc("value"), "term")
    terms = own.select("lang", "id", "term", F.expr("(p - q) * (p - q) div (p + q)").alias("value")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    terms = with_groups(terms, groups.select("lang", "id", "source"), ["lang", "id"], small).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    pairs = pair_sums(postings.select("lang", "term", "list"), groups, small, heavy_quarters)
    sides = pairs.select("lang", F.inline(F.array(F.struct(F.col("i").alias("id"), F.col("j").alias("other")), F.struct(F.col("j").alias("id"), F.col("i").alias("other")))), "value")
    named = with_groups(sides, groups.select("lang", "id", "source"), ["lang", "id"], small)
    named = with_groups(named, groups.select("lang", F.col("id").alias("other"), F.col("source").alias("item")), ["lang", "other"], small)
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranks).alias("rank")).unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
langs AS (SELECT d.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM docs) d LEFT JOIN kept k USING (lang) GROUP BY d.lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT d.lang, d.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.n + 2 * l.v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v))::HUGEINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every) WHERE part = 'pair' OR rank <= {TOP}
"""
