"""SimHash near-duplicates through an inverted index over byte positions with count filtering.

A fingerprint has 8 bytes. Two that differ in at most 2 bits share at least 6 positional bytes: the guaranteed count.
A tally over lists of single bytes would emit all pairs of a list, each of which holds 1/256 of all fingerprints, so
the index has one posting list for each combination of 6 positions and their bytes: whoever meets there has reached
the count of 6 without being tallied in any other list. Within a list only the 2 other bytes differ, so it
holds at most 65,536 distinct fingerprints, whatever the corpus. A list is verified by looking up, for each member,
the 136 values at 1 or 2 bits from its own in a table of those 16 bits, and yields a spanning forest of its links,
at most one per member, rather than all pairs. Copies with equal fingerprints are one entry.

Fingerprints take shingles of ``shingle`` words, after lower-casing A-Z; words are runs of characters other than
space and U+0009 to U+000D; a bit is set if it is set in over half of the shingles' XXH64 (seed 42). Defined
results: a text that is null or has no word gets fingerprint zero and is linked like any other; fewer words than a
shingle has are one shingle; repeated shingles count as often as they occur. A component's id is its smallest
doc_id; null ids are ignored unless all are null, which gives null. ``near_duplicates`` returns ids, fingerprints and components only;
``with_fingerprint`` keeps other columns but one with its output's name; ``keep_one`` returns the columns that it gets.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BATCH_ROWS, join_counted, materialise, maybe_in, quoted, runs_of, shuffle_partitions, spare, table, text_key
from ._components import components

BYTES, MAX_BITS = 8, 2
SHARED = BYTES - MAX_BITS
SLICE_CHARS = 1 << 20
#: For similar shingles: bytes of a signature, positions of a posting list's key, the least tally; the longest list that one task
#: compares, the longest whose members are offered each other at first, and a block's texts and shingles; how many candidates a text is
#: offered at first; the pairs of one text that are verified together.
POSITIONS, RUN, MIN_SHARED, LIST, WIDE, BLOCK, BLOCK_SHINGLES, OFFERS, STAR = 64, 4, 38, 256, 4096, 1024, 1 << 19, 8, 2048


def fingerprints(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in runs_of([len(t or "") for t in texts], SLICE_CHARS):
        hashes, counts = [], []
        for t in texts[a:b]:
            words = (t or "").encode("utf-8", "surrogatepass").lower().split()
            n = len(words)
            if n == 0:
                counts.append(0)
                continue
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            k = min(shingle, n)
            starts = np.concatenate(([0], ends[: n - k] + 1)).tolist()
            hashes += [digest(joined[i:j], 42) for i, j in zip(starts, ends[k - 1 :].tolist())]
            counts.append(n - k + 1)
        h = np.array(hashes, np.uint64)
        counts = np.array(counts, np.int64)
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(counts) - counts)[some]
        set_in = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = (2 * set_in > counts[some, None]).astype(np.uint8)
        out[a + some] = np.packbits(over, axis=1).view(">u8").ravel()
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """Adds the fingerprint of ``text`` as a long."""

    @F.arrow_udf("long")
    def mark(column: pa.Array) -> pa.Array:
        return pa.array(fingerprints(column.to_pylist(), shingle), pa.int64())

    return docs.withColumn(out, mark(F.col(text)))


def _flips() -> np.ndarray:
    one = [1 << i for i in range(16)]
    return np.array(one + [x | y for x, y in combinations(one, 2)], np.int64)


def _forest(own: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct 16-bit values, as pairs of places in ``own``."""
    place = np.full(1 << 16, -1, np.int32)
    place[own] = np.arange(len(own))
    if len(own) <= 136:
        pairs = [(i, int(j)) for i in range(len(own)) for j in i + 1 + np.flatnonzero(np.bitwise_count(own[i] ^ own[i + 1 :]) <= MAX_BITS)]
    else:
        pairs = []
        for flip in _flips():
            j = place[own ^ flip]
            i = np.flatnonzero(j > np.arange(len(own)))
            pairs += zip(i.tolist(), j[i].tolist())
    head = list(range(len(own)))

    def find(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    out = []
    for i, j in pairs:
        x, y = find(i), find(j)
        if x != y:
            head[y] = x
            out.append((i, j))
    return out


def links(marks: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """(a, b): links that connect all distinct fingerprints at 2 or fewer differing bits."""
    value = F.col("f")
    postings = []
    for number, kept in enumerate(combinations(range(BYTES), SHARED)):
        mask = sum(0xFF << 8 * i for i in kept)
        mask -= (mask >> 63) << 64
        postings.append(F.struct(F.lit(number).cast("byte").alias("positions"), value.bitwiseAND(F.lit(mask)).alias("shared")))
    # few bytes make many postings, so they are dealt to all tasks whatever their size
    distinct = marks.select(F.col(fingerprint).alias("f")).repartition(shuffle_partitions(marks.sparkSession), "f").distinct()
    index = distinct.select("f", F.explode(F.array(*postings)).alias("key"))
    lists = index.groupBy("key.positions", "key.shared").agg(F.collect_list("f").alias("members")).filter("size(members) > 1")

    masks = list(combinations(range(BYTES), SHARED))

    def verify(batches):
        for batch in batches:
            a, b = [], []
            for positions, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = np.sort(members.values.to_numpy(zero_copy_only=False))
                low, high = (8 * i for i in range(BYTES) if i not in masks[positions])
                own = ((f >> low) & 0xFF) | (((f >> high) & 0xFF) << 8)
                for i, j in _forest(own):
                    a.append(f[i])
                    b.append(f[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.select("positions", "members").mapInArrow(verify, "a long, b long").distinct()


def groups(marks: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """One row for each distinct fingerprint: fingerprint, root (its component's smallest one), component_id, rows."""
    own = materialise(marks.groupBy(fingerprint).agg(F.min(doc_id).alias("least_id"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    roots = components(links(own, fingerprint))
    rooted = own.join(roots.withColumnRenamed("node", fingerprint), fingerprint, "left").withColumn("root", F.coalesce("root", fingerprint))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.select(fingerprint, "root", "rows").join(ids, "root").select(fingerprint, "root", "component_id", "rows")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``docs`` without the text: ``doc_id``, fingerprint (long), and component_id of every row."""
    marks = materialise(with_fingerprint(docs.select(doc_id, text), text, shingle=shingle).drop(text), "fingerprints")
    found = materialise(groups(marks, doc_id), "fingerprint-groups")
    return join_counted(marks, found, "fingerprint", "rows").select(doc_id, "fingerprint", "component_id")


# Documents whose shingles are similar: the same index over byte positions, with signatures that follow the similarity.


def shingle_hashes(text: str | None, shingle: int) -> tuple[bytes, np.ndarray]:
    """The joined lower-case words of a text, and the 64-bit hashes of its shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return b"", np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    k = min(shingle, n)
    starts = np.concatenate(([0], ends[: n - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return joined, np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, ends[k - 1 :].tolist())), np.uint64, n - k + 1)


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each position, by which its order of shingles is made."""
    x = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"%d" % i) for i in range(POSITIONS)), np.uint32).reshape(POSITIONS, 4)
    return x[:, 0].copy(), x[:, 1] | np.uint32(1)


def signatures(texts: list[str | None], shingle: int) -> tuple[list[bytes], list[bytes], list[int]]:
    """A key of each text's word sequence, its signature of ``POSITIONS`` bytes, and its number of distinct shingles.

    At each position stands the byte of the shingle that comes first in the position's own order. Two texts share a
    position's byte about as often as a shingle of either is one of both."""
    keys, marks, distinct = [], [], []
    salts, factors = _orders()
    for a, b in runs_of([len(t or "") for t in texts], SLICE_CHARS):
        found = [shingle_hashes(t, shingle) for t in texts[a:b]]
        keys += [xxhash.xxh3_128_digest(x) for x, _ in found]
        h = [np.unique(x) if len(x) else np.zeros(1, np.uint64) for _, x in found]
        distinct += map(len, h)
        starts = np.cumsum([0, *map(len, h)])[:-1]
        low = (np.concatenate(h) >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(h), POSITIONS), np.uint8)
        for i, (salt, factor) in enumerate(zip(salts, factors)):
            first = np.minimum.reduceat((low ^ salt) * factor, starts)
            first = (first ^ (first >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out[:, i] = (first * np.uint32(0x9E3779B1)) >> np.uint32(24)
        marks += [x.tobytes() for x in out]
    return keys, marks, distinct


def _offers(one: dict, two: dict, percent: int, most: int) -> tuple[list, list, list]:
    """For each member of ``one`` the best ``most`` candidates in ``two`` of other groups: who shares ``MIN_SHARED`` bytes or more
    and has a size that allows the similarity, those that share most first."""
    a, b, n = [], [], []
    signs, sizes, ids, roots = two["signs"], two["sizes"], two["ids"], two["roots"]
    for uid, sign, size, root in zip(one["ids"], one["signs"], one["sizes"], one["roots"]):
        shared = (signs == sign).sum(axis=1)
        near = np.flatnonzero((shared >= MIN_SHARED) & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)) & (roots != root))
        best = near[np.argsort(-shared[near], kind="stable")[:most]]
        a += [uid] * len(best)
        b += [ids[k] for k in best.tolist()]
        n += shared[best].tolist()
    return a, b, n


def _members(rows: list[dict]) -> dict:
    rows = sorted(rows, key=lambda m: (m["sign"], m["uid"]))
    return {
        "ids": [m["uid"] for m in rows], "signs": np.frombuffer(b"".join(m["sign"] for m in rows), np.uint8).reshape(-1, POSITIONS), "sizes": np.array([m["size"] for m in rows], np.int64),
        "roots": np.array([m["root"] for m in rows], object),
    }


def _offered(found: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary()), pa.array(found[2], pa.int32())], names=["a", "b", "shared"])


def _list_offers(percent: int, most: int):
    def run(batches):
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            for row in batch.column(0):
                own = _members(row.as_py())
                for all_, more in zip(found, _offers(own, own, percent, most)):
                    all_ += more
                if len(found[0]) > 20_000:
                    yield _offered(found)
                    found = ([], [], [])
            yield _offered(found)

    return run


def _block_offers(percent: int, most: int):
    """Of two blocks of one list, in ``side`` 0 and 1, what the first one's members are offered of the second one's."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["side", "uid", "sign", "size", "root"]).to_pylist()
        one, two = ([m for m in rows if m["side"] == k] for k in (0, 1))
        return pa.Table.from_batches([_offered(_offers(_members(one), _members(two), percent, most) if one and two else ([], [], []))])

    return run


def _shared_bytes(x: pa.Array, y: pa.Array) -> pa.Array:
    a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in (x, y))
    return pa.array((a == b).sum(axis=1, dtype=np.int32), pa.int32())


def _cell_links(percent: int):
    """The links between members of ``side`` 0 and 1 (2: both) of one list, by all candidates that are of different groups
    and not linked here already; each pair where its first equal run is the list's. Two members that are ``other`` meet from either side."""

    def run(table: pa.Table) -> pa.Table:
        side, own, size, other = (table[c].to_numpy() for c in ("side", "run", "size", "other"))
        ids, size = table["uid"].to_pylist(), size.astype(np.int64)
        rank = np.unique(np.array(ids, object), return_inverse=True)[1]
        group = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1]
        sign = np.frombuffer(b"".join(table["sign"].to_pylist()), np.uint8).reshape(-1, POSITIONS)
        pieces = sign.reshape(-1, POSITIONS // RUN, RUN)
        lists = table["shingles"].combine_chunks()
        codes = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True)[1]
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        ends, mark, two = np.cumsum(counts), np.zeros(len(codes) + 1, bool), np.flatnonzero(side >= 1)
        a, b = [], []
        for x in np.flatnonzero(side != 1).tolist():
            at = two[(group[two] != group[x]) & ~(other[two] & (rank[two] < rank[x])) & (100 * np.minimum(size[two], size[x]) >= percent * np.maximum(size[two], size[x]))]
            at = at[(sign[at] == sign[x]).sum(axis=1) >= MIN_SHARED]
            at = at[((pieces[at] == pieces[x]).all(axis=2).argmax(axis=1) == own[x]) & (counts[at] > 0)]
            if not len(at):
                continue
            mine = codes[ends[x] - counts[x] : ends[x]]
            mark[mine] = True
            n = counts[at]
            starts = np.cumsum(n) - n
            place = np.repeat(ends[at] - n - starts, n) + np.arange(int(n.sum()))
            common = np.add.reduceat(mark[codes[place]], starts, dtype=np.int64)
            mark[mine] = False
            for y in at[100 * common >= percent * (counts[x] + n - common)].tolist():
                if group[x] != group[y]:
                    a.append(ids[x])
                    b.append(ids[y])
                    group[group == group[y]] = group[x]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def similar_groups(signs: DataFrame, links: DataFrame, verify, shingles, percent: int) -> DataFrame:
    """(node, root) of all groups of (uid, sign, size), by candidates that ``verify`` lets pass; ``links`` are sure already.
    ``shingles`` returns (uid, shingles) of the uids that it is given, and maybe more.

    A list holds the signatures with equal bytes at ``RUN`` positions; members that share ``MIN_SHARED`` bytes and have sizes that
    allow the similarity are candidates. First each member is offered its ``OFFERS`` best candidates of other groups (of lists
    longer than ``WIDE`` the list's first member only); offers are verified, the good ones join groups. That tests every candidate
    of a member that has no more of them. The members that do have more, and those of longer lists, are then compared with one
    another in every list that still holds several of the groups, whatever its length: all candidates of different groups are
    verified where they meet, in blocks of bounded size, so no candidate of two groups is left untested. Of a long list those
    outside its most common group are compared with all, so blocks go with their number times the list's length.
    """
    runs = POSITIONS // RUN
    edges, roots = materialise(links, "similar-links"), None
    if edges.take(1):
        roots = components(edges)

    def labelled(df: DataFrame) -> DataFrame:
        if roots is None:
            return df.withColumn("root", F.col("uid"))
        return df.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))

    def join_groups(good: DataFrame) -> None:
        nonlocal edges, roots
        if good.take(1):
            edges = edges.unionByName(good)
            roots = components(edges)

    def listed(df: DataFrame) -> DataFrame:
        """Members of all lists that hold several groups, with the list's ``n`` members and ``weight`` of shingles."""
        keys = F.array(*[F.struct(F.lit(i).alias("run"), F.xxhash64(F.lit(i), F.substring("sign", i * RUN + 1, RUN)).alias("key")) for i in range(runs)])
        posts = df.select("uid", "sign", "size", "root", F.explode(keys).alias("k")).select("uid", "sign", "size", "root", "k.*")
        sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key", "n", "weight")
        sizes = materialise(sizes, "list-sizes")
        return materialise(join_counted(maybe_in(posts, "key", sizes, "key", "__may").filter("__may").drop("__may"), sizes, "key", "n"), "lists")

    def star(df: DataFrame) -> DataFrame:
        heads = df.groupBy("key").agg(F.min(F.struct("sign", "uid", "size")).alias("head"), F.count(F.lit(1)).alias("n"))
        met = join_counted(df.drop("n"), heads, "key", "n").filter("uid <> head.uid").filter(f"100 * least(size, head.size) >= {percent} * greatest(size, head.size)")
        met = met.withColumn("shared", F.arrow_udf(_shared_bytes, "int")("sign", "head.sign")).filter(F.col("shared") >= MIN_SHARED)
        return met.select(F.col("uid").alias("a"), F.col("head.uid").alias("b"), "shared")

    def blocks(df: DataFrame, most: int) -> DataFrame:
        cut = df.withColumn("last", F.expr(f"CAST((n - 1) div {BLOCK} AS INT)")).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("last") + 1).cast("int"))
        spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        columns = ["key", "one", "two", "side", "uid", "sign", "size", "root"]
        sides = [spread.withColumns({"one": F.col("block"), "two": F.col("other"), "side": F.lit(0)}), spread.withColumns({"one": F.col("other"), "two": F.col("block"), "side": F.lit(1)})]
        return sides[0].select(*columns).unionByName(sides[1].select(*columns)).groupBy("key", "one", "two").applyInArrow(_block_offers(percent, most), "a binary, b binary, shared int")

    def offered(df: DataFrame, most: int) -> DataFrame:
        lists = df.filter(F.col("n") <= LIST).groupBy("key").agg(F.collect_list(F.struct("uid", "sign", "size", "root")).alias("members"))
        found = lists.select("members").mapInArrow(_list_offers(percent, most), "a binary, b binary, shared int")
        long = df.filter((F.col("n") > LIST) & (F.col("n") <= WIDE))
        found = found.unionByName(blocks(long, most)) if long.take(1) else found
        wide = df.filter(F.col("n") > WIDE)
        return found.unionByName(star(wide)) if wide.take(1) else found

    def cells(df: DataFrame) -> DataFrame:
        """Each member of a list in the cells (one, two) of blocks in which it is compared."""
        columns = ["key", "run", "one", "two", "side", "other", "uid", "sign", "size", "root"]
        last = lambda n, weight: F.expr(f"CAST(greatest(({n} - 1) div {BLOCK}, {weight} div {BLOCK_SHINGLES}) AS INT)")
        cut = df.withColumn("last", last("n", "weight"))
        short = cut.filter("last = 0").withColumns({"one": F.lit(0), "two": F.lit(0), "side": F.lit(2), "other": F.lit(True)}).select(*columns)
        long = cut.filter("last > 0")
        if not long.take(1):
            return short
        by_root = long.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("w"))
        mains = by_root.groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("n"), F.sum("w").alias("weight"), F.max_by("w", F.struct("c", "root")).alias("w"))
        mains = materialise(mains.select("key", "n", F.col("main.root").alias("main"), last("(n - main.c)", "(weight - w)").alias("others")), "list-mains")
        long = join_counted(long.drop("n"), mains, "key", "n").withColumn("other", F.col("root") != F.col("main"))
        place = lambda seed, count: F.pmod(F.xxhash64("uid", F.lit(seed)), F.col(count) + 1).cast("int")
        one = long.filter("other").withColumns({"side": F.lit(0), "one": place(1, "others"), "two": F.explode(F.sequence(F.lit(0), "last"))})
        two = long.withColumns({"side": F.lit(1), "two": place(2, "last"), "one": F.explode(F.sequence(F.lit(0), "others"))})
        return short.unionByName(one.select(*columns)).unionByName(two.select(*columns))

    first = listed(labelled(signs))
    if first.take(1):
        best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
        once = offered(first, OFFERS + 1).groupBy("a", "b").agg(F.max("shared").alias("shared")).withColumn("nth", F.row_number().over(best))
        once = materialise(once.filter(F.col("nth") <= OFFERS + 1), "similar-candidates")
        pairs = once.filter(F.col("nth") <= OFFERS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if once.take(1):
            join_groups(materialise(verify(materialise(pairs, "similar-pairs")), "similar-links"))
        more = once.filter(F.col("nth") > OFFERS).select(F.col("a").alias("uid")).union(first.filter(F.col("n") > WIDE).select("uid")).distinct()
        more = materialise(signs.join(more, "uid", "left_semi"), "more-candidates")
        rest = listed(labelled(more)) if more.take(1) else more
        if rest.take(1):
            held = cells(rest).join(shingles(more.select("uid")), "uid")
            join_groups(materialise(held.groupBy("key", "one", "two").applyInArrow(_cell_links(percent), "a binary, b binary"), "similar-links"))
    return roots if roots is not None else signs.limit(0).select(F.col("uid").alias("node"), F.col("uid").alias("root"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (uid, shingles) have a Jaccard similarity of ``percent`` hundredths or more."""
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    # a text of very many pairs is repeated once for each STAR of them, and its pairs are dealt over the repeats
    dealt = pairs.join(degree.filter(F.col("n") > STAR), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce(F.expr(f"n div {STAR} + 1"), F.lit(1))))
    mine = degree.join(sets, degree["a"] == sets["uid"]).select("a", F.col("shingles").alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {STAR}"))).alias("part"))
    both = dealt.drop("n").join(mine, ["a", "part"]).join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("theirs")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("mine", "theirs")))
    return both.filter(F.expr(f"100 * common >= {percent} * (size(mine) + size(theirs) - common)")).select("a", "b")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of similar documents: that with the smallest id, then the least text hash.

    Two documents are linked if their words are equal but for the case of A-Z, or if the Jaccard similarity of their
    sets of ``shingle``-word shingles is ``percent`` hundredths or more; a group is what links connect. Bits of a
    64-bit fingerprint don't tell such pairs: at 0.8 two differ in 10 bits at the mean, and no byte need be equal. So
    the byte at each position is that of a shingle chosen by the position (see ``signatures``); index, tally of shared
    bytes, least tally and verification are the same. At 0.8 a pair shares 51 of 64 bytes at the mean, ``MIN_SHARED``
    with odds of 100,000 to 1, and one of the 16 runs of positions with odds of 4,000 to 1.

    A null id comes last; of repeated rows (equal id and text) one stays. All texts without words are equal. Verdicts
    are joined to the rows that they may concern; other rows aren't shuffled.
    """
    names = {x: spare(docs, f"__{x}") for x in ("doc", "key", "verdict", "may", "at")}

    @F.arrow_udf("struct<uid: binary, sign: binary, size: int>")
    def mark(column: pa.Array) -> pa.Array:
        parts = [signatures([], shingle)] + [signatures(column.slice(i, 512).to_pylist(), shingle) for i in range(0, len(column), 512)]
        keys, marks, sizes = (list(chain.from_iterable(p)) for p in zip(*parts))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), pa.array(sizes, pa.int32())], names=["uid", "sign", "size"])

    rows = docs.select(F.col(quoted(doc_id)).alias("doc"), text_key(quoted(text)).alias("key"), mark(F.col(quoted(text))).alias("m")).select("doc", "key", "m.*")
    classes = materialise(rows, "signatures", BATCH_ROWS).groupBy("uid", "doc", "key").agg(F.first("sign").alias("sign"), F.first("size").alias("size"), F.count(F.lit(1)).alias("times"))
    classes = materialise(classes, "document-classes")
    own = F.struct(F.col("doc").isNull().alias("last"), "doc", "key")
    heads = materialise(classes.groupBy("uid").agg(F.min(own).alias("head"), F.first("sign").alias("sign"), F.first("size").alias("size")), "texts")
    first = materialise(heads.groupBy("sign").agg(F.min(F.struct("uid", "size")).alias("one"), F.count(F.lit(1)).alias("n")).select("sign", "one.*", "n"), "distinct-signatures")
    # texts of one signature: each with the first of them, where that holds; the others stand for themselves below
    equal = first.filter("n > 1").select("sign", F.col("uid").alias("a"), "n")
    equal = materialise(join_counted(heads.select("sign", F.col("uid").alias("b"), "size"), equal, "sign", "n").filter("a <> b"), "equal-signatures")
    keyed = docs.select(F.col(quoted(doc_id)).alias("doc_"), text_key(quoted(text)).alias("key_"), F.col(quoted(text)).alias("text"))
    sets = None

    def cut(batches):
        for batch in batches:
            made = [np.unique(shingle_hashes(t, shingle)[1]).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, made)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made) if made else [], pa.int64()))], names=["uid", "shingles"])

    def shingles(wanted: DataFrame) -> DataFrame:
        """(uid, shingles) of these texts and those asked for before, taken from one document each when first asked for."""
        nonlocal sets
        if sets is not None:
            wanted = wanted.join(sets.select("uid"), "uid", "left_anti")
        wanted = materialise(wanted.join(heads.select("uid", "head"), "uid").select("uid", "head.doc", "head.key"), "wanted-texts")
        if wanted.take(1):
            some = maybe_in(keyed, "xxhash64(doc_, key_)", wanted, "xxhash64(doc, key)", "may").filter("may")
            some = some.join(wanted, some["doc_"].eqNullSafe(wanted["doc"]) & (some["key_"] == wanted["key"])).select("uid", "text")
            more = materialise(some.dropDuplicates(["uid"]).mapInArrow(cut, "uid binary, shingles array<long>"), "shingle-sets", BATCH_ROWS)
            sets = more if sets is None else sets.unionByName(more)
        return sets if sets is not None else wanted.selectExpr("uid", "CAST(NULL AS ARRAY<BIGINT>) AS shingles")

    def verify(pairs: DataFrame) -> DataFrame:
        return verified(pairs, shingles(pairs.selectExpr("a AS uid").union(pairs.select("b")).distinct()), percent)

    links = materialise(verify(equal.select("a", "b")), "equal-links") if equal.take(1) else equal.select("a", "b")
    odd_ones = equal.join(links.select("b"), "b", "left_anti").select(F.col("b").alias("uid"), "sign", "size")
    roots = similar_groups(first.select("uid", "sign", "size").unionByName(odd_ones), links, verify, shingles, percent)

    # verdicts: of each group the first class stays, once
    rooted = classes.select("uid", "doc", "key", "times").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    winners = rooted.groupBy("root").agg(F.min(own).alias("winner"), F.count(F.lit(1)).alias("n"))
    judged = join_counted(rooted, winners, "root", "n").withColumn("stays", own == F.col("winner"))
    odd = judged.filter("NOT stays OR times > 1").select(F.col("doc").alias(names["doc"]), F.col("key").alias(names["key"]), F.when(F.col("stays"), "once").otherwise("goes").alias(names["verdict"]))
    odd = materialise(odd, "near-verdicts")
    at = docs.withColumn(names["at"], text_key(text))
    at = maybe_in(at, f"xxhash64({quoted(doc_id)}, `{names['at']}`)", odd, f"xxhash64(`{names['doc']}`, `{names['key']}`)", names["may"])
    sure = at.filter(~F.col(names["may"]))
    held = at.filter(names["may"]).join(odd, F.col(quoted(doc_id)).eqNullSafe(F.col(names["doc"])) & (F.col(names["at"]) == F.col(names["key"])), "left")
    once = held.filter(F.col(names["verdict"]) == "once").dropDuplicates([names["doc"], names["key"]])
    free = held.filter(F.col(names["verdict"]).isNull())
    columns = [F.col(quoted(c)) for c in docs.columns]
    return sure.select(*columns).unionByName(free.select(*columns)).unionByName(once.select(*columns))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
