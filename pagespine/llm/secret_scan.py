"""Secret scan with corpus-wide ownership: what one owner alone has looks live, what many have is an example.

Three base patterns find spans in each text; each kind's matches are leftmost and do not overlap, and those that are
too short are dropped. Beyond them the method looks, outside assignments, for unnamed tokens: runs of 20 or more of
``[A-Za-z0-9+/_-]`` that have a digit, a letter and 8 different characters, and that hold no span of another kind.
Whether such a token is a credential is told by who has it: hashes of all candidates (base values too) are aggregated
over the corpus by distinct repositories and owners. A candidate that at most ``max_owners`` owners and
``max_repositories`` repositories have is live-looking; one that is copied more widely is an example. Live tokens are added
to the spans; base spans stay whatever the verdict, which the columns ``n_live`` and ``n_copied`` tell. In ``documents`` a row is a
repository and its ``source`` the owner.

DataFrame and SQL functions only. A text is split at the matches; the lengths of parts and matches, summed up, give the
places in code points. Only rows with candidates are shuffled, by hash for the counts, which are partial before each
shuffle: first distinct (hash, owner, repository), then repositories by owner, then owners. Verdicts go back by hash through a
filter of fixed size, which passes few of the copied ones, and then by row.

Defined results: a null text is empty. A null owner or repository counts as one of its own kind (the empty name). Rows that share
id and text are one repository. An empty table gives no rows. Other columns pass through (the text too), but one named
like a column made here is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, maybe_in, pass_through, quoted, spare, table, text_key

MAX_OWNERS, MAX_REPOSITORIES = 1, 16
#: The base kinds in order, with their patterns, the group that is the value, and its least length.
KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"({KEYS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}"  # runs of hex digits are whole: those of 32 or more are the same matches
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: Unnamed tokens: what they are made of, what they must not hold, and how many different characters they have at least.
TOKEN, OTHERS, DIFFERENT = "[A-Za-z0-9+/_-]{20,}", "AKIA[A-Z0-9]{12}|[0-9a-f]{32}", 8
KIND_NAMES = (*(kind for kind, *_ in BASE), "token")
#: Sums of lengths are taken in two steps, so that a text with very many matches stays cheap.
STEP = 256
_SPANS = "array<struct<start:int,end:int,value:string>>"


def places(text: str, pattern: str, group: int = 0, v: str = "v") -> str:
    """SQL for the matches of ``pattern`` in the string ``text`` as array of (start, end, value), in code points.

    The names of lambda variables begin with ``v``, so that calls can be nested.
    """
    parts, hits, values = (f"{f}({text}, r'{pattern}', {k})" for f, k in (("split", -1), ("regexp_extract_all", 0), ("regexp_extract_all", group)))
    # the length of the part before each match and of the match, and their sums before every STEP-th match
    first = f"named_struct('gaps', transform({parts}, {v}x -> length({v}x)), 'hits', transform({hits}, {v}x -> length({v}x)), 'all', {values})"
    second = f"named_struct('gaps', {v}a.gaps, 'hits', {v}a.hits, 'all', {v}a.all, 'both', zip_with(slice({v}a.gaps, 1, size({v}a.hits)), {v}a.hits, ({v}g, {v}h) -> {v}g + {v}h))"
    third = f"named_struct('gaps', {v}b.gaps, 'hits', {v}b.hits, 'all', {v}b.all, 'both', {v}b.both, 'before', transform(sequence(0, int(size({v}b.both) div {STEP})), {v}k -> aggregate(slice({v}b.both, 1, {STEP} * {v}k), 0, ({v}s, {v}y) -> {v}s + {v}y)))"
    start = f"{v}c.before[int({v}i div {STEP})] + aggregate(slice({v}c.both, int({STEP} * ({v}i div {STEP})) + 1, {v}i % {STEP}), 0, ({v}t, {v}z) -> {v}t + {v}z) + {v}c.gaps[{v}i]"
    found = f"transform({v}c.hits, ({v}n, {v}i) -> named_struct('start', {start}, 'end', {start} + {v}n, 'value', {v}c.all[{v}i]))"
    return f"transform(transform(transform(array({first}), {v}a -> {second}), {v}b -> {third}), {v}c -> {found})[0]"


def with_spans(rows: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """Adds an array of (start, end, value) a kind; a text that can't have a match isn't split."""
    t = f"coalesce({quoted(text)}, '')"
    guards = {"assign": f"{t} rlike r'{KEYS}'", "access": f"contains({t}, 'AKIA')", "hex": f"{t} rlike r'{HEX}'"}
    every, parts = spare(rows, "__every"), spare(rows, "__parts")

    def guarded(kind: str, pattern: str, group: int) -> str:
        return f"CASE WHEN {guards[kind]} THEN {places(t, pattern, group)} ELSE CAST(array() AS {_SPANS}) END"

    out = rows.withColumn(every, F.expr(guarded("assign", ASSIGN, 2)))
    for kind, pattern, group, least in BASE:
        found = every if kind == "assign" else guarded(kind, pattern, group)
        out = out.withColumn(names[kind], F.expr(f"filter({found}, e -> length(e.value) >= {least})"))
    # tokens of the parts between assignments; each part begins where the one before it ends
    out = out.withColumn(parts, F.expr(f"CASE WHEN {t} rlike r'{TOKEN}' THEN split({t}, r'{ASSIGN}', -1) ELSE array() END"))
    moved = f"named_struct('start', coalesce(get({every}, k - 1).end, 0) + e.start, 'end', coalesce(get({every}, k - 1).end, 0) + e.end, 'value', e.value)"
    tokens = f"flatten(transform({parts}, (p, k) -> transform({places('p', TOKEN, 0, 'u')}, e -> {moved})))"
    live = f"e.value rlike '[0-9]' AND e.value rlike '[A-Za-z]' AND NOT e.value rlike r'{OTHERS}' AND size(array_distinct(split(e.value, ''))) >= {DIFFERENT}"
    return out.withColumn(names["token"], F.expr(f"filter({tokens}, e -> {live})")).drop(every, parts)


def ownership(candidates: DataFrame) -> DataFrame:
    """(h, g, owners, repositories) of (h, g, owner, repository): how many have each candidate; repositories count by owner."""
    pairs = candidates.select("h", "g", "owner", "repository").distinct()
    by_owner = pairs.groupBy("h", "g", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("h", "g").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, keep_text: bool = True) -> DataFrame:
    """All rows with ``secrets``, an array of (start, end, kind, live) by start and kind: all base spans and the live
    tokens; and ``n_live`` and ``n_copied``, how many candidates of the row, base spans or tokens, are either."""
    made = ("secrets", "n_live", "n_copied")
    names = {k: spare(docs, f"__{k}") for k in KIND_NAMES}
    own, key = spare(docs, "__own"), spare(docs, "__key")
    rows = with_spans(docs, text, names).withColumns({own: F.coalesce(F.col(quoted(repository)).cast("string"), F.lit("")), key: text_key(quoted(text))})
    owner_name = spare(docs, "__owner")
    rows = rows.withColumn(owner_name, F.coalesce(F.col(quoted(owner)).cast("string"), F.lit("")))
    kept = pass_through(docs, *made, *([] if keep_text else [text]))
    rows = materialise(rows.select(*kept, own, key, owner_name, *names.values()), "secret-spans")
    some = " OR ".join(f"size({n}) > 0" for n in names.values())
    listed = ", ".join(f"transform({n}, e -> named_struct('start', e.start, 'kind', {i}, 'end', e.end, 'value', e.value))" for i, n in enumerate(names.values()))
    each = rows.filter(some).select(F.col(own).alias("repository"), F.col(key).alias("key"), F.col(owner_name).alias("owner"), F.expr(f"inline(concat({listed}))"))
    each = each.select("repository", "key", "owner", "start", "kind", "end", F.xxhash64("value").alias("h"), F.xxhash64("value", F.lit("g")).alias("g"))
    live = materialise(ownership(each).filter((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).select("h", "g", F.lit(True).alias("live")), "secret-owners")
    asked = maybe_in(each, "h", live, "h", "maybe")
    told = asked.filter("maybe").join(live, ["h", "g"], "left").withColumn("live", F.coalesce("live", F.lit(False))).drop("maybe")
    told = told.unionByName(asked.filter("NOT maybe").drop("maybe").withColumn("live", F.lit(False)))
    # rows that share repository and text have the same spans, so a set keeps them once
    spans = told.groupBy(F.col("repository").alias(own), F.col("key").alias(key)).agg(F.collect_set(F.struct("start", "kind", "end", "live")).alias("secrets"))
    base = len(BASE)
    out = rows.filter(some).join(spans, [own, key]).unionByName(rows.filter(f"NOT ({some})").withColumn("secrets", F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,live:boolean>>)")))
    out = out.withColumns({"n_live": F.expr("CAST(size(filter(secrets, e -> e.live)) AS BIGINT)"), "n_copied": F.expr("CAST(size(filter(secrets, e -> NOT e.live)) AS BIGINT)")})
    name = "CASE e.kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KIND_NAMES)) + " END"
    secrets = F.expr(f"transform(array_sort(filter(secrets, e -> e.live OR e.kind < {base})), e -> named_struct('start', e.start, 'end', e.end, 'kind', {name}, 'live', e.live))")
    return out.withColumn("secrets", secrets).drop(own, key, owner_name, *names.values())


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    written = "array_join(transform({}, e -> concat_ws(':', e.kind, e.start, e.end)), ',')"
    counts = [F.expr(f"CAST(size(filter(secrets, e -> e.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KIND_NAMES]
    return found.select("doc_id", *counts, F.expr(f"sha2({written.format("filter(secrets, e -> e.kind <> 'token')")}, 256)").alias("base_sha256"), F.expr(written.format("secrets")).alias("spans"), "n_live", "n_copied")


def _hits(source: str, pattern: str, group: int, keys: str) -> str:
    """Matches of ``t`` in ``source`` with their places: parts and matches side by side, and running sums of their lengths."""
    rows = f"SELECT {keys}, generate_subscripts(m, 1) AS k, unnest(m) AS m, unnest(v) AS value, unnest(p[:len(m)]) AS gap FROM (SELECT {keys}, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS p FROM {source})"
    return f"SELECT {keys}, k, value, length(m) AS n, sum(length(gap) + length(m)) OVER (PARTITION BY {keys} ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM ({rows})"


def _duckdb() -> str:
    base = " UNION ALL ".join(f"SELECT rid, {i} AS kind, stop - n AS start, stop, value FROM ({_hits('docs', pattern, group, 'rid')}) WHERE length(value) >= {least}" for i, (_, pattern, group, least) in enumerate(BASE))
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KIND_NAMES)) + " END"
    span = f"{name} || ':' || start || ':' || stop"
    token = len(BASE)
    counts = ", ".join(f"count(*) FILTER (kind = {i}{' AND live' if k == 'token' else ''}) AS n_{k}" for i, k in enumerate(KIND_NAMES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
base AS ({base}),
parts AS (SELECT rid, unnest(p) AS t, generate_subscripts(p, 1) AS part FROM (SELECT rid, string_split_regex(t, '{ASSIGN}') AS p FROM docs)),
offsets AS (SELECT rid, k + 1 AS part, stop AS moved FROM ({_hits('docs', ASSIGN, 2, 'rid')})),
tokens AS (SELECT h.rid, {token} AS kind, coalesce(moved, 0) + stop - n AS start, coalesce(moved, 0) + stop AS stop, value FROM ({_hits('parts', TOKEN, 0, 'rid, part')}) h LEFT JOIN offsets o ON o.rid = h.rid AND o.part = h.part
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '{OTHERS}') AND len(list_distinct(string_split(value, ''))) >= {DIFFERENT}),
each AS (SELECT doc_id, owner, c.* FROM (SELECT * FROM base UNION ALL SELECT * FROM tokens) c JOIN docs USING (rid)),
owned AS (SELECT value, count(DISTINCT owner) <= {MAX_OWNERS} AND count(DISTINCT (owner, coalesce(doc_id::VARCHAR, ''))) <= {MAX_REPOSITORIES} AS live FROM each GROUP BY value),
told AS (SELECT * FROM each JOIN owned USING (value)),
spans AS (SELECT rid, {counts}, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
  coalesce(string_agg({span}, ',' ORDER BY start, kind) FILTER (kind < {token}), '') AS base, coalesce(string_agg({span}, ',' ORDER BY start, kind) FILTER (kind < {token} OR live), '') AS spans FROM told GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KIND_NAMES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM docs LEFT JOIN spans USING (rid)
"""


SQL = _duckdb()
