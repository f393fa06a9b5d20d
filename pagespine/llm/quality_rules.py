"""Quality by weak supervision: rules vote or abstain, EM estimates how far to trust each, a posterior decides.

Each rule looks at one statistic of the text and votes good (1), bad (-1) or abstains (0). The votes of all
documents are counted by pattern (at most 3 to the number of rules, whatever the corpus). Expectation-maximisation
over those counts estimates the share of good documents and, for each rule, how often it votes bad and how often good
on good and on bad documents; the posterior that a document is good follows from its votes. Everything is DataFrame
expressions. No rule repeats the base rule's bound on words; the estimates have no bounds but a few pseudo-counts, which
also keep good and bad from changing sides.

Defined results: a null text has no words; it and an empty text fail the base rule (fewer than 50 words). With an
empty table the parameters stay at their start. Repeated rows vote each, rows with a null id too. Other columns pass
through unchanged, but one with the name of a column made here (``q_`` and a name) is replaced by it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, pass_through, quoted, spare, table

ROUNDS = 20
#: Of good (g) and bad (b) documents: how often a rule votes bad (n) and good (p), before any is counted.
START = {"good": 0.85, "gn": 0.05, "gp": 0.75, "bn": 0.4, "bp": 0.3}
#: Pseudo-counts that hold rare votes near the start.
WEIGHT = 10.0
MIN_WORDS = 50
#: name, when it votes bad, when it votes good; both over the statistics. Comparisons are of integers only.
RULES = (
    ("word_size", "word_chars < 3 * n_words OR word_chars > 7 * n_words", "word_chars >= 4 * n_words AND word_chars <= 6 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("line_repeats", "10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 AND n_dup_lines = 0"),
    ("window_repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("sentences", "10 * n_stops < 7 * n_lines", "100 * n_stops >= 98 * n_lines"),
)
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stops", "n_repeat_words")
#: Arrays over which one text's statistics are computed.
_STEPS = {
    "q_flat": r"translate(coalesce({text}, ''), '\t\n\u000b\u000c\r', '     ')",
    "q_words": "array_remove(split(q_flat, ' '), '')",
    "q_lines": r"filter(split(coalesce({text}, ''), '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')",
    # 3-word windows with their places, equal ones next to each other
    "q_windows": "sort_array(transform(CASE WHEN size(q_words) > 2 THEN sequence(0, size(q_words) - 3) ELSE array() END, i -> named_struct('h', xxhash64(q_words[i], q_words[i + 1], q_words[i + 2]), 'i', i)))",
    "q_found": "array_sort(transform(filter(q_windows, (w, k) -> (k > 0 AND q_windows[greatest(k - 1, 0)].h = w.h) OR (k + 1 < size(q_windows) AND q_windows[least(k + 1, size(q_windows) - 1)].h = w.h)), w -> w.i))",
}
_STATS = {
    "n_words": "CAST(size(q_words) AS BIGINT)",
    "word_chars": "CAST(length(replace(q_flat, ' ', '')) AS BIGINT)",
    "n_symbols": "CAST(length(coalesce({text}, '')) - length(translate(coalesce({text}, ''), '#*$%&|<>', '')) AS BIGINT)",
    "n_lines": "CAST(size(q_lines) AS BIGINT)",
    "n_dup_lines": "CAST(size(q_lines) - size(array_distinct(q_lines)) AS BIGINT)",
    "n_stops": r"CAST(size(filter(q_lines, x -> x rlike '[.!?][\\x20\\x09-\\x0D]*\\z')) AS BIGINT)",
    # each found window adds the words that the one before it doesn't reach
    "n_repeat_words": "CAST(CASE WHEN size(q_found) = 0 THEN 0 ELSE aggregate(sequence(1, size(q_found)), 0, (n, k) -> n + CASE WHEN k = size(q_found) THEN 3 ELSE least(3, q_found[least(k, size(q_found) - 1)] - q_found[k - 1]) END) END AS BIGINT)",
}


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``q_`` and the name of each statistic. Words are runs of characters other than space and U+0009 to U+000D."""
    steps = {name: spare(docs, name) for name in _STEPS}

    def own(sql: str) -> Column:
        for name, taken in steps.items():
            sql = re.sub(rf"\b{name}\b", taken, sql)
        return F.expr(sql.format(text=quoted(text)))

    out = docs
    for name, sql in _STEPS.items():
        out = out.withColumn(steps[name], own(sql))
    return out.select(*pass_through(docs, *[f"q_{name}" for name in _STATS]), *[own(sql).alias(f"q_{name}") for name, sql in _STATS.items()])


def vote(rule: tuple[str, str, str]) -> str:
    return f"CASE WHEN {rule[1]} THEN -1 WHEN {rule[2]} THEN 1 ELSE 0 END"


def with_votes(stats: DataFrame) -> DataFrame:
    """Adds ``q_vote_`` and the name of each rule."""
    names = re.compile(rf"\b({'|'.join(STATS)})\b")
    return stats.withColumns({f"q_vote_{rule[0]}": F.expr(names.sub(r"q_\1", vote(rule))) for rule in RULES})


def posterior_sql(theta: dict, votes: dict[str, str]) -> str:
    """Probability of a good document, given its votes."""
    odds = [f"ln({theta['good']}) - ln(1 - {theta['good']})"]
    for name, column in votes.items():
        gn, gp, bn, bp = (theta[f"{k}_{name}"] for k in ("gn", "gp", "bn", "bp"))
        odds.append(f"CASE {column} WHEN -1 THEN ln({gn}) - ln({bn}) WHEN 1 THEN ln({gp}) - ln({bp}) ELSE ln(1 - {gn} - {gp}) - ln(1 - {bn} - {bp}) END")
    return f"1 / (1 + exp(-({' + '.join(odds)})))"


def update_sql(votes: dict[str, str], q: str = "q", n: str = "n", total: str = "sum({})") -> dict[str, str]:
    """The parameters' next values, by ``total`` over patterns of votes, their counts and posteriors."""

    def share(hit: str, of: str, start: float) -> str:
        return f"(coalesce({total.format(hit)}, 0) + {WEIGHT * start}) / (coalesce({total.format(of)}, 0) + {WEIGHT})"

    out = {"good": share(f"{n} * {q}", n, START["good"])}
    for name, column in votes.items():
        for key, weight in (("g", q), ("b", f"(1 - {q})")):
            for way, vote_ in (("n", -1), ("p", 1)):
                out[f"{key}{way}_{name}"] = share(f"CASE WHEN {column} = {vote_} THEN {n} * {weight} ELSE 0 END", f"{n} * {weight}", START[key + way])
    return out


def start() -> dict:
    return {"good": START["good"]} | {f"{k}_{rule[0]}": START[k] for rule in RULES for k in ("gn", "gp", "bn", "bp")}


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM over the counted patterns; the driver sees only the parameters, one row.

    All rounds are one expression over the array of patterns: a query a round, each with other numbers in its code, would
    be compiled a round, and the driver would hold what it compiled.
    """
    columns = {rule[0]: f"q_vote_{rule[0]}" for rule in RULES}
    names = list(start())
    theta = ", ".join(f"'{k}', CAST({v!r} AS DOUBLE)" for k, v in start().items())
    votes = ", ".join(f"'{c}', p.{c}" for c in columns.values())
    good = posterior_sql({k: f"t.{k}" for k in names}, {k: f"p.{c}" for k, c in columns.items()})
    total = "aggregate(w, CAST(0 AS DOUBLE), (s, p) -> s + {})"
    after = update_sql({k: f"p.{c}" for k, c in columns.items()}, "p.q", "p.n", total)
    after = ", ".join(f"'{k}', CAST({after[k]} AS DOUBLE)" for k in names)
    # the array of one array is there to name the patterns with their posteriors
    weighed = f"array(transform(patterns, p -> named_struct({votes}, 'n', CAST(p.n AS DOUBLE), 'q', {good})))"
    rounds_ = f"aggregate(array_repeat(0, {rounds}), named_struct({theta}), (t, i) -> transform({weighed}, w -> named_struct({after}))[0])"
    listed = patterns.agg(F.array_sort(F.collect_list(F.struct(*columns.values(), "n"))).alias("patterns"))
    return listed.select(F.expr(rounds_).alias("theta")).select("theta.*").first().asDict()


MADE = tuple(f"q_{x}" for x in (*STATS, *(f"vote_{rule[0]}" for rule in RULES), "good", "base_failed", "kept"))


def base_failed(prefix: str = "q_") -> Column:
    return F.expr(f"{prefix}n_words < {MIN_WORDS} OR 100 * {prefix}n_repeat_words > 50 * {prefix}n_words")


def judge(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows with their statistics, votes, ``q_good`` (the posterior), ``q_base_failed`` and ``q_kept``.

    The statistics are written once to the shared folder, with the text only if ``keep_text``; the patterns are
    counted from there.
    """
    stats = with_stats(docs.select(*pass_through(docs, *MADE)), text)
    scored = materialise(with_votes(stats if keep_text else stats.drop(text)), "quality-votes")
    names = [f"q_vote_{rule[0]}" for rule in RULES]
    patterns = materialise(scored.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "quality-patterns")
    theta = fit(patterns)
    good = posterior_sql({k: f"{v!r}D" for k, v in theta.items()}, {rule[0]: f"q_vote_{rule[0]}" for rule in RULES})
    return scored.withColumns({"q_good": F.expr(good), "q_base_failed": base_failed()}).withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_good") >= 0.5))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"q_{x}").alias(x) for x in names], F.col("q_n_lines").alias("n_lines"), F.col("q_n_stops").alias("n_stops"))


def _duckdb() -> str:
    """The same for DuckDB: statistics by row numbers instead of arrays, EM as one pair of steps a round."""
    votes = {rule[0]: f"v_{rule[0]}" for rule in RULES}
    word = r"[^\x20\x09-\x0D]"
    parts = [f"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '{word}+') AS w FROM docs)),
windows AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows WHERE win IS NOT NULL) WHERE c > 1),
repeats AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
lines AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{word}')),
line_stats AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '[.!?][\\x20\\x09-\\x0D]*$')) AS n_stops FROM lines GROUP BY rid),
word_stats AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY rid),
stats AS (SELECT d.rid, d.doc_id, coalesce(w.n_words, 0) AS n_words, coalesce(w.word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
  coalesce(l.n_stops, 0) AS n_stops, coalesce(r.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN word_stats w USING (rid) LEFT JOIN line_stats l USING (rid) LEFT JOIN repeats r USING (rid)),
votes AS (SELECT *, {', '.join(f'{vote(r)} AS v_{r[0]}' for r in RULES)} FROM stats),
patterns AS (SELECT {', '.join(votes.values())}, count(*)::DOUBLE AS n FROM votes GROUP BY ALL),
theta0 AS (SELECT {', '.join(f'{v!r}::DOUBLE AS {k}' for k, v in start().items())})"""]
    for i in range(ROUNDS):
        parts.append(f"post{i} AS (SELECT patterns.*, {posterior_sql({k: f'theta{i}.{k}' for k in start()}, votes)} AS q FROM patterns, theta{i})")
        parts.append(f"theta{i + 1} AS (SELECT {', '.join(f'{sql} AS {k}' for k, sql in update_sql(votes).items())} FROM post{i})")
    good = posterior_sql({k: f"theta{ROUNDS}.{k}" for k in start()}, votes)
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"
    return f"WITH {','.join(parts)}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND {good} >= 0.5 AS kept, n_lines, n_stops FROM votes, theta{ROUNDS}"


SQL = _duckdb()
