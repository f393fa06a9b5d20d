"""The corpus queries on the small tables and odd rows, against plain versions, libraries, and SQL."""

import hashlib
import math
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagespine.llm import _common, bpe, decontaminate, language_id, line_dedup, lm_score, quality_rules, queries, repeats, simhash, token_records, warc
from pagespine.llm._common import scratch_path

from . import plain

public_tokenizers = pytest.importorskip("public_tokenizers")

RULES = {"edge": decontaminate._EDGE, "number": decontaminate._NUMBER, "number_words": decontaminate.NUMBER_WORDS, "units": decontaminate.UNITS}
PASSAGE = "Every harbour keeps a ledger of arrivals, and the clerk who writes it knows more than the mayor. " * 6
LONG = " ".join(f"word{i % 977} follows, then number {i}." for i in range(20_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "één twee drie — été ÉCOLE naïve 😀 ok"), (5, "same line of text that is long enough here\n" * 40),
    (6, LONG), (7, LONG), (8, PASSAGE + "tail one"), (9, "head " + PASSAGE), (10, "same line of text that is long enough herf\nanother"), (11, "42 #### $$$ |||"), (12, " x y \x0b z\r\nq"),
]


def crc(x):
    return zlib.crc32(str(x).encode())


def rows_of(spark, sf, table="documents", columns=("doc_id", "text")):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{table}.parquet").select(*columns).collect()]


@pytest.fixture(scope="module")
def odd_dir(spark, tiny, tmp_path_factory):
    """A folder whose documents are ODD, with some columns that operators also make, and whose pages hold odd rows."""
    out = tmp_path_factory.mktemp("odd")
    made = [(i, t, ["en", None, "fr"][i % 3], "web", 0, 5, [1], "x") for i, t in ODD]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, score int, words array<int>, ids string").write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{tiny}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(1, "a", None), (2, None, ""), (3, "c", "<p>x</p>"), (4, "d", "<p>x</p>"), (5, "e\r\nf", "é" * 9), (6, "g", LONG)], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return str(out)


@pytest.fixture(scope="module")
def empty_dir(spark, tiny, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{tiny}/{name}.parquet").limit(0).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("which", ["tiny", "odd_dir"])
def test_language(spark, which, request):
    sf = request.getfixturevalue(which)
    docs = rows_of(spark, sf, columns=("doc_id", "text", "lang"))
    want = plain.languages(docs, lambda i: crc(i) % 4 != 2, language_id.BUCKETS, language_id.ORDERS, language_id._MIX, language_id.SMOOTHING)
    for r in queries.QUERIES["op1_language_id"](spark, sf).collect():
        lang, score = want.pop(r["doc_id"])
        assert (r["held_out"], r["lang_pred"]) == (crc(r["doc_id"]) % 4 == 2, lang)
        assert r["score"] == pytest.approx(score, rel=1e-6, abs=1e-9)
    assert not want


def test_rare_language_is_learned(spark):
    """A language of few rows among very many gives all of them, so that it is no column without counts."""
    rows = [(i, "the quick brown fox walks over there", "en") for i in range(6000)] + [(6000 + i, "příliš žluťoučký kůň úpěl ďábelské ódy", "cs") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = language_id.train(docs, max_docs=200)
    asked = spark.createDataFrame([(1, "unseen wordplay of zebras", 0.5), (2, "žluťoučký kůň", 0.5)], "doc_id long, text string, score double")
    made = language_id.predict(asked, langs, matrix)
    assert {r["doc_id"]: r["lang_pred"] for r in made.collect()} == {1: "en", 2: "cs"}
    assert made.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [language_id.most_of_each(x, 100) for x in ([5, 1000], [10], [1000, 1000, 1000], [])] == [95, 100, 34, 0]


def test_language_ties_and_repeats(spark):
    docs = spark.createDataFrame([(1, "ab", "b"), (2, "ab", "a"), (2, "ab", "a"), (1, "ab", "b"), (None, "ab", None)], "doc_id long, text string, lang string")
    langs, matrix = language_id.train(docs)
    got = language_id.predict(docs, langs, matrix).collect()
    assert len(got) == 5 and {(r["lang_pred"], round(r["score"], 9)) for r in got} == {("a", 0.5)}


def test_language_accuracy(spark, small):
    own = spark.read.parquet(f"{small}/documents.parquet").filter("lang IS NOT NULL").select("doc_id", "lang").join(queries.QUERIES["op1_language_id"](spark, small), "doc_id")
    r = own.filter("held_out AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] > 100 and r["right"] > 0.95


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    langs, matrix = language_id.train(docs)
    assert language_id.predict(docs, langs, matrix).first()["lang_pred"] == "und"


@pytest.mark.parametrize("which", ["tiny", "odd_dir", "small"])
def test_quality(spark, which, request, by_sql, same):
    sf = request.getfixturevalue(which)
    made = queries.QUERIES["op2_quality_rules"](spark, sf)
    if which != "odd_dir":
        same(made, *by_sql(queries.SQL["op2_quality_rules"], sf))
    own, docs = {r["doc_id"]: r for r in made.collect()}, rows_of(spark, sf)
    kept = plain.quality_kept([t for _, t in docs], quality_rules.ROUNDS, quality_rules.START, quality_rules.WEIGHT)
    for (doc_id, text), (failed, keep) in zip(docs, kept):
        r, s = own[doc_id].asDict(), plain.statistics(text)
        assert {k: r[k] for k in s} == s, doc_id
        assert (r["base_failed"], r["kept"]) == (failed, keep), doc_id


def test_quality_against_labels(spark, small):
    """Of the labelled documents that the base rule lets through, the method finds the bad ones and keeps the good ones."""
    made = queries.QUERIES["op2_quality_rules"](spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").filter("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in made.groupBy("quality", "kept").count().collect()}
    assert n.get((0, False), 0) > 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert n[1, True] > 0.97 * (n[1, True] + n.get((1, False), 0))


def test_quality_of_odd_rows(spark):
    """Repeated rows, null ids, and columns with the names of outputs and steps."""
    rows = [(None, "some words here", "x", 1, 2), (1, None, "y", 1, 2), (1, None, "y", 1, 2), (2, LONG, "z", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, q_words string, q_kept int, q_n_words int")
    made = quality_rules.judge(docs)
    got = sorted(((r["doc_id"], r["q_words"], r["q_n_words"], r["q_kept"]) for r in made.collect()), key=str)
    assert got == [(1, "y", 0, False), (1, "y", 0, False), (2, "z", 100_000, False), (None, "x", 3, False)]
    assert made.columns.count("q_kept") == made.columns.count("q_n_words") == 1


@pytest.mark.parametrize("which", ["tiny", "odd_dir"])
def test_lines(spark, which, request):
    sf = request.getfixturevalue(which)
    want = plain.line_dedup(rows_of(spark, sf))
    for r in queries.QUERIES["op3_line_dedup"](spark, sf).collect():
        gone, text = want.pop(r["doc_id"])
        assert r["n_removed"] == len(gone), r["doc_id"]
        assert r["kept_sha256"] == (None if text is None else hashlib.sha256(text.encode()).hexdigest())
    assert not want


def test_lines_at_random(spark):
    dice = random.Random(5)
    base = ["".join(dice.choice("abcd ") for _ in range(dice.randint(30, 60))) for _ in range(40)]

    def edited(x):
        i, how = dice.randrange(len(x)), dice.randrange(4)
        return [x, x[:i] + "z" + x[i:], x[:i] + x[i + 1 :], x[:i] + "y" + x[i + 1 :]][how]

    docs = [(i, "\n".join(edited(edited(dice.choice(base))) for _ in range(dice.randint(1, 8)))) for i in range(60)]
    done = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in done.collect()} == {i: t for i, (_, t) in plain.line_dedup(docs).items()}


def test_lines_of_odd_rows(spark):
    line = "a line that is long enough to take part in this"
    rows = [(1, f"{line}\nNo.\n\nNo.", "x", 1), (2, None, "y", 2), (3, "", "z", 3), (4, f"{line}!\nNo.\n", "v", 4), (5, "No?\n \n ", "w", 5)]
    made = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines string, __key int"), n_lines="n_lines", n_removed="n_removed")
    assert made.columns == ["doc_id", "text", "__key", "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in made.collect()) == [(1, f"{line}\nNo.\n", 1, 4, 1), (2, None, 2, 0, 0), (3, "", 3, 1, 0), (4, "", 4, 3, 2), (5, "No?\n \n ", 5, 3, 0)]


def test_very_common_lines(spark, monkeypatch):
    """Keys that are broadcast beside those that are joined give the same lines."""
    rows = [(i, f"a footer that every page in the archive carries\nunique line number {i} of this archive here") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: t for i, (_, t) in plain.line_dedup(rows).items()}
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == want
    monkeypatch.setattr(_common, "COUNTED_ROWS", 0)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == want


def test_lines_of_repeated_rows(spark):
    row = (1, "one line that is long enough to take part\nshort\none line that is long enough to take part")
    got = line_dedup.dedup_lines(spark.createDataFrame([row, row, (None, row[1])], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, row[1].rsplit("\n", 1)[0]), (1, ""), (1, "")]


@pytest.mark.parametrize("which", ["tiny", "odd_dir"])
def test_records(spark, which, request):
    from tokenizers import Tokenizer

    sf = request.getfixturevalue(which)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own, start = {r["doc_id"]: r for r in queries.QUERIES["op4_token_records"](spark, sf).collect()}, 0
    for doc_id, text in sorted(rows_of(spark, sf)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        r = own.pop(doc_id)
        assert (r["start"], r["n_tokens"]) == (start, len(ids)), doc_id
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)), doc_id
        start += len(ids)
    assert not own


def test_records_by_offset(spark, tiny):
    folder = scratch_path(spark, "by-offset")
    manifest = token_records.write_records(spark.read.parquet(f"{tiny}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), 2, files=3)
    assert manifest.count() == 3
    for m in manifest.collect():
        index = spark.read.parquet(m["index_path"]).collect()
        dice = random.Random(1).sample(index, min(20, len(index)))
        for r, data in zip(dice, token_records.read_at(m["path"], [r["offset"] for r in dice])):
            assert len(data) == 2 * r["n_ids"] and len(token_records.frame(data)) == r["length"]


def test_spellings_of_a_word_are_encoded_once(monkeypatch):
    import tokenizers

    class Counting:
        def __init__(self, own):
            self.own = tokenizer(own)

        @classmethod
        def from_file(cls, path):
            made = cls.__new__(cls)
            made.own = tokenizer.from_file(path)
            return made

        def __getattr__(self, name):
            return getattr(self.own, name)

        def __setattr__(self, name, value):
            object.__setattr__(self, name, value) if name == "own" else setattr(self.own, name, value)

        def encode_batch_fast(self, texts, **how):
            words.extend(w for t in texts for w in t.split())
            return self.own.encode_batch_fast(texts, **how)

    tokenizer, words = tokenizers.Tokenizer, []
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, texts = token_records.WordEncoder(path), ["Élanwhed élanwhed, ÉLANWHED", "élanwhed*** Élanwhed.\nélanWhed,"]
    words.clear()
    got = [ids.tolist() for ids in encoder.encode(texts, 2)]
    assert got == [[*tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert sum(w.lower().startswith("élanwhed") for w in words) == 1, words


def test_words_at_random():
    from tokenizers import Tokenizer

    path, dice = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    t, encoder = Tokenizer.from_file(path), token_records.WordEncoder(path)
    pieces = ["a", "B", "the", "É", "ß", "µ", "ª", "²", "½", "7", "\u0301", "é", "İ", "Σ", "ΑΣ", "ж", "中", "ﬁ", ".", ",", "'", "'s", "'T", "´", "—", "\"", "###", "</w>", "<|endoftext|>", "<|", "|>", "_", "\t", "\r", "\x85", "\xa0", "\u2028", "\x00", "\ud7ff", "😀"]
    texts = ["".join(dice.choice([*pieces, " ", " ", "\n"]) for _ in range(dice.randrange(60))) for _ in range(3000)]
    assert encoder.has_plain
    for _ in range(2):  # with an empty memo, then with a full one
        assert [ids.tolist() for ids in encoder.encode(texts, 2)] == [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_have_no_plain_words(tmp_path):
    from tokenizers import AddedToken, Tokenizer, normalizers

    texts = ["Under under, UNDER*** the end", "Été été."]
    for i, change in enumerate((lambda t: setattr(t, "normalizer", normalizers.NFC()), lambda t: t.add_tokens([AddedToken("under", normalized=False)]))):
        t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        change(t)
        t.save(path := str(tmp_path / f"{i}.json"))
        encoder = token_records.WordEncoder(path)
        assert not encoder.has_plain
        assert [ids.tolist() for ids in encoder.encode(texts, 2)] == [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_damaged_record(tmp_path):
    import io

    whole = token_records.frame(b"abcdef")
    assert token_records.read_record(io.BytesIO(whole)) == b"abcdef"
    for i in range(len(whole)):
        with pytest.raises(ValueError):
            token_records.read_record(io.BytesIO(whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1 :]))


def reference_encoding():
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("which", ["tiny", "odd_dir"])
def test_bpe(spark, which, request):
    sf, theirs = request.getfixturevalue(which), reference_encoding()
    own = {r["doc_id"]: r for r in queries.QUERIES["op5_byte_bpe"](spark, sf).collect()}
    for doc_id, text in rows_of(spark, sf):
        ids = theirs.encode_ordinary(text or "")
        r = own.pop(doc_id)
        assert r["n_tokens"] == len(ids), doc_id
        assert r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert not own


def test_bpe_at_random():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    codec, theirs = bpe.Codec(bpe.model_bytes(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN), reference_encoding()

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\r'.,x1é   ​ 　\x1c\x85"))))
    def check(text):
        (ids,) = codec.encode([text])
        assert ids == b"".join(x.to_bytes(4, "little") for x in theirs.encode_ordinary(text))
        assert codec.decode([ids]) == [text.encode()]

    check()


def levels_by_model(model):
    """The level that the model's filter gives a pair, and how often it gave more than the pair's count has."""
    import numpy as np
    import xxhash

    bits = {r["part"]: np.frombuffer(r["data"], np.uint8) for r in model.parts.filter("pairs").collect()}
    asked, wrong = {}, []

    def level(a, b, count):
        if (a, b) not in asked:
            h = lm_score.pair_hash(*(np.array([xxhash.xxh64_intdigest(x.encode(), 5)], np.uint64) for x in (a, b)))
            mine = bits.get(int(lm_score.part_of(h, 48, model.n_parts)[0]), np.empty(0, np.uint8))
            asked[a, b] = int(lm_score.levels(mine, h)[0])
            assert asked[a, b] >= count.bit_length()
            if asked[a, b] > count.bit_length():
                wrong.append((a, b))
        return asked[a, b]

    return level, asked, wrong


@pytest.mark.parametrize("which", ["tiny", "odd_dir"])
def test_lm(spark, which, request):
    sf = request.getfixturevalue(which)
    docs = rows_of(spark, sf)
    held = lambda i: crc(i) % 5 == 1
    level, asked, wrong = levels_by_model(lm_score.train(spark.createDataFrame([x for x in docs if not held(x[0])], "doc_id long, text string")))
    base, full = plain.unigrams(docs, held), plain.bigrams(docs, held, level, lm_score.STRENGTH)
    for r in queries.QUERIES["op6_lm_score"](spark, sf).collect():
        n, known, total, score = base.pop(r["doc_id"])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), n, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert r["score"] == pytest.approx(full[r["doc_id"]], rel=1e-9)
    assert not base and len(wrong) < 0.02 * len(asked)


def test_lm_beats_tokens_alone(spark, small):
    r = queries.QUERIES["op6_lm_score"](spark, small).filter("held_out").agg(F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better"), F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["better"] > 0.6 and r["s"] > r["b"]


def test_lm_odd_rows(spark):
    """Null ids, repeated rows, columns with the names of outputs and of the operator's own; small blocks and parts."""
    rows = [(None, "the tide turns", 1.5, "x"), (1, "the tide turns", 2.5, "y"), (1, "the tide turns", 2.5, "y"), (2, None, 0.5, None), (3, "", 0.5, None), (4, "wave " * 70_000, 1.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, __text string")
    model = lm_score.train(docs, part_bytes=1000)
    assert model.n_parts > 300 and model.texts == 6
    made = lm_score.score(docs, model)
    assert made.columns == ["doc_id", "__text", "n_tokens", "n_known", "base_score", "score", "train_tokens"]
    got = {(r["doc_id"], r["__text"]): r for r in made.collect()}
    assert made.count() == 6 and got[2, None]["score"] == got[3, None]["score"] and got[2, None]["n_tokens"] == 1
    assert got[None, "x"]["score"] == got[1, "y"]["score"] and got[4, "z"]["n_tokens"] == 70_001
    nothing = lm_score.train(docs.limit(0))
    r = lm_score.score(docs, nothing).filter("doc_id = 2").first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (1, 0, 0)


@pytest.mark.parametrize("which", ["tiny", "odd_dir"])
def test_simhash(spark, which, request):
    sf = request.getfixturevalue(which)
    want = plain.groups({i: plain.fingerprint(t) for i, t in rows_of(spark, sf)})
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.QUERIES["op7_simhash"](spark, sf).collect()}
    assert got == want


def test_simhash_links_at_random(spark):
    dice, marks = random.Random(3), {}
    for i in range(300):
        x = dice.getrandbits(64) if i < 60 else marks[dice.randrange(i)]
        for _ in range(dice.randint(0, 3) if i >= 60 else 0):
            x ^= 1 << dice.randrange(64)
        marks[i] = x
    signed = [(i, x - (x >> 63 << 64)) for i, x in marks.items()]
    found = simhash.groups(spark.createDataFrame(signed, "doc_id long, fingerprint long"))
    of = {r["fingerprint"] & (1 << 64) - 1: r["component_id"] for r in found.collect()}
    assert {i: of[x] for i, x in marks.items()} == {i: c for i, (_, c) in plain.groups(marks).items()}


@pytest.mark.parametrize("longest", [256, 1])
def test_one_of_each_group(spark, tiny, monkeypatch, longest):
    """Also with blocks, which a pair of documents takes here."""
    monkeypatch.setattr(simhash, "LIST", longest)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == plain.similar(rows_of(spark, tiny))


def test_one_of_a_large_group(spark, monkeypatch):
    """Near copies of two texts, each within a few words of its text, and texts that share a passage only."""
    monkeypatch.setattr(simhash, "LIST", 8)
    dice = random.Random(8)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(5))
    bases, passage = [[word() for _ in range(n)] for n in (200, 90)], [word() for _ in range(60)]
    docs = [(0, " ".join(bases[0])), (1, " ".join(bases[1]))]
    for i in range(2, 120):
        w = list(bases[i % 2])
        w[dice.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    docs += [(i, " ".join([word() for _ in range(60)] + passage)) for i in range(120, 180)]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == plain.similar(docs) == [0, 1, *range(120, 180)]


def borderline(seed, groups, words=300):
    """Groups of 16 to 20 texts, each of its group's text with 3 or 4 words changed: near the bound, on both sides."""
    dice = random.Random(seed)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(5))
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(dice.randint(16, 20)):
            w = list(base)
            for at in dice.sample(range(words), dice.randint(3, 4)):
                w[at] = word()
            docs.append((len(docs), " ".join(w)))
    return docs


@pytest.mark.parametrize("longest, wide", [(256, 4096), (4, 4096), (4, 8)])
def test_near_the_bound(spark, monkeypatch, longest, wide):
    """All documents that brute force removes go, and no others: also by blocks of longer lists, and by lists that are split."""
    for name, value in (("LIST", longest), ("WIDE", wide), ("BLOCK", 4 if longest == 4 else 1024)):
        monkeypatch.setattr(simhash, name, value)
    docs = borderline(21, 40 if longest > 4 else 8)
    stay, go = set(plain.similar(docs)), len(docs)
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert stay <= kept and len(kept - stay) <= 0.01 * (go - len(stay)), (len(docs), len(stay), len(kept))


def crowded(seed, systems, decoys, words=300):
    """Systems of two texts of Jaccard similarity 0.816, each amid ``decoys`` that have 0.788 with it and less with all others:
    to either text, many of its decoys look as similar as the other one does."""
    dice = random.Random(seed)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(6))
    changed = lambda base, n: [word() if i in at else w for at in [{*dice.sample(range(5, words - 5, 5), n)}] for i, w in enumerate(base)]
    docs, twins = [], []
    for _ in range(systems):
        one = [word() for _ in range(words)]
        two = changed(one, 6)
        twins.append(len(docs) + 1)
        docs += [one, two, *(changed(base, 7) for base in (one, two) for _ in range(decoys))]
    return [(i, " ".join(w)) for i, w in enumerate(docs)], twins


@pytest.mark.parametrize("longest, wide, block, systems, decoys", [(256, 4096, 1024, 3, 250), (4, 8, 4, 2, 40)])
def test_one_of_a_crowd(spark, monkeypatch, longest, wide, block, systems, decoys):
    """A text's one partner is found behind any number of candidates that fail; also in lists that are long."""
    for name, value in (("LIST", longest), ("WIDE", wide), ("BLOCK", block)):
        monkeypatch.setattr(simhash, name, value)
    docs, twins = crowded(5, systems, decoys)
    stay = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id").collect()}
    assert sorted({i for i, _ in docs} - stay) == twins


def test_long_lists_lose_none(spark, monkeypatch):
    """What is left near the bound equals brute force exactly where all lists are longer than first offers go."""
    for name, value in (("LIST", 2), ("WIDE", 4), ("BLOCK", 4)):
        monkeypatch.setattr(simhash, name, value)
    docs = borderline(33, 6)
    stay = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert stay == set(plain.similar(docs))


def test_one_of_odd_rows(spark):
    rows = [(1, "a b", "p", 1), (1, "a b", "q", 2), (None, "A  B", "r", 3), (None, "c", "s", 4), (None, "c", "t", 5), (2, None, "u", 6), (3, " ", "v", 7), (4, "a b c d e f g", "w", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, uid int")
    kept = [tuple(r) for r in simhash.keep_one(docs).select("doc_id", "text").collect()]
    assert sorted(kept, key=str) == [(1, "a b"), (2, None), (4, "a b c d e f g"), (None, "c")]
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["tiny", "odd_dir"])
def test_archives(spark, which, request):
    sf = request.getfixturevalue(which)
    got = [tuple(r) for r in queries.QUERIES["op8_warc"](spark, sf).collect()]
    assert sorted(got) == sorted(plain.archive(rows_of(spark, sf, "pages", ("page_id", "html"))))


def test_archive_headers(spark):
    """Repeated rows of a response have record ids of their own; revisits refer by id, URL and date; each archive has a warcinfo."""
    import gzip
    import io

    rows = [(1, "u1", "same", 1), (5, "u5", "same", 2), (5, "u5", "same", 3), (None, "n", "same", 4), (None, "n", "same", 5), (5, "u5", "other", 6), (7, None, None, 7), (6, "e", "", 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    manifest = warc.write_archives(warc.resolve(pages), scratch_path(spark, "archives"), "2026-02-03T04:05:06Z")
    read = warc.read_archives(manifest).collect()
    assert len(read) == 8 and len({r["record_id"] for r in read}) == 8
    assert sorted((r["page_id"], r["record_type"]) for r in read if r["page_id"]) == [(1, "revisit"), (5, "response"), (5, "response"), (5, "response"), (6, "revisit"), (7, "response")]
    found = []
    for r in manifest.collect():
        with warc.open_read(r["path"]) as f:
            found.append(list(warc.read_archive(io.BufferedReader(gzip.GzipFile(fileobj=f)))))
    assert all([h["warc-type"] for h, _ in x].count("warcinfo") == 1 and x[0][0]["warc-type"] == "warcinfo" for x in found)
    revisit = next(h for x in found for h, _ in x if h.get("warc-target-uri") == "u1")
    assert (revisit["warc-refers-to-target-uri"], revisit["warc-refers-to-date"]) == ("u5", "2026-02-03T04:05:06Z")
    assert revisit["warc-refers-to"] in {r["record_id"] for r in read if r["page_id"] == 5}


def test_archives_have_urls(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    read = warc.read_archives(warc.write_archives(warc.resolve(pages), scratch_path(spark, "archives")))
    assert {r["page_id"]: r["url"] for r in read.collect()} == {r["page_id"]: r["url"] for r in pages.collect()}


@pytest.mark.parametrize("which", ["tiny", "odd_dir", "small"])
def test_benchmark(spark, which, request):
    sf = request.getfixturevalue(which)
    want = plain.template_matches(rows_of(spark, sf), rows_of(spark, sf, "benchmark", ("item_id", "text")), **RULES)
    got = {r["doc_id"]: (r["item_ids"], r["matched_tokens"]) for r in queries.QUERIES["op9_decontaminate"](spark, sf).collect()}
    assert got == want
    assert which == "odd_dir" or any(found for found, _ in got.values())


def test_other_parameters_match(spark):
    """Other names and numbers match if they do so consistently; ten words in a row match whatever stands beside them."""
    items = [(1, "If Anna buys 12 apples for 3 dollars each and then sells 4 of them, how much is left over in total for Anna?"), (2, None), (3, "too short"), (4, "Before noon Tom walked 5 miles to Dover and by dusk he and Tom were 9 miles from Dover again")]
    docs = [
        (1, "Quiz. If Bertha buys 15 apples for 7 euros each and then sells 6 of them, how much is left over in total for Bertha?"),
        (2, "Quiz. If Bertha buys 15 apples for 7 euros each and then sells 6 of them, how much is left over in total for Carl?"),
        (3, "If anyone buys apples, nothing is said of what they do with them afterwards, or of any total."),
        (4, "Before noon Ann walked 6 miles to Leeds and by dusk he and Ann were 8 miles from Leeds again"),
        (5, "Before noon Ann walked 6 miles to Leeds and by dusk he and Bob were 8 miles from York again"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.flag(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [4], 5: []}
    assert got == {i: found for i, (found, _) in plain.template_matches(docs, items, **RULES).items()}


def test_items_word_for_word(spark):
    """Short items, items of numbers and names, and an item of which only one of two equal values is changed."""
    items = [(1, "Solve 3 4 5 6 7 8 9 km now please."), (2, "What is entropy?"), (3, "A tank holds 5 barrels of oil and every hour the pump moves some of it over, until 5 barrels have left the yard for good"), (4, "...")]
    docs = [
        (1, "Quiz: solve 3 4 5 6 7 8 9 km now please"),
        (2, "Solve 4 4 5 6 7 8 9 km now please"),
        (3, "so what is entropy, then"),
        (4, "What is energy?"),
        (5, "A tank holds 5 barrels of oil and every hour the pump moves some of it over, until 7 barrels have left the yard for good"),
        (6, None),
        (7, "..."),
    ]
    want = {1: [1], 2: [], 3: [2], 4: [], 5: [3], 6: [], 7: []}
    items, docs_ = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["item_ids"] for r in decontaminate.flag(docs_, items).collect()} == want
    assert {i: found for i, (found, _) in plain.template_matches(docs, [tuple(r) for r in items.collect()], **RULES).items()} == want


def test_contamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two apples and pears in a basket of wood")], "item_id long, text string")
    text = "we saw one two apples and pears in a basket of wood"
    docs = spark.createDataFrame([(None, text, 1, 2), (1, text, 1, 3), (1, text, 1, 4), (2, None, 1, 5)], "doc_id long, text string, item_ids int, __key int")
    made = decontaminate.flag(docs, items)
    assert made.columns == ["doc_id", "text", "__key", "item_ids", "matched_tokens"]
    assert sorted((r["__key"], r["item_ids"], r["matched_tokens"]) for r in made.collect()) == [(2, [1], 10), (3, [1], 10), (4, [1], 10), (5, [], 0)]


@pytest.mark.parametrize("which", ["tiny", "odd_dir"])
def test_repeats(spark, which, request):
    sf = request.getfixturevalue(which)
    docs = rows_of(spark, sf)
    want = {i: (len((t or "").encode()), n, runs, hashlib.sha256(rest).hexdigest()) for (i, t), (n, runs, rest) in zip(docs, plain.repeats([t for _, t in docs]))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op10_repeats"](spark, sf).collect()}
    assert got == want


def test_repeats_at_random(spark):
    dice = random.Random(11)
    pool = ["".join(dice.choice("ab") for _ in range(dice.randint(350, 700))) for _ in range(12)]
    docs = [(i, "".join(dice.choice(pool)[dice.randint(0, 60) :] if dice.random() < 0.6 else "".join(dice.choice("xyz") for _ in range(dice.randint(0, 300))) for _ in range(dice.randint(0, 6)))) for i in range(80)]
    docs += [(900, "a" * 1500), (901, "ab" * 700), (902, None)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: rest for (i, _), (_, _, rest) in zip(docs, plain.repeats([t for _, t in docs]))}


@pytest.mark.parametrize("core_bytes", [1 << 18, 3000])
def test_planted_passages(spark, monkeypatch, core_bytes):
    """A passage in very many texts, of 400 bytes or of 399, among other words each time; also where its core is split."""
    monkeypatch.setattr(repeats, "CORE_BYTES", core_bytes)
    dice = random.Random(21)
    word = lambda n: "".join(dice.choice("abcdefghij ") for _ in range(n))
    passages = {n: word(n) for n in (399, 400, 431, 900)}
    docs = [(i, word(dice.randint(0, 300)) + "".join(chr(33 + i) + passages[n] + chr(33 + i) for n in passages if dice.random() < 0.7) + word(dice.randint(0, 300))) for i in range(60)]
    docs += [(60, "x" * 399), (60, "x" * 400), (61, "y" * 401)]  # equal ids; a string that starts twice in one text
    made = repeats.remove(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((r["doc_id"], bytes(r["kept"])) for r in made.collect())
    assert got == sorted((i, rest) for (i, _), (_, _, rest) in zip(docs, plain.repeats([t for _, t in docs])))
    assert not any(passages[n].encode() in rest for _, rest in got for n in (400, 431, 900)) and any(passages[399].encode() in rest for _, rest in got)


def test_repeats_of_odd_rows(spark):
    rows = [(None, PASSAGE, "a", 1), (None, PASSAGE, "b", 2), (1, None, "c", 3), (2, "", "d", 4), (3, "short", "e", 5)]
    made = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string, kept string, __key int"))
    assert made.columns == ["doc_id", "text", "__key", "kept", "spans"]
    assert sorted((r["__key"], bytes(r["kept"])) for r in made.collect()) == [(1, b""), (2, b""), (3, b""), (4, b""), (5, b"short")]


def test_widened_cores():
    """Each widening keeps its core in the string, and the last is the string."""
    body = "".join(random.Random(3).choice("abcd") for _ in range(900)).encode()
    import numpy as np

    first, n, _, _ = repeats.pieces(body, np.array([len(body)]))
    for at, k in zip(first.tolist(), n.tolist()):
        piece, sizes = body[at : at + k + repeats.LENGTH - 1], []
        for level in range(repeats.LEVELS + 1):
            a, b = repeats.wider(piece, k, level)
            assert (a >= np.arange(k)).all() and (b <= np.arange(k) + repeats.LENGTH).all() and len(set((b - a).tolist())) == 1
            sizes.append(int(b[0] - a[0]))
        assert sizes == sorted(set(sizes)) and sizes[0] == repeats.CORE and sizes[-1] == repeats.LENGTH


def test_transforms_of_many_shards(monkeypatch):
    import numpy as np

    dice = random.Random(2)
    pool = ["".join(dice.choice("abc") for _ in range(600)).encode() for _ in range(6)]
    strings = [dice.choice(pool)[dice.randint(0, 90) :][: dice.randint(420, 600)] for _ in range(40)]
    strings = list(dict.fromkeys(strings))
    starts = np.array([len(s) - repeats.LENGTH + 1 for s in strings])
    want = [[sum(t.count(s[i : i + 400]) for t in strings) > 1 for i in range(n)] for s, n in zip(strings, starts)]
    for shard_bytes in (1, 2000, 1 << 20):
        masks = repeats.repeated(strings, starts, np.ones(len(strings)), shard_bytes)
        assert [m.tolist() for m in masks] == want


def test_batches_of_repeats(spark, tiny, monkeypatch):
    """No function over Arrow in the search for repeats gets more than BATCH_ROWS rows of whole texts at a time."""

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = _common.materialise(spark.range(0, 100, 1, 1).mapInArrow(rows, "n long"), "batches", 7)
    assert max(r["n"] for r in made.collect()) <= 7
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == limit
    held = {}

    def noted(df, label, batch_rows=None):
        if "InArrow" in df._jdf.queryExecution().logical().toString():
            held[label] = batch_rows
        return _common.materialise(df, label, batch_rows)

    monkeypatch.setattr(repeats, "materialise", noted)
    monkeypatch.setattr(repeats, "CORE_BYTES", 1 << 10)  # so that cores are split
    docs = [(i, PASSAGE + f"tail {i} " * 9) for i in range(20)]
    repeats.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert set(held) >= {"pieces", "piece-bytes", "split-pieces", "repeats"}
    assert all(n and n <= repeats.BATCH_ROWS for n in held.values()), held


def test_rules_are_fitted_at_once(spark):
    """The rounds of expectation-maximisation are one query, whatever their number, with the same parameters."""
    columns = [f"q_vote_{rule[0]}" for rule in quality_rules.RULES]
    votes = [tuple(random.Random(i).choices((-1, 0, 1), (1, 2, 5), k=len(columns))) + (1 + i % 7,) for i in range(60)]
    patterns = spark.createDataFrame(votes, ", ".join(f"{c} int" for c in columns) + ", n long")
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        got = quality_rules.fit(patterns, 12)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 3
    theta, weight = quality_rules.start(), quality_rules.WEIGHT
    for _ in range(12):
        held = []
        for *vote, n in votes:
            odds = math.log(theta["good"]) - math.log(1 - theta["good"])
            for rule, v in zip(quality_rules.RULES, vote):
                gn, gp, bn, bp = (theta[f"{k}_{rule[0]}"] for k in ("gn", "gp", "bn", "bp"))
                odds += math.log({-1: gn, 1: gp, 0: 1 - gn - gp}[v]) - math.log({-1: bn, 1: bp, 0: 1 - bn - bp}[v])
            held.append((vote, n, 1 / (1 + math.exp(-odds))))
        share = lambda hit, of, first: (hit + weight * first) / (of + weight)
        after = {"good": share(sum(n * q for _, n, q in held), sum(n for _, n, _ in held), quality_rules.START["good"])}
        for i, rule in enumerate(quality_rules.RULES):
            for key, side in (("g", lambda q: q), ("b", lambda q: 1 - q)):
                for way, v in (("n", -1), ("p", 1)):
                    hit, of = sum(n * side(q) for vote, n, q in held if vote[i] == v), sum(n * side(q) for _, n, q in held)
                    after[f"{key}{way}_{rule[0]}"] = share(hit, of, quality_rules.START[key + way])
        theta = after
    assert list(got) == list(quality_rules.start())
    assert all(math.isclose(got[k], theta[k], rel_tol=1e-9) for k in theta)
    assert quality_rules.fit(patterns.limit(0)) == pytest.approx(quality_rules.start())
    assert quality_rules.fit(patterns, 0) == quality_rules.start()
