"""The pipeline against the same stages in plain Python."""

import gc
import hashlib
import weakref
from types import SimpleNamespace

import pytest

from pagespine.llm import _common, bpe, decontaminate, quality_rules, simhash

from . import plain
from .test_operators import RULES, reference_encoding

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    kept = plain.quality_kept([t for _, t in docs], quality_rules.ROUNDS, quality_rules.START, quality_rules.WEIGHT)
    docs = [d for d, (_, keep) in zip(docs, kept) if keep]
    lined = plain.line_dedup(docs)
    docs = [(i, lined[i][1]) for i, _ in docs]
    stay = set(plain.similar(docs))
    docs = [(i, t) for i, t in docs if i in stay]
    found = plain.template_matches(docs, items, **RULES)
    docs = [(i, t) for i, t in docs if not found[i][0]]
    theirs, want = reference_encoding(), {}
    for i, t in docs:
        ids = theirs.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want
    assert decontaminate.WINDOW == 10


def test_stages_keep_columns(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, tiny)
        assert made.columns == docs.columns, name
        assert 0 < made.count() <= docs.count(), name
    assert len(corpus_pipeline.STAGES) == 5


def test_empty(spark, tiny, tmp_path):
    spark.read.parquet(f"{tiny}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tiny}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_keep_one_stage(spark):
    """A worker that goes on to the next stage drops what the last one kept."""
    shared = SimpleNamespace(value=(bpe.model_bytes([bytes([b]) for b in range(256)]), r"\w+|\W+"))
    tokens = weakref.ref(decontaminate._worker_tokens())
    assert decontaminate._worker_tokens() is tokens()
    codec = weakref.ref(bpe._codec(shared))
    assert bpe._codec(shared) is codec()
    gc.collect()
    assert tokens() is None
    decontaminate._worker_tokens()
    gc.collect()
    assert codec() is None


def test_batches_of_texts(spark, tiny, monkeypatch):
    """Whole texts go to Python BATCH_ROWS rows at a time, and the ids are made once."""
    held = {}

    def noted(df, label, batch_rows=None):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if "InArrow" in plan or "ArrowEvalPython" in plan:
            held[label] = batch_rows, plan
        return _common.materialise(df, label, batch_rows)

    for module in (corpus_pipeline, decontaminate, simhash):
        monkeypatch.setattr(module, "materialise", noted)
    corpus_pipeline.run(spark, tiny).count()
    texts = {"signatures", "shingle-sets", "met-windows", "stage-byte_level_bpe"}
    assert texts <= set(held)
    assert {held[label][0] for label in texts} == {_common.BATCH_ROWS}
    assert held["stage-byte_level_bpe"][1].count("(text#") == 1


def test_encode_decode(spark):
    import public_tokenizers

    shared = bpe.tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "naïve  words, words.\n\n  x\u3000y 12345", "c"), (3, "naïve  words", "c")], "doc_id long, text string, ids string")
    want = bpe.decode(bpe.encode(docs, shared), shared)
    got = bpe.encode_decode(docs, shared)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
