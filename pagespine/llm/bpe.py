"""Byte-level BPE through a sentencepiece model written directly from a rank vocabulary.

Every vocabulary entry becomes a piece spelled with one printable character per byte, scored by its negative
rank, under identity normalisation; the model's best-score-first merging is then the merging by lowest rank.
Texts are split into pre-tokens, each pre-token is spelled in the same alphabet and encoded alone, and decoding
maps the pieces' characters back to bytes. A pre-token that is a whole entry of the vocabulary is looked up, which gives
the id that the model gives it.

Defined results: a null text is encoded as an empty one (no ids, empty bytes, also for an empty table); repeated
rows give repeated results; other columns pass through unchanged, but one with the name of the output (``ids``, ``decoded``)
is replaced by it.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BATCH_ROWS, Memo, kept, runs_of, spare, split_sum, table

#: White space as the pre-token pattern understands it.
_SPACE = "\t-\r \x85\xa0  -     　"
#: White space after a visible character always starts a pre-token, so these chunks are split independently.
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Bytes of text that are handled at once in a task.
SLICE_BYTES = 1 << 20
#: Chunks of text that a worker remembers.
MEMO_ENTRIES = 250_000


@lru_cache(1)
def byte_alphabet() -> str:
    """One printable character per byte value: the byte's own where it is visible, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in visible else chr(next(spare)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(entries) != list(range(len(entries))):
        raise ValueError(f"{path}: ranks must be 0 to n - 1")
    return [entries[i] for i in range(len(entries))]


def model_bytes(entries: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece i is entry i."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_alphabet()
    model = pb.ModelProto()
    for rank, entry in enumerate(entries):
        model.pieces.add(piece="".join(letters[b] for b in entry), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(entries)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes in one worker; memos hold chunks of text seen before."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pre_tokens = regex.compile(pattern)
        self.spell = dict(enumerate(byte_alphabet()))
        size = self.model.get_piece_size() - 1
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.whole = {p: i for i, p in enumerate(self.pieces)}
        self.bytes_of = [bytes(map(back.__getitem__, p)) for p in self.pieces]
        self.memo = Memo(self._encode_chunks, np.uint32, MEMO_ENTRIES)

    def _encode_chunks(self, chunks):
        tokens, counts = [], []
        spell, space = self.spell, self.spell[0x20]
        for chunk in chunks:
            begun = chunk[0] == " "
            word = chunk[1:] if begun else chunk
            if word.isalpha():
                if word.isascii():  # visible ASCII is spelled as it is
                    tokens.append(space + word if begun else word)
                    counts.append(1)
                    continue
                found = [chunk]
            elif word[-1:] in (".", ",") and word[:-1].isalpha():
                if word.isascii():
                    tokens += (space + word[:-1] if begun else word[:-1], word[-1])
                    counts.append(2)
                    continue
                found = [chunk[:-1], word[-1]]
            else:
                found = self.pre_tokens.findall(chunk)
            counts.append(len(found))
            tokens += [t.encode("utf-8", "replace").decode("latin-1").translate(spell) for t in found]
        whole = list(map(self.whole.get, tokens))
        rest = [t for t, i in zip(tokens, whole) if i is None]
        encoded = iter(self.model.encode(rest, out_type=int, num_threads=1)) if rest else iter(())
        flat, runs = [], []
        for i in whole:
            if i is None:
                run = next(encoded)
                flat += run
                runs.append(len(run))
            else:
                flat.append(i)
                runs.append(1)
        sizes = split_sum(np.array(runs, np.int64), np.array(counts, np.int64))
        return np.array(flat, np.uint32), np.cumsum(sizes) - sizes, sizes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, for each text."""
        out = []
        for a, b in runs_of([len(t or "") for t in texts], SLICE_BYTES):
            chunks, counts = [], []
            for t in texts[a:b]:
                found = _CHUNK.findall(t or "")
                chunks += found
                counts.append(len(found))
            ids, sizes = self.memo.look_up(chunks)
            data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(split_sum(sizes, np.array(counts, np.int64)))
            out += [data[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return out

    def decode(self, ids: list[bytes | None]) -> list[bytes]:
        at = self.bytes_of.__getitem__
        return [b"".join(map(at, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]


def _by_slices(work, column: pa.Array) -> pa.Array:
    """What ``work`` makes of the values, some at a time, so that a batch isn't held as Python objects as a whole."""
    parts = [pa.array(work(column.slice(i, BATCH_ROWS).to_pylist()), pa.binary()) for i in range(0, len(column), BATCH_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def _codec(shared) -> Codec:
    """The worker's own codec for a broadcast (model, pattern)."""
    model, pattern = shared.value
    return kept((hash(model), pattern), lambda: Codec(model, pattern))


def tokenizer(spark: SparkSession, ranks_path: str, pattern: str):
    """The broadcast model; its size is that of the vocabulary file, whatever the corpus."""
    return spark.sparkContext.broadcast((model_bytes(read_ranks(ranks_path)), pattern))


def encode(docs: DataFrame, shared, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids of ``text`` as packed little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def ids(column: pa.Array) -> pa.Array:
        return _by_slices(_codec(shared).encode, column)

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, shared, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that the packed ids stand for."""

    @F.arrow_udf("binary")
    def data(column: pa.Array) -> pa.Array:
        return _by_slices(_codec(shared).decode, column)

    return docs.withColumn(out, data(F.col(ids)))


def encode_decode(docs: DataFrame, shared, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of its ids, in one function: chained apart, Spark asks for the ids once for each."""

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def both(column: pa.Array) -> pa.Array:
        codec = _codec(shared)
        made = _by_slices(codec.encode, column)
        return pa.StructArray.from_arrays([made, _by_slices(codec.decode, made)], names=["ids", "decoded"])

    made = spare(docs, "__made")
    return docs.withColumn(made, both(F.col(text))).withColumns({ids: F.col(f"{made}.ids"), out: F.col(f"{made}.decoded")}).drop(made)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared = tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs, shared), shared)
    return done.select(
        "doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
