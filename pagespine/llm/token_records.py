"""Token ids in length-delimited binary record files with a separate offset index.

A record is: the length of the data as an unsigned 64-bit integer, the masked checksum of those 8 bytes, the data,
and the masked checksum of the data; all little-endian. The checksum is CRC-32 (zlib's), rotated right by 15 bits
plus 0xA282EAD8, so that a checksum stored inside a record isn't mistaken for its own. The data are the ids as
unsigned 16-bit integers where the vocabulary has at most 65,536 entries, else as 32-bit ones. Beside each record
file lies a Parquet index: doc_id, offset of the record, its length, and its number of ids; a reader that shuffles
records needs no scan.

Order: ascending doc_id over all files (a null id first), rows with equal ids by a hash of their text. A null text is
empty: the record has only the end id. Repeated rows give repeated records. An empty table gives no file and no row.
Other columns are not read.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Memo, make_dirs, materialise, open_read, open_write, runs_of, scratch_path, shuffle_partitions, split_sum, table, task_file, text_key

HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
SLICE_CHARS = 4 << 20
#: A word of Latin letters, with ASCII marks behind it or not: its normal form is itself in lower case, and letters and
#: marks are one piece each. Apostrophes are left out, as they begin pieces of their own.
PLAIN = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The normalizer and the splitting of which that holds.
PLAIN_FORMS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return b"".join((size, TAIL.pack(masked(size)), data, TAIL.pack(masked(data))))


def read_record(f) -> bytes | None:
    """The next record's data, or None at the end of the file."""
    head = f.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("truncated record head")
    size, crc = HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError("damaged record length")
    body = f.read(size + TAIL.size)
    if len(body) < size + TAIL.size or masked(body[:size]) != TAIL.unpack(body[size:])[0]:
        raise ValueError("damaged record data")
    return body[:size]


def read_at(path: str, offsets) -> list[bytes]:
    """Records at the given offsets, in the given order: what a shuffled read does with the index."""
    with open_read(path) as f:
        out = []
        for at in offsets:
            f.seek(at)
            out.append(read_record(f))
        return out


class WordEncoder:
    """Encodes texts word by word with a memo; the tokenizer drops white space, so words are independent.

    Plain words are made of pieces that have a memo too: spellings that differ in case or in marks behind them are one.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.tokenizer.model._resize_cache(0)  # the memo knows what comes again; the rest comes once
        self.point, self.comma = (e.ids[-1] for e in self.tokenizer.encode_batch_fast([".", ","], add_special_tokens=False))
        self.memo, self.parts = Memo(self._words, np.uint32), Memo(self._parts, np.uint32)
        forms = tuple(json.loads(x.__getstate__()) if x else None for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_plain = forms == PLAIN_FORMS and not any(PLAIN.fullmatch(t) or not PLAIN.sub("", t) for t in added)
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _parts(self, parts):
        """Ids of pieces in lower case, as ``_words`` gives them."""
        flat, sizes = [], []
        for a in range(0, len(parts), 256):
            some = parts[a : a + 256]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):  # the vocabulary lacks the end of a piece
                each = [e.ids for e in self.pieces.encode_batch_fast(some, add_special_tokens=False)]
                ids, ends = np.array(sum(each, []), np.uint32), np.cumsum([len(x) for x in each])
            flat.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        sizes = np.concatenate([*sizes, np.empty(0, np.int64)])
        return np.concatenate([*flat, np.empty(0, np.uint32)]), np.cumsum(sizes) - sizes, sizes

    def _words(self, words):
        """Ids of all words end to end, and each word's start and length there."""
        parts, n_parts, rest = [], [], []
        for w in words:
            m = PLAIN.fullmatch(w) if self.has_plain else None
            if m is None:
                rest.append(w)
                n_parts.append(0)
                continue
            letters, marks = m.groups()
            parts.append(letters)
            if marks:
                parts.append(marks)
            n_parts.append(2 if marks else 1)
        counts = np.array(n_parts, np.int64)
        flat, made = self.parts.look_up("\n".join(parts).lower().split("\n") if parts else [])
        more, begins, lengths = self._others(rest)
        sizes = split_sum(made, counts)
        starts = np.cumsum(sizes) - sizes
        starts[counts == 0], sizes[counts == 0] = len(flat) + begins, lengths
        return np.concatenate([flat, more]), starts, sizes

    def _others(self, words):
        """The same for words that need not be plain.

        Words of letters, with at most one point or comma behind, go in joined to one text; each is one or two pieces,
        whose last ids can be told.
        """
        n_pieces = np.fromiter((1 if w.isalpha() else 2 if w[-1:] in (".", ",") and w[:-1].isalpha() else 0 for w in words), np.int64, len(words))
        starts, sizes = np.empty((2, len(words)), np.int64)
        flat, used, apart = [], 0, np.flatnonzero(n_pieces == 0).tolist()
        plain = np.flatnonzero(n_pieces)
        for a in range(0, len(plain), 256):
            at = plain[a : a + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in at.tolist()])], add_special_tokens=False)[0].ids, np.uint32)
            ends, counts = np.flatnonzero(self.ends[ids]) + 1, n_pieces[at]
            if len(ends) == counts.sum():
                ends = ends[np.cumsum(counts) - 1]
                marks = (ids[ends - 1] == self.point) | (ids[ends - 1] == self.comma)
            if len(ends) != len(at) or (marks != (counts == 2)).any():  # the tokenizer splits a word further
                apart += at.tolist()
                continue
            begins = np.concatenate(([0], ends[:-1]))
            starts[at], sizes[at] = used + begins, ends - begins
            flat.append(ids)
            used += len(ids)
        for i, e in zip(apart, self.tokenizer.encode_batch_fast([words[i] for i in apart], add_special_tokens=False)):
            starts[i], sizes[i] = used, len(e.ids)
            flat.append(np.array(e.ids, np.uint32))
            used += len(e.ids)
        return np.concatenate([*flat, np.empty(0, np.uint32)]), starts, sizes

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        out = []
        for a, b in runs_of([len(t or "") for t in texts], SLICE_CHARS):
            words, counts = [], []
            for t in texts[a:b]:
                found = (t or "").replace("\n", " ").split(" ")
                words += found
                counts.append(len(found))
            ids, sizes = self.memo.look_up(words)
            ends = np.cumsum(split_sum(sizes, np.array(counts, np.int64))).tolist()
            out += [np.append(ids[i:j], np.uint32(end_id)) for i, j in zip([0, *ends[:-1]], ends)]
        return out


_encoders: dict = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Writes ids of all texts in ascending ``doc_id`` order; returns the manifest, one row per file.

    Rows are dealt by ranges of the id, so each file is one task's and the files follow one another. Manifest:
    part, path, index_path, n_docs, n_ids. Its rows name only files of tasks that succeeded.
    """
    spark = docs.sparkSession
    make_dirs(folder)
    kind = docs.schema[doc_id].dataType

    def write(batches):
        encoder, f, index, at, n_ids = _encoder(tokenizer_path), None, [], 0, 0
        dtype = "<u2" if encoder.size <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for batch in batches:
            if f is None and batch.num_rows:
                path = task_file(folder, ".records")
                f = open_write(path)
            keys = batch.column(0)
            made, offsets, lengths, counts = io.BytesIO(), [], [], []
            for ids in encoder.encode(batch.column(1).to_pylist(), end_id):
                record = frame(ids.astype(dtype).tobytes())
                made.write(record)
                offsets.append(at)
                lengths.append(len(record))
                counts.append(len(ids))
                at += len(record)
                if made.tell() > 8 << 20:
                    f.write(made.getvalue())
                    made = io.BytesIO()
            n_ids += sum(counts)
            if f is not None:
                f.write(made.getvalue())
                index.append(pa.table({"doc_id": keys, "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64()), "n_ids": pa.array(counts, pa.int64())}))
        if f is None:
            return
        f.close()
        whole = pa.concat_tables(index)
        with open_write(f"{path}.index.parquet") as out:
            pq.write_table(whole, out)
        from pyspark import TaskContext

        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "index_path": [f"{path}.index.parquet"], "dtype": [dtype], "n_docs": pa.array([whole.num_rows], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("tie"))
    dealt = keyed.repartitionByRange(files or shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    assert kind == dealt.schema["doc_id"].dataType
    return materialise(dealt.mapInArrow(write, "part int, path string, index_path string, dtype string, n_docs long, n_ids long"), "token-manifest")


def read_records(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per record, read from the files: doc_id, start, n_tokens, ids (packed unsigned 32-bit integers).

    The driver sees one row per file, to add up where each file starts; records are read by one task per file.
    """
    spark = manifest.sparkSession
    shards, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):
        shards.append((row["path"], row["index_path"], row["dtype"], start))
        start += row["n_ids"]

    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                with open_read(shard["index_path"]) as f:
                    index = pq.read_table(f)
                at, first = 0, shard["start"]
                with open_read(shard["path"]) as raw:
                    f = io.BufferedReader(raw, 4 << 20)
                    counts = index.column("n_ids").to_pylist()
                    for a, b in runs_of([4 * n for n in counts], 4 << 20):
                        ids, starts = [], []
                        for n in counts[a:b]:
                            found = np.frombuffer(read_record(f), shard["dtype"])
                            if len(found) != n:
                                raise ValueError(f"{shard['path']}: record {at} doesn't fit the index")
                            ids.append(found.astype("<u4").tobytes())
                            starts.append(first)
                            first += n
                            at += 1
                        yield pa.RecordBatch.from_arrays([index.column("doc_id").slice(a, b - a).combine_chunks(), pa.array(starts, pa.int64()), pa.array(counts[a:b], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.createDataFrame(shards, "path string, index_path string, dtype string, start long")
    return files.repartition(max(1, len(shards))).mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_records(table(spark, sf_dir, "documents"), scratch_path(spark, "token-records"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_records(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
