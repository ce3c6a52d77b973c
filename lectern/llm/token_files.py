"""Token ids in Arrow files of fixed-size lists (dealt operator 1).

Each file is one shard of a token stream in ascending doc_id order. A row is one sequence: tokens, a fixed-size list of
unsigned integers (16 bits if the vocabulary fits); mask, a fixed-size list of as many bits (set for tokens, not for
padding); and of the documents that end in the sequence, their places after the last token (ends) and doc_ids. All batches but a shard's last have the same number of rows, so
sequence k of a mapped file is found by arithmetic and read without a copy (sequence()).
"""

from __future__ import annotations

import json
import posixpath
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe_automaton import byte_letters
from lectern.llm.chunks import ChunkMemo, split_chunks
from lectern.llm.shared import new_folder, text_batches

LENGTH, ROWS, END_ID = 2048, 256, 2


class Encoder:
    """The tokenizers library over whole texts. Where a file drops white space, pieces between it are encoded once each."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        added = [x for x in spec["added_tokens"] if x["lstrip"] or x["rstrip"] or x["single_word"] or any(map(str.isspace, x["content"]))]
        self.by_chunk = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and not added
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["invert"]
            and steps[0]["behavior"] == "Removed"
            and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in steps[0]["pattern"]["Regex"]
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
        )
        self.memo = ChunkMemo(self._bytes)

    def _bytes(self, text: str) -> bytes:
        if self.by_chunk and text.isalpha() and text == text.lower() and max(text) < "\u0250" and unicodedata.is_normalized("NFC", text):
            # one word that the file's other steps leave as it is: only its model has work to do
            ids = [t.id for t in self.model.tokenize(text if text.isascii() else "".join([self.letters[b] for b in text.encode()]))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        text = text or ""
        return b"".join(map(self.memo.__getitem__, split_chunks(text))) if self.by_chunk else self._bytes(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


def _schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])


class ShardWriter:
    """Cuts a stream of documents into sequences; holds one batch of them."""

    def __init__(self, out, length: int, rows: int, vocabulary: int):
        self.length = length
        kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
        self.schema = _schema(length, kind)
        self.writer = pa.ipc.new_file(out, self.schema)
        self.ids, self.ends = np.zeros(length * rows, kind.to_pandas_dtype()), []
        self.at, self.n_ids, self.n_docs = 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_ids, self.n_docs, done = self.n_ids + len(ids), self.n_docs + 1, 0
        while done < len(ids):
            n = min(len(ids) - done, len(self.ids) - self.at)
            self.ids[self.at : self.at + n] = ids[done : done + n]
            done, self.at = done + n, self.at + n
            if done == len(ids):
                self.ends.append((self.at, doc_id))
            if self.at == len(self.ids):
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.at // self.length)
        if not rows:
            return
        n = rows * self.length
        self.ids[self.at : n] = 0
        places = np.array([e for e, _ in self.ends], np.int64)
        in_row = (places - 1) // self.length
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(in_row, minlength=rows))]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(places - in_row * self.length, pa.int32()), pa.array([d for _, d in self.ends], pa.int64()))]
        fixed = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(self.ids[:n]), pa.array(np.arange(n) < self.at))]
        self.writer.write_batch(pa.record_batch([*fixed, *lists], schema=self.schema))
        self.at, self.ends = 0, []

    def close(self) -> None:
        self._flush()
        self.writer.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes the shards of docs (doc_id, text) and returns the manifest: shard, path, n_ids, n_docs, first_id.

    Documents are dealt by ranges of doc_id, each task writes one shard, and only shards of tasks that succeeded are in the
    manifest, so a task that is run again does no harm. A null text counts as empty: just the end id. Rows that repeat an
    id all stay, ordered by text; a null id comes first. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, out, path = TaskContext.get().partitionId(), None, None
        fs, base = pafs.FileSystem.from_uri(folder)
        enc = encoder(tokenizer_path)
        for batch in batches:
            if out is None:
                fs.create_dir(base)
                path = posixpath.join(base, f"shard-{shard:06d}-{uuid.uuid4().hex}.arrow")
                stream = fs.open_output_stream(path)
                out = ShardWriter(stream, length, rows, max(enc.tokenizer.get_vocab_size(), end_id + 1))
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                out.add(None if doc_id == "" else int(doc_id), np.append(np.frombuffer(enc.encode(text), "<u4"), np.uint32(end_id)))
        if out is not None:
            out.close()
            stream.close()
            yield pd.DataFrame([(shard, path, out.n_ids, out.n_docs)], columns=["shard", "path", "n_ids", "n_docs"])

    dealt = text_batches(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = dealt.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").mapInPandas(run, "shard int, path string, n_ids long, n_docs long").collect()  # one row per shard
    table, first = [], 0
    for r in sorted(made):
        table.append((*r, first))
        first += r["n_ids"]
    return spark.createDataFrame(table, "shard int, path string, n_ids long, n_docs long, first_id long")


def sequence(source: pa.NativeFile, k: int, rows: int = ROWS) -> tuple[pa.Array, pa.Array]:
    """Tokens and mask of sequence k of an open (memory-mapped) shard, as views of the file."""
    batch = pa.ipc.open_file(source).get_batch(k // rows)
    return tuple(batch.column(c)[k % rows].values for c in ("tokens", "mask"))


def documents_in(source) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """Documents of a shard in order, each as its pieces; holds one document and one batch."""
    reader, held = pa.ipc.open_file(source), []
    for b in range(reader.num_record_batches):
        batch = reader.get_batch(b)
        ids, ends, at = batch.column("tokens").flatten().to_numpy(), batch.column("ends"), 0
        rows = np.repeat(np.arange(len(ends)), ends.value_lengths().to_numpy())
        length = batch.schema.field("tokens").type.list_size
        for end, doc_id in zip(rows * length + ends.flatten().to_numpy(), batch.column("doc_ids").flatten().to_pylist(), strict=True):
            yield doc_id, [*held, ids[at:end]]
            held, at = [], end
        if at < (n := batch.column("mask").flatten().true_count):
            held.append(ids[at:n].copy())


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch["path"], batch["first_id"], strict=True):
                out = []
                with fs.open_input_file(path) as source:
                    for doc_id, pieces in documents_in(source):
                        n, crc = 0, 0
                        for piece in pieces:
                            n, crc = n + len(piece), zlib.crc32(piece.astype("<u4"), crc)
                        out.append(("" if doc_id is None else str(doc_id), int(start), n, crc))
                        start += n
                        if len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    n = max(1, manifest.count())
    one_each = manifest.repartition(n, "shard") if n > 1 else manifest
    return one_each.select("path", "first_id").mapInPandas(run, "doc_id string, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit("")).cast("long"))


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Writes docs to token files and returns what read_token_files() reads from them."""
    folder = folder or new_folder(spark, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer_path), folder)
