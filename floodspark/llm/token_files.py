"""Token ids as flat binary files.

Format, in one folder: for every part ``part-NNNNN.bin`` (ids, little-endian unsigned 16-bit integers if
all ids fit, else 32-bit), ``part-NNNNN.idx`` (64-bit offsets in ids: where each document begins, and the
end) and ``part-NNNNN.doc`` (64-bit doc_ids; the least 64-bit integer stands for null). Parts follow each
other in doc_id order; a part's base is the number of ids before it, a prefix sum over the parts' totals.
Files are read back through memory maps (ranged reads where the store has no local path).
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.llm import bpe
from floodspark.llm import common as c

NULL_ID = np.iinfo(np.int64).min
#: Bytes of text that are encoded together.
SLICE_BYTES = 4 << 20
#: New words that make up one text for the library.
TOGETHER = 100
PART_BYTES = 16 << 20


class LibraryEncoder:
    """The tokenizers library's ids of texts; a piece of text met before is not encoded again."""

    def __init__(self, source: str, dtype: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype(dtype)
        spec = json.loads(source)
        self.cuts, self.keep = bpe.byte_level(spec), bpe.added(spec)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        #: Ids of tokens that begin with a blank.
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.piece = bpe.Recent(lambda raw: self.of([raw.decode("utf-8", "replace")])[0], bpe.CACHE)

    def of(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        """Encode words whose only white space is a blank before them, many in one text, and cut the ids at the blanks."""
        shown = [(w, s) for w in words if (s := w.decode("utf-8", "replace"))[:1] == " " and s.split() == [s[1:]]]
        groups = [shown[at : at + TOGETHER] for at in range(0, len(shown), TOGETHER)]
        for group, raw in zip(groups, self.of(["".join(s for _, s in x) for x in groups])):
            ids = np.frombuffer(raw, self.dtype)
            cut = (np.append(np.flatnonzero(self.begins[ids]), len(ids)) * self.dtype.itemsize).tolist()
            if len(cut) == len(group) + 1:  # else each word is encoded by itself when asked for
                for (word, _), a, b in zip(group, cut, cut[1:]):
                    self.piece.put(word, raw[a:b])

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        known, older = self.piece, self.piece.older
        self.learn([w for w in words if w not in known and w not in older])
        return [known[w] for w in words]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        if self.cuts:
            data, cut = bpe.encoded(column, self.keep, self.ids_of)
            return np.frombuffer(data, self.dtype)[: cut[-1] // self.dtype.itemsize], cut // self.dtype.itemsize
        found = self.of([x.as_py() or "" for x in column])
        return np.frombuffer(b"".join(found), self.dtype), np.concatenate([[0], np.cumsum([len(x) // self.dtype.itemsize for x in found])]).astype(np.int64)


_LOADED: dict[tuple, LibraryEncoder] = {}


def encoder(source: str, dtype: str) -> LibraryEncoder:
    if (key := (hash(source), dtype)) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = LibraryEncoder(source, dtype)
    return _LOADED[key]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> list[dict]:
    """Write ``docs`` (doc_id, text) to ``folder`` in ascending doc_id order (nulls first); the parts.

    A null text counts as empty; every document ends with ``end_id``. Rows that repeat a doc_id follow
    each other. An empty table gives no parts. Only the parts' totals reach the driver.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    size = Tokenizer.from_str(text).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(size - 1, end_id) < 1 << 16 else "<u4"
    source = spark.sparkContext.broadcast(text)
    c.small_batches(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-c.text_bytes(docs) // PART_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        name, tries = f"{root}/part-{part:05d}", f"{root}/.{uuid.uuid4().hex}"
        sizes, ids = [], []
        enc = encoder(source.value, dtype)
        out = None
        for batch in batches:
            for some in c.slices(batch, SLICE_BYTES):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{tries}.bin")
                got, cut = enc.encode(some.column("text"))
                sizes.append(np.diff(cut) + 1)
                ids.append(some.column("doc_id").fill_null(NULL_ID).to_numpy().astype("<i8"))
                out.write(np.insert(got, cut[1:], end_id).tobytes())
        if out is None:
            return
        out.close()
        sizes = np.concatenate(sizes)
        for kind, data in (("idx", np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")), ("doc", np.concatenate(ids))):
            with store.open_output_stream(f"{tries}.{kind}") as f:
                f.write(data.tobytes())
        for kind in ("bin", "idx", "doc"):  # complete files only, so that a second try of the task does no harm
            store.move(f"{tries}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())], ["part", "n_docs", "n_tokens"])

    totals = sorted(rows.mapInArrow(run, "part int, n_docs long, n_tokens long").collect())
    bases = np.concatenate([[0], np.cumsum([x.n_tokens for x in totals])]).tolist()
    return [{"part": x.part, "base": int(b), "n_docs": x.n_docs, "n_tokens": x.n_tokens, "dtype": dtype} for x, b in zip(totals, bases)]


def opened(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A memory map of a file; where the store is remote, its bytes."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(spark: SparkSession, folder: str, parts: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers) of every document in the files."""
    schema = "part int, base long, n_docs long, n_tokens long, dtype string"
    todo = spark.createDataFrame([tuple(p.values()) for p in parts], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for p in batch.to_pylist():
                name = f"{root}/part-{p['part']:05d}"
                ids, at, docs = opened(store, f"{name}.bin", p["dtype"]), opened(store, f"{name}.idx", "<i8"), opened(store, f"{name}.doc", "<i8")
                for lo in range(0, len(docs), 10_000):
                    own = np.asarray(docs[lo : lo + 10_000])
                    cut = np.asarray(at[lo : lo + len(own) + 1])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(p["base"] + cut[:-1], pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.repartition(max(1, len(parts)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files, below the shared folder unless told otherwise, and read them back."""
    spark = docs.sparkSession
    base = folder or f"{c.shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return read(spark, base, write(docs, base, tokenizer, end_id))
