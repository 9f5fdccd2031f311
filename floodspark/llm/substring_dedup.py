"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every chunk of documents hashes its word windows and asks the buckets that own the hashes which of them other
chunks have too. Windows with such a hash, or with one that the chunk has twice, are asked about again by a
second, independent hash beside the first and with the smallest doc_id that has them; buckets answer whether
another chunk has a smaller one. So windows count as equal if 128 bits agree. Removed windows merge into
maximal word intervals.

Nulls and edges: a null text has no words; a document shorter than a window keeps all its words; a null
doc_id counts as larger than every other; rows with the same doc_id do not remove each other; bytes that are no
UTF-8 are compared as they are and shown as replacement characters; an empty table gives no rows. Other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm import common as c

LAST = np.iinfo(np.int64).max
#: Two hashes of words (bytes, starts, ends); tests put weaker ones in their place.
HASHES = (c.word_hashes, lambda data, start, end: c.word_hashes(data, start, end, c.OTHER))


class Windows:
    """The word windows of a chunk's texts, in ascending doc_id order."""

    def __init__(self, table: pa.Table, width: int, hashes: tuple[Callable, Callable]) -> None:
        ids = c.flat(table.column("doc_id")).cast(pa.int64()).fill_null(LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table, self.width, self.second = table.take(pa.array(order)), width, hashes[1]
        self.data, offsets = c.utf8(self.table.column("text"))
        self.start, self.end, self.first = c.words(self.data, offsets)
        rolled = c.rolling(hashes[0](self.data, self.start, self.end), width)
        self.at = np.flatnonzero(c.whole(self.first, width, len(rolled)))
        self.rolled = rolled[self.at]
        self.keys, self.count = np.unique(self.rolled, return_counts=True)
        self.owner = np.repeat(ids[order], np.diff(self.first))[self.at]

    def twice(self, shared: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the windows whose first hash another chunk (``shared``) or this one has too: their numbers, the sorted
        distinct pairs of hashes, which of these each has, and the smallest doc_id of each pair."""
        wanted = self.keys[shared | (self.count > 1)]
        place = np.searchsorted(wanted, self.rolled).clip(0, max(len(wanted) - 1, 0))
        some = np.flatnonzero(wanted[place] == self.rolled) if len(wanted) else place[:0]
        one = self.rolled[some]
        two = c.rolling(self.second(self.data, self.start, self.end), self.width)[self.at[some]] if len(some) else one
        order = np.lexsort((self.owner[some], two, one))
        a, b = one[order], two[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        which = np.empty(len(some), np.int64)
        which[order] = np.cumsum(new) - 1
        return some, [a[new], b[new]], which, self.owner[some][order][new]


def repeated_words(docs: DataFrame, width: int = 13, hashes: tuple[Callable, Callable] = HASHES) -> DataFrame:
    """doc_id, n_words, n_removed, spans (begin, end in words of each maximal removed interval) and
    kept (what is left, joined by one space) of every row of ``docs`` (doc_id, text): a word goes if a
    window of ``width`` words that covers it also starts in a document with a smaller doc_id."""
    n = c.parts(docs)
    chunks = c.in_chunks(docs, n)

    def ask(table):
        return Windows(table, width, hashes).keys, []

    def shared(columns, _):
        _, which, count = np.unique(columns[0], return_inverse=True, return_counts=True)
        return (count[which] > 1).astype(np.uint8), []

    def bits(replies, keys):
        return c.answers(replies).astype(bool) if len(keys) else np.zeros(0, bool)

    def ask_again(table, replies):
        w = Windows(table, width, hashes)
        _, (one, two), _, least = w.twice(bits(replies, w.keys))
        return one, [two, least]

    def earlier(columns, _):
        one, two, least = columns
        order = np.lexsort((least, two, one))
        a, b, d = one[order], two[order], least[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        smallest = d[new][np.cumsum(new) - 1]
        out = np.empty(len(a), np.uint8)
        out[order] = smallest < d
        return out, []

    def finish(table, replies):
        w = Windows(table, width, hashes)
        table, first = w.table, w.first
        round_ = replies.column("round").to_numpy()
        some, (one, _), which, least = w.twice(bits(replies.filter(pa.array(round_ == 1)), w.keys))
        before = bits(replies.filter(pa.array(round_ == 2)), one)
        gone = c.covered(w.at[some[before[which] | (w.owner[some] > least[which])]], width, len(w.start))
        raw = c.texts(table.column("text"))
        spans, kept, removed = [], [], []
        for row, text in enumerate(raw):
            mask = gone[first[row] : first[row + 1]]
            own = text.split()
            if mask.any():
                cut = np.flatnonzero(np.diff(mask, prepend=False, append=False))
                spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(cut[::2], cut[1::2])])
                own = [w for w, g in zip(own, mask) if not g]
            else:
                spans.append([])
            kept.append(b" ".join(own).decode("utf-8", "replace"))
            removed.append(int(mask.sum()))
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.string())})

    told = c.stored(c.asked(chunks, ask, [], shared, n).drop("notes"))
    c.release(docs.sparkSession)
    again = c.stored(c.asked(chunks, ask_again, ["<u8", "<i8"], earlier, n, told).drop("notes"))
    c.release(docs.sparkSession)
    replies = told.withColumn("round", F.lit(1)).unionByName(again.withColumn("round", F.lit(2)))
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, kept string"
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema)


def brute_force(rows: list[tuple[int, str | None]], width: int = 13) -> dict[int, tuple[int, int, str]]:
    """The same for a small list, by a dictionary of windows; for tests."""
    split = {i: (t or "").encode().split() for i, t in rows}
    least: dict[tuple, int] = {}
    for i in sorted(split):
        for k in range(len(split[i]) - width + 1):
            least.setdefault(tuple(split[i][k : k + width]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out
