"""Toxicity: a factorisation machine over hashed terms.

Terms are the 64-bit hashes of a text's lower-cased words and of the first bytes of longer words (word
families share a stem). All of them are folded into SLOTS slots; none is screened out. The machine adds to
linear weights an inner product of factors for every two slots of a text, so it learns pairs such as an
insult with the mention of a group, also where neither tells anything alone.

    logit = b + sum_i w_i + sum_(i<j) <v_i, v_j> / sqrt(n)      over the n distinct model slots of the text
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm import common as c
from floodspark.llm.lm_score import held_out

#: Bytes other than letters, digits and those of non-ASCII characters separate words.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False
STEMS = (4, 5, 6)
#: Terms are folded into so many slots, a power of two: the model has at most as many weights and factor rows.
SLOTS = 1 << 18
#: Bytes of text that are handled at once.
SLICE_BYTES = 1 << 18
#: Shards' machines are averaged in blocks of so many slots.
BLOCK = 1 << 14
#: The chi-square root at which a slot's linear input is 1; what AdaGrad's sums of squares begin with.
CHI, CALM = 5.0, 1e-2


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of the texts, repeats included, and the text it is in."""
    data, offsets = c.utf8(column)
    data = c.LOWER[data]
    start, end, first = c.words(data, offsets, APART)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes, docs = [c.word_hashes(data, start, end)], [doc]
    for k in STEMS:
        longer = end - start > k
        hashes.append(c.mix(c.word_hashes(data, start[longer], start[longer] + k) + np.uint64(k)))
        docs.append(doc[longer])
    return np.concatenate(hashes), np.concatenate(docs)


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots of each text's terms, and the text each is in, by text and slot."""
    hashes, docs = terms(column)
    both = c.sorted_set(docs * np.int64(SLOTS) + (hashes & np.uint64(SLOTS - 1)).astype(np.int64))
    return both % SLOTS, both // SLOTS


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Machine:
    """terms: sorted slots that the training texts fill; bias, w (slots) and v (slots x factors)."""

    def __init__(self, terms: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.terms, self.bias, self.w, self.v = terms, bias, w, v

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The distinct model slots of each text, as parallel arrays of text and place in ``terms``."""
        place = np.full(SLOTS, -1, np.int64)
        place[self.terms.astype(np.int64)] = np.arange(len(self.terms))
        docs, places, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for part in c.slices(pa.RecordBatch.from_arrays([column], ["text"]), SLICE_BYTES):
            slot, doc = folded(part.column("text"))
            docs.append(doc[place[slot] >= 0] + before)
            places.append(place[slot][place[slot] >= 0])
            before += part.num_rows
        return np.concatenate(docs), np.concatenate(places)

    def logits(self, doc: np.ndarray, at: np.ndarray, texts: int) -> np.ndarray:
        n = np.sqrt(np.maximum(np.bincount(doc, minlength=texts), 1))
        out = self.bias + np.bincount(doc, self.w[at], texts)
        for v in np.ascontiguousarray(self.v[at].T):
            out += (np.bincount(doc, v, texts) ** 2 - np.bincount(doc, v * v, texts)) / 2 / n
        return out


def epoch(m: Machine, rows: list[np.ndarray], y: np.ndarray, grad2: list[np.ndarray], rate: float, l2: float, order: np.ndarray, batch: int = 64, strength: np.ndarray | None = None) -> None:
    """One AdaGrad pass over texts given as arrays of term places; changes ``m`` in place.

    ``strength`` scales the linear input of each term (1 if not given); ``m.w`` holds weight times input.
    """
    strength = np.ones(len(m.w)) if strength is None else strength
    for lo in range(0, len(order), batch):
        own = order[lo : lo + batch]
        doc = np.repeat(np.arange(len(own)), [len(rows[k]) for k in own])
        at = np.concatenate([rows[k] for k in own])
        error = sigmoid(m.logits(doc, at, len(own))) - y[own]
        n = np.sqrt(np.maximum(np.bincount(doc, minlength=len(own)), 1))
        used, place = np.unique(at, return_inverse=True)
        gw = strength[used] * (np.bincount(place, error[doc], len(used)) / len(own) + l2 * m.w[used])
        grad2[0][used] += gw * gw
        m.w[used] -= rate * strength[used] * gw / np.sqrt(grad2[0][used])
        rows_v = m.v[used]
        gv, share = np.empty(rows_v.shape), error[doc] / n[doc] / len(own)
        for f, column in enumerate(np.ascontiguousarray(rows_v.T)):
            v = column[place]
            gv[:, f] = np.bincount(place, share * (np.bincount(doc, v, len(own))[doc] - v), len(used))
        gv += l2 * rows_v
        squares = grad2[1][used] + gv * gv
        grad2[1][used] = squares
        m.v[used] = rows_v - rate * gv / np.sqrt(squares)
        m.bias -= rate * error.mean()


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, factors: int = 8, shards: int = 6, rounds: int = 8, epochs: int = 3, rate: float = 0.1, l2: float = 1e-5, modulus: int = 4, remainder: int = 2) -> Machine:
    """Learn ``labels.toxic`` (0 or 1; null: no label) from rows whose crc32(doc_id) mod ``modulus`` is not ``remainder``.

    The fit is bounded: the labelled documents with the smallest hashes of their ids, about ``train_rows``. All
    their terms count, folded into SLOTS slots. The linear input of a slot is the root of its chi-square with the
    label, so that the many slots of chance words move little; factors learn from all slots alike.
    ``shards`` tasks pass over their shards; after each round their machines are averaged.
    """
    spark = docs.sparkSession
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    portion = min(1.0, train_rows / max(marked.count(), 1))
    marked = marked.filter(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) < int(portion * (1 << 30))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # about train_rows ids at most

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct slots of each text, so that texts are cut into terms once."""
        for batch in batches:
            for part in c.slices(batch, SLICE_BYTES):
                slot, doc = folded(part.column("text"))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("shard"), part.column("text_hash"), pa.ListArray.from_arrays(cut, pa.array(slot, pa.int32()))], ["toxic", "shard", "text_hash", "slots"])

    c.small_batches(spark)
    train = train.select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("text").alias("text_hash"))
    train = c.stored(train.mapInArrow(places, "toxic int, shard int, text_hash long, slots array<int>"))
    positive, rows = (int(x or 0) for x in train.agg(F.sum("toxic"), F.count("*")).first())
    prior = float(np.log((positive + 0.5) / (rows - positive + 0.5)))
    empty = Machine(np.zeros(0, np.uint64), prior, np.zeros(0), np.zeros((0, factors)))
    if not positive or positive == rows:
        return empty

    # no more than SLOTS rows reach the driver
    table = train.select("toxic", F.explode("slots").alias("term")).groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).toArrow().sort_by("term")
    best, bad, n = table["term"].to_numpy().astype(np.uint64), table["bad"].to_numpy().astype(np.float64), table["n"].to_numpy().astype(np.float64)
    if not len(best):
        return empty
    expected = n * (positive / rows)
    chi2 = (bad - expected) ** 2 / np.maximum(expected * (1 - n / rows) * (1 - positive / rows), 1e-9)
    strength = np.sqrt(chi2) / CHI
    rng = np.random.default_rng(7)
    machine = Machine(best, prior, np.zeros(len(best), np.float32), rng.normal(0, 0.05, (len(best), factors)).astype(np.float32))
    scale = spark.sparkContext.broadcast(strength)
    for turn in range(rounds):
        now = spark.sparkContext.broadcast(machine)

        def learn(key, part):
            m = Machine(now.value.terms, now.value.bias, now.value.w.copy(), now.value.v.copy())
            part = part.sort_values(["toxic", "text_hash"])
            place = np.full(SLOTS, -1, np.int64)
            place[m.terms.astype(np.int64)] = np.arange(len(m.terms))
            own = [place[x] for x in part["slots"]]
            y = part["toxic"].to_numpy(np.float64)
            grad2 = [np.full(m.w.shape, CALM, np.float32), np.full(m.v.shape, CALM, np.float32)]
            order = np.random.default_rng(turn)
            for _ in range(epochs):
                epoch(m, own, y, grad2, rate, l2, order.permutation(len(y)), strength=scale.value)
            cuts = range(0, len(m.w), BLOCK)
            return pd.DataFrame({"block": cuts, "n": len(y), "bias": m.bias, "w": [m.w[k : k + BLOCK].tobytes() for k in cuts], "v": [m.v[k : k + BLOCK].tobytes() for k in cuts]})

        def mean(key, part):
            part = part.sort_values(["n", "bias"])
            n = part["n"].to_numpy() / part["n"].sum()
            w, v = (sum(x * np.frombuffer(y, np.float32) for x, y in zip(n, part[k])).astype(np.float32).tobytes() for k in ("w", "v"))
            return pd.DataFrame({"block": [key[0]], "bias": [n @ part["bias"]], "w": [w], "v": [v]})

        # one machine (at most SLOTS x (factors + 1) numbers) for each of a fixed number of shards
        got = train.groupBy("shard").applyInPandas(learn, "block long, n long, bias double, w binary, v binary")
        got = got.groupBy("block").applyInPandas(mean, "block long, bias double, w binary, v binary").toArrow().sort_by("block")
        w, v = (np.frombuffer(b"".join(got[k].to_pylist()), np.float32) for k in ("w", "v"))
        machine = Machine(best, got["bias"][0].as_py(), w, v.reshape(-1, factors))
        c.release(spark)
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and toxicity (0 to 1) of every row of ``docs`` (doc_id, text), from whole texts.

    A null or empty text, or one without model terms, gets the score of the bias; a null doc_id stays
    null; rows are independent; an empty table gives no rows. Other columns are not read.
    """
    c.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in c.slices(batch, SLICE_BYTES):
                doc, at = m.present(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sigmoid(m.logits(doc, at, part.num_rows)))], ["doc_id", "toxicity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, toxicity double")
