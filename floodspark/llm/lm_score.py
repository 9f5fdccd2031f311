"""Language-model scores by deleted interpolation.

    p1(w) = (1 - l1) / (V + 1) + l1 c(w) / N                 weights l1, l2 by bucket of c(h)
    p2(w | h) = (1 - l2) p1(w) + l2 c(h w) / c(h)            h: the word before, or the text's begin
    p3(w | g h) = (1 - l3) p2(w | h) + l3 c(g h w) / c(g h)  where c(g h) is 1 or more; else p2

over training tokens. The weights depend on the context's frequency (buckets are powers of two) and are
learned by expectation-maximisation on held-out counts: every training token in turn is deleted from the
counts that predict it. What EM needs, how many tokens have which bucket and which estimates (to an eighth of
a power of two), are tables of bounded size, summed over all training tokens in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm import common as c

#: What stands for the end and the begin of a text among word hashes.
END, BEGIN = np.uint64(0xE7D1), np.uint64(0xB361)
STEPS, LEVELS, BUCKETS = 8, 512, 32
#: Text bytes of a chunk.
CHUNK_BYTES = 5 << 20


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % modulus == remainder, F.lit(False))


class Tokens:
    """Tokens of a chunk's texts: keys of words, of word pairs and of triples; ``opens`` marks first tokens."""

    def __init__(self, table: pa.Table) -> None:
        data, offsets = c.utf8(table.column("text"))
        data = c.LOWER[data]
        start, end, first = c.words(data, offsets)
        docs = len(first) - 1
        self.sizes = np.diff(first) + 1
        self.first = first[:-1] + np.arange(docs)
        words = np.full(len(start) + docs, END)
        words[np.arange(len(start)) + np.repeat(np.arange(docs), np.diff(first))] = c.word_hashes(data, start, end)
        before = np.concatenate([[BEGIN], words[:-1]]).astype(np.uint64)[: len(words)]
        self.opens = np.zeros(len(words), bool)
        self.opens[self.first] = True
        before[self.opens] = BEGIN
        # the last bit tells words from pairs
        self.words, self.pairs = c.mix(words + c.ODD) | np.uint64(1), c.mix(before * np.uint64(c.BASE) + words) & ~np.uint64(1)
        self.triples = c.mix(np.concatenate([[BEGIN], self.pairs[:-1]]).astype(np.uint64)[: len(words)] * np.uint64(c.BASE) + words)
        self.keys = c.sorted_set(np.concatenate([self.words, self.pairs]))
        self.trains = np.repeat(~table.column("held_out").to_numpy(), self.sizes)

    def counts(self, keys: np.ndarray, *tokens: np.ndarray) -> np.ndarray:
        """Training tokens of each of ``keys``; each of ``tokens`` has the keys of all tokens, or of those that count."""
        out = np.zeros(len(keys), np.uint32)
        for x in tokens:
            own, n = np.unique(x, return_counts=True)
            out[np.searchsorted(keys, own)] += n.astype(np.uint32)
        return out

    def seen(self, total: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: how often training has the word, the pair, the word before it, and the two words before it
        (0 for a text's first word, where they tell no more than its begin does)."""
        w, pair = (c.looked_up(self.keys, total, x).astype(np.int64) for x in (self.words, self.pairs))
        h, g = (np.concatenate([[0], x[:-1]])[: len(x)] for x in (w, pair))
        h[self.opens], g[self.opens] = texts, 0
        return w, pair, h, g


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the whole part of its frequency's logarithm to base 2."""
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0).clip(0, BUCKETS - 1)


def level(p: np.ndarray) -> np.ndarray:
    """0 for p = 0, else the number of a step of the logarithm."""
    return np.where(p > 0, LEVELS - 1 + np.rint(np.log2(np.maximum(p, 1e-18)) * STEPS), 0).clip(0, LEVELS - 1).astype(np.int64)


VALUE = np.append(0.0, 2.0 ** ((np.arange(1, LEVELS) - LEVELS + 1) / STEPS))


def cell(of: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by bucket and by the levels of two estimates: cells, and how many tokens each has."""
    cells, n = np.unique((of * LEVELS + level(one)) * LEVELS + level(two), return_counts=True)
    return cells.astype(np.int64), n.astype(np.int64)


def maximised(p: np.ndarray, b: np.ndarray, n: np.ndarray, out: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM: the weights of the estimates ``p`` (cells x estimates) in each bucket, from the first guess ``out``."""
    for _ in range(rounds):
        share = out[b] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        total = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(p.shape[1])], axis=1)
        some = total.sum(axis=1) > 0
        out[some] = total[some] / total[some].sum(axis=1, keepdims=True)
        # an unseen word must keep a probability in every bucket
        out[:, 0] = np.maximum(out[:, 0], 1e-6)
        out /= out.sum(axis=1, keepdims=True)
    return out


def weights(cells: np.ndarray, n: np.ndarray, vocabulary: int) -> np.ndarray:
    """EM over the table of held-out counts: a row (uniform, word, pair) for each bucket."""
    p = np.stack([np.full(len(cells), 1 / (vocabulary + 1)), VALUE[cells // LEVELS % LEVELS], VALUE[cells % LEVELS]], axis=1)
    out = np.tile([0.1, 0.9, 0.0], (BUCKETS, 1))
    out[1:] = [0.1, 0.5, 0.4]
    out = maximised(p, cells // LEVELS**2, n, out)
    out[0] = [*(out[0][:2] / out[0][:2].sum()), 0]
    return out


def weights_of_triples(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same for a lower-order estimate and that of the triple: a row (lower order, triple) for each bucket."""
    p = np.stack([VALUE[cells // LEVELS % LEVELS], VALUE[cells % LEVELS]], axis=1)
    return maximised(p, cells // LEVELS**2, n, np.tile([0.6, 0.4], (BUCKETS, 1)))


def two_words(mixed: np.ndarray, w: np.ndarray, pair: np.ndarray, h: np.ndarray, train: int, vocabulary: int) -> np.ndarray:
    """p2 from counts."""
    part = mixed[bucket(h)]
    return part[:, 0] / (vocabulary + 1) + part[:, 1] * w / max(train, 1) + part[:, 2] * pair / np.maximum(h, 1)


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Words are lower-cased in A-Z; each text ends with a token of its own. Rows whose crc32(doc_id)
    mod ``modulus`` is not ``remainder`` are learned from, all of them; null ids are too. A null text counts
    as empty: one token, its end. Repeated rows count as often as they occur. Where nothing is held
    in training, the base is over no counts and every word has the same probability. An empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out("doc_id", modulus, remainder).alias("held_out"))
    size = c.text_bytes(rows)
    n, buckets = c.parts(rows, size, CHUNK_BYTES), c.parts(rows, size, CHUNK_BYTES, each=1)
    chunks = c.in_chunks(rows, n, "held_out")

    def ask(table):
        t = Tokens(table)
        return t.keys, [t.counts(t.keys, t.words[t.trains], t.pairs[t.trains])]

    def summed(keys, counts):
        same, which = np.unique(keys, return_inverse=True)
        return same, np.bincount(which, counts, len(same)).astype(np.uint64), which

    def answer(columns, _):
        same, total, which = summed(*columns)
        of_words = total[(same & np.uint64(1)).astype(bool)]
        return total[which], [int(of_words.sum()), int((of_words > 0).sum())]

    pairs = c.stored(c.asked(chunks, ask, ["<u4"], answer, buckets), codec="zstd")
    train, vocabulary = (x or 0 for x in pairs.agg(F.sum(F.col("notes")[0]), F.sum(F.col("notes")[1])).first())
    texts = rows.filter(~F.col("held_out")).count()
    pairs = pairs.drop("notes")
    c.release(spark)

    def ask_triples(table, reply):
        """The triples whose context counts, and the held-out counts of the lower orders."""
        t = Tokens(table)
        w, pair, h, g = t.seen(c.answers(reply, np.uint64), texts)
        keys = c.sorted_set(t.triples[g >= 1])
        w, pair, h = (x[t.trains] for x in (w, pair, h))
        return keys, [t.counts(keys, t.triples[(g >= 1) & t.trains])], cell(bucket(h - 1), (w - 1) / max(train - 1, 1), (pair - 1) / np.maximum(h - 1, 1))

    def answer_triples(columns, _):
        _, total, which = summed(*columns)
        return total[which], []

    # at most BUCKETS * LEVELS**2 cells whatever the data; a few thousand in practice
    told = c.stored(c.asked(chunks, ask_triples, ["<u4"], answer_triples, buckets, pairs), codec="zstd")
    table = c.tallies(told).toPandas()
    mixed = weights(table["cell"].to_numpy(np.int64), table["n"].to_numpy(np.float64), vocabulary)
    about = pairs.withColumn("order", F.lit(2)).unionByName(told.filter("chunk >= 0").drop("notes").withColumn("order", F.lit(3)))
    both = chunks.groupBy("chunk").cogroup(about.groupBy("chunk"))
    c.release(spark)

    def all_seen(table, reply):
        t, order = Tokens(table), reply.column("order").to_numpy()
        w, pair, h, g = t.seen(c.answers(reply.filter(pa.array(order == 2)), np.uint64), texts)
        deep = np.flatnonzero(g >= 1)
        keys = c.sorted_set(t.triples[deep])
        triple = c.looked_up(keys, c.answers(reply.filter(pa.array(order == 3)), np.uint64), t.triples[deep]).astype(np.int64)
        return t, w, pair, h, g[deep], deep, triple

    def held_out_counts(table, reply):
        t, w, pair, h, g, deep, triple = all_seen(table, reply)
        own = t.trains[deep]
        deep, g, triple = deep[own], g[own], triple[own]
        lower = two_words(mixed, w[deep] - 1, pair[deep] - 1, h[deep] - 1, train - 1, vocabulary)
        cells, count = cell(bucket(g - 1), lower, (triple - 1) / np.maximum(g - 1, 1))
        return pa.table({"cell": cells, "n": count})

    table = both.applyInArrow(held_out_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    deeper = weights_of_triples(table["cell"].to_numpy(np.int64), table["n"].to_numpy(np.float64))
    c.release(spark)

    def finish(table, reply):
        t, w, pair, h, g, deep, triple = all_seen(table, reply)
        p = two_words(mixed, w, pair, h, train, vocabulary)
        part = deeper[bucket(g)]
        p[deep] = part[:, 0] * p[deep] + part[:, 1] * triple / np.maximum(g, 1)
        sums = lambda x: np.add.reduceat(x, t.first) if len(t.first) else np.zeros(0)
        out = {"doc_id": table.column("doc_id").cast(pa.int64()), "held_out": table.column("held_out"), "n_tokens": t.sizes, "n_known": sums((w > 0).astype(np.int64)), "train_tokens": np.full(table.num_rows, train)}
        return pa.table(out | {"base_score": sums(np.log10((w + 1) / (train + vocabulary + 1))), "score": sums(np.log10(p))})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.applyInArrow(finish, schema)
