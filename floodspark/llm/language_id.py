"""Language identification with language-bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: a slot holds a bit for every language, so that the AND of an
n-gram's slots is the set of all languages whose filter has it. A text's bits are counted by language,
corrected for the false positives that the filter's fill predicts; the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm import common as c
from floodspark.llm.lm_score import held_out

SIZES = (3, 4)
#: Slots of a filter and probes for each n-gram; the filter (2 MB up to 16 languages, else 8 MB for every 63) is broadcast.
SLOTS, PROBES = 1 << 20, 2
#: Bytes of text that are handled at once.
SLICE_BYTES = 1 << 18
#: Languages in one word of a slot, which Spark holds as a signed long.
WORD = 63
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def n_grams(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bytes of every n-gram that has a letter, lower-cased, other ASCII as blanks; and each text's first."""
    docs = len(offsets) - 1
    buffer = np.full(len(data) + 2 * docs, 32, np.uint8)  # a blank before and after each text
    at = np.arange(len(data)) + np.repeat(2 * np.arange(docs) + 1, np.diff(offsets))
    buffer[at] = np.where(LETTER[data], c.LOWER[data], 32)
    starts = offsets + 2 * np.arange(docs + 1)
    n = max(len(buffer) - size + 1, 0)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams |= buffer[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    solid = buffer != 32
    # two blanks at either end: the n-gram says no more than a shorter one
    useful = (solid[:n] | solid[1 : n + 1]) & (solid[size - 2 : size - 2 + n] | solid[size - 1 : size - 1 + n])
    keep = np.flatnonzero(useful & c.whole(starts, size, n))
    return grams[keep] | np.uint64(size << 56), np.searchsorted(keep, starts)


def slots(grams: np.ndarray) -> list[np.ndarray]:
    mixed = c.mix(grams)
    return [((mixed >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(PROBES)]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letters = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
    out = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for row in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[row] = any(x.isalpha() for x in data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Model:
    """languages, their prior order, the filter (words x slots) and its false-positive rates."""

    def __init__(self, languages: list[str], filled: np.ndarray) -> None:
        self.languages, self.filled, self.kind = languages, filled, filled.dtype.type
        self.false = np.array([((filled[k // WORD] >> self.kind(k % WORD)) & self.kind(1)).mean() ** PROBES for k in range(len(languages))])

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """n-grams of each text in each language's filter (texts x languages), less the expected false ones."""
        out = np.zeros((len(offsets) - 1, max(1, len(self.languages))))
        for size in SIZES:
            grams, first = n_grams(data, offsets, size)
            probes, n = slots(grams), np.diff(first)
            for k, rate in enumerate(self.false):
                if k % WORD == 0:
                    masks = np.full(len(grams), np.iinfo(self.kind).max, self.kind)
                    for at in probes:
                        masks &= self.filled[k // WORD][at]
                hits = np.concatenate([[0], np.cumsum((masks >> self.kind(k % WORD)) & self.kind(1), dtype=np.int64)])
                out[:, k] += np.maximum(hits[first[1:]] - hits[first[:-1]] - n * rate, 0) / (1 - rate + 1e-12)
        return out


def portions(counts: dict[str, int], rows: int, least: int = 20) -> dict[str, float]:
    """The part of each language's documents to take: all of a rare language, equally many of the others, ``rows``
    together; but of each at least ``least``, or all."""
    left, cap = rows, 0
    for k, n in enumerate(sorted(counts.values())):
        cap = left / (len(counts) - k)
        if n > cap:
            break
        left, cap = left - n, n
    return {lang: min(1.0, max(cap, least) / n) for lang, n in counts.items()}


def fit(docs: DataFrame, text_rows: int = 12_000, modulus: int = 3, remainder: int = 1, least: float = 0.002, share: float = 0.4) -> Model:
    """Learn from documents with a language whose crc32(doc_id) mod ``modulus`` is not ``remainder``.

    The fit is bounded: it takes the documents with the smallest hashes of their ids in each language, about
    ``text_rows`` in all and 20 or more of each (``portions``). Any number of languages with two or more
    documents is learned (an n-gram needs two). An
    n-gram enters a language's filter if at least ``least`` of its documents hold it, and at
    least ``share`` of the part that holds it in the language where it is most frequent.
    """
    spark = docs.sparkSession
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out("doc_id", modulus, remainder))
    seen = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().filter("count >= 2").orderBy(F.desc("count"), "lang").collect()}
    languages = list(seen)
    if not languages:
        return Model([], np.zeros((1, SLOTS), np.uint16))
    bound = spark.createDataFrame([(k, int(rate * (1 << 30))) for k, rate in portions(seen, text_rows).items()], "lang string, bound long")
    some = labelled.join(F.broadcast(bound), "lang").filter(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) < F.col("bound")).select("text", "lang")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of a slice, by language, hold each n-gram."""
        for batch in batches:
            for part in c.slices(batch, SLICE_BYTES):
                lang = part.column("lang").dictionary_encode()
                names = lang.dictionary.to_pylist()
                code = lang.indices.to_numpy()
                data, offsets = c.utf8(part.column("text"))
                for size in SIZES:
                    g, first = n_grams(data, offsets, size)
                    doc = np.repeat(np.arange(len(code)), np.diff(first))
                    order = np.lexsort((doc, g))
                    g, doc = g[order], doc[order]
                    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]) if len(g) else np.zeros(0, bool)
                    pairs, n = np.unique(np.stack([g[fresh], code[doc[fresh]].astype(np.uint64)]), axis=1, return_counts=True) if len(g) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array([names[k] for k in pairs[1]], pa.string()), pa.array(n, pa.int64())], ["gram", "lang", "n"])

    sizes = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    codes = spark.createDataFrame([(lang, k, sizes[lang]) for k, lang in enumerate(languages) if lang in sizes], "lang string, code int, size long")
    counts = some.mapInArrow(grams, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).join(F.broadcast(codes), "lang")
    p = F.col("n") / F.col("size")
    held = counts.groupBy("gram").agg(F.max(p).alias("top"), F.collect_list(F.struct("code", "n", p.alias("p"))).alias("of")).select("gram", "top", F.explode("of").alias("x"))
    held = held.filter((F.col("x.p") >= least) & (F.col("x.n") >= 2) & (F.col("x.p") >= share * F.col("top")))
    held = held.groupBy("gram", F.floor(F.col("x.code") / WORD).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, x.code % {WORD}))").alias("mask"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, mask = batch.column("word"), batch.column("mask")
            for at in slots(batch.column("gram").to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([word, pa.array(at), mask], ["word", "slot", "mask"])

    found = held.mapInArrow(fill, "word int, slot long, mask long").groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    # no more than SLOTS rows of each word reach the driver
    filled = np.zeros((-(-len(languages) // WORD), SLOTS), np.uint16 if len(languages) <= 16 else np.uint64)
    filled[found["word"].to_numpy(), found["slot"].to_numpy()] = found["mask"].to_numpy().astype(filled.dtype)
    return Model(languages, filled)


def identify(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with ``pred`` (a learned language; ``und`` if text is null or has no letter, or nothing was
    learned) and ``score`` (0 to 1, the decided language's share of all counts; 0 without any).

    Ties go to the language with more training documents. Whole texts count; rows are independent;
    an empty table gives no rows. Columns that have the two names already are replaced.
    """
    c.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(pred, score)
    others = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for part in c.slices(batch, SLICE_BYTES):
                data, offsets = c.utf8(part.column("text"))
                counts = m.counts(data, offsets)
                best = counts.argmax(axis=1)
                total = counts.sum(axis=1)
                share = np.where(total > 0, counts.max(axis=1) / np.maximum(total, 1e-9), 0.0)
                known = has_letter(data, offsets) & (len(m.languages) > 0)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in others), pa.array(names[np.where(known, best, len(m.languages))], pa.string()), pa.array(np.where(known, share, 0.0))], [*others, pred, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{pred}` string, `{score}` double")
