"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

``build_index`` stores a posting (document, position) for every token of the documents that is a term of the
benchmark at hand; another benchmark needs an index of its own terms. Every phrase (a window of an item)
takes the postings of its rarest term, moved back by the term's offset, and keeps those that its next
rarest term confirms. Each of the begins that are left looks for all further terms of its phrase at
their places: where none is missing the phrase stands word for word (exact). ``proximity_matches`` reports the two
rarest terms with the gap between them instead.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm import common as c

#: After lower-casing A-Z: words are digits, a-z and all characters beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark terms or phrases up to which they are broadcast (some tens of MB); beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def tokens(text: str | Column) -> Column:
    """Words of a text; none for a null or empty one."""
    lowered = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAP), "")


def small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table of short rows if their number allows; beyond, the join shuffles, and Spark splits
    the tasks of frequent keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def phrases(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """All windows of ``width`` consecutive words of the items (an item of fewer, but not none, is one): pid, n, p (the
    words), each once; and pid, item of every named item that has it. Both are stored."""
    words = items.select("item_id", tokens("text").alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    cut = words.select("item_id", "w", F.explode(starts).alias("s")).select(F.col("item_id").cast("string").alias("item"), F.slice("w", F.col("s"), width).alias("p"))
    cut = c.stored(cut.select(F.xxhash64("p").alias("pid"), "item", "p").distinct())
    return c.stored(cut.groupBy("p").agg(F.first("pid").alias("pid")).select("pid", F.size("p").alias("n"), "p")), cut.filter("item is not null").select("pid", "item")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos and tid: a posting for every token of ``docs`` among ``terms`` (term, tid), stored."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(tokens("text")).alias("pos", "term"))
    return c.stored(words.join(small(terms), "term").select("doc_id", "text_hash", "pos", "tid"))


class Search:
    """The index of ``docs`` for the phrases of ``items``, and each phrase's terms from the rarest on."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int) -> None:
        self.phrases, self.holders = phrases(items, width)
        places = self.phrases.select("pid", "n", F.posexplode("p").alias("offset", "term"))
        terms = c.stored(places.select("term").distinct().withColumn("tid", F.xxhash64("term")))
        self.index = build_index(docs, terms)
        frequency = c.stored(self.index.groupBy("tid").agg(F.count("*").alias("cf")))
        ranked = places.withColumn("tid", F.xxhash64("term")).join(small(frequency), "tid").groupBy("pid", "n").agg(F.array_sort(F.collect_set(F.struct("cf", "offset", "tid"))).alias("terms"))
        # a phrase with a word that no document has occurs nowhere
        self.ranked = c.stored(ranked.filter(F.size("terms") == F.col("n")).select("pid", "n", "terms"))

    def begins(self, rank: int) -> DataFrame:
        """Where each phrase would begin by its ``rank``-th rarest term (the last, if it has fewer)."""
        term = F.col("terms")[F.least(F.lit(rank), F.size("terms") - 1)]
        wanted = self.ranked.select("pid", "n", term["tid"].alias("tid"), term["offset"].alias("offset"))
        near = small(wanted)
        return self.index.join(near, "tid").select("doc_id", "text_hash", "pid", "n", (F.col("pos") - F.col("offset")).alias("start"))

    def candidates(self) -> DataFrame:
        """doc_id, text_hash, pid, n and start where the two rarest terms agree on a begin, each once, stored."""
        first, second = self.begins(0).filter("start >= 0"), self.begins(1).filter("start >= 0")
        b = second.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("pid").alias("p"), F.col("start").alias("s"))
        same = first.doc_id.eqNullSafe(b.d) & (first.text_hash == b.h) & (first.pid == b.p) & (first.start == b.s)
        return c.stored(first.join(b, same, "left_semi").distinct())

    def exact(self) -> DataFrame:
        """doc_id, text_hash, pid, n and start of every phrase that stands word for word in a document."""
        begun = self.candidates()
        short, long = begun.filter("n <= 2"), begun.filter("n > 2")
        rest = small(self.ranked.select("pid", F.expr("slice(terms, 3, size(terms))").alias("rest")))
        wanted = long.join(rest, "pid").select("doc_id", "text_hash", "pid", "n", "start", F.explode("rest").alias("x"))
        wanted = wanted.select("doc_id", "text_hash", "pid", "n", "start", F.col("x.tid").alias("tid"), (F.col("start") + F.col("x.offset")).alias("pos"))
        held = c.stored(long.select("doc_id", "text_hash").distinct())
        held = small(held).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
        there = self.index.join(held, self.index.doc_id.eqNullSafe(held.d) & (self.index.text_hash == held.h), "left_semi")
        there = there.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("pos").alias("q"), F.col("tid").alias("t"))
        same = wanted.doc_id.eqNullSafe(there.d) & (wanted.text_hash == there.h) & (wanted.pos == there.q) & (wanted.tid == there.t)
        met = wanted.join(there, same, "left_semi").groupBy("doc_id", "text_hash", "pid", "n", "start").agg(F.count("*").alias("k"))
        return short.unionByName(met.filter(F.col("k") == F.col("n") - 2).drop("k"))


def matches(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items (item_ids as sorted strings) and spans (start, size of each
    phrase found) of every row of ``docs`` (doc_id, text), for exact phrases of ``items`` (item_id, text).

    Nulls and edges: a null or empty text has no words; an item without words has no phrase; a null
    doc_id is a document like others, a null item_id counts as an item without a name, so it makes hits
    but is not listed; rows that repeat a doc_id or an item_id are compared each on their own, equal
    rows once; without items nothing is hit; an empty table gives no rows. Other columns are not read.
    """
    search = Search(docs, items, width)
    found = c.stored(search.exact())
    spans = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", F.col("n").alias("size")))).alias("spans"))
    holders = found.select("doc_id", "text_hash", "pid").distinct().join(search.holders, "pid")
    names = holders.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans, names = spans.toDF("d", "h", "spans"), names.toDF("d2", "h2", "items")
    hits = c.stored(spans.join(names, F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left").select("d", "h", "spans", "items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(tokens("text")).cast("long").alias("n_words"))
    rows = rows.join(hits, rows.doc_id.eqNullSafe(hits.d) & (rows.text_hash == hits.h), "left")
    some = lambda name: F.coalesce(name, F.array().cast(hits.schema[name].dataType)).alias(name)
    rows = rows.select("doc_id", "text_hash", "n_words", some("items"), some("spans"))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))
    return rows.select("doc_id", "text_hash", "n_words", F.size(hit).cast("long").alias("n_hit"), "items", "spans")


def proximity_matches(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 5) -> DataFrame:
    """doc_id, items, start and gap: where a phrase's two rarest terms stand in the phrase's order, moved
    apart or together by up to ``slop`` words (gap 0: as in the phrase). Nulls as in ``matches``."""
    found = Search(docs, items, width)
    a, b = found.begins(0).alias("a"), found.begins(1).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.pid") == F.col("b.pid"))
    gap = F.col("b.start") - F.col("a.start")
    near = a.join(b, same & (F.abs(gap) <= slop)).select(F.col("a.doc_id").alias("doc_id"), F.col("a.pid").alias("pid"), F.col("a.start").alias("start"), gap.alias("gap"))
    items = found.holders.groupBy("pid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return near.join(items, "pid").select("doc_id", "items", "start", "gap").distinct()


def clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no phrase of ``items``, all columns as they were."""
    found = c.stored(Search(docs, items, width).exact().select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct())
    (own,) = c.unused(docs, "text_hash")
    rows = docs.withColumn(own, F.xxhash64("text"))
    return rows.join(small(found), rows["doc_id"].eqNullSafe(found.d) & (rows[own] == found.h), "left_anti").drop(own)
