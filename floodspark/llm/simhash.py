"""SimHash near-dedup with covering locality-sensitive hashing.

Masks: bit i of a fingerprint is given the non-zero vector m(i) of r + 1 bits; for every non-zero v of
r + 1 bits one table keeps the bits i with an odd inner product of m(i) and v. The m(i) of r or fewer
differing bits cannot span r + 1 dimensions, so some v is orthogonal to all of them, and in that table
the two fingerprints agree: every pair within the radius collides in at least one of 2**(r+1) - 1 tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm import common as c
from floodspark.llm import graph

BITS = 64
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2**(radius+1) - 1 masks of ``bits`` bits; each keeps about half of them."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def fingerprint(text: bytes, k: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of every ``k``-word shingle of one lower-cased text."""
    words = text.lower().split()  # bytes.lower changes A-Z only, bytes.split splits at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = hashes[at : at + AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a long) of every row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", k) for x in batch.column("raw")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    c.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges a, b that connect all fingerprints ``fp`` within ``radius`` bits of each other: of each
    block's links only a spanning forest, so a large group gives no more edges than it has members."""
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks))))
    rows = distinct.select("fp", tables.alias("x")).select("fp", "x.t", "x.key")
    met = graph.blocks(rows, ["t", "key"], "fp")

    def compare(table: pa.Table) -> pa.Table:
        fp, t, key, own, i, j = (table.column(x).to_numpy() for x in ("fp", "t", "key", "own", "i", "j"))
        bits = fp.view(np.uint64)
        group = np.unique(np.stack([t.astype(np.int64), key, i.astype(np.int64), j.astype(np.int64)]), axis=1, return_inverse=True)[1].reshape(-1)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x, y in graph.pairs(group, own, i != j):
            near = np.bitwise_count(bits[x] ^ bits[y]) <= radius
            a, b = np.concatenate([a, fp[x[near]]]), np.concatenate([b, fp[y[near]]])
            if len(a) > 1 << 20:
                a, b = graph.stars(a, b)
        a, b = graph.stars(a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("part").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, fingerprint (16 hex digits), component_id and kept of every row of ``docs``.

    component_id is the smallest doc_id that links of ``radius`` or fewer differing bits reach; of a
    component, kept is true for the row with the smallest (doc_id, text_hash). Nulls and edges: a null,
    empty or white-space text has fingerprint 0, which links like any other; null doc_ids come after all
    others and make a component_id null only where a component has no other; repeated rows share all
    values; an empty table gives no rows. Other columns are not read.
    """
    prints = c.stored(fingerprints(docs, k))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("lead")
    distinct = c.stored(prints.groupBy("fp").agg(first))
    found = graph.components(links(distinct.select("fp"), radius))
    labelled = distinct.join(found, distinct.fp == found.id, "left").select("fp", "lead", F.coalesce("component", "fp").alias("component"))
    leads = labelled.groupBy("component").agg(F.min("lead").alias("lead"))
    by_fp = labelled.select("fp", "component").join(leads, "component").select("fp", "lead")
    kept = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))
    return prints.join(by_fp, "fp").select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("lead.doc_id").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each component, and all columns as they were."""
    own, no, at = c.unused(docs, "text_hash", "kept_id", "kept_hash")
    kept = near_duplicates(docs, k, radius).filter("kept").select(F.col("doc_id").alias(no), F.col("text_hash").alias(at)).distinct()
    rows = docs.withColumn(own, F.xxhash64("text"))
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept[no]) & (rows[own] == kept[at]), "left_semi").dropDuplicates(["doc_id", own]).drop(own)
