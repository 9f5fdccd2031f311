"""Suffix-array dedup by a distributed difference-cover algorithm.

Which bytes lie in a ``width``-byte string that starts at two places or more?

1. Letters. Of the hashes of all ``core``-byte strings the smallest in every run of width + 1 - core is an
   anchor, so any two equal ``width``-byte strings hold the same anchors at the same places. Texts
   become strings of letters: letter g is the text from anchor g to the end of the next anchor's core.
   Letters whose cores occur once cannot be in a repeat and drop out before anything is sorted.
2. Sample. Letters at places 1 and 2 modulo 3 are the difference-cover sample: their triples are sorted
   over the cluster and named by rank; names of triples of names triple the reach, until every name reaches
   as far as a repeat needs, which bounds the rounds by log3(width).
3. Merge. Any two places of different classes have a common shift into the sample: classes 0 and 1 are
   sorted by (letter, name of the next place), classes 0 and 2 by (letter, letter, name of the place after).
   In each order neighbours are compared: equal keys have a common prefix of the length asked for.
4. Ends. What neighbours have in common ends between anchors: only the strings that start there and are not
   yet decided, few for each end of a repeat, are compared by their own fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm import common as c

CHUNK_BYTES = 2 << 20
#: Places whose anchors are looked for at once, and rows of one range partition when letters are named.
SPAN_BITS, SORT_ROWS = 15, 1_000_000
SPAN = 1 << SPAN_BITS
#: Powers of the base and of its inverse within a span and the strings that begin in it.
UP, BACK = c.powers(c.BASE, SPAN), c.powers(c.INVERSE, 2 * SPAN)
BYTE = c.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * c.ODD)


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        a = op(a[:-reach], a[reach:])
        reach *= 2
    return op(a[: len(a) - (width - reach)], a[width - reach :]) if width > reach else a


class Letters:
    """Anchors and hashes of the texts of a chunk, in the order of doc_id and text hash.

    ``at``: the anchors; ``since``: the first ``width``-byte string that has each one as its own.
    """

    def __init__(self, table: pa.Table, width: int, core: int, anchors: bytes | None = None) -> None:
        self.width, self.core = width, core
        self.table = table.sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
        self.data, self.offsets = c.utf8(self.table.column("text"))
        n = len(self.data)
        self.total = np.zeros(n + 1, np.uint64)
        self.far = c.powers(pow(c.INVERSE, SPAN, 1 << 64), n // SPAN + 1)
        for lo, factor in zip(range(0, n, SPAN), c.powers(pow(c.BASE, SPAN, 1 << 64), n // SPAN + 1)):
            part = self.total[lo + 1 : lo + 1 + SPAN]
            np.multiply(BYTE[self.data[lo : lo + SPAN]], UP[: len(part)], out=part)
            part *= factor
            np.cumsum(part, out=part)
            part += self.total[lo]
        if anchors is None:
            self.at, self.since = self._anchors()
        else:
            steps = c.unplanes(pa.py_buffer(anchors), 0, len(anchors) // 4, np.dtype("<u4"))
            self.at, self.since = np.cumsum(steps.reshape(2, -1), axis=1, dtype=np.int64)

    def packed(self) -> bytes:
        """The anchors, for another ``Letters`` of the same chunk."""
        return c.planes(np.concatenate([np.diff(x, prepend=0) for x in (self.at, self.since)]).astype("<u4"))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``start`` to ``end``."""
        back = self.far[start >> SPAN_BITS] * BACK[start & (SPAN - 1)]
        return c.mix((self.total[end] - self.total[start]) * back + (end - start).astype(np.uint64) * c.ODD)

    @property
    def cores(self) -> np.ndarray:
        return self.hashes(self.at, self.at + self.core)

    @property
    def usable(self) -> np.ndarray:
        """Whether a ``width``-byte string starts at each byte."""
        size = np.diff(self.offsets)
        start = np.maximum(size - self.width + 1, 0)
        return np.repeat(np.tile([True, False], len(size)), np.stack([start, size - start], axis=1).reshape(-1))

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every ``width``-byte string the core with the least hash (the first of equals), block by block."""
        n, run, usable = len(self.data), self.width + 1 - self.core, self.usable
        at, since, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], -1
        for lo in range(0, n - self.width + 1, SPAN):
            hi = min(lo + SPAN, n - self.width + 1)
            some = np.flatnonzero(usable[lo:hi])
            if not len(some):
                continue
            m = hi + run - 1  # cores that begin before m
            order = (self.total[lo + self.core : m + self.core] - self.total[lo:m]) * BACK[: m - lo]
            order *= self.far[lo >> SPAN_BITS]
            order ^= order >> np.uint64(29)
            order *= c.ODD
            order &= np.uint64(0xFFFFFFFF00000000)  # by hash, then by place
            order |= np.arange(m - lo, dtype=np.uint64)
            place = (slide(order, run, np.minimum)[some] & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo
            new = np.append(place[0] != last, place[1:] != place[:-1])
            at.append(place[new])
            since.append(some[new] + lo)
            last = place[-1]
        return np.concatenate(at), np.concatenate(since)

    def letters(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor but the last: its letter, the next anchor's place, and whether both cores repeat in one text."""
        here, there = self.at[:-1], self.at[1:]
        text = np.searchsorted(self.offsets, self.at, "right")
        valid = repeated[:-1] & repeated[1:] & (text[:-1] == text[1:])
        return self.hashes(here, np.where(valid, there + self.core, here)), there, valid

    def inside(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bytes in any of the stretches from ``start`` to ``end``."""
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
        return np.cumsum(change, out=change)[:-1] > 0


def repeats(keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    same, which = np.unique(keys, return_inverse=True)
    return np.bincount(which, count, len(same))[which] > 1


def asked_twice(columns: list[np.ndarray], _: np.ndarray) -> tuple[np.ndarray, list[int]]:
    return repeats(*columns).astype(np.uint8), []


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, for each 1 or (if it is there more than once) 2, and which each is."""
    keys, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
    return keys, np.minimum(n, 2).astype(np.uint8), which


def named(rows: DataFrame, keys: list[str], most: int = 0) -> tuple[DataFrame, DataFrame]:
    """``rows`` (chunk, g, ...) with name, a rank of their ``keys`` in the order of the whole table,
    repeated, whether a neighbour in that order has the same keys, and lead, true for at least the first
    row of each key. Rows of one key may fill many partitions; only each partition's first and last key
    reach the driver. ``most``: about how many rows there are. Also gives the stored table that it reads, to be forgotten."""
    spark = rows.sparkSession
    others = [x for x in rows.columns if x not in keys]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // SORT_ROWS))
    order = [*keys, "chunk", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One batch behind, as the last row of a batch is judged by the first of the next."""
        part = TaskContext.get().partitionId()
        held, last, local = None, None, -1

        def told(follows: bool, ends: bool) -> pa.RecordBatch:
            batch, k, same, names, begins = held
            edge = np.zeros(len(names), bool)
            edge[0], edge[-1] = begins, edge[-1] or ends or begins and len(names) == 1
            out = {x: batch.column(x) for x in others} | {"part": np.full(len(names), part, np.int32), "local": names, "twin": same | np.append(same[1:], follows), "lead": ~same}
            return pa.RecordBatch.from_pydict(out | {f"edge_{x}": pa.array(np.where(edge, v, 0), mask=~edge) for x, v in zip(keys, k)})

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(x).to_numpy() for x in keys])
            joined = last is not None and bool((k[:, 0] == last).all())
            if held is not None:
                yield told(joined, False)
            same = np.append(joined, (k[:, 1:] == k[:, :-1]).all(axis=0))
            names = local + np.cumsum(~same)
            held, last, local = (batch, k, same, names, last is None), k[:, -1], int(names[-1])
        if held is not None:
            yield told(False, True)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{x} {types[x]}" for x in others), "part int, local long, twin boolean, lead boolean", *(f"edge_{x} long" for x in keys)])
    ranked = c.stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    edges = ranked.filter(f"edge_{keys[0]} is not null").select("part", "local", *(f"edge_{x}" for x in keys)).distinct().orderBy("part", "local").collect()
    base, shared, names, last = 0, set(), {}, None
    for e in edges:  # two rows, or one, for each partition
        key = tuple(e[2:])
        if e.part not in names:
            joined = key == last
            names[e.part] = base - joined
            if joined:
                shared.add(base - 1)  # a key may fill many partitions: its name once
        base, last = names[e.part] + e.local + 1, key
    bases = spark.createDataFrame([(int(p), int(b)) for p, b in names.items()], "part int, base long")
    meet = spark.createDataFrame([(int(x),) for x in sorted(shared)], "name long").withColumn("met", F.lit(True))
    whole = ranked.join(F.broadcast(bases), "part").withColumn("name", F.col("local") + F.col("base"))  # a row for each partition
    return whole.join(F.broadcast(meet), "name", "left").select(*others, "name", (F.col("twin") | F.coalesce("met", F.lit(False))).alias("repeated"), "lead"), ranked


def long_repeats(letters: DataFrame, most: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """chunk, g and lead of the letters from which equal text reaches the goal elsewhere too, perhaps more than
    once; of those with equal text at least one has lead. Also the stored tables that these come from.

    letters: chunk, g, cls (g modulo 3), t0, t1, t2 (letters from g on; 0 where the letters before reach far
    enough), goal and upto (the place to reach, and where the letters given end).
    """
    scale = 1
    sample, ranked = named(letters.filter("cls <> 0").select("chunk", "g", "goal", "upto", "t0", "t1", "t2"), ["t0", "t1", "t2"], most)
    sample = c.stored(sample.select("chunk", "g", "goal", "upto", "name", "repeated", "lead"))
    c.forget(ranked)
    offset = 0
    while True:
        scale *= 3
        if not sample.filter("repeated and upto < goal").limit(1).count():
            break

        def longer(table):
            """Names of the places ``scale`` and two times ``scale`` on, where a name does not reach far enough."""
            t = table.sort_by("g")
            g, goal, upto, name, repeated, lead = (t.column(x).to_numpy() for x in ("g", "goal", "upto", "name", "repeated", "lead"))
            open_ = repeated & (upto < goal)
            names, ends = [name], [upto]
            for k in (1, 2):
                at = np.searchsorted(g, g + k * scale).clip(0, len(g) - 1)
                there = (g[at] == g + k * scale) & (name[at] >= 0) & (ends[-1] < goal)
                names.append(np.where(there, name[at], -1))
                ends.append(np.where(there, upto[at], ends[-1]))
            # what cannot be followed any further stays undecided, and its ends are compared later
            stuck = open_ & ((names[1] < 0) | (ends[1] < goal) & (names[2] < 0))
            go = open_ & ~stuck
            kind = np.where(go, 1, 0)
            return pa.table({"chunk": t.column("chunk"), "g": g, "goal": goal, "upto": np.where(go, ends[2], upto), "n0": np.where(stuck, -1, name), "n1": names[1], "n2": names[2], "go": kind.astype(np.int32), "repeated": repeated & ~stuck, "lead": lead})

        step = c.stored(sample.groupBy("chunk").applyInArrow(c.tidied(longer), "chunk int, g long, goal long, upto long, n0 long, n1 long, n2 long, go int, repeated boolean, lead boolean"))
        again, ranked = named(step.filter("go = 1").select("chunk", "g", "goal", "upto", "n0", "n1", "n2"), ["n0", "n1", "n2"], most)
        offset += 1 << 40
        again = again.select("chunk", "g", "goal", "upto", (F.col("name") + offset).alias("name"), "repeated", "lead")
        old, sample = sample, c.stored(step.filter("go = 0").select("chunk", "g", "goal", "upto", F.col("n0").alias("name"), "repeated", "lead").unionByName(again))
        for table in (old, step, ranked):
            c.forget(table)

    def keys(table, names):
        """Sort keys of the merge; a place takes part where the name it needs reaches far enough."""
        t, s = table.sort_by("g"), names.sort_by("g")
        g, cls, t0, t1 = (t.column(x).to_numpy() for x in ("g", "cls", "t0", "t1"))
        at, name = s.column("g").to_numpy(), s.column("name").to_numpy()
        good = s.column("upto").to_numpy() >= s.column("goal").to_numpy()
        out = []
        for kind, shift, left in ((1, 1, 2), (2, 2, 1)):
            place = np.searchsorted(at, g + shift).clip(0, max(len(at) - 1, 0))
            some = np.flatnonzero((cls != left) & (at[place] == g + shift) & good[place]) if len(at) else np.zeros(0, np.int64)
            out.append((np.full(len(some), kind), g[some], t0[some], t1[some] if kind == 2 else np.zeros(len(some), np.int64), name[place[some]]))
        kind, g, a, b, r = (np.concatenate(x) for x in zip(*out))
        return pa.table({"chunk": pa.array(np.full(len(g), t.column("chunk")[0].as_py() if t.num_rows else 0), pa.int32()), "g": g, "kind": kind, "a": a, "b": b, "r": r})

    merged = letters.select("chunk", "g", "cls", "t0", "t1").groupBy("chunk").cogroup(sample.groupBy("chunk")).applyInArrow(c.tidied(keys), "chunk int, g long, kind long, a long, b long, r long")
    merged, ranked = named(merged, ["kind", "a", "b", "r"], 2 * most)
    found = sample.filter("repeated and upto >= goal").select("chunk", "g", "lead").unionByName(merged.filter("repeated").select("chunk", "g", "lead"))
    return found, [sample, ranked]


def repeated_bytes(docs: DataFrame, width: int = 200, core: int = 48) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (begin, end in bytes of each maximal removed run) and kept (the bytes
    left) of every row of ``docs`` (doc_id, text): a byte goes if a ``width``-byte string that covers
    it also starts anywhere else, in any row.

    Nulls and edges: a null text counts as empty; texts of fewer than ``width`` bytes keep all; null doc_ids
    are rows like others; equal rows repeat each other; an empty table gives no rows. Other columns are
    not read.
    """
    if width > SPAN:
        raise ValueError(f"width is at most {SPAN}")
    spark, core = docs.sparkSession, min(core, max(1, width // 2))
    size = c.text_bytes(docs)
    n, buckets = c.parts(docs, size, CHUNK_BYTES), c.parts(docs, size, 4 * CHUNK_BYTES, each=1)
    chunks = c.in_chunks(docs.withColumn("text_hash", F.xxhash64("text")), n, "text_hash")
    make = lambda table, anchors=None: Letters(table, width, core, anchors)

    def ask_cores(table):
        keys, count, _ = distinct(make(table).cores)
        return keys, [count]

    cores = c.stored(c.asked(chunks, ask_cores, ["u1"], asked_twice, buckets))

    def spell(table, replies):
        x = make(table)
        keys, _, which = distinct(x.cores)
        bits = c.answers(replies).astype(bool) if len(keys) else np.zeros(0, bool)
        repeated = bits[which]
        letter, there, valid = x.letters(repeated)
        g = np.flatnonzero(valid)
        m = len(letter)
        goal = there[g] + width - core
        t, upto, ok = [letter[g].view(np.int64)], there[g], np.ones(len(g), bool)
        for k in (1, 2):
            more = upto < goal
            at = (g + k).clip(0, max(m - 1, 0))
            ok &= ~more | ((g + k < m) & valid[at])
            t.append(np.where(more, letter[at].view(np.int64), 0))
            upto = np.where(more, there[at], upto)
        g, upto, goal, t = g[ok], upto[ok], goal[ok], [y[ok] for y in t]
        out = {"chunk": pa.array(np.full(len(g), table.column("chunk")[0].as_py() if table.num_rows else 0), pa.int32()), "g": g, "cls": pa.array(g % 3, pa.int32()), "goal": goal, "upto": upto}
        bitmap = np.packbits(repeated, bitorder="little").tobytes()
        rows = pa.table(out | {"t0": t[0], "t1": t[1], "t2": t[2], "kind": pa.array(np.zeros(len(g)), pa.int32()), "payload": pa.nulls(len(g), pa.binary())})
        about = {"chunk": table.column("chunk").slice(0, 1).take(pa.array([0, 0])), "kind": pa.array([1, 5], pa.int32()), "payload": pa.array([bitmap, x.packed()], pa.binary())} if table.num_rows else {}
        return pa.concat_tables([rows, pa.table([about[f.name] if f.name in about else pa.nulls(2, f.type) for f in rows.schema], rows.schema)]) if about else rows

    schema = "chunk int, g long, cls int, goal long, upto long, t0 long, t1 long, t2 long, kind int, payload binary"
    spelled = c.stored(chunks.groupBy("chunk").cogroup(cores.groupBy("chunk")).applyInArrow(c.tidied(spell), schema))
    c.forget(cores)
    c.release(spark)
    letters = spelled.filter("kind = 0").drop("kind", "payload")
    found, used = long_repeats(letters, spelled.count())

    def places(table):
        g, lead = table.column("g").to_numpy(), table.column("lead").to_numpy()
        lists = [np.unique(g).astype("<u4").tobytes(), np.unique(g[lead]).astype("<u4").tobytes()]
        return pa.table({"chunk": table.column("chunk").slice(0, 1).take(pa.array([0, 0])), "kind": pa.array([2, 4], pa.int32()), "payload": pa.array(lists, pa.binary())})

    placed = c.stored(found.groupBy("chunk").applyInArrow(c.tidied(places), "chunk int, kind int, payload binary"))
    for table in used:
        c.forget(table)
    known = spelled.filter("kind in (1, 5)").select("chunk", "kind", "payload").unionByName(placed)
    c.release(spark)

    def compared(x: Letters, notes: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings to compare by fingerprint (undecided ones, and one of each decided kind for them
        to meet), and the letters known to repeat."""
        repeated = np.unpackbits(np.frombuffer(notes.get(1, b""), np.uint8), bitorder="little")[: len(x.at)].astype(bool)
        full, lead = (np.frombuffer(notes.get(k, b""), "<u4").astype(np.int64) for k in (2, 4))
        begun = lambda letters: x.inside(x.at[letters], x.at[letters + 1] + 1)
        n = len(x.data)
        own = np.repeat(np.append(False, repeated), np.diff(np.concatenate([[0], x.since, [n]]))) if len(x.at) else np.zeros(n, bool)
        own &= ~begun(full)
        own |= begun(lead)
        own &= x.usable
        return np.flatnonzero(own), full

    def about_chunk(table: pa.Table) -> dict[int, bytes]:
        return dict(zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()))

    def ask_strings(table, about):
        notes = about_chunk(about)
        x = make(table, notes.get(5))
        starts, _ = compared(x, notes)
        keys, count, _ = distinct(x.hashes(starts, starts + width))
        return keys, [count]

    strings = c.asked(chunks, ask_strings, ["u1"], asked_twice, buckets, known)
    told = strings.select("chunk", F.lit(3).alias("kind"), "bucket", "payload").unionByName(known.select("chunk", "kind", F.lit(-1).alias("bucket"), "payload"))

    def finish(table, about):
        kind = about.column("kind").to_numpy()
        notes = about_chunk(about.filter(pa.array(kind != 3)))
        x = make(table, notes.get(5))
        starts, full = compared(x, notes)
        keys, _, which = distinct(x.hashes(starts, starts + width))
        bits = c.answers(about.filter(pa.array(kind == 3))).astype(bool) if len(keys) else np.zeros(0, bool)
        starts = starts[bits[which]]
        gone = x.inside(np.append(x.at[full], starts), np.append(x.at[full + 1], starts) + width)
        spans, kept, removed = [], [], []
        for a, b in zip(x.offsets[:-1], x.offsets[1:]):
            mask = gone[a:b]
            cut = np.flatnonzero(np.diff(mask, prepend=False, append=False)) if mask.any() else []
            spans.append([{"begin": int(p), "end": int(q)} for p, q in zip(cut[::2], cut[1::2])])
            kept.append(x.data[a:b][~mask].tobytes())
            removed.append(int(mask.sum()))
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": x.table.column("doc_id").cast(pa.int64()), "text_hash": x.table.column("text_hash"), "n_bytes": np.diff(x.offsets), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})

    schema = "doc_id long, text_hash long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary"
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(c.tidied(finish), schema)


def valid_text(kept: str) -> Column:
    """A string of the whole characters in a binary column that may cut through some."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: b if b is None else bytes(b).decode("utf-8", "ignore"))

    return run(kept)


def brute_force(texts: list[bytes], width: int = 200) -> list[np.ndarray]:
    """Which bytes of each text go, by a dictionary of all strings; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - width + 1):
            seen[t[p : p + width]] = seen.get(t[p : p + width], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = True
        out.append(gone)
    return out
