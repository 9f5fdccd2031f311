"""Helpers shared by the text operators: shared folders, chunks of documents, words and hashes.

Texts are handled as the UTF-8 bytes of an Arrow column, so that the work inside a task is a few
numpy passes over one flat buffer. Spark does all partitioning and shuffling.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.sources import io

#: Text bytes that one chunk of documents, and one bucket of hashes, is meant to hold.
CHUNK_BYTES = 4 << 20
#: Parts that little text may be dealt to.
LEAST = 16

ODD = np.uint64(0x9E3779B97F4A7C15)


# --------------------------------------------------------------------------- shared folders
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, set for checkpoints too."""
    path = io.shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs read the shared folder, not the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *partition_by: str, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; columnar, for the larger intermediates. ``codec`` is that of
    the files, the session's if not given."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if codec:
        writer = writer.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Spark hand texts to Python in batches of at most about ``size`` bytes, so that a task's buffers stay
    small whatever the rows' lengths; a session that asks for smaller batches keeps them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= size:
        spark.conf.set(key, str(size))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from ``names``."""
    taken = {x.lower() for x in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps before the next large shuffle."""
    for _ in range(2):  # what Python lets go of reaches the JVM with the next call
        gc.collect()
        spark.sparkContext._jvm.System.gc()


#: What this Python worker keeps from task to task: the tables of the operator that asked last.
KEPT: dict = {}


def kept_in_worker(key, make: Callable):
    """``make()``, made once in a Python worker and kept until another key is asked for or ``tidy`` lets go of it."""
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = make()
    return KEPT[key]


def tidy(alone: bool = True) -> None:
    """Give back what Arrow and the C library hold unused: workers are used again by later tasks and stages, and without this each
    holds the most that any had. ``alone``: also what another operator has left in the worker."""
    if alone and KEPT:
        KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(f: Callable) -> Callable:
    """``f``, a function of one group, in a worker that is tidied before and after."""

    def run(*tables: pa.Table) -> pa.Table:
        tidy()
        try:
            return f(*tables)
        finally:
            tidy()

    # Spark goes by the number of arguments
    return (lambda table: run(table)) if f.__code__.co_argcount == 1 else (lambda table, more: run(table, more))


def slices(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes of text; a longer text alone."""
    _, offsets = utf8(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


# --------------------------------------------------------------------------- chunks
def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(docs: DataFrame, size: int | None = None, unit: int = CHUNK_BYTES, each: int = 2) -> int:
    """Number of chunks or buckets: grows with the bytes of text, at least ``each`` for a shuffle partition. Chunks and buckets
    meet in pairs, so many partitions do not split little text: no more than LEAST parts, or parts of half a unit."""
    size = text_bytes(docs) if size is None else size
    return max(min(each * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(LEAST, -(-2 * size // unit))), -(-size // unit))


def in_chunks(docs: DataFrame, n: int, *more: str) -> DataFrame:
    """doc_id, text and the columns ``more`` with ``chunk``, a hash of the whole row: copies of a
    text under different ids spread over all chunks."""
    return docs.select("doc_id", "text", *more, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"))


def asked(chunks: DataFrame, ask: Callable[..., tuple], kinds: list[str], answer: Callable[[list[np.ndarray], np.ndarray], tuple[np.ndarray, list[int]]], buckets: int, known: DataFrame | None = None) -> DataFrame:
    """What every chunk wants to know about its hashes, answered by the bucket that owns each hash.

    ``ask(table)`` gives the sorted uint64 hashes of a chunk and columns of ``kinds`` that go with them;
    a bucket gets those of all chunks (``answer(columns, start)``: the first column are hashes,
    ``start`` marks where a chunk's begin) and returns one number for each, and a few totals of its own
    (``notes``, on one row of each bucket). The result has a row for each chunk and bucket;
    ``answers(table)`` puts a chunk's rows together, in the order asked. A hash costs at most one
    entry for each chunk however often it occurs, so no bucket is hot. ``known``, if given, has
    more rows about the chunks, which ``ask`` then gets as a second table. A third thing that ``ask`` gives, a table of
    cell, n (int64), is summed by cell over the chunks that a bucket is given: ``tallies`` has the rest.
    """
    types = [np.dtype(x) for x in ("<u8", *kinds)]

    def send(table: pa.Table, *more_tables: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        keys, more, *tally = ask(table, *more_tables)
        cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        columns = [np.asarray(x, kind) for x, kind in zip((keys, *more), types)]
        payload = [b"".join(planes(x[cuts[b] : cuts[b + 1]]) for x in columns) for b in used]
        n = np.diff(cuts)[used]
        if tally and len(tally[0][0]):
            used, n, payload = np.append(used, chunk % buckets), np.append(n, -1), [*payload, np.stack(tally[0]).astype("<i8").tobytes()]
        return pa.table({"bucket": pa.array(used, pa.int32()), "chunk": pa.array([chunk] * len(used), pa.int32()), "n": pa.array(n, pa.int32()), "payload": pa.array(payload, pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        own = table.column("n").to_numpy() >= 0
        rows, others = table.filter(pa.array(own)).sort_by("chunk"), table.filter(pa.array(~own))
        n = rows.column("n").to_numpy()
        columns = [[np.zeros(0, kind)] for kind in types]
        for size, block in zip(n, rows.column("payload")):
            at, block = 0, block.as_buffer()
            for k, kind in enumerate(types):
                columns[k].append(unplanes(block, at, int(size), kind))
                at += int(size) * kind.itemsize
        start = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        out, notes = answer([np.concatenate(x) for x in columns], start)
        payload = [planes(out[a:b]) for a, b in zip(start[:-1], start[1:])]
        chunk, bucket, notes = rows.column("chunk").to_pylist(), table.column("bucket")[0].as_py(), [notes, *[None] * len(n)][: len(n)]
        if others.num_rows:
            cells, counts = np.concatenate([np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1) for x in others.column("payload")], axis=1)
            one, which = np.unique(cells, return_inverse=True)
            chunk, payload, notes = [*chunk, -1], [*payload, b""], [*notes, np.stack([one, np.bincount(which, counts, len(one)).astype(np.int64)]).reshape(-1).tolist()]
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "bucket": pa.array([bucket] * len(chunk), pa.int32()), "payload": pa.array(payload, pa.binary()), "notes": pa.array(notes, pa.list_(pa.int64()))})

    schema = "bucket int, chunk int, n int, payload binary"
    if known is None:
        asks = chunks.groupBy("chunk").applyInArrow(lambda table: send(table), schema)
    else:
        asks = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(lambda table, more: send(table, more), schema)
    return asks.groupBy("bucket").applyInArrow(reply, "chunk int, bucket int, payload binary, notes array<long>")


def tallies(replies: DataFrame) -> DataFrame:
    """cell and n, summed over all chunks, of stored replies."""
    cell = F.posexplode(F.slice("notes", F.lit(1), F.floor(F.size("notes") / 2).cast("int"))).alias("k", "cell")
    return replies.filter("chunk < 0").select("notes", cell).select("cell", F.col("notes")[F.col("k") + F.floor(F.size("notes") / 2).cast("int")].alias("n")).groupBy("cell").agg(F.sum("n").alias("n"))


def sorted_set(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])[: len(a)]]


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of the sorted hashes ``keys`` at each of ``wanted``, all of which are keys. Hashes are spread evenly, so
    their first bits lead to within a place or two."""
    if not len(keys):
        return values[:0]
    shift = np.uint64(64 - len(keys).bit_length())
    first = np.bincount((keys >> shift).astype(np.int64), minlength=1 << len(keys).bit_length())
    at = (np.cumsum(first) - first)[(wanted >> shift).astype(np.int64)]
    open_ = np.flatnonzero(keys[at] != wanted)
    while len(open_):
        at[open_] += 1
        open_ = open_[keys[at[open_]] != wanted[open_]]
    return values[at]


def answers(table: pa.Table, dtype=np.uint8) -> np.ndarray:
    kind = np.dtype(dtype)
    blocks = [x.as_buffer() for x in table.sort_by("bucket").column("payload")]
    return np.concatenate([np.zeros(0, kind), *(unplanes(x, 0, x.size // kind.itemsize, kind) for x in blocks)])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the hash, so that sorted hashes fall into consecutive slices."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def planes(a: np.ndarray) -> bytes:
    """Byte planes, the high bytes of sorted values side by side: the shuffle's codec then shrinks them."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unplanes(block: pa.Buffer, at: int, n: int, dtype: np.dtype) -> np.ndarray:
    raw = np.frombuffer(block, np.uint8, n * dtype.itemsize, at)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


# --------------------------------------------------------------------------- bytes, words, hashes
def flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and where each text begins and ends; null counts as empty."""
    a = pc.fill_null(flat(column).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return pc.fill_null(flat(column).cast(pa.large_binary()), b"").to_pylist()


def lookup(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SPACE = lookup(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each of 256 places in a word.
PLACE = mix((np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * ODD)
#: Others, for a second hash that is independent of the first.
OTHER = mix((np.arange(1 << 16, dtype=np.uint64) + np.uint64(1 << 20)) * ODD)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of other bytes than ``space``, and the first word of each text."""
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, random: np.ndarray = PLACE) -> np.ndarray:
    """64-bit hash of every word: random numbers by place and byte, summed, then mixed with the length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = (end - start).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(size[:-1], dtype=np.int64)])
    shift = np.repeat((start - first).astype(np.int32), size)
    at = np.arange(len(shift), dtype=np.int32)
    byte = data[at + shift]
    place = at - np.repeat(first.astype(np.int32), size)
    value = random[((place & 255) << 8) | byte]
    if size.max() > 256:
        value = value * ((place.astype(np.uint64) >> np.uint64(8)) * np.uint64(2) + np.uint64(1))
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * ODD)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


#: Odd, so it has an inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values, from prefix sums modulo 2**64."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(BASE, len(values)), dtype=np.uint64)])
    return mix((total[k:] - total[:n]) * powers(INVERSE, n))


def whole(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the windows of k consecutive items that begin at 0 to n-1 lie inside one text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + k <= ends


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Items inside a window of ``width`` items that begins at one of ``starts``."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    change -= np.bincount(starts + width, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0
