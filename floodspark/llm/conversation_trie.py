"""Prefix trie of conversations by hashes of blocks of turns.

Conversations are cut into blocks of ``BLOCK`` turns. A turn's tag is a 128-bit hash of its place and content; a block's
digest is the sum of its tags, and the sum of all digests so far names the prefix, so a prefix is a running sum that Spark
can build in parts. Conversations are first grouped by (block number, prefix before, prefix after): all copies of a long
common beginning become one row for each block, however many there are. Where siblings differ (a prefix is followed by
more than one block digest), the turns inside those blocks are refined: prefixes turn by turn of the distinct
blocks, with the counts of their groups. Elsewhere the nodes of a block are read off its one row.

A node belongs to its smallest member, and what one conversation owns is the end of its way from some depth on, so
(smallest member, depth) names a node. What a subtree holds is summed over the blocks that pass through its top: what
their owners own further down, block by block from the end, and inside the block turn by turn. No step walks the tree.

Prefixes are equal when four 32-bit sums of tags made from SHA-256 agree, and the depth does. A conversation may be of any
length: positions come from a range partitioning, running sums from blocks of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark.llm import common as c
from floodspark.llm.ranks import attached, positions, sized

BLOCK = 8
#: Blocks whose sums are added up before running sums go over them.
SUPER = 64
LANES = [f"s{i}" for i in range(4)]


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, null first), digest and bytes of every turn of ``conversations`` (conv_id, turn, role, text;
    other columns are ignored). A null role or text is empty; rows without conv_id belong to no conversation; turns of
    one number stand in order of their digests."""
    empty = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(sized(empty("role")), empty("text")), 256))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(empty("text")).cast("long").alias("bytes"))
    return positions(c.stored(rows), ["conv_id"], ["turn", "digest"]).drop("turn")


def branched(turns: DataFrame, ids: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Every conversation c of ``ids`` (conv_id) with the first h turns of c - c % ``family``, then its own after its first h;
    h = crc32(decimal c) % (most + 1). ``turns`` is what ``ordered`` gives, and so is the result."""
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    heads = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    sizes = heads.groupBy("base").agg(F.count("*").alias("size"))
    wanted = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    first = wanted.join(heads, "base").filter(F.col("pos") < F.col("h")).select("conv_id", "pos", "digest", "bytes")
    short = wanted.join(sizes, "base", "left").select("conv_id", (F.col("h") - F.least("h", F.coalesce("size", F.lit(0)))).alias("short")).filter("short > 0")
    own = attached(c.stored(turns.filter(F.col("pos") >= h)), c.stored(short), ["conv_id"])
    own = own.select("conv_id", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("pos"), "digest", "bytes")
    return first.unionByName(own)


def before(rows: DataFrame, order: Column, sums: list[str]) -> DataFrame:
    """``rows`` (stored; conv_id) with, for each of ``sums``, its sum over the conversation's rows before by ``order`` (a whole number,
    one for each row) as ``<name>_before``. Windows go over SUPER numbers at most, and over the sums of so many."""
    rows = rows.withColumn("_o", order).withColumn("_s", F.floor(F.col("_o") / SUPER))
    own = Window.partitionBy("conv_id", "_s").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "_s").agg(*(F.sum(x).alias(x) for x in sums))
    parts = parts.select("conv_id", "_s", *(F.sum(x).over(over).alias(f"{x}_over") for x in sums)).filter(F.col(f"{sums[0]}_over").isNotNull())
    out = rows.withColumns({f"{x}_own": F.sum(x).over(own) for x in sums}).join(parts, ["conv_id", "_s"], "left")
    zero = F.lit(0)
    out = out.withColumns({f"{x}_before": F.coalesce(f"{x}_own", zero) + F.coalesce(f"{x}_over", zero) for x in sums})
    return out.drop("_o", "_s", *(f"{x}_own" for x in sums), *(f"{x}_over" for x in sums))


def key_of(*lanes: Column) -> Column:
    return F.concat_ws(".", *(F.hex(x) for x in lanes))


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, blk, own (bytes, sums before and with each turn of the block), prefix and key (names of what stands before and with
    the block), size (turns up to its end)."""
    low, tag = F.lit(0xFFFFFFFF), [F.xxhash64(F.lit(k), "digest", "pos") for k in (1, 2)]
    lanes = [x for t in tag for x in (F.shiftrightunsigned(t, 32), t.bitwiseAND(low))]
    rows = turns.select("conv_id", "pos", "bytes", F.floor(F.col("pos") / BLOCK).alias("blk"), *(x.alias(f"t{i}") for i, x in enumerate(lanes)))
    so_far = Window.partitionBy("conv_id", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"q{i}": F.sum(f"t{i}").over(so_far) for i in range(4)})
    turn = F.struct("pos", "bytes", F.array(*(F.col(f"q{i}") - F.col(f"t{i}") for i in range(4))).alias("a"), F.array(*(F.col(f"q{i}") for i in range(4))).alias("b"))
    blk = rows.groupBy("conv_id", "blk").agg(F.array_sort(F.collect_list(turn)).alias("own"), *(F.sum(f"t{i}").alias(s) for i, s in enumerate(LANES)))
    out = before(c.stored(blk), F.col("blk"), LANES)
    start, end = [F.col(f"{s}_before") for s in LANES], [F.col(f"{s}_before") + F.col(s) for s in LANES]
    return out.select("conv_id", "blk", "own", F.array(*start).alias("start"), key_of(*start).alias("prefix"), key_of(*end).alias("key"), (F.col("blk") * BLOCK + F.size("own")).alias("size"))


ROOT = ".".join("0" * 4)
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, key string"


def trie(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the conversations ``ids`` (conv_id, distinct) with ``turns`` (conv_id, pos, digest, bytes; positions from 0
    without gaps).

    Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved (sum over the subtree of (members - 1) x bytes of the last turn) and key, a name of the prefix. Turn
    ``depth - 1`` of conversation conv_id is a node's last turn. The root has depth 0 and no parent; conversations without turns
    end there. Ends: conv_id, depth and key of the node where each conversation ends. No conversations: no nodes.
    """
    own = c.stored(blocks(turns))
    groups = c.stored(own.groupBy("blk", "prefix", "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("own").alias("own"), F.first("start").alias("start")))
    siblings = groups.groupBy("blk", "prefix").agg(F.count("*").alias("siblings"))
    groups = c.stored(attached(groups, siblings, ["blk", "prefix"]))
    name = lambda lanes: key_of(*(F.col("start")[i] + F.col(f"x.{lanes}")[i] for i in range(4)))

    def opened(rows: DataFrame, *more: Column | str) -> DataFrame:
        """The turns of the rows' blocks, each with the names of its prefix and of its parent's."""
        return rows.withColumn("x", F.explode("own")).select((F.col("x.pos") + 1).alias("depth"), name("b").alias("key"), name("a").alias("parent"), F.col("x.bytes").alias("bytes"), *more)

    alone = opened(groups.filter("siblings = 1"), "n", "least")
    refined = opened(groups.filter("siblings > 1"), "n", "least").groupBy("depth", "key").agg(F.first("parent").alias("parent"), F.first("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("least").alias("least"))
    nodes = c.stored(alone.unionByName(refined))

    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = c.stored(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "own_saved": (F.col("n") - 1) * F.col("bytes"), "above": F.col("depth") - 1}))
    parents = nodes.select(F.col("depth").alias("above"), F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    nodes = c.stored(attached(nodes, parents, ["above", "parent"]))

    held = nodes.groupBy(F.col("least").alias("conv_id"), F.floor((F.col("depth") - 1) / BLOCK).alias("blk")).agg(F.sum("leaf").alias("leaf"), F.sum("own_saved").alias("own_saved"), F.collect_list(F.struct("depth", "leaf", "own_saved")).alias("items"))
    held = c.stored(held)
    sums = ["leaf", "own_saved"]
    further = own.select("conv_id", "blk", "key").join(held.drop("items"), ["conv_id", "blk"], "left").fillna(0, sums)
    further = before(c.stored(further), -F.col("blk"), sums).groupBy("blk", "key").agg(*(F.sum(f"{x}_before").alias(f"{x}_further") for x in sums))
    groups = groups.join(further, ["blk", "key"]).drop("key").join(held.select(F.col("conv_id").alias("least"), "blk", "items"), ["least", "blk"], "left")
    inside = lambda x: F.aggregate(F.filter(F.coalesce("items", F.array().cast("array<struct<depth:bigint,leaf:bigint,own_saved:bigint>>")), lambda y: y["depth"] > F.col("x.pos")), F.lit(0).cast("long"), lambda total, y: total + y[x])
    below = opened(groups, *((F.col(f"{x}_further") + inside(x)).alias(x) for x in sums)).groupBy("depth", "key").agg(F.sum("leaf").alias("n_leaves"), F.sum("own_saved").alias("saved"))

    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    all_of = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.coalesce(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("own_saved"), F.lit(0)).alias("saved")).first()
    least = ids.agg(F.min("conv_id")).first()[0]
    top = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", *(F.lit(all_of[x]).cast("long").alias(x) for x in ("n_children", "n_leaves", "saved")), F.lit(ROOT).alias("key"))
    rest = nodes.join(below, ["depth", "key"]).select(F.col("least").alias("conv_id"), "depth", F.coalesce("parent_conv_id", F.lit(least)).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved", "key")

    last = own.groupBy("conv_id").agg(F.max(F.struct("size", "key")).alias("last")).select("conv_id", F.col("last.size").alias("depth"), F.col("last.key").alias("key"))
    ends = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("key", F.lit(ROOT)).alias("key"))
    return rest.unionByName(top), ends


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, key and sha256 of the comma-joined conv_ids, ascending, of each node where conversations end. The ids of a node are
    joined in ranges first and the ranges hashed in order as they stream by, so memory does not grow with a node's ids."""
    ranges = ends.repartitionByRange("conv_id").withColumn("pid", F.spark_partition_id())
    joined = ranges.groupBy("depth", "key", "pid").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, state = ["depth", "key", "ends_sha256"], None, hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            for depth, key, ids in zip(*(batch.column(x).to_pylist() for x in ("depth", "key", "ids"))):
                if (depth, key) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (depth, key), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names)

    return joined.repartition("depth", "key").sortWithinPartitions("depth", "key", "pid").mapInArrow(hashed, "depth long, key string, ends_sha256 string")
