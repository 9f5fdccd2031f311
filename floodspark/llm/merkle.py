"""Merkle manifest of a table: levels built as parent-linked node rows, proofs climbed by a recursive query.

A leaf is the hash of one row. Leaves of a tree (one for each language) stand in order of doc_id; every two consecutive
nodes become the hash of both, a last one alone the hash of itself, until one node is left: the subroot. Subroots give
the root in the same way.

Trees are built in blocks of ``2 ** LEVELS`` consecutive nodes, each a small array in one row, so the tree of a hot language is
spread like any other and a table of n rows takes log(n) / LEVELS rounds. A node row holds its block, level and
place, its sibling, and so its link to the parent (level + 1, half its place); a tree that is one node already has a row without a step. The recursive query ascends inside blocks, a row
for each leaf, joined to the next node by (tree, block, level, place): at most ``2 ** LEVELS`` leaves meet in a node row. What
lies above a block is climbed once for the block, again by recursion, and then handed down to its leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.llm import common as c
from floodspark.llm.ranks import attached, positions, sized

LEVELS = 5
WIDTH = 1 << LEVELS
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
PATH = "sides string, siblings binary"

CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree, block, leaf, 0 AS level, leaf AS place, hash AS folded, '' AS sides, CAST('' AS BINARY) AS siblings, false AS arrived FROM {starts}
  UNION ALL
  SELECT c.tree, c.block, c.leaf, c.level + 1, CAST(c.place DIV 2 AS INT),
         CASE WHEN n.side = '' THEN c.folded ELSE unhex(sha2(CASE n.side WHEN 'L' THEN concat(lower(hex(n.sibling)), lower(hex(c.folded)))
                                WHEN 'R' THEN concat(lower(hex(c.folded)), lower(hex(n.sibling))) ELSE lower(hex(c.folded)) END, 256)) END,
         concat(c.sides, n.side), concat(c.siblings, n.sibling), n.last
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.block = n.block AND c.level = n.level AND c.place = n.place
)
SELECT tree, block, leaf, folded, sides, siblings FROM climb WHERE arrived
"""


def leaf_hash(n_chars: str | Column) -> Column:
    """Hash of a row with this n_chars: every value with its byte count, a null as a dash."""
    n_chars = F.col(n_chars) if isinstance(n_chars, str) else n_chars
    values = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), n_chars.cast("string"), F.col("text")]
    return F.sha2(F.concat(*(F.coalesce(sized(x), F.lit("-")) for x in values)), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, tree, leaf and other (binary): ``other`` is the leaf with n_chars + 1 where ``tampered`` holds."""
    tampered = F.lit(False) if tampered is None else tampered
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("+"), "lang"))  # "" is first in bytewise order
    other = F.when(F.coalesce(tampered, F.lit(False)), F.unhex(leaf_hash(F.col("n_chars") + 1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), F.unhex(leaf_hash("n_chars")).alias("leaf"), other.alias("other"))
    return rows.withColumn("other", F.coalesce("other", "leaf"))


def above(hashes: str) -> Column:
    """The next level of an array of hex hashes."""
    pair = lambda k: F.concat(F.element_at(hashes, 2 * k + 1), F.coalesce(F.try_element_at(hashes, 2 * k + 2), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int")), lambda k: F.sha2(pair(k), 256))


@dataclass
class Tree:
    """``rounds``: node rows of each round; ``tops``: tree and hash (binary) of every subroot."""

    rounds: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame, most: int, counts: DataFrame) -> Tree:
    """Trees of ``nodes`` (tree, idx from 0, hash binary); ``counts`` has tree and n, ``most`` is the largest n."""
    rounds: list[DataFrame] = []
    now, size = nodes, most
    while size > 1:
        at = WIDTH ** len(rounds)
        left = F.ceil(F.col("n") / at).cast("long")
        steps = F.when(left >= WIDTH, LEVELS).otherwise(F.ceil(F.log2(F.greatest(left, F.lit(1))))).cast("int")
        block = now.groupBy("tree", F.floor(F.col("idx") / WIDTH).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("own"))
        block = block.select("tree", "block", F.transform("own", lambda x: F.lower(F.hex(x["hash"]))).alias("l0"))
        block = attached(c.stored(block), counts, ["tree"]).withColumn("steps", steps)
        for k in range(LEVELS):
            block = block.withColumn(f"l{k + 1}", F.when(F.col("steps") > k, above(f"l{k}")))
        block = c.stored(block)
        level = F.posexplode(F.array(*(F.when(F.col("steps") > (k or -1), F.col(f"l{k}")) for k in range(LEVELS)))).alias("level", "row")
        rows = block.select("tree", "block", "steps", level).select("tree", "block", "steps", "level", "row", F.posexplode("row").alias("place", "hash"))
        beside = F.try_element_at("row", F.col("place").bitwiseXOR(F.lit(1)) + 1)
        side = F.when(F.col("steps") == 0, "").when(F.col("place") % 2 == 1, "L").when(F.col("place") + 1 < F.size("row"), "R").otherwise("N")
        rounds.append(c.stored(rows.select("tree", "block", "level", "place", side.alias("side"), F.unhex(F.coalesce(beside, F.lit(""))).alias("sibling"), (F.col("level") + 1 >= F.col("steps")).alias("last"))))
        top = F.element_at(F.element_at(F.array(*(f"l{k}" for k in range(LEVELS + 1))), F.col("steps") + 1), 1)
        now, size = block.select("tree", F.col("block").alias("idx"), F.unhex(top).alias("hash")), -(-size // WIDTH)
    return Tree(rounds, now.select("tree", "hash"))


def climbed(spark: SparkSession, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, block, leaf, folded, sides and siblings, from each of ``starts`` (tree, block, leaf, hash) up to the top of its block.

    The recursive query makes every step and keeps those that have arrived. Its limit of rows is lifted while it runs.
    """
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return c.stored(spark.sql(CLIMB, starts=starts, nodes=nodes))
    finally:
        spark.conf.set(ROW_LIMIT, before) if before is not None else spark.conf.unset(ROW_LIMIT)


def paths(spark: SparkSession, tree: Tree, upper: DataFrame) -> DataFrame:
    """tree, idx, sides, siblings and the columns of ``upper`` (tree, sides, siblings, more): the way from every top of a block of
    the first round to the end of ``upper``."""
    more = [x for x in upper.columns if x not in ("tree", "sides", "siblings")]
    now = upper.withColumn("idx", F.lit(0).cast("long"))
    for k in range(len(tree.rounds) - 1, 0, -1):
        below = tree.rounds[k]
        start = below.filter("level = 0").select("tree", "block", F.col("place").alias("leaf"), F.lit(b"").alias("hash"))
        own = climbed(spark, start, below)
        held = own.join(now.withColumnRenamed("idx", "block").withColumnsRenamed({"sides": "s", "siblings": "b"}), ["tree", "block"])
        held = held.select("tree", (F.col("block") * WIDTH + F.col("leaf")).alias("idx"), F.concat("sides", "s").alias("sides"), F.concat("siblings", "b").alias("siblings"), *more)
        now = c.stored(held)
    return now


def fold(start: Column, sides: str, siblings: str) -> Column:
    """The hex hash at the end of a way (``sides``, ``siblings``) that begins at the hex hash ``start``."""

    def step(x: Column, k: Column) -> Column:
        side = F.substring(sides, k, F.lit(1))
        other = F.lower(F.hex(F.substring(siblings, x["at"], F.lit(32))))
        joined = F.when(side == "L", F.concat(other, x["h"])).when(side == "R", F.concat(x["h"], other)).otherwise(x["h"])
        return F.struct(F.sha2(joined, 256).alias("h"), (x["at"] + F.when(side == "N", 0).otherwise(32)).alias("at"))

    return F.when(F.length(sides) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(sides)), F.struct(start.alias("h"), F.lit(1).alias("at")), step)["h"])


SCHEMA = "doc_id long, leaf string, subroot string, root string, sides string, siblings binary, folded_root string, verified boolean"


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot and root (hex), the proof (sides: L, R or N for none of each step; siblings: 32 bytes each, from the
    leaf up), folded_root (from the leaf, or with n_chars + 1 where ``tampered``) and verified, for every row of ``docs``
    (doc_id, source, lang, n_chars, text; other columns are ignored).

    A null value counts as a dash, so it differs from an empty text. Rows that repeat a doc_id are leaves of their own, in order
    of their hashes; a null doc_id comes first and a null lang is a tree of its own, the first. A single row
    is subroot and root itself. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = c.stored(leaves(docs, tampered))
    counts = c.stored(rows.groupBy("tree").agg(F.count("*").alias("n")))
    most = counts.agg(F.max("n")).first()[0]
    if not most:
        return spark.createDataFrame([], SCHEMA)
    ranked = c.stored(positions(rows, ["tree"], ["doc_id", "leaf"]))
    lower = build(ranked.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("hash")), most, counts)
    tops = c.stored(positions(c.stored(lower.tops.withColumn("one", F.lit("*"))), ["one"], ["tree"]))
    n_tops = tops.count()
    roots = tops.select(F.col("one").alias("tree"), F.col("pos").alias("idx"), "hash")
    upper = build(roots, n_tops, spark.createDataFrame([("*", n_tops)], "tree string, n long"))
    root = F.lit(upper.tops.select(F.lower(F.hex("hash"))).first()[0])
    own = tops.withColumns({"block": F.floor(F.col("pos") / WIDTH), "leaf": (F.col("pos") % WIDTH).cast("int")}).withColumnRenamed("hash", "subroot")

    def reached(starts: DataFrame, tree: Tree) -> DataFrame:
        """The first round's climb; without rounds every start is its own top."""
        if tree.rounds:
            return climbed(spark, starts, tree.rounds[0])
        return starts.select("tree", "block", "leaf", F.col("hash").alias("folded"), F.lit("").alias("sides"), F.lit(b"").alias("siblings"))

    none = spark.createDataFrame([("*", "", bytearray())], "tree string, sides string, siblings binary")
    first = reached(own.select(F.col("one").alias("tree"), "block", "leaf", F.col("subroot").alias("hash")), upper)
    over = paths(spark, upper, none).withColumnsRenamed({"idx": "block", "sides": "s", "siblings": "b"}).drop("tree")
    first = first.join(over, "block").select("block", "leaf", F.concat("sides", "s").alias("sides"), F.concat("siblings", "b").alias("siblings"))
    ends = c.stored(own.join(first, ["block", "leaf"]).select("tree", "sides", "siblings", F.lower(F.hex("subroot")).alias("subroot")))

    place = {"block": F.floor(F.col("pos") / WIDTH), "leaf_no": (F.col("pos") % WIDTH).cast("int")}
    ranked = ranked.withColumns(place)
    low = reached(ranked.select("tree", "block", F.col("leaf_no").alias("leaf"), F.col("other").alias("hash")), lower).withColumnsRenamed({"leaf": "leaf_no", "sides": "s", "siblings": "b"})
    high = paths(spark, lower, ends).withColumnRenamed("idx", "block")
    out = ranked.join(low, ["tree", "block", "leaf_no"]).join(high, ["tree", "block"])
    out = out.withColumn("folded_root", fold(F.lower(F.hex("folded")), "sides", "siblings")).withColumn("root", root)
    return out.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", F.concat("s", "sides").alias("sides"), F.concat("b", "siblings").alias("siblings"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
