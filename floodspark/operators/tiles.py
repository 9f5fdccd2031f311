"""Graphs of cells solved in two levels: inside tiles, then among the cells on tiles' rims, then back into the tiles.

A tile is one task of at most tile x tile cells, whatever the site's size. What joins and loops see is the contracted graph: of a
tile only cells that another tile drains to, or labels that touch its rim, so rounds grow with the logarithm of the number
of tiles that a path crosses and shuffles with the tiles' rims. Cells have site_id, row, col and cell_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.operators.grids import neighbours
from floodspark.sources.io import kept

KEYS = ("site_id", "tr", "tc")


def with_tile(cells: DataFrame, tile: int) -> DataFrame:
    """Adds the tile (tr, tc) of each cell."""
    return cells.withColumn("tr", F.floor(F.col("row") / tile).cast("int")).withColumn("tc", F.floor(F.col("col") / tile).cast("int"))


def on_rim(tile: int) -> Column:
    return F.pmod("row", F.lit(tile)).isin(0, tile - 1) | F.pmod("col", F.lit(tile)).isin(0, tile - 1)


def ends(p: np.ndarray) -> np.ndarray:
    """The last of each chain of indices, where ends point at themselves."""
    while not np.array_equal(q := p[p], p):
        p = q
    return p


def inner(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A tile by cell_id, the index that each cell drains to (itself if that is none of the tile), and where it drains to
    another tile."""
    pdf = pdf.sort_values("cell_id", ignore_index=True)
    ids, to = pdf["cell_id"].to_numpy(), pdf["to"].to_numpy()
    at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    here = ids[at] == to
    return pdf, np.where(here, at, np.arange(len(ids))), ~here


def gathered(down: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``n`` over all that drain to each index of a tile, itself included."""
    jump, n = np.where(down == np.arange(len(down)), -1, down), n.copy()
    while (live := jump >= 0).any():
        more = np.zeros_like(n)
        np.add.at(more, jump[live], n[live])
        n += more
        jump[live] = jump[jump[live]]
    return n


def draining(tree: DataFrame, tile: int, *more: str) -> DataFrame:
    """site_id, cell_id and ``to`` (the parent, or the cell itself without one) as longs, with tiles."""
    to = F.coalesce("parent", "cell_id").cast("long").alias("to")
    return kept(with_tile(tree, tile).select(*KEYS, F.col("cell_id").cast("long").alias("cell_id"), to, on_rim(tile).alias("rim"), *more))


def accumulation(tree: DataFrame, tile: int) -> DataFrame:
    """site_id, cell_id and the number of cells that drain through each, itself included."""
    cells = draining(tree, tile)
    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    keys = ", ".join(f"{k} {types[k]}" for k in KEYS)

    def leaving(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, down, out = inner(pdf)
        last, n = ends(down), gathered(down, np.ones(len(pdf), np.int64))
        ahead = np.where(out[last], pdf["to"].to_numpy()[last], pdf["cell_id"])
        return pdf.assign(ahead=ahead, n=np.where(out, n, 0))[pdf["rim"]][[*KEYS, "cell_id", "ahead", "n"]]

    rim = kept(cells.groupBy(*KEYS).applyInPandas(leaving, f"{keys}, cell_id long, ahead long, n long"))
    # what tiles send on by themselves; then what passes through them
    sent = rim.filter("n > 0").groupBy("site_id", F.col("ahead").alias("cell_id")).agg(F.sum("n").alias("n"))
    entries = rim.drop("n").join(sent, ["site_id", "cell_id"])
    state = kept(entries.select(*KEYS, "cell_id", F.when(F.col("ahead") != F.col("cell_id"), F.col("ahead")).alias("jump"), "n"))
    while state.filter("jump is not null").limit(1).count():
        added = state.filter("jump is not null").groupBy("site_id", F.col("jump").alias("cell_id")).agg(F.sum("n").alias("more"))
        onward = state.select("site_id", F.col("cell_id").alias("jump"), F.col("jump").alias("next"))
        state = kept(state.join(added, ["site_id", "cell_id"], "left").join(onward, ["site_id", "jump"], "left").select(*KEYS, "cell_id", F.col("next").alias("jump"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))

    def back(pdf: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
        pdf, down, _ = inner(pdf)
        n = np.ones(len(pdf), np.int64)
        n[np.searchsorted(pdf["cell_id"], entering["cell_id"])] += entering["n"].to_numpy()
        return pdf.assign(accumulation=gathered(down, n))[["site_id", "cell_id", "accumulation"]]

    done = cells.groupBy(*KEYS).cogroup(state.groupBy(*KEYS)).applyInPandas(back, f"site_id {types['site_id']}, cell_id long, accumulation long")
    return done.withColumn("cell_id", F.col("cell_id").cast(tree.schema["cell_id"].dataType))


def first_ancestor(tree: DataFrame, marked: str, tile: int) -> DataFrame:
    """site_id, cell_id and the first marked cell on the way down from each, itself included; null if none."""
    cells = draining(tree, tile, F.coalesce(F.col(marked), F.lit(False)).alias("marked"))
    site = cells.schema["site_id"].dataType.simpleString()

    def ahead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, down, out = inner(pdf)
        stop, ids = pdf["marked"].to_numpy(bool), pdf["cell_id"].to_numpy()
        last = ends(np.where(stop, np.arange(len(ids)), down))
        hit = stop[last]
        at = np.where(hit, ids[last], np.where(out[last], pdf["to"].to_numpy()[last], ids))
        return pdf.assign(at=at, hit=hit)[["site_id", "cell_id", "at", "hit"]]

    near = cells.groupBy(*KEYS).applyInPandas(ahead, f"site_id {site}, cell_id long, at long, hit boolean")
    near = kept(near.select("site_id", "cell_id", F.when(F.col("hit"), F.col("at")).alias("found"), F.when(~F.col("hit") & (F.col("at") != F.col("cell_id")), F.col("at")).alias("jump")))
    entries = near.filter("jump is not null").select("site_id", F.col("jump").alias("cell_id")).distinct()
    state = kept(near.join(entries, ["site_id", "cell_id"], "left_semi"))
    while state.filter("found is null and jump is not null").limit(1).count():
        further = state.select("site_id", F.col("cell_id").alias("jump"), F.col("found").alias("f2"), F.col("jump").alias("j2"))
        state = kept(state.join(further, ["site_id", "jump"], "left").select("site_id", "cell_id", F.coalesce("found", "f2").alias("found"), F.when(F.coalesce("found", "f2").isNull(), F.col("j2")).alias("jump")))
    kind = tree.schema["cell_id"].dataType
    far = state.select("site_id", F.col("cell_id").alias("jump"), F.col("found").alias("far"))
    return near.join(far, ["site_id", "jump"], "left").select("site_id", F.col("cell_id").cast(kind).alias("cell_id"), F.coalesce("found", "far").cast(kind).alias("found"))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each one's component, for links between indices a and b."""
    p = np.arange(n)
    while True:
        q = p.copy()
        np.minimum.at(q, p[a], p[b])
        np.minimum.at(q, p[b], p[a])
        if np.array_equal(q := ends(q), p):
            return p
        p = q


def linked(pairs: DataFrame) -> DataFrame:
    """site_id, label and root (the least label reachable) of pairs of labels (site_id, label, other), given both ways. Labels go to
    neighbours and to the label's own label, so long chains take few rounds."""
    state = kept(pairs.select("site_id", "label", F.col("label").alias("root")).distinct())
    while True:
        low = pairs.join(state.select("site_id", F.col("label").alias("other"), F.col("root").alias("r")), ["site_id", "other"]).groupBy("site_id", "label").agg(F.min("r").alias("r"))
        now = state.join(low, ["site_id", "label"], "left").withColumn("new", F.least("root", "r"))
        # the neighbourhood's label also hooks the old label
        hooks = now.groupBy("site_id", F.col("root").alias("label")).agg(F.min("new").alias("hook"))
        now = kept(now.select("site_id", "label", "root", "new").join(hooks, ["site_id", "label"], "left").select("site_id", "label", "root", F.least("new", "hook").alias("new")))
        own = now.select("site_id", F.col("label").alias("new"), F.col("new").alias("far"))
        state = kept(now.join(own, ["site_id", "new"]).select("site_id", "label", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        if not state.filter("moved").limit(1).count():
            return state.drop("moved")
        state = state.drop("moved")


def components(mask: DataFrame, tile: int) -> DataFrame:
    """site_id, cell_id and component (least cell_id) of eight-connected cells."""
    kind = mask.schema["cell_id"].dataType
    cells = with_tile(mask.select("site_id", "row", "col", F.col("cell_id").cast("long").alias("cell_id")), tile)
    types = {f.name: f.dataType.simpleString() for f in cells.schema}

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, which = np.unique(pdf["cell_id"].to_numpy(), return_inverse=True)
        r, c = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        r, c = r - r.min() + 1, c - c.min() + 1
        grid = np.full((r.max() + 2, c.max() + 2), -1)
        grid[r, c] = which
        a, b = [], []
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
            there = grid[r + dr, c + dc]
            a.append(which[there >= 0])
            b.append(there[there >= 0])
        root = joined(len(ids), np.concatenate(a), np.concatenate(b))
        return pdf.assign(label=ids[root[which]])[["site_id", "row", "col", "cell_id", "label"]]

    inside = kept(cells.groupBy(*KEYS).applyInPandas(label, f"site_id {types['site_id']}, row {types['row']}, col {types['col']}, cell_id long, label long"))
    pairs = neighbours(inside.filter(on_rim(tile)).select("site_id", "row", "col", "label"), "label").filter("label <> n_label")
    roots = linked(kept(pairs.select("site_id", "label", F.col("n_label").alias("other")).distinct()))
    return inside.join(roots, ["site_id", "label"], "left").select("site_id", F.col("cell_id").cast(kind).alias("cell_id"), F.coalesce("root", "label").cast(kind).alias("component"))
