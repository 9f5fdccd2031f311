"""Terrain jobs on graphs of cells: filling, drainage, accumulation, heights, components, outlines.

The fill works on tiles that exchange their border cells; accumulation, heights and components are solved inside tiles and then
among their rims (``tiles``); traces follow chains of cells by pointer doubling. Every round is a checkpoint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.operators import tiles
from floodspark.operators.grids import neighbours, within_radius
from floodspark.sources.io import kept


def seeds(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Cells (site_id, row, col, cell_id, z) with ``seed``: on the border, or without a height, or beside such a cell's gap."""
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)
    return cells.withColumn("seed", edge | F.col("z").isNull())


def fill(cells: DataFrame, width: int, height: int, epsilon: float = 1e-3, tile: int = 256) -> DataFrame:
    """Filled heights: the least surface that is at least z and, but for seeds, over its lowest neighbour by
    ``epsilon``. Null heights are outlets. Tiles are solved with a rim of their neighbours' cells until no rim changes."""
    s = seeds(cells, width, height).withColumn("z", F.when(F.col("z").isNull(), float("-inf")).otherwise(F.col("z").cast("double")))
    state = kept(s.withColumn("filled", F.when(F.col("seed"), F.col("z")).otherwise(float("inf"))).withColumn("tr", F.floor(F.col("row") / tile).cast("int")).withColumn("tc", F.floor(F.col("col") / tile).cast("int")))
    near = lambda x: F.array_distinct(F.array(F.floor((F.col(x) - 1) / tile).cast("int"), F.floor(F.col(x) / tile).cast("int"), F.floor((F.col(x) + 1) / tile).cast("int")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = ((pdf["tr"] == pdf["ar"]) & (pdf["tc"] == pdf["ac"])).to_numpy()
        r, c = pdf["row"].to_numpy() - pdf["row"].min() + 1, pdf["col"].to_numpy() - pdf["col"].min() + 1
        shape = (r.max() + 2, c.max() + 2)
        z, w, free = np.full(shape, np.inf), np.full(shape, np.inf), np.zeros(shape, bool)
        z[r, c], w[r, c], free[r, c] = pdf["z"], pdf["filled"], own & ~pdf["seed"].to_numpy()
        while True:
            low = np.full(shape, np.inf)
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if a or b:
                        low[1:-1, 1:-1] = np.minimum(low[1:-1, 1:-1], w[1 + a : shape[0] - 1 + a, 1 + b : shape[1] - 1 + b])
            new = np.where(free, np.minimum(w, np.maximum(z, low + epsilon)), w)
            if (new == w).all():
                break
            w = new
        now = w[r[own], c[own]]
        return pdf[own].assign(moved=now != pdf.loc[own, "filled"], filled=now)[[*names, "moved"]]

    names = state.columns
    schema = state.withColumn("moved", F.lit(True)).schema
    while True:
        spread = state.withColumn("ar", F.explode(near("row"))).withColumn("ac", F.explode(near("col")))
        state = kept(spread.groupBy("site_id", "ar", "ac").applyInPandas(solve, schema))
        moved, state = state.filter("moved").limit(1).count(), state.drop("moved")
        if not moved:
            return state.drop("tr", "tc").withColumn("z", F.when(F.col("z") > float("-inf"), F.col("z"))).withColumn("filled", F.when(F.abs("filled") < float("inf"), F.col("filled")))


def drainage(filled: DataFrame) -> DataFrame:
    """Adds parent: the neighbour with the least (filled height, id); null for seeds. A null height is lowest."""
    low = filled.withColumn("f", F.coalesce("filled", F.lit(float("-inf")))).withColumn("nb", F.struct("f", "cell_id"))
    best = neighbours(low.select("site_id", "row", "col", "cell_id", "nb"), "nb").groupBy("site_id", "cell_id").agg(F.min("n_nb").alias("b"))
    return filled.join(best, ["site_id", "cell_id"], "left").withColumn("parent", F.when(~F.col("seed"), F.col("b.cell_id"))).drop("b")


def accumulation(tree: DataFrame, tile: int = 256) -> DataFrame:
    """site_id, cell_id and the number of cells that drain through each, itself included (cells with row, col, parent)."""
    return tiles.accumulation(tree, tile)


def first_ancestor(tree: DataFrame, marked: str, tile: int = 256) -> DataFrame:
    """site_id, cell_id and the first marked cell on the way down from each, itself included; null if none."""
    return tiles.first_ancestor(tree, marked, tile)


def height_above(tree: DataFrame, marked: str, tile: int = 256) -> DataFrame:
    """Filled height over that of the first channel cell downstream, in single precision; null if none."""
    f = tree.select("site_id", F.col("cell_id").alias("found"), F.col("filled").cast("float").alias("low"))
    return tree.select("site_id", "cell_id", F.col("filled").cast("float").alias("high")).join(first_ancestor(tree, marked, tile), ["site_id", "cell_id"]).join(f, ["site_id", "found"], "left").select("site_id", "cell_id", (F.col("high") - F.col("low")).alias("hand"))


def trace(tree: DataFrame, starts: DataFrame) -> DataFrame:
    """site_id, start, step, cell_id: the way down from each start to its outlet."""
    jump = kept(tree.select("site_id", "cell_id", F.col("parent").alias("next")).filter("next is not null"))
    found, reach = kept(starts.select("site_id", F.col("cell_id").alias("start"), F.lit(0).alias("step"), "cell_id")), 1
    while True:
        more = found.join(jump, ["site_id", "cell_id"]).select("site_id", "start", (F.col("step") + reach).alias("step"), F.col("next").alias("cell_id"))
        bigger = kept(found.unionAll(more))
        if bigger.count() == found.count():
            return found
        found, reach = bigger, reach * 2
        jump = kept(jump.join(jump.select("site_id", F.col("cell_id").alias("next"), F.col("next").alias("far")), ["site_id", "next"]).select("site_id", "cell_id", F.col("far").alias("next")))


def upstream(basins: DataFrame, seeds_: DataFrame, hops: int = 25) -> DataFrame:
    """seed, hybas_id and hop of all basins upstream of each seed, not visited twice."""
    found = kept(seeds_.select(F.col("hybas_id").alias("seed"), "hybas_id", F.lit(0).alias("hop")))
    front = found
    for hop in range(1, hops + 1):
        nxt = front.join(basins.select(F.col("next_down").alias("hybas_id"), F.col("hybas_id").alias("up")), "hybas_id").select("seed", F.col("up").alias("hybas_id"), F.lit(hop).alias("hop")).distinct()
        front = kept(nxt.join(found, ["seed", "hybas_id"], "left_anti"))
        if not front.limit(1).count():
            break
        found = kept(found.unionByName(front))
    return found


def components(mask: DataFrame, tile: int = 256) -> DataFrame:
    """site_id, cell_id and component (least cell_id) of eight-connected cells (site_id, row, col, cell_id)."""
    return tiles.components(mask, tile)


def touching(labelled: DataFrame, marked: DataFrame) -> DataFrame:
    """The cells of components (site_id, cell_id, component) that hold a cell of ``marked`` (site_id, cell_id)."""
    hit = labelled.join(marked.select("site_id", "cell_id"), ["site_id", "cell_id"], "left_semi").select("site_id", "component").distinct()
    return labelled.join(hit, ["site_id", "component"], "left_semi")


def component_areas(labelled: DataFrame, cell_m: float) -> DataFrame:
    return labelled.groupBy("site_id", "component").agg(F.count("*").alias("n_cells"), (F.count("*") * cell_m**2).alias("area_m2"))


def nearest_component(labelled: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """site_id, id, component and d2 (squared cells) of the component nearest to each point (site_id, id, row, col) within
    ``radius`` cells, of ties the smaller; null if none. Cells carry row and col."""
    span = lambda x: F.explode(F.sequence(F.col(x) - radius, F.col(x) + radius))
    around = points.withColumn("r", span("row")).withColumn("c", span("col"))
    d2 = F.pow(F.col("r") - F.col("row"), 2) + F.pow(F.col("c") - F.col("col"), 2)
    around = around.withColumn("d2", d2.cast("int")).filter(F.col("d2") <= radius * radius).select("site_id", "id", F.col("r").alias("row"), F.col("c").alias("col"), "d2")
    best = around.join(labelled.select("site_id", "row", "col", "component"), ["site_id", "row", "col"]).groupBy("site_id", "id").agg(F.min(F.struct("d2", "component")).alias("b"))
    return points.select("site_id", "id").join(best, ["site_id", "id"], "left").select("site_id", "id", F.col("b.component").alias("component"), F.col("b.d2").alias("d2"))


def fill_voids(cells: DataFrame, radius: float, cell_m: float) -> DataFrame:
    """Null heights from the valid cells within ``radius``, weighted by 1 / d**2; null if there are none."""
    at = lambda d, x, y: d.withColumn(x, F.col("col") * cell_m + F.col("site_id") * 1e7).withColumn(y, F.col("row") * cell_m)
    void = at(cells.filter("z is null"), "x_m", "y_m").select("site_id", F.col("cell_id").alias("osm_id"), "x_m", "y_m")
    valid = at(cells.filter("z is not null"), "cx", "cy").select("cell_id", "z", "cx", "cy")
    got = within_radius(void, valid, radius).groupBy("site_id", F.col("osm_id").alias("cell_id")).agg((F.sum(F.col("z") / (F.col("d") * F.col("d"))) / F.sum(1 / (F.col("d") * F.col("d")))).alias("filled_z"))
    return cells.join(got, ["site_id", "cell_id"], "left").withColumn("z", F.coalesce("z", "filled_z")).drop("filled_z")


def burn_crest(cells: DataFrame, dams: DataFrame, most: int) -> DataFrame:
    """Raise the cells across the valley at a dam (dam_id, site_id, row, col, dr, dc, crest) to its crest, both ways until the
    first cell that is as high, each dam by itself; cells are never lowered and get the highest of several crests."""
    step = F.explode(F.expr(f"filter(sequence(-{most}, {most}), k -> true)"))
    line = dams.withColumn("k", step).withColumn("row", F.col("row") + F.col("k") * F.col("dr")).withColumn("col", F.col("col") + F.col("k") * F.col("dc"))
    got = line.join(cells.select("site_id", "row", "col", "cell_id", "z"), ["site_id", "row", "col"])
    wall = got.groupBy("site_id", "dam_id").agg(F.min(F.when((F.col("k") >= 0) & (F.col("z") >= F.col("crest")), F.col("k"))).alias("right"), F.max(F.when((F.col("k") <= 0) & (F.col("z") >= F.col("crest")), F.col("k"))).alias("left"))
    inside = got.join(wall, ["site_id", "dam_id"]).filter("k < coalesce(right, k + 1) and k > coalesce(left, k - 1)").groupBy("site_id", "cell_id").agg(F.max("crest").alias("crest"))
    return cells.join(inside, ["site_id", "cell_id"], "left").withColumn("z", F.when(F.col("z").isNotNull(), F.greatest("z", F.coalesce("crest", "z")))).drop("crest")


def burn_reservoir(cells: DataFrame, label: str) -> DataFrame:
    """Labelled cells get their median height as water surface and the least as bed."""
    level = cells.filter(F.col(label).isNotNull()).groupBy("site_id", label).agg(F.percentile("z", 0.5).alias("surface"), F.min("z").alias("bed"))
    return cells.join(level, ["site_id", label], "left")
