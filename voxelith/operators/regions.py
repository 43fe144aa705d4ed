"""Connected regions of a raster, and the masks that follow from them.

Cells are labelled inside square tiles with array code, one task for each tile; only labels
that meet at tile borders enter the iterative part, so its size follows the borders, not the
area. A region's label is its least cell, ordered by z and then x.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.operators.graph import components
from voxelith.sources.storage import settle

TILE = 256
#: Labels are z * SPAN + x + OFFSET for coordinates of either sign.
SPAN = 1 << 31
OFFSET = 1 << 30


def label_grid(mask: np.ndarray) -> np.ndarray:
    """4-neighbour labels of a boolean array: the flat index of each region's first cell, -1 outside.

    Works on runs along rows; runs of adjacent rows that overlap are joined by taking minima
    until nothing changes, with pointers followed in between.
    """
    rows, cols = mask.shape
    padded = np.zeros((rows, cols + 2), dtype=np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    r, start = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    out = np.full((rows, cols), -1, dtype=np.int64)
    if not len(r):
        return out
    # Runs are in row order, so the runs of the next row that overlap [start, stop) are contiguous.
    wide = cols + 1
    first = np.searchsorted(r * wide + stop, (r + 1) * wide + start, side="right")
    last = np.searchsorted(r * wide + start, (r + 1) * wide + stop, side="left")
    count = np.maximum(last - first, 0)
    upper = np.repeat(np.arange(len(r)), count)
    lower = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    root = np.arange(len(r))
    while True:
        a, b = root[upper], root[lower]
        low = np.minimum(a, b)
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    names = (r * cols + start)[root]
    length = stop - start
    flat = np.repeat(r * cols + start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out.ravel()[flat] = np.repeat(names, length)
    return out


def cell_id(x: Column, z: Column) -> Column:
    return (z.cast("long") + OFFSET) * F.lit(SPAN) + x.cast("long") + OFFSET


def label_regions(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """x, z and region of the cells given; each is part of a region."""
    placed = cells.select("x", "z", F.expr(f"floor(x / {tile})").alias("tx"), F.expr(f"floor(z / {tile})").alias("tz"))

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        x, z = frame["x"].to_numpy(), frame["z"].to_numpy()
        x0, z0 = x.min(), z.min()
        mask = np.zeros((z.max() - z0 + 1, x.max() - x0 + 1), dtype=bool)
        mask[z - z0, x - x0] = True
        flat = label_grid(mask)[z - z0, x - x0]
        lz, lx = np.divmod(flat, mask.shape[1])
        ids = (lz + z0 + OFFSET).astype(np.int64) * SPAN + lx + x0 + OFFSET
        return pd.DataFrame({"x": x, "z": z, "local": ids})

    labelled = settle(placed.groupBy("tx", "tz").applyInPandas(label, "x int, z int, local long"), "labels")
    right = labelled.where(F.pmod("x", F.lit(tile)) == tile - 1).select((F.col("x") + 1).alias("x"), "z", F.col("local").alias("a"))
    down = labelled.where(F.pmod("z", F.lit(tile)) == tile - 1).select("x", (F.col("z") + 1).alias("z"), F.col("local").alias("a"))
    edges = right.unionByName(down).join(labelled, ["x", "z"]).select("a", F.col("local").alias("b"))
    roots = components(edges)
    return labelled.join(roots, labelled.local == roots.node, "left").select("x", "z", F.coalesce("root", "local").alias("region"))


def extent(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1")
    )


def region_sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region").agg(F.count(F.lit(1)).alias("n_cells"))


def ocean_mask(
    cells: DataFrame, sea_level: int | Column, min_ocean: int = 500_000, water: bool = False, tile: int = TILE
) -> DataFrame:
    """Adds ocean: cells at or below sea level in regions that touch the map's border or have
    min_ocean cells or more (0: border only). With water, cells must also be water."""
    level = F.lit(sea_level) if isinstance(sea_level, (int, float)) else sea_level
    low = F.col("h") <= level
    if water:
        low = low & F.coalesce("water", F.lit(False))
    regions = settle(label_regions(cells.where(low).select("x", "z"), tile), "sea")
    edge = extent(cells)
    touching = (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1")) | (F.col("z") == F.col("z0")) | (F.col("z") == F.col("z1"))
    facts = regions.crossJoin(F.broadcast(edge)).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max(touching).alias("border"))
    chosen = facts.where(F.col("border") | (F.col("n") >= min_ocean) if min_ocean > 0 else F.col("border"))
    marked = regions.join(chosen.select("region"), "region", "left_semi").select("x", "z", F.lit(True).alias("ocean"))
    return cells.drop("ocean").join(marked, ["x", "z"], "left").withColumn("ocean", F.coalesce("ocean", F.lit(False)))


def remove_small_islands(cells: DataFrame, min_land: int, tile: int = TILE) -> DataFrame:
    """Land regions of fewer than min_land cells become ocean."""
    regions = settle(label_regions(cells.where("not ocean").select("x", "z"), tile), "land")
    small = region_sizes(regions).where(F.col("n_cells") < min_land).select("region")
    sunk = regions.join(small, "region", "left_semi").select("x", "z", F.lit(True).alias("__sunk"))
    return cells.join(sunk, ["x", "z"], "left").withColumn("ocean", F.col("ocean") | F.coalesce("__sunk", F.lit(False))).drop("__sunk")


def remove_floating(cells: DataFrame, drop: int = 100, tile: int = TILE) -> DataFrame:
    """High clusters that stand more than drop above all their neighbours sink to the highest of them."""
    top = cells.agg(F.max(F.col("h")).cast("int").alias("__top"))
    high = cells.crossJoin(F.broadcast(top)).where(F.col("h") >= F.col("__top") - drop)
    regions = settle(label_regions(high.select("x", "z"), tile), "high")
    held = regions.join(cells.select("x", "z", "h"), ["x", "z"])
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dz")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    around = held.select("region", "x", "z", steps.alias("d")).select(
        "region", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("z") + F.col("d.dz")).alias("z")
    ).distinct()
    other = regions.withColumnRenamed("region", "own")
    border = around.join(other, ["x", "z"], "left").where("own is null or own <> region").join(cells.select("x", "z", "h"), ["x", "z"])
    rims = border.groupBy("region").agg(F.max("h").alias("rim"))
    lows = held.groupBy("region").agg(F.min(F.col("h").cast("int")).alias("low"))
    sunk = lows.join(rims, "region").where(F.col("low") - F.col("rim").cast("int") > drop).select("region", F.col("rim").cast("int").alias("rim"))
    moved = regions.join(sunk, "region").select("x", "z", "rim")
    return cells.join(moved, ["x", "z"], "left").withColumn("h", F.coalesce(F.col("rim").cast(cells.schema["h"].dataType), "h")).drop("rim")


def grounded(blocks: DataFrame, floor: int | None = None) -> DataFrame:
    """Adds grounded to solid blocks (x, y, z) of each 16 x 16 chunk.

    Grounded are regions of 6-neighbours with a block in the chunk's lowest 16 levels, counted
    from floor or the section of the chunk's lowest block; if none has, those on the lowest level
    with a block.
    """
    chunks = blocks.withColumns({"cx": F.shiftright("x", 4), "cz": F.shiftright("z", 4)})
    base = floor

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        x, y, z = frame["x"].to_numpy() & 15, frame["y"].to_numpy(), frame["z"].to_numpy() & 15
        low = (y.min() // 16) * 16 if base is None else base
        height = int(y.max() - low + 1)
        solid = np.zeros((height, 16, 16), dtype=bool)
        solid[y - low, z, x] = True
        label = label_voxels(solid)
        seeds = np.unique(label[:16][solid[:16]])
        if not len(seeds):
            seeds = np.unique(label[(y - low).min()][solid[(y - low).min()]])
        return frame.assign(grounded=np.isin(label[y - low, z, x], seeds))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema) + ", grounded boolean"
    return chunks.groupBy("cx", "cz").applyInPandas(mark, schema).drop("cx", "cz")


def label_voxels(solid: np.ndarray) -> np.ndarray:
    """6-neighbour labels of a boolean array with three axes; -1 outside."""
    flat = np.arange(solid.size).reshape(solid.shape)
    a, b = [], []
    for axis in range(3):
        one = tuple(slice(None, -1) if k == axis else slice(None) for k in range(3))
        two = tuple(slice(1, None) if k == axis else slice(None) for k in range(3))
        both = solid[one] & solid[two]
        a.append(flat[one][both])
        b.append(flat[two][both])
    a, b = np.concatenate(a), np.concatenate(b)
    root = flat.ravel().copy()
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    return np.where(solid, root.reshape(solid.shape), -1)
