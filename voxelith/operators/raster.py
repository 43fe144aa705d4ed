"""Rasters as relations: one row (x, z, h) for each column of the map."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelith.functions.geometry import bounds, convex_hull, coordinates, inside_convex, inside_even_odd


def to_chunks(cells: DataFrame) -> DataFrame:
    """chunks(cx, cz, h): 256 heights at z * 16 + x."""
    place = F.pmod("z", F.lit(16)) * 16 + F.pmod("x", F.lit(16))
    return cells.groupBy(F.shiftright("x", 4).alias("cx"), F.shiftright("z", 4).alias("cz")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), "h"))), lambda s: s["h"]).alias("h")
    )


def from_chunks(chunks: DataFrame) -> DataFrame:
    """cells(x, z, h) of chunks."""
    return chunks.select("cx", "cz", F.posexplode("h").alias("p", "h")).select(
        (F.col("cx") * 16 + F.col("p") % 16).cast("int").alias("x"),
        (F.col("cz") * 16 + F.expr("p div 16")).cast("int").alias("z"),
        "h",
    )


def assemble(chunks: DataFrame) -> DataFrame:
    """The dense map over the chunks' extent: cells of missing chunks have a null h and gap set.

    Of chunks with the same place that of the last path wins; without paths places must not repeat.
    """
    if "path" in chunks.columns:
        chunks = chunks.groupBy("cx", "cz").agg(F.max_by("h", "path").alias("h"))
    cells = from_chunks(chunks)
    box = chunks.agg(F.min("cx").alias("a"), F.max("cx").alias("b"), F.min("cz").alias("c"), F.max("cz").alias("d"))
    wanted = box.select(F.explode(F.sequence("a", "b")).alias("cx"), "c", "d").select("cx", F.explode(F.sequence("c", "d")).alias("cz"))
    missing = wanted.join(chunks.select("cx", "cz").distinct(), ["cx", "cz"], "left_anti")
    blank = missing.withColumn("h", F.array_repeat(F.lit(None).cast(cells.schema["h"].dataType), 256))
    return cells.withColumn("gap", F.lit(False)).unionByName(from_chunks(blank).withColumn("gap", F.lit(True)))


def with_water(cells: DataFrame, water: DataFrame) -> DataFrame:
    """Adds water from chunks(cx, cz, water); cells without are not water."""
    flags = from_chunks(water.withColumnRenamed("water", "h")).withColumnRenamed("h", "water")
    return cells.join(flags, ["x", "z"], "left").withColumn("water", F.coalesce("water", F.lit(False)))


def map_extent(cells: DataFrame) -> DataFrame:
    """Extent, size in blocks, and height range."""
    return cells.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"),
        (F.max("x") - F.min("x") + 1).alias("width"), (F.max("z") - F.min("z") + 1).alias("height"),
        F.min("h").alias("lo"), F.when(F.max("h") <= F.min("h"), F.min("h") + 1).otherwise(F.max("h")).alias("hi"),
    )


def sea_level(cells: DataFrame, share: float = 0.6) -> DataFrame:
    """sea_level and its count: the commonest whole height between the least and the share-quantile.

    Works on the histogram of heights, which is small whatever the map. The quantile is
    interpolated and cut to a whole number; of equally common heights the lowest wins.
    """
    counts = cells.where("h is not null").groupBy(F.col("h").cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rising = W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(rising)).withColumn("total", F.sum("n").over(W.partitionBy()))
    rank = F.lit(share) * (F.col("total") - 1)
    low = F.min(F.when(F.col("upto") > F.floor(rank), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.ceil(rank), F.col("v")))
    edges = ranked.agg(
        F.min("v").alias("lo"), (low + (high - low) * F.max(rank - F.floor(rank)) + F.lit(1e-9)).cast("int").alias("hi")
    )
    best = F.max(F.struct("n", (-F.col("v")).alias("v")))
    inside = counts.crossJoin(F.broadcast(edges)).where((F.col("v") >= F.col("lo")) & ((F.col("v") <= F.col("hi")) | (F.col("v") == F.col("lo"))))
    return inside.where((F.col("lo") < F.col("hi")) | (F.col("v") == F.col("lo"))).agg(best.alias("b")).select(
        (-F.col("b.v")).alias("sea_level"), F.col("b.n").alias("n_cells")
    )


def coverage(cells: DataFrame, flag: str) -> DataFrame:
    return cells.agg((F.avg(F.col(flag).cast("int")) * 100).alias("percent"))


def land_range(cells: DataFrame, sea: float | Column) -> DataFrame:
    """Least and largest height above sea level outside the ocean; 0 and 0 if there is none."""
    above = F.when(~F.col("ocean"), F.col("h") - sea)
    return cells.agg(F.coalesce(F.min(above), F.lit(0)).alias("lowest"), F.coalesce(F.max(above), F.lit(0)).alias("highest"))


def flatten_ocean(cells: DataFrame, level: float) -> DataFrame:
    return cells.withColumn("h", F.when(F.col("ocean"), F.lit(level)).otherwise(F.col("h")).cast(cells.schema["h"].dataType))


def erode(cells: DataFrame, flag: str, margin: int) -> DataFrame:
    """Keeps the flag where the whole square of 2 * margin + 1 around a cell has it; outside counts as unset."""
    full = 2 * margin + 1
    across = W.partitionBy("z").orderBy("x").rangeBetween(-margin, margin)
    down = W.partitionBy("x").orderBy("z").rangeBetween(-margin, margin)
    rows = cells.withColumn("__row", F.sum(F.col(flag).cast("int")).over(across) == full)
    return rows.withColumn(flag, F.sum(F.col("__row").cast("int")).over(down) == full).drop("__row")


def crop(cells: DataFrame, points: Sequence[Sequence[float]]) -> DataFrame:
    """The polygon's bounding box of the map; outside the polygon h is the least of the whole map.

    Adds inside. Boolean columns are unset outside. The least height comes from the map before
    the crop, so the box is not pushed below that aggregate.
    """
    points = coordinates(points)
    x0, x1, z0, z1 = bounds(points)
    least = cells.agg(F.min("h").alias("__least"))
    box = cells.where(F.col("x").between(x0, x1) & F.col("z").between(z0, z1))
    inside = inside_even_odd(F.col("x").cast("double"), F.col("z").cast("double"), points)
    out = box.crossJoin(F.broadcast(least)).withColumn("inside", inside)
    out = out.withColumn("h", F.when(F.col("inside"), F.col("h")).otherwise(F.col("__least"))).drop("__least")
    for f in cells.schema:
        if f.dataType.simpleString() == "boolean":
            out = out.withColumn(f.name, F.col(f.name) & F.col("inside"))
    return out


def prune_regions(regions: DataFrame, points: Sequence[Sequence[float]]) -> DataFrame:
    """Region files (rx, rz) of 512 x 512 blocks that meet the polygon's bounding box."""
    x0, x1, z0, z1 = bounds(coordinates(points))
    return regions.where(
        (F.col("rx") * 512 + 511 >= x0) & (F.col("rx") * 512 <= x1) & (F.col("rz") * 512 + 511 >= z0) & (F.col("rz") * 512 <= z1)
    )


def _masks(cells: DataFrame, polygons: Sequence, exact: bool) -> list[Column]:
    masks = []
    for polygon in polygons:
        points = coordinates(polygon)
        corners = convex_hull(points)
        if len(points) < 3 or len(corners) < 3:
            continue
        x, z = F.col("x").cast("double"), F.col("z").cast("double")
        # The box reaches from the whole part of the least to that of the largest coordinate.
        xs, zs = [p[0] for p in points], [p[1] for p in points]
        box = F.col("x").between(int(min(xs)), int(max(xs))) & F.col("z").between(int(min(zs)), int(max(zs)))
        masks.append(box & (inside_even_odd(x, z, points) if exact else inside_convex(x, z, corners)))
    return masks


def mask_polygons(cells: DataFrame, polygons: Sequence, level: float, exact: bool = False) -> DataFrame:
    """Cells in the convex hull of a polygon become ocean at the level; exact uses the polygon itself."""
    hit = F.lit(False)
    for mask in _masks(cells, polygons, exact):
        hit = hit | mask
    ocean = F.col("ocean") if "ocean" in cells.columns else F.lit(False)
    kind = cells.schema["h"].dataType
    return cells.withColumn("ocean", ocean | hit).withColumn("h", F.when(hit, F.lit(level)).otherwise(F.col("h")).cast(kind))


def masked_total(cells: DataFrame, polygons: Sequence, exact: bool = False) -> DataFrame:
    """Cells masked, added up over the polygons, so that overlaps count more than once."""
    total = F.lit(0)
    for mask in _masks(cells, polygons, exact):
        total = total + mask.cast("int")
    return cells.agg(F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("masked"))


def fill_gaps(cells: DataFrame) -> DataFrame:
    """Gaps take the height of the nearest cell that has one; of equally near ones the least z, then x.

    First every column finds its nearest heights above and below with window functions; then
    each row of the map combines the columns with array code.
    """
    column = W.partitionBy("x").orderBy("z")
    spot = F.when(F.col("h").isNotNull(), F.struct("z", "h"))
    near = cells.withColumn("up", F.last(spot, True).over(column.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "down", F.first(spot, True).over(column.rowsBetween(0, W.unboundedFollowing))
    )
    holes = near.where("h is null").select("z").distinct()
    kind = cells.schema["h"].dataType.simpleString()

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        z = int(frame["z"].iloc[0])
        spots = [(s["x"], s["d2"], s["fz"], s["fh"]) for s in frame["s"].iloc[0]]
        x = np.array([s[0] for s in spots], dtype=np.int64)
        d2 = np.array([s[1] for s in spots], dtype=np.int64)
        fz = np.array([s[2] for s in spots], dtype=np.int64)
        fh = np.array([s[3] for s in spots])
        out = []
        for at in frame["m"].iloc[0]:
            far = (x - at) ** 2 + d2
            best = np.lexsort((x, fz, far))[0]
            out.append((at, z, fh[best]))
        return pd.DataFrame(out, columns=["x", "z", "filled"])

    def found(side: str) -> Column:
        return F.struct("x", ((F.col(f"{side}.z") - F.col("z")).cast("long") ** 2).cast("long").alias("d2"), F.col(f"{side}.z").alias("fz"), F.col(f"{side}.h").alias("fh"))

    spots = near.join(F.broadcast(holes), "z").groupBy("z").agg(
        F.concat(
            F.collect_list(F.when(F.col("up").isNotNull(), found("up"))),
            F.collect_list(F.when(F.col("down").isNotNull() & F.col("h").isNull(), found("down"))),
        ).alias("s"),
        F.collect_list(F.when(F.col("h").isNull(), F.col("x"))).alias("m"),
    )
    filled = spots.groupBy("z").applyInPandas(fill, f"x int, z int, filled {kind}")
    return cells.join(filled, ["x", "z"], "left").withColumn("h", F.coalesce("h", "filled")).drop("filled")

