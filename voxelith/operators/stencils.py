"""Neighbourhood operators on dense rasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelith.sources.tables import grid

#: Lines of the map that one call of a line kernel gets.
BAND = 64


def median3(cells: DataFrame) -> DataFrame:
    """The median of the 3 x 3 neighbourhood; the map's edge repeats outwards."""
    down = W.partitionBy("x").orderBy("z")
    across = W.partitionBy("z").orderBy("x")
    column = F.array(F.coalesce(F.lag("h").over(down), F.col("h")), F.col("h"), F.coalesce(F.lead("h").over(down), F.col("h")))
    stacked = cells.withColumn("__c", column)
    nine = F.concat(
        F.coalesce(F.lag("__c").over(across), F.col("__c")), F.col("__c"), F.coalesce(F.lead("__c").over(across), F.col("__c"))
    )
    return stacked.withColumn("h", F.sort_array(nine)[4]).drop("__c")


def dilate(cells: DataFrame, flag: str) -> DataFrame:
    """Sets the flag where a cell or one of its four neighbours has it."""
    down, across = W.partitionBy("x").orderBy("z"), W.partitionBy("z").orderBy("x")
    parts: list[Column] = [F.col(flag)]
    for window in (down, across):
        parts += [F.coalesce(F.lag(flag).over(window), F.lit(False)), F.coalesce(F.lead(flag).over(window), F.lit(False))]
    hit = parts[0]
    for part in parts[1:]:
        hit = hit | part
    return cells.withColumn(flag, hit)


def gaussian_weights(sigma: float) -> np.ndarray:
    """Weights of offsets -r to r, r = int(4 * sigma + 0.5), with sum 1."""
    radius = int(4.0 * sigma + 0.5)
    at = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (at / sigma) ** 2)
    return w / w.sum()


def _blur_lines(cells: DataFrame, line: str, along: str, weights: np.ndarray) -> DataFrame:
    radius = len(weights) // 2

    def blur(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([line, along], kind="stable")
        lines = frame[line].nunique()
        values = frame["h"].to_numpy(dtype=np.float64).reshape(lines, -1)
        # Edges mirror with the edge cell repeated, as often as the radius asks for.
        padded = np.pad(values, ((0, 0), (radius, radius)), mode="symmetric")
        out = sum(w * padded[:, i : i + values.shape[1]] for i, w in enumerate(weights))
        return frame.assign(h=out.ravel())[["x", "z", "h"]]

    banded = cells.select("x", "z", F.col("h").cast("double").alias("h"), F.expr(f"floor({line} / {BAND})").alias("band"))
    return banded.groupBy("band").applyInPandas(blur, "x int, z int, h double")


def gaussian(cells: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian blur of a dense map (x, z, h); sigma 0 leaves it as it is."""
    if sigma <= 0 or int(4.0 * sigma + 0.5) == 0:
        return cells.select("x", "z", F.col("h").cast("double").alias("h"))
    weights = gaussian_weights(sigma)
    return _blur_lines(_blur_lines(cells, "x", "z", weights), "z", "x", weights)


def _source(out: Column, n_in: int, n_out: int) -> Column:
    """Where an output index lies on the input axis; first and last fall on first and last."""
    return out * F.lit((n_in - 1) / (n_out - 1)) if n_out > 1 else F.lit(0.0) * out


def resample_linear(cells: DataFrame, width: int, height: int, out_width: int, out_height: int) -> DataFrame:
    """Bilinear resampling of a map with x and z from 0 to (x, z, h) of the new size."""
    out = grid(cells.sparkSession, out_width, out_height)
    fx, fz = _source(F.col("x"), width, out_width), _source(F.col("z"), height, out_height)
    out = out.withColumns({"__fx": fx, "__fz": fz}).withColumns(
        {"__x": F.least(F.floor("__fx"), F.lit(max(0, width - 2))).cast("int"), "__z": F.least(F.floor("__fz"), F.lit(max(0, height - 2))).cast("int")}
    )
    parts = []
    for dx in (0, 1):
        for dz in (0, 1):
            wx = F.col("__fx") - F.col("__x") if dx else 1 - (F.col("__fx") - F.col("__x"))
            wz = F.col("__fz") - F.col("__z") if dz else 1 - (F.col("__fz") - F.col("__z"))
            parts.append(F.struct((F.col("__x") + dx).alias("sx"), (F.col("__z") + dz).alias("sz"), (wx * wz).alias("w")))
    taps = out.select("x", "z", F.explode(F.array(*parts)).alias("t")).where("t.w <> 0").select("x", "z", "t.sx", "t.sz", "t.w")
    source = cells.select(F.col("x").alias("sx"), F.col("z").alias("sz"), F.col("h").cast("double").alias("h"))
    return taps.join(source, ["sx", "sz"]).groupBy("x", "z").agg(F.sum(F.col("w") * F.col("h")).alias("h"))


def resample_nearest(cells: DataFrame, width: int, height: int, out_width: int, out_height: int, *columns: str) -> DataFrame:
    """Nearest resampling of the columns; halves go up."""
    out = grid(cells.sparkSession, out_width, out_height)
    picked = out.select(
        "x", "z",
        F.floor(_source(F.col("x"), width, out_width) + 0.5).cast("int").alias("sx"),
        F.floor(_source(F.col("z"), height, out_height) + 0.5).cast("int").alias("sz"),
    )
    source = cells.select(F.col("x").alias("sx"), F.col("z").alias("sz"), *columns)
    return picked.join(source, ["sx", "sz"]).drop("sx", "sz")


def downsample_shape(width: int, height: int, longest: int) -> tuple[int, int]:
    """The size at which the longer side has the given number of vertices, two at least."""
    if max(width, height) <= longest:
        return width, height
    factor = longest / max(width, height)
    return max(2, round(width * factor)), max(2, round(height * factor))


def downsample(cells: DataFrame, width: int, height: int, longest: int) -> tuple[DataFrame, int, int]:
    """Blurs against aliasing and resamples to downsample_shape; a small map stays as it is."""
    out_width, out_height = downsample_shape(width, height, longest)
    if (out_width, out_height) == (width, height):
        return cells.select("x", "z", F.col("h").cast("double").alias("h")), width, height
    blurred = gaussian(cells, 0.5 * max(width, height) / longest)
    return resample_linear(blurred, width, height, out_width, out_height), out_width, out_height


def image_shape(width: int, height: int, max_width: int, max_height: int) -> tuple[int, int]:
    """Pixels of the image: the map's size if either limit is 0, else the largest that fits both."""
    if max_width <= 0 or max_height <= 0:
        return width, height
    scale = min(max_width / width, max_height / height)
    return max(1, round(width * scale)), max(1, round(height * scale))

