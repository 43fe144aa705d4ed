"""From heights to pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.functions.colors import alpha, elevation_rgb, gray
from voxelith.operators.stencils import gaussian, image_shape, median3, resample_linear, resample_nearest


def render(
    cells: DataFrame, width: int, height: int, sea_level: float = 0.0, max_width: int = 4096, max_height: int = 4096,
    sigma: float = 1.5, transparent: bool = False,
) -> tuple[DataFrame, int, int]:
    """pixels(px, py, r, g, b, gray, a) of a dense map (x, z from 0, h, ocean and, if transparent, inside).

    Median at full resolution, then resampling, then the blur, then the colours; the colours
    span the heights of the map as it came in.
    """
    out_width, out_height = image_shape(width, height, max_width, max_height)
    span = cells.agg(F.min("h").cast("double").alias("lo"), F.max("h").cast("double").alias("hi")).select(
        "lo", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).alias("hi")
    )
    smooth = median3(cells.select("x", "z", F.col("h").cast("double").alias("h")))
    flags = ["ocean"] + ["inside"] * transparent
    marks = cells.select("x", "z", *flags)
    if (out_width, out_height) != (width, height):
        smooth = resample_linear(smooth, width, height, out_width, out_height)
        marks = resample_nearest(marks, width, height, out_width, out_height, *flags)
    if sigma * out_width / width > 0.1:
        smooth = gaussian(smooth, sigma * out_width / width)
    pixels = smooth.join(marks, ["x", "z"]).crossJoin(F.broadcast(span))
    rgb = elevation_rgb(F.col("h"), F.col("ocean"), F.col("lo"), F.col("hi"), F.lit(float(sea_level)))
    shade = gray(F.col("h"), F.col("ocean"), F.col("lo"), F.col("hi"))
    out = pixels.select(
        F.col("x").alias("px"), F.col("z").alias("py"), rgb.alias("c"), shade.alias("gray"),
        (alpha(F.col("inside")) if transparent else F.lit(255)).alias("a"),
    ).select("px", "py", "c.r", "c.g", "c.b", "gray", "a")
    return out, out_width, out_height
