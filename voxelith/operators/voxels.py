"""Surfaces of block columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.functions.blocks import is_air, is_no_ground, is_water
from voxelith.operators.regions import grounded


def surface(blocks: DataFrame, ground_only: bool = False) -> DataFrame:
    """x, z and h, the level above the highest block that counts; 0 for columns without one."""
    skip = is_no_ground(F.col("name")) if ground_only else is_air(F.col("name"))
    top = F.max(F.when(~skip, F.col("y"))) + 1
    return blocks.groupBy("x", "z").agg(F.coalesce(top, F.lit(0)).cast("int").alias("h"))


def grounded_surface(blocks: DataFrame, ground_only: bool = False, floor: int | None = None) -> DataFrame:
    """The same over blocks that reach the chunk's floor; columns without one lie on the floor."""
    skip = is_no_ground(F.col("name")) if ground_only else is_air(F.col("name"))
    solid = grounded(blocks.where(~skip).select("x", "y", "z"), floor)
    tops = solid.where("grounded").groupBy("x", "z").agg((F.max("y") + 1).cast("int").alias("h"))
    chunk = [F.shiftright("x", 4).alias("cx"), F.shiftright("z", 4).alias("cz")]
    base = F.lit(floor) if floor is not None else F.floor(F.min("y") / 16) * 16
    floors = blocks.groupBy(*chunk).agg(base.cast("int").alias("base"))
    columns = blocks.select("x", "z", *chunk).distinct().join(floors, ["cx", "cz"]).join(tops, ["x", "z"], "left")
    return columns.select("x", "z", F.coalesce("h", "base").alias("h"))


def surface_water(blocks: DataFrame, heights: DataFrame) -> DataFrame:
    """x, z, h and water: whether the block right below the surface is water."""
    tops = blocks.select("x", "z", (F.col("y") + 1).alias("h"), is_water(F.col("name")).alias("water"))
    return heights.join(tops, ["x", "z", "h"], "left").withColumn("water", F.coalesce("water", F.lit(False)))
