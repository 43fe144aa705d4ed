"""Terrain and voxels derived from ordinary Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """x and z of every cell of a width x height map."""
    return spark.range(width * height).select(
        (F.col("id") % width).cast("int").alias("x"), F.expr(f"cast(id div {width} as int)").alias("z")
    )


def terrain(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """cells(x, z, h, gap): a cone-shaped island with noise from lineitem.

    The noise of a cell is the least quantity of its order lines; cells without any are gaps.
    """
    half = size // 2
    noise = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy((F.col("l_orderkey") % size).cast("int").alias("x"), (F.col("l_partkey") % size).cast("int").alias("z"))
        .agg(F.min(F.col("l_quantity").cast("int")).alias("q"))
    )
    slope = F.expr(f"(abs(x - {half}) + abs(z - {half})) * 32 div {half} div 2")
    return grid(spark, size, size).join(noise, ["x", "z"], "left").select(
        "x", "z", (76 - slope + F.coalesce("q", F.lit(0)) % 8).cast("int").alias("h"), F.col("q").isNull().alias("gap")
    )


TERRAIN_SQL = """
WITH b AS (
  SELECT CAST(l_orderkey % 64 AS INT) x, CAST(l_partkey % 64 AS INT) z, min(CAST(l_quantity AS INT)) q
  FROM lineitem GROUP BY 1, 2
), g AS (
  SELECT CAST(a.range AS INT) x, CAST(b.range AS INT) z FROM range(64) a CROSS JOIN range(64) b
), terrain AS (
  SELECT g.x, g.z, CAST(76 - ((abs(g.x - 32) + abs(g.z - 32)) // 2) + coalesce(q, 0) % 8 AS INT) h, q IS NULL gap
  FROM g LEFT JOIN b USING (x, z)
)"""

#: The block that stands for each line number.
BLOCKS = (
    "minecraft:stone", "minecraft:dirt", "minecraft:grass_block", "minecraft:oak_log", "minecraft:oak_leaves",
    "minecraft:water", "minecraft:air",
)


def voxels(spark: SparkSession, sf_dir: str, size: int = 32) -> DataFrame:
    """blocks(x, y, z, name) from lineitem."""
    names = F.array(*[F.lit(b) for b in BLOCKS])
    return (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy(
            (F.col("l_orderkey") % size).cast("int").alias("x"),
            (F.col("l_quantity").cast("int") - 1).alias("y"),
            (F.col("l_partkey") % size).cast("int").alias("z"),
        )
        .agg(F.min("l_linenumber").alias("n"))
        .select("x", "y", "z", F.element_at(names, F.col("n").cast("int")).alias("name"))
    )


VOXEL_SQL = f"""
WITH RECURSIVE voxels AS (
  SELECT x, y, z, list_extract([{", ".join(f"'{b}'" for b in BLOCKS)}], n) AS name FROM (
    SELECT CAST(l_orderkey % 32 AS INT) x, CAST(l_quantity AS INT) - 1 y, CAST(l_partkey % 32 AS INT) z,
      min(l_linenumber) n
    FROM lineitem GROUP BY 1, 2, 3)
)"""
