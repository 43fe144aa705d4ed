"""World saves: which kind a folder holds, where its regions lie, and reading them as a map."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions.geometry import bounds, coordinates
from voxelith.operators import raster
from voxelith.sources import anvil, bedrock
from voxelith.sources.anvil import ScanOptions

# Where region files may lie under a save.
REGION_FOLDERS = ("region", "dimensions/minecraft/overworld/region", "DIM0/region", "world/region")


def _names(folder: str) -> list[str]:
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def detect_format(save: str) -> str:
    """"java" if a region folder has region files, "bedrock" if db/ has tables; else FileNotFoundError."""
    if any(anvil.region_place(n) for f in REGION_FOLDERS for n in _names(os.path.join(save, f))):
        return "java"
    if any(n == "MANIFEST" or n.endswith(".ldb") for n in _names(os.path.join(save, "db"))):
        return "bedrock"
    raise FileNotFoundError(f"no world save in {save}")


def region_folder(save: str) -> str:
    for folder in REGION_FOLDERS:
        if os.path.isdir(os.path.join(save, folder)):
            return os.path.join(save, folder)
    raise FileNotFoundError(f"no region folder in {save}")


@dataclass(frozen=True)
class WorldOptions:
    scan: ScanOptions = field(default_factory=ScanOptions)
    crop: Sequence[Sequence[float]] | None = None


def read_chunks(spark: SparkSession, save: str, options: WorldOptions = WorldOptions()) -> DataFrame:
    """chunks of a save; with a crop only region files that meet its bounding box are read."""
    if detect_format(save) == "bedrock":
        chunks = bedrock.decode_records(bedrock.open_database(spark, os.path.join(save, "db")))
        if options.crop is not None:
            x0, x1, z0, z1 = bounds(coordinates(options.crop))
            chunks = chunks.where(F.shiftright("cx", 5).between(x0 >> 9, x1 >> 9) & F.shiftright("cz", 5).between(z0 >> 9, z1 >> 9))
        return chunks
    folder = region_folder(save)
    if options.crop is None:
        return anvil.decode_regions(anvil.region_files(spark, folder), options.scan)
    x0, x1, z0, z1 = bounds(coordinates(options.crop))
    kept = []
    for name in _names(folder):
        place = anvil.region_place(name)
        if place and place[0] * 512 + 511 >= x0 and place[0] * 512 <= x1 and place[1] * 512 + 511 >= z0 and place[1] * 512 <= z1:
            kept.append(os.path.join(folder, name))
    if not kept:
        raise ValueError("the crop area meets no region file")
    files = spark.read.format("binaryFile").load(kept)
    return anvil.decode_regions(files, options.scan)


def read_world(spark: SparkSession, save: str, options: WorldOptions = WorldOptions()) -> DataFrame:
    """cells(x, z, h, gap, water, inside) of a save, always with these columns.

    Gaps of missing chunks are filled from the nearest cells. x and z are block coordinates.
    """
    chunks = read_chunks(spark, save, options)
    cells = raster.assemble(chunks.select("cx", "cz", "h", *[c for c in chunks.columns if c == "path"]))
    filled = raster.fill_gaps(cells)
    if "water" in chunks.columns:
        filled = raster.with_water(filled, chunks.select("cx", "cz", "water"))
    else:
        filled = filled.withColumn("water", F.lit(None).cast("boolean"))
    if options.crop is not None:
        filled = raster.crop(filled, options.crop)
    else:
        filled = filled.withColumn("inside", F.lit(True))
    return filled.select("x", "z", "h", "gap", "water", "inside")


def diagnose(spark: SparkSession, save: str, regions: int = 2, chunks: int = 3) -> DataFrame:
    """The first chunks of the first regions: path, cx, cz, version, status, keys and height ranges."""
    if detect_format(save) == "bedrock":
        found = bedrock.decode_records(bedrock.open_database(spark, os.path.join(save, "db"))).limit(regions * chunks)
        mean = F.aggregate("h", F.lit(0).cast("long"), lambda t, v: t + v) / 256
        return found.select("cx", "cz", F.array_min("h").alias("lo"), F.array_max("h").alias("hi"), mean.alias("mean"))
    folder = region_folder(save)
    paths = [os.path.join(folder, n) for n in _names(folder) if anvil.region_place(n)][:regions]
    schema = (
        "path string, cx int, cz int, data_version int, status string, keys array<string>, "
        "surface_lo int, surface_hi int, ground_lo int, ground_hi int"
    )

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rx, rz = anvil.region_place(path)
                for i, (lx, lz, root) in enumerate(anvil.chunk_records(bytes(content))):
                    if i == chunks:
                        break
                    chunk = root.get("Level", root)
                    spans = []
                    for ground in (False, True):
                        h = anvil.heights(root, ScanOptions(ground_only=ground))
                        spans += [int(h.min()), int(h.max())] if h is not None else [None, None]
                    rows.append((path, rx * 32 + lx, rz * 32 + lz, root.get("DataVersion"), str(chunk.get("Status", "")), sorted(chunk), *spans))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, schema)
