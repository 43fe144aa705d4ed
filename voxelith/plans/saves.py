"""Queries over save files: tables are encoded as files, and what is read back is held against SQL.

Heights and blocks come from whole tables, as in the registry. Regions lie on both sides of zero, chunks
are compressed in every known way, some are damaged, and sections use each of the three encodings.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.bits import palette_bits
from voxelith.functions.blocks import NO_GROUND
from voxelith.operators import raster
from voxelith.plans import registry
from voxelith.plans.registry import query
from voxelith.sources import anvil, bedrock, nbt, sinks
from voxelith.sources.anvil import ScanOptions
from voxelith.sources.tables import BLOCKS, TERRAIN_SQL, VOXEL_SQL
from voxelith.sources.tables import voxels as voxel_table

TAGS = "cx int, cz int, tags binary, compression int"
#: Levels below zero at which the block tables start: two sections.
DEPTH = 32


def _chunks(spark, sf_dir) -> DataFrame:
    """chunks(cx, cz, h) of the terrain, moved so that it lies in four regions."""
    moved = registry.terrain(spark, sf_dir, 64).select((F.col("x") - 32).alias("x"), (F.col("z") - 32).alias("z"), "h")
    return raster.to_chunks(moved)


def _height_tags(chunks: DataFrame, maps: dict[str, int], legacy: bool = False) -> DataFrame:
    """Chunk tags with stored height maps, each so much above h; every other chunk packs them as one stream of bits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for cx, cz, h in zip(frame["cx"], frame["cz"], frame["h"], strict=True):
                h = np.asarray(h, dtype=np.int64)
                if legacy:
                    root = {"Level": {"xPos": int(cx), "HeightMap": h.astype(np.int32)}}
                else:
                    root = {"Status": "full", "Heightmaps": {n: anvil.pack_longs(h + up, 9, (cx + cz) % 2 == 0) for n, up in maps.items()}}
                out.append((cx, cz, nbt.dump(root)))
            yield pd.DataFrame(out, columns=["cx", "cz", "tags"])

    tags = chunks.select("cx", "cz", "h").mapInPandas(run, "cx int, cz int, tags binary")
    damaged = (F.col("cx") * 3 + F.col("cz")) % 5 == 0
    return tags.withColumn("compression", F.when(damaged, 9).otherwise(F.pmod(F.col("cx") + 2 * F.col("cz"), F.lit(3)) + 1).cast("int"))


_MOVED = "SELECT x - 32 AS x, z - 32 AS z, {h} FROM terrain WHERE ((x // 16 - 2) * 3 + (z // 16 - 2)) % 5 <> 0"


@query(TERRAIN_SQL + _MOVED.format(h="h"))
def region_scan_stored(spark, sf_dir):
    files = anvil.encode_regions(_height_tags(_chunks(spark, sf_dir), {"WORLD_SURFACE": 0}))
    return raster.from_chunks(anvil.decode_regions(files))


@query(TERRAIN_SQL + " " + " UNION ALL ".join(_MOVED.format(h=f"'{m}' AS kind, h + {up} AS h") for m, up in (("surface", 9), ("ground", 3))))
def region_scan_preferences(spark, sf_dir):
    files = anvil.encode_regions(
        _height_tags(_chunks(spark, sf_dir), {"MOTION_BLOCKING": 2, "MOTION_BLOCKING_NO_LEAVES": 1, "WORLD_SURFACE_WG": 5, "WORLD_SURFACE": 7})
    )
    surface = raster.from_chunks(anvil.decode_regions(files, ScanOptions(y_offset=2))).withColumn("kind", F.lit("surface"))
    ground = raster.from_chunks(anvil.decode_regions(files, ScanOptions(ground_only=True, y_offset=2))).withColumn("kind", F.lit("ground"))
    return surface.unionByName(ground)


@query(TERRAIN_SQL + _MOVED.format(h="h"))
def region_scan_legacy(spark, sf_dir):
    files = anvil.encode_regions(_height_tags(_chunks(spark, sf_dir), {}, legacy=True))
    return raster.from_chunks(anvil.decode_regions(files))


@query(
    TERRAIN_SQL
    + """SELECT x, z, CASE WHEN (x // 16) % 2 = 0 THEN h + 5 ELSE h END AS h, false AS gap FROM terrain"""
)
def region_scan_last_wins(spark, sf_dir):
    """Chunks that stand in two files: those of the later name are taken."""
    chunks = raster.to_chunks(registry.terrain(spark, sf_dir, 64))
    first = anvil.encode_regions(_height_tags(chunks, {"WORLD_SURFACE": 0}).withColumn("compression", F.lit(2)))
    again = chunks.where("cx % 2 = 0").withColumn("h", F.transform("h", lambda v: v + 5))
    second = anvil.encode_regions(_height_tags(again, {"WORLD_SURFACE": 0}).withColumn("compression", F.lit(1)))
    files = second.withColumn("path", F.regexp_replace("path", "r.0.", "r.00.")).unionByName(first)
    return raster.assemble(anvil.decode_regions(files))


# Sections ------------------------------------------------------------------------------


def _section_tags(blocks: DataFrame) -> DataFrame:
    """Chunk tags of blocks(x, y, z, name) in 16 x 16 x 16 sections: with block states, with packed
    palettes under a level, or with numbers, by the chunk's place."""
    number = {name: i + 1 for i, name in enumerate(b for b in BLOCKS if b != "minecraft:air")} | {"minecraft:air": 0}

    def section(y: int, cells: dict[int, str], kind: int) -> dict:
        names = ["minecraft:air", *sorted(set(cells.values()) - {"minecraft:air"})]
        if kind == 2:
            return {"Y": y, "Blocks": bytes(number[cells.get(i, "minecraft:air")] for i in range(4096))}
        index = np.array([names.index(cells.get(i, "minecraft:air")) for i in range(4096)])
        palette = [{"Name": n} for n in names]
        if kind == 0 and len(names) == 1:
            return {"Y": y, "block_states": {"palette": palette}}
        data = anvil.pack_longs(index, palette_bits(len(names)), kind == 0)
        return {"Y": y, "block_states": {"palette": palette, "data": data}} if kind == 0 else {"Y": y, "Palette": palette, "BlockStates": data}

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        cx, cz = int(frame["x"].iloc[0]) >> 4, int(frame["z"].iloc[0]) >> 4
        kind = (cx + 2 * cz) % 3
        cells: dict[int, dict[int, str]] = {y: {} for y in range(-2, 2)}
        for x, y, z, name in zip(frame["x"], frame["y"], frame["z"], frame["name"], strict=True):
            cells[int(y) >> 4][((int(y) & 15) * 16 + (int(z) & 15)) * 16 + (int(x) & 15)] = name
        parts = [section(y, own, kind) for y, own in cells.items()]
        root = {"sections": parts} if kind == 0 else {"Level": {"Sections": parts}}
        return pd.DataFrame({"cx": [cx], "cz": [cz], "tags": [nbt.dump(root)], "compression": [kind + 1]})

    low = blocks.select("x", (F.col("y") - DEPTH).alias("y"), "z", "name")
    return low.groupBy(F.shiftright("x", 4), F.shiftright("z", 4)).applyInPandas(lambda frame: pack(frame), TAGS)


def _sections(spark, sf_dir, options: ScanOptions, blocks: DataFrame | None = None) -> DataFrame:
    blocks = voxel_table(spark, sf_dir) if blocks is None else blocks
    return anvil.decode_regions(anvil.encode_regions(_section_tags(blocks)), options)


_GROUND = "name <> 'minecraft:air' AND (name = 'minecraft:grass_block' OR NOT regexp_matches(regexp_extract(name, '[^:]*$'), '" + "|".join(NO_GROUND) + "'))"
#: Chunks of numbered blocks don't know which of them are ground.
_SOLID = f"CASE WHEN (x // 16 + 2 * (z // 16)) % 3 = 2 THEN name <> 'minecraft:air' ELSE {_GROUND} END"
_COLUMNS = "columns AS (SELECT a.range::INT AS x, b.range::INT AS z FROM range(32) a, range(32) b)"


def _tops(kind: str, where: str) -> str:
    return f"SELECT '{kind}' AS kind, c.x, c.z, coalesce(max(CASE WHEN {where} THEN y END) + 1 - {DEPTH}, 0) AS h FROM columns c LEFT JOIN voxels v ON v.x = c.x AND v.z = c.z GROUP BY 2, 3"


@query(VOXEL_SQL + f", {_COLUMNS} " + _tops("surface", "name <> 'minecraft:air'") + " UNION ALL " + _tops("ground", _SOLID.replace("x //", "c.x //").replace("z //", "c.z //")))
def section_scan(spark, sf_dir):
    found = [
        raster.from_chunks(_sections(spark, sf_dir, ScanOptions(force_scan=True, ground_only=ground))).withColumn("kind", F.lit(name))
        for name, ground in (("surface", False), ("ground", True))
    ]
    return found[0].unionByName(found[1])


@query(
    VOXEL_SQL
    + f""", {_COLUMNS}, tops AS (
SELECT c.x, c.z, coalesce(max(CASE WHEN name <> 'minecraft:air' THEN y END) + 1 - {DEPTH}, 0) AS h FROM columns c LEFT JOIN voxels v ON v.x = c.x AND v.z = c.z GROUP BY 1, 2)
SELECT t.x, t.z, t.h, coalesce(v.name = 'minecraft:water' AND (t.x // 16 + 2 * (t.z // 16)) % 3 <> 2, false) AS water
FROM tops t LEFT JOIN voxels v ON v.x = t.x AND v.z = t.z AND v.y - {DEPTH} = t.h - 1"""
)
def section_scan_water(spark, sf_dir):
    chunks = _sections(spark, sf_dir, ScanOptions(force_scan=True, water=True))
    return raster.with_water(raster.from_chunks(chunks), chunks.select("cx", "cz", "water"))


@query(
    VOXEL_SQL
    + f""", {_COLUMNS}, solid AS (SELECT x, y, z, (y * 32 + z) * 32 + x AS id FROM voxels WHERE (x * 7 + z) % 11 <> 0 AND ({_SOLID})),
e AS (SELECT a.id a, b.id b FROM solid a JOIN solid b ON a.x // 16 = b.x // 16 AND a.z // 16 = b.z // 16
  AND ((b.x = a.x AND b.z = a.z AND b.y IN (a.y - 1, a.y + 1)) OR (b.y = a.y AND b.z = a.z AND b.x IN (a.x - 1, a.x + 1)) OR (b.y = a.y AND b.x = a.x AND b.z IN (a.z - 1, a.z + 1)))),
reach(id) AS (SELECT id FROM solid WHERE y < 16 UNION SELECT e.b FROM reach JOIN e ON e.a = reach.id),
tops AS (SELECT (id % 32)::INT x, (id // 32 % 32)::INT z, max(id // 1024)::INT + 1 - {DEPTH} AS h FROM reach GROUP BY 1, 2)
SELECT x, z, coalesce(h, -{DEPTH}) AS h FROM columns LEFT JOIN tops USING (x, z)"""
)
def section_scan_grounded(spark, sf_dir):
    """Only blocks that reach the floor count; columns without one lie on the floor."""
    bare = voxel_table(spark, sf_dir).where("(x * 7 + z) % 11 <> 0")
    return raster.from_chunks(_sections(spark, sf_dir, ScanOptions(ground_only=True, detect_floating=True), bare))


# Key-value records, pictures and solids ------------------------------------------------


@query(TERRAIN_SQL + "SELECT x - 32 AS x, z - 32 AS z, h FROM terrain WHERE (x // 16 + z // 16) % 4 <> 1")
def key_value_scan(spark, sf_dir):
    """Height records among records with other tags, longer keys and values that are too short."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for cx, cz, h in zip(frame["cx"], frame["cz"], frame["h"], strict=True):
                key, value = struct.pack("<ii", cx, cz), np.asarray(h, dtype="<i2").tobytes()
                short = (cx + cz) % 4 == 1
                out += [(key + b"\x2b", value[:511] if short else value + b"biomes"), (key + b"\x2c", value), (key + b"\x2b\x00", value), (b"", value)]
            yield pd.DataFrame(out, columns=["key", "value"])

    records = _chunks(spark, sf_dir).select("cx", "cz", "h").mapInPandas(run, "key binary, value binary")
    return raster.from_chunks(bedrock.decode_records(records))


def _corners(v: str) -> list[Column]:
    return [F.round(F.col(f"{v}{i}").cast("double"), 3).alias(f"{v}{i}") for i in "xyz"]


@query(TERRAIN_SQL + ", " + registry._VERTEX_SQL + "\nSELECT " + ", ".join(f"round({v}.{i}::DOUBLE, 3) AS {v}{i}" for v in ("v0", "v1", "v2") for i in "xyz") + " FROM tri")
def stl_round_trip(spark, sf_dir):
    """The corners of a solid's triangles, read back from the bytes that its file is made of."""
    parts = sinks.triangle_bytes(registry._triangles(spark, sf_dir), [])
    names = [f"{v}{i}" for v in ("v0", "v1", "v2") for i in "xyz"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["data"]:
                yield pd.DataFrame(np.frombuffer(bytes(data), dtype=sinks.STL_ROW)["v"].reshape(-1, 9), columns=names)

    back = parts.mapInPandas(read, ", ".join(f"{n} float" for n in names))
    return back.select(*_corners("v0"), *_corners("v1"), *_corners("v2"))


@query(registry.oracle_sql()["gray_ramp"])
def gray_rows_round_trip(spark, sf_dir):
    """The pixels of a gray picture, read back from the rows of bytes that its file is made of."""
    pixels = registry.queries()["gray_ramp"](spark, sf_dir).select(F.col("x").alias("px"), F.col("z").alias("py"), "gray")
    rows = sinks.pixel_rows(pixels, ("gray",))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for z, x0, row in zip(frame["py"], frame["x0"], frame["row"], strict=True):
                values = np.frombuffer(bytes(row), dtype=np.uint8)
                yield pd.DataFrame({"x": np.arange(x0, x0 + len(values)), "z": z, "gray": values.astype(np.int32)})

    return rows.mapInPandas(read, "x int, z int, gray int")
