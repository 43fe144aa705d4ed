"""A whole run: load, process, image, single mesh, mosaic."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators import mesh, raster, regions, stencils
from voxelith.operators.imaging import render
from voxelith.plans.manifest import Manifest
from voxelith.plans.params import Params, stage_key
from voxelith.sources import sinks
from voxelith.sources.anvil import ScanOptions
from voxelith.sources.world import WorldOptions, read_world, region_folder


def listing(save: str) -> str:
    """Names, sizes and times of the save's region files."""
    try:
        folder = region_folder(save)
    except FileNotFoundError:
        folder = os.path.join(save, "db")
    names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    return repr([(n, os.path.getsize(os.path.join(folder, n)), os.path.getmtime(os.path.join(folder, n))) for n in names])


def load(spark: SparkSession, params: Params) -> DataFrame:
    scan = ScanOptions(params.ground_only, params.detect_floating, params.force_scan, params.detect_water_blocks)
    return read_world(spark, params.save_path, WorldOptions(scan, params.crop_area))


def resolve_sea_level(cells: DataFrame, params: Params) -> int | None:
    """The given level, or the detected one where something is masked by it."""
    if params.sea_level is not None or not params.mask_ocean:
        return params.sea_level
    return raster.sea_level(cells).first()["sea_level"]


def process(cells: DataFrame, params: Params, level: int | None) -> DataFrame:
    """Ocean, small islands, flattening and polygon masks; without any of these the map as it is.

    The true sea level finds the ocean; the ocean and the polygons are set to the level less the
    offset.
    """
    out = cells.withColumn("ocean", F.lit(False))
    floor = (63 if level is None else level) - params.sea_level_offset
    if params.mask_ocean:
        out = regions.ocean_mask(out, level, params.min_ocean_blocks, water=params.detect_water_blocks)
        if params.min_land_area > 0:
            out = regions.remove_small_islands(out, params.min_land_area)
        out = raster.flatten_ocean(out, floor)
    if params.sea_masking:
        out = raster.mask_polygons(out, params.sea_masking, floor)
    return out


def origin(cells: DataFrame) -> tuple[DataFrame, int, int]:
    """The map moved so that x and z start at 0, its width and its height."""
    e = regions.extent(cells).first()
    moved = cells.withColumns({"x": F.col("x") - e.x0, "z": F.col("z") - e.z0})
    return moved, e.x1 - e.x0 + 1, e.z1 - e.z0 + 1


def mesh_map(cells: DataFrame, width: int, height: int, params: Params) -> tuple[DataFrame, int, int]:
    """Smoothed and downsampled heights with the ocean, north up: x is the column, z the row."""
    smooth = stencils.gaussian(cells, params.smooth_sigma)
    small, cols, rows = stencils.downsample(smooth, width, height, params.max_verts)
    marks = cells.select("x", "z", "ocean")
    if (cols, rows) != (width, height):
        marks = stencils.resample_nearest(marks, width, height, cols, rows, "ocean")
    return small.join(marks, ["x", "z"]).withColumn("z", F.lit(rows - 1) - F.col("z")), cols, rows


def single(spark: SparkSession, cells: DataFrame, width: int, height: int, params: Params, level: int | None, path: str, fit_z: float | None = None) -> int:
    """One watertight STL of the map; returns its number of triangles."""
    small, cols, rows = mesh_map(cells, width, height, params)
    step = mesh.scale_to_fit(params.max_x_mm, params.max_y_mm, cols, rows, params.border_width)
    raised, facts = mesh.mesh_heights(small, params.z_exaggeration, level, params.sea_level_offset, fit_z, step)
    wall = params.border_width * step
    solid = mesh.solid_triangles(mesh.vertices(raised, facts, step, params.base_mm, wall))
    return sinks.write_stl(path, solid, ring(spark, facts, cols, rows, step, params))


def ring(spark: SparkSession, facts: DataFrame, cols: int, rows: int, step: float, params: Params) -> DataFrame | None:
    boxes = border(spark, facts, cols, rows, step, params)
    return None if boxes is None else mesh.box_triangles(boxes)


def border(spark: SparkSession, facts: DataFrame, cols: int, rows: int, step: float, params: Params) -> DataFrame | None:
    """The border's boxes, higher than the relief by two steps of z."""
    f = facts.first()
    top = f.span * f.z_scale + params.base_mm + 2 * f.z_scale
    boxes = mesh.border_boxes((cols - 1) * step, (rows - 1) * step, params.border_width * step, top)
    if not boxes:
        return None
    schema = "box int, " + ", ".join(f"{c} double" for c in mesh.BOX_COLUMNS)
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], schema)


def mosaic(spark: SparkSession, cells: DataFrame, width: int, height: int, params: Params, level: int | None, folder: str, fit_z: float | None = None) -> DataFrame:
    """One STL for each tile that isn't written yet; returns tz, tx and n of those written now."""
    small, cols, rows = mesh_map(cells, width, height, params)
    step = mesh.scale_to_fit(params.max_x_mm, params.max_y_mm, cols, rows, params.border_width)
    raised, facts = mesh.mesh_heights(small, params.z_exaggeration, level, params.sea_level_offset, fit_z, step)
    plan = mesh.TilePlan(cols, rows, step, params.tile_x_mm, params.tile_y_mm, params.border_width)
    points = mesh.vertices(raised, facts, step, params.base_mm, params.border_width * step)
    points = points.join(raised.select(F.col("z").cast("int").alias("r"), F.col("x").cast("int").alias("c"), "ocean"), ["r", "c"])
    placed = plan.place(points)
    boxes = border(spark, facts, cols, rows, step, params)
    if boxes is None:
        schema = "box int, " + ", ".join(f"{c} double" for c in mesh.BOX_COLUMNS)
        boxes = spark.createDataFrame([], schema)
    cut = mesh.clip_boxes(boxes, plan.windows(spark), step).withColumn("box", F.monotonically_increasing_id())
    skip = sinks.finished_tiles(spark, folder)
    if params.skip_ocean_stl:
        bare = mesh.ocean_tiles(placed).where("all_ocean").select("tz", "tx").join(cut.select("tz", "tx").distinct(), ["tz", "tx"], "left_anti")
        skip = skip.unionByName(bare)
    solid = mesh.solid_triangles(placed, ("tz", "tx")).join(skip, ["tz", "tx"], "left_anti")
    walls = mesh.box_triangles(cut).join(skip, ["tz", "tx"], "left_anti")
    os.makedirs(folder, exist_ok=True)
    return sinks.write_tiles(solid, walls, folder)


def run(spark: SparkSession, params: Params, fresh: bool = False) -> dict[str, str]:
    """Every stage that is asked for and whose key is new; returns what happened to each."""
    manifest = Manifest(os.path.join(params.out_dir, "state"))
    if fresh:
        manifest.clear()
    seen, inputs = {}, listing(params.save_path)
    key = {s: stage_key(params, s, inputs) for s in ("load", "process", "image", "stl", "mosaic")}
    seen["load"] = "reused" if manifest.done("load", key["load"]) else "made"
    cells = manifest.table(spark, "load", key["load"], lambda: load(spark, params))
    if manifest.done("process", key["process"]):
        level, seen["process"] = manifest.facts("process")["sea_level"], "reused"
    else:
        level, seen["process"] = resolve_sea_level(cells, params), "made"
    ready = manifest.table(spark, "process", key["process"], lambda: process(cells, params, level), {"sea_level": level})
    moved, width, height = origin(ready)

    def once(stage: str, wanted: bool, path: str, make) -> None:
        if not wanted:
            seen[stage] = "off"
        elif manifest.done(stage, key[stage]):
            seen[stage] = "reused"
        else:
            make()
            manifest.mark(stage, key[stage], [path])
            seen[stage] = "made"

    def image() -> None:
        clear = params.crop_area is not None and not params.rectangular_crop
        pixels, w, h = render(moved, width, height, level or 0, params.max_px_w, params.max_px_h, params.smooth_sigma, clear)
        pixels = pixels.persist()
        sinks.write_png(pixels, picture, w, h, ("r", "g", "b", "a") if clear else ("r", "g", "b"))
        sinks.write_png(pixels, gray_path(picture), w, h, ("gray", "gray", "gray", "a") if clear else ("gray",))
        pixels.unpersist()

    picture = os.path.join(params.out_dir, "heightmap.png")
    solid = os.path.join(params.out_dir, "terrain.stl")
    tiles = os.path.join(params.out_dir, "mosaic")
    once("image", params.generate_heightmap, picture, image)
    once("stl", params.generate_stl, solid, lambda: single(spark, moved, width, height, params, level, solid))
    fits = params.max_x_mm <= params.tile_x_mm and params.max_y_mm <= params.tile_y_mm

    def pieces() -> None:
        # Tiles of another key are of another model.
        if manifest.record.get("mosaic-begun", {}).get("key") != key["mosaic"]:
            shutil.rmtree(tiles, ignore_errors=True)
            manifest.mark("mosaic-begun", key["mosaic"], [])
        mosaic(spark, moved, width, height, params, level, tiles).count()

    once("mosaic", params.generate_mosaic and not fits, tiles, pieces)
    return seen


def gray_path(path: str) -> str:
    stem, end = os.path.splitext(path)
    return f"{stem}_gray{end}"
