"""A synthetic world through scan, map, image, meshes and stage records."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.functions.bits import unpack_array
from voxelith.operators import raster
from voxelith.plans import params as p
from voxelith.plans.run import gray_path, load, mosaic, origin, process, resolve_sea_level, run, single
from voxelith.sources import anvil, bedrock, nbt, sinks, world
from voxelith.streaming.regions import update_chunks


def pack9(values):
    out = []
    for i in range(0, 256, 7):
        word = sum(int(v) << (9 * k) for k, v in enumerate(values[i : i + 7]))
        out.append(word - 2**64 if word >= 2**63 else word)
    return np.array(out, dtype=np.int64)


def surface():
    """The fixture's heights: waves, shifted so that each chunk's whole minimum is 64."""
    z, x = np.mgrid[0:128, 0:128].astype(np.float64)
    f = (40 * np.sin(x / 20) * np.cos(z / 15) + 20 * np.sin(x / 8 + 1) - 10).astype(np.float32)
    h = np.zeros((128, 128), dtype=np.int32)
    for cz in range(0, 128, 16):
        for cx in range(0, 128, 16):
            tile = f[cz : cz + 16, cx : cx + 16]
            h[cz : cz + 16, cx : cx + 16] = (tile - (int(tile.min()) - 64)).astype(np.int32)
    return h


@pytest.fixture(scope="module")
def save(tmp_path_factory):
    folder = tmp_path_factory.mktemp("world")
    h = surface()
    chunks = {}
    for cz in range(8):
        for cx in range(8):
            tile = h[cz * 16 : cz * 16 + 16, cx * 16 : cx * 16 + 16].ravel()
            chunks[(cx, cz)] = {
                "DataVersion": 2860, "xPos": cx, "zPos": cz, "yPos": -4, "Status": "minecraft:full",
                "Heightmaps": {"WORLD_SURFACE": pack9(tile)},
            }
    (folder / "region").mkdir()
    (folder / "region" / "r.0.0.mca").write_bytes(anvil.write_region(chunks))
    return str(folder)


def test_scan(spark, save):
    cells = world.read_world(spark, save)
    facts = cells.agg(F.count("h"), F.min("h"), F.max("h"), F.sum("h")).first()
    assert tuple(facts) == (16384, 63, 127, 1_367_056)
    level = raster.sea_level(cells).first()
    assert (level.sea_level, level.n_cells) == (81, 547)
    assert world.diagnose(spark, save).count() == 3


def test_ocean(spark, save):
    params = p.Params(save_path=save, out_dir="x", min_ocean_blocks=10**9, min_land_area=50)
    cells = load(spark, params)
    level = resolve_sea_level(cells, params)
    done = process(cells, params, level)
    assert level == 81
    # 4663 cells of the ocean and 54 of islands with fewer than 50.
    assert done.where("ocean").count() == 4663 + 54
    assert done.where("ocean and h <> 81").count() == 0


def _section(y, names, pick):
    index = np.array([[[pick(yy, z, x) for x in range(16)] for z in range(16)] for yy in range(16)]).ravel()
    bits = 4
    longs = []
    for i in range(0, 4096, 16):
        word = sum(int(v) << (bits * k) for k, v in enumerate(index[i : i + 16]))
        longs.append(word - 2**64 if word >= 2**63 else word)
    return {"Y": y, "block_states": {"palette": [{"Name": n} for n in names], "data": np.array(longs, dtype=np.int64)}}


def test_sections():
    names = ["minecraft:air", "minecraft:stone", "minecraft:oak_log", "minecraft:water"]
    low = _section(-1, names, lambda y, z, x: 1 if y < 4 else 0)
    # One floating stone, one log on the ground, water in one column.
    def pick(y, z, x):
        if (y, z, x) == (9, 3, 3):
            return 1
        return 2 if (z, x) == (5, 5) and y == 0 else 3 if (z, x) == (7, 7) and y == 2 else 0

    root = {"sections": [low, _section(0, names, pick)]}
    plain = anvil.heights(root, anvil.ScanOptions(force_scan=True))
    assert plain[0, 0] == -12 and plain[3, 3] == 10 and plain[5, 5] == 1 and plain[7, 7] == 3
    ground = anvil.heights(root, anvil.ScanOptions(ground_only=True, force_scan=True))
    assert ground[5, 5] == -12
    solid = anvil.heights(root, anvil.ScanOptions(detect_floating=True))
    assert solid[3, 3] == -12 and solid[0, 0] == -12
    wet = anvil.water_flags(root, plain)
    assert wet[7, 7] and wet.sum() == 1
    uniform = {"sections": [{"Y": -2, "block_states": {"palette": [{"Name": "minecraft:water"}]}}]}
    assert anvil.water_flags({"Level": uniform}, np.full((16, 16), -16)).all()
    old = {"Sections": [{"Y": 0, "Blocks": bytes([1] * 256 + [0] * 3840)}]}
    assert (anvil.heights({"Level": old}, anvil.ScanOptions(ground_only=True)) == 1).all()
    older = {"Sections": [{"Y": 0, "Palette": [{"Name": "minecraft:air"}, {"Name": "minecraft:stone"}], "BlockStates": low["block_states"]["data"]}]}
    assert (anvil.heights(older, anvil.ScanOptions()) == 4).all()
    assert anvil.heights({"HeightMap": np.arange(256, dtype=np.int32)}, anvil.ScanOptions())[1, 0] == 16
    assert anvil.heights({}, anvil.ScanOptions()) is None
    empty = {"sections": [_section(2, ["minecraft:air"], lambda y, z, x: 0)]}
    assert (anvil.heights(empty, anvil.ScanOptions()) == 0).all()
    assert (anvil.heights(empty, anvil.ScanOptions(detect_floating=True)) == 32).all()


def test_damaged_regions():
    tags = {"HeightMap": np.zeros(256, dtype=np.int32)}
    for compression in (1, 2, 3):
        data = anvil.write_region({(1, 2): tags}, compression)
        assert [(x, z) for x, z, _ in anvil.chunk_records(data)] == [(1, 2)]
        broken = bytearray(data)
        broken[8192 + 4] = 9  # an unknown compression
        assert not list(anvil.chunk_records(bytes(broken)))
        assert not list(anvil.chunk_records(data[:8200]))
    assert not list(anvil.chunk_records(b""))
    assert nbt.parse(b"\x01\x00") is None and nbt.parse(b"") is None
    assert anvil.region_place("a/r.-3.12.mca") == (-3, 12) and anvil.region_place("r.x.mca") is None


def test_tags_round_trip():
    root = {"a": 1, "b": "text", "c": [1, 2], "d": {"e": 2.5}, "f": np.arange(3, dtype=np.int64), "g": b"xyz"}
    back = nbt.parse(nbt.dump(root))
    assert back["a"] == 1 and back["b"] == "text" and back["c"] == [1, 2] and back["d"] == {"e": 2.5}
    assert back["f"].tolist() == [0, 1, 2] and bytes(back["g"]) == b"xyz"


def test_formats(tmp_path):
    with pytest.raises(FileNotFoundError):
        world.detect_format(str(tmp_path))
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "000005.ldb").write_bytes(b"")
    assert world.detect_format(str(tmp_path)) == "bedrock"
    (tmp_path / "DIM0" / "region").mkdir(parents=True)
    (tmp_path / "DIM0" / "region" / "r.0.-1.mca").write_bytes(b"")
    assert world.detect_format(str(tmp_path)) == "java"
    assert world.region_folder(str(tmp_path)).endswith("DIM0/region")


def test_key_value_records(spark):
    heights = struct.pack("<256h", *range(-128, 128))
    rows = [
        (struct.pack("<ii", -1, 5) + b"\x2b", heights + b"biomes"), (struct.pack("<ii", 0, 0) + b"\x2b", b"short"),
        (struct.pack("<ii", 0, 0) + b"\x2c", heights), (b"other", heights),
    ]
    found = bedrock.decode_records(spark.createDataFrame([tuple(map(bytearray, r)) for r in rows], "key binary, value binary")).collect()
    assert [(r.cx, r.cz, r.h) for r in found] == [(-1, 5, list(range(-128, 128)))]


def test_crop_outside(spark, save):
    with pytest.raises(ValueError):
        world.read_chunks(spark, save, world.WorldOptions(crop=[(-900, 0), (-800, 0), (-800, 50)]))


def _edges(triangles):
    found = {}
    for t in triangles["v"]:
        corners = [tuple(np.round(c, 4)) for c in t]
        for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
            found[(a, b)] = found.get((a, b), 0) + 1
    return found


def test_single_mesh(spark, save, tmp_path):
    params = p.Params(save_path=save, out_dir="x", max_x_mm=100, max_y_mm=100, smooth_sigma=1.0, max_verts=40, mask_ocean=False)
    cells, width, height = origin(load(spark, params).withColumn("ocean", F.lit(False)))
    path = str(tmp_path / "one.stl")
    n = single(spark, cells, width, height, params, None, path, fit_z=10.0)
    out = sinks.read_stl(path)
    assert n == len(out) == 4 * 39 * 39 + 8 * 39
    assert np.allclose(out["v"].max(axis=(0, 1)), [100, 100, 12], atol=1e-3) and out["v"].min() == 0
    edges = _edges(out)
    # A closed surface passes every edge once in each direction.
    assert all(count == 1 and edges.get((b, a)) == 1 for (a, b), count in edges.items())
    assert np.allclose(np.linalg.norm(out["n"], axis=1), 1, atol=1e-3)


def test_mosaic(spark, save, tmp_path):
    params = p.Params(
        save_path=save, out_dir="x", max_x_mm=100, max_y_mm=100, tile_x_mm=40, tile_y_mm=40, smooth_sigma=0, border_width=3,
        mask_ocean=False,
    )
    cells, width, height = origin(load(spark, params).withColumn("ocean", F.lit(False)))
    folder = str(tmp_path / "tiles")
    made = mosaic(spark, cells, width, height, params, None, folder, fit_z=10.0).collect()
    assert len(made) == 9
    tops = {(r.tz, r.tx): sinks.read_stl(sinks.tile_path(folder, r.tz, r.tx))["v"][..., 2] for r in made}
    assert all(t.min() == 0 for t in tops.values())
    assert tops[(0, 0)].max() > tops[(1, 1)].max()
    assert sinks.finished_tiles(spark, folder).count() == 9
    with open(sinks.tile_path(folder, 1, 1), "ab") as f:
        f.write(b"x")  # a tile that isn't whole is made again
    again = mosaic(spark, cells, width, height, params, None, folder, fit_z=10.0).collect()
    assert [(r.tz, r.tx) for r in again] == [(1, 1)]


def test_whole_run(spark, save, tmp_path):
    out = str(tmp_path / "out")
    params = p.Params(
        save_path=save, out_dir=out, max_px_w=64, max_px_h=64, max_verts=24, max_x_mm=50, max_y_mm=50, tile_x_mm=30, tile_y_mm=30,
        min_ocean_blocks=100, min_land_area=10,
    )
    assert set(run(spark, params).values()) == {"made"}
    picture = os.path.join(out, "heightmap.png")
    rgb, gray = sinks.read_png(picture), sinks.read_png(gray_path(picture))
    assert rgb.shape == (64, 64, 3) and gray.shape == (64, 64, 1)
    assert ((rgb == (30, 80, 160)).all(axis=2) == (gray[..., 0] == 0)).mean() > 0.99
    assert set(run(spark, params).values()) == {"reused"}
    changed = p.Params(**{**params.__dict__, "base_mm": 3.0})
    assert run(spark, changed) == {"load": "reused", "process": "reused", "image": "reused", "stl": "made", "mosaic": "made"}


def test_stream_of_regions(spark, save, tmp_path):
    args = (spark, os.path.join(save, "region"), str(tmp_path / "chunks"), str(tmp_path / "state"))
    update_chunks(*args)
    update_chunks(*args)
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 64


def test_params(tmp_path):
    square = [[0, 0], [9, 0], [9, 9], [0, 9]]
    file = {"configuration": {"sea_level": 62, "_note": 1, "border_width": 2}, "crop_area": square, "sea_masking": [square]}
    params = p.from_json(file)
    assert params.sea_level == 62 and params.crop_area[2] == (9, 9) and len(params.sea_masking) == 1
    assert p.from_json(p.to_json(params)) == params
    flat = {f"crop_{a}{i}": v for i, c in enumerate(square, 1) for a, v in zip("xz", c, strict=True)}
    masks = tmp_path / "m.json"
    masks.write_text(json.dumps({"coordinates": square}))
    old = p.from_json({**flat, "polygon_json": str(masks)})
    assert old.crop_area == params.crop_area and old.sea_masking == params.sea_masking
    with pytest.raises(ValueError):
        p.Params(base_mm=0)
    assert p.same(1, 1.0 + 1e-12) and not p.same(None, 0) and p.same("1", 1)
    assert p.stage_key(params, "image") != p.stage_key(p.Params(), "image")
    assert p.stage_key(p.Params(base_mm=3), "image") == p.stage_key(p.Params(), "image")


def test_unpack_matches_fixture():
    values = list(range(256))
    assert unpack_array(pack9(values), 9, 256).tolist() == values
