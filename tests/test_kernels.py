"""Array code and expressions against plain definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelith.functions.bits import palette_bits, unpack, unpack_array
from voxelith.functions.blocks import is_no_ground, skipped
from voxelith.functions.geometry import convex_hull, inside_convex, inside_even_odd
from voxelith.operators import mesh, stencils
from voxelith.operators.graph import components
from voxelith.operators.regions import label_grid, label_voxels


def flood(mask):
    """Labels by flood fill: the flat index of each region's first cell."""
    out = np.full(mask.shape, -1)
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start] >= 0:
            continue
        name, todo = np.ravel_multi_index(start, mask.shape), [start]
        out[start] = name
        while todo:
            at = todo.pop()
            for axis in range(mask.ndim):
                for step in (-1, 1):
                    to = tuple(v + step * (k == axis) for k, v in enumerate(at))
                    if all(0 <= v < s for v, s in zip(to, mask.shape, strict=True)) and mask[to] and out[to] < 0:
                        out[to] = name
                        todo.append(to)
    return out


@given(st.integers(0, 2**32 - 1), st.integers(1, 14), st.integers(1, 14), st.floats(0.1, 0.9))
@settings(max_examples=60, deadline=None)
def test_grid_labels(seed, rows, cols, share):
    mask = np.random.default_rng(seed).random((rows, cols)) < share
    assert np.array_equal(label_grid(mask), flood(mask))


@given(st.integers(0, 2**32 - 1), st.floats(0.1, 0.9))
@settings(max_examples=30, deadline=None)
def test_voxel_labels(seed, share):
    mask = np.random.default_rng(seed).random((5, 4, 6)) < share
    assert np.array_equal(label_voxels(mask), flood(mask))


def _pack(values, bits, aligned):
    out, each = [], 64 // bits
    if aligned:
        for i in range(0, len(values), each):
            out.append(sum(v << (k * bits) for k, v in enumerate(values[i : i + each])))
    else:
        whole = sum(v << (k * bits) for k, v in enumerate(values))
        out = [(whole >> (64 * i)) & (2**64 - 1) for i in range(-(-len(values) * bits // 64))]
    return [v - 2**64 if v >= 2**63 else v for v in out]


@pytest.mark.parametrize(("bits", "count", "aligned", "longs"), [(9, 256, True, 37), (9, 256, False, 36), (4, 4096, True, 256), (5, 4096, True, 342), (5, 4096, False, 320)])
def test_unpack(spark, bits, count, aligned, longs):
    values = [(i * 37 + i // 3) % (1 << bits) for i in range(count)]
    packed = _pack(values, bits, aligned)
    assert len(packed) == longs
    assert unpack_array(np.array(packed), bits, count).tolist() == values
    frame = spark.createDataFrame([(packed,)], "a array<long>")
    assert frame.select(unpack("a", bits, count).alias("v")).first().v == values


def test_unpack_short_input_is_padded(spark):
    assert unpack_array(np.array([-1]), 9, 256).tolist()[:8] == [511] * 7 + [1]
    frame = spark.createDataFrame([([-1],)], "a array<long>")
    assert frame.select(unpack("a", 9, 256).alias("v")).first().v[:8] == [511] * 7 + [1]


def test_palette_bits():
    assert [palette_bits(n) for n in (1, 2, 16, 17, 32, 33, 4096)] == [4, 4, 4, 5, 5, 6, 12]


def test_block_names(spark):
    names = ["minecraft:air", "minecraft:stone", "minecraft:grass_block", "foo:grass_block", "minecraft:bedrock", "minecraft:oak_log", "plain"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    found = [r.s for r in frame.select(is_no_ground(F.col("name")).alias("s")).collect()]
    assert found == [True, False, False, True, True, True, False]
    assert found == [skipped(n, True) for n in names]
    assert [skipped(n, False) for n in names] == [True] + [False] * 6


def test_polygons(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    cells = spark.range(12 * 12).select((F.col("id") % 12).cast("double").alias("x"), F.expr("cast(id div 12 as double)").alias("z"))
    inside = cells.where(inside_even_odd(F.col("x"), F.col("z"), square)).count()
    assert inside == 100  # the far column and row stay outside
    assert cells.where(inside_convex(F.col("x"), F.col("z"), convex_hull(square))).count() == 121
    assert len(convex_hull([(0, 0), (1, 1), (2, 2)])) < 3
    assert convex_hull([(0, 0), (4, 0), (2, 1), (4, 4), (0, 4)]) == [(0, 0), (4, 0), (4, 4), (0, 4)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 7), (200, 201), (202, 201), (300, 300)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {n for n, r in found.items() if r == 0} == {*range(61), 100}
    assert {n for n, r in found.items() if r == 200} == {200, 201, 202}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shapes():
    assert mesh.solid_triangle_count(128, 128) == 65_532
    assert mesh.solid_triangle_count(128, 128) + 12 * len(mesh.border_boxes(1, 1, 1, 1)) == 65_580
    plan = mesh.TilePlan(128, 128, mesh.scale_to_fit(100, 100, 128, 128), 50, 50)
    assert (plan.stride_c, plan.across, plan.down) == (63, 3, 3)
    plan = mesh.TilePlan(128, 128, mesh.scale_to_fit(100, 100, 128, 128, 3), 40, 40, 3)
    assert (plan.stride_c, plan.across, plan.down) == (53, 3, 3)
    assert stencils.image_shape(100, 50, 0, 10) == (100, 50)
    assert stencils.image_shape(100, 50, 200, 200) == (200, 100)
    assert stencils.downsample_shape(100, 3, 50) == (50, 2)
    assert stencils.downsample_shape(10, 10, 50) == (10, 10)
    with pytest.raises(ValueError):
        mesh.scale_to_fit(100, 100, 1, 5)
    assert mesh.border_boxes(1, 1, 0, 1) == []


def test_blur_keeps_constants(spark):
    flat = spark.range(300).select((F.col("id") % 20).cast("int").alias("x"), F.expr("cast(id div 20 as int)").alias("z"), F.lit(7.0).alias("h"))
    out = stencils.gaussian(flat, 2.0).agg(F.min("h"), F.max("h"), F.count("h")).first()
    assert out[2] == 300 and abs(out[0] - 7) < 1e-9 and abs(out[1] - 7) < 1e-9
    assert abs(stencils.gaussian_weights(1.5).sum() - 1) < 1e-12
