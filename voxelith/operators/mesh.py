"""Watertight meshes of height maps, whole or in tiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def solid_triangle_count(rows: int, cols: int) -> int:
    """Two triangles for each quad of top and bottom and for each edge of the four walls."""
    return 4 * (rows - 1) * (cols - 1) + 4 * (rows - 1) + 4 * (cols - 1)


def scale_to_fit(max_x: float, max_y: float, cols: int, rows: int, border: int = 0) -> float:
    """Millimetres for each step between vertices, the border's layers included."""
    across, down = cols - 1 + 2 * max(0, border), rows - 1 + 2 * max(0, border)
    if across <= 0 or down <= 0:
        raise ValueError("a mesh needs two rows and two columns")
    return min(max_x / across, max_y / down)


def mesh_heights(
    cells: DataFrame, exaggeration: float = 1.0, sea_level: float | None = None, offset: float = 0.0,
    fit_z: float | None = None, step: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Heights in mesh units, and one row (lo, span, z_scale).

    With fit_z the whole range is scaled to that height and the ocean lies at the least height.
    With a sea level relief is exaggerated around it and the ocean lies offset below it,
    unscaled; without one heights are exaggerated and the ocean takes the least of them. A range
    below a millionth counts as 1.
    """
    h = F.col("h").cast("double")
    least = cells.agg(F.min(h).alias("__lo"))
    if fit_z is not None:
        raised = cells.crossJoin(F.broadcast(least)).withColumn("h", F.when(F.col("ocean"), F.col("__lo")).otherwise(h))
    elif sea_level is not None:
        raised = cells.withColumn(
            "h", F.when(F.col("ocean"), F.lit(float(sea_level) - offset)).otherwise(F.lit(float(sea_level)) + (h - sea_level) * exaggeration)
        )
    else:
        raised = cells.crossJoin(F.broadcast(least)).withColumn(
            "h", F.when(F.col("ocean"), F.col("__lo") * exaggeration).otherwise(h * exaggeration)
        )
    raised = raised.drop("__lo")
    span = F.when(F.max("h") - F.min("h") < 1e-6, F.lit(1.0)).otherwise(F.max("h") - F.min("h"))
    facts = raised.agg(F.min("h").alias("lo"), span.alias("span")).withColumn(
        "z_scale", F.lit(float(fit_z)) / F.col("span") if fit_z is not None else F.lit(float(step))
    )
    return raised, facts


def vertices(cells: DataFrame, facts: DataFrame, step: float, base: float, origin: float = 0.0, rows: int | None = None) -> DataFrame:
    """r, c, x, y, z of each vertex. With rows the map is turned so that north is up."""
    r = F.lit(rows - 1) - F.col("z") if rows is not None else F.col("z")
    return cells.crossJoin(F.broadcast(facts.select("lo", "z_scale"))).select(
        r.cast("int").alias("r"), F.col("x").cast("int").alias("c"),
        (F.lit(origin) + F.col("x") * step).alias("x"), (F.lit(origin) + r * step).alias("y"),
        ((F.col("h") - F.col("lo")) * F.col("z_scale") + base).alias("z"),
    )


def _point(name: str, flat: bool = False) -> Column:
    z = F.lit(0.0) if flat else F.col(f"{name}.z")
    return F.struct(F.col(f"{name}.x").cast("float").alias("x"), F.col(f"{name}.y").cast("float").alias("y"), z.cast("float").alias("z"))


def _faces(*faces: tuple[str, int, tuple[Column, Column, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(side).alias("side"), F.lit(k).alias("k"), a.alias("v0"), b.alias("v1"), c.alias("v2")) for side, k, (a, b, c) in faces])


#: Sides in the order in which a file lists them.
SIDES = ("top", "bottom", "west", "east", "first", "last")


def solid_triangles(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, side, r, c, k, v0, v1, v2 of the closed solid over a rectangle of vertices (r, c, x, y, z).

    A vertex meets its neighbours to the right, below and across through window functions.
    Walls stand on the first and last rows and columns of each group named by by.
    """
    here = F.struct("x", "y", "z")
    right = W.partitionBy(*by, "r").orderBy("c")
    below = W.partitionBy(*by, "c").orderBy("r")
    rows = points.select(*by, "r", "c", here.alias("a")).withColumn("b", F.lead("a").over(right))
    rows = rows.withColumn("__next", F.lead(F.struct("a", "b")).over(below)).select(
        "*", F.col("__next.a").alias("d"), F.col("__next.b").alias("e")
    )
    edges = points.groupBy(*by).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    rows = rows.join(edges, list(by)) if by else rows.crossJoin(F.broadcast(edges))
    a, b, d, e = (_point(n) for n in "abde")
    fa, fb, fd, fe = (_point(n, True) for n in "abde")
    quad = _faces(("top", 0, (a, b, e)), ("top", 1, (a, e, d)), ("bottom", 0, (fa, fe, fb)), ("bottom", 1, (fa, fd, fe)))
    west = _faces(("west", 0, (a, fd, fa)), ("west", 1, (a, d, fd)))
    east = _faces(("east", 0, (a, fa, fd)), ("east", 1, (a, fd, d)))
    first = _faces(("first", 0, (a, fa, fb)), ("first", 1, (a, fb, b)))
    last = _faces(("last", 0, (a, fb, fa)), ("last", 1, (a, b, fb)))
    none = F.slice(quad, 1, 0)
    has_right, has_below = F.col("b").isNotNull(), F.col("d").isNotNull()
    faces = F.concat(
        F.when(has_right & has_below, quad).otherwise(none),
        F.when(has_below & (F.col("c") == F.col("c0")), west).otherwise(none),
        F.when(has_below & (F.col("c") == F.col("c1")), east).otherwise(none),
        F.when(has_right & (F.col("r") == F.col("r0")), first).otherwise(none),
        F.when(has_right & (F.col("r") == F.col("r1")), last).otherwise(none),
    )
    return rows.select(*by, "r", "c", F.explode(faces).alias("f")).select(*by, "f.side", "r", "c", "f.k", "f.v0", "f.v1", "f.v2")


def normal(v0: str = "v0", v1: str = "v1", v2: str = "v2") -> Column:
    """struct(x, y, z): the unit normal, zero for triangles without area."""
    ux, uy, uz = (F.col(f"{v1}.{i}").cast("double") - F.col(f"{v0}.{i}") for i in "xyz")
    wx, wy, wz = (F.col(f"{v2}.{i}").cast("double") - F.col(f"{v0}.{i}") for i in "xyz")
    nx, ny, nz = uy * wz - uz * wy, uz * wx - ux * wz, ux * wy - uy * wx
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    return F.struct(*[F.when(size > 1e-12, n / size).otherwise(F.lit(0.0)).cast("float").alias(i) for n, i in zip((nx, ny, nz), "xyz", strict=True)])


def border_boxes(terrain_x: float, terrain_y: float, wall: float, top: float) -> list[tuple[float, ...]]:
    """Four boxes (x0, x1, y0, y1, z0, z1) around the model; none without a wall."""
    if wall <= 0:
        return []
    x1, y1 = wall + terrain_x, wall + terrain_y
    return [
        (0.0, wall, 0.0, y1 + wall, 0.0, top), (x1, x1 + wall, 0.0, y1 + wall, 0.0, top),
        (wall, x1, 0.0, wall, 0.0, top), (wall, x1, y1, y1 + wall, 0.0, top),
    ]


BOX_COLUMNS = ("x0", "x1", "y0", "y1", "z0", "z1")
#: Corners of a box by bits of x, y and z, for its twelve triangles with normals outwards.
#: A file's triangles come in this order.
_BOX = (
    ("000", "110", "100"), ("000", "010", "110"), ("001", "101", "111"), ("001", "111", "011"),
    ("000", "100", "101"), ("000", "101", "001"), ("100", "110", "111"), ("100", "111", "101"),
    ("110", "010", "011"), ("110", "011", "111"), ("010", "000", "001"), ("010", "001", "011"),
)


def box_triangles(boxes: DataFrame) -> DataFrame:
    """The boxes' other columns, k, v0, v1, v2; boxes without volume give nothing."""
    def corner(bits: str) -> Column:
        return F.struct(*[F.col(f"{axis}{bit}").cast("float").alias(axis) for axis, bit in zip("xyz", bits, strict=True)])

    rest = [c for c in boxes.columns if c not in BOX_COLUMNS]
    solid = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("z1") > F.col("z0")))
    faces = F.array(*[F.struct(F.lit(k).alias("k"), *[corner(p).alias(f"v{i}") for i, p in enumerate(t)]) for k, t in enumerate(_BOX)])
    return solid.select(*rest, F.explode(faces).alias("f")).select(*rest, "f.k", "f.v0", "f.v1", "f.v2")


@dataclass(frozen=True)
class TilePlan:
    """The tiles of a mosaic over cols x rows vertices with a border of some layers."""

    cols: int
    rows: int
    step: float
    tile_x: float
    tile_y: float
    border: int = 0

    @property
    def stride_c(self) -> int:
        return max(2, round(self.tile_x / self.step) + 1) - 1

    @property
    def stride_r(self) -> int:
        return max(2, round(self.tile_y / self.step) + 1) - 1

    @property
    def across(self) -> int:
        return math.ceil((self.cols + 2 * self.border - 1) / self.stride_c)

    @property
    def down(self) -> int:
        return math.ceil((self.rows + 2 * self.border - 1) / self.stride_r)

    def windows(self, spark) -> DataFrame:
        """tz, tx and the closed window c0..c1, r0..r1 of vertices, the border's layers counted."""
        last_c, last_r = self.cols + 2 * self.border - 1, self.rows + 2 * self.border - 1
        ids = spark.range(self.across * self.down).select(
            F.expr(f"cast(id div {self.across} as int)").alias("tz"), (F.col("id") % self.across).cast("int").alias("tx")
        )
        return ids.select(
            "tz", "tx", (F.col("tx") * self.stride_c).alias("c0"), F.least((F.col("tx") + 1) * self.stride_c, F.lit(last_c)).alias("c1"),
            (F.col("tz") * self.stride_r).alias("r0"), F.least((F.col("tz") + 1) * self.stride_r, F.lit(last_r)).alias("r1"),
        )

    def place(self, points: DataFrame) -> DataFrame:
        """Each vertex in its tiles: one, two on an edge, four at a corner."""
        def tiles(at: Column, stride: int, count: int) -> Column:
            own = F.floor(at / stride)
            spots = F.array(F.when((at % stride == 0) & (own > 0), own - 1), F.when(own < count, own))
            return F.array_compact(spots)

        c, r = F.col("c") + self.border, F.col("r") + self.border
        spread = points.withColumn("tx", F.explode(tiles(c, self.stride_c, self.across)))
        spread = spread.withColumn("tz", F.explode(tiles(r, self.stride_r, self.down)))
        placed = spread.withColumn("tx", F.col("tx").cast("int")).withColumn("tz", F.col("tz").cast("int"))
        # A tile with a single row or column of terrain has none.
        sides = placed.groupBy("tz", "tx").agg(
            (F.max("c") > F.min("c")).alias("__wide"), (F.max("r") > F.min("r")).alias("__tall")
        )
        return placed.join(sides.where("__wide and __tall").select("tz", "tx"), ["tz", "tx"])


def clip_boxes(boxes: DataFrame, windows: DataFrame, step: float) -> DataFrame:
    """The parts of the boxes inside each tile's window: tz, tx and the clipped box."""
    both = windows.crossJoin(F.broadcast(boxes))
    cut = both.select(
        "tz", "tx",
        F.greatest("x0", F.col("c0") * step).alias("x0"), F.least("x1", F.col("c1") * step).alias("x1"),
        F.greatest("y0", F.col("r0") * step).alias("y0"), F.least("y1", F.col("r1") * step).alias("y1"), "z0", "z1",
    )
    return cut.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def ocean_tiles(placed: DataFrame) -> DataFrame:
    """tz, tx and all_ocean of tiles that hold terrain."""
    return placed.groupBy("tz", "tx").agg(F.min("ocean").alias("all_ocean"))
