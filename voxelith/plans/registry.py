"""Named terrain queries and their DuckDB counterparts.

Every query runs over a map derived from whole tables; see sources.tables. Real numbers are
rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions.bits import unpack_aligned, unpack_stream
from voxelith.functions.blocks import NO_GROUND, is_no_ground
from voxelith.functions.colors import alpha, elevation_rgb, gray
from voxelith.functions.geometry import convex_hull
from voxelith.operators import mesh, raster, regions, stencils, voxels
from voxelith.sources.tables import TERRAIN_SQL, VOXEL_SQL, terrain
from voxelith.sources.tables import voxels as voxel_table

SIZE = 64
SEA = 60
MIN_OCEAN = 50
MIN_LAND = 30
CROP = [(10.5, 8.0), (50.0, 12.25), (56.0, 50.0), (30.0, 40.0), (12.0, 55.5)]
MASKS = [[(5, 5), (30, 8), (20, 20), (28, 30), (6, 25)], {"coordinates": [(22, 18), (40, 18), (40, 36), (22, 36)]}]
SIGMA = 1.5

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def six(c: Column) -> Column:
    return F.round(c, 6)


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    head = TERRAIN_SQL if not recursive else TERRAIN_SQL.replace("WITH b", "WITH RECURSIVE b", 1)
    return head + "".join(f", {p}" for p in parts) + "\n" + select


def _labels(name: str, where: str) -> str:
    """Cells that meet the condition and their labels, the least cell of each region."""
    return f"""{name}_cells AS (SELECT x, z, z * 64 + x AS id FROM terrain WHERE {where}),
{name}_edges AS (
  SELECT a.id a, b.id b FROM {name}_cells a JOIN {name}_cells b
    ON abs(a.x - b.x) + abs(a.z - b.z) = 1 AND abs(a.x - b.x) <= 1),
{name}_cc(id, root) USING KEY (id) AS (
  SELECT id, id FROM {name}_cells
  UNION
  SELECT * FROM (
    SELECT e.b, min(c.root) r FROM {name}_cc c JOIN {name}_edges e ON c.id = e.a
      JOIN recurring.{name}_cc o ON o.id = e.b WHERE c.root < o.root GROUP BY e.b)),
{name} AS (SELECT c.x, c.z, l.root FROM {name}_cc l JOIN {name}_cells c USING (id))"""


_SEA_LABELS = _labels("sea", f"h <= {SEA}")
_OCEAN = f"""chosen AS (
  SELECT root FROM sea GROUP BY root
  HAVING count(*) >= {MIN_OCEAN} OR bool_or(x IN (0, 63) OR z IN (0, 63))),
masked AS (
  SELECT t.*, s.root IS NOT NULL AND s.root IN (SELECT root FROM chosen) AS ocean
  FROM terrain t LEFT JOIN sea s USING (x, z))"""


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain(spark, sf_dir, SIZE)


def _ocean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.ocean_mask(_map(spark, sf_dir), SEA, MIN_OCEAN, tile=32)


# Extent, chunks, sea level -------------------------------------------------------------


@query(_with(select="SELECT min(x) x0, max(x) x1, min(z) z0, max(z) z1, max(x) - min(x) + 1 AS width, max(z) - min(z) + 1 AS height, min(h) lo, max(h) hi FROM terrain"))
def terrain_extent(spark, sf_dir):
    return raster.map_extent(_map(spark, sf_dir))


@query(_with(select="SELECT x // 16 cx, z // 16 cz, count(*) n, min(h) lo, max(h) hi, sum(h)::BIGINT total FROM terrain GROUP BY 1, 2"))
def terrain_chunk_stats(spark, sf_dir):
    return raster.to_chunks(_map(spark, sf_dir)).select(
        "cx", "cz", F.size("h").cast("long").alias("n"), F.array_min("h").alias("lo"), F.array_max("h").alias("hi"),
        F.aggregate("h", F.lit(0).cast("long"), lambda t, v: t + v).alias("total"),
    )


@query(_with(select="SELECT x, z, h FROM terrain"))
def chunk_explode_roundtrip(spark, sf_dir):
    return raster.from_chunks(raster.to_chunks(_map(spark, sf_dir)))


_DROPPED = "((x // 16) * 3 + z // 16) % 5 = 0"


def _holes(spark, sf_dir):
    chunks = raster.to_chunks(_map(spark, sf_dir))
    return raster.assemble(chunks.where("(cx * 3 + cz) % 5 <> 0"))


@query(_with(select=f"SELECT x, z, CASE WHEN {_DROPPED} THEN NULL ELSE h END h, {_DROPPED} gap FROM terrain WHERE x BETWEEN 0 AND 63"))
def assemble_missing_chunks(spark, sf_dir):
    return _holes(spark, sf_dir)


@query(
    _with(
        f"holed AS (SELECT x, z, CASE WHEN {_DROPPED} THEN NULL ELSE h END h FROM terrain)",
        "near AS (SELECT a.x, a.z, arg_min(b.h, {'d': (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z), 'z': b.z, 'x': b.x}) h "
        "FROM holed a, holed b WHERE a.h IS NULL AND b.h IS NOT NULL GROUP BY a.x, a.z)",
        select="SELECT x, z, h FROM near UNION ALL SELECT x, z, h FROM holed WHERE h IS NOT NULL",
    )
)
def gap_fill_nearest(spark, sf_dir):
    return raster.fill_gaps(_holes(spark, sf_dir)).select("x", "z", "h")


_LEVEL_SQL = """(SELECT h AS sea_level, count(*) AS n_cells FROM terrain, (SELECT min(h) lo, trunc(quantile_cont(h, 0.6)) hi FROM terrain)
WHERE h BETWEEN lo AND hi GROUP BY h ORDER BY n_cells DESC, h LIMIT 1)"""


@query(_with(select=f"SELECT * FROM {_LEVEL_SQL}"))
def sea_level(spark, sf_dir):
    return raster.sea_level(_map(spark, sf_dir))


@query(_with(select=f"SELECT round(100 * avg(CASE WHEN h <= {SEA} THEN 1 ELSE 0 END), 6) AS percent FROM terrain"))
def water_candidates(spark, sf_dir):
    low = _map(spark, sf_dir).withColumn("low", F.col("h") <= SEA)
    return raster.coverage(low, "low").select(six(F.col("percent")).alias("percent"))


# Regions and masks ---------------------------------------------------------------------


@query(_with(_SEA_LABELS, recursive=True, select="SELECT (root % 64)::INT AS x, (root // 64)::INT AS z, count(*) AS n_cells FROM sea GROUP BY root"))
def water_components(spark, sf_dir):
    found = regions.label_regions(_map(spark, sf_dir).where(F.col("h") <= SEA), tile=32)
    sizes = regions.region_sizes(found)
    return sizes.select(
        (F.col("region") % regions.SPAN - regions.OFFSET).cast("int").alias("x"),
        (F.expr(f"region div {regions.SPAN}") - regions.OFFSET).cast("int").alias("z"), "n_cells",
    )


@query(_with(_SEA_LABELS, _OCEAN, recursive=True, select="SELECT x, z, ocean FROM masked"))
def ocean_mask(spark, sf_dir):
    return _ocean(spark, sf_dir).select("x", "z", "ocean")


@query(
    _with(
        _labels("sea", f"h <= {SEA} AND (x * 7 + z * 5) % 11 <> 0"), _OCEAN, recursive=True, select="SELECT x, z, ocean FROM masked"
    )
)
def ocean_mask_with_water(spark, sf_dir):
    wet = _map(spark, sf_dir).withColumn("water", F.expr("(x * 7 + z * 5) % 11 <> 0"))
    return regions.ocean_mask(wet, SEA, MIN_OCEAN, water=True, tile=32).select("x", "z", "ocean")


@query(
    _with(
        _SEA_LABELS, _OCEAN,
        "d AS (SELECT m.x, m.z, count(*) FILTER (WHERE n.ocean) n FROM masked m, masked n "
        "WHERE abs(m.x - n.x) <= 1 AND abs(m.z - n.z) <= 1 GROUP BY 1, 2)",
        recursive=True, select="SELECT x, z, n = 9 AS ocean FROM d",
    )
)
def ocean_eroded(spark, sf_dir):
    return raster.erode(_ocean(spark, sf_dir).select("x", "z", "ocean"), "ocean", 1)


@query(
    _with(
        _SEA_LABELS, _OCEAN,
        "d AS (SELECT m.x, m.z, bool_or(n.ocean) ocean FROM masked m, masked n WHERE abs(m.x - n.x) + abs(m.z - n.z) <= 1 GROUP BY 1, 2)",
        recursive=True, select="SELECT x, z, ocean FROM d",
    )
)
def ocean_dilated(spark, sf_dir):
    return stencils.dilate(_ocean(spark, sf_dir).select("x", "z", "ocean"), "ocean")


_LAND = f"""land_cells AS (SELECT x, z, z * 64 + x AS id FROM masked WHERE NOT ocean),
land_edges AS (SELECT a.id a, b.id b FROM land_cells a JOIN land_cells b ON abs(a.x - b.x) + abs(a.z - b.z) = 1 AND abs(a.x - b.x) <= 1),
land_cc(id, root) USING KEY (id) AS (
  SELECT id, id FROM land_cells
  UNION
  SELECT * FROM (SELECT e.b, min(c.root) r FROM land_cc c JOIN land_edges e ON c.id = e.a
    JOIN recurring.land_cc o ON o.id = e.b WHERE c.root < o.root GROUP BY e.b)),
small AS (SELECT root FROM land_cc GROUP BY root HAVING count(*) < {MIN_LAND}),
sunk AS (SELECT (id % 64)::INT x, (id // 64)::INT z FROM land_cc WHERE root IN (SELECT root FROM small))"""


@query(
    _with(
        _SEA_LABELS, _OCEAN, _LAND, recursive=True,
        select="SELECT m.x, m.z, m.ocean OR s.x IS NOT NULL AS ocean FROM masked m LEFT JOIN sunk s ON m.x = s.x AND m.z = s.z",
    )
)
def micro_islands(spark, sf_dir):
    return regions.remove_small_islands(_ocean(spark, sf_dir), MIN_LAND, tile=32).select("x", "z", "ocean")


_DROP = 2


@query(
    _with(
        f"top AS (SELECT max(h) t FROM terrain), {_labels('high', f'h >= (SELECT t FROM top) - {_DROP}')}",
        "rims AS (SELECT a.root, max(t.h) rim FROM high a JOIN terrain t ON abs(a.x - t.x) + abs(a.z - t.z) = 1 "
        "LEFT JOIN high o ON o.x = t.x AND o.z = t.z WHERE o.root IS NULL OR o.root <> a.root GROUP BY 1)",
        "lows AS (SELECT root, min(h) low FROM high JOIN terrain USING (x, z) GROUP BY 1)",
        f"sunk AS (SELECT root, rim FROM lows JOIN rims USING (root) WHERE low - rim > {_DROP})",
        recursive=True,
        select="SELECT x, z, coalesce(rim, h)::INT h FROM terrain LEFT JOIN (SELECT x, z, rim FROM high JOIN sunk USING (root)) USING (x, z)",
    )
)
def floating_clusters(spark, sf_dir):
    return regions.remove_floating(_map(spark, sf_dir), _DROP, tile=32).select("x", "z", "h")


@query(
    _with(
        _SEA_LABELS, _OCEAN, recursive=True,
        select=f"SELECT CASE WHEN ocean THEN 'ocean' WHEN h <= {SEA} THEN 'lake' ELSE 'land' END AS kind, "
        f"count(*) AS n_cells, sum(CASE WHEN ocean THEN {SEA} ELSE h END)::BIGINT AS total FROM masked GROUP BY 1",
    )
)
def ocean_flatten(spark, sf_dir):
    cells = _ocean(spark, sf_dir)
    kind = F.when(F.col("ocean"), "ocean").when(F.col("h") <= SEA, "lake").otherwise("land")
    flat = raster.flatten_ocean(cells.withColumn("kind", kind), SEA)
    return flat.groupBy("kind").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("h").alias("total"))


@query(_with(_SEA_LABELS, _OCEAN, recursive=True, select=f"SELECT min(h - {SEA}) AS lowest, max(h - {SEA}) AS highest FROM masked WHERE NOT ocean"))
def land_range(spark, sf_dir):
    return raster.land_range(_ocean(spark, sf_dir), SEA)


# Polygons ------------------------------------------------------------------------------


def _crossings(points) -> str:
    parts = []
    for (ax, az), (bx, bz) in zip(points, [points[-1], *points[:-1]], strict=True):
        parts.append(f"(CASE WHEN ({az} > z) <> ({bz} > z) AND x < {bx - ax}::DOUBLE * (z - {az}) / {bz - az}::DOUBLE + {ax} THEN 1 ELSE 0 END)")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query("SELECT rx, rz FROM (SELECT a.range - 3 AS rx, b.range - 3 AS rz FROM range(7) a, range(7) b) WHERE rx * 512 + 511 >= -600 AND rx * 512 <= 700 AND rz * 512 + 511 >= 100 AND rz * 512 <= 513")
def region_prune(spark, sf_dir):
    files = spark.range(49).select((F.col("id") % 7 - 3).alias("rx"), (F.expr("id div 7") - 3).alias("rz"))
    return raster.prune_regions(files, [(-600, 100), (700, 100), (0.5, 512.2)])


@query(
    _with(
        select=f"SELECT x, z, inside, CASE WHEN inside THEN h ELSE lo END h FROM (SELECT x, z, h, {_crossings(CROP)} AS inside, "
        f"(SELECT min(h) FROM terrain) lo FROM terrain WHERE x BETWEEN 10 AND 56 AND z BETWEEN 8 AND 56)"
    )
)
def crop_polygon(spark, sf_dir):
    return raster.crop(_map(spark, sf_dir).select("x", "z", "h"), CROP).select("x", "z", "inside", "h")


def _hull_sql(polygon) -> str:
    points = polygon["coordinates"] if isinstance(polygon, dict) else polygon
    corners = convex_hull(points)
    return " AND ".join(
        f"({bx - ax} * (z - {az}) - {bz - az} * (x - {ax}) >= -1e-9)"
        for (ax, az), (bx, bz) in zip(corners, [*corners[1:], corners[0]], strict=True)
    )


@query(_with(select=f"SELECT x, z, ({_hull_sql(MASKS[0])}) OR ({_hull_sql(MASKS[1])}) AS ocean, CASE WHEN ({_hull_sql(MASKS[0])}) OR ({_hull_sql(MASKS[1])}) THEN {SEA} ELSE h END AS h FROM terrain"))
def polygon_hull_mask(spark, sf_dir):
    return raster.mask_polygons(_map(spark, sf_dir).select("x", "z", "h"), MASKS, SEA)


@query(_with(select=f"SELECT (count(*) FILTER (WHERE {_hull_sql(MASKS[0])}) + count(*) FILTER (WHERE {_hull_sql(MASKS[1])}))::BIGINT AS masked FROM terrain"))
def polygon_cells_counted(spark, sf_dir):
    return raster.masked_total(_map(spark, sf_dir), MASKS)


# Stencils ------------------------------------------------------------------------------


@query(
    _with(
        "o AS (SELECT a.range - 1 dx, b.range - 1 dz FROM range(3) a, range(3) b)",
        select="SELECT t.x, t.z, median(n.h)::DOUBLE AS h FROM terrain t, o JOIN terrain n ON n.x = greatest(0, least(63, t.x + dx)) AND n.z = greatest(0, least(63, t.z + dz)) GROUP BY 1, 2",
    )
)
def median3x3(spark, sf_dir):
    return stencils.median3(_map(spark, sf_dir).select("x", "z", F.col("h").cast("double").alias("h")))


def _blur_sql(source: str, sigma: float, name: str) -> str:
    weights = stencils.gaussian_weights(sigma)
    radius = len(weights) // 2
    values = ", ".join(f"({i - radius}, {w!r}::DOUBLE)" for i, w in enumerate(map(float, weights)))
    mirror = "least(((k % 128) + 128) % 128, 127 - ((k % 128) + 128) % 128)"
    return f"""{name}_w AS (SELECT * FROM (VALUES {values}) v(d, w)),
{name}_1 AS (SELECT t.x, t.z, sum(w * n.h) h FROM (SELECT x, z, z + d k, w FROM {source}, {name}_w) t JOIN {source} n ON n.x = t.x AND n.z = {mirror.replace("k", "t.k")} GROUP BY 1, 2),
{name} AS (SELECT t.x, t.z, sum(w * n.h) h FROM (SELECT x, z, x + d k, w FROM {name}_1, {name}_w) t JOIN {name}_1 n ON n.z = t.z AND n.x = {mirror.replace("k", "t.k")} GROUP BY 1, 2)"""


@query(_with(_blur_sql("terrain", SIGMA, "soft"), select="SELECT x, z, round(h, 6) AS h FROM soft"))
def gaussian_blur(spark, sf_dir):
    return stencils.gaussian(_map(spark, sf_dir), SIGMA).select("x", "z", six(F.col("h")).alias("h"))


def _linear_sql(source: str, name: str, n_out: int, n_in: int = 64) -> str:
    step = (n_in - 1) / (n_out - 1)
    return f"""{name}_o AS (SELECT a.range x, b.range z, a.range * {step!r}::DOUBLE fx, b.range * {step!r}::DOUBLE fz FROM range({n_out}) a, range({n_out}) b),
{name}_i AS (SELECT *, least(floor(fx), {n_in - 2})::INT ix, least(floor(fz), {n_in - 2})::INT iz FROM {name}_o),
{name} AS (SELECT o.x::INT x, o.z::INT z, sum(t.h * (CASE WHEN t.x = o.ix THEN 1 - (fx - ix) ELSE fx - ix END) * (CASE WHEN t.z = o.iz THEN 1 - (fz - iz) ELSE fz - iz END)) h
  FROM {name}_i o JOIN {source} t ON t.x IN (o.ix, o.ix + 1) AND t.z IN (o.iz, o.iz + 1) GROUP BY 1, 2)"""


@query(_with(_linear_sql("terrain", "lin", 41), select="SELECT x, z, round(h, 6) AS h FROM lin"))
def resample_linear(spark, sf_dir):
    return stencils.resample_linear(_map(spark, sf_dir), SIZE, SIZE, 41, 41).select("x", "z", six(F.col("h")).alias("h"))


@query(_with(select=f"SELECT a.range::INT x, b.range::INT z, t.h FROM range(41) a, range(41) b, terrain t WHERE t.x = floor(a.range * {63 / 40!r}::DOUBLE + 0.5) AND t.z = floor(b.range * {63 / 40!r}::DOUBLE + 0.5)"))
def resample_nearest(spark, sf_dir):
    return stencils.resample_nearest(_map(spark, sf_dir), SIZE, SIZE, 41, 41, "h")


@query(_with(_blur_sql("terrain", 0.5 * 64 / 40, "soft"), _linear_sql("soft", "lin", 40), select="SELECT x, z, round(h, 6) AS h FROM lin"))
def downsample(spark, sf_dir):
    out, _, _ = stencils.downsample(_map(spark, sf_dir), SIZE, SIZE, 40)
    return out.select("x", "z", six(F.col("h")).alias("h"))


# Colours -------------------------------------------------------------------------------


def _lerp(a: int, b: int, t: str) -> str:
    return f"trunc(greatest(0, least(255, {float(a)} * (1 - {t}) + {float(b)} * {t})))::INT"


def _rgb_sql() -> str:
    low = f"greatest(0.0, least(1.0, (h - lo) / greatest({SEA} - lo, 1e-6)))"
    high = f"greatest(0.0, least(1.0, (h - {SEA}) / greatest(hi - {SEA}, 1e-6)))"
    deep, sea, top, ocean = (0, 30, 80), (20, 160, 60), (200, 30, 30), (30, 80, 160)
    return ", ".join(
        f"CASE WHEN ocean THEN {ocean[i]} WHEN h < {SEA} THEN {_lerp(deep[i], sea[i], low)} ELSE {_lerp(sea[i], top[i], high)} END AS {c}"
        for i, c in enumerate("rgb")
    )


_SPAN = "span AS (SELECT min(h)::DOUBLE lo, max(h)::DOUBLE hi FROM terrain), px AS (SELECT m.x, m.z, m.h::DOUBLE h, m.ocean, lo, hi FROM masked m, span)"


def _pixels(spark, sf_dir):
    cells = _ocean(spark, sf_dir)
    span = cells.agg(F.min("h").cast("double").alias("lo"), F.max("h").cast("double").alias("hi"))
    return cells.withColumn("h", F.col("h").cast("double")).crossJoin(F.broadcast(span))


@query(_with(_SEA_LABELS, _OCEAN, _SPAN, recursive=True, select=f"SELECT x, z, {_rgb_sql()} FROM px"))
def color_ramp(spark, sf_dir):
    rgb = elevation_rgb(F.col("h"), F.col("ocean"), F.col("lo"), F.col("hi"), F.lit(float(SEA)))
    return _pixels(spark, sf_dir).select("x", "z", rgb.alias("c")).select("x", "z", "c.*")


@query(_with(_SEA_LABELS, _OCEAN, _SPAN, recursive=True, select="SELECT x, z, CASE WHEN ocean THEN 0 ELSE trunc(greatest(0.0, least(1.0, (h - lo) / (hi - lo))) * 255)::INT END AS gray FROM px"))
def gray_ramp(spark, sf_dir):
    return _pixels(spark, sf_dir).select("x", "z", gray(F.col("h"), F.col("ocean"), F.col("lo"), F.col("hi")).alias("gray"))


@query(_with(select=f"SELECT x, z, CASE WHEN {_crossings(CROP)} THEN 255 ELSE 0 END AS a FROM terrain WHERE x BETWEEN 10 AND 56 AND z BETWEEN 8 AND 56"))
def alpha_crop(spark, sf_dir):
    return raster.crop(_map(spark, sf_dir).select("x", "z", "h"), CROP).select("x", "z", alpha(F.col("inside")).alias("a"))


# Meshes --------------------------------------------------------------------------------


@query(_with(_SEA_LABELS, _OCEAN, recursive=True, select=f"SELECT x, z, round(CASE WHEN ocean THEN {SEA} - 3.0 ELSE {SEA} + (h - {SEA}) * 1.5 END, 6) AS h FROM masked"))
def mesh_heights(spark, sf_dir):
    raised, _ = mesh.mesh_heights(_ocean(spark, sf_dir), 1.5, SEA, 3.0)
    return raised.select("x", "z", six(F.col("h")).alias("h"))


@query(_with(_SEA_LABELS, _OCEAN, recursive=True, select="SELECT round(min(h)::DOUBLE, 6) AS lo, round((max(h) - min(h))::DOUBLE, 6) AS span, round(10.0 / (max(h) - min(h)), 6) AS z_scale FROM (SELECT CASE WHEN ocean THEN (SELECT min(h) FROM masked) ELSE h END h FROM masked)"))
def mesh_heights_fit_z(spark, sf_dir):
    _, facts = mesh.mesh_heights(_ocean(spark, sf_dir), fit_z=10.0)
    return facts.select(six(F.col("lo")).alias("lo"), six(F.col("span")).alias("span"), six(F.col("z_scale")).alias("z_scale"))


_STEP = mesh.scale_to_fit(100.0, 100.0, SIZE, SIZE)


def _triangles(spark, sf_dir):
    cells = _map(spark, sf_dir).withColumn("ocean", F.lit(False))
    raised, facts = mesh.mesh_heights(cells, fit_z=10.0)
    return mesh.solid_triangles(mesh.vertices(raised, facts, _STEP, 2.0, rows=SIZE))


def _flat(v: str) -> list[Column]:
    return [F.round(F.col(f"{v}.{i}").cast("double"), 3).alias(f"{v}{i}") for i in "xyz"]


_VERTEX_SQL = f"""v AS (
  SELECT 63 - z AS r, x AS c, (h - lo) * 10.0 / (hi - lo) + 2.0 AS zz FROM terrain, (SELECT min(h) lo, max(h) hi FROM terrain)),
p AS (SELECT r, c, {{'x': (c * {_STEP!r}::DOUBLE)::FLOAT, 'y': (r * {_STEP!r}::DOUBLE)::FLOAT, 'z': zz::FLOAT}} AS t,
  {{'x': (c * {_STEP!r}::DOUBLE)::FLOAT, 'y': (r * {_STEP!r}::DOUBLE)::FLOAT, 'z': 0::FLOAT}} AS f FROM v),
q AS (SELECT a.r, a.c, a.t a, a.f fa, b.t b, b.f fb, d.t d, d.f fd, e.t e, e.f fe FROM p a
  LEFT JOIN p b ON b.r = a.r AND b.c = a.c + 1 LEFT JOIN p d ON d.r = a.r + 1 AND d.c = a.c LEFT JOIN p e ON e.r = a.r + 1 AND e.c = a.c + 1),
tri AS (
  SELECT 'top' side, r, c, 0 k, a v0, b v1, e v2 FROM q WHERE e IS NOT NULL UNION ALL SELECT 'top', r, c, 1, a, e, d FROM q WHERE e IS NOT NULL
  UNION ALL SELECT 'bottom', r, c, 0, fa, fe, fb FROM q WHERE e IS NOT NULL UNION ALL SELECT 'bottom', r, c, 1, fa, fd, fe FROM q WHERE e IS NOT NULL
  UNION ALL SELECT 'west', r, c, 0, a, fd, fa FROM q WHERE c = 0 AND d IS NOT NULL UNION ALL SELECT 'west', r, c, 1, a, d, fd FROM q WHERE c = 0 AND d IS NOT NULL
  UNION ALL SELECT 'east', r, c, 0, a, fa, fd FROM q WHERE c = 63 AND d IS NOT NULL UNION ALL SELECT 'east', r, c, 1, a, fd, d FROM q WHERE c = 63 AND d IS NOT NULL
  UNION ALL SELECT 'first', r, c, 0, a, fa, fb FROM q WHERE r = 0 AND b IS NOT NULL UNION ALL SELECT 'first', r, c, 1, a, fb, b FROM q WHERE r = 0 AND b IS NOT NULL
  UNION ALL SELECT 'last', r, c, 0, a, fb, fa FROM q WHERE r = 63 AND b IS NOT NULL UNION ALL SELECT 'last', r, c, 1, a, b, fb FROM q WHERE r = 63 AND b IS NOT NULL)"""


@query(_with(_VERTEX_SQL, select="SELECT side, r, c, k, " + ", ".join(f"round({v}.{i}::DOUBLE, 3) AS {v}{i}" for v in ("v0", "v1", "v2") for i in "xyz") + " FROM tri"))
def solid_triangles(spark, sf_dir):
    return _triangles(spark, sf_dir).select("side", "r", "c", "k", *_flat("v0"), *_flat("v1"), *_flat("v2"))


@query(_with(_VERTEX_SQL, select="SELECT side, count(*) AS n FROM tri GROUP BY side"))
def triangle_counts(spark, sf_dir):
    return _triangles(spark, sf_dir).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


_CROSS = {
    "x": "(v1.y::DOUBLE - v0.y) * (v2.z::DOUBLE - v0.z) - (v1.z::DOUBLE - v0.z) * (v2.y::DOUBLE - v0.y)",
    "y": "(v1.z::DOUBLE - v0.z) * (v2.x::DOUBLE - v0.x) - (v1.x::DOUBLE - v0.x) * (v2.z::DOUBLE - v0.z)",
    "z": "(v1.x::DOUBLE - v0.x) * (v2.y::DOUBLE - v0.y) - (v1.y::DOUBLE - v0.y) * (v2.x::DOUBLE - v0.x)",
}


@query(_with(_VERTEX_SQL, f"n AS (SELECT side, r, c, k, {_CROSS['x']} nx, {_CROSS['y']} ny, {_CROSS['z']} nz FROM tri)", select="SELECT side, r, c, k, " + ", ".join(f"round(n{i} / sqrt(nx * nx + ny * ny + nz * nz), 4) + 0.0 AS n{i}" for i in "xyz") + " FROM n"))
def triangle_normals(spark, sf_dir):
    n = _triangles(spark, sf_dir).withColumn("n", mesh.normal())
    return n.select("side", "r", "c", "k", *[(F.round(F.col(f"n.{i}").cast("double"), 4) + 0.0).alias(f"n{i}") for i in "xyz"])


_BOXES = mesh.border_boxes(100.0, 80.0, 4.5, 14.25)
_BOX_VALUES = ", ".join(f"({i}, " + ", ".join(f"{v!r}::DOUBLE" for v in b) + ")" for i, b in enumerate(_BOXES))


def _boxes(spark) -> DataFrame:
    return spark.createDataFrame([(i, *b) for i, b in enumerate(_BOXES)], "box int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")


@query(f"SELECT box, x0, x1, y0, y1, z0, z1 FROM (VALUES {_BOX_VALUES}) v(box, x0, x1, y0, y1, z0, z1)")
def border_boxes(spark, sf_dir):
    return _boxes(spark)


@query(f"SELECT box, 12::BIGINT AS n, round((x1 - x0) * (y1 - y0) * (z1 - z0), 3) AS volume FROM (VALUES {_BOX_VALUES}) v(box, x0, x1, y0, y1, z0, z1)")
def box_triangles(spark, sf_dir):
    """The volume that the faces enclose, by signed tetrahedra, must be the box's."""
    def d(v: str, i: str) -> Column:
        return F.col(f"{v}.{i}").cast("double")

    six_volume = (
        d("v0", "x") * (d("v1", "y") * d("v2", "z") - d("v1", "z") * d("v2", "y"))
        - d("v0", "y") * (d("v1", "x") * d("v2", "z") - d("v1", "z") * d("v2", "x"))
        + d("v0", "z") * (d("v1", "x") * d("v2", "y") - d("v1", "y") * d("v2", "x"))
    )
    faces = mesh.box_triangles(_boxes(spark))
    return faces.groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(six_volume) / 6, 3).alias("volume"))


_PLAN = mesh.TilePlan(SIZE, SIZE, mesh.scale_to_fit(100.0, 100.0, SIZE, SIZE, 3), 40.0, 40.0, 3)
_WINDOWS = f"""w AS (SELECT a.range::INT tz, b.range::INT tx, b.range * {_PLAN.stride_c} c0, least((b.range + 1) * {_PLAN.stride_c}, 69) c1,
  a.range * {_PLAN.stride_r} r0, least((a.range + 1) * {_PLAN.stride_r}, 69) r1 FROM range({_PLAN.down}) a, range({_PLAN.across}) b)"""


@query(_with(_WINDOWS, select="SELECT tz, tx, count(*) AS n, min(t.h) lo, max(t.h) hi FROM w JOIN terrain t ON t.x + 3 BETWEEN c0 AND c1 AND (63 - t.z) + 3 BETWEEN r0 AND r1 GROUP BY 1, 2"))
def mosaic_tiles(spark, sf_dir):
    points = _map(spark, sf_dir).select((F.lit(63) - F.col("z")).alias("r"), F.col("x").alias("c"), "h")
    return _PLAN.place(points).groupBy("tz", "tx").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))


_RING = mesh.border_boxes(63 * _PLAN.step, 63 * _PLAN.step, 3 * _PLAN.step, 15.0)
_RING_VALUES = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in b) + ")" for b in _RING)


@query(
    f"WITH {_WINDOWS}, b AS (SELECT * FROM (VALUES {_RING_VALUES}) v(x0, x1, y0, y1, z0, z1)), "
    f"k AS (SELECT tz, tx, greatest(x0, c0 * {_PLAN.step!r}::DOUBLE) x0, least(x1, c1 * {_PLAN.step!r}::DOUBLE) x1, "
    f"greatest(y0, r0 * {_PLAN.step!r}::DOUBLE) y0, least(y1, r1 * {_PLAN.step!r}::DOUBLE) y1 FROM w, b) "
    "SELECT tz, tx, round(x0, 6) x0, round(x1, 6) x1, round(y0, 6) y0, round(y1, 6) y1 FROM k WHERE x1 > x0 AND y1 > y0"
)
def tile_box_clip(spark, sf_dir):
    boxes = spark.createDataFrame(_RING, ", ".join(f"{c} double" for c in mesh.BOX_COLUMNS))
    cut = mesh.clip_boxes(boxes, _PLAN.windows(spark), _PLAN.step)
    return cut.select("tz", "tx", *[six(F.col(c)).alias(c) for c in ("x0", "x1", "y0", "y1")])


@query(_with(_SEA_LABELS, _OCEAN, _WINDOWS, recursive=True, select="SELECT tz, tx, bool_and(ocean) AS all_ocean FROM w JOIN masked t ON t.x + 3 BETWEEN c0 AND c1 AND (63 - t.z) + 3 BETWEEN r0 AND r1 GROUP BY 1, 2"))
def tiles_all_ocean(spark, sf_dir):
    points = _ocean(spark, sf_dir).select((F.lit(63) - F.col("z")).alias("r"), F.col("x").alias("c"), "ocean")
    return mesh.ocean_tiles(_PLAN.place(points))


@query(f"WITH {_WINDOWS} SELECT tz, tx FROM w WHERE (tz + tx) % 3 <> 0")
def tiles_remaining(spark, sf_dir):
    windows = _PLAN.windows(spark).select("tz", "tx")
    return windows.join(windows.where("(tz + tx) % 3 = 0"), ["tz", "tx"], "left_anti")


# Voxels --------------------------------------------------------------------------------


@query(VOXEL_SQL + " SELECT x, z, coalesce(max(CASE WHEN name NOT IN ('minecraft:air', 'minecraft:cave_air', 'minecraft:void_air') THEN y END) + 1, 0) AS h FROM voxels GROUP BY 1, 2")
def voxel_surface(spark, sf_dir):
    return voxels.surface(voxel_table(spark, sf_dir))


_NO_GROUND_SQL = "name IN ('minecraft:air', 'minecraft:cave_air', 'minecraft:void_air') OR (name <> 'minecraft:grass_block' AND regexp_matches(regexp_extract(name, '[^:]*$'), '" + "|".join(NO_GROUND) + "'))"


@query(VOXEL_SQL + f" SELECT x, z, coalesce(max(CASE WHEN NOT ({_NO_GROUND_SQL}) THEN y END) + 1, 0) AS h FROM voxels GROUP BY 1, 2")
def voxel_surface_ground(spark, sf_dir):
    return voxels.surface(voxel_table(spark, sf_dir), ground_only=True)


@query(VOXEL_SQL + ", s AS (SELECT x, z, coalesce(max(CASE WHEN name <> 'minecraft:air' THEN y END) + 1, 0) AS h FROM voxels GROUP BY 1, 2) SELECT s.x, s.z, s.h, coalesce(v.name = 'minecraft:water', false) AS water FROM s LEFT JOIN voxels v ON v.x = s.x AND v.z = s.z AND v.y = s.h - 1")
def voxel_is_water(spark, sf_dir):
    blocks = voxel_table(spark, sf_dir)
    return voxels.surface_water(blocks, voxels.surface(blocks))


@query(
    VOXEL_SQL
    + f""", solid AS (SELECT x, y, z, (y * 32 + z) * 32 + x AS id FROM voxels WHERE NOT ({_NO_GROUND_SQL})),
e AS (SELECT a.id a, b.id b FROM solid a JOIN solid b ON a.x // 16 = b.x // 16 AND a.z // 16 = b.z // 16
  AND ((b.x = a.x AND b.z = a.z AND b.y IN (a.y - 1, a.y + 1)) OR (b.y = a.y AND b.z = a.z AND b.x IN (a.x - 1, a.x + 1)) OR (b.y = a.y AND b.x = a.x AND b.z IN (a.z - 1, a.z + 1)))),
reach(id) AS (SELECT id FROM solid WHERE y < 16 UNION SELECT e.b FROM reach JOIN e ON e.a = reach.id)
SELECT (id % 32)::INT x, (id // 32 % 32)::INT z, count(*) AS n_grounded, max(id // 1024)::INT + 1 AS h FROM reach GROUP BY 1, 2"""
)
def voxel_grounded(spark, sf_dir):
    blocks = voxel_table(spark, sf_dir)
    found = regions.grounded(blocks.where(~is_no_ground(F.col("name"))).select("x", "y", "z"), floor=0).where("grounded")
    return found.groupBy("x", "z").agg(F.count(F.lit(1)).alias("n_grounded"), (F.max("y") + 1).alias("h"))


# Packed longs --------------------------------------------------------------------------


_VALUE = "(l_orderkey * 2654435761 + l_partkey * 40503 + l_linenumber * 97) % 2000000011 * 4611686017 - 4611686018427387904"


def _longs(spark, sf_dir, n: int) -> DataFrame:
    """Arrays of n longs from each supplier's order lines in order of value; the last may be shorter."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    whole = lines.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.expr(_VALUE))).alias("w"))
    part = whole.select("l_suppkey", "w", F.explode(F.expr(f"sequence(0, cast((size(w) - 1) div {n} as int))")).alias("part"))
    return part.select("l_suppkey", "part", F.slice("w", F.col("part") * n + 1, n).alias("a"))


_LONGS_SQL = f"""WITH w AS (SELECT l_suppkey, list_sort(list({_VALUE})) AS w FROM lineitem GROUP BY 1),
a AS (SELECT l_suppkey, k::INT AS part, w[k * {{n}} + 1 : k * {{n}} + {{n}}] AS a FROM (SELECT l_suppkey, w, unnest(range((len(w) - 1) // {{n}} + 1)) AS k FROM w)),
u AS (SELECT l_suppkey, part, len(a) AS n, list_transform(a, lambda v: CASE WHEN v < 0 THEN v::HUGEINT + 18446744073709551616 ELSE v::HUGEINT END) AS u FROM a)"""


@query(_LONGS_SQL.format(n=37) + " SELECT l_suppkey, part, i::INT AS i, ((coalesce(u[i // 7 + 1], 0) >> ((i % 7) * 9)::INT) & 511)::INT AS v FROM u, (SELECT unnest(range(256)) AS i)")
def unpack_aligned_longs(spark, sf_dir):
    return _longs(spark, sf_dir, 37).select("l_suppkey", "part", F.posexplode(unpack_aligned("a", 9, 256)).alias("i", "v"))


@query(
    _LONGS_SQL.format(n=36)
    + " SELECT l_suppkey, part, i::INT AS i, (((coalesce(u[i * 9 // 64 + 1], 0) >> ((i * 9) % 64)::INT) | CASE WHEN (i * 9) % 64 > 55 THEN (coalesce(u[i * 9 // 64 + 2], 0) & 511) << (64 - (i * 9) % 64)::INT ELSE 0 END) & 511)::INT AS v FROM u, (SELECT unnest(range(256)) AS i)"
)
def unpack_compact_longs(spark, sf_dir):
    return _longs(spark, sf_dir, 36).select("l_suppkey", "part", F.posexplode(unpack_stream("a", 9, 256)).alias("i", "v"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from voxelith.plans import saves  # noqa: E402, F401  registers its queries with query()
