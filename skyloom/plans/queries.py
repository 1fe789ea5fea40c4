"""Queries of the engine's operators over the stand-in tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import camera, geo, grid, projections, scalar
from ..operators import fits, frames, fusion, governance, ordered, orientation, poisson, raster, spatial, structure, views
from ..operators.asof import asof_lerp
from ..sinks import text as text_sink
from ..sinks.products import byte_colors, las_colors
from ..sources import runs, telemetry
from . import fixtures as fx
from . import mission

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def rounded(c: str, n: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return (F.round(F.col(c), n) + F.lit(0.0)).alias(c)


# Grids


def _grid(agg: str) -> Query:
    return lambda s, d: raster.elevation_grid(fx.cloud(s, d), fx.CLOUD, agg).select("row", "col", rounded("z", 8), "n")


for _agg, _sql in (("max", "max"), ("min", "min"), ("mean", "avg")):
    query(f"WITH {fx.POINTS}, {fx.CELLS} SELECT \"row\", col, round({_sql}(z), 8) + 0e0 AS z, count(*) AS n FROM inside GROUP BY ALL", f"grid_dsm_{_agg}")(_grid(_agg))


@query(f"WITH {fx.POINTS}, {fx.CELLS} SELECT \"row\", col, floor(sum(r) / count(*)::DOUBLE)::SMALLINT AS r, floor(sum(g) / count(*)::DOUBLE)::SMALLINT AS g, floor(sum(b) / count(*)::DOUBLE)::SMALLINT AS b FROM inside GROUP BY ALL")
def grid_ortho_mean(s, d):
    return raster.ortho_grid(fx.cloud(s, d), fx.CLOUD)


@query(f"WITH {fx.POINTS}, {fx.CELLS} SELECT round(count(*) / 2000e0, 6) AS coverage FROM (SELECT DISTINCT \"row\", col FROM inside)")
def grid_coverage(s, d):
    return raster.coverage(raster.elevation_grid(fx.cloud(s, d), fx.CLOUD), fx.CLOUD).select(rounded("coverage"))


@query(f"WITH {fx.POINTS} SELECT count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM cloud")
def cloud_bounds(s, d):
    return raster.bounds(fx.cloud(s, d))


def _opening_sql(k: int) -> str:
    a, b = k // 2, k - 1 - k // 2
    passes = ["SELECT \"row\", col, coalesce(z, (SELECT max(z) FROM g)) AS v0 FROM (SELECT r AS \"row\", c AS col FROM range(40) t(r), range(50) u(c)) LEFT JOIN g USING (\"row\", col)"]
    sql = f"p0 AS ({passes[0]})"
    for i, (how, axis) in enumerate((("min", "col"), ("min", "\"row\""), ("max", "col"), ("max", "\"row\""))):
        other = "\"row\"" if axis == "col" else "col"
        frame = f"OVER (PARTITION BY {other} ORDER BY {axis} RANGE BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
        sql += f", p{i + 1} AS (SELECT \"row\", col, {how}(v0) {frame} AS v0 FROM p{i})"
    return f"WITH {fx.POINTS}, {fx.CELLS}, g AS (SELECT \"row\", col, max(z) AS z FROM inside GROUP BY ALL), {sql} SELECT \"row\"::INT AS \"row\", col::INT AS col, round(v0, 6) + 0e0 AS dtm FROM p4"


def _opening(k: int) -> Query:
    return lambda s, d: raster.opening(raster.elevation_grid(fx.cloud(s, d), fx.CLOUD), fx.CLOUD, k).select("row", "col", rounded("dtm"))


for _k in (3, 4, 12):
    query(_opening_sql(_k), f"dtm_opening_k{_k}")(_opening(_k))


@query(f"WITH {fx.POINTS} SELECT round(quantile_cont(z, 0.01) - 2e0, 6) AS z_lo, round(quantile_cont(z, 0.99) + 2e0, 6) AS z_hi FROM cloud")
def zband(s, d):
    return raster.z_band(fx.cloud(s, d), 2.0).select(rounded("z_lo"), rounded("z_hi"))


@query(f"WITH {fx.POINTS}, b AS (SELECT quantile_cont(z, 0.1) - 1e0 AS lo, quantile_cont(z, 0.8) + 1e0 AS hi FROM cloud) SELECT count(*) AS n, round(sum(z), 4) AS z FROM cloud, b WHERE z >= lo AND z < hi")
def zband_clip(s, d):
    c = fx.cloud(s, d)
    return raster.clip_band(c, raster.z_band(c, 1.0, 10.0, 80.0)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("z"))


@query(f"WITH {fx.POINTS}, m AS (SELECT min(x) - 1e0 AS x0, min(y) - 1e0 AS y0, min(z) - 1e0 AS z0 FROM cloud) SELECT floor((x - x0) / 2e0)::BIGINT AS vx, floor((y - y0) / 2e0)::BIGINT AS vy, floor((z - z0) / 2e0)::BIGINT AS vz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS n FROM cloud, m GROUP BY ALL")
def voxel_downsample(s, d):
    return raster.voxel_downsample(fx.cloud(s, d), 2.0).select("vx", "vy", "vz", rounded("x", 9), rounded("y", 9), rounded("z", 9), "n")


@query(f"WITH {fx.POINTS}, t AS (SELECT quantile_cont(z, 0.05) AS q FROM cloud) SELECT count(*) AS n, round(min(z), 6) AS z_min FROM cloud, t WHERE z >= q")
def density_crop(s, d):
    return raster.density_crop(fx.cloud(s, d), 0.05, "z").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("z"), 6).alias("z_min"))


@query(f"WITH {fx.POINTS}, t AS (SELECT max(greatest(r, g, b)) AS top FROM cloud) SELECT x, y, z, (r << CASE WHEN top <= 255 THEN 8 ELSE 0 END)::INT AS r, (g << CASE WHEN top <= 255 THEN 8 ELSE 0 END)::INT AS g, (b << CASE WHEN top <= 255 THEN 8 ELSE 0 END)::INT AS b FROM cloud, t")
def color_widen(s, d):
    return las_colors(fx.cloud(s, d))


@query("SELECT l_orderkey, l_linenumber, least(255, greatest(0, floor(l_discount * CASE WHEN (SELECT max(greatest(l_discount, l_tax)) FROM lineitem) <= 1.000001 THEN 255e0 ELSE 1e0 END)))::SMALLINT AS r FROM lineitem")
def color_bytes(s, d):
    li = fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("r"), F.col("l_tax").alias("g"), F.lit(0.0).alias("b"))
    return byte_colors(li).select("l_orderkey", "l_linenumber", "r")


@query(f"WITH {fx.POINTS}, {fx.CELLS}, g AS (SELECT DISTINCT \"row\", col FROM inside) SELECT (SELECT count(*) FROM g) AS n_vertices, 2 * count(*) AS n_faces FROM g a JOIN g b ON b.\"row\" = a.\"row\" AND b.col = a.col + 1 JOIN g c ON c.\"row\" = a.\"row\" + 1 AND c.col = a.col JOIN g e ON e.\"row\" = a.\"row\" + 1 AND e.col = a.col + 1")
def height_field_mesh(s, d):
    v, f = raster.height_mesh(raster.elevation_grid(fx.cloud(s, d), fx.CLOUD), fx.CLOUD)
    return v.agg(F.count(F.lit(1)).alias("n_vertices")).crossJoin(f.agg(F.count(F.lit(1)).alias("n_faces")))


CHECKPOINTS = "c AS (SELECT p_partkey, (p_partkey % 480) / 1e1 AS x, (p_partkey % 390) / 1e1 AS y, p_retailprice / 2e1 AS alt FROM part), k AS (SELECT *, floor(40e0 - y)::INT AS \"row\", floor(x)::INT AS col FROM c)"


@query(f"WITH {fx.POINTS}, {fx.CELLS}, g AS (SELECT \"row\", col, max(z) AS z FROM inside GROUP BY ALL), {CHECKPOINTS} SELECT count(*) AS n, round(sqrt(avg((z - alt) * (z - alt))), 6) AS rmse, round(avg(abs(z - alt)), 6) AS mae, round(avg(z - alt), 6) AS bias FROM k JOIN g USING (\"row\", col)")
def checkpoint_error(s, d):
    p = fx.table(s, d, "part").select("p_partkey", ((F.col("p_partkey") % 480) / 1e1).alias("x"), ((F.col("p_partkey") % 390) / 1e1).alias("y"), (F.col("p_retailprice") / 2e1).alias("alt"))
    found = raster.sample_grid(p, raster.elevation_grid(fx.cloud(s, d), fx.CLOUD), fx.CLOUD)
    return raster.checkpoint_error(found).select("n", rounded("rmse"), rounded("mae"), rounded("bias"))


@query("SELECT p_partkey, greatest(1, ceil(p_retailprice / 7e0))::INT AS cells, round(CASE WHEN p_size % 5 = 0 THEN p_size / 1e1 ELSE greatest(p_retailprice * 1.1e0 / 2048e0, 5e-2) END, 6) AS voxel FROM part")
def grid_scalars(s, d):
    p = fx.table(s, d, "part")
    override = F.when(F.col("p_size") % 5 == 0, F.col("p_size") / 1e1).otherwise(F.lit(0.0))
    return p.select("p_partkey", grid.grid_shape(F.col("p_retailprice"), 7.0).alias("cells"), F.round(F.when(F.col("p_size") % 5 == 0, F.col("p_size") / 1e1).otherwise(grid.meshing_voxel(F.col("p_retailprice"), 11, F.lit(0.05), override)), 6).alias("voxel"))


# Tiles, neighbours, fusion

TILES = ((0.0, 0.0), 15.0, 3.0, (4, 3))
_TILE_SQL = """tiled AS (SELECT c.*, tx, ty FROM cloud c, range(4) a(tx), range(3) b(ty) WHERE x >= tx * 15e0 - 3 AND x < (tx + 1) * 15e0 + 3 AND y >= ty * 15e0 - 3 AND y < (ty + 1) * 15e0 + 3)"""


@query(f"WITH {fx.POINTS}, {_TILE_SQL} SELECT tx::INT AS tx, ty::INT AS ty, count(*) AS n, round(sum(z), 3) AS z FROM tiled GROUP BY ALL")
def tile_candidates(s, d):
    o, size, overlap, shape = TILES
    return spatial.tile_candidates(fx.cloud(s, d), "x", "y", o, size, overlap, shape).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 3).alias("z"))


@query(f"WITH {fx.POINTS}, {_TILE_SQL} SELECT tx::INT AS tx, ty::INT AS ty, count(*) AS n FROM tiled WHERE tx = least(3, greatest(0, floor(x / 15))) AND ty = least(2, greatest(0, floor(y / 15))) GROUP BY ALL")
def tile_core_dedup(s, d):
    o, size, overlap, shape = TILES
    return spatial.tile_owned(spatial.tile_candidates(fx.cloud(s, d), "x", "y", o, size, overlap, shape), "x", "y", o, size, shape).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))


def _thin(s, d) -> DataFrame:
    v = raster.voxel_downsample(fx.cloud(s, d), 4.0, (0.0, 0.0, 0.0))
    return v.select((F.col("vx") * 1_000_000 + F.col("vy") * 1000 + F.col("vz")).alias("point_id"), "x", "y", "z")


_THIN_SQL = f"{fx.POINTS}, thin AS (SELECT (floor(x / 4e0) * 1000000 + floor(y / 4e0) * 1000 + floor(z / 4e0))::BIGINT AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM cloud GROUP BY 1)"


@query(f"WITH {_THIN_SQL}, m AS (SELECT a.point_id, b.point_id AS other, row_number() OVER (PARTITION BY a.point_id ORDER BY power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2), b.point_id) AS r FROM thin a JOIN thin b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 36e0) SELECT point_id, count(*) AS n, string_agg(other::VARCHAR, ',' ORDER BY r) AS who FROM m WHERE r <= 12 GROUP BY 1")
def radius_neighbours(s, d):
    near = spatial.neighbours(_thin(s, d), 6.0, 12).groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour_id"))).alias("found"))
    return near.select("point_id", F.size("found").cast("long").alias("n"), F.array_join(F.transform("found", lambda r: r["neighbour_id"].cast("string")), ",").alias("who"))


@query()
def normals_pca(s, d):
    return fits.normals(spatial.neighbours(_thin(s, d), 6.0, 12)).select("point_id", rounded("nx"), rounded("ny"), rounded("nz"))


def _crossings(size: float, keys: str = "", limit: str = "") -> str:
    """SQL of the surface between neighbouring voxels of ``vox``."""
    parts = []
    for axis in "xyz":
        on = " AND ".join([*(f"n.{k} = m.{k}" for k in keys.split(", ") if k), *(f"n.v{c} = m.v{c} + {int(c == axis)}" for c in "xyz")])
        at = ", ".join(f"(m.v{c} + 5e-1 + {'m.sdf / (m.sdf - n.sdf)' if c == axis else '0e0'}) * {size} AS {c}" for c in "xyz")
        parts.append(f"SELECT {''.join(f'm.{k}, ' for k in keys.split(', ') if k)}{at}, m.r + m.sdf / (m.sdf - n.sdf) * (n.r - m.r) AS r FROM vox m JOIN vox n ON {on} WHERE ((m.sdf > 0 AND n.sdf <= 0) OR (m.sdf <= 0 AND n.sdf > 0)){limit}")
    return " UNION ALL ".join(parts)


_RAYS = f"""{fx.POINTS}, ray AS (SELECT x, y, z, r, x - 25e0 AS dx, y - 20e0 AS dy, z - 300e0 AS dz FROM cloud), len AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM ray)"""
_HITS = """SELECT {keys}floor((x + dx * (k * 1e0 / l)) / 1e0) AS vx, floor((y + dy * (k * 1e0 / l)) / 1e0) AS vy, floor((z + dz * (k * 1e0 / l)) / 1e0) AS vz, l, dx, dy, dz, r FROM {source}, unnest(range(-4, 5)) AS g(k) WHERE l > 0"""
_VOX = """SELECT {keys}vx, vy, vz, avg(least(1e0, greatest(-1e0, (l - (((vx + 5e-1) - 25e0) * dx + ((vy + 5e-1) - 20e0) * dy + ((vz + 5e-1) - 300e0) * dz) / l) / 4e0))) AS sdf, avg(r) AS r FROM hit GROUP BY ALL"""


def _seen_from_above(s, d) -> DataFrame:
    return fx.cloud(s, d).select("x", "y", "z", F.lit(25.0).alias("cx"), F.lit(20.0).alias("cy"), F.lit(300.0).alias("cz"), "r", "g", "b")


@query(f"WITH {_RAYS}, hit AS ({_HITS.format(keys='', source='len')}), vox AS ({_VOX.format(keys='')}), s AS ({_crossings(1.0)}) SELECT round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y, round(z, 4) + 0e0 AS z, round(r, 3) + 0e0 AS r FROM s")
def fusion_surface(s, d):
    return fusion.fuse(_seen_from_above(s, d), 1.0).select(*(rounded(c, 4) for c in "xyz"), rounded("r", 3))


_TILES = "t AS (SELECT tx, ty, len.* FROM len, unnest(range(0, 3)) AS a(tx), unnest(range(0, 2)) AS b(ty) WHERE x >= tx * 2e1 - 6 AND x < (tx + 1) * 2e1 + 6 AND y >= ty * 2e1 - 6 AND y < (ty + 1) * 2e1 + 6)"


@query(f"WITH {_RAYS}, {_TILES}, hit AS ({_HITS.format(keys='tx, ty, ', source='t')}), vox AS ({_VOX.format(keys='tx, ty, ')}), s AS ({_crossings(1.0, 'tx, ty')}) SELECT round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y, round(z, 4) + 0e0 AS z, tx::INT AS tx, ty::INT AS ty FROM s WHERE tx = least(2, greatest(0, floor(x / 2e1))) AND ty = least(1, greatest(0, floor(y / 2e1)))")
def fusion_tiled(s, d):
    return fusion.fuse_tiled(_seen_from_above(s, d), 1.0, (0.0, 0.0), 20.0, (3, 2), 6.0).select(*(rounded(c, 4) for c in "xyz"), "tx", "ty")


CAMERAS = "cam AS (SELECT r_regionkey AS k, 'cam' || r_regionkey AS name, 1e1 * r_regionkey + 5 AS cx, 2e1 AS cy, 2e2 AS cz FROM region)"


@query(f"WITH {fx.POINTS}, p AS (SELECT DISTINCT x, y, z FROM cloud), {CAMERAS}, q AS (SELECT name, x, y, z, 4e2 * (x - cx) / (cz - z) + 5e1 AS u, 4e2 * (cy - y) / (cz - z) + 4e1 AS v, cz - z AS depth FROM p, cam WHERE abs(x - cx) <= 30 AND abs(y - cy) <= 30) SELECT name, count(*) AS n, round(sum(depth), 3) AS depth, sum(round_even(u, 0))::BIGINT AS cols FROM q WHERE depth > 0 AND round_even(u, 0) BETWEEN 0 AND 99 AND round_even(v, 0) BETWEEN 0 AND 79 GROUP BY name")
def visible_points(s, d):
    return _seen(s, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("depth"), 3).alias("depth"), F.sum("col").alias("cols"))


def _seen(s, d):
    pts = fx.cloud(s, d).select("x", "y", "z").distinct().withColumn("point_id", F.xxhash64("x", "y", "z"))
    return spatial.visible_points(_region_cameras(s, d), pts)


def _region_cameras(s, d):
    r = fx.table(s, d, "region")
    k = camera.intrinsics(F.lit("SIMPLE_PINHOLE"), F.array(F.lit(400.0), F.lit(50.0), F.lit(40.0)))
    down = F.array(*(F.array(*map(F.lit, row)) for row in ((1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, -1.0))))
    cx = F.col("r_regionkey") * 10.0 + 5
    return r.select(F.concat(F.lit("cam"), F.col("r_regionkey").cast("string")).alias("name"), k.alias("k"), down.alias("rotation"), F.array(cx, F.lit(20.0), F.lit(200.0)).alias("center"), F.lit(100).alias("width"), F.lit(80).alias("height"), (cx - 30).alias("x0"), (cx + 30).alias("x1"), F.lit(-10.0).alias("y0"), F.lit(50.0).alias("y1"))


@query(f"""WITH {fx.POINTS}, p AS (SELECT DISTINCT x, y, z FROM cloud), {CAMERAS}, q AS (SELECT x, y, z, 4e2 * (x - cx) / (cz - z) + 5e1 AS u, 4e2 * (cy - y) / (cz - z) + 4e1 AS v FROM p, cam WHERE abs(x - cx) <= 30 AND abs(y - cy) <= 30 AND cz > z)
SELECT round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y, round(z, 5) + 0e0 AS z, count(*) AS n FROM q WHERE round_even(u, 0) BETWEEN 0 AND 99 AND round_even(v, 0) BETWEEN 0 AND 79 GROUP BY x, y, z HAVING count(*) > 1""")
def triangulated_points(s, d):
    """The cloud's points found again from where the cameras see them."""
    cams, xyz = _region_cameras(s, d), [F.col(c) for c in "xyz"]
    pts = fx.cloud(s, d).select("x", "y", "z").distinct().withColumn("point_id", F.xxhash64("x", "y", "z"))
    pixels = spatial.visible_points(cams, pts).select("name", "point_id").join(pts, "point_id").join(cams, "name").withColumn("p", camera.project_point(F.col("k"), F.col("rotation"), F.col("center"), xyz))
    seen = structure.rays(pixels.select(F.col("point_id").alias("track_id"), "name", "p.u", "p.v"), cams)
    return structure.triangulate(seen).where("x is not null").select(*(rounded(c, 5) for c in "xyz"), "n")


@query("""WITH f AS (SELECT DISTINCT l_partkey AS part, 's' || l_suppkey AS name FROM lineitem), t AS (SELECT part, count(*) AS n, min(name) AS first FROM f GROUP BY 1 HAVING count(*) > 1)
SELECT first || ':' || part AS track_id, n FROM t""")
def feature_tracks(s, d):
    """Suppliers as images, parts as features: each is matched with the next supplier of the part only."""
    f = fx.table(s, d, "lineitem").select(F.col("l_partkey").alias("part"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), "l_suppkey").distinct()
    before = F.lag("name").over(Window.partitionBy("part").orderBy("l_suppkey"))
    m = f.select(before.alias("name_a"), F.col("part").alias("feature_a"), F.col("name").alias("name_b"), F.col("part").alias("feature_b"), F.col("l_suppkey").cast("double").alias("score")).where("name_a is not null")
    return structure.tracks(m).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))


def _between(c: str) -> Column:
    """Rounded off the halves, on which sums of the stand-in's short decimals fall."""
    return (F.round(F.col(c) + 13e-5, 3) + 0.0).alias(c)


def _cameras(s, d, focal: float, cx: float, cy: float) -> DataFrame:
    """Five cameras in a row that look down."""
    k = camera.intrinsics(F.lit("PINHOLE"), F.array(F.lit(focal), F.lit(focal), F.lit(cx), F.lit(cy)))
    down = F.array(*(F.array(*map(F.lit, row)) for row in ((1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, -1.0))))
    return fx.table(s, d, "region").select(F.concat(F.lit("cam"), F.col("r_regionkey").cast("string")).alias("name"), k.alias("k"), down.alias("rotation"), F.array(F.col("r_regionkey") * 10.0 + 5, F.lit(20.0), F.lit(200.0)).alias("center"))


def _depth_images(s, d) -> DataFrame:
    """Depth of a nearly level ground, as means of what falls on a pixel."""
    li = fx.table(s, d, "lineitem")
    pixels = li.groupBy(F.concat(F.lit("cam"), (F.col("l_orderkey") % 5).cast("string")).alias("name"), (F.col("l_partkey") % 40).alias("u"), (F.col("l_suppkey") % 30).alias("v"))
    return pixels.agg((F.lit(195.0) + F.round(F.avg("l_discount"), 6) * 10).alias("depth"), *(F.round(F.avg(c), 6).alias(n) for c, n in (("l_quantity", "r"), ("l_tax", "g"), ("l_linenumber", "b"))))


_VIEWS = """{cameras}, px AS (SELECT 'cam' || (l_orderkey % 5) AS name, l_partkey % 40 AS u, l_suppkey % 30 AS v, 195e0 + round(avg(l_discount), 6) * 10 AS depth, round(avg(l_quantity), 6) AS r FROM lineitem GROUP BY ALL),
pt AS (SELECT {tile}px.*, cx, cy, (u - 20e0) / 4e1 * depth + cx AS x, -((v - 15e0) / 4e1 * depth) + cy AS y, -depth + 2e2 AS z FROM px JOIN cam USING (name){tiles}),
lo AS (SELECT DISTINCT {tile}name, cx, cy, floor((x - 8) / 16) AS bx, floor((x + 8) / 16) AS ex, floor((y - 8) / 16) AS by_, floor((y + 8) / 16) AS ey, floor((z - 8) / 16) AS bz, floor((z + 8) / 16) AS ez FROM pt{window}),
bl AS (SELECT DISTINCT {tile}name, cx, cy, bx + i AS bx, by_ + j AS by_, bz + k AS bz FROM lo, unnest(range(0, 2)) AS a(i), unnest(range(0, 2)) AS b(j), unnest(range(0, 2)) AS c(k) WHERE bx + i <= ex AND by_ + j <= ey AND bz + k <= ez),
cell AS (SELECT {tile}name, cx, cy, bx * 8 + i AS vx, by_ * 8 + j AS vy, bz * 8 + k AS vz FROM bl, unnest(range(0, 8)) AS a(i), unnest(range(0, 8)) AS b(j), unnest(range(0, 8)) AS c(k)),
pr AS (SELECT {tile}name, vx, vy, vz, (vx + 5e-1) * 2e0 - cx AS mx, -((vy + 5e-1) * 2e0 - 2e1) AS my, -((vz + 5e-1) * 2e0 - 2e2) AS mz FROM cell),
sp AS (SELECT {tile}name, vx, vy, vz, floor(4e1 * mx / mz + 2e1 + 5e-1)::BIGINT AS u, floor(4e1 * my / mz + 15e0 + 5e-1)::BIGINT AS v, mz FROM pr WHERE mz > 0),
sa AS (SELECT {tile}vx, vy, vz, (pt.depth - mz) * sqrt(1 + (sp.u - 2e1) / 4e1 * ((sp.u - 2e1) / 4e1) + (sp.v - 15e0) / 4e1 * ((sp.v - 15e0) / 4e1)) / 8e0 AS sdf, pt.r FROM sp JOIN pt USING ({tile}name, u, v){window}),
vox AS (SELECT * FROM (SELECT {tile}vx, vy, vz, avg(least(1e0, sdf)) AS sdf, avg(r) AS r FROM sa WHERE sdf > -1 GROUP BY ALL) WHERE sdf < 98e-2 AND sdf >= -98e-2)"""


def _views_sql(**parts: str) -> str:
    return _VIEWS.format(cameras=CAMERAS, **parts)


@query(f"WITH {_views_sql(tile='', tiles='', window='')}, s AS ({_crossings(2.0)}) SELECT round(x + 13e-5, 3) + 0e0 AS x, round(y + 13e-5, 3) + 0e0 AS y, round(z + 13e-5, 3) + 0e0 AS z, round(r + 13e-5, 3) + 0e0 AS r FROM s")
def fusion_views(s, d):
    return fusion.fuse_views(_depth_images(s, d), _cameras(s, d, 40.0, 20.0, 15.0), 2.0).select(*(_between(c) for c in "xyzr"))


_WINDOW = " WHERE (tx = 0 OR x >= 5 + tx * 2e1 - 1e1) AND (tx = 1 OR x < 5 + (tx + 1) * 2e1 + 1e1)"


@query(f"""WITH {_views_sql(tile='tx, ', tiles=", unnest(range(0, 2)) AS q(tx) WHERE cx >= 5 + tx * 2e1 - 1e1 AND cx < 5 + (tx + 1) * 2e1 + 1e1", window=_WINDOW)}, s AS ({_crossings(2.0, 'tx')}) SELECT tx::INT AS tx, round(x + 13e-5, 3) + 0e0 AS x, round(y + 13e-5, 3) + 0e0 AS y, round(z + 13e-5, 3) + 0e0 AS z FROM s WHERE tx = least(1, greatest(0, floor((x - 5) / 2e1)))""")
def fusion_view_tiles(s, d):
    found = fusion.fuse_view_tiles(_depth_images(s, d), _cameras(s, d, 40.0, 20.0, 15.0), 2.0, (5.0, 20.0), 20.0, (2, 1), 10.0)
    return found.select("tx", *(_between(c) for c in "xyz"))


def _ground(s, d) -> DataFrame:
    """A gentle height field: the mean of each cell of the cloud."""
    g = raster.elevation_grid(fx.cloud(s, d), fx.CLOUD, "mean")
    return g.select((F.col("row") * 1000 + F.col("col")).cast("long").alias("point_id"), F.col("col").cast("double").alias("x"), (-F.col("row")).cast("double").alias("y"), (F.col("z") / 50).alias("z"))


@query()
def normals_oriented(s, d):
    """One way up: all normals of a height field, by the spanning forest of its neighbours."""
    near = spatial.neighbours(_ground(s, d), 2.5, 12)
    found = fits.normals(near).join(_ground(s, d), "point_id")
    return orientation.oriented(found, near).select("point_id", rounded("nx"), rounded("ny"), rounded("nz"))


@query()
def poisson_surface(s, d):
    """Vertices of the ground's reconstructed surface, without the sparsest tenth."""
    near = spatial.neighbours(_ground(s, d), 2.5, 12)
    normals = orientation.turned_up(fits.normals(near)).join(_ground(s, d), "point_id")
    vertices, _ = poisson.poisson_mesh(normals, 6)
    return raster.density_crop(vertices, 0.1).select("vertex", *(rounded(c, 4) for c in "xyz"), "density")


# Tracks

_ASOF = """WITH {track}, {probes}, e AS (SELECT track_id, min(t) AS t0, max(t) AS t1 FROM track GROUP BY 1),
q AS (SELECT p.track_id, p.i, p.t + {off} AS u, least(greatest(p.t + {off}, t0), t1) AS t FROM probes p JOIN e USING (track_id)),
h AS (SELECT q.*, a.t AS ta, a.lat AS la, a.lon AS oa, a.alt AS aa, a.yaw AS ya FROM q ASOF LEFT JOIN track a ON a.track_id = q.track_id AND q.t > a.t),
k AS (SELECT h.*, b.t AS tb, b.lat AS lb, b.lon AS ob, b.alt AS ab, b.yaw AS yb FROM h ASOF LEFT JOIN track b ON b.track_id = h.track_id AND h.t <= b.t)
SELECT track_id, i, round(CASE WHEN ta IS NULL THEN lb ELSE la + (lb - la) * (t - ta) / (tb - ta) END, 9) AS lat,
 round(CASE WHEN ta IS NULL THEN ob ELSE oa + (ob - oa) * (t - ta) / (tb - ta) END, 9) AS lon,
 round(CASE WHEN ta IS NULL THEN ab ELSE aa + (ab - aa) * (t - ta) / (tb - ta) END, 6) AS alt,
 round(CASE WHEN ta IS NULL OR u >= t1 THEN yb WHEN ya IS NOT NULL AND yb IS NOT NULL THEN ya + (yb - ya) * (t - ta) / (tb - ta) ELSE coalesce(ya, yb) END, 6) + 0e0 AS yaw FROM k JOIN e USING (track_id)"""


def _asof(off: float) -> Query:
    def run(s, d):
        out = asof_lerp(fx.track(s, d), fx.probe_times(s, d), "track_id", ["lat", "lon", "alt", "yaw"], order="event_id", offset_s=off)
        return out.select("track_id", "i", rounded("lat", 9), rounded("lon", 9), rounded("alt"), rounded("yaw"))

    return run


query(_ASOF.format(track=fx.TRACK, probes=fx.PROBES, off="0e0"), "asof_lerp")(_asof(0.0))
query(_ASOF.format(track=fx.TRACK, probes=fx.PROBES, off="1234.5e0"), "asof_lerp_offset")(_asof(1234.5))

HAVERSINE = "2 * 6371008.8e0 * asin(sqrt(power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({e} - {b}) / 2), 2)))"


@query(f"WITH {fx.TRACK} SELECT a.track_id, a.ord FROM track a WHERE EXISTS (SELECT 1 FROM track b WHERE b.track_id = a.track_id AND b.ord >= a.ord + 5 AND {HAVERSINE.format(a='a.lat', b='a.lon', c='b.lat', e='b.lon')} <= 500e0)")
def revisit_semi(s, d):
    return spatial.revisits(fx.track(s, d), "track_id", 500.0, 5).select("track_id", "ord")


@query(f"WITH {fx.TRACK}, l AS (SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM track WINDOW w AS (PARTITION BY track_id ORDER BY ord)) SELECT track_id, ord, round({HAVERSINE.format(a='pa', b='po', c='lat', e='lon')}, 4) AS step_m FROM l")
def track_steps(s, d):
    return ordered.steps(fx.track(s, d), "track_id", ["ord"]).select("track_id", "ord", rounded("step_m", 4))


@query(f"WITH {fx.TRACK}, l AS (SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM track WINDOW w AS (PARTITION BY track_id ORDER BY ord)) SELECT track_id, round(quantile_cont({HAVERSINE.format(a='pa', b='po', c='lat', e='lon')}, 0.5), 4) AS median_step_m FROM l GROUP BY 1")
def track_median_step(s, d):
    return ordered.median_step(fx.track(s, d), "track_id", ["ord"]).select("track_id", rounded("median_step_m", 4))


@query(f"WITH {fx.TRACK} SELECT track_id, round(max_by(t, ord) - min_by(t, ord), 6) AS duration_s, count(yaw) > 0 AS has_yaw FROM track GROUP BY 1")
def track_summary(s, d):
    t = fx.track(s, d)
    return ordered.duration(t, "track_id", ["ord"]).join(ordered.fields_present(t, "track_id", ["yaw"]), "track_id").select("track_id", rounded("duration_s"), "has_yaw")


@query("WITH e AS (SELECT user_id AS track_id, event_id, epoch_us(ts) / 1e6 AS t FROM events) SELECT track_id, event_id, round(t - first_value(t) OVER (PARTITION BY track_id ORDER BY event_id), 4) + 0e0 AS t FROM e")
def track_rebase(s, d):
    e = fx.table(s, d, "events").select(F.col("user_id").alias("track_id"), "event_id", (fx.micros("ts") / 1e6).alias("t"))
    return ordered.rebase(e, "track_id", ["event_id"]).select("track_id", "event_id", rounded("t", 4))


@query(f"WITH {fx.TRACK}, m AS (SELECT track_id, quantile_cont(lon, 0.5) AS lon, quantile_cont(lat, 0.5) AS lat FROM track GROUP BY 1) SELECT track_id, (32600 + ((floor((lon + 180) / 6)::INT % 60) + 1))::INT AS epsg, ((floor((lon + 180) / 6)::INT % 60) + 1)::INT AS zone, 'N' AS hemisphere, 'track_median' AS derived_from FROM m")
def track_crs(s, d):
    return fits.derive_crs(fx.track(s, d), "track_id")


@query(f"WITH {fx.TRACK}, p AS (SELECT track_id, lon, CASE WHEN track_id % 2 = 0 THEN -lat ELSE lat END AS lat FROM track), m AS (SELECT track_id, quantile_cont(lon, 0.5) AS lon, quantile_cont(lat, 0.5) AS lat FROM p GROUP BY 1) SELECT track_id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6)::INT + 1)::INT AS epsg, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS hemisphere FROM m")
def track_crs_hemispheres(s, d):
    south = fx.track(s, d).withColumn("lat", F.when(F.col("track_id") % 2 == 0, -F.col("lat")).otherwise(F.col("lat")))
    return fits.derive_crs(south, "track_id").select("track_id", "epsg", "hemisphere")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(1e0, greatest(0e0, l_discount / (l_tax * 2 + 1e-6))), 9) AS confidence FROM lineitem")
def fit_confidences(s, d):
    li = fx.table(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(scalar.fit_confidence(F.col("l_discount"), F.col("l_tax") * 2), 9).alias("confidence"))


# Another series than the operator's: the expansion by powers of the distance from the central meridian, which is good to less than a millimetre within a zone.
_SERIES = """WITH p AS (SELECT n_nationkey AS id, n_nationkey * 141e-1 - 17e1 AS lon, n_nationkey * 63e-1 - 76e0 AS lat FROM nation), z AS (SELECT *, floor((lon + 180) / 6)::INT + 1 AS zone FROM p),
c AS (SELECT *, radians(lat) AS f, radians(lon - (zone * 6 - 183)) * cos(radians(lat)) AS a, 6378137e0 AS r, (2 - 1 / 298.257223563e0) / 298.257223563e0 AS e FROM z),
t AS (SELECT *, e / (1 - e) AS g, r / sqrt(1 - e * power(sin(f), 2)) AS n, power(tan(f), 2) AS t, e / (1 - e) * power(cos(f), 2) AS c,
 r * ((1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256) * f - (3 * e / 8 + 3 * e * e / 32 + 45 * e * e * e / 1024) * sin(2 * f) + (15 * e * e / 256 + 45 * e * e * e / 1024) * sin(4 * f) - 35 * e * e * e / 3072 * sin(6 * f)) AS m FROM c)
SELECT id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone)::INT AS epsg,
 round(9996e-4 * n * (a + (1 - t + c) * power(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * g) * power(a, 5) / 120) + 5e5, 1) AS easting,
 round(9996e-4 * (m + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * power(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * g) * power(a, 6) / 720)) + CASE WHEN lat >= 0 THEN 0 ELSE 1e7 END, 1) AS northing FROM t"""


def _series(source: str, keep: str, zone: str) -> str:
    """Easting and northing (e, n) of the rows (lon, lat) of ``source``, by that series."""
    out = _SERIES[_SERIES.index("c AS (") : _SERIES.index("SELECT id, (CASE")]
    tail = _SERIES[_SERIES.index(" round(9996e-4 * n") :].replace("round(", "(").replace(", 1) AS easting", ") AS east").replace(", 1) AS northing", ") AS north")
    return f"z AS (SELECT *, {zone} AS zone FROM {source}), {out}, xy AS (SELECT {keep},{tail})"


@query(f"""WITH {fx.TRACK}, w AS (SELECT track_id, lon, lat, alt FROM track), {_series("w", "track_id, alt", "43")}
SELECT track_id, count(*) AS n, round(avg(east) + 3, 2) AS x, round(avg(north) - 2, 2) AS y, round(avg(alt) - 50 + 123e-5, 2) AS z, round(max(east) - min(east), 2) AS wide, 43 + 32600 AS epsg, 0e0 AS rmse FROM xy GROUP BY 1""")
def mission_points(s, d):
    """Sparse points of all tracks, given in visual frames of their own, in map coordinates after the mission's poses are aligned."""
    seen = fx.track(s, d).select("track_id", "t", "ord", "lat", "lon", "alt", F.concat(F.lit("img/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"), "event_id")
    east, north = geo.project_utm(F.col("lon"), F.col("lat"), F.lit(32643))

    def visual(east: Column, north: Column, up: Column) -> list[Column]:
        """Turned by a right angle and scaled by the track, about a far origin."""
        scale = 2.0 + F.col("track_id") % 7
        return [(north - 1.4e6) / scale, -(east - 7.7e5) / scale, (up + 11) / scale]

    turn = F.array(*(F.array(*map(F.lit, r)) for r in ((1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, -1.0))))
    poses = seen.select(F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("name"), F.array(*visual(east, north, F.col("alt"))).alias("center"), turn.alias("rotation"))
    sparse = seen.select("track_id", F.col("event_id").alias("point_id"), *(c.alias(n) for c, n in zip(visual(east + 3, north - 2, F.col("alt") - 50), "xyz", strict=True)))
    tables = {"keyframes": seen, "crs": fits.derive_crs(fx.track(s, d), "track_id"), "visual_poses": poses, "sparse_points": sparse}
    out = mission.poses(s, tables, {})
    sums = out["points"].groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c) + (1.23e-3 if c == "z" else 0.0), 2).alias(c) for c in "xyz"), F.round(F.max("x") - F.min("x"), 2).alias("wide"))  # means of short decimals may be halves: off them
    return sums.join(out["spine"].select("track_id", "epsg", rounded("rmse", 3)), "track_id")


@query(_SERIES)
def utm_forward(s, d):
    lon, lat = F.col("n_nationkey") * 14.1 - 170.0, F.col("n_nationkey") * 6.3 - 76.0
    p = fx.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), geo.utm_epsg(lon, lat).cast("int").alias("epsg"), lon.alias("lon"), lat.alias("lat"))
    e, n = geo.project_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    return p.select("id", "epsg", F.round(e, 1).alias("easting"), F.round(n, 1).alias("northing"))


@query("SELECT c_custkey, (((floor((c_acctbal / 60e0 - 5 + 180) / 6)::INT % 60) + 60) % 60 + 1)::INT AS zone, round(c_acctbal / 60e0 - 5, 7) + 0e0 AS lon, round(c_acctbal / 130e0 - 10, 7) + 0e0 AS lat FROM customer")
def utm_round_trip(s, d):
    c = fx.table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 60.0 - 5).alias("lon0"), (F.col("c_acctbal") / 130.0 - 10).alias("lat0"))
    c = c.withColumn("epsg", geo.utm_epsg(F.col("lon0"), F.col("lat0")))
    e, n = geo.project_utm(F.col("lon0"), F.col("lat0"), F.col("epsg"))
    lon, lat = geo.unproject_utm(F.col("e"), F.col("n"), F.col("epsg"))
    return c.withColumn("e", e).withColumn("n", n).select("c_custkey", geo.utm_zone(F.col("lon0")).alias("zone"), (F.round(lon, 7) + 0.0).alias("lon"), (F.round(lat, 7) + 0.0).alias("lat"))


# Each system's defining parameters, and textbook forms that share no series with the library's.
_SYSTEMS = """sys(epsg, kind, meridian, lat0, p1, p2, e0, n0) AS (VALUES (32643, 'tm', 75e0, 0e0, 9996e-4, 0e0, 5e5, 0e0), (32756, 'tm', 153e0, 0e0, 9996e-4, 0e0, 5e5, 1e7), (25832, 'tm', 9e0, 0e0, 9996e-4, 0e0, 5e5, 0e0),
 (26917, 'tm', -81e0, 0e0, 9996e-4, 0e0, 5e5, 0e0), (28355, 'tm', 147e0, 0e0, 9996e-4, 0e0, 5e5, 1e7), (2193, 'tm', 173e0, 0e0, 9996e-4, 0e0, 16e5, 1e7), (3006, 'tm', 15e0, 0e0, 9996e-4, 0e0, 5e5, 0e0),
 (3763, 'tm', -8.133108333333334e0, 39.66825833333333e0, 1e0, 0e0, 0e0, 0e0), (5179, 'tm', 127.5e0, 38e0, 9996e-4, 0e0, 1e6, 2e6),
 (2154, 'lcc', 3e0, 46.5e0, 49e0, 44e0, 7e5, 66e5), (3034, 'lcc', 10e0, 52e0, 35e0, 65e0, 4e6, 28e5), (3347, 'lcc', -91.86666666666666e0, 63.390675e0, 49e0, 77e0, 62e5, 3e6), (7755, 'lcc', 80e0, 24e0, 12.472955e0, 35.1728044444444e0, 4e6, 4e6),
 (3031, 'polar', 0e0, -90e0, 71e0, 0e0, 0e0, 0e0), (3413, 'polar', -45e0, 90e0, 70e0, 0e0, 0e0, 0e0), (3995, 'polar', 0e0, 90e0, 71e0, 0e0, 0e0, 0e0), (32661, 'ups', 0e0, 90e0, 994e-3, 0e0, 2e6, 2e6), (32761, 'ups', 0e0, -90e0, 994e-3, 0e0, 2e6, 2e6),
 (3395, 'mercator', 0e0, 0e0, 1e0, 0e0, 0e0, 0e0), (3857, 'mercator', 0e0, 0e0, 0e0, 0e0, 0e0, 0e0))"""
_CODES = (32643, 32756, 25832, 26917, 28355, 2193, 3006, 3763, 5179, 2154, 3034, 3347, 7755, 3031, 3413, 3995, 32661, 32761, 3395, 3857)


def _t_sql(lat: str, e: str = "e") -> str:
    return f"(tan(pi() / 4 - {lat} / 2) / pow((1 - {e} * sin({lat})) / (1 + {e} * sin({lat})), {e} / 2))"


def _m_sql(lat: str) -> str:
    return f"(cos({lat}) / sqrt(1 - pow(e * sin({lat}), 2)))"


def _arc_sql(lat: str) -> str:
    """Length of the meridian, by Helmert's series."""
    return f"(6378137e0 / (1 + h) * ((1 + h * h / 4 + pow(h, 4) / 64) * {lat} - 3 / 2e0 * (h - pow(h, 3) / 8) * sin(2 * {lat}) + 15 / 16e0 * (h * h - pow(h, 4) / 4) * sin(4 * {lat}) - 35 / 48e0 * pow(h, 3) * sin(6 * {lat}) + 315 / 512e0 * pow(h, 4) * sin(8 * {lat})))"


_PROJECTED = f"""WITH {_SYSTEMS}, p AS (SELECT n_nationkey AS id, *, radians((n_nationkey - 12) * CASE WHEN kind = 'tm' THEN 5e-2 ELSE 95e-1 END) AS d, radians((n_nationkey * 31e-1 + 12) * CASE WHEN lat0 < 0 OR n0 = 1e7 THEN -1 ELSE 1 END) AS f, 1 / 298257223563e-9 AS fl FROM nation, sys),
q AS (SELECT *, sqrt(fl * (2 - fl)) AS e, fl / (2 - fl) AS h, abs(f) AS af, radians(p1) AS f1, radians(p2) AS f2, radians(lat0) AS f0 FROM p),
r AS (SELECT *, tan(f) * tan(f) AS t, e * e / (1 - e * e) * cos(f) * cos(f) AS c, e * e / (1 - e * e) AS g, d * cos(f) AS w, 6378137e0 / sqrt(1 - pow(e * sin(f), 2)) AS nu,
 CASE WHEN kind = 'lcc' THEN (ln({_m_sql("f1")}) - ln({_m_sql("f2")})) / (ln({_t_sql("f1")}) - ln({_t_sql("f2")})) END AS n FROM q),
k AS (SELECT *, CASE kind WHEN 'lcc' THEN 6378137e0 * {_m_sql("f1")} / (n * pow({_t_sql("f1")}, n)) * pow({_t_sql("f")}, n) WHEN 'polar' THEN 6378137e0 * {_m_sql("f1")} * {_t_sql("af")} / {_t_sql("f1")} WHEN 'ups' THEN 2 * 6378137e0 * p1 * {_t_sql("af")} / sqrt(pow(1 + e, 1 + e) * pow(1 - e, 1 - e)) END AS rho,
 CASE WHEN kind = 'lcc' THEN 6378137e0 * {_m_sql("f1")} / (n * pow({_t_sql("f1")}, n)) * pow({_t_sql("f0")}, n) END AS rho0 FROM r)
SELECT id, epsg, round(e0 + CASE kind WHEN 'tm' THEN p1 * nu * (w + (1 - t + c) * pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * g) * pow(w, 5) / 120) WHEN 'lcc' THEN rho * sin(n * d) WHEN 'mercator' THEN 6378137e0 * d ELSE rho * sin(d) END, 3) + 0e0 AS easting,
 round(n0 + CASE kind WHEN 'tm' THEN p1 * ({_arc_sql("f")} - {_arc_sql("f0")} + nu * tan(f) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * g) * pow(w, 6) / 720)) WHEN 'lcc' THEN rho0 - rho * cos(n * d)
 WHEN 'mercator' THEN -6378137e0 * ln({_t_sql("f", "(e * p1)")}) ELSE -sign(lat0) * rho * cos(d) END, 3) + 0e0 AS northing FROM k"""


@query(_PROJECTED)
def map_projected(s, d):
    """Points in twenty systems of four families."""
    n = fx.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.explode(F.array(*map(F.lit, _CODES))).alias("epsg"))
    meridian = F.element_at(F.create_map(*(F.lit(v) for c in _CODES for v in (c, projections.SYSTEMS[c].meridian))), F.col("epsg"))
    tm = F.col("epsg").isin([c for c in _CODES if projections.SYSTEMS[c].kind == "tm"])
    lon = meridian + (F.col("id") - 12) * F.when(tm, 0.05).otherwise(9.5)
    lat = (F.col("id") * 3.1 + 12) * F.when(F.col("epsg").isin(32756, 28355, 2193, 3031, 32761), -1).otherwise(1)
    out = projections.project_rows(n.withColumns({"lon": lon, "lat": lat}), "lon", "lat", "epsg")
    return out.select("id", "epsg", rounded("easting", 3), rounded("northing", 3))


@query(f"WITH {_SYSTEMS}, o AS (SELECT *, row_number() OVER (ORDER BY epsg) - 1 AS i FROM sys) SELECT c_custkey, epsg, round(meridian + c_acctbal / 4000e0, 8) + 0e0 AS lon, round(c_acctbal / 125e0 - 10, 8) + 0e0 AS lat FROM customer JOIN o ON i = c_custkey % 20")
def map_round_trip(s, d):
    """Degrees to metres and back, the systems dealt over the customers."""
    codes = sorted(_CODES)
    c = fx.table(s, d, "customer").select("c_custkey", F.get(F.array(*map(F.lit, codes)), (F.col("c_custkey") % 20).cast("int")).alias("epsg"), F.get(F.array(*(F.lit(projections.SYSTEMS[k].meridian) for k in codes)), (F.col("c_custkey") % 20).cast("int")).alias("m"), F.col("c_acctbal").alias("v"))
    there = projections.project_rows(c.select("c_custkey", "epsg", (F.col("m") + F.col("v") / 4000.0).alias("x"), (F.col("v") / 125.0 - 10).alias("y")), "x", "y", "epsg")
    return projections.unproject_rows(there, "easting", "northing", "epsg").select("c_custkey", "epsg", rounded("lon", 8), rounded("lat", 8))


@query(f"WITH {fx.TRACK}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ord) - 1 AS k FROM track) SELECT track_id, ord FROM n WHERE k % 3 = 0 AND k < 60")
def keyframe_stride(s, d):
    return ordered.every_nth(fx.track(s, d), "track_id", ["ord"], 3, 20).select("track_id", "ord")


_GREEDY = f"""WITH RECURSIVE {fx.TRACK}, l AS (SELECT track_id, ord, greatest(0e0, coalesce(alt - lag(alt) OVER (PARTITION BY track_id ORDER BY ord), 0e0)) AS d FROM track),
r(track_id, ord, acc, took, n, done) AS (SELECT track_id, ord, 0e0, true, 1, false FROM l WHERE ord = 0
UNION ALL SELECT l.track_id, l.ord, CASE WHEN r.acc + l.d >= 25e0 THEN 0e0 ELSE r.acc + l.d END, r.acc + l.d >= 25e0 AND NOT done,
 r.n + (r.acc + l.d >= 25e0 AND NOT done)::INT, done OR (r.acc + l.d >= 25e0 AND {{most}} > 0 AND r.n + 1 >= {{most}}) FROM r JOIN l ON l.track_id = r.track_id AND l.ord = r.ord + 1)
SELECT track_id, ord FROM r WHERE took"""


def _greedy(most: int) -> Query:
    def run(s, d):
        t = fx.track(s, d)
        moved = t.withColumn("d", F.col("alt") - F.lag("alt").over(Window.partitionBy("track_id").orderBy("ord")))
        return ordered.select_by_displacement(moved.select("track_id", "ord", "d"), "track_id", ["ord"], "d", 25.0, most).select("track_id", "ord")

    return run


query(_GREEDY.format(most=0), "keyframe_greedy")(_greedy(0))
query(_GREEDY.format(most=1), "keyframe_greedy_cap")(_greedy(1))


@query("SELECT p_partkey, greatest(1, round_even((CASE WHEN p_size % 7 = 0 THEN 30e0 ELSE p_size::DOUBLE END) / 2e0, 0))::BIGINT AS stride, src_index, (src_index // greatest(1, round_even((CASE WHEN p_size % 7 = 0 THEN 30e0 ELSE p_size::DOUBLE END) / 2e0, 0))::BIGINT)::BIGINT AS idx FROM part, unnest(range(0, 100, greatest(1, round_even((CASE WHEN p_size % 7 = 0 THEN 30e0 ELSE p_size::DOUBLE END) / 2e0, 0))::BIGINT)) AS g(src_index) WHERE src_index // greatest(1, round_even((CASE WHEN p_size % 7 = 0 THEN 30e0 ELSE p_size::DOUBLE END) / 2e0, 0))::BIGINT < 10")
def frame_sampling(s, d):
    p = fx.table(s, d, "part")
    fps = F.when(F.col("p_size") % 7 == 0, F.lit(0.0)).otherwise(F.col("p_size").cast("double"))
    video = p.select(F.col("p_partkey").alias("path"), fps.alias("fps"), F.lit(100).alias("n_frames"))
    rows = runs.frame_rows(video, 2.0, 10)
    return rows.join(video, "path").select(F.col("path").alias("p_partkey"), ordered.frame_stride(F.col("fps"), F.lit(2.0)).alias("stride"), "src_index", F.col("index").alias("idx"))


@query(f"""WITH {fx.TRACK}, g AS (SELECT track_id, ord, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM track WINDOW w AS (PARTITION BY track_id ORDER BY ord)),
h AS (SELECT *, sqrt(power(lat2 - lat, 2) + power(lon2 - lon, 2)) AS len FROM g WHERE lat2 IS NOT NULL),
k AS (SELECT *, sum(len) OVER (PARTITION BY track_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS e FROM h),
p AS (SELECT DISTINCT track_id, j, j * 5e-2 AS s FROM track, range(1, 6) r(j))
SELECT p.track_id, p.j::INT AS j, round(lat + (s - (e - len)) / len * (lat2 - lat), 8) AS lat, round(lon + (s - (e - len)) / len * (lon2 - lon), 8) AS lon FROM p JOIN k ON k.track_id = p.track_id AND s > e - len AND s <= e""")
def path_interpolation(s, d):
    t = fx.track(s, d)
    probes = t.select("track_id").distinct().withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("s", F.col("j") * 0.05)
    return ordered.along_path(t, probes, "track_id", "ord", ["lat", "lon"]).select("track_id", "j", rounded("lat", 8), rounded("lon", 8))


@query(f"WITH {fx.TRACK} SELECT track_id, ord, round(t, 3) AS t, round(lat, 8) AS lat, round(lon, 8) AS lon, round(alt, 1) AS alt, CASE WHEN yaw IS NULL THEN NULL ELSE round(yaw, 1) END AS yaw FROM (SELECT track_id, ord, ord / 3e1 AS t, lat, lon, alt, yaw FROM track)")
def srt_roundtrip(s, d):
    t = fx.track(s, d).withColumn("rel_alt", F.lit(None).cast("double")).withColumn("pitch", F.lit(None).cast("double")).withColumn("roll", F.lit(None).cast("double"))
    t = t.withColumn("alt", F.round("alt", 1)).withColumn("yaw", F.round("yaw", 1))
    back = telemetry.parse_srt(text_sink.srt_text(t, "track_id", "ord", 30.0))
    return back.select(F.col("track_id").cast("long").alias("track_id"), "ord", rounded("t", 3), rounded("lat", 8), rounded("lon", 8), "alt", "yaw")


@query("SELECT o_orderkey, epoch(o_orderdate)::DOUBLE AS t FROM orders")
def time_cells(s, d):
    return fx.table(s, d, "orders").select("o_orderkey", telemetry.time_cell(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("t"))


_MAV = "m AS (SELECT l_suppkey AS track_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS ord, CASE WHEN l_returnflag = 'R' THEN 'GLOBAL_POSITION_INT' WHEN l_returnflag = 'A' THEN 'GPS_RAW_INT' ELSE 'HEARTBEAT' END AS type, l_orderkey::DOUBLE AS t, l_partkey * 1000 AS lat, l_orderkey * 1000 AS lon, round(l_extendedprice * 100)::BIGINT AS alt, (l_quantity * 100)::BIGINT AS relative_alt, CASE WHEN l_linenumber = 1 THEN 65535 ELSE l_linenumber * 1000 END AS hdg FROM lineitem)"


@query(f"WITH {_MAV}, f AS (SELECT track_id, min(ord) AS first FROM m WHERE type = 'GLOBAL_POSITION_INT' GROUP BY 1), u AS (SELECT m.* FROM m LEFT JOIN f USING (track_id) WHERE type = 'GLOBAL_POSITION_INT' OR (type = 'GPS_RAW_INT' AND (first IS NULL OR ord < first))) SELECT track_id::VARCHAR AS track_id, ord, t - min(t) OVER (PARTITION BY track_id) AS t, round(lat / 1e7, 7) AS lat, round(lon / 1e7, 7) AS lon, round(alt / 1e3, 3) AS alt, CASE WHEN type = 'GLOBAL_POSITION_INT' AND hdg <> 65535 THEN hdg / 1e2 END AS yaw FROM u")
def mavlink_decode(s, d):
    li = fx.table(s, d, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")) - 1
    kind = F.when(F.col("l_returnflag") == "R", "GLOBAL_POSITION_INT").when(F.col("l_returnflag") == "A", "GPS_RAW_INT").otherwise("HEARTBEAT")
    m = li.select(F.col("l_suppkey").alias("track_id"), n.alias("ord"), kind.alias("type"), F.col("l_orderkey").alias("t"), (F.col("l_partkey") * 1000).alias("lat"), (F.col("l_orderkey") * 1000).alias("lon"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("alt"), (F.col("l_quantity") * 100).cast("long").alias("relative_alt"), F.when(F.col("l_linenumber") == 1, 65535).otherwise(F.col("l_linenumber") * 1000).alias("hdg"))
    return telemetry.decode_mavlink(m).select("track_id", "ord", "t", rounded("lat", 7), rounded("lon", 7), rounded("alt", 3), "yaw")


@query("SELECT c_custkey, round((CASE WHEN c_nationkey % 2 = 0 THEN -1 ELSE 1 END) * ((c_custkey % 90) + (c_custkey % 60) / 6e1 + (c_custkey % 59) / 36e2), 8) + 0e0 AS lat, round((CASE WHEN c_nationkey % 3 = 0 THEN -1 ELSE 1 END) * ((c_custkey % 180) + (c_custkey % 60) / 6e1 + (c_custkey % 59) / 36e2), 8) + 0e0 AS lon, c_acctbal * (CASE WHEN c_nationkey = 1 THEN -1 ELSE 1 END) AS alt FROM customer")
def exif_positions(s, d):
    c = fx.table(s, d, "customer")
    k = F.col("c_custkey").cast("double")
    rows = c.select("c_custkey", F.array(k % 90, k % 60, k % 59).alias("lat_dms"), F.when(F.col("c_nationkey") % 2 == 0, "S").otherwise("N").alias("lat_ref"), F.array(k % 180, k % 60, k % 59).alias("lon_dms"), F.when(F.col("c_nationkey") % 3 == 0, "W").otherwise("E").alias("lon_ref"), F.col("c_acctbal").alias("alt"), F.when(F.col("c_nationkey") == 1, 1).otherwise(0).alias("alt_ref"))
    lat, lon, alt = runs.gps_of_exif()
    return rows.select("c_custkey", (F.round(lat, 8) + 0.0).alias("lat"), (F.round(lon, 8) + 0.0).alias("lon"), alt.alias("alt"))


# Frames


@query(f"""WITH {fx.PATCHES}, l AS (SELECT frame, pixels, list_transform([i FOR i IN range(36)], lambda i: pixels[(i // 6) * 8 + 8 + i % 6 + 1] + pixels[(i // 6) * 8 + 8 + i % 6 + 3] + pixels[(i // 6) * 8 + i % 6 + 2] + pixels[(i // 6) * 8 + 16 + i % 6 + 2] - 4 * pixels[(i // 6) * 8 + 8 + i % 6 + 2]) AS v FROM patch),
q AS (SELECT frame, list_var_pop(v) AS varlap, len(list_filter(pixels, lambda p: p <= 5)) / 64e0 AS clip_low, len(list_filter(pixels, lambda p: p >= 250)) / 64e0 AS clip_high FROM l)
SELECT frame, round(varlap, 4) AS varlap, round(clip_low, 6) AS clip_low, round(clip_high, 6) AS clip_high, varlap >= 1e5 AND clip_low <= 1e-1 AND clip_high <= 1e-1 AS accepted FROM q""")
def frame_quality(s, d):
    q = frames.frame_quality(fx.patches(s, d), "pixels", 8, 8, 1e5, 0.1, 0.1)
    return q.select("frame", rounded("varlap", 4), rounded("clip_low"), rounded("clip_high"), "accepted")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(114e-3 * (l_partkey % 256) + 587e-3 * (l_suppkey % 256) + 299e-3 * (l_quantity * 5), 6) AS gray FROM lineitem")
def gray_values(s, d):
    li = fx.table(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(scalar.to_gray(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_quantity") * 5), 6).alias("gray"))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: power(p[1]::DOUBLE - p[2]::DOUBLE, 2))))"


@query(f"""WITH d AS MATERIALIZED (SELECT a.vec_id AS left_id, b.vec_id AS right_id, {_DIST} AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
l AS (SELECT left_id, min(ROW(dist, right_id)) AS m FROM d GROUP BY 1), r AS (SELECT right_id, min(ROW(dist, left_id)) AS m FROM d GROUP BY 1)
SELECT d.left_id, d.right_id, round(d.dist, 6) AS distance FROM d JOIN l ON l.left_id = d.left_id AND l.m[2] = d.right_id JOIN r ON r.right_id = d.right_id AND r.m[2] = d.left_id""")
def mutual_nn(s, d):
    e = fx.table(s, d, "embeddings").withColumn("pair", F.lit(0))
    vector = F.col("embedding").cast("array<double>").alias("vector")
    left, right = (e.where(F.col("vec_id") % 2 == side).select("pair", F.col("vec_id").cast("long").alias(f"{name}_id"), vector) for side, name in ((0, "left"), (1, "right")))
    return spatial.mutual_nearest(left, right, "pair").select("left_id", "right_id", rounded("distance"))


@query("WITH m AS (SELECT l_suppkey AS pair, sqrt(power(l_discount * 1e2, 2) + power(l_tax * 1e2, 2)) AS d FROM lineitem WHERE l_returnflag = 'A') SELECT pair, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN quantile_cont(d, 0.5) ELSE 0 END, 6) AS displacement FROM m GROUP BY 1")
def match_displacement(s, d):
    m = fx.table(s, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("pair"), (F.col("l_discount") * 100).alias("dx"), (F.col("l_tax") * 100).alias("dy"))
    return spatial.pair_displacement(m, "pair", F.col("dx"), F.col("dy")).select("pair", "n", rounded("displacement"))


_DET = "det AS (SELECT l_suppkey AS frame, CASE l_returnflag WHEN 'A' THEN 'car' WHEN 'R' THEN 'dog' ELSE 'tree' END AS label, l_discount * 10 AS score, (l_partkey % 60) - 5e-1 AS x0, (l_orderkey % 40) - 5e-1 AS y0, (l_partkey % 60) + l_quantity / 5 AS x1, (l_orderkey % 40) + l_quantity / 6 AS y1 FROM lineitem)"


@query(f"""WITH {_DET}, b AS (SELECT frame, label, least(64, greatest(0, trunc(x0)))::INT AS xa, least(64, greatest(0, trunc(x1)))::INT AS xb, least(48, greatest(0, trunc(y0)))::INT AS ya, least(48, greatest(0, trunc(y1)))::INT AS yb FROM det WHERE score >= 5e-1 AND label IN ('car', 'dog')),
p AS (SELECT DISTINCT frame, u, v FROM b, range(64) x(u), range(48) y(v) WHERE xb > xa AND yb > ya AND u BETWEEN xa - 1 AND xb AND v BETWEEN ya - 1 AND yb)
SELECT frame, round(count(*) / 3072e0, 6) AS dynamic_frac FROM p GROUP BY 1""")
def mask_fraction(s, d):
    li = fx.table(s, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", "car").when(F.col("l_returnflag") == "R", "dog").otherwise("tree")
    det = li.select(F.col("l_suppkey").alias("frame"), label.alias("label"), (F.col("l_discount") * 10).alias("score"), (F.col("l_partkey") % 60 - 0.5).alias("x0"), (F.col("l_orderkey") % 40 - 0.5).alias("y0"), (F.col("l_partkey") % 60 + F.col("l_quantity") / 5).alias("x1"), (F.col("l_orderkey") % 40 + F.col("l_quantity") / 6).alias("y1"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    wanted = s.range(1).select(F.explode(scalar.expanded_labels(F.array(F.lit("vehicle"), F.lit("animal")))).alias("label"))
    return frames.mask_fraction(frames.mask_bits(det, wanted, 0.5, 3), 64, 48).select("frame", rounded("dynamic_frac"))


@query(f"WITH {_DET} SELECT label, count(*) AS n FROM det WHERE score >= 5e-1 GROUP BY 1")
def label_histogram(s, d):
    li = fx.table(s, d, "lineitem").where(F.col("l_discount") * 10 >= 0.5)
    label = F.when(F.col("l_returnflag") == "A", "car").when(F.col("l_returnflag") == "R", "dog").otherwise("tree")
    return li.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS run, max_by(o_orderkey, o_totalprice) AS model, max(o_totalprice) AS size FROM orders GROUP BY 1")
def largest_model(s, d):
    m = fx.table(s, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("model"), F.col("o_totalprice").alias("size"), F.col("o_orderkey").alias("ord"))
    return frames.largest_model(m, "run", "size", "model")


@query("SELECT o_custkey AS scene, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders")
def painter_order(s, d):
    return frames.painter_order(fx.table(s, d, "orders").select(F.col("o_custkey").alias("scene"), F.col("o_orderkey").alias("item"), "o_totalprice"), "scene", "o_totalprice").select("scene", "item", "rank")


# Fits

_CORR = "c AS (SELECT vec_id % 5 AS k, embedding[1]::DOUBLE AS s0, embedding[2]::DOUBLE AS s1, embedding[3]::DOUBLE AS s2, embedding[4]::DOUBLE AS d0, embedding[5]::DOUBLE AS d1, embedding[6]::DOUBLE AS d2 FROM embeddings)"


def _pairs(s, d) -> DataFrame:
    e = fx.table(s, d, "embeddings")
    return e.select((F.col("vec_id") % 5).alias("k"), *(e["embedding"][i].cast("double").alias(n) for i, n in enumerate(("s0", "s1", "s2", "d0", "d1", "d2"))))


@query(f"WITH {_CORR} SELECT k, count(*) AS n, round(avg(s0), 6) + 0e0 AS m_s0, round(avg(d2), 6) + 0e0 AS m_d2, round(covar_pop(d0, s1), 8) + 0e0 AS c01, round(covar_pop(d2, s2), 8) + 0e0 AS c22, round(var_pop(s0) + var_pop(s1) + var_pop(s2), 8) AS var_s FROM c GROUP BY 1")
def similarity_moments(s, d):
    m = fits.similarity_moments(_pairs(s, d), "k")
    return m.select("k", "n", rounded("m_s0"), rounded("m_d2"), rounded("c01", 8), rounded("c22", 8), rounded("var_s", 8))


# The residual that no similarity can go below: from the singular values of the cross-covariance, as roots of the eigenvalues of C'C by the cosine formula.
@query(f"""WITH {_CORR}, m AS (SELECT k, count(*) AS n, {", ".join(f"covar_pop(d{i}, s{j}) AS c{i}{j}" for i in range(3) for j in range(3))}, var_pop(s0) + var_pop(s1) + var_pop(s2) AS vs, var_pop(d0) + var_pop(d1) + var_pop(d2) AS vd FROM c GROUP BY 1),
a AS (SELECT *, {", ".join(f"c0{i} * c0{j} + c1{i} * c1{j} + c2{i} * c2{j} AS a{i}{j}" for i in range(3) for j in range(i, 3))}, c00 * (c11 * c22 - c12 * c21) - c01 * (c10 * c22 - c12 * c20) + c02 * (c10 * c21 - c11 * c20) AS det FROM m),
q AS (SELECT *, (a00 + a11 + a22) / 3 AS q FROM a), p AS (SELECT *, sqrt((power(a00 - q, 2) + power(a11 - q, 2) + power(a22 - q, 2) + 2 * (a01 * a01 + a02 * a02 + a12 * a12)) / 6) AS p FROM q),
r AS (SELECT *, acos(least(1e0, greatest(-1e0, ((a00 - q) * ((a11 - q) * (a22 - q) - a12 * a12) - a01 * (a01 * (a22 - q) - a12 * a02) + a02 * (a01 * a12 - (a11 - q) * a02)) / (2 * p * p * p)))) / 3 AS phi FROM p),
e AS (SELECT *, sqrt(greatest(0e0, q + 2 * p * cos(phi))) AS s1, sqrt(greatest(0e0, q + 2 * p * cos(phi - 2 * pi() / 3))) AS s2, sqrt(greatest(0e0, q + 2 * p * cos(phi + 2 * pi() / 3))) AS s3 FROM r)
SELECT k, round(sqrt(greatest(0e0, vd - power(s1 + s2 + sign(det) * s3, 2) / vs)), 5) AS rmse, n FROM e""")
def similarity_fit(s, d):
    f = fits.fit_similarity(_pairs(s, d), "k")
    moved = _pairs(s, d).join(f, "k").withColumn("sim", F.struct("scale", "rotation", "translation"))
    p = camera.similarity_apply(F.col("sim"), [F.col(c) for c in ("s0", "s1", "s2")])
    return moved.groupBy("k").agg(F.round(scalar.rmse3(p, [F.col(c) for c in ("d0", "d1", "d2")]), 5).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CORR} SELECT k, round(sqrt(avg(power(s0 - d0, 2) + power(s1 - d1, 2) + power(s2 - d2, 2))), 6) AS rmse FROM c GROUP BY 1")
def rmse_3d(s, d):
    return _pairs(s, d).groupBy("k").agg(F.round(scalar.rmse3([F.col(f"s{i}") for i in range(3)], [F.col(f"d{i}") for i in range(3)]), 6).alias("rmse"))


def _trim_sql() -> str:
    sql = "WITH r0 AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice / 1e3 AS y FROM lineitem), z0 AS (SELECT k, count(*) AS n FROM r0 GROUP BY 1)"
    for i in range(3):
        sql += f", f{i} AS (SELECT k, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r{i} GROUP BY 1), e{i} AS (SELECT r{i}.k, r{i}.x, r{i}.y, f{i}.a, f{i}.b, abs(f{i}.a * x + f{i}.b - y) AS r FROM r{i} JOIN f{i} ON f{i}.k = r{i}.k), q{i} AS (SELECT k, quantile_cont(r, 0.8) AS q FROM e{i} GROUP BY 1), r{i + 1} AS (SELECT k, x, y, a, b, r FROM e{i} JOIN q{i} USING (k) WHERE r <= greatest(q, 1e-9))"
    return sql + " SELECT k, round(any_value(a), 5) AS a, round(any_value(b), 5) AS b, any_value(n) AS n, count(*) AS n_inliers, round(quantile_cont(r, 0.5), 5) AS median_residual, any_value(n) >= 8 AS metric FROM r3 JOIN z0 USING (k) GROUP BY 1"


@query(_trim_sql())
def trimfit(s, d):
    li = fx.table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity", (F.col("l_extendedprice") / 1e3).alias("m"))
    f = fits.trust_fit(fits.fit_scale_shift(li, "k", "l_quantity", "m"))
    return f.select("k", rounded("a", 5), rounded("b", 5), "n", "n_inliers", rounded("median_residual", 5), "metric")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_returnflag = 'R' OR 2e0 * l_quantity - 30 <= 0 THEN 0 ELSE 2e0 * l_quantity - 30 END, 6) AS depth, round(CASE WHEN l_quantity > 0 AND l_discount >= 2e-2 AND l_discount < 6e-2 THEN l_quantity ELSE 0 END, 6) AS clipped FROM lineitem")
def depth_values(s, d):
    li = fx.table(s, d, "lineitem")
    depth = camera.depth_value(F.lit(2.0), F.lit(-30.0), F.col("l_quantity"), F.col("l_returnflag") == "R")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", depth.alias("depth"), camera.clip_depth(F.col("l_quantity"), [F.col("l_discount")], [F.lit(0.02)], [F.lit(0.06)]).alias("clipped"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(2e0 * (-l_tax) + 1, 6) + 0e0 AS x, round(2e0 * l_discount + 2, 6) + 0e0 AS y, round(2e0 * l_quantity + 3, 6) + 0e0 AS z FROM lineitem")
def similarity_apply(s, d):
    li = fx.table(s, d, "lineitem")
    turn = F.array(*(F.array(*map(F.lit, r)) for r in ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))))
    sim = F.struct(F.lit(2.0).alias("scale"), turn.alias("rotation"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("translation"))
    p = camera.similarity_apply(sim, [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")])
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *((F.round(c, 6) + 0.0).alias(n) for c, n in zip(p, "xyz", strict=True)))


@query("SELECT l_orderkey, l_linenumber, l_partkey, least(1e0, l_quantity / 4e1) AS share, round(1 - least(1e0, l_discount * 12), 6) AS without, round_even(least(l_discount * 10, CASE l_linenumber % 7 WHEN 0 THEN 1e0 WHEN 1 THEN 95e-2 WHEN 2 THEN 85e-2 WHEN 3 THEN 7e-1 WHEN 4 THEN 5e-1 WHEN 5 THEN 35e-2 ELSE 2e-1 END), 4) AS blended FROM lineitem")
def confidences(s, d):
    li = fx.table(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", scalar.share(F.col("l_quantity"), F.lit(40.0)).alias("share"), F.round(scalar.without(F.col("l_discount") * 12), 6).alias("without"), scalar.blend(F.least(F.lit(1.0), F.col("l_discount") * 10), scalar.level_cap(F.col("l_linenumber") % 7)).alias("blended"))


# Joins of poses, keyframes and masks


@query("WITH p AS (SELECT l_orderkey, count(*) AS n_points FROM lineitem GROUP BY 1), k AS (SELECT o_orderkey, 'frames/' || o_orderkey || '.jpg' AS path, o_totalprice AS alt FROM orders WHERE o_orderstatus <> 'F') SELECT split_part(path, '/', 2) AS name, n_points, alt FROM p JOIN k ON p.l_orderkey || '.jpg' = split_part(path, '/', 2)")
def pose_keyframe_join(s, d):
    p = fx.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_points")).select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("name"), "n_points")
    k = fx.table(s, d, "orders").where("o_orderstatus <> 'F'").select(scalar.basename(F.concat(F.lit("frames/"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))).alias("name"), F.col("o_totalprice").alias("alt"))
    return p.join(k, "name").select("name", "n_points", "alt")


_KEYS = "k AS (SELECT o_orderkey AS index, 'frames/' || o_orderkey || '.jpg' AS path, o_totalprice AS alt FROM orders WHERE o_orderstatus <> 'F')"
_NAMED = "l_orderkey || '.jpg' = split_part(path, '/', 2)"


def _keyframes(s, d):
    return fx.table(s, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("index"), F.concat(F.lit("frames/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"), F.col("o_totalprice").alias("alt"), F.lit(1.0).alias("lat"), F.when(F.col("o_orderkey") % 5 > 0, F.lit(2.0)).alias("lon"))


def _poses(s, d):
    return fx.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_points")).select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("name"), "n_points")


@query(f"WITH p AS (SELECT l_orderkey, count(*) AS n_points FROM lineitem GROUP BY 1), {_KEYS} SELECT split_part(path, '/', 2) AS name, n_points, alt FROM p JOIN k ON {_NAMED} WHERE index % 5 > 0")
def pose_keyframe_positions(s, d):
    return views.keyframe_poses(_poses(s, d), _keyframes(s, d)).select("name", "n_points", "alt")


@query(f"WITH p AS (SELECT l_orderkey, count(*) AS n_points FROM lineitem GROUP BY 1), {_KEYS}, m AS (SELECT o_orderkey AS index, (o_orderkey % 10) / 1e1 AS dynamic_frac FROM orders WHERE o_orderkey % 3 = 0) SELECT split_part(path, '/', 2) AS name, n_points, dynamic_frac, dynamic_frac IS NOT NULL AS masked FROM p JOIN k ON {_NAMED} LEFT JOIN m USING (index)")
def pose_mask_join(s, d):
    masks = fx.table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("index"), (F.col("o_orderkey") % 10 / F.lit(10.0)).alias("dynamic_frac"))
    return views.masked_views(_poses(s, d), _keyframes(s, d), masks).select("name", "n_points", "dynamic_frac", "masked")


@query(f"""WITH c AS (SELECT o_orderkey, (o_custkey % 50)::DOUBLE AS cx, (o_custkey % 40)::DOUBLE AS cy, 2e2 AS cz FROM orders), {_KEYS},
q AS (SELECT l_orderkey, cx, cy, cz, l_linenumber * 10 AS u, l_quantity AS v, l_extendedprice / 1e3 AS depth FROM lineitem JOIN c ON o_orderkey = l_orderkey JOIN k ON index = l_orderkey),
w AS (SELECT l_orderkey || '.jpg' AS name, cx + (u - 50) / 4e2 * depth AS x, cy - (v - 40) / 4e2 * depth AS y, cz - depth AS z, depth FROM q)
SELECT name, count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(z), 3) AS z FROM w WHERE depth > 0 AND x >= 0 AND x < 45 AND y >= 1 AND y < 38 AND z >= 105 AND z < 190 GROUP BY 1""")
def dense_points(s, d):
    k = camera.intrinsics(F.lit("PINHOLE"), F.array(F.lit(400.0), F.lit(400.0), F.lit(50.0), F.lit(40.0)))
    down = F.array(*(F.array(*map(F.lit, row)) for row in ((1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, -1.0))))
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    poses = fx.table(s, d, "orders").select(name.alias("name"), k.alias("k"), down.alias("rotation"), F.array((F.col("o_custkey") % 50).cast("double"), (F.col("o_custkey") % 40).cast("double"), F.lit(200.0)).alias("center"))
    depth = fx.table(s, d, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("name"), (F.col("l_linenumber") * 10).alias("u"), F.col("l_quantity").alias("v"), (F.col("l_extendedprice") / 1e3).alias("depth"))
    kept = views.dense_views(poses, _keyframes(s, d), fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("index")).distinct())
    points = views.world_points(depth, kept, [0.0, 1.0, 105.0], [45.0, 38.0, 190.0])
    return points.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.sum(c), 3).alias(c) for c in "xyz"))


@query(f"WITH {fx.POINTS}, p AS (SELECT DISTINCT x, y, z FROM cloud), {CAMERAS}, q AS (SELECT name, round_even(4e2 * (x - cx) / (cz - z) + 5e1, 0)::BIGINT AS u, round_even(4e2 * (cy - y) / (cz - z) + 4e1, 0)::BIGINT AS v, cz - z AS depth FROM p, cam WHERE abs(x - cx) <= 30 AND abs(y - cy) <= 30) SELECT name, count(*) AS n, sum((u * 7 + v * 13) % 11)::BIGINT AS rel FROM q WHERE depth > 0 AND u BETWEEN 0 AND 99 AND v BETWEEN 0 AND 79 AND (u + v) % 4 > 0 GROUP BY name")
def view_raster_lookup(s, d):
    seen = _seen(s, d)
    pixels = fx.table(s, d, "region").select(F.concat(F.lit("cam"), F.col("r_regionkey").cast("string")).alias("name"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("u")).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(79))))
    relative = pixels.where((F.col("u") + F.col("v")) % 4 > 0).withColumn("rel", (F.col("u") * 7 + F.col("v") * 13) % 11)
    return views.raster_lookup(seen, relative, "rel").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("rel").alias("rel"))


@query("""WITH d AS (SELECT p_brand AS pair, p_partkey AS id, (p_partkey * 2654435761) % 4294967296 AS bits FROM part),
m AS (SELECT a.pair, a.id AS left_id, b.id AS right_id, bit_count(xor(a.bits, b.bits))::INT AS distance FROM d a JOIN d b ON a.pair = b.pair AND a.id % 2 = 0 AND b.id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY pair, left_id ORDER BY distance, right_id) AS x, row_number() OVER (PARTITION BY pair, right_id ORDER BY distance, left_id) AS y FROM m)
SELECT pair, left_id, right_id, distance FROM r WHERE x = 1 AND y = 1""")
def mutual_nn_hamming(s, d):
    p = fx.table(s, d, "part").select(F.col("p_brand").alias("pair"), F.col("p_partkey").alias("id"), F.array((F.col("p_partkey") * F.lit(2654435761) % F.lit(4294967296)).cast("long")).alias("bits"))
    left, right = (p.where(F.col("id") % 2 == side).select("pair", F.col("id").alias(f"{name}_id"), F.col("bits").alias("vector")) for side, name in ((0, "left"), (1, "right")))
    return spatial.mutual_nearest(left, right, "pair", spatial.hamming).withColumn("distance", F.col("distance").cast("int"))


@query("SELECT o_custkey AS run, count(*) AS n_keyframes, count(*) FILTER (o_orderstatus = 'O') AS n_registered, count(*) FILTER (o_orderstatus = 'O') / count(*)::DOUBLE AS rate FROM orders GROUP BY 1")
def registration_rate(s, d):
    o = fx.table(s, d, "orders").select(F.col("o_custkey").alias("run"), "o_orderstatus", F.concat(F.lit("a/b/"), F.col("o_orderkey").cast("string")).alias("path"))
    return views.registration(o, o.where("o_orderstatus = 'O'").select(F.substring_index("path", "/", -1).alias("name")), "run")


# Governance


@query("SELECT o_orderpriority AS priority, sha256(string_agg(h, '' ORDER BY h)) AS sha256 FROM (SELECT o_orderpriority, sha256(o_orderkey::VARCHAR) AS h FROM orders) GROUP BY 1")
def hash_combine(s, d):
    o = fx.table(s, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"))
    return governance.combined_hashes(o, "priority", "h")


_LABEL_CASE = "CASE level " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in scalar.LEVEL_LABELS.items()) + " END"
_CAP_CASE = "CASE level " + " ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, v in scalar.LEVEL_CAPS.items()) + " END"


@query(f"""WITH t AS (SELECT p_brand AS brand, (p_size % 7)::INT AS level, p_partkey AS ord, p_name || p_partkey AS name, (p_partkey % 3) > 0 AND p_size % 7 > 1 AS ok FROM part),
b AS (SELECT brand, min(level) AS top, min(ROW(level, ord)) FILTER (ok) AS m FROM t GROUP BY 1), c AS (SELECT b.brand, top, t.level, t.name FROM b JOIN t ON t.brand = b.brand AND t.ord = b.m[2]),
o AS (SELECT c.brand, string_agg(t.name || ' [' || t.level || ']', ', ' ORDER BY t.ord) AS off FROM c JOIN t ON t.brand = c.brand AND t.level < c.level AND NOT t.ok GROUP BY 1)
SELECT brand, level, name, level > top AS degraded, CASE WHEN level > top THEN 'uses ' || name || ' [' || level || ', ' || {_LABEL_CASE} || ']' || coalesce('; not available: ' || off, '') END AS reason, {_CAP_CASE} AS confidence_cap FROM c LEFT JOIN o USING (brand)""")
def tier_choose(s, d):
    t = fx.table(s, d, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") % 7).alias("level"), F.col("p_partkey").alias("ord"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), ((F.col("p_partkey") % 3 > 0) & (F.col("p_size") % 7 > 1)).alias("available"))
    return governance.choose_tier(t, "brand")


_STATE = "CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' WHEN count(DISTINCT stage) FILTER (status IN ('done', 'degraded')) = 11 THEN 'done' ELSE 'partial' END"


@query(f"WITH {fx.RECORDS}, u AS (SELECT run, stage, max_by(status, version) AS status FROM rec GROUP BY ALL) SELECT run, {_STATE} AS state, count(*) FILTER (status IN ('done', 'degraded')) AS n_done, count(*) FILTER (status = 'failed') AS n_failed, count(*) AS n_stages FROM u GROUP BY 1")
def run_rollup(s, d):
    latest = governance.upsert(fx.stage_records(s, d), ["run", "stage"], "version")
    return governance.run_states(latest, "run", fx.RUN_STAGES)


@query(f"WITH {fx.RECORDS} SELECT run, round(sum(wall), 5) AS total_wall, count(*) AS n_stages, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (degraded_reason <> '') AS n_degraded FROM rec GROUP BY 1")
def run_report(s, d):
    return governance.run_report(fx.stage_records(s, d), "run").select("run", rounded("total_wall", 5), "n_stages", "n_failed", "n_degraded")


@query(f"WITH {fx.RECORDS} SELECT run, stage, max_by(status, version) AS status, max(version) AS version FROM rec GROUP BY ALL")
def record_upsert(s, d):
    return governance.upsert(fx.stage_records(s, d), ["run", "stage"], "version").select("run", "stage", "status", "version")


@query(f"WITH {fx.RECORDS}, u AS (SELECT run, stage, max_by(wall, version) AS wall FROM rec GROUP BY ALL) SELECT run, max(wall) AS rmse FROM u WHERE stage = 's2' GROUP BY 1")
def metric_lookup(s, d):
    latest = governance.upsert(fx.stage_records(s, d), ["run", "stage"], "version").withColumn("metrics", F.create_map(F.lit("rmse"), F.col("wall")))
    return governance.metric_of(latest, "run", "s2", "rmse")


@query("SELECT o_orderkey, o_orderstatus <> 'F' AND o_custkey % 3 = 0 AND o_orderkey % 2 = 0 AS fresh FROM orders WHERE o_orderkey IS NOT NULL")
def stage_freshness(s, d):
    o = fx.table(s, d, "orders")
    want = o.select("o_orderkey", F.lit("i0").alias("inputs_hash"), F.lit("p0").alias("params_hash"))
    old = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), F.concat(F.lit("i"), (F.col("o_custkey") % 3).cast("string")).alias("inputs_hash"), F.concat(F.lit("p"), (F.col("o_orderkey") % 2).cast("string")).alias("params_hash"))
    return governance.freshness(want, old, ["o_orderkey"]).select("o_orderkey", "fresh")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'MISSING' WHEN o_custkey % 2 = 0 THEN 'OK' ELSE 'MISMATCH' END AS result FROM orders WHERE o_orderstatus <> 'F'")
def stage_verify(s, d):
    o = fx.table(s, d, "orders")
    rec = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), F.lit("h0").alias("outputs_hash"))
    now = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.concat(F.lit("h"), (F.col("o_custkey") % 2).cast("string")).alias("outputs_hash"), (F.col("o_orderkey") % 7 == 0).cast("int").alias("n_missing"))
    return governance.verify(rec, now, ["o_orderkey"])


def _edge_sql() -> str:
    rows = [f"('{s_}', '{r}')" for s_ in governance.STAGES for r in governance.REQUIRES.get(s_, ())]
    names = ", ".join(f"'{x}'" for x in governance.STAGES)
    return f"edges(stage, needs) AS (VALUES {', '.join(rows)}), stages AS (SELECT unnest([{names}]) AS stage)"


@query(f"""WITH {_edge_sql()}, out AS (SELECT n_nationkey AS run, stage AS needs, sha256(n_name || stage) AS h FROM nation, stages WHERE (n_nationkey + length(stage)) % 3 > 0),
h AS (SELECT n_nationkey AS run, e.stage, coalesce(o.h, 'missing:' || e.needs) AS h FROM nation JOIN edges e ON true LEFT JOIN out o ON o.run = n_nationkey AND o.needs = e.needs UNION ALL SELECT n_nationkey, stage, sha256(n_name) FROM nation, stages)
SELECT run, stage, sha256(string_agg(h, '' ORDER BY h)) AS inputs_hash FROM h GROUP BY ALL""")
def stage_inputs_hash(s, d):
    n = fx.table(s, d, "nation").withColumn("stage", F.explode(F.array(*map(F.lit, governance.STAGES))))
    current = n.select(F.col("n_nationkey").alias("run"), "stage", F.sha2("n_name", 256).alias("extra"))
    recorded = n.where((F.col("n_nationkey") + F.length("stage")) % 3 > 0).select(F.col("n_nationkey").alias("run"), "stage", F.sha2(F.concat("n_name", "stage"), 256).alias("outputs_hash"))
    return governance.inputs_hashes(current, recorded, "run")


@query("SELECT p_partkey, (CASE p_size % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'GPL-3.0' WHEN 3 THEN 'CC-BY-NC-4.0' ELSE 'BSD-3-Clause' END) IN ('Apache-2.0', 'MIT', 'BSD-2-Clause', 'BSD-3-Clause', 'CC-BY-4.0') AND p_partkey % 4 <> 0 AS permitted FROM part")
def model_license_gate(s, d):
    p = fx.table(s, d, "part")
    names = F.array(*map(F.lit, ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "BSD-3-Clause")))
    m = p.select("p_partkey", F.get(names, F.col("p_size") % 5).alias("license"), (F.col("p_partkey") % 4 == 0).alias("reference_only"))
    return governance.permitted_models(m).select("p_partkey", "permitted")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'local' WHEN p_size % 2 = 0 OR p_size % 5 > 0 THEN 'cloud-t4' ELSE 'local' END AS place, CASE WHEN p_partkey % 2 = 0 THEN 'openvino' ELSE 'cpu' END AS backend FROM part")
def stage_placement(s, d):
    p = fx.table(s, d, "part").select("p_partkey", (F.col("p_size") % 3 == 0).alias("cpu_only"), (F.col("p_size") % 2 == 0).alias("needs_cuda"), (F.col("p_size") % 5).cast("double").alias("vram_gb"), (F.col("p_partkey") % 2 == 0).alias("openvino_ok"))
    return governance.placement(p, openvino=True).select("p_partkey", "place", "backend")


@query("""WITH g AS (SELECT n_regionkey AS stage, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS label, CASE WHEN n_regionkey % 2 = 0 THEN 'all' ELSE 'any' END AS mode, n_name AS module, n_nationkey % 4 > 0 AS ok FROM nation),
e AS (SELECT stage, label, any_value(mode) AS mode, CASE WHEN any_value(mode) = 'any' THEN bool_or(ok) ELSE bool_and(ok) END AS ok, CASE WHEN mode = 'any' THEN ' lacks any of ' ELSE ' lacks some of ' END || string_agg(module, ', ' ORDER BY module) AS mods FROM g GROUP BY stage, label, mode)
SELECT stage, bool_and(ok) AS ready, coalesce(string_agg(label || mods, '; ' ORDER BY label) FILTER (NOT ok), '') AS missing FROM e GROUP BY 1""")
def stage_readiness(s, d):
    n = fx.table(s, d, "nation")
    g = n.select(F.col("n_regionkey").alias("stage"), F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b").alias("label"), F.when(F.col("n_regionkey") % 2 == 0, "all").otherwise("any").alias("mode"), F.col("n_name").alias("module"))
    return governance.readiness(g, n.select(F.col("n_name").alias("module"), (F.col("n_nationkey") % 4 > 0).alias("available")))


@query("WITH x AS (SELECT o_custkey AS run, CASE o_orderkey % 5 WHEN 0 THEN 'obj' WHEN 1 THEN 'ply' WHEN 2 THEN 'las' WHEN 3 THEN 'potree' ELSE 'usd' END AS format, o_orderstatus <> 'F' AS ok FROM orders) SELECT run, count(*) AS n_wanted, count(*) FILTER (ok) AS n_ok, count(*) FILTER (format IN ('obj', 'ply', 'las')) AS n_must, count(*) FILTER (ok AND format IN ('obj', 'ply', 'las')) AS n_must_ok, round_even(count(*) FILTER (ok AND format IN ('obj', 'ply', 'las')) / greatest(1, count(*) FILTER (format IN ('obj', 'ply', 'las')))::DOUBLE, 3) AS confidence FROM x GROUP BY 1")
def export_accounting(s, d):
    names = F.array(*map(F.lit, ("obj", "ply", "las", "potree", "usd")))
    o = fx.table(s, d, "orders").select(F.col("o_custkey").alias("run"), F.get(names, (F.col("o_orderkey") % 5).cast("int")).alias("format"), (F.col("o_orderstatus") != "F").alias("ok"))
    return governance.export_accounting(o, "run")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(s, d):
    return fx.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
