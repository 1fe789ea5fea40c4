"""Depth fusion by truncated signed distances, as grouped aggregation over voxels.

Two ways lead to the voxels.  By views (``fuse_views``): blocks of voxels are
allocated where depth lies, and each view looks up, for the voxels of its own
blocks, the depth at the pixel that they project to.  By rays (``fuse``), for
points whose pixels are gone: each depth sample speaks for the voxels along its ray within the truncation;
distances and colours are averaged per voxel, and the surface is where the
mean distance changes sign between neighbouring voxels.  The result does not
hang on how samples are dealt to tasks, nor on tiles: a voxel belongs to one
tile, and points are kept by the tile whose core holds them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.camera import project_point
from .spatial import tile_candidates, tile_owned
from .views import world_points

#: The truncation in voxels.
TRUNCATION = 4


def ray_samples(points: DataFrame, voxel: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(vx, vy, vz, sdf, r, g, b): voxels that each surface point speaks for.

    points: x, y, z, the camera's cx, cy, cz, and r, g, b.
    """
    d = [F.col(c) - F.col(f"c{c}") for c in "xyz"]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    rays = points.withColumn("__len", length).where("__len > 0").withColumn("__k", F.explode(F.sequence(F.lit(-TRUNCATION), F.lit(TRUNCATION))))
    along = F.col("__k") * F.lit(float(voxel)) / F.col("__len")
    ids = [F.floor((F.col(c) + d[i] * along) / F.lit(float(voxel))).alias(f"v{c}") for i, c in enumerate("xyz")]
    placed = rays.select(*keys, *ids, "x", "y", "z", "cx", "cy", "cz", "__len", "r", "g", "b")
    # Signed distance of the voxel's centre along the ray: positive before the surface.
    centre = sum((((F.col(f"v{c}") + 0.5) * voxel - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0)) / F.col("__len")
    sdf = (F.col("__len") - centre) / F.lit(float(TRUNCATION * voxel))
    return placed.select(*keys, "vx", "vy", "vz", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sdf)).alias("sdf"), "r", "g", "b")


def integrate(samples: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per voxel: mean distance and colour, and weight; combined map-side."""
    return samples.groupBy(*keys, "vx", "vy", "vz").agg(F.avg("sdf").alias("sdf"), *(F.avg(c).alias(c) for c in "rgb"), F.count(F.lit(1)).alias("weight"))


def surface(voxels: DataFrame, voxel: float, least_weight: int = 1, keys: tuple[str, ...] = (), limit: float | None = None) -> DataFrame:
    """(x, y, z, r, g, b): zero crossings between neighbours along each axis; voxels at or beyond the limit lie too far from any surface.

    Each voxel is sent to its own place and to the three places before it, so
    one aggregation of numbers brings a voxel and its neighbours together.
    """
    known = voxels.where(F.col("weight") >= least_weight)
    if limit is not None:
        known = known.where((F.col("sdf") < limit) & (F.col("sdf") >= -limit))
    values, places = ("sdf", "r", "g", "b"), ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("slot"), *((F.col(f"v{c}") - d).alias(f"v{c}") for c, d in zip("xyz", step, strict=True))) for i, step in enumerate(places))))
    sent = known.select(*keys, place.alias("__p"), *values).select(*keys, "__p.*", *values)
    met = sent.groupBy(*keys, "vx", "vy", "vz").agg(*(F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{c}{i}") for i in range(4) for c in values))
    own = F.col("sdf0")
    crossings = []
    for i, axis in enumerate("xyz", 1):
        ahead = F.col(f"sdf{i}")
        f = own / (own - ahead)
        at = [((F.col(f"v{c}") + 0.5 + (f if c == axis else 0.0)) * voxel).alias(c) for c in "xyz"]
        colors = [(F.col(f"{c}0") + f * (F.col(f"{c}{i}") - F.col(f"{c}0"))).alias(c) for c in "rgb"]
        crossings.append(F.when(((own > 0) & (ahead <= 0)) | ((own <= 0) & (ahead > 0)), F.struct(*at, *colors)))
    return met.where("sdf0 is not null").select(*keys, F.explode(F.array(*crossings)).alias("__p")).where("__p is not null").select(*keys, "__p.*")


def fuse(points: DataFrame, voxel: float, z_lo: Column | float | None = None, z_hi: Column | float | None = None) -> DataFrame:
    """Surface points of a fused cloud, within a half-open height band if given."""
    if z_lo is not None:
        points = points.where(F.col("z") >= z_lo)
    if z_hi is not None:
        points = points.where(F.col("z") < z_hi)
    return surface(integrate(ray_samples(points, voxel)), voxel)


def fuse_tiled(points: DataFrame, voxel: float, origin: tuple[float, float], tile: float, shape: tuple[int, int], overlap: float) -> DataFrame:
    """``fuse`` tile by tile: (x, y, z, r, g, b, tx, ty), for clouds that are stored and worked on by tiles.

    A tile fuses the points of its core and the overlap around it, and keeps
    the surface in its core.  With an overlap of more than the truncation and a
    voxel the tiles together are the whole.
    """
    if overlap < (TRUNCATION + 1) * voxel:
        raise ValueError("the overlap must hold the truncation and a voxel")
    keys = ("tx", "ty")
    dealt = tile_candidates(points, "x", "y", origin, tile, overlap, shape)
    found = surface(integrate(ray_samples(dealt, voxel, keys), keys), voxel, keys=keys)
    return tile_owned(found, "x", "y", origin, tile, shape)


#: Voxels along a block's side.
BLOCK = 8
#: Mean distances at or beyond this are no part of a surface.
NEAR = 0.98


def touched_blocks(points: DataFrame, voxel: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(name, bx, by, bz): blocks within the truncation of a depth point of the view, each once for a view."""
    side, reach = float(BLOCK * voxel), float(TRUNCATION * voxel)
    # Blocks from the first to the last one that the truncation around a point meets; the steps are constants, so that no filter is inferred from them.
    steps = F.array(*map(F.lit, range(math.ceil(2 * TRUNCATION / BLOCK) + 1)))
    ids = {c: (F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)) for c in "xyz"}
    out = points.select(*keys, "name", *(v.alias(f"{n}{c}") for c, pair in ids.items() for n, v in zip(("lo", "hi"), pair, strict=True))).distinct()
    for c in "xyz":
        out = out.withColumn("__d", F.explode(steps)).withColumn(f"b{c}", F.col(f"lo{c}") + F.col("__d")).where(F.col(f"b{c}") <= F.col(f"hi{c}"))
    return out.select(*keys, "name", "bx", "by", "bz").distinct()


def view_samples(depth: DataFrame, views: DataFrame, blocks: DataFrame, voxel: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(vx, vy, vz, sdf, r, g, b): what each view tells of the voxels of its blocks.

    depth: name, u, v, depth, r, g, b; views: name, k, rotation, center.  A
    voxel takes the depth of the pixel that its centre projects to; distances
    are along the ray, in truncations, and voxels more than one behind the
    depth are hidden from the view.  Blocks meet their view by its name, and
    their voxels the depth by name and pixel: two equi-joins.
    """
    # Cameras as plain numbers, so that a voxel's row is short; blocks are dealt out before they grow by their voxels.
    numbers = [F.col(f"k.{c}").alias(f"__{c}") for c in ("fx", "fy", "cx", "cy")] + [F.col("rotation")[i][j].alias(f"__r{i}{j}") for i in range(3) for j in range(3)] + [F.col("center")[i].alias(f"__c{i}") for i in range(3)]
    deal = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = blocks.repartition(deal, *keys, "name", "bx", "by", "bz").join(views.select(*keys, "name", *numbers), [*keys, "name"])
    n = F.explode(F.sequence(F.lit(0), F.lit(BLOCK**3 - 1))).alias("__n")
    inner = {"x": F.col("__n") % BLOCK, "y": F.floor(F.col("__n") / BLOCK) % BLOCK, "z": F.floor(F.col("__n") / BLOCK**2)}
    met = met.select("*", n).withColumns({f"v{c}": F.col(f"b{c}") * BLOCK + i for c, i in inner.items()})
    k = F.struct(*(F.col(f"__{c}").alias(c) for c in ("fx", "fy", "cx", "cy")))
    rotation, center = F.array(*(F.array(*(F.col(f"__r{i}{j}") for j in range(3))) for i in range(3))), F.array(*(F.col(f"__c{i}") for i in range(3)))
    place = project_point(k, rotation, center, [(F.col(f"v{c}") + 0.5) * float(voxel) for c in "xyz"])
    u, v, z = (place[c] for c in "uvz")
    seen = met.select(*keys, "name", "vx", "vy", "vz", "__fx", "__fy", "__cx", "__cy", F.floor(u + 0.5).alias("u"), F.floor(v + 0.5).alias("v"), z.alias("__z")).where("__z > 0")
    pixels = depth.where("depth > 0").select(*keys, "name", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "depth", "r", "g", "b")
    found = seen.join(pixels, [*keys, "name", "u", "v"])
    x, y = (F.col("u") - F.col("__cx")) / F.col("__fx"), (F.col("v") - F.col("__cy")) / F.col("__fy")
    sdf = (F.col("depth") - F.col("__z")) * F.sqrt(1 + x * x + y * y) / float(TRUNCATION * voxel)
    return found.select(*keys, "vx", "vy", "vz", sdf.alias("sdf"), "r", "g", "b").where("sdf > -1").withColumn("sdf", F.least(F.lit(1.0), "sdf"))


def fuse_views(depth: DataFrame, views: DataFrame, voxel: float, z_lo: float = float("-inf"), z_hi: float = float("inf"), reach: float = float("inf"), keys: tuple[str, ...] = (), window: tuple[Column, Column, Column, Column] | None = None) -> DataFrame:
    """Surface points of depth images: (x, y, z, r, g, b).

    Depth beyond ``reach``, or whose point lies outside the height band or the
    window (x from, x to, y from, y to), is no depth.  With keys, depth and
    views carry them, and each key is fused by itself.
    """
    near = depth.where((F.col("depth") > 0) & (F.col("depth") <= reach))
    x_lo, x_hi, y_lo, y_hi = window or (F.lit(float("-inf")), F.lit(float("inf")), F.lit(float("-inf")), F.lit(float("inf")))
    kept = world_points(near, views, [x_lo, y_lo, z_lo], [x_hi, y_hi, z_hi], keys)
    samples = view_samples(kept, views, touched_blocks(kept, voxel, keys), voxel, keys)
    return surface(integrate(samples, keys), voxel, keys=keys, limit=NEAR)


def view_tiles(views: DataFrame, origin: tuple[float, float], tile: float, shape: tuple[int, int], overlap: float) -> DataFrame:
    """views repeated for each tile (tx, ty) whose core, widened by the overlap, holds the camera's centre."""
    placed = views.withColumn("__x", F.get("center", F.lit(0))).withColumn("__y", F.get("center", F.lit(1)))
    return tile_candidates(placed, "__x", "__y", origin, tile, overlap, shape).drop("__x", "__y")


def tile_window(origin: tuple[float, float], tile: float, shape: tuple[int, int], overlap: float) -> tuple[Column, Column, Column, Column]:
    """The ground that a tile fuses: its core and the overlap; the border tiles reach to infinity."""
    out = []
    for c, start, n in zip(("tx", "ty"), origin, shape, strict=True):
        i = F.col(c)
        out.append(F.when(i == 0, F.lit(float("-inf"))).otherwise(start + i * tile - overlap))
        out.append(F.when(i == n - 1, F.lit(float("inf"))).otherwise(start + (i + 1) * tile + overlap))
    return tuple(out)


def fuse_view_tiles(depth: DataFrame, views: DataFrame, voxel: float, origin: tuple[float, float], tile: float, shape: tuple[int, int], overlap: float, **band: float) -> DataFrame:
    """``fuse_views`` tile by tile: (tx, ty, x, y, z, r, g, b), each point in the tile whose core holds it."""
    if tile <= 0:
        raise ValueError("tiles need a size")
    dealt = view_tiles(views, origin, tile, shape, overlap)
    pixels = depth.join(dealt.select("tx", "ty", "name"), "name")
    found = fuse_views(pixels, dealt, voxel, keys=("tx", "ty"), window=tile_window(origin, tile, shape, overlap), **band)
    return tile_owned(found, "x", "y", origin, tile, shape)


def _committed(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def fuse_tiles_into(folder: str, depth: DataFrame, views: DataFrame, voxel: float, origin: tuple[float, float], tile: float, shape: tuple[int, int], overlap: float, at_once: int = 64, **band: float) -> tuple[DataFrame, int]:
    """``fuse_view_tiles`` for a cloud too large for one job: tiles are fused and committed by rows of tiles, up to ``at_once`` tiles a job.

    Each job writes a folder of its own, which counts once it is complete; a
    later call with the same folder goes on where the last one ended.  Only
    tiles that hold a camera are visited.  Gives the whole cloud and the
    number of jobs that this call ran.
    """
    spark = depth.sparkSession
    dealt = view_tiles(views, origin, tile, shape, overlap)
    group = F.floor((F.col("ty").cast("long") * shape[0] + F.col("tx")) / at_once).cast("long")
    jobs = [r.job for r in dealt.select(group.alias("job")).distinct().orderBy("job").toLocalIterator()]
    parts, ran = [], 0
    for job in jobs:
        path = f"{folder}/tiles={job}"
        if not _committed(spark, path):
            own = dealt.where(group == job)
            pixels = depth.join(own.select("tx", "ty", "name"), "name")
            found = fuse_views(pixels, own, voxel, keys=("tx", "ty"), window=tile_window(origin, tile, shape, overlap), **band)
            tile_owned(found, "x", "y", origin, tile, shape).write.mode("overwrite").parquet(path)
            ran += 1
        parts.append(path)
    if not parts:
        raise ValueError("no views to fuse")
    return spark.read.parquet(*parts), ran
