"""The batch plan of a mission: named stages over tables, skipped when nothing they read has changed.

A stage is a function of (spark, tables, settings) that returns tables.  The
plan keeps order, parameter hashes and statuses; tables are written as
Parquet under the run's folder, so a stage can be resumed in another session.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import camera, grid, projections
from ..functions.scalar import basename
from ..operators import fits, frames, fusion, lineage, orientation, poisson, raster, spatial, views
from ..operators.asof import asof_lerp
from ..operators.fits import derive_crs
from ..operators.governance import FINISHED, REQUIRES, combined_hash, combined_hash_of, hash_object, stages_upto
from ..operators.ordered import every_nth, select_by_displacement, steps
from ..sinks import binary, products, text

Tables = dict[str, DataFrame]
Stage = Callable[[SparkSession, Tables, dict], Tables]
REGISTRY: dict[str, Stage] = {}
#: Tables from outside without which a stage is left out, as if it were not registered.
READS: dict[str, tuple[str, ...]] = {}


def stage(name: str, *reads: str) -> Callable[[Stage], Stage]:
    def register(f: Stage) -> Stage:
        REGISTRY[name], READS[name] = f, reads
        return f

    return register


@dataclass
class Record:
    stage: str
    status: str = "pending"
    inputs_hash: str = ""
    params_hash: str = ""
    outputs_hash: str = ""
    wall: float = 0.0
    error: str = ""
    outputs: dict[str, str] = field(default_factory=dict)


def table_hash(df: DataFrame) -> str:
    """Hash of a table's rows, whatever their order."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    # Hashes of 256 groups first, so that no task sorts all rows' hashes.
    part = rows.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sum(F.conv(F.substring("h", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return part.agg(combined_hash(F.concat_ws(":", "p", F.col("s").cast("string"), F.col("n").cast("string")))).first()[0]


def run(spark: SparkSession, folder: str, tables: Tables, settings: dict, records: dict[str, Record] | None = None, only: str | None = None, upto: str | None = None, force: bool = False) -> dict[str, Record]:
    """Run the registered stages in order.  Stages fail when what they require has not finished."""
    records = dict(records or {})
    active = {n for n in REGISTRY if all(t in tables for t in READS[n])}
    for name in stages_upto(only, upto):
        if name not in active:
            continue
        needs = REQUIRES.get(name, ())
        own = {k: v for k, v in tables.items()}
        record = records.get(name, Record(name))
        inputs = combined_hash_of([records[n].outputs_hash if n in records and records[n].outputs_hash else f"missing:{n}" for n in needs] + [settings.get("inputs_hash", "")])
        params = hash_object(settings.get(name, {}))
        if not force and record.status in FINISHED and (record.inputs_hash, record.params_hash) == (inputs, params):
            for table, path in record.outputs.items():
                tables[table] = spark.read.parquet(path)
            continue
        record = Record(name, "running", inputs, params)
        records[name] = record
        began = time.time()
        try:
            if missing := [n for n in needs if n in active and (n not in records or records[n].status not in FINISHED)]:
                raise ValueError(f"unfinished: {', '.join(missing)}")
            hashes = []
            for table, df in REGISTRY[name](spark, own, {"folder": folder, "inputs": inputs} | settings.get(name, {})).items():
                path = f"{folder}/{name}/{table}"
                df.write.mode("overwrite").parquet(path)
                tables[table] = spark.read.parquet(path)
                record.outputs[table] = path
                hashes.append(table_hash(tables[table]))
            record.outputs_hash, record.status = combined_hash_of(hashes), "done"
        except Exception as e:
            record.status, record.error = "failed", f"{type(e).__name__}: {e}"
        record.wall = time.time() - began
        if record.status == "failed":
            break
    return records


@stage("s0_ingest")
def ingest(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """Frames placed on the track, and the track's projection."""
    track = tables["telemetry"]
    frames = asof_lerp(track, tables["frame_times"], "track_id", ["lat", "lon", "alt"], order="ord", offset_s=settings.get("time_offset_s", 0.0))
    return {"frames": frames, "crs": derive_crs(track, "track_id", settings.get("epsg"))}


@stage("s1_frameqa")
def keyframes(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """Keyframes of the frames that pass the quality gate.

    ``frame_pixels`` (path, pixels: gray values by rows), where given, decides what passes;
    ``displacements`` (path, pixels moved since the accepted frame before), where given, the
    distance between keyframes, else the distance flown does.
    """
    shots, out = tables["frames"], {}
    if "frame_pixels" in tables:
        scores = frames.frame_quality(tables["frame_pixels"], "pixels", int(settings["width"]), int(settings["height"]), float(settings.get("blur_min_varlap", 60.0)), float(settings.get("exposure_low", 0.6)), float(settings.get("exposure_high", 0.6)))
        out["frame_scores"] = scores.drop("pixels")
        shots = shots.join(scores.where("accepted").select("path"), "path", "left_semi")
        if shots.isEmpty():
            raise ValueError("no frame passes the quality gate")
    most = settings.get("max_keyframes", 0)
    if settings.get("method") == "fixed_stride":
        return out | {"keyframes": every_nth(shots, "track_id", ["t"], settings.get("stride", 10), most)}
    if "displacements" in tables:
        moved = shots.join(tables["displacements"].select("path", "displacement"), "path", "left").withColumn("displacement", F.coalesce("displacement", F.lit(0.0)))
        return out | {"keyframes": select_by_displacement(moved, "track_id", ["t"], "displacement", settings.get("min_parallax_px", 20.0), most)}
    return out | {"keyframes": select_by_displacement(steps(shots, "track_id", ["t"]), "track_id", ["t"], "step_m", settings.get("min_displacement_m", 5.0), most)}


def one_code(tables: Tables) -> int:
    """The projection that all tracks share; products of several ones would mix coordinates."""
    codes = [r.epsg for r in tables["crs"].select("epsg").distinct().limit(2).collect()]
    if len(codes) != 1:
        raise ValueError("the tracks have different projections: set one by epsg")
    return codes[0]


@stage("s2_poses")
def poses(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """Poses solved elsewhere, in map coordinates.

    Of each track, the similarity from camera centres to the keyframes'
    projected positions places centres, orientations and sparse points (of the
    track, if they name one; else there must be one track).  Poses of keyframes without a
    position are placed too.
    """
    epsg = one_code(tables)
    shots = tables["keyframes"].withColumn("name", basename(F.col("path")))
    seen = tables["visual_poses"].join(shots.select("name", "track_id", "path", "t", *(F.col(c).alias(f"gps_{c}") for c in ("lat", "lon", "alt"))), "name")
    # Positions relative to their mean, as large coordinates would cost the moments precision.
    east, north = projections.project(F.col("gps_lon"), F.col("gps_lat"), epsg)
    known = seen.where("gps_lat is not null and gps_lon is not null").select("track_id", *(F.get("center", F.lit(i)).alias(f"s{i}") for i in range(3)), east.alias("e0"), north.alias("e1"), F.coalesce("gps_alt", F.lit(0.0)).alias("e2"))
    origin = known.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"e{i}").alias(f"o{i}") for i in range(3)))
    if not origin.where("n < 3").isEmpty() or origin.isEmpty():
        raise ValueError("fewer than three images with a position")
    pairs = known.join(origin, "track_id").withColumns({f"d{i}": F.col(f"e{i}") - F.col(f"o{i}") for i in range(3)})
    spine = fits.fit_similarity(pairs, "track_id").join(origin, "track_id")
    sim = F.struct("scale", "rotation", F.transform(F.arrays_zip(F.col("translation").alias("t"), F.array("o0", "o1", "o2").alias("o")), lambda p: p["t"] + p["o"]).alias("translation"))
    spine = spine.select("track_id", "n", F.array("o0", "o1", "o2").alias("origin"), sim.alias("sim"))
    left = pairs.join(spine.select("track_id", "sim", "origin"), "track_id")
    off = [p - F.col(f"e{i}") for i, p in enumerate(camera.similarity_apply(F.col("sim"), [F.col(f"s{i}") for i in range(3)]))]
    spine = spine.join(left.groupBy("track_id").agg(F.sqrt(F.avg(sum((d * d for d in off[1:]), off[0] * off[0]))).alias("rmse")), "track_id").withColumn("epsg", F.lit(epsg))

    def placed(df: DataFrame, xyz: list[Column]) -> tuple[DataFrame, list[Column]]:
        return df.join(spine.select("track_id", "sim"), "track_id"), camera.similarity_apply(F.col("sim"), xyz)

    met, center = placed(seen, [F.get("center", F.lit(i)) for i in range(3)])
    lon, lat = projections.unproject(F.get("center", F.lit(0)), F.get("center", F.lit(1)), epsg)
    moved = {"center": F.array(*center)} | ({"rotation": camera.rotate_into(F.col("rotation"), F.col("sim.rotation"))} if "rotation" in seen.columns else {})
    out = {"spine": spine, "poses": met.withColumns(moved).drop("sim").withColumns({"lat": lat, "lon": lon, "alt": F.get("center", F.lit(2))})}
    if "sparse_points" in tables:
        sparse = tables["sparse_points"]
        if "track_id" not in sparse.columns:
            tracks = [r.track_id for r in spine.select("track_id").limit(2).collect()]
            if len(tracks) > 1:
                raise ValueError("sparse points of several tracks must name their track_id")
            sparse = sparse.withColumn("track_id", F.lit(tracks[0]))
        sparse, xyz = placed(sparse, [F.col(c) for c in "xyz"])
        out["points"] = sparse.withColumns(dict(zip("xyz", xyz, strict=True))).drop("sim")
    return out | {"registration": views.registration(tables["keyframes"], tables["visual_poses"], "track_id")}


@stage("s3_masking", "detections", "mask_labels")
def masking(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """Pixels of moving things, from detections made elsewhere."""
    pixels = frames.mask_pixels(tables["detections"], tables["mask_labels"], settings.get("min_score", 0.5), settings.get("dilation", 0))
    return {"masks": pixels.select(F.col("frame").alias("name"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))}


@stage("s4_depth", "sparse_points", "relative_depth")
def depth(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """Metric depth: relative depth made elsewhere, scaled by the sparse points that each view sees.

    Views that see too few of them stay relative, and say so.  Colours (r, g,
    b) and other columns of the depth pixels go along.
    """
    reach = float(settings.get("reach_m", 200.0))
    cams = tables["poses"].select("name", camera.intrinsics(F.col("model"), F.col("params")).alias("k"), "rotation", "center", "width", "height", *((F.get("center", F.lit(i)) + s).alias(f"{c}{n}") for i, c in enumerate("xy") for n, s in enumerate((-reach, reach))))
    seen = spatial.visible_points(cams, tables["points"])
    anchors = views.raster_lookup(seen, tables["relative_depth"], "rel")
    lines = fits.trust_fit(fits.fit_scale_shift(anchors, "name", "rel", "depth"), settings.get("min_anchors", 8))
    nothing = spark.createDataFrame([], "name string, u long, v long")
    metric = views.metric_depth(tables["relative_depth"].join(cams.select("name"), "name", "left_semi"), lines, tables.get("masks", nothing))
    every = cams.select("name").join(lines, "name", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "metric": F.coalesce("metric", F.lit(False))})
    return {"depth": metric, "depth_fits": every.withColumn("degraded", F.when(~F.col("metric"), "too few sparse points in view; depth stays relative"))}


@stage("s6_global")
def alignment(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """The poses' consistency: the median step of each track and the poses whose place is visited again."""
    now = tables["poses"].withColumn("ord", F.row_number().over(Window.partitionBy("track_id").orderBy("t", "name")).cast("long"))
    size = now.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_poses"))
    again = spatial.revisits(now.join(size, "track_id"), "track_id", 2 * float(settings.get("gnss_sigma_m", 2.5)), spatial.revisit_gap(F.col("n_poses")))
    closed = again.groupBy("track_id").agg(F.count(F.lit(1)).alias("loop_candidates"))
    before = Window.partitionBy("track_id").orderBy("ord")
    square = sum(((F.get("center", F.lit(i)) - F.lag(F.get("center", F.lit(i))).over(before)) ** 2 for i in range(3)), F.lit(0.0))
    step = now.withColumn("step", F.sqrt(square)).groupBy("track_id").agg(F.percentile("step", F.lit(0.5)).alias("median_step_m"))
    return {"alignment": size.join(step, "track_id").join(closed, "track_id", "left").fillna(0, ["loop_candidates"]), "global_poses": now.select("name", "track_id", *(F.get("center", F.lit(i)).alias(c) for i, c in enumerate(("east", "north", "up"))))}


@stage("s7_dense", "sparse_points", "relative_depth")
def dense(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """A coloured cloud in map coordinates: depth of all views, fused in voxels that look it up, within the height band of the sparse points.

    With ``tile_m`` the ground is fused by tiles, each committed by itself, so
    that a run that breaks off goes on from the tiles it has.
    """
    cams = tables["poses"].select("name", camera.intrinsics(F.col("model"), F.col("params")).alias("k"), "rotation", "center")
    gray = F.lit(float(settings.get("gray", 128)))
    pixels = tables["depth"].withColumns({c: gray for c in "rgb" if c not in tables["depth"].columns})
    band = raster.z_band(tables["points"], settings.get("z_margin_m", 2.0)).first()
    voxel, limits = float(settings.get("voxel_m", 0.5)), {"z_lo": band.z_lo, "z_hi": band.z_hi, "reach": float(settings.get("depth_trunc_m", math.inf))}
    if tile := settings.get("tile_m"):
        spread = cams.agg(*(f(F.get("center", F.lit(i))).alias(f"{c}{n}") for i, c in enumerate("xy") for n, f in (("0", F.min), ("1", F.max)))).first()
        shape = tuple(max(1, math.ceil((spread[f"{c}1"] - spread[f"{c}0"]) / tile)) for c in "xy")
        folder = f"{settings['folder']}/s7_dense/tiles-{hash_object([settings.get('inputs', ''), settings])[:16]}"
        cloud, _ = fusion.fuse_tiles_into(folder, pixels, cams, voxel, (spread["x0"], spread["y0"]), float(tile), shape, float(settings.get("overlap_m", tile / 2)), int(settings.get("tiles_at_once", 64)), **limits)
        cloud = cloud.select("x", "y", "z", "r", "g", "b")
    else:
        cloud = fusion.fuse_views(pixels, cams, voxel, **limits)
    return {"cloud": cloud}


@stage("s8_mesh")
def mesh(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """The cloud's surface: oriented normals and a Poisson solve, without its sparsest vertices; or (``method: height``) a triangulated raster."""
    cloud = tables["cloud"].where(raster.finite("x", "y", "z"))
    if settings.get("method", "poisson") == "height":
        extent = raster.extent_of(cloud, settings.get("resolution", 1.0))
        vertices, faces = raster.height_mesh(raster.elevation_grid(cloud, extent), extent)
        return {"vertices": vertices, "faces": faces}
    depth = int(settings.get("depth", 9))
    ends = raster.bounds(cloud).first()
    if not ends["n"]:
        raise ValueError("no points to mesh")
    extent = max(ends[f"{c}_max"] - ends[f"{c}_min"] for c in "xyz")
    voxel = spark.range(1).select(grid.meshing_voxel(F.lit(float(extent)), depth, F.lit(float(settings.get("voxel_m", 0.5))), F.lit(float(settings.get("mesh_voxel_m", 0.0))))).first()[0]
    colors = tuple(c for c in "rgb" if c in cloud.columns)
    # Near the origin, as map coordinates would cost the covariances digits.
    origin = {c: ends[f"{c}_min"] for c in "xyz"}
    thin = raster.voxel_downsample(cloud.withColumns({c: F.col(c) - o for c, o in origin.items()}), voxel, (0.0, 0.0, 0.0), ("x", "y", "z", *colors))
    points = lineage.written(thin.withColumn("point_id", F.xxhash64("vx", "vy", "vz")).drop("vx", "vy", "vz", "n"))
    near = lineage.written(spatial.neighbours(points, 3 * voxel, int(settings.get("normal_max_nn", 30))))
    normal = lineage.written(fits.normals(near).join(points, "point_id"))
    turned = orientation.oriented(normal, near, int(settings.get("consistent_normals_max_points", orientation.MOST_POINTS)))
    vertices, faces = poisson.poisson_mesh(turned, depth)
    vertices = vertices.withColumns({c: F.col(c) + o for c, o in origin.items()})
    if share := float(settings.get("density_quantile", 0.02)):
        vertices = raster.density_crop(lineage.written(vertices), share)
        faces = poisson.cropped(vertices, faces, vertices)
    if faces.isEmpty():
        raise ValueError("the surface has no faces: try a greater depth")
    return {"vertices": vertices, "faces": faces}


@stage("s9_geo")
def rasters(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """Surface, ground and colour rasters of the dense cloud."""
    cloud = tables["cloud"]
    extent = raster.extent_of(cloud, settings.get("resolution", 0.25))
    surface = raster.elevation_grid(cloud, extent)
    window = max(1, int(round(settings.get("ground_window_m", 3.0) / extent.resolution)))
    return {"dsm": surface, "dtm": raster.opening(surface, extent, window), "ortho": raster.ortho_grid(cloud, extent)}


@stage("s10_export")
def exports(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """Files of the products, and which of the wanted formats could be written."""
    folder = settings["folder"].removeprefix("file://")
    if "://" in folder:
        raise ValueError("product files are written to a mount that all workers see, not to a store by its address")
    extent = raster.extent_of(tables["cloud"], settings.get("resolution", 0.25))
    crs = one_code(tables)

    def to(name: str, write: Callable[[str], None]) -> Callable[[], str]:
        def run_() -> str:
            write(f"{folder}/{name}")
            return f"{folder}/{name}"

        return run_

    writers = {
        "ply": to("cloud.ply", lambda p: products.write_ply(tables["cloud"], p)), "las": to("cloud.las", lambda p: binary.write_las(tables["cloud"], p)),
        "obj": to("mesh.obj", lambda p: text.write_obj(tables["vertices"], tables["faces"], p)), "glb": to("mesh.glb", lambda p: binary.write_glb(tables["vertices"], tables["faces"], p)),
        "geotiff": to("dsm.tif", lambda p: binary.write_geotiff(tables["dsm"], extent, p, crs)), "ortho": to("ortho.tif", lambda p: binary.write_rgb_geotiff(tables["ortho"], extent, p, crs)),
    }
    results = products.export(settings.get("formats", ["ply", "las", "obj", "glb", "geotiff", "ortho", "fbx"]), writers)
    return {"exports": products.export_rows(spark, settings.get("run", "run"), results)}


@stage("report")
def report(spark: SparkSession, tables: Tables, settings: dict) -> Tables:
    """One row per table that the run has: its number of rows."""
    names = [n for n in ("keyframes", "poses", "points", "masks", "depth", "cloud", "vertices", "dsm", "dtm", "ortho", "exports") if n in tables]
    counts = [tables[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return {"report": out}
