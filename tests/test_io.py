"""Sources, sinks, plans and streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators.raster import Extent
from skyloom.functions import geo
from skyloom.plans import mission
from skyloom.sinks import products
from skyloom.sinks import text as sink
from skyloom.sources import ply, runs, telemetry
from skyloom.streaming.live import live_keyframes, live_minutes

NEW = "1\n00:00:01,000 --> 00:00:02,000\n[latitude: 22.5431] [longitude: 113.9425] [rel_alt: 0.0 abs_alt: 54.4] [yaw: 10.0]\n\n2\n00:00:02,5 --> 00:00:03,000\n[latitude: 22.5432] [longitude: 113.9426] [rel_alt: 1.5]\n"
OLD = "1\r\n00:00:00,000 --> 00:00:01,000\r\nGPS(113.9425,22.5431,20) BAROMETER:54.4\r\n"


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["ord"])


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text(NEW)
    a = rows(telemetry.read_telemetry(spark, "dji_srt", str(tmp_path / "a.srt")))
    assert [(r["t"], r["alt"], r["rel_alt"], r["yaw"]) for r in a] == [(0.0, 54.4, 0.0, 10.0), (1.5, 1.5, 1.5, None)]
    old = rows(telemetry.parse_srt(spark.createDataFrame([("x", OLD)], "track_id string, text string")))
    assert [(r["lat"], r["lon"], r["alt"], r["rel_alt"]) for r in old] == [(22.5431, 113.9425, 54.4, None)]
    none = telemetry.parse_srt(spark.createDataFrame([("x", "1\n00:00:00,000 --> 00:00:01,000\nhello\n")], "track_id string, text string"))
    with pytest.raises(ValueError, match="no position"):
        telemetry.require_samples(none)
    for bad in (("nope", "x"), ("csv", "")):
        with pytest.raises(ValueError):
            telemetry.read_telemetry(spark, *bad)


def test_subtitle_round_trip(spark):
    t = spark.createDataFrame([("a", i, 22.5 + i / 1e6, 113.9, 50.0 + i, None, 1.5, None, None) for i in range(5)], "track_id string, ord long, lat double, lon double, alt double, rel_alt double, yaw double, pitch double, roll double")
    back = rows(telemetry.parse_srt(sink.srt_text(t, "track_id", "ord", 25.0)))
    assert [(r["t"], r["lat"], r["alt"], r["yaw"], r["rel_alt"]) for r in back] == [(pytest.approx(i / 25), pytest.approx(22.5 + i / 1e6), 50.0 + i, 1.5, None) for i in range(5)]


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("time,latitude,longitude,abs_alt\n2024-01-01T00:00:00Z,22.5,113.9,54\n2024-01-01T00:00:01Z,22.6,114.0,\n")
    got = rows(telemetry.read_csv(spark, str(tmp_path / "t.csv"), {"t": "time", "lat": 1, "lon": "2", "alt": "abs_alt"}))
    assert [(r["t"], r["lat"], r["lon"], r["alt"]) for r in got] == [(0.0, 22.5, 113.9, 54.0), (1.0, 22.6, 114.0, 0.0)]
    with pytest.raises(ValueError, match="missing column"):
        telemetry.read_csv(spark, str(tmp_path / "t.csv"), {"t": "when", "lat": 1, "lon": 2})
    (tmp_path / "bad.csv").write_text("t,lat,lon\nsoon,1,2\n")
    with pytest.raises(Exception, match="not a time"):
        telemetry.read_csv(spark, str(tmp_path / "bad.csv"), {"t": "t", "lat": "lat", "lon": "lon"}).collect()


def test_exif_and_mavlink(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"GPSLatitude": 1.0, "GPSLongitude": 2.0, "SampleTime": 5}, {"GPSLatitude": 1.0}, {"GPSLatitude": 1.5, "GPSLongitude": 2.5, "GPSAltitude": 9}]))
    got = rows(telemetry.read_telemetry(spark, "exif", str(tmp_path / "e.json")))
    assert [(r["t"], r["lat"], r["alt"]) for r in got] == [(0.0, 1.0, 0.0), (-3.0, 1.5, 9.0)]
    m = spark.createDataFrame([("a", 0, "GPS_RAW_INT", 1.0, 10_000_000, 20_000_000, 3000, None, None), ("a", 1, "GLOBAL_POSITION_INT", 3.0, 10_000_001, 20_000_000, 4000, 500, 9000), ("a", 2, "GPS_RAW_INT", 2.0, 0, 0, 0, None, None), ("a", 3, "GLOBAL_POSITION_INT", 2.5, 10_000_002, 20_000_000, 4000, 600, 65535)], "track_id string, ord long, type string, t double, lat long, lon long, alt long, relative_alt long, hdg long")
    got = sorted((r.t, round(r.lat, 7), r.alt, r.rel_alt, r.yaw) for r in telemetry.decode_mavlink(m).collect())
    assert got == [(0.0, 1.0, 3.0, None, None), (1.5, 1.0000002, 4.0, 0.6, None), (2.0, 1.0000001, 4.0, 0.5, 90.0)]


def test_checkpoints(spark, tmp_path):
    (tmp_path / "c.csv").write_text("latitude,lon,longitude,abs_alt\n1,2,,3\n1,,9,3\nx,1,1,1\n")
    assert sorted(tuple(r) for r in telemetry.read_checkpoints(spark, str(tmp_path / "c.csv")).collect()) == [(1.0, 2.0, 3.0), (1.0, 9.0, 3.0)]


def test_unit_colors_are_written_as_bytes(spark, tmp_path):
    points = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 0.5), (1.0, 0.0, 0.0, 0.9, 0.2, 0.5)], "x double, y double, z double, r double, g double, b double")
    products.write_ply(points.repartition(2), str(tmp_path / "unit.ply"))
    assert sorted(tuple(r)[3:] for r in products.read_ply(spark, str(tmp_path / "unit.ply")).collect()) == [(229, 51, 127), (255, 0, 127)]


def test_ply(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(float(np.float32(a)), float(np.float32(b)), float(np.float32(c)), int(r), int(g), int(bl)) for (a, b, c), (r, g, bl) in zip(rng.normal(size=(300, 3)), rng.integers(0, 256, (300, 3)), strict=True)]
    p = spark.createDataFrame(data, "x double, y double, z double, r int, g int, b int")
    path = str(tmp_path / "cloud.ply")
    products.write_ply(p.repartition(5), path)
    for chunk in (None, 7, 1000):
        assert sorted(tuple(r) for r in products.read_ply(spark, path, chunk).collect()) == sorted(data)
    assert [f.name for f in tmp_path.iterdir()] == ["cloud.ply"]
    h = ply.read_header(path)
    body = (tmp_path / "cloud.ply").read_bytes()
    (tmp_path / "cut.ply").write_bytes(body[: h.size + 15 * 10 + 4])  # ends within the eleventh point
    assert products.read_ply(spark, str(tmp_path / "cut.ply")).count() == 10
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\ncomment c\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    assert sorted(tuple(r) for r in products.read_ply(spark, str(tmp_path / "a.ply")).collect()) == [(1.0, 2.0, 3.0, None, None, None), (4.0, 5.0, 6.0, None, None, None)]
    with pytest.raises(Exception, match="not a PLY"):
        (tmp_path / "no.ply").write_text("obj\n")
        products.read_ply(spark, str(tmp_path / "no.ply")).collect()
    assert struct.unpack("<fff", body[h.size : h.size + 12])


def test_colors(spark):
    p = spark.createDataFrame([(1.0, 0.0, 0.5)], "r double, g double, b double")
    assert tuple(products.byte_colors(p).first()) == (255, 0, 127)
    assert tuple(products.las_colors(spark.createDataFrame([(255, 1, 0)], "r int, g int, b int")).first()) == (65280, 256, 0)


def test_mesh_and_raster(spark, tmp_path):
    v = spark.createDataFrame([(5, 0.0, 0.0, 1.5), (70_000, 1.0, 0.0, 0.0), (9, 0.0, 1.0, 0.0)], "vertex long, x double, y double, z double")
    f = spark.createDataFrame([(5, 9, 70_000)], "a long, b long, c long")
    sink.write_obj(v, f, str(tmp_path / "m"))
    lines = [x for part in sorted((tmp_path / "m").glob("part-*")) for x in part.read_text().splitlines()]
    assert lines == ["v 0.000000 0.000000 1.500000", "v 0.000000 1.000000 0.000000", "v 1.000000 0.000000 0.000000", "f 1 2 3"]
    grid = spark.createDataFrame([(0, 1, 2.5)], "row int, col int, z double")
    e = Extent(0, 0, 2, 1, 1.0)
    products.write_raster(grid, e, str(tmp_path / "r"), 32631)
    assert spark.read.parquet(str(tmp_path / "r")).select("z", "epsg", "width").first()[:] == (2.5, 32631, 2)
    assert products.raster_array(grid, e).tolist() == [[-9999.0, 2.5]]


def test_documents(spark, tmp_path):
    sink.write_json({"b": 1}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"b": 1} and len(list(tmp_path.iterdir())) == 1
    page = sink.report_html("a<b", {"n": 1}, [{"stage": "s&t"}])
    assert "a&lt;b" in page and "s&amp;t" in page
    t = spark.createDataFrame([("a", 0.12345, 1.0, 2.0, 3.0, None, None, None, None)], "track_id string, t double, lat double, lon double, alt double, rel_alt double, yaw double, pitch double, roll double")
    assert json.loads(sink.telemetry_json(t).first().value) == {"track_id": "a", "t": 0.123, "lat": 1.0, "lon": 2.0, "alt": 3.0}
    out = products.export(["OBJ", "las", "obj", "ply"], {"obj": lambda: "m.obj", "ply": lambda: 1 / 0})
    assert [(f, ok) for f, ok, _, _ in out] == [("obj", True), ("las", False), ("ply", False)]
    assert products.export_rows(spark, "r", out).count() == 3


def test_runs(spark, tmp_path):
    for n, body in (("a", json.dumps({"run_id": "a", "stages": [{"name": "s0_ingest", "status": "done", "wall_seconds": 1.5, "metrics": {"n": "3"}}]})), ("b", "{broken"), ("c", json.dumps({"run_id": "c", "stages": []}))):
        (tmp_path / n).mkdir()
        (tmp_path / n / "manifest.json").write_text(body)
    r = runs.read_runs(spark, f"{tmp_path}/*/manifest.json").cache()
    assert sorted((x.run_id or "", x.error) for x in r.collect()) == [("", True), ("a", False), ("c", False)]
    assert sorted((x.run, x.stage) for x in runs.stage_records(r).collect()) == [("a", "s0_ingest"), ("c", None)]
    with pytest.raises(Exception):
        runs.register_inputs(spark, str(tmp_path / "nothing*"), "video").collect()


def test_settings():
    base = {"crs": {"epsg": 1, "mode": "auto"}, "geo": {"res": 0.5}}
    out = runs.settings([base, {"crs": {"epsg": 2}}], environment={"SKYLOOM__GEO__RES": "0.25", "OTHER": "1"}, sets=["crs.mode=fixed"])
    assert out == {"crs": {"epsg": 2, "mode": "fixed"}, "geo": {"res": 0.25}} and base["geo"]["res"] == 0.5
    with pytest.raises(ValueError, match="unknown settings"):
        runs.settings([base, {"typo": 1}], environment={})
    with pytest.raises(ValueError, match="a.b=value"):
        runs.settings([base], environment={}, sets=["x"])


def test_mission_resumes(spark, tmp_path):
    track = spark.createDataFrame([("a", i, float(i), 10.0 + i / 1e4, 20.0, 100.0) for i in range(20)], "track_id string, ord long, t double, lat double, lon double, alt double")
    times = spark.createDataFrame([("a", i, i * 1.0, f"img/{i}.jpg") for i in range(20)], "track_id string, index long, t double, path string")
    visual = spark.createDataFrame([(f"{i}.jpg", [0.0, 0.0, 1.0]) for i in range(20)], "name string, center array<double>")
    cloud = spark.createDataFrame([(x / 4, y / 4, 1.0, 1, 2, 3) for x in range(20) for y in range(20)], "x double, y double, z double, r int, g int, b int")
    tables = lambda: {"telemetry": track, "frame_times": times, "visual_poses": visual, "cloud": cloud}
    settings = {"s1_frameqa": {"min_displacement_m": 30.0}, "s9_geo": {"resolution": 1.0}}
    out = tables()
    done = mission.run(spark, str(tmp_path), out, settings)
    assert {n: (r.status, r.error) for n, r in done.items()} == dict.fromkeys(("s0_ingest", "s1_frameqa", "s2_poses", "s6_global", "s8_mesh", "s9_geo", "s10_export", "report"), ("done", ""))
    assert out["keyframes"].count() == 7 and out["dtm"].count() == 25
    again = mission.run(spark, str(tmp_path), tables(), settings, done)
    assert all(again[n] is done[n] for n in done)
    changed = mission.run(spark, str(tmp_path), tables(), settings | {"s1_frameqa": {"min_displacement_m": 60.0}}, done)
    assert changed["s0_ingest"] is done["s0_ingest"] and changed["s2_poses"].inputs_hash != done["s2_poses"].inputs_hash
    broken = mission.run(spark, str(tmp_path), tables() | {"visual_poses": visual.limit(1)}, settings)
    assert broken["s2_poses"].status == "failed" and "s9_geo" not in broken


ORIGIN = (445_201.0, 1_105_474.0)
#: The visual frame: map = SCALE * TURN @ visual + SHIFT.
SCALE, TURN, SHIFT = 4.0, np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), np.array([ORIGIN[0], ORIGIN[1], 0.0])


def slope(x):
    return 2.0 + 0.05 * x


def slope_tables(spark):
    """Twenty-five cameras above a slope that rises to the east, looking down; poses and points in the visual frame, colours by place."""
    grid = [(i, 20.0 * (i % 5), 20.0 * (i // 5)) for i in range(25)]
    at = spark.createDataFrame([(i, ORIGIN[0] + x, ORIGIN[1] + y) for i, x, y in grid], "i long, e double, n double")
    lon, lat = geo.unproject_utm(F.col("e"), F.col("n"), F.lit(32634))
    track = at.select(F.lit("a").alias("track_id"), F.col("i").alias("ord"), F.col("i").cast("double").alias("t"), lat.alias("lat"), lon.alias("lon"), F.lit(60.0).alias("alt"))
    times = spark.createDataFrame([("a", i, float(i), f"img/{i}.jpg") for i, _, _ in grid], "track_id string, index long, t double, path string")
    down = np.array([[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]])
    visual = lambda p: ((np.array(p) - SHIFT) @ TURN / SCALE).tolist()
    poses = spark.createDataFrame([(f"{i}.jpg", "PINHOLE", [20.0, 20.0, 16.0, 16.0], (down @ TURN).tolist(), visual([ORIGIN[0] + x, ORIGIN[1] + y, 60.0]), 32, 32) for i, x, y in grid], "name string, model string, params array<double>, rotation array<array<double>>, center array<double>, width int, height int")
    pixels = []
    for i, x, y in grid:
        for u in range(32):
            for v in range(32):
                # The depth at which the pixel's ray meets the slope.
                depth = (60.0 - slope(x)) / (1 + 0.05 * (u - 16) / 20)
                east, north = x + (u - 16) / 20 * depth, y - (v - 16) / 20 * depth
                pixels.append((f"{i}.jpg", u, v, (depth - 5.0) / 2.0, 200 if east < 40 else 50, 180 if north < 40 else 30, 90))
    relative = spark.createDataFrame(pixels, "name string, u long, v long, rel double, r int, g int, b int")
    sparse = spark.createDataFrame([(k, *visual([ORIGIN[0] + x, ORIGIN[1] + y, slope(x)])) for k, (x, y) in enumerate((x, y) for x in range(-40, 130, 3) for y in range(-40, 130, 3))], "point_id long, x double, y double, z double")
    boxes = spark.createDataFrame([("0.jpg", "car", 0.9, 0.0, 0.0, 4.0, 4.0, 32, 32)], "frame string, label string, score double, x0 double, y0 double, x1 double, y1 double, width int, height int")
    labels = spark.createDataFrame([("car", False)], "label string, small boolean")
    return {"telemetry": track, "frame_times": times, "visual_poses": poses, "relative_depth": relative, "sparse_points": sparse, "detections": boxes, "mask_labels": labels}


def test_mission_of_all_stages(spark, tmp_path):
    """Poses, points, depth, cloud, mesh, rasters and files of the slope, in map coordinates and with its colours."""
    tables = slope_tables(spark)
    settings = {"s1_frameqa": {"min_displacement_m": 1.0}, "s7_dense": {"voxel_m": 2.0, "tile_m": 60.0, "overlap_m": 60.0}, "s8_mesh": {"resolution": 4.0, "depth": 5}, "s9_geo": {"resolution": 4.0}, "s10_export": {"resolution": 4.0}}
    done = mission.run(spark, str(tmp_path), tables, settings)
    assert {n: (r.status, r.error) for n, r in done.items()} == dict.fromkeys(mission.REGISTRY, ("done", "")) and len(done) == 11
    spine = tables["spine"].first()
    assert abs(spine.sim.scale - SCALE) < 1e-6 and np.allclose(spine.sim.rotation, TURN, atol=1e-6) and spine.rmse < 1e-3 and spine.epsg == 32634
    for r in tables["poses"].collect():
        i = int(r.name[:-4])
        assert np.allclose(r.center, [ORIGIN[0] + 20 * (i % 5), ORIGIN[1] + 20 * (i // 5), 60.0], atol=1e-3)
        assert np.allclose(r.rotation, [[1, 0, 0], [0, -1, 0], [0, 0, -1]], atol=1e-6) and abs(r.lat - r.gps_lat) < 1e-8 and abs(r.lon - r.gps_lon) < 1e-8
    assert all(abs(r.z - slope(r.x - ORIGIN[0])) < 1e-3 for r in tables["points"].collect())
    assert tables["masks"].count() == 16 and tables["depth"].where("depth = 0").count() == 16
    assert all(r.metric and abs(r.a - 2.0) < 0.2 for r in tables["depth_fits"].collect()) and tables["depth_fits"].count() == 25
    cloud = tables["cloud"].toPandas()
    assert len(cloud) > 1000 and np.median(np.abs(cloud.z - slope(cloud.x - ORIGIN[0]))) < 0.3
    east, north = cloud.x - ORIGIN[0], cloud.y - ORIGIN[1]
    inner = (np.abs(east - 40) > 6) & (np.abs(north - 40) > 6)
    assert (np.abs(cloud.r - np.where(east < 40, 200, 50))[inner] < 1).mean() > 0.99 and (np.abs(cloud.g - np.where(north < 40, 180, 30))[inner] < 1).mean() > 0.99
    assert {r.format: r.ok for r in tables["exports"].collect()} == {"ply": True, "las": True, "obj": True, "glb": True, "geotiff": True, "ortho": True, "fbx": False}
    for name in ("dsm.tif", "ortho.tif"):
        tags = tiff_tags((tmp_path / name).read_bytes())
        assert tags[33550][:2] == [4.0, 4.0] and abs(tags[33922][3] - cloud.x.min()) < 1e-6 and abs(tags[33922][4] - cloud.y.max()) < 1e-6 and 32634 in tags[34735]
    ortho = tables["ortho"].toPandas()
    west = ortho[cloud.x.min() + 4 * ortho.col - ORIGIN[0] < 30]
    assert west.r.median() == 200 and set(ortho.g.unique()) >= {180, 30}
    assert {r.name: r.n for r in tables["report"].collect()}["poses"] == 25 and tables["registration"].first().rate == 1.0


def tiff_tags(blob):
    """Doubles and shorts of a little-endian file's first directory."""
    import struct

    (at,) = struct.unpack_from("<I", blob, 4)
    (n,) = struct.unpack_from("<H", blob, at)
    out = {}
    for i in range(n):
        tag, kind, count, value = struct.unpack_from("<HHII", blob, at + 2 + 12 * i)
        if kind in (3, 12):
            size, code = {3: (2, "H"), 12: (8, "d")}[kind]
            place = at + 2 + 12 * i + 8 if size * count <= 4 else value
            out[tag] = list(struct.unpack_from(f"<{count}{code}", blob, place))
    return out


def test_mission_gates(spark):
    """The quality gate, displacements by features, views without anchors, tracks of two zones."""
    tables = slope_tables(spark)
    tables |= mission.ingest(spark, tables, {})
    rng = np.random.default_rng(2)
    shots = [(f"img/{i}.jpg", [float(v) for v in (rng.integers(0, 255, 64) if i % 3 else np.full(64, 90))]) for i in range(25)]
    tables["frame_pixels"] = spark.createDataFrame(shots, "path string, pixels array<double>")
    gate = {"width": 8, "height": 8, "min_displacement_m": 0.0}
    kept = mission.keyframes(spark, tables, gate)
    assert sorted(int(r.path[4:-4]) for r in kept["keyframes"].collect()) == [i for i in range(25) if i % 3]
    with pytest.raises(ValueError, match="quality"):
        mission.keyframes(spark, tables, gate | {"blur_min_varlap": 1e12})
    tables["displacements"] = spark.createDataFrame([(f"img/{i}.jpg", 11.0) for i in range(25)], "path string, displacement double")
    del tables["frame_pixels"]
    moved = mission.keyframes(spark, tables, {})["keyframes"]
    assert sorted(int(r.path[4:-4]) for r in moved.collect()) == list(range(0, 25, 2))
    stride = mission.keyframes(spark, tables, {"method": "fixed_stride", "stride": 4})["keyframes"]
    assert sorted(int(r.path[4:-4]) for r in stride.collect()) == list(range(0, 25, 4))
    tables |= mission.keyframes(spark, tables, {"method": "fixed_stride", "stride": 1})
    tables |= mission.poses(spark, tables, {})
    # Only the first view keeps points near it.
    center = {r.name: r.center for r in tables["poses"].collect()}["0.jpg"]
    tables["points"] = tables["points"].where(F.abs(F.col("x") - center[0]) < 8).where(F.abs(F.col("y") - center[1]) < 8)
    out = mission.depth(spark, tables, {"min_anchors": 8})
    judged = {r.name: (r.metric, r.degraded) for r in out["depth_fits"].collect()}
    assert judged["0.jpg"] == (True, None) and judged["24.jpg"][0] is False and "relative" in judged["24.jpg"][1]
    far = out["depth"].where("name = '24.jpg'").join(tables["relative_depth"].select("name", "u", "v", "rel"), ["name", "u", "v"])
    assert far.count() == 1024 and far.where("depth <> rel").isEmpty() and out["depth"].columns == ["name", "u", "v", "depth", "r", "g", "b"]
    with pytest.raises(ValueError, match="projection"):
        mission.poses(spark, tables | {"crs": spark.createDataFrame([("a", 32634), ("b", 32635)], "track_id string, epsg int")}, {})


def test_streams_equal_batches(spark, tmp_path):
    from skyloom.operators.ordered import select_by_displacement, steps

    rng = np.random.default_rng(1)
    data = [(k, float(i), 10 + float(np.cumsum(rng.random(60))[i]) / 1e4, 20.0, f"2024-01-01 00:{i:02d}:00", float(i)) for k in ("a", "b") for i in range(60)]
    schema = "track_id string, t double, lat double, lon double, at string, alt double"
    rows = spark.createDataFrame(data, schema)
    for i in range(3):
        rows.where(f"t >= {i * 20} and t < {i * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = live_keyframes(stream.select("track_id", "t", "lat", "lon"), 20.0).writeStream.format("memory").queryName("keys").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch = select_by_displacement(steps(rows, "track_id", ["t"]), "track_id", ["t"], "step_m", 20.0)
    pick = lambda df: sorted((r.track_id, r.t) for r in df.collect())
    assert pick(spark.table("keys")) == pick(batch)
    minutes = live_minutes(stream.withColumn("ts", F.to_timestamp("at")), late="0 seconds", width="10 minutes")
    q = minutes.writeStream.format("memory").queryName("minutes").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.n for r in spark.table("minutes").collect()} == {10}
