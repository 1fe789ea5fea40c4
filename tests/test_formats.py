"""Binary logs, pixels, arrays and video headers: made-up files against what they were made of."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import projections
from skyloom.sources import mavlink, pixels, runs, telemetry


def x25(data: bytes) -> int:
    """The checksum, bit by bit."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ 0x8408 if crc & 1 else crc >> 1
    return crc


def message(kind: int, payload: bytes, version: int = 1, signed: bool = False) -> bytes:
    if version == 1:
        head = bytes([len(payload), 7, 1, 1, kind])
    else:
        payload = payload.rstrip(b"\0") or b"\0"
        head = bytes([len(payload), int(signed), 0, 7, 1, 1]) + kind.to_bytes(3, "little")
    seed = {24: 24, 33: 104, 0: 50}[kind]
    body = bytes([0xFE if version == 1 else 0xFD]) + head + payload
    return body + struct.pack("<H", x25(body[1:] + bytes([seed]))) + (b"s" * 13 if signed else b"")


def fused(i: int, hdg: int = 0) -> bytes:
    return struct.pack("<IiiiihhhH", i * 200, 225_431_000 + i, -1_139_425_000 - i, 54_000 + i, 1_000 + i, 0, 0, 0, hdg)


def raw_fix(i: int) -> bytes:
    return struct.pack("<QiiiHHHHBB", i, 225_000_000 + i, 1_139_000_000, 9_000, 1, 1, 1, 1, 3, 9)


def log(n: int) -> tuple[bytes, list]:
    rng = np.random.default_rng(5)
    out, truth = b"", []
    for i in range(n):
        stamp = struct.pack(">Q", 1_700_000_000_000_000 + i * 250_000)
        if i % 11 == 0:
            out += rng.integers(0, 256, int(rng.integers(0, 60)), dtype=np.uint8).tobytes() + b"\xfe\xfd\xfe"  # junk with start bytes
        out += stamp + message(0, bytes(9))  # a kind that is not read
        if i % 13 == 5:
            out += stamp + message(33, fused(i))[:-3] + b"\x00"  # torn
            continue
        fix = i < 3
        out += stamp
        truth.append((len(out), "GPS_RAW_INT" if fix else "GLOBAL_POSITION_INT", i))
        hdg = 65535 if i % 7 == 0 else i
        out += message(24, raw_fix(i)) if fix else message(33, fused(i, hdg), 1 + i % 2, i % 4 == 1)
    return out, truth


def test_binary_log(spark, tmp_path):
    data, truth = log(200)
    (tmp_path / "a.tlog").write_bytes(data)
    spark.dataSource.register(mavlink.MavlinkDataSource)
    seen = []
    for chunk in (1 << 20, 4096, 777):  # any cut gives the same messages
        got = spark.read.format("mavlink").option("chunk", chunk).load(str(tmp_path)).orderBy("ord").collect()
        seen.append([(r.ord, r.type, r.lat, r.lon, r.alt, r.relative_alt, r.hdg, r.t) for r in got])
    assert seen[0] == seen[1] == seen[2]
    assert [x[:2] for x in seen[0]] == [x[:2] for x in truth]
    for (_, kind, lat, lon, alt, rel, hdg, t), (_, _, i) in zip(seen[0], truth, strict=True):
        assert t == pytest.approx(1_700_000_000 + i / 4)
        if kind == "GPS_RAW_INT":
            assert (lat, lon, alt, rel, hdg) == (225_000_000 + i, 1_139_000_000, 9_000, None, None)
        else:
            assert (lat, lon, alt, rel, hdg) == (225_431_000 + i, -1_139_425_000 - i, 54_000 + i, 1_000 + i, 65535 if i % 7 == 0 else i)
    track = telemetry.read_telemetry(spark, "mavlink", str(tmp_path / "a.tlog"), chunk=1000).orderBy("t").collect()
    # Raw fixes count until the first fused position.
    assert len(track) == len(truth) and track[0].t == 0.0 and track[0].rel_alt is None and track[-1].alt == pytest.approx(54.199)
    assert [r.yaw for r in track[3:6]] == [0.03, 0.04, 0.06] and track[6].yaw is None
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.tlog").write_bytes(b"")
    assert spark.read.format("mavlink").load(str(tmp_path / "none")).isEmpty()
    own = spark.read.format("mavlink").option("stamped", "false").load(str(tmp_path)).where("type = 'GLOBAL_POSITION_INT'").agg(F.max("t")).first()[0]
    assert own == pytest.approx(199 * 0.2)


def test_every_cut(tmp_path):
    """Ranges of a byte or three, without Spark."""
    data, truth = log(20)
    path = tmp_path / "a.tlog"
    path.write_bytes(data)
    for chunk in (1, 3, 64):
        r = mavlink.MavlinkReader({"path": str(path), "chunk": str(chunk)})
        places = sorted(p for part in r.partitions() for b in r.read(part) for p in b.column("ord").to_pylist())
        assert places == [t[0] for t in truth]
    path.write_bytes(b"")
    assert mavlink.MavlinkReader({"path": str(path)}).partitions() == []


def test_projections(spark):
    # Published points: the origin of each system, and the offsets there.
    for code, lon, lat, e, n in ((2154, 3.0, 46.5, 700_000, 6_600_000), (3034, 10.0, 52.0, 4_000_000, 2_800_000), (7755, 80.0, 24.0, 4_000_000, 4_000_000), (5179, 127.5, 38.0, 1_000_000, 2_000_000), (3857, 180.0, 0.0, 20_037_508.342789, 0)):
        x, y = spark.range(1).select(*projections.project(F.lit(lon), F.lit(lat), code)).first()
        assert abs(x - e) < 1e-3 and abs(y - n) < 1e-3
        back = spark.range(1).select(*projections.unproject(F.lit(float(e)), F.lit(float(n)), code)).first()
        assert abs(back[0] - lon) < 1e-9 and abs(back[1] - lat) < 1e-9
    # Across the antimeridian, and null.
    df = spark.createDataFrame([(-179.0, -40.0, 2193), (None, 1.0, 3857)], "lon double, lat double, epsg int")
    there = projections.project_rows(df, "lon", "lat", "epsg")
    assert there.columns == ["lon", "lat", "epsg", "easting", "northing"]
    back = projections.unproject_rows(there.drop("lon", "lat"), "easting", "northing", "epsg").orderBy("epsg").collect()
    assert back[0].lon == pytest.approx(-179.0, abs=1e-7) and back[0].lat == pytest.approx(-40.0, abs=1e-7) and back[1].lon is None
    with pytest.raises(ValueError, match="no projection"):
        projections.project(F.lit(1.0), F.lit(1.0), 4326)
    with pytest.raises(Exception, match="no projection of this code: 4326"):
        projections.project_rows(df.withColumn("epsg", F.lit(4326)), "lon", "lat", "epsg").collect()


def filtered_png(image: np.ndarray, kinds, color: int, depth: int = 8, palette: bytes = b"") -> bytes:
    """A PNG with a stated filter for each row, written byte by byte."""
    h, w = image.shape[:2]
    raw = image.reshape(h, -1)
    step = max(1, raw.shape[1] // w) if depth >= 8 else 1
    out = bytearray()
    for y in range(h):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for i in range(raw.shape[1]):
            a = int(raw[y, i - step]) if i >= step else 0
            b = int(raw[y - 1, i]) if y else 0
            c = int(raw[y - 1, i - step]) if y and i >= step else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(p - v))  # the first of equals
            out.append((int(raw[y, i]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    width = w if depth >= 8 else w * 8 // depth
    packed = zlib.compress(bytes(out))
    return pixels.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, h, depth, color, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


def test_png_kinds():
    rng = np.random.default_rng(3)
    smooth = (np.add.outer(np.arange(17), np.arange(23))[..., None] * [3, 5, 7] + rng.integers(0, 9, (17, 23, 3))).astype(np.uint8)
    for kinds in ((0,), (1,), (2,), (3,), (4,), (0, 2, 2), (4, 3, 2, 1, 0), (1, 4, 4, 3)):
        assert np.array_equal(pixels.decode_png(filtered_png(smooth, kinds, 2)), smooth)
    alpha = rng.integers(0, 256, (9, 5, 4), dtype=np.uint8)
    assert np.array_equal(pixels.decode_png(filtered_png(alpha, (4, 1), 6)), alpha[..., :3])
    gray = rng.integers(0, 256, (6, 8, 1), dtype=np.uint8)
    assert np.array_equal(pixels.decode_png(filtered_png(gray, (3, 2), 0)), np.repeat(gray, 3, 2))
    deep = rng.integers(0, 256, (6, 8, 2), dtype=np.uint8)  # 16 bits a sample
    assert np.array_equal(pixels.decode_png(filtered_png(deep, (4,), 0, 16)), np.repeat(deep[..., :1], 3, 2))
    colors = rng.integers(0, 256, (16, 3), dtype=np.uint8)
    index = rng.integers(0, 256, (4, 3, 1), dtype=np.uint8)  # two samples a byte
    both = np.stack([index[..., 0] >> 4, index[..., 0] & 15], 2).reshape(4, 6)
    assert np.array_equal(pixels.decode_png(filtered_png(index, (0, 4), 3, 4, colors.tobytes())), colors[both])
    good = pixels.encode_png(smooth)
    assert np.array_equal(pixels.decode_png(good), smooth)
    for bad in (b"", b"JFIF", good[:-20], good[:60] + b"x" + good[61:], good[:33]):
        with pytest.raises(ValueError):
            pixels.decode_png(bad)


def test_pixels_round_trip(spark, tmp_path):
    images = spark.range(3).select(F.concat(F.col("id").cast("string"), F.lit(".png")).alias("path"), F.col("id"))
    cell = F.posexplode(F.sequence(F.lit(0), F.lit(30 * 20 - 1)))
    flat = images.select("path", "id", cell.alias("i", "_"))
    planted = flat.select("path", (F.col("i") % 30).alias("u"), F.floor(F.col("i") / 30).cast("int").alias("v"), ((F.col("i") * 7 + F.col("id")) % 256).cast("short").alias("r"), (F.col("i") % 251).cast("short").alias("g"), F.lit(9).cast("short").alias("b"))
    written = pixels.write_files(pixels.images_of_pixels(planted), str(tmp_path))
    assert sorted(r.path for r in written.collect()) == ["0.png", "1.png", "2.png"]
    back = pixels.read_pixels(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert back.count() == 1800 and back.exceptAll(planted).isEmpty()
    (tmp_path / "z.png").write_bytes(b"torn")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r.error for r in pixels.decode_images(files, strict=False).where("error is not null").collect()] == ["not a PNG image"]
    with pytest.raises(Exception, match="not a PNG image"):
        pixels.read_pixels(spark, str(tmp_path)).count()
    # Gaps are black, repeats keep the largest, colours stay bytes; no rows give no images.
    odd = spark.createDataFrame([("a", 1, 1, 300, -4, None), ("a", 0, 0, 1, 1, 1), ("a", 0, 0, 2, 0, 0), ("a", -1, 0, 9, 9, 9)], "path string, u int, v int, r int, g int, b int")
    image = pixels.decode_png(bytes(pixels.images_of_pixels(odd).first().content))
    assert image.tolist() == [[[2, 0, 0], [0, 0, 0]], [[0, 0, 0], [255, 0, 0]]]
    assert pixels.images_of_pixels(odd.limit(0)).isEmpty()
    with pytest.raises(Exception, match="not a plain file name"):
        pixels.write_files(pixels.images_of_pixels(odd).withColumn("path", F.lit("../a")), str(tmp_path)).collect()


def test_arrays(spark, tmp_path):
    spark.dataSource.register(pixels.NpyDataSource)
    rng = np.random.default_rng(1)
    for name, a in (("a", rng.normal(size=(7, 5)).astype("f4")), ("b", np.asfortranarray(rng.integers(0, 99, (3, 4, 2)))), ("c", np.zeros((0, 3))), ("d", np.array(2.5)), ("e", np.arange(4, dtype=">i2"))):
        folder = tmp_path / name
        folder.mkdir()
        np.save(folder / "x.npy", a)
        for chunk in (4, 1000):
            got = spark.read.format("npy").option("chunk", chunk).load(str(folder)).collect()
            assert {tuple(r.place): r.value for r in got} == {i: float(v) for i, v in np.ndenumerate(a)} and len(got) == a.size
    depth = spark.createDataFrame([("p.npy", 0, 0, 1.5), ("p.npy", 1, 2, 2.5), ("p.npy", 1, 2, 0.5)], "name string, v int, u int, depth double")
    pixels.write_files(pixels.arrays_of_rows(depth, "name", "v", "u", "depth"), str(tmp_path / "out"), "name").collect()
    back = np.load(tmp_path / "out" / "p.npy")
    assert back.shape == (2, 3) and back[0, 0] == 1.5 and back[1, 2] == 2.5 and np.isnan(back).sum() == 4
    (tmp_path / "f.npy").write_bytes((tmp_path / "a" / "x.npy").read_bytes()[:-4])
    with pytest.raises(Exception, match="ends early"):
        spark.read.format("npy").load(str(tmp_path / "f.npy")).collect()


def box(kind: bytes, *parts: bytes, wide: bool = False) -> bytes:
    body = b"".join(parts)
    return (struct.pack(">I", 1) + kind + struct.pack(">Q", 16 + len(body)) if wide else struct.pack(">I", 8 + len(body)) + kind) + body


def video(width: int, height: int, runs, scale: int, version: int = 0, wide: bool = False) -> bytes:
    ticks = sum(n * d for n, d in runs)
    clock = lambda rate, length: bytes([version, 0, 0, 0]) + (struct.pack(">QQIQ", 1, 2, rate, length) if version else struct.pack(">IIII", 1, 2, rate, length)) + bytes(80)
    track = lambda kind: box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", width << 16, height << 16)), box(b"mdia", box(b"mdhd", clock(scale, ticks)), box(b"hdlr", bytes(8), kind, bytes(13)), box(b"minf", box(b"stbl", box(b"stsd", bytes(8)), box(b"stts", bytes(4), struct.pack(">I", len(runs)), *(struct.pack(">II", *r) for r in runs))))))
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(5000), wide=wide) + box(b"moov", box(b"mvhd", clock(1000, ticks * 1000 // scale)), track(b"soun"), track(b"vide"))


def test_probe(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(video(1920, 1080, [(300, 1001)], 30_000, 0, True))
    (tmp_path / "b.mov").write_bytes(video(640, 480, [(10, 40), (10, 60)], 1000, 1))
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.mp4", "b.mov")], "path string")
    found = pixels.probe_videos(paths)
    a, b = found.orderBy("path").collect()
    assert (a.width, a.height, a.n_frames) == (1920, 1080, 300) and a.fps == pytest.approx(30_000 / 1001) and a.duration == pytest.approx(10.01)
    assert (b.width, b.height, b.n_frames, b.fps, b.duration) == (640, 480, 20, 20.0, 1.0)
    assert runs.frame_rows(found, 10.0).groupBy("path").count().orderBy("path").collect()[1]["count"] == 10
    assert pixels.probe_videos(paths.limit(0)).isEmpty()
    for bad, why in ((b"", "no movie"), (box(b"moov"), "no video"), (struct.pack(">I", 99) + b"moov", "beyond")):
        (tmp_path / "c.mp4").write_bytes(bad)
        with pytest.raises(ValueError, match=why):
            pixels.probe(str(tmp_path / "c.mp4"))
