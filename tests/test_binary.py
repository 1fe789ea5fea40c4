"""Exchange files are read back byte by byte."""

import json
import struct
import zlib

import numpy as np

from skyloom.operators.raster import Extent
from skyloom.sinks import binary


def test_las(spark, tmp_path):
    data = [(500_000.123 + i, 4_000_000.5 - i, 10.25 * i, i, 2 * i, 255) for i in range(20)]
    binary.write_las(spark.createDataFrame(data, "x double, y double, z double, r int, g int, b int").repartition(3), str(tmp_path / "c.las"))
    raw = (tmp_path / "c.las").read_bytes()
    assert raw[:4] == b"LASF" and raw[24:26] == b"\x01\x04" and len(raw) == 375 + 36 * 20 and [p.name for p in tmp_path.iterdir()] == ["c.las"]
    assert struct.unpack_from("<HI", raw, 94) == (375, 375) and raw[104] == 7 and struct.unpack_from("<Q", raw, 247)[0] == 20
    scale, offset, box = (struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155), struct.unpack_from("<6d", raw, 179))
    got = []
    for i in range(20):
        p = struct.unpack_from("<iiiHBBBBhHdHHH", raw, 375 + 36 * i)
        got.append((*(round(s * k + o, 3) for s, k, o in zip(p[:3], scale, offset, strict=True)), *(c >> 8 for c in p[-3:])))
    assert sorted(got) == sorted((round(a, 3), round(b, 3), round(c, 3), r, g, bl) for a, b, c, r, g, bl in data)
    assert np.allclose(box, (500_019.123, 500_000.123, 4_000_000.5, 3_999_981.5, 194.75, 0.0))


def test_geotiff(spark, tmp_path):
    grid = spark.createDataFrame([(0, 0, 1.5), (2, 3, -4.0)], "row int, col int, z double")
    binary.write_geotiff(grid, Extent(100.0, 200.0, 102.0, 201.5, 0.5), str(tmp_path / "d.tif"), 32631)
    raw = (tmp_path / "d.tif").read_bytes()
    assert raw[:4] == b"II*\0"
    at = struct.unpack_from("<I", raw, 4)[0]
    tags = {}
    for i in range(struct.unpack_from("<H", raw, at)[0]):
        number, kind, n, value = struct.unpack_from("<HHII", raw, at + 2 + 12 * i)
        code, size = {3: ("H", 2), 4: ("I", 4), 12: ("d", 8), 2: ("s", 1)}[kind]
        where = value if n * size > 4 else at + 2 + 12 * i + 8
        tags[number] = struct.unpack_from(f"<{n}{code}", raw, where) if code != "s" else raw[where : where + n]
    assert list(tags) == sorted(tags) and (tags[256], tags[257], tags[33922][3:5], tags[33550][0], tags[34735][-1], tags[42113]) == ((4,), (3,), (100.0, 201.5), 0.5, 32631, b"-9999\0")
    body = b"".join(zlib.decompress(raw[o : o + n]) for o, n in zip(tags[273], tags[279], strict=True))
    image = np.frombuffer(body, "<f4").reshape(3, 4)
    assert image[0, 0] == 1.5 and image[2, 3] == -4.0 and (image == -9999).sum() == 10


def test_rgb_geotiff(spark, tmp_path):
    grid = spark.createDataFrame([(0, 0, 255.0, 0.0, 7.0), (2, 3, 1.0, 300.0, 9.0)], "row int, col int, r double, g double, b double")
    binary.write_rgb_geotiff(grid, Extent(100.0, 200.0, 102.0, 201.5, 0.5), str(tmp_path / "o.tif"), 32631)
    raw = (tmp_path / "o.tif").read_bytes()
    at = struct.unpack_from("<I", raw, 4)[0]
    entries = {number: (kind, n, value, at + 2 + 12 * i + 8) for i in range(struct.unpack_from("<H", raw, at)[0]) for number, kind, n, value in [struct.unpack_from("<HHII", raw, at + 2 + 12 * i)]}
    assert struct.unpack_from("<4H", raw, entries[258][2]) == (8, 8, 8, 8) and raw[entries[262][3]] == 2 and raw[entries[277][3]] == 4 and 42113 not in entries
    image = np.frombuffer(zlib.decompress(raw[entries[273][2] : entries[273][2] + entries[279][2]]), np.uint8).reshape(3, 4, 4)
    assert image[0, 0].tolist() == [255, 0, 7, 255] and image[2, 3].tolist() == [1, 255, 9, 255] and image.sum() == 255 + 7 + 255 + 1 + 255 + 9 + 255


def test_glb(spark, tmp_path):
    v = spark.createDataFrame([(7, 0.0, 0.0, 0.0), (3, 2.0, 0.0, 0.0), (9, 1.0, 3.0, 0.0)], "vertex long, x double, y double, z double")
    binary.write_glb(v, spark.createDataFrame([(7, 3, 9)], "a long, b long, c long"), str(tmp_path / "m.glb"))
    raw = (tmp_path / "m.glb").read_bytes()
    magic, version, total = struct.unpack_from("<4sII", raw)
    n = struct.unpack_from("<I", raw, 12)[0]
    doc = json.loads(raw[20 : 20 + n])
    blob = raw[20 + n + 8 :]
    assert (magic, version, total) == (b"glTF", 2, len(raw)) and doc["buffers"][0]["byteLength"] == len(blob)
    points = np.frombuffer(blob[:36], "<f4").reshape(3, 3) + doc["nodes"][0]["translation"]
    index = np.frombuffer(blob[36:], "<u4")
    assert np.allclose(points[index], [[0, 0, 0], [2, 0, 0], [1, 3, 0]])
