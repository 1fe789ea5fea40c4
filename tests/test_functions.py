"""Scalar functions against stated values."""

import math

import pytest
from pyspark.sql import functions as F

from skyloom.functions import camera, geo, grid, scalar


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_zones_and_codes(spark):
    for lon, zone in ((0.0, 31), (-123.1, 10), (77.2, 43), (151.2, 56), (180.0, 1), (-180.0, 1)):
        assert one(spark, geo.utm_zone(F.lit(lon)))[0] == zone
    assert one(spark, geo.utm_epsg(F.lit(77.2), F.lit(28.6)))[0] == 32643
    assert one(spark, geo.utm_epsg(F.lit(151.2), F.lit(-33.8)))[0] == 32756


def test_haversine(spark):
    assert abs(one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))[0] - 111_195) < 5
    assert one(spark, geo.haversine_m(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0)))[0] == 0


def test_projection(spark):
    # Central meridian on the equator, and a round trip in both hemispheres.
    e, n = one(spark, *geo.project_utm(F.lit(3.0), F.lit(0.0), F.lit(32631)))
    assert abs(e - 500_000) < 1e-6 and abs(n) < 1e-6
    # One degree of latitude from the equator along the meridian is 110,574.4 m, scaled by 0.9996.
    assert abs(one(spark, geo.project_utm(F.lit(3.0), F.lit(1.0), F.lit(32631))[1])[0] - 110_574.39 * 0.9996) < 0.5
    for lon, lat in ((77.2, 28.6), (151.2, -33.8), (8.9, 60.0), (-122.9, 1e-9)):
        code = one(spark, geo.utm_epsg(F.lit(lon), F.lit(lat)))[0]
        e, n = one(spark, *geo.project_utm(F.lit(lon), F.lit(lat), F.lit(code)))
        back = one(spark, *geo.unproject_utm(F.lit(e), F.lit(n), F.lit(code)))
        assert max(abs(back[0] - lon), abs(back[1] - lat)) < 1e-9
    with pytest.raises(Exception, match="not a WGS84 UTM code"):
        one(spark, geo.project_utm(F.lit(3.0), F.lit(0.0), F.lit(4326))[0])
    with pytest.raises(Exception, match="out of range"):
        one(spark, geo.checked_epsg(F.lit(99)))


def test_camera(spark):
    k = camera.intrinsics(F.lit("simple_radial"), F.array(*map(F.lit, (100.0, 50.0, 50.0, 0.1))))
    eye = F.array(*(F.array(*(F.lit(1.0 if i == j else 0.0) for j in range(3))) for i in range(3)))
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    for x, u in ((0.0, 50.0), (1.0, 60.0)):
        p = one(spark, camera.project_point(k, eye, zero, [F.lit(x), F.lit(0.0), F.lit(10.0)]))[0]
        assert (p.u, p.v, p.z) == (u, 50.0, 10.0)
    assert one(spark, camera.project_point(k, eye, zero, [F.lit(1.0), F.lit(0.0), F.lit(0.0)]))[0].u is None
    assert one(spark, camera.intrinsics(F.lit("odd"), F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))))[0].fy == 2.0
    with pytest.raises(Exception, match="unsupported camera"):
        one(spark, camera.intrinsics(F.lit("odd"), F.array(F.lit(1.0))))
    world = camera.back_project(F.lit(60.0), F.lit(50.0), F.lit(10.0), k, eye, zero)
    assert tuple(one(spark, *world)) == (1.0, 0.0, 10.0)
    sim = F.struct(F.lit(2.0).alias("scale"), eye.alias("rotation"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("translation"))
    assert one(spark, camera.similarity_matrix(sim))[0] == [[2.0, 0.0, 0.0, 1.0], [0.0, 2.0, 0.0, 2.0], [0.0, 0.0, 2.0, 3.0], [0.0, 0.0, 0.0, 1.0]]
    c = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert one(spark, camera.center_of(eye, camera.translation_of(eye, c)))[0] == [1.0, 2.0, 3.0]
    assert one(spark, camera.rotate_into(eye, eye))[0][0] == [1.0, 0.0, 0.0]


def test_scalars(spark):
    assert abs(one(spark, scalar.to_gray(F.lit(255.0), F.lit(0.0), F.lit(0.0)))[0] - 29.07) < 1e-9
    for row, want in (((200.0, 0.01, 0.01), True), ((50.0, 0.0, 0.0), False), ((200.0, 0.5, 0.0), False), ((100.0, 0.4, 0.4), True)):
        assert one(spark, scalar.accept_frame(*map(F.lit, row), 100.0, 0.4, 0.4))[0] is want
    assert [one(spark, scalar.to_byte(F.lit(v) * scalar.color_scale(F.lit(1.0))))[0] for v in (1.0, 0.0, 0.5)] == [255, 0, 127]
    assert one(spark, scalar.color_scale(F.lit(2.0)))[0] == 1.0
    assert one(spark, scalar.expanded_labels(F.array(F.lit("vehicle"), F.lit("person"))))[0] == sorted(["vehicle", "person", *scalar.LABEL_EXPANSION["vehicle"]])
    assert one(spark, scalar.blend(F.lit(0.9), F.lit(0.85)))[0] == 0.85
    assert one(spark, scalar.blend(F.lit(None).cast("double"), F.lit(0.85)))[0] is None
    with pytest.raises(Exception, match="outside 0..1"):
        one(spark, scalar.blend(F.lit(1.5), F.lit(0.85)))
    assert one(spark, scalar.share(F.lit(5.0), F.lit(0.0)))[0] == 0.0
    assert one(spark, scalar.box_pixel(F.lit(-3.7), F.lit(10)), scalar.box_pixel(F.lit(99.9), F.lit(10)), scalar.box_pixel(F.lit(3.9), F.lit(10))) == (0, 10, 3)
    assert one(spark, scalar.basename(F.lit("a/b/c.jpg")))[0] == "c.jpg"
    assert math.isclose(one(spark, scalar.fit_confidence(F.lit(1.0), F.lit(4.0)))[0], 1 / 4.000001)


def test_grid(spark):
    assert one(spark, grid.grid_shape(F.lit(2.5), 1.0), grid.grid_shape(F.lit(0.0), 1.0), grid.grid_shape(F.lit(3.0), 1.0)) == (3, 1, 3)
    assert one(spark, grid.meshing_voxel(F.lit(300.0), 11, F.lit(0.05), F.lit(0.0)))[0] == pytest.approx(300 * 1.1 / 2048)
    assert one(spark, grid.meshing_voxel(F.lit(300.0), 11, F.lit(0.5), F.lit(0.0)))[0] == 0.5
    assert one(spark, grid.meshing_voxel(F.lit(300.0), 11, F.lit(0.5), F.lit(0.2)))[0] == 0.2
