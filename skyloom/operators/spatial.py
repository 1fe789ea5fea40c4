"""Spatial joins: revisits, tiles, visibility, neighbours, mutual nearest descriptors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.camera import pixel, project_point, visible
from ..functions.geo import EARTH_RADIUS_M, haversine_m


def revisit_gap(n: Column) -> Column:
    """Rows that must lie between a pose and a later visit of its place."""
    return F.greatest(F.lit(5), F.floor(0.05 * n)).cast("long")


#: Cells a side of the blocks by which rows meet.
CELLS = 8


def revisits(track: DataFrame, key: str, radius_m: float, gap: Column | int, lat: str = "lat", lon: str = "lon", order: str = "ord") -> DataFrame:
    """Rows i of a track for which some row j >= i + gap lies within the radius.

    Cells are so small that all rows of one are within the radius of each
    other: there the largest j decides.  Only the rows that this leaves open,
    at most ``gap`` of a cell, are compared with the rows of the cells around,
    so a place visited very often costs no more than a linear pass.  They meet by
    blocks of cells, of which an open row goes to the few that the cells around it are in.  Rows
    without coordinates never match.  Tracks must not cross the antimeridian.
    """
    side = math.degrees(radius_m * 0.999 / math.sqrt(2) / EARTH_RADIUS_M)
    gap = F.lit(gap) if isinstance(gap, int) else gap
    rows = track.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("__gap", gap).withColumn("__y", F.floor(F.col(lat) / side)).withColumn("__x", F.floor(F.col(lon) / side))
    last = rows.groupBy(key, "__y", "__x").agg(F.max(order).alias("__last"))
    marked = rows.join(last, [key, "__y", "__x"])
    sure = marked.where(F.col("__last") >= F.col(order) + F.col("__gap"))
    open_rows = marked.where(F.col("__last") < F.col(order) + F.col("__gap"))
    reach = F.ceil(math.sqrt(2) / 0.999 / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col(lat)) + 3 * side))))) + 1
    block = lambda c: F.floor(c / CELLS)
    y, x = F.col("__y"), F.col("__x")
    near = open_rows.select(*track.columns, "__gap", "__y", "__x", reach.alias("__reach")).withColumn("__by", F.explode(F.sequence(block(y - 2), block(y + 2)))).withColumn("__bx", F.explode(F.sequence(block(x - F.col("__reach")), block(x + F.col("__reach"))))).alias("a")
    others = rows.select(key, lat, lon, order, "__y", "__x", block(y).alias("__by"), block(x).alias("__bx")).alias("b")
    close = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__by") == F.col("b.__by")) & (F.col("a.__bx") == F.col("b.__bx")) & (F.col(f"b.{order}") >= F.col(f"a.{order}") + F.col("a.__gap"))
    close = close & (F.abs(F.col("a.__y") - F.col("b.__y")) <= 2) & (F.abs(F.col("a.__x") - F.col("b.__x")) <= F.col("a.__reach"))
    close = close & (haversine_m(F.col(f"a.{lat}"), F.col(f"a.{lon}"), F.col(f"b.{lat}"), F.col(f"b.{lon}")) <= radius_m)
    # Several blocks may hold a match: rows are unique by key and order.
    more = near.join(others, close, "left_semi").select(*track.columns).dropDuplicates([key, order])
    return sure.select(*track.columns).unionByName(more)


def tile_index(value: Column, origin: float, tile: float, count: int | None = None) -> Column:
    """Tile whose half-open core holds a value; values beyond either end belong to the border tiles."""
    i = F.floor((value - origin) / F.lit(float(tile)))
    i = F.greatest(F.lit(0), i)
    return (F.least(F.lit(count - 1), i) if count else i).cast("int")


def tile_candidates(df: DataFrame, x: str, y: str, origin: tuple[float, float], tile: float, overlap: float, shape: tuple[int, int]) -> DataFrame:
    """df repeated for every tile (tx, ty) whose half-open window, widened by the overlap, holds the point."""
    def ids(value: Column, start: float, n: int) -> Column:
        lo = F.greatest(F.lit(0), F.floor((value - start - overlap) / tile)).cast("int")
        hi = F.least(F.lit(n - 1), F.floor((value - start + overlap) / tile)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi))

    def within(value: Column, t: Column, start: float) -> Column:
        return (value >= start + t * tile - overlap) & (value < start + (t + 1) * tile + overlap)

    out = df.withColumn("tx", F.explode(ids(F.col(x), origin[0], shape[0]))).withColumn("ty", F.explode(ids(F.col(y), origin[1], shape[1])))
    return out.where(within(F.col(x), F.col("tx"), origin[0]) & within(F.col(y), F.col("ty"), origin[1]))


def tile_owned(df: DataFrame, x: str, y: str, origin: tuple[float, float], tile: float, shape: tuple[int, int]) -> DataFrame:
    """Of rows repeated over tiles, the one whose tile's core holds the point."""
    return df.where((F.col("tx") == tile_index(F.col(x), origin[0], tile, shape[0])) & (F.col("ty") == tile_index(F.col(y), origin[1], tile, shape[1])))


def visible_points(cameras: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs of camera and point that the camera sees, with pixel and depth.

    cameras: name, k, rotation, center, width, height, and the footprint
    (x0, x1, y0, y1) beyond which nothing can be seen; points: point_id, x, y,
    z.  Both sides meet by cells of the footprint's size, not as a cross product.
    """
    size = cameras.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("__size")).where("__size > 0")
    cell = lambda v: F.floor(v / F.col("__size"))
    # A camera's numbers leave their arrays once, not once for each point.
    numbers = [F.col(f"k.{c}").alias(f"__{c}") for c in ("fx", "fy", "cx", "cy")] + [F.col("rotation")[i][j].alias(f"__r{i}{j}") for i in range(3) for j in range(3)] + [F.col("center")[i].alias(f"__c{i}") for i in range(3)]
    held = cameras.select("name", "width", "height", "x0", "x1", "y0", "y1", *numbers)
    cams = held.crossJoin(F.broadcast(size)).withColumn("__bx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("__by", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    pts = points.crossJoin(F.broadcast(size)).withColumn("__bx", cell(F.col("x"))).withColumn("__by", cell(F.col("y"))).drop("__size")
    met = cams.join(pts, ["__bx", "__by"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    p = project_point({c: F.col(f"__{c}") for c in ("fx", "fy", "cx", "cy")}, [[F.col(f"__r{i}{j}") for j in range(3)] for i in range(3)], [F.col(f"__c{i}") for i in range(3)], [F.col("x"), F.col("y"), F.col("z")])
    # As a generated row, so that the filter does not project anew.
    seen = met.select("name", "point_id", "width", "height", F.inline(F.array(p)).alias("u", "v", "depth"))
    seen = seen.where(visible(F.col("u"), F.col("v"), F.col("depth"), F.col("width"), F.col("height")))
    return seen.select("name", "point_id", pixel(F.col("u")).alias("col"), pixel(F.col("v")).alias("row"), "depth")


#: Parts at least that the descriptors of a frame are dealt into, on either side, and descriptors of a part.
BLOCKS, PART = 8, 1 << 15
#: Numbers of one piece of a block's distance matrix; of one that is a product of matrices.
PIECE, PRODUCT = 1 << 22, 1 << 19
#: Pairs for each descriptor that rounding may leave open, before all distances are made exactly.
MANY = 16


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a and b."""
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all rows of a and b, bit strings as rows of longs."""
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)


def _every(a: np.ndarray, b: np.ndarray, metric: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a its nearest row of b and the distance, and for each row of b likewise; the first of equal ones."""
    rows = max(1, PIECE // (len(b) * a.shape[1]))
    of_a, near_a, of_b, near_b = [], [], None, None
    for at in range(0, len(a), rows):
        d = metric(a[at : at + rows], b)
        j, i = d.argmin(1), d.argmin(0)
        of_a.append(j)
        near_a.append(d[np.arange(len(j)), j])
        low = d[i, np.arange(len(i))]
        better = np.ones(len(b), bool) if near_b is None else low < near_b
        near_b, of_b = np.where(better, low, 0 if near_b is None else near_b), np.where(better, at + i, 0 if of_b is None else of_b)
    return np.concatenate(of_a), np.concatenate(near_a), of_b, near_b


def _first_of_copies(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal rows, in order, and for each row the place of its own among these."""
    whole = np.ascontiguousarray(a).view(np.dtype((np.void, a.dtype.itemsize * a.shape[1]))).ravel()
    _, first, own = np.unique(whole, return_index=True, return_inverse=True)
    order = np.argsort(first)
    return first[order], np.argsort(order)[own]


def _by_products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_every`` for Euclidean distances of finite numbers: squared distances from a product of matrices, and those within rounding of the least exactly."""
    (keep_a, own_a), (keep_b, own_b) = _first_of_copies(a), _first_of_copies(b)
    u, v = a[keep_a], b[keep_b]
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    # Far above what rounding makes of the three sums.
    slack = 8 * np.finfo(float).eps * (u.shape[1] + 8)
    floor_u, floor_v = slack * (uu + vv.max()), slack * (vv + uu.max())
    rows = max(1, PRODUCT // len(v))
    best_v, held, most = np.full(len(v), np.inf), 0, PIECE + MANY * (len(u) + len(v))
    meet_u, meet_v = [], []

    def still(pairs: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        i, j, d = (np.concatenate(p) for p in zip(*pairs, strict=True))
        near = d <= best_v[j] + floor_v[j]
        return [(i[near], j[near], d[near])]

    def least(own: np.ndarray, other: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((other, d, own))
        top = order[np.r_[True, np.diff(own[order]) > 0]]
        return other[top], d[top]

    def exact(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
        step = max(1, PIECE >> 6)
        d = np.concatenate([np.sqrt(((u[i[at : at + step]] - v[j[at : at + step]]) ** 2).sum(1)) for at in range(0, len(i), step)])
        return i, j, d

    for at in range(0, len(u), rows):
        d = u[at : at + rows] @ v.T
        d *= -2
        d += uu[at : at + rows, None]
        d += vv
        low = d.min(1)
        i, j = np.nonzero(d <= (low + floor_u[at : at + rows])[:, None])
        meet_u.append((at + i, j))
        np.minimum(best_v, d.min(0), out=best_v)
        i, j = np.nonzero(d <= best_v + floor_v)
        meet_v.append((at + i, j, d[i, j]))
        held += len(meet_u[-1][0]) + len(i)
        if held > most:
            meet_v = still(meet_v)  # the least of a column falls from piece to piece
            held = sum(len(p[0]) for p in meet_u + meet_v)
            if 2 * held > most:  # rounding could decide nearly everywhere
                return _every(a, b, euclidean)
    meet_v = [p[:2] for p in still(meet_v)]
    i, j, d = exact(meet_u)
    of_u, near_u = least(i, j, d)
    i, j, d = exact(meet_v)
    of_v, near_v = least(j, i, d)
    return keep_b[of_u][own_a], near_u[own_a], keep_a[of_v][own_b], near_v[own_b]


def _nearest(pair: str, metric: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """The nearest of either side within a block of left and a block of right descriptors: (pair, side, own, distance, other)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[pair, "side", "own", "distance", "other"])
        left, right = left.sort_values("left_id"), right.sort_values("right_id")  # the first of equal ones is the smaller id
        a, b = np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy())
        ids_a, ids_b = left["left_id"].to_numpy(), right["right_id"].to_numpy()
        plain = metric is not euclidean or a.dtype != np.float64 or b.dtype != np.float64 or not (np.abs(a) < 1e150).all() or not (np.abs(b) < 1e150).all()
        of_a, near_a, of_b, near_b = _every(a, b, metric) if plain else _by_products(a, b)
        parts = [pd.DataFrame({"side": 0, "own": ids_a, "distance": near_a, "other": ids_b[of_a]}), pd.DataFrame({"side": 1, "own": ids_b, "distance": near_b, "other": ids_a[of_b]})]
        return pd.concat(parts, ignore_index=True).assign(**{pair: left[pair].iloc[0]})[[pair, "side", "own", "distance", "other"]]

    return run


def mutual_nearest(left: DataFrame, right: DataFrame, pair: str, metric: Callable[[np.ndarray, np.ndarray], np.ndarray] = euclidean, least: int = 0, blocks: int | None = None) -> DataFrame:
    """(pair, left_id, right_id, distance): descriptors of a frame pair that are each other's nearest.

    left and right: pair, left_id or right_id (longs), and vector, an array of numbers of one length; pairs
    of frames either of which has fewer than ``least`` descriptors give nothing.  The
    work is the product of the descriptors of one pair of frames, made once: both sides are dealt into ``blocks``
    parts (of some PART descriptors at most, if not given), each two of which meet as matrices in one task, which keeps the nearest for each descriptor.
    Euclidean distances are products of matrices, and exact where rounding could decide.
    Those few are then compared.  Ties go to the smaller id.
    """
    if least > 0:
        left, right = (d.join(d.groupBy(pair).count().where(F.col("count") >= least).select(pair), pair, "left_semi") for d in (left, right))
    if blocks is None:
        counts = left.groupBy(pair).count().unionByName(right.groupBy(pair).count())
        blocks = max(BLOCKS, -(-(counts.agg(F.max("count")).first()[0] or 0) // PART))
    every = F.explode(F.array(*(F.lit(i) for i in range(blocks))))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    a = left.select(pair, "left_id", "vector", part("left_id").alias("__a"), every.alias("__b"))
    b = right.select(pair, "right_id", "vector", part("right_id").alias("__b"), every.alias("__a"))
    kind = left.schema[pair].dataType.simpleString()
    keys = (pair, "__a", "__b")
    near = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(_nearest(pair, metric), f"{pair} {kind}, side int, own long, distance double, other long")
    # A row for each descriptor and block of the other side.
    best = near.groupBy(pair, "side", "own").agg(F.min(F.struct("distance", "other")).alias("b"))
    # A mutual pair is named by both of its sides.
    named = best.select(pair, F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("b.other")).alias("left_id"), F.when(F.col("side") == 0, F.col("b.other")).otherwise(F.col("own")).alias("right_id"), "b.distance")
    return named.groupBy(pair, "left_id", "right_id").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("distance")).where("n = 2").drop("n")


def pair_displacement(matches: DataFrame, pair: str, dx: Column, dy: Column, least: int = 8) -> DataFrame:
    """Median displacement of each pair's matches; 0 with fewer than ``least``."""
    d = F.sqrt(dx * dx + dy * dy)
    return matches.groupBy(pair).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.percentile(d, F.lit(0.5))).otherwise(F.lit(0.0)).alias("displacement"))


def neighbours(points: DataFrame, radius: float, most: int, id_column: str = "point_id") -> DataFrame:
    """(point_id, neighbour_id, rank): up to ``most`` nearest points within the radius, the point itself included.

    Cells of the radius' size; candidates per cell are bounded by the voxel
    size that the cloud was thinned to before.
    """
    cell = [F.floor(F.col(c) / radius).alias(f"__{c}") for c in "xyz"]
    cells = points.select(id_column, "x", "y", "z", *cell)
    around = cells
    for c in "xyz":
        around = around.withColumn(f"__d{c}", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"__{c}", F.col(f"__{c}") + F.col(f"__d{c}"))
    a, b = around.alias("a"), cells.alias("b")
    square = sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), F.lit(2)) for c in "xyz"), F.lit(0.0))
    met = a.join(b, [F.col(f"a.__{c}") == F.col(f"b.__{c}") for c in "xyz"]).where(square <= radius * radius)
    rows = met.select(F.col(f"a.{id_column}").alias(id_column), F.col(f"b.{id_column}").alias("neighbour_id"), *(F.col(f"b.{c}").alias(c) for c in "xyz"), square.alias("d2"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(id_column).orderBy("d2", "neighbour_id"))).where(F.col("rank") <= most)
