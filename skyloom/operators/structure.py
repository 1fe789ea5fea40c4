"""Structure from matched features: tracks, their points, and cameras and points refined together.

Matches join features to tracks (components by joining what lies together, then by alternating stars).  A track
that holds two features of one image is in conflict: it loses the worse part
of its matches and is joined anew, until no track is.  Points lie nearest to the
rays of their track, which takes nothing but sums.  The adjustment holds one
row per track with its observations, a track being no longer than there are images; each
round is one map over these rows and one aggregate of 6 x 6 blocks for pairs of
cameras (the Schur complement).  Only that reduced system, bounded by
``most_cameras`` and an error beyond it, meets the driver.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import dropped, written

#: Cameras of one adjustment; its dense system has six times as many rows.
MOST_CAMERAS = 1000
#: Edges that a task joins at once where they lie.
JOINED = 1 << 20


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges of numbered nodes: each node that is not the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        u, v = _joined(*(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= JOINED:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v): each node u (a long) that is not the least of its component, and that least node v, of edges u, v.

    Each task first joins the edges that lie together.  What is a star then is left alone; the rest
    meets in alternating stars.
    """
    now, settled = written(edges.mapInArrow(_joined_batches, "u long, v long").distinct()), []
    while True:
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("ups"), F.lit(0).alias("root")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("ups"), F.lit(1).alias("root")))
        odd = written(ends.groupBy("n").agg(F.sum("ups").alias("ups"), F.max("root").alias("root")).where("ups > 1 or (ups = 1 and root = 1)").select("n"))
        if odd.isEmpty():
            return functools.reduce(DataFrame.unionByName, settled, now)
        roots = written(now.join(odd.withColumnRenamed("n", "u"), "u", "left_semi").select("v").union(odd).distinct())
        settled.append(written(now.join(roots, "v", "left_anti").select("u", "v")))
        rest = now.join(roots, "v", "left_semi").select("u", "v")
        both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = written(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct())
        for table in (now, odd, roots):
            dropped(table)
        now = after


def _number(seed: int, end: str) -> Column:
    return F.xxhash64(F.lit(seed), f"{end}.name", f"{end}.feature")


def tracks(matches: DataFrame) -> DataFrame:
    """(track_id, name, feature) of matches (name_a, feature_a, name_b, feature_b, score); less is better.

    A track's name is its least feature; features without a match have none.
    Of a track in conflict the matches up to the middle of its range of scores stay
    (of equal scores: of their hashes).  Matches within one image or with a null do
    not count, of repeated ones the best; a null score is the worst.  Features are numbered
    by a hash; should two share a number, all are numbered anew.
    """
    end = lambda s: F.struct(F.col(f"name_{s}").alias("name"), F.col(f"feature_{s}").alias("feature"))
    known = matches.where("name_a <> name_b and feature_a is not null and feature_b is not null").select(end("a").alias("a"), end("b").alias("b"), F.coalesce("score", F.lit(float("inf"))).cast("double").alias("w"))
    known = known.withColumn("h", F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("double"))
    for seed in itertools.count():
        edges = written(known.select("a", "b", _number(seed, "a").alias("u"), _number(seed, "b").alias("v"), "w", "h"))
        nodes = written(edges.select(F.col("u").alias("node"), "a.name", "a.feature").union(edges.select("v", "b.name", "b.feature")).distinct())
        if nodes.groupBy("node").count().where("count > 1").isEmpty():
            break
        dropped(edges)
        dropped(nodes)
    done = None
    while True:
        stars = _stars(edges.select("u", "v"))
        members = written(stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).join(nodes, "node"))
        twice = written(members.groupBy("root", "name").count().where("count > 1").select("root").distinct())
        fine = members.join(twice, "root", "left_anti")
        done = fine if done is None else done.unionByName(fine)
        torn = edges.join(members.join(twice, "root", "left_semi").select(F.col("node").alias("u"), "root"), "u")
        torn = torn.groupBy("root", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.min("w").alias("w"), F.min("h").alias("h"))
        bounds = torn.groupBy("root").agg(*(f(c).alias(f"{n}_{c}") for c in "wh" for n, f in (("least", F.min), ("most", F.max))))
        better = F.when(F.col("least_w") < F.col("most_w"), (F.col("w") < F.col("most_w")) & (F.col("w") <= F.least(F.lit(1e308), F.col("most_w")) / 2 + F.col("least_w") / 2)).otherwise(F.col("h") <= F.col("least_h") / 2 + F.col("most_h") / 2)
        if not twice.isEmpty():
            edges = written(torn.join(bounds, "root").where(better).select("u", "v", "w", "h"))
        if twice.isEmpty() or edges.isEmpty():
            # A track has no more features than there are images.
            first = F.first(F.struct("name", "feature")).over(Window.partitionBy("root").orderBy("name", "feature"))
            return done.withColumn("first", first).select(F.concat_ws(":", "first.name", F.col("first.feature").cast("string")).alias("track_id"), "name", "feature")


def rays(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    """Observations (track_id, name, u, v) with the unit ray d and the centre of their camera (name, k, rotation, center)."""
    met = observations.join(cameras.select("name", "k", "rotation", "center"), "name")
    across = [(F.col("u") - F.col("k.cx")) / F.col("k.fx"), (F.col("v") - F.col("k.cy")) / F.col("k.fy"), F.lit(1.0)]
    size = F.sqrt(across[0] * across[0] + across[1] * across[1] + 1)
    turned = [sum((F.col("rotation")[j][i] * across[j] for j in range(1, 3)), F.col("rotation")[0][i] * across[0]) / size for i in range(3)]
    return met.select("track_id", "name", "u", "v", F.array(*turned).alias("d"), "center")


def triangulate(seen: DataFrame, least_spread: float = 1e-8) -> DataFrame:
    """(track_id, x, y, z, n): the point with the least sum of squared distances to the rays of ``rays``.

    Tracks of one ray, or of rays so nearly parallel that the normal matrix's determinant is
    below ``least_spread`` times the cube of their number, have no point: x, y and z are null.
    """
    d, c = [F.get("d", F.lit(i)) for i in range(3)], [F.get("center", F.lit(i)) for i in range(3)]
    across = lambda i, j: F.lit(float(i == j)) - d[i] * d[j]
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    # Centres relative to the first one of the track would need another pass; the sums are of the order of the centres.
    matrix = [F.sum(across(i, j)).alias(f"a{i}{j}") for i, j in pairs]
    side = [F.sum(across(i, 0) * c[0] + across(i, 1) * c[1] + across(i, 2) * c[2]).alias(f"b{i}") for i in range(3)]
    sums = seen.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), *matrix, *side)
    a = lambda i, j: F.col(f"a{min(i, j)}{max(i, j)}")

    def minor(i: int, j: int) -> Column:
        (r, s), (p, q) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return (a(r, p) * a(s, q) - a(r, q) * a(s, p)) * (-1) ** (i + j)

    det = a(0, 0) * minor(0, 0) + a(0, 1) * minor(0, 1) + a(0, 2) * minor(0, 2)
    solved = sums.withColumn("det", det)
    sound = F.col("det") > least_spread * F.pow(F.col("n").cast("double"), F.lit(3.0))
    point = [F.when(sound, (minor(i, 0) * F.col("b0") + minor(i, 1) * F.col("b1") + minor(i, 2) * F.col("b2")) / F.col("det")).alias(n) for i, n in enumerate("xyz")]
    return solved.select("track_id", *point, "n")


# Adjustment

ROW = "track_id string, cams array<int>, us array<double>, vs array<double>, x double, y double, z double"
BLOCK, SIDE = [f"s{i}" for i in range(36)], [f"g{i}" for i in range(6)]


class _Cameras:
    """Rotations, centres and intrinsics as arrays."""

    def __init__(self, rotation: np.ndarray, center: np.ndarray, k: np.ndarray):
        self.rotation, self.center, self.k = rotation, center, k

    def moved(self, step: np.ndarray) -> _Cameras:
        w = step[:, :3]
        angle = np.linalg.norm(w, axis=1)[:, None, None]
        cross = _cross(w)
        unit = cross / np.where(angle == 0, 1, angle)
        turn = np.eye(3) + np.sin(angle) * unit + (1 - np.cos(angle)) * unit @ unit
        return _Cameras(turn @ self.rotation, self.center + step[:, 3:], self.k)


def _cross(w: np.ndarray) -> np.ndarray:
    out = np.zeros((len(w), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 2] = -w[:, 2], w[:, 1], -w[:, 0]
    return out - out.transpose(0, 2, 1)


class _Linear:
    """Residuals and derivatives of a batch of whole tracks, and each track's own system."""

    def __init__(self, batch: pd.DataFrame, cams: _Cameras, damping: float):
        n = batch["cams"].map(len).to_numpy()
        flat = lambda c, t: np.concatenate([np.asarray(v, t) for v in batch[c]]) if len(batch) else np.zeros(0, t)
        self.track, self.cam = np.repeat(np.arange(len(batch)), n), flat("cams", np.int64)
        self.xyz, self.n = batch[["x", "y", "z"]].to_numpy(float), n
        r, k = cams.rotation[self.cam], cams.k[self.cam]
        p = np.einsum("nij,nj->ni", r, self.xyz[self.track] - cams.center[self.cam])
        z = np.where(np.abs(p[:, 2]) < 1e-9, 1e-9, p[:, 2])
        self.residual = np.stack([flat("us", float) - k[:, 0] * p[:, 0] / z - k[:, 2], flat("vs", float) - k[:, 1] * p[:, 1] / z - k[:, 3]], 1)
        pixel = np.zeros((len(p), 2, 3))
        pixel[:, 0, 0], pixel[:, 1, 1] = k[:, 0] / z, k[:, 1] / z
        pixel[:, 0, 2], pixel[:, 1, 2] = -k[:, 0] * p[:, 0] / z**2, -k[:, 1] * p[:, 1] / z**2
        self.of_point = pixel @ r
        self.of_cam = np.concatenate([pixel @ -_cross(p), -self.of_point], 2)
        self.both = self.of_cam.transpose(0, 2, 1) @ self.of_point
        own, self.side = np.zeros((len(batch), 3, 3)), np.zeros((len(batch), 3))
        np.add.at(own, self.track, self.of_point.transpose(0, 2, 1) @ self.of_point)
        np.add.at(self.side, self.track, np.einsum("nij,ni->nj", self.of_point, self.residual))
        diagonal = np.einsum("tii->ti", own)
        diagonal *= 1 + damping
        diagonal += 1e-12
        self.inverse = np.linalg.inv(own) if len(own) else own


def _normal(rows: DataFrame, cams: _Cameras, damping: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of squared residuals, matrix, right side) of the cameras, tracks being eliminated."""
    count = len(cams.center)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            one = _Linear(batch, cams, damping)
            reach = one.both @ one.inverse[one.track]
            # Ordered pairs of observations of one track: each with all from its track's first to its last.
            first = np.concatenate([[0], np.cumsum(one.n)])[:-1][one.track]
            many = one.n[one.track]
            i = np.repeat(np.arange(len(one.cam)), many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            code = np.concatenate([one.cam[i] * count + one.cam[j], one.cam * (count + 1)])
            keys, at = np.unique(code, return_inverse=True)
            block, side = np.zeros((len(keys), 6, 6)), np.zeros((len(keys), 6))
            np.add.at(block, at[: len(i)], -reach[i] @ one.both[j].transpose(0, 2, 1))
            own = one.of_cam.transpose(0, 2, 1) @ one.of_cam
            np.einsum("nii->ni", own)[...] *= 1 + damping
            np.add.at(block, at[len(i) :], own)
            np.add.at(side, at[len(i) :], np.einsum("nij,ni->nj", one.of_cam, one.residual) - np.einsum("nij,nj->ni", reach, one.side[one.track]))
            cost = np.zeros(len(keys))
            cost[0] = (one.residual**2).sum()
            yield pd.DataFrame(np.concatenate([keys[:, None], cost[:, None], block.reshape(-1, 36), side], 1), columns=["key", "cost", *BLOCK, *SIDE]).astype({"key": np.int64})

    names = ["cost", *BLOCK, *SIDE]
    sums = rows.mapInPandas(run, "key long, " + ", ".join(f"{n} double" for n in names)).groupBy("key").agg(*(F.sum(n).alias(n) for n in names))
    matrix, side, cost = np.zeros((count, 6, count, 6)), np.zeros((count, 6)), 0.0
    for r in sums.toLocalIterator():
        a, b = divmod(r[0], count)
        cost += r[1]
        matrix[a, :, b, :] = np.reshape(r[2:38], (6, 6))
        side[a] += r[38:44]
    return cost, matrix.reshape(count * 6, count * 6), side.ravel()


def _stepped(rows: DataFrame, cams: _Cameras, damping: float, step: np.ndarray) -> DataFrame:
    """Rows with their points moved as the cameras' step wants it."""

    def run(batches):
        for batch in batches:
            if len(batch):
                one = _Linear(batch, cams, damping)
                side = one.side.copy()
                np.add.at(side, one.track, -np.einsum("nij,ni->nj", one.both, step[one.cam]))
                moved = one.xyz + np.einsum("tij,tj->ti", one.inverse, side)
                yield batch.assign(x=moved[:, 0], y=moved[:, 1], z=moved[:, 2])

    return rows.mapInPandas(run, ROW)


def adjust(observations: DataFrame, cameras: DataFrame, points: DataFrame, rounds: int = 20, settled: float = 1e-9, most_cameras: int = MOST_CAMERAS) -> tuple[DataFrame, DataFrame, float]:
    """(cameras, points, root mean square residual in pixels) after damped least squares.

    Observations are (track_id, name, u, v), cameras (name, k, rotation, center), points
    (track_id, x, y, z).  Intrinsics stay.  Observations without a camera or a point
    do not count; cameras that see nothing stay.  The result is fixed up to a
    similarity, as nothing ties it to the ground: ``fits.fit_similarity`` does.
    A round that makes the sum of squares larger is undone and damped more.
    """
    spark = observations.sparkSession
    held = cameras.select("name", "k.fx", "k.fy", "k.cx", "k.cy", "rotation", "center").orderBy("name").limit(most_cameras + 1).collect()
    if len(held) > most_cameras:
        raise ValueError(f"more than {most_cameras} cameras: adjust parts that overlap")
    shape = lambda v, *s: np.array(v, float).reshape(-1, *s)
    cams = _Cameras(shape([r.rotation for r in held], 3, 3), shape([r.center for r in held], 3), shape([r[1:5] for r in held], 4))
    index = spark.createDataFrame([(r.name, i) for i, r in enumerate(held)], "name string, cam int")
    seen = observations.join(F.broadcast(index), "name").groupBy("track_id").agg(F.collect_list(F.struct("cam", "u", "v")).alias("o"))
    known = points.where("x is not null and y is not null and z is not null").select(F.col("track_id").cast("string").alias("track_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    rows = written(seen.withColumn("track_id", F.col("track_id").cast("string")).join(known, "track_id").select("track_id", F.col("o.cam").alias("cams"), F.col("o.u").cast("array<double>").alias("us"), F.col("o.v").cast("array<double>").alias("vs"), "x", "y", "z"))
    total = rows.agg(F.sum(F.size("cams"))).first()[0] or 0
    damping, moved = 1e-3, total > 0
    cost, matrix, side = _normal(rows, cams, damping) if moved else (0.0, None, None)
    for _ in range(rounds if moved else 0):
        blank = np.flatnonzero(np.diag(matrix) <= 0)
        matrix[blank, blank] = 1.0  # cameras that see nothing
        step = np.linalg.solve(matrix, side).reshape(-1, 6)
        tried, after = cams.moved(step), written(_stepped(rows, cams, damping, step))
        less = max(damping / 10, 1e-12)
        new, new_matrix, new_side = _normal(after, tried, less)
        if new < cost:
            dropped(rows)
            done = cost - new <= settled * cost
            rows, cams, damping, cost, matrix, side = after, tried, less, new, new_matrix, new_side
            if done:
                break
        else:
            dropped(after)
            damping *= 10
            if damping > 1e6:
                break
            _, matrix, side = _normal(rows, cams, damping)
    placed = spark.createDataFrame([(r.name, cams.rotation[i].tolist(), cams.center[i].tolist()) for i, r in enumerate(held)], "name string, rotation array<array<double>>, center array<double>")
    out = cameras.drop("rotation", "center").join(placed, "name")
    return out, rows.select("track_id", "x", "y", "z"), float(np.sqrt(cost / total)) if total else 0.0
