"""Tracks, points and adjustment on a made-up scene."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import structure

CAMERA = "name string, k struct<fx:double,fy:double,cx:double,cy:double>, rotation array<array<double>>, center array<double>"
MATCH = "name_a string, feature_a int, name_b string, feature_b int, score double"


def brute_tracks(matches):
    """The rule stated in ``tracks``, for matches of different scores."""
    edges, out = {frozenset(((a, i), (b, j))): w for a, i, b, j, w in matches}, set()
    while edges:
        parts = []
        for e in edges:
            joined = set(e)
            for p in [p for p in parts if p & joined]:
                joined |= p
                parts.remove(p)
            parts.append(joined)
        left = {}
        for p in parts:
            if len({n for n, _ in p}) == len(p):
                out.add(frozenset(p))
                continue
            own = {e: w for e, w in edges.items() if set(e) <= p}
            lo, hi = min(own.values()), max(own.values())
            left |= {e: w for e, w in own.items() if w < hi and w <= hi / 2 + lo / 2}
        edges = left
    return out


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.track_id, set()).add((r.name, r.feature))
    return {frozenset(v) for v in out.values()}


def test_tracks(spark):
    rng = random.Random(4)
    scores = iter(rng.sample(range(1, 10_000), 400))
    matches = [(f"i{a}", t, f"i{b}", t, next(scores) / 10) for t in range(12) for a, b in itertools.combinations(range(5), 2) if rng.random() < 0.5]
    matches += [(f"i{rng.randrange(5)}", rng.randrange(12), f"j{rng.randrange(3)}", rng.randrange(12), next(scores) / 10) for _ in range(25)]  # false ones
    matches = list({frozenset(((m[0], m[1]), (m[2], m[3]))): m for m in matches}.values())
    df = spark.createDataFrame(matches, MATCH)
    got = grouped(structure.tracks(df))
    assert got == brute_tracks(matches)
    assert all(len({n for n, _ in t}) == len(t) for t in got)
    flipped = df.select(F.col("name_b").alias("name_a"), F.col("feature_b").alias("feature_a"), F.col("name_a").alias("name_b"), F.col("feature_a").alias("feature_b"), "score", F.lit(1).alias("root"))
    odd = spark.createDataFrame([("i0", 1, "i0", 2, 0.0), (None, 1, "i0", 2, 0.0), ("i0", None, "i1", 2, 0.0)], MATCH)
    assert grouped(structure.tracks(flipped.drop("root").union(odd).union(flipped.drop("root")))) == got
    assert structure.tracks(df.limit(0)).isEmpty()
    # Equal and null scores end too.
    tie = spark.createDataFrame([("a", 1, "b", 1, 1.0), ("b", 1, "a", 2, 1.0), ("c", 1, "d", 1, None), ("d", 1, "c", 2, None)], MATCH)
    assert sorted(len(t) for t in grouped(structure.tracks(tie))) == [2, 2]


def test_tracks_that_lie_together_need_no_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(structure, "written", lambda df, real=structure.written: made.append(1) or real(df))
    chain = [(f"i{k:02}", t, f"i{k + 1:02}", t, 1.0) for t in range(40) for k in range(30)]
    want = {frozenset((f"i{k:02}", t) for k in range(31)) for t in range(40)}
    assert grouped(structure.tracks(spark.createDataFrame(chain, MATCH).coalesce(1))) == want
    assert len(made) <= 8
    # Torn apart over tasks and blocks they are the same tracks, by rounds.
    monkeypatch.setattr(structure, "JOINED", 7)
    random.Random(1).shuffle(chain)
    assert grouped(structure.tracks(spark.createDataFrame(chain, MATCH).repartition(4))) == want


def test_features_that_share_a_number_are_numbered_anew(spark, monkeypatch):
    real, seeds = structure._number, set()

    def number(seed, end):
        seeds.add(seed)
        return real(seed, end) if seed else F.pmod(real(seed, end), F.lit(3))

    monkeypatch.setattr(structure, "_number", number)
    chain = [(f"i{k}", t, f"i{k + 1}", t, 1.0) for t in range(5) for k in range(3)]
    assert grouped(structure.tracks(spark.createDataFrame(chain, MATCH))) == {frozenset((f"i{k}", t) for k in range(4)) for t in range(5)}
    assert seeds == {0, 1}


def scene(seed=2, n=60):
    rng = np.random.default_rng(seed)
    points = np.c_[rng.uniform(-40, 40, (n, 2)), rng.uniform(-6, 6, n)]
    cams = []
    for i in range(7):
        w = rng.normal(0, 0.08, 3)
        turn = np.eye(3) + structure._cross(w[None])[0]
        q, _ = np.linalg.qr(turn)
        cams.append((np.diag(np.sign(np.diag(q))) @ q.T @ np.diag([1.0, -1.0, -1.0]), np.array([-30 + 10 * i, 12.0 * (-1) ** i, 90 + 3 * i])))
    k = (800.0, 790.0, 320.0, 240.0)
    seen = []
    for t, p in enumerate(points):
        for i, (r, c) in enumerate(cams):
            x = r @ (p - c)
            if (t + i) % 4:
                seen.append((f"t{t}", f"c{i}", float(k[0] * x[0] / x[2] + k[2]), float(k[1] * x[1] / x[2] + k[3])))
    return points, cams, k, seen


def test_points_and_adjustment(spark):
    points, cams, k, seen = scene()
    obs = spark.createDataFrame(seen, "track_id string, name string, u double, v double")
    frame = lambda cs: spark.createDataFrame([(f"c{i}", k, r.tolist(), c.tolist()) for i, (r, c) in enumerate(cs)], CAMERA)
    exact = {r.track_id: (r.x, r.y, r.z, r.n) for r in structure.triangulate(structure.rays(obs, frame(cams))).collect()}
    for t, p in enumerate(points):
        assert np.allclose(exact[f"t{t}"][:3], p, atol=1e-6) and exact[f"t{t}"][3] == sum(s[0] == f"t{t}" for s in seen)
    # One ray, and the same ray twice, give no point.
    alone = structure.triangulate(structure.rays(obs.where("track_id = 't1' and name = 'c1'").union(obs.where("track_id = 't2' and name = 'c1'")).union(obs.where("track_id = 't2' and name = 'c1'")), frame(cams)))
    assert all(r.x is None for r in alone.collect()) and alone.count() == 2
    # Cameras off by some 0.6 degrees and half a metre an axis, and their points, come back, up to a similarity.
    rng = np.random.default_rng(9)
    off = [((np.eye(3) + structure._cross(rng.normal(0, 0.01, (1, 3)))[0]) @ r, c + rng.normal(0, 0.5, 3)) for r, c in cams]
    off = [(np.linalg.svd(r)[0] @ np.linalg.svd(r)[2], c) for r, c in off]
    start = structure.triangulate(structure.rays(obs, frame(off)))
    extra = spark.createDataFrame([("blind", k, np.eye(3).tolist(), [0.0, 0.0, 0.0])], CAMERA)
    out, placed, rms = structure.adjust(obs, frame(off).union(extra), start, 12)
    assert rms < 1e-4
    got = {r.track_id: np.array([r.x, r.y, r.z]) for r in placed.collect()}
    a = np.array([got[f"t{t}"] for t in range(len(points))])
    a0, p0 = a - a.mean(0), points - points.mean(0)
    u, s, vt = np.linalg.svd(p0.T @ a0)
    turn = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
    scale = s.sum() / (a0**2).sum()
    assert np.abs(scale * a0 @ turn.T - p0).max() < 1e-3
    held = {r.name: r for r in out.collect()}
    for i, (_, c) in enumerate(cams):
        assert np.allclose(scale * turn @ (np.array(held[f"c{i}"].center) - a.mean(0)) + points.mean(0), c, atol=1e-3)
    assert held["blind"].center == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError, match="more than 3 cameras"):
        structure.adjust(obs, frame(off), start, most_cameras=3)
