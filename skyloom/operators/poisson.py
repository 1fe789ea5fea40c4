"""Surface reconstruction from oriented points: a Poisson solve on nested grids, and its iso-surface.

The indicator's gradient should be the field of normals, so its Laplacian is
the field's divergence.  The cube around the points is halved level by level.
At the coarsest level it is one small dense grid, solved exactly by
eigenvectors, with no flow through its sides.  At each finer level only blocks of
nodes near points are refined: a block is solved exactly, with an overlap of
``HALO`` nodes all around, between values interpolated from the level before,
and keeps its core.  What is far away is smooth and settled by coarse levels, so
one pass per level does, and a level is one grouped map over blocks of bounded
size.  Every node has one owner, so neighbouring blocks agree where they meet.

Samples of a level are means of the points of a cell, so dense places weigh no
more than sparse ones.

The surface is cut by tetrahedra (six around a cube's diagonal).  A vertex is
named by the edge that it lies on, whichever block meets it, so the mesh is closed
wherever all of a cube's corners are known.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import written

BASE = 5
BLOCK, HALO = 16, 8
#: Nodes along a solved box.
BOX = BLOCK + 2 * HALO + 1
#: Levels between the finest cells and those whose number of points is a vertex' density.
DENSITY_LEVELS = 2
#: Sizes of cells, each twice the one before, that a density adds up.
DENSITY_STEPS = 4
_KEYS = ["bx", "by", "bz"]


def _spread(df: DataFrame, low: dict[str, Column], high: dict[str, Column], steps: int) -> DataFrame:
    """df repeated for the blocks from low to high, at most ``steps`` an axis."""
    out = df.withColumns({f"__lo{a}": low[a] for a in "xyz"} | {f"__hi{a}": high[a] for a in "xyz"})
    for a in "xyz":
        out = out.withColumn("__d", F.explode(F.array(*map(F.lit, range(steps))))).withColumn(f"b{a}", (F.col(f"__lo{a}") + F.col("__d")).cast("int")).where(F.col(f"b{a}") <= F.col(f"__hi{a}"))
    return out.drop("__d", *(f"__{s}{a}" for a in "xyz" for s in ("lo", "hi")))


def _block(node: Column) -> Column:
    return F.floor(node / BLOCK)


def _clipped(node: Column, level: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(1 << level), node))


def level_samples(points: DataFrame, origin: list[float], side: float, level: int) -> DataFrame:
    """(ix, iy, iz, x, y, z, nx, ny, nz, n): the mean point of each cell, in cells, and its unit normal."""
    at = {a: (F.col(a) - origin[i]) * ((1 << level) / side) for i, a in enumerate("xyz")}
    cells = points.select(*(at[a].alias(a) for a in "xyz"), *(F.floor(at[a]).cast("int").alias(f"i{a}") for a in "xyz"), "nx", "ny", "nz")
    means = cells.groupBy("ix", "iy", "iz").agg(*(F.avg(c).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")), F.count(F.lit(1)).alias("n"))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return means.withColumn("__s", size).where("__s > 1e-9").withColumns({c: F.col(c) / F.col("__s") for c in ("nx", "ny", "nz")}).drop("__s")


def _right_side(xyz: np.ndarray, normals: np.ndarray, nodes: int) -> np.ndarray:
    """The divergence of the normals, dealt to the eight nodes around each sample, times the squared cell size."""
    field = np.zeros((nodes + 2, nodes + 2, nodes + 2, 3))  # node i at i + 1
    low = np.floor(xyz).astype(int)
    part = xyz - low
    for corner in product((0, 1), repeat=3):
        at = low + corner + 1
        ok = ((at >= 0) & (at < nodes + 2)).all(1)
        weight = np.where(corner, part, 1 - part).prod(1)
        np.add.at(field, tuple(at[ok].T), normals[ok] * weight[ok, None])
    return sum((np.roll(field[..., i], -1, i) - np.roll(field[..., i], 1, i))[1:-1, 1:-1, 1:-1] for i in range(3)) / 2


@cache
def _modes(n: int, closed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and eigenvalues of the second difference on n nodes; closed ends have no flow, others are fixed outside."""
    t = np.diag(np.full(n, -2.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    if closed:
        t[0, 0] = t[-1, -1] = -1.0
    values, vectors = np.linalg.eigh(t)
    return vectors, values


def _along(matrix: np.ndarray, cube: np.ndarray) -> np.ndarray:
    """The matrix applied along each of the three axes."""
    for _ in range(3):
        cube = np.moveaxis(np.tensordot(matrix, cube, (1, 0)), 0, 2)
    return cube


def _solved(right: np.ndarray, closed: bool) -> np.ndarray:
    """u with (sum of neighbours) - 6 u = right."""
    vectors, values = _modes(len(right), closed)
    total = values[:, None, None] + values[:, None] + values
    modes = _along(vectors.T, right)
    return _along(vectors, np.divide(modes, total, out=np.zeros_like(modes), where=np.abs(total) > 1e-9))


def coarse_solution(samples: pd.DataFrame, level: int) -> np.ndarray:
    n = (1 << level) + 1
    return _solved(_right_side(samples[["x", "y", "z"]].to_numpy(), samples[["nx", "ny", "nz"]].to_numpy(), n), closed=True)


@cache
def _halving() -> np.ndarray:
    """Interpolation from every second node to all nodes of a box."""
    out = np.zeros((BOX, (BOX + 1) // 2))
    for i in range(BOX):
        out[i, i // 2] += 0.5
        out[i, (i + 1) // 2] += 0.5
    return out


def _read(cube: np.ndarray, xyz: np.ndarray) -> np.ndarray:
    """Trilinear values at places in nodes."""
    low = np.clip(np.floor(xyz).astype(int), 0, len(cube) - 2)
    part, out = xyz - low, np.zeros(len(xyz))
    for corner in product((0, 1), repeat=3):
        out += cube[tuple((low + corner).T)] * np.where(corner, part, 1 - part).prod(1)
    return out


def _refine(level: int):
    def run(key: tuple, samples: pd.DataFrame, coarse: pd.DataFrame) -> pd.DataFrame:
        block = np.array(key)
        half = (BOX + 1) // 2
        ids = np.clip(np.add.outer(block * BLOCK // 2 - HALO // 2, np.arange(half)), 0, 1 << (level - 1))
        before = np.zeros((half, half, half))
        for r in coarse.itertuples(index=False):
            own = [(ids[i] // BLOCK) == c for i, c in enumerate((r.cx, r.cy, r.cz))]
            cube = np.frombuffer(r.values, np.float64).reshape(BLOCK, BLOCK, BLOCK)
            before[np.ix_(*own)] = cube[np.ix_(*(ids[i][own[i]] % BLOCK for i in range(3)))]
        box = _along(_halving(), before)
        low = block * BLOCK - HALO
        xyz = samples[["x", "y", "z"]].to_numpy() - low
        right = _right_side(xyz, samples[["nx", "ny", "nz"]].to_numpy(), BOX)[1:-1, 1:-1, 1:-1]
        for axis in range(3):
            for end, side in ((0, 0), (-1, -1)):
                first, edge = [slice(None)] * 3, [slice(1, -1)] * 3
                first[axis], edge[axis] = end, side
                right[tuple(first)] -= box[tuple(edge)]
        box[1:-1, 1:-1, 1:-1] = _solved(right, closed=False)
        own = (samples[["ix", "iy", "iz"]].to_numpy() // BLOCK == block).all(1)
        level_at = _read(box, xyz[own])
        core = np.ascontiguousarray(box[HALO : HALO + BLOCK, HALO : HALO + BLOCK, HALO : HALO + BLOCK])
        return pd.DataFrame([(*key, core.tobytes(), float(level_at.sum()), int(own.sum()))], columns=[*_KEYS, "values", "iso_sum", "iso_n"])

    return run


def indicator(points: DataFrame, origin: list[float], side: float, depth: int) -> tuple[DataFrame, float]:
    """(bx, by, bz, values): blocks of the finest level's nodes near points, and the value at the surface."""
    spark, base = points.sparkSession, min(BASE, depth)
    samples = {level: written(level_samples(points, origin, side, level)) for level in range(base, depth + 1)}
    needed: dict[int, DataFrame] = {}
    near = {a: (F.col(f"i{a}") - 2, F.col(f"i{a}") + 3) for a in "xyz"}
    ranges = lambda level, pair: ({a: _block(_clipped(pair[a][0], level)) for a in "xyz"}, {a: _block(_clipped(pair[a][1], level)) for a in "xyz"})
    for level in range(depth, base, -1):
        if level == depth:
            wanted = _spread(samples[level], *ranges(level, near), 2).select(*_KEYS).distinct()
        else:
            span = {a: (F.col(f"p{a}") * (BLOCK // 2) - HALO // 2, F.col(f"p{a}") * (BLOCK // 2) - HALO // 2 + (BOX - 1) // 2) for a in "xyz"}
            finer = needed[level + 1].select(*(F.col(f"b{a}").alias(f"p{a}") for a in "xyz"))
            wanted = _spread(finer, *ranges(level, span), 2).select(*_KEYS).distinct()
        needed[level] = written(wanted)
    dense = coarse_solution(samples[base].toPandas(), base)  # at most 2 ** (3 * BASE) rows
    n = -(-len(dense) // BLOCK)
    padded = np.pad(dense, (0, n * BLOCK - len(dense)), mode="edge")
    cut = lambda *b: np.ascontiguousarray(padded[tuple(slice(i * BLOCK, (i + 1) * BLOCK) for i in b)]).tobytes()
    blocks = spark.createDataFrame([(*b, bytearray(cut(*b))) for b in product(range(n), repeat=3)], "bx int, by int, bz int, values binary")
    if depth == base:
        at = samples[base].select("x", "y", "z").toPandas().to_numpy()
        return blocks, float(_read(dense, at).mean())
    for level in range(base + 1, depth + 1):
        parents = _spread(needed[level].select(*(F.col(f"b{a}").alias(f"p{a}") for a in "xyz")), *ranges(level - 1, {a: (F.col(f"p{a}") * (BLOCK // 2) - HALO // 2, F.col(f"p{a}") * (BLOCK // 2) - HALO // 2 + (BOX - 1) // 2) for a in "xyz"}), 2)
        coarse = parents.join(blocks.select(*_KEYS, "values"), _KEYS).select(*(F.col(f"p{a}").alias(f"b{a}") for a in "xyz"), *(F.col(f"b{a}").alias(f"c{a}") for a in "xyz"), "values")
        reach = {a: (F.ceil((F.col(f"i{a}") - (BLOCK + HALO)) / BLOCK), F.floor((F.col(f"i{a}") + HALO + 1) / BLOCK)) for a in "xyz"}
        dealt = _spread(samples[level], {a: reach[a][0] for a in "xyz"}, {a: reach[a][1] for a in "xyz"}, 3).join(needed[level], _KEYS, "left_semi")
        solved = dealt.groupBy(*_KEYS).cogroup(coarse.groupBy(*_KEYS)).applyInPandas(_refine(level), "bx int, by int, bz int, values binary, iso_sum double, iso_n long")
        blocks = written(solved)
    total = blocks.agg(F.sum("iso_sum").alias("s"), F.sum("iso_n").alias("n")).first()
    return blocks.select(*_KEYS, "values"), total.s / max(1, total.n)


def _tetrahedra() -> list[np.ndarray]:
    """Corners of the six tetrahedra around a cube's diagonal."""
    return [np.array([[0, 0, 0], *np.cumsum(np.eye(3, dtype=int)[list(p)], axis=0)]) for p in permutations(range(3))]


def _cuts(inside: tuple[bool, ...]) -> list[tuple[tuple[int, int], ...]]:
    """Triangles, each by three edges (corner within, corner without), of a tetrahedron's signs."""
    within, without = [i for i in range(4) if inside[i]], [i for i in range(4) if not inside[i]]
    if len(within) == 2:
        (a, b), (c, d) = within, without
        return [((a, c), (a, d), (b, d)), ((a, c), (b, d), (b, c))]
    return [tuple((i, o) for i in within for o in without)] if within and without else []


def surface_of(cube: np.ndarray, low: np.ndarray, iso: float, size: int) -> pd.DataFrame:
    """Triangles of a cube of nodes that starts at node ``low``: ids and places (in nodes) of their corners; unknown nodes are NaN."""
    inside = cube < iso
    known = np.isfinite(cube)
    corners = list(product((0, 1), repeat=3))
    cut = tuple(slice(None, -1) for _ in range(3))
    part = lambda array, c: array[tuple(slice(x, x + array.shape[i] - 1) for i, x in enumerate(c))]
    some, every = np.zeros_like(inside[cut]), np.ones_like(inside[cut])
    whole = np.ones_like(inside[cut])
    for c in corners:
        some, every, whole = some | part(inside, c), every & part(inside, c), whole & part(known, c)
    cubes = np.argwhere(some & ~every & whole)
    out = []
    for tetrahedron in _tetrahedra():
        nodes = cubes[:, None] + tetrahedron
        values = cube[tuple(np.moveaxis(nodes, 2, 0))]
        signs = values < iso
        for case in product((False, True), repeat=4):
            rows = (signs == case).all(1)
            for triangle in _cuts(case) if rows.any() else []:
                ids, places = [], []
                for edge in triangle:
                    a, b = sorted(edge)  # corners ascend along every axis
                    va, vb = values[rows, a], values[rows, b]
                    step = tetrahedron[b] - tetrahedron[a]
                    node = nodes[rows, a] + low
                    ids.append((((node[:, 0] * size + node[:, 1]) * size + node[:, 2]) << 3) + int(step @ (1, 2, 4)))
                    places.append(node + ((iso - va) / (vb - va))[:, None] * step)
                outward = tetrahedron[[i for i in range(4) if not case[i]]].mean(0) - tetrahedron[[i for i in range(4) if case[i]]].mean(0)
                flip = np.cross(places[1] - places[0], places[2] - places[0]) @ outward < 0
                for pair in (ids, places):
                    first, second = pair[1].copy(), pair[2].copy()
                    pair[1][flip], pair[2][flip] = second[flip], first[flip]
                out.append(pd.DataFrame({n: i for n, i in zip("abc", ids, strict=True)} | {f"{n}{a}": p[:, j] for n, p in zip("abc", places, strict=True) for j, a in enumerate("xyz")}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["a", "b", "c", *(f"{n}{a}" for n in "abc" for a in "xyz")])


def _extract(iso: float, size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cube = np.full((BLOCK + 1,) * 3, np.nan)
        for r in rows.itertuples(index=False):
            values = np.frombuffer(r.values, np.float64).reshape((BLOCK,) * 3)
            to = tuple(slice(BLOCK, None) if d else slice(None, BLOCK) for d in (r.dx, r.dy, r.dz))
            cube[to] = values[tuple(slice(None, 1) if d else slice(None) for d in (r.dx, r.dy, r.dz))]
        at = np.array(key) * BLOCK
        for axis in range(3):  # padding beyond the last node
            beyond = [slice(None)] * 3
            beyond[axis] = slice(max(0, size - at[axis]), None)
            cube[tuple(beyond)] = np.nan
        return surface_of(cube, at, iso, size)

    return run


def poisson_mesh(points: DataFrame, depth: int = 8, scale: float = 1.25) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the surface of oriented points (x, y, z, nx, ny, nz, and r, g, b if there are colours).

    vertices: vertex, x, y, z, density (points per cell two levels above the
    finest one, added up over it and three larger ones around the vertex, so that it
    falls with the distance from the points) and the mean colour of the smallest of them; faces: a, b, c,
    counter-clockwise seen from outside.  The cube is ``scale`` times the points' extent
    and halved ``depth`` times.  Far from all points there is no mesh.
    """
    if not 1 <= depth <= 18:
        raise ValueError("the depth lies between 1 and 18")
    ends = points.agg(*(f(a).alias(f"{a}{n}") for a in "xyz" for n, f in (("0", F.min), ("1", F.max)))).first()
    if ends.x0 is None:
        raise ValueError("no points to mesh")
    side = scale * max(ends[f"{a}1"] - ends[f"{a}0"] for a in "xyz") or 1.0
    origin = [(ends[f"{a}0"] + ends[f"{a}1"] - side) / 2 for a in "xyz"]
    blocks, iso = indicator(points, origin, side, depth)
    size = (1 << depth) + 1
    dealt = blocks.withColumn("__d", F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{a}") for a, v in zip("xyz", d, strict=True))) for d in product((0, 1), repeat=3))))).select(*((F.col(f"b{a}") - F.col(f"__d.d{a}")).cast("int").alias(f"b{a}") for a in "xyz"), "__d.*", "values")
    owned = dealt.join(blocks.select(*_KEYS), _KEYS, "left_semi")
    corners = ", ".join(f"{n}{a} double" for n in "abc" for a in "xyz")
    cut = written(owned.groupBy(*_KEYS).applyInPandas(_extract(iso, size), f"a long, b long, c long, {corners}"))
    step = side / (1 << depth)
    named = cut.select(F.explode(F.array(*(F.struct(F.col(n).alias("vertex"), *((F.col(f"{n}{a}") * step + origin[i]).alias(a) for i, a in enumerate("xyz"))) for n in "abc"))).alias("v")).select("v.*")
    vertices = named.groupBy("vertex").agg(*(F.min(a).alias(a) for a in "xyz"))
    wide = step * (1 << min(DENSITY_LEVELS, depth))
    cell = [F.floor((F.col(a) - origin[i]) / wide).alias(f"__{a}") for i, a in enumerate("xyz")]
    colors = [c for c in "rgb" if c in points.columns]
    counts = points.select(*cell, *colors).groupBy("__x", "__y", "__z").agg(F.count(F.lit(1)).alias("__n"), *(F.avg(c).alias(c) for c in colors))
    dense = vertices.select("*", *cell).withColumn("density", F.lit(0.0))
    for k in range(DENSITY_STEPS):
        dense = dense.join(counts, ["__x", "__y", "__z"], "left").withColumn("density", F.col("density") + F.coalesce("__n", F.lit(0)) / 8.0**k).drop("__n")
        up = {f"__{a}": F.floor(F.col(f"__{a}") / 2) for a in "xyz"}
        dense = dense.withColumns(up)
        counts = counts.select("__n", *(v.alias(c) for c, v in up.items())).groupBy("__x", "__y", "__z").agg(F.sum("__n").alias("__n"))
    dense = dense.drop("__x", "__y", "__z")
    # Corners that fall on one vertex leave no area.
    return dense, cut.select("a", "b", "c").where("a <> b and b <> c and a <> c")


def cropped(vertices: DataFrame, faces: DataFrame, kept: DataFrame) -> DataFrame:
    """Faces all of whose corners are among the kept vertices."""
    out = faces
    for c in "abc":
        out = out.join(kept.select(F.col("vertex").alias(c)), c, "left_semi")
    return out.select("a", "b", "c")
