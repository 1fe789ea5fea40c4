"""Normals made consistent over a neighbour graph.

Neighbours of nearly parallel normals should point the same way.  A minimum
spanning forest of the graph, by 1 - |cosine|, is built in Borůvka rounds: each
vertex takes its lightest edge, which gives trees whose roots are found by
pointer jumping, signs going along; trees become the vertices of the next,
smaller graph.  No task sees a graph, and rounds grow with the logarithm of the
points.  Each tree is turned so that its highest point looks up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import dropped, written

#: Above so many points all normals are just turned up, unless told otherwise.
MOST_POINTS = 2_000_000


def turned_up(normals: DataFrame) -> DataFrame:
    """Normals looking up: right for ground seen from above."""
    sign = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    return normals.withColumns({c: F.col(c) * sign for c in ("nx", "ny", "nz")})


def _lightest(edges: DataFrame) -> DataFrame:
    """(u, v, p): the lightest edge of each vertex; ties go to the smaller name."""
    both = edges.select("u", "v", "w", "k", "p").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "k", "p"))
    return both.groupBy("u").agg(F.min(F.struct("w", "k", "v", "p")).alias("e")).select("u", "e.v", "e.p")


def _roots(lightest: DataFrame) -> DataFrame:
    """(u, r, p): each vertex's root in the trees of lightest edges, and whether its sign differs.

    With distinct weights the only cycles are two vertices that took each
    other; the smaller one is the root.
    """
    back = lightest.select(F.col("u").alias("v"), F.col("v").alias("__back"))
    now = lightest.join(back, "v", "left").select("u", F.when((F.col("__back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("r"), "p")
    now = written(now.withColumn("p", F.when(F.col("u") == F.col("r"), 0).otherwise(F.col("p"))))
    while True:
        ahead = now.select(F.col("u").alias("r"), F.col("r").alias("__r"), F.col("p").alias("__p"))
        after = written(now.join(ahead, "r").select("u", F.col("__r").alias("r"), F.when(F.col("r") == F.col("__r"), F.col("p")).otherwise(F.col("p").bitwiseXOR(F.col("__p"))).alias("p"), (F.col("r") != F.col("__r")).alias("moved")))
        dropped(now)
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def spanning_signs(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, r, p): for each point the root of its tree in the minimum spanning forest, and the parity of flips on the way.

    points: u; edges: u, v, w, p (1 if the ends' signs should differ), in one direction each.
    """
    state = written(points.select("u", F.col("u").alias("r"), F.lit(0).alias("p")))
    now = written(edges.select("u", "v", "w", F.xxhash64(F.least("u", "v"), F.greatest("u", "v")).alias("k"), "p"))
    while not now.isEmpty():
        roots = _roots(_lightest(now))
        own = roots.select(F.col("u").alias("r"), F.col("r").alias("__r"), F.col("p").alias("__p"))
        after = written(state.join(own, "r", "left").select("u", F.coalesce("__r", "r").alias("r"), F.col("p").bitwiseXOR(F.coalesce("__p", F.lit(0))).alias("p")))
        side = lambda c: roots.select(F.col("u").alias(c), F.col("r").alias(f"__{c}"), F.col("p").alias(f"__p{c}"))
        moved = now.join(side("u"), "u").join(side("v"), "v").where("__u <> __v")
        ends = moved.select(F.least("__u", "__v").alias("u"), F.greatest("__u", "__v").alias("v"), "w", "k", F.col("p").bitwiseXOR(F.col("__pu")).bitwiseXOR(F.col("__pv")).alias("p"))
        smaller = written(ends.groupBy("u", "v").agg(F.min(F.struct("w", "k", "p")).alias("e")).select("u", "v", "e.*"))
        for old in (state, now, roots):
            dropped(old)
        state, now = after, smaller
    return state


def oriented(normals: DataFrame, pairs: DataFrame, most: int = MOST_POINTS, id_column: str = "point_id") -> DataFrame:
    """normals (point_id, x, y, z, nx, ny, nz, ...) with consistent signs.

    pairs: point_id, neighbour_id.  With more than ``most`` points they are turned up.
    """
    if most and normals.limit(most + 1).count() > most:
        return turned_up(normals)
    n = normals.select(F.col(id_column).alias("u"), "nx", "ny", "nz", "z")
    ends = pairs.select(F.least(id_column, "neighbour_id").alias("u"), F.greatest(id_column, "neighbour_id").alias("v")).where("u <> v").distinct()
    met = ends.join(n.drop("z"), "u").join(n.select(F.col("u").alias("v"), *(F.col(c).alias(f"o{c}") for c in ("nx", "ny", "nz"))), "v")
    cosine = F.col("nx") * F.col("onx") + F.col("ny") * F.col("ony") + F.col("nz") * F.col("onz")
    edges = met.select("u", "v", (1 - F.abs(cosine)).alias("w"), F.when(cosine < 0, 1).otherwise(0).alias("p"))
    signs = spanning_signs(n, edges)
    placed = n.join(signs, "u").withColumn("up", F.when(F.col("p") == 1, -F.col("nz")).otherwise(F.col("nz")))
    # The highest point of each tree looks up; a level normal there counts as it is.
    top = placed.groupBy("r").agg(F.max(F.struct("z", "u", "up")).alias("top")).select("r", F.when(F.col("top.up") < 0, 1).otherwise(0).alias("__flip"))
    flips = signs.join(top, "r").select(F.col("u").alias(id_column), F.when(F.col("p").bitwiseXOR(F.col("__flip")) == 1, -1.0).otherwise(1.0).alias("__sign"))
    return normals.join(flips, id_column).withColumns({c: F.col(c) * F.col("__sign") for c in ("nx", "ny", "nz")}).drop("__sign")
