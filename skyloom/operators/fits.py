"""Robust fits: similarity transforms, trimmed lines, derived projections, normals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import checked_epsg, utm_epsg, utm_zone


def derive_crs(track: DataFrame, key: str | None = None, override: int | None = None) -> DataFrame:
    """epsg, zone, hemisphere and derived_from of each track, from its median position or an override."""
    if override is not None:
        rows = track.select(key).distinct() if key else track.sparkSession.range(1).select()
        return rows.select(*([key] if key else []), checked_epsg(F.lit(override)).alias("epsg"), F.lit(-1).alias("zone"), F.lit("?").alias("hemisphere"), F.lit("user_set").alias("derived_from"))
    med = track.groupBy(*([key] if key else [])).agg(F.percentile("lon", F.lit(0.5)).alias("lon"), F.percentile("lat", F.lit(0.5)).alias("lat"))
    bad = F.col("lon").isNull() | ~F.col("lon").between(-180.0, 180.0) | ~F.col("lat").between(-90.0, 90.0)
    epsg = F.when(bad, F.raise_error(F.lit("track without valid coordinates")).cast("int")).otherwise(utm_epsg(F.col("lon"), F.col("lat")))
    return med.select(*([key] if key else []), epsg.alias("epsg"), utm_zone(F.col("lon")).alias("zone"), F.when(F.col("lat") >= 0, "N").otherwise("S").alias("hemisphere"), F.lit("track_median").alias("derived_from"))


MOMENTS = [f"{a}{i}" for a in ("s", "d") for i in range(3)]


def similarity_moments(pairs: DataFrame, key: str | None = None) -> DataFrame:
    """Means, cross-covariance and source variance of point pairs (s0..s2, d0..d2): all that a similarity needs, by one partial aggregation."""
    cov = [F.covar_pop(f"d{i}", f"s{j}").alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    var = (F.var_pop("s0") + F.var_pop("s1") + F.var_pop("s2")).alias("var_s")
    return pairs.groupBy(*([key] if key else [])).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in MOMENTS), *cov, var)


def solve_similarity(n: int, mean_s: np.ndarray, mean_d: np.ndarray, cov: np.ndarray, var_s: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Umeyama's closed form from the moments."""
    if n < 3:
        raise ValueError("a similarity needs three points at least")
    u, d, vt = np.linalg.svd(cov)
    sign = np.ones(3)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        sign[2] = -1
    rotation = u @ np.diag(sign) @ vt
    scale = float((d * sign).sum() / var_s) if var_s > 0 else 1.0
    return scale, rotation, mean_d - scale * rotation @ mean_s


def fit_similarity(pairs: DataFrame, key: str) -> DataFrame:
    """(key, scale, rotation, translation) of each group; the solver sees one row of moments per group."""
    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                g = r._asdict()
                s, rot, t = solve_similarity(int(g["n"]), np.array([g[f"m_s{i}"] for i in range(3)]), np.array([g[f"m_d{i}"] for i in range(3)]), np.array([[g[f"c{i}{j}"] for j in range(3)] for i in range(3)]), g["var_s"])
                out.append((g[key], s, rot.tolist(), t.tolist()))
            yield pd.DataFrame(out, columns=[key, "scale", "rotation", "translation"])

    moments = similarity_moments(pairs, key)
    kind = moments.schema[key].dataType.simpleString()
    return moments.mapInPandas(solve, f"{key} {kind}, scale double, rotation array<array<double>>, translation array<double>")


def fit_scale_shift(rows: DataFrame, key: str, x: str, y: str, rounds: int = 3, keep: float = 0.8) -> DataFrame:
    """Trimmed least squares y = a x + b of each group: a, b, n, n_inliers and the inliers' median residual.

    Each round fits the rows kept so far, and drops those whose residual is
    above the residuals' quantile ``keep``; a and b are those before the last
    trim.  A group is done when three rows are left, or fewer would be.  Groups
    with fewer than three usable rows are left out.  One shuffle by the key
    serves all rounds, as windows over the whole group; a group is one
    image's anchors.
    """
    usable = F.lit(True)
    for c in (x, y):
        usable = usable & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    w = Window.partitionBy(key)
    now = rows.where(usable & (F.col(y) > 0)).select(key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    now = now.withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 3")
    now = now.select(key, "__x", "__y", "n", F.lit(True).alias("__in"), F.lit(False).alias("__done"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("__r"))
    for _ in range(rounds):
        u, v = F.when(F.col("__in"), F.col("__x")), F.when(F.col("__in"), F.col("__y"))
        fitted = now.select("*", F.count(u).over(w).alias("__used"), F.regr_slope(v, u).over(w).alias("__a"), F.regr_intercept(v, u).over(w).alias("__b"), F.avg(u).over(w).alias("__xm"), F.avg(v).over(w).alias("__ym"))
        # A single distinct x leaves the slope open: the smallest coefficients win, as with a pseudo-inverse.
        norm = F.col("__xm") * F.col("__xm") + 1
        a = F.when(F.col("__done"), F.col("a")).otherwise(F.coalesce("__a", F.col("__xm") * F.col("__ym") / norm))
        b = F.when(F.col("__done"), F.col("b")).otherwise(F.coalesce("__b", F.col("__ym") / norm))
        fitted = fitted.select(key, "__x", "__y", "n", "__in", "__done", "__used", a.alias("a"), b.alias("b")).withColumn("__r", F.abs(F.col("a") * F.col("__x") + F.col("b") - F.col("__y")))
        limited = fitted.withColumn("__limit", F.greatest(F.percentile(F.when(F.col("__in"), F.col("__r")), F.lit(keep)).over(w), F.lit(1e-9)))
        limited = limited.withColumn("__keep", F.col("__in") & (F.col("__r") <= F.col("__limit")))
        judged = limited.withColumn("__done", F.col("__done") | (F.col("__used") <= 3) | (F.count(F.when(F.col("__keep"), 1)).over(w) < 3))
        now = judged.select(key, "__x", "__y", "n", F.when(F.col("__done"), F.col("__in")).otherwise(F.col("__keep")).alias("__in"), "__done", "a", "b", "__r")
    return now.groupBy(key).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("n").alias("n"), F.count_if("__in").alias("n_inliers"), F.percentile(F.when(F.col("__in"), F.col("__r")), F.lit(0.5)).alias("median_residual"))


def trust_fit(fits: DataFrame, least: int = 8) -> DataFrame:
    """fits with metric: enough anchors to be believed."""
    return fits.withColumn("metric", F.col("n") >= least)


def normals(neighbourhoods: DataFrame, id_column: str = "point_id") -> DataFrame:
    """(point_id, nx, ny, nz): direction of least variance of each neighbourhood, pointing up.

    The six covariances are aggregated in the JVM; Python sees one row per point.
    """
    cov = neighbourhoods.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"), *(F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))

    def solve(batches):
        for pdf in batches:
            m = pdf[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy().reshape(-1, 3, 3)
            v = np.linalg.eigh(m)[1][:, :, 0]
            v *= np.where(v[:, 2:3] < 0, -1.0, 1.0)
            yield pd.DataFrame({id_column: pdf[id_column], "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2]})

    kind = cov.schema[id_column].dataType.simpleString()
    return cov.where("n >= 3").mapInPandas(solve, f"{id_column} {kind}, nx double, ny double, nz double")
