"""Operators over ordered series: rebasing, strides, displacements, greedy selection, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m


def rebase(df: DataFrame, key: str, order: list[str], time: str = "t") -> DataFrame:
    """time minus the time of the series' first row in order (not its smallest time)."""
    first = df.groupBy(key).agg(F.min_by(time, F.struct(*order)).alias("__t0"))
    return df.join(first, key).withColumn(time, F.col(time) - F.col("__t0")).drop("__t0")


def duration(df: DataFrame, key: str, order: list[str], time: str = "t") -> DataFrame:
    """Last minus first time of each series, in order."""
    by = F.struct(*order)
    return df.groupBy(key).agg((F.max_by(time, by) - F.min_by(time, by)).alias("duration_s"))


def fields_present(df: DataFrame, key: str, optional: list[str]) -> DataFrame:
    """One flag per optional field: does the series have any value of it."""
    return df.groupBy(key).agg(*((F.count(c) > 0).alias(f"has_{c}") for c in optional))


def frame_stride(source_fps: Column, target_fps: Column) -> Column:
    """max(1, round(source / target)), halves to even; 30 frames a second if the source's rate is unknown."""
    fps = F.when(source_fps > 0, source_fps).otherwise(F.lit(30.0))
    return F.greatest(F.lit(1), F.rint(fps / target_fps)).cast("long")


def every_nth(df: DataFrame, key: str, order: list[str], stride: int, most: int = 0) -> DataFrame:
    """Every stride-th row of each series, at most ``most`` of them if positive."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    kept = df.withColumn("__n", n).where(F.col("__n") % max(1, stride) == 0)
    if most > 0:
        kept = kept.where(F.col("__n") < max(1, stride) * most)
    return kept.drop("__n")


def first_n(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def steps(df: DataFrame, key: str, order: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with step_m, the distance to the row before (null for the first)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("step_m", haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)))


def median_step(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return steps(df, key, order).groupBy(key).agg(F.percentile("step_m", F.lit(0.5)).alias("median_step_m"))


def select_by_displacement(df: DataFrame, key: str, order: list[str], displacement: str, least: float, most: int = 0, cap_before: bool = False) -> DataFrame:
    """Greedy selection: the first row, then each row at which the positive displacements since the last selected one reach ``least``.

    The cap is looked at only after a row was added, so ``most=1`` gives two
    rows; ``cap_before`` gives one.  Each choice hangs on the one before it, so
    a series is one task's work; it passes by in sorted batches of which only
    three numbers are remembered, whatever its length.
    """
    moved = F.greatest(F.lit(0.0), F.coalesce(F.col(displacement).cast("double"), F.lit(0.0)))
    dealt = df.withColumn("__d", moved).repartition(key).sortWithinPartitions(key, *order, "__d")
    columns = df.columns

    def choose(batches):
        import pyarrow as pa

        series, acc, n, full = object(), 0.0, 0, False
        for batch in batches:
            take = []
            for name, d in zip(batch.column(key).to_pylist(), batch.column("__d").to_pylist(), strict=True):
                if first := name != series:
                    series, acc, n, full = name, 0.0, 0, False
                else:
                    acc += d
                full = full or (cap_before and 0 < most <= n)
                chosen = not full and (first or acc >= least)
                if chosen:
                    acc, n = 0.0, n + 1
                    full = not first and 0 < most <= n
                take.append(chosen)
            yield batch.select(columns).filter(pa.array(take))

    return dealt.mapInArrow(choose, df.schema)


def along_path(points: DataFrame, probes: DataFrame, key: str, order: str, coordinates: list[str], distance: str = "s") -> DataFrame:
    """Points of polylines at given distances along them; beyond the end, on the last segment's line."""
    w = Window.partitionBy(key).orderBy(order)
    nexts = {c: F.lead(c).over(w) for c in coordinates}
    length = F.sqrt(sum((F.pow(nexts[c] - F.col(c), F.lit(2)) for c in coordinates), F.lit(0.0)))
    segments = points.select(key, order, *coordinates, *(nexts[c].alias(f"__{c}") for c in coordinates), length.alias("__len")).where("__len is not null")
    total = F.sum("__len").over(w.rowsBetween(Window.unboundedPreceding, 0))
    segments = segments.withColumn("__end", total).withColumn("__start", F.col("__end") - F.col("__len")).withColumn("__last", F.lead(order).over(w).isNull()).withColumn("__first", F.lag(order).over(w).isNull())
    inside = ((F.col(f"p.{distance}") > F.col("g.__start")) | F.col("g.__first")) & ((F.col(f"p.{distance}") <= F.col("g.__end")) | F.col("g.__last"))
    met = probes.alias("p").join(segments.alias("g"), (F.col(f"p.{key}") == F.col(f"g.{key}")) & inside)
    u = F.coalesce(F.try_divide(F.col(f"p.{distance}") - F.col("g.__start"), F.nullif(F.col("g.__len"), F.lit(0.0))), F.lit(0.0))
    return met.select(*(F.col(f"p.{c}") for c in probes.columns), *((F.col(f"g.{c}") + u * (F.col(f"g.__{c}") - F.col(f"g.{c}"))).alias(c) for c in coordinates))
