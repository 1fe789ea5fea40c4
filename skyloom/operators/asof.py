"""Interpolating as-of join.

Per series, a probe between two samples gets their linear interpolation; a
probe before the first or after the last sample gets that sample.  An exact
hit gives the sample hit, of equal times the first one.

Series are cut into time chunks, so that one long series is spread over many
tasks: two windows within each chunk find the neighbours of a probe, and where
a chunk has none, the nearest sample of the chunks before or after is carried
in from a summary with one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_S = 6 * 3600.0


def _lerp(a: Column, b: Column, f: Column) -> Column:
    """Between both if both are there, else whichever is."""
    return F.when(a.isNotNull() & b.isNotNull(), a + (b - a) * f).otherwise(F.coalesce(a, b))


def asof_lerp(samples: DataFrame, probes: DataFrame, key: str, values: list[str], time: str = "t", order: str | None = None, offset_s: float = 0.0, chunk_s: float = CHUNK_S) -> DataFrame:
    """probes with the interpolated values; probes of series without samples are dropped.

    samples: key, time, values, and order, which ranks samples of equal time
    (by default the time itself).  offset_s is added to the probes' times
    before the look-up.
    """
    at = F.col(time).cast("double")
    ranked = F.col(order) if order else F.lit(0)
    sample = F.struct(at.alias("t"), ranked.cast("long").alias("o"), *(F.col(v).cast("double").alias(v) for v in values))
    left = samples.where(F.col(time).isNotNull()).select(F.col(key).alias("__k"), at.alias("__t"), F.lit(1).alias("__kind"), sample.alias("__s"))
    probe = F.struct(*(F.col(c) for c in probes.columns))
    right = probes.select(F.col(key).alias("__k"), (F.col(time).cast("double") + F.lit(float(offset_s))).alias("__t"), F.lit(0).alias("__kind"), probe.alias("__p"))
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("__chunk", F.floor(F.col("__t") / F.lit(float(chunk_s))))
    by_chunk = Window.partitionBy("__k", "__chunk")
    # At equal times probes stand before samples, so the sample hit is the next one; the other way round it comes before the probe again.
    order_key = F.col("__s.o")
    before = F.last("__s", ignorenulls=True).over(by_chunk.orderBy("__t", "__kind", order_key).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__s", ignorenulls=True).over(by_chunk.orderBy(F.desc("__t"), F.desc("__kind"), order_key.desc()).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("__a", before).withColumn("__b", after).where("__kind = 0")
    # One row per chunk: its first and last sample, and those of the chunks around it.
    chunks = rows.groupBy("__k", "__chunk").agg(F.min("__s").alias("first"), F.max(F.when(F.col("__s").isNotNull(), F.struct(F.col("__s.t").alias("t"), (F.col("__s.o")).alias("o"), F.col("__s").alias("s")))).alias("last"))
    around = Window.partitionBy("__k").orderBy("__chunk")
    back = Window.partitionBy("__k").orderBy(F.desc("__chunk"))
    carried = chunks.select("__k", "__chunk", F.last("last.s", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.last("first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("__after"))
    joined = found.join(carried, ["__k", "__chunk"])
    a, b = F.coalesce("__a", "__before"), F.coalesce("__b", "__after")
    low, high = F.coalesce(a, b), F.coalesce(b, a)  # clamped at either end
    span = high["t"] - low["t"]
    share = (F.col("__t") - low["t"]) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    ends = a.isNull() | b.isNull()
    out = [F.when(ends, low[v]).otherwise(_lerp(low[v], high[v], share)).alias(v) for v in values]
    return joined.where(a.isNotNull() | b.isNotNull()).select("__p.*", *out)
