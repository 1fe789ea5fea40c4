"""Mission-shaped projections of the star-schema tables, for queries and benchmarks.

Each has a DataFrame form and the same thing as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.raster import Extent

#: Fixed bounds and resolution of the stand-in cloud.
CLOUD = Extent(0.0, 0.0, 50.0, 40.0, 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch of a timestamp without a zone, read as UTC whatever the session's zone is."""
    return F.unix_micros(F.to_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of one flight per user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")
    first = e.groupBy("user_id").agg(F.min_by("ts", F.struct("ts", "event_id")).alias("ts0"))
    t = (micros("ts") - micros("ts0")) / 1e6
    ord_ = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.join(first, "user_id").select(F.col("user_id").alias("track_id"), "event_id", ord_.cast("long").alias("ord"), t.alias("t"), (F.lit(12.9) + F.col("value") / 1e4).alias("lat"), (F.lit(77.5) + (F.col("event_id") % 97) / 1e3).alias("lon"), (F.lit(900.0) + F.col("value")).alias("alt"), F.when(F.col("event_type") != "error", F.col("value") % 360).alias("yaw"))


TRACK = """e0 AS (SELECT user_id, event_id, ts, value, event_type, first_value(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ts0,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events),
track AS (SELECT user_id AS track_id, event_id, ord, (epoch_us(ts) - epoch_us(ts0)) / 1e6 AS t, 129e-1 + value / 1e4 AS lat,
  775e-1 + (event_id % 97) / 1e3 AS lon, 900e0 + value AS alt, CASE WHEN event_type <> 'error' THEN value % 360 END AS yaw FROM e0)"""


def probe_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every six hours from a day before a track's first position to 31 days after it."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id")).distinct()
    return users.select("track_id", F.explode(F.sequence(F.lit(-4), F.lit(124))).alias("i")).select("track_id", "i", (F.col("i") * 21600.0).alias("t"))


PROBES = "probes AS (SELECT track_id, i::INT AS i, i * 21600e0 AS t FROM (SELECT DISTINCT user_id AS track_id FROM events), unnest(range(-4, 125)) AS g(i))"


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(((F.col("l_orderkey") % 500) / 1e1).alias("x"), ((F.col("l_partkey") % 400) / 1e1).alias("y"), (F.col("l_extendedprice") / 1e3).alias("z"), (F.col("l_quantity") * 5).cast("int").alias("r"), (F.col("l_partkey") % 256).cast("int").alias("g"), (F.col("l_suppkey") % 256).cast("int").alias("b"))


POINTS = "cloud AS (SELECT (l_orderkey % 500) / 1e1 AS x, (l_partkey % 400) / 1e1 AS y, l_extendedprice / 1e3 AS z, (l_quantity * 5)::INT AS r, (l_partkey % 256)::INT AS g, (l_suppkey % 256)::INT AS b FROM lineitem)"
CELLS = "cells AS (SELECT *, floor((40e0 - y) / 1e0)::INT AS \"row\", floor((x - 0e0) / 1e0)::INT AS col FROM cloud), inside AS (SELECT * FROM cells WHERE \"row\" BETWEEN 0 AND 39 AND col BETWEEN 0 AND 49)"


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray images."""
    pixel = F.transform("embedding", lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.lit(128.0) + F.lit(600.0) * e.cast("double"))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), pixel.alias("pixels"))


PATCHES = "patch AS (SELECT vec_id AS frame, list_transform(embedding, lambda e: least(255e0, greatest(0e0, 128e0 + 600e0 * e::DOUBLE))) AS pixels FROM embeddings)"


def stage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run and stage (the latest order wins), as run records."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "degraded").otherwise("done")
    return o.select(F.col("o_custkey").alias("run"), F.concat(F.lit("s"), (F.col("o_orderkey") % 11).cast("string")).alias("stage"), status.alias("status"), (F.col("o_totalprice") / 1e3).alias("wall"), F.when(F.col("o_orderstatus") == "P", F.lit("fallback")).alias("degraded_reason"), F.col("o_orderkey").alias("version"))


RECORDS = "rec AS (SELECT o_custkey AS run, 's' || (o_orderkey % 11) AS stage, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'degraded' ELSE 'done' END AS status, o_totalprice / 1e3 AS wall, CASE WHEN o_orderstatus = 'P' THEN 'fallback' END AS degraded_reason, o_orderkey AS version FROM orders)"

RUN_STAGES = tuple(f"s{i}" for i in range(11))
