"""Run manifests, frame listings and layered settings."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, dataset_name string, crs struct<epsg:int,zone:int,hemisphere:string,derived_from:string>, stages array<struct<name:string,status:string,environment:string,wall_seconds:double,inputs_hash:string,params_hash:string,outputs_hash:string,degraded_reason:string,confidence:struct<summary:double>,metrics:map<string,string>>>, _corrupt_record string"


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per manifest; unreadable ones have error set and nothing else."""
    docs = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(pattern)
    return docs.withColumn("path", F.col("_metadata.file_path")).withColumn("error", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def stage_records(runs: DataFrame) -> DataFrame:
    """One row per run and stage; a run without stages keeps one row with a null stage."""
    s = runs.where(~F.col("error")).select(F.col("run_id").alias("run"), F.explode_outer("stages").alias("s"))
    return s.select("run", F.col("s.name").alias("stage"), F.col("s.status").alias("status"), F.col("s.environment").alias("environment"), F.col("s.wall_seconds").alias("wall"), F.col("s.inputs_hash").alias("inputs_hash"), F.col("s.params_hash").alias("params_hash"), F.col("s.outputs_hash").alias("outputs_hash"), F.col("s.degraded_reason").alias("degraded_reason"), F.col("s.confidence.summary").alias("confidence"), F.col("s.metrics").alias("metrics"))


def register_inputs(spark: SparkSession, path: str, role: str, required: bool = True) -> DataFrame:
    """(path, role, sha256, bytes, present) of input files; none at all is an error if required."""
    from ..operators.governance import hash_files

    found = hash_files(spark, path).select("path", F.lit(role).alias("role"), "sha256", F.col("length").alias("bytes"), F.lit(True).alias("present"))
    if required and found.isEmpty():
        raise ValueError(f"missing input: {path}")
    return found


def frame_rows(video: DataFrame, target_fps: float, most: int = 0) -> DataFrame:
    """(path, index, src_index, t) of the frames taken from each video (path, fps, n_frames)."""
    from ..operators.ordered import frame_stride

    stride = frame_stride(F.col("fps"), F.lit(float(target_fps)))
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)
    rows = video.where("n_frames > 0").select("path", fps.alias("fps"), stride.alias("stride"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1, stride)).alias("src_index"))
    rows = rows.select("path", (F.col("src_index") / F.col("stride")).cast("long").alias("index"), "src_index", F.bround(F.col("src_index") / F.col("fps"), 4).alias("t"))
    return rows.where(F.col("index") < most) if most > 0 else rows


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files by path, with bytes; decoding is left to whoever has a codec."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(path).select("path", "length", "content")


def gps_of_exif(d: Mapping[str, str] | None = None) -> tuple[Column, Column, Column]:
    """(lat, lon, alt) columns of EXIF GPS columns: lat_dms, lat_ref, lon_dms, lon_ref, alt, alt_ref."""
    from ..functions.geo import dms_to_degrees

    names = {k: k for k in ("lat_dms", "lat_ref", "lon_dms", "lon_ref", "alt", "alt_ref")} | dict(d or {})
    c = {k: F.col(v) for k, v in names.items()}
    lat = dms_to_degrees(*(c["lat_dms"][i] for i in range(3)), F.coalesce(c["lat_ref"], F.lit("N")))
    lon = dms_to_degrees(*(c["lon_dms"][i] for i in range(3)), F.coalesce(c["lon_ref"], F.lit("E")))
    alt = F.coalesce(c["alt"], F.lit(0.0)) * F.when(F.coalesce(c["alt_ref"], F.lit(0)) == 1, -1).otherwise(1)
    return lat, lon, alt


# Settings: on the driver


def merged(base: Mapping, over: Mapping) -> dict:
    """base with over laid upon it, tables within tables."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def settings(layers: list[Mapping], prefix: str = "SKYLOOM__", environment: Mapping[str, str] | None = None, sets: list[str] = ()) -> dict:
    """Layers from weak to strong, then variables PREFIXa__b=v, then "a.b=v" items.  Unknown top-level tables are an error once the first layer has any."""
    out: dict = {}
    for layer in layers:
        if out and (odd := set(layer) - set(out)):
            raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
        out = merged(out, layer)
    items = [(k.removeprefix(prefix).lower().split("__"), v) for k, v in sorted((environment if environment is not None else os.environ).items()) if k.startswith(prefix)]
    for item in sets:
        name, sign, value = item.partition("=")
        if not sign:
            raise ValueError(f"not of the form a.b=value: {item}")
        items.append((name.split("."), value))
    for path, value in items:
        here = out
        for part in path[:-1]:
            here = here.setdefault(part, {})
        here[path[-1]] = _value(value)
    return out
