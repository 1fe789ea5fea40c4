"""Text products: subtitle tracks, telemetry JSON, OBJ meshes, reports."""

from __future__ import annotations

import html
import json
import os
import tempfile
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def srt_timecode(t: Column) -> Column:
    ms = F.round(F.greatest(F.lit(0.0), t) * 1000).cast("long")
    part = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3_600_000), 2), F.lit(":"), part(F.floor(ms / 60_000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit(","), part(ms % 1000, 3))


def srt_block(number: Column, start: Column, end: Column, lat: Column, lon: Column, abs_alt: Column, rel_alt: Column | None = None, **angles: Column) -> Column:
    """One subtitle block in the bracketed layout; absent optional values are left out."""
    rel = F.lit("") if rel_alt is None else F.coalesce(F.format_string("rel_alt: %.1f ", rel_alt), F.lit(""))
    rel = rel if rel_alt is None else F.when(rel_alt.isNull(), F.lit("")).otherwise(rel)
    fields = [F.format_string("[latitude: %.8f]", lat), F.format_string("[longitude: %.8f]", lon), F.concat(F.lit("["), rel, F.format_string("abs_alt: %.1f]", abs_alt))]
    fields += [F.when(v.isNotNull(), F.format_string(f"[{k}: %.1f]", v)) for k, v in angles.items()]
    return F.concat_ws("\n", number.cast("string"), F.concat(srt_timecode(start), F.lit(" --> "), srt_timecode(end)), F.concat_ws(" ", *fields), F.lit(""))


def srt_text(samples: DataFrame, key: str, order: str, fps: float) -> DataFrame:
    """(key, text): the whole subtitle track of each series (lat, lon, alt, rel_alt, yaw, pitch, roll)."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = samples.withColumn("__i", i)
    block = srt_block(F.col("__i") + 1, F.col("__i") / fps, (F.col("__i") + 1) / fps, F.col("lat"), F.col("lon"), F.col("alt"), F.col("rel_alt"), yaw=F.col("yaw"), pitch=F.col("pitch"), roll=F.col("roll"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", block.alias("b")))), lambda s: s["b"]), "\n").alias("text"))


def telemetry_json(telemetry: DataFrame) -> DataFrame:
    """One JSON object per sample: t to three places, absent fields left out."""
    row = F.struct("track_id", F.bround("t", 3).alias("t"), "lat", "lon", "alt", "rel_alt", "yaw", "pitch", "roll")
    return telemetry.select(F.to_json(row).alias("value"))


def write_telemetry(telemetry: DataFrame, path: str) -> None:
    telemetry_json(telemetry).write.mode("overwrite").text(path)


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(ord, value): lines of an OBJ mesh; vertices are renumbered from 1 in their order."""
    from pyspark.sql import Window

    # Dense numbers without one window over all: counts of the blocks before, and the rank within a block.
    block = F.floor(F.col("vertex") / 65_536)
    marked = vertices.withColumn("__b", block)
    sizes = marked.groupBy("__b").count()
    before = sizes.withColumn("__o", F.coalesce(F.sum("count").over(Window.partitionBy(F.floor(F.col("__b") / (1 << 30))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = marked.join(before, "__b").withColumn("n", F.col("__o") + F.row_number().over(Window.partitionBy("__b").orderBy("vertex")))
    lines = numbered.select(F.lit(0).alias("kind"), F.col("n").alias("ord"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("value"))
    number = numbered.select("vertex", "n")
    out = faces.withColumn("__f", F.monotonically_increasing_id())
    for c in "abc":
        out = out.join(number.select(F.col("vertex").alias(c), F.col("n").alias(f"n{c}")), c)
    return lines.unionByName(out.select(F.lit(1).alias("kind"), F.col("__f").alias("ord"), F.format_string("f %d %d %d", "na", "nb", "nc").alias("value")))


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """A folder of text parts that, joined in order of their names, is the mesh."""
    obj_lines(vertices, faces).orderBy("kind", "ord").select("value").write.mode("overwrite").text(path)


def write_json(value: object, path: str) -> None:
    """A small document, written beside and moved into place, so that readers see the old or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)
    os.replace(name, path)


def report_html(title: str, facts: Mapping[str, object], stages: Iterable[Mapping[str, object]]) -> str:
    """A page with a run's facts and its stages; all values are escaped."""
    esc = lambda v: html.escape("" if v is None else str(v))
    rows = list(stages)
    head = list(dict.fromkeys(k for r in rows for k in r))
    top = "".join(f"<dt>{esc(k)}</dt><dd>{esc(v)}</dd>" for k, v in facts.items())
    table = "".join("<tr>" + "".join(f"<td>{esc(r.get(k))}</td>" for k in head) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{esc(title)}</title></head><body><h1>{esc(title)}</h1><dl>{top}</dl><table><tr>{''.join(f'<th>{esc(k)}</th>' for k in head)}</tr>{table}</table></body></html>"
