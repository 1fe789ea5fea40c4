"""Flight telemetry: subtitle tracks, CSV logs, EXIF records, MAVLink messages.

Every reader gives the TELEMETRY schema; track_id is the file, ord the order
within it, and t is rebased to the track's first row in order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import rebase

OPTIONAL = ("rel_alt", "yaw", "pitch", "roll")
COLUMNS = ("track_id", "ord", "t", "lat", "lon", "alt", *OPTIONAL)

#: Stands between the start and the end of a block's time.
ARROW = "-->"
#: A name and its number, wherever they stand in a block.
PAIR = r"(\w+)\s*:\s*([-+]?\d+(?:\.\d+)?)"
#: What the older layout puts between brackets behind its name.
TRIPLE = r"(?i)gps\s*\(([^()]*)\)"
#: Prefix of the gimbal's angles, which stand for the plain ones.
GIMBAL = "gb_"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def named_numbers(text: Column) -> Column:
    """The "name: number" pairs of a block as an array of (name in lower case, number), in order."""
    names, numbers = F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2))
    return F.arrays_zip(F.transform(names, F.lower).alias("name"), F.transform(numbers, lambda n: n.try_cast("double")).alias("number"))


def _value(pairs: str, *names: str) -> Column:
    """The number of the first pair with one of the names."""
    return F.get(F.filter(F.col(pairs), lambda p: p["name"].isin(*names)), F.lit(0))["number"]


def timecode_seconds(text: Column) -> Column:
    """HH:MM:SS,mmm before the arrow; a short fraction is filled up on the right ("5" is half a second).  Null without such a time."""
    line = F.trim(F.substring_index(F.substring_index(text, ARROW, 1), "\n", -1))
    # The last word before the arrow; hours, minutes and seconds have two digits each.
    clock = F.split(F.replace(F.substring_index(line, " ", -1), F.lit(","), F.lit(".")), ":")
    seconds = F.split(F.get(clock, F.lit(2)), r"\.")
    hours, whole, fraction = F.right(F.get(clock, F.lit(0)), F.lit(2)), F.get(seconds, F.lit(0)), F.get(seconds, F.lit(1))
    digits = lambda c, least, most: c.isNotNull() & F.length(c).between(least, most) & (F.translate(c, "0123456789", "") == "")
    right = F.contains(text, F.lit(ARROW)) & (F.size(clock) == 3) & (F.size(seconds) == 2) & digits(hours, 2, 2) & digits(F.get(clock, F.lit(1)), 2, 2) & digits(whole, 2, 2) & digits(fraction, 1, 3)
    return F.when(right, hours.try_cast("double") * 3600 + F.get(clock, F.lit(1)).try_cast("double") * 60 + whole.try_cast("double") + F.rpad(fraction, 3, "0").try_cast("double") / 1000)


def parse_srt(texts: DataFrame, track: str = "track_id", text: str = "text") -> DataFrame:
    """Whole subtitle texts to telemetry; blocks without time or position are dropped."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"\A\s+|\s+\z", ""))
    blocks = texts.select(F.col(track).cast("string").alias("track_id"), F.posexplode(F.split(body, r"\n\s*\n")).alias("ord", "block"))
    triple = F.transform(F.split(_group(F.col("block"), TRIPLE), ","), lambda v: F.trim(v).try_cast("double"))
    told = blocks.select("track_id", "ord", timecode_seconds(F.col("block")).alias("t"), named_numbers(F.col("block")).alias("pairs"), triple.alias("triple"))
    # The older layout: longitude, latitude, height in brackets, and a barometer beside them.
    old = (F.size("triple") == 3) & F.get("triple", F.lit(0)).isNotNull() & F.get("triple", F.lit(1)).isNotNull() & F.get("triple", F.lit(2)).isNotNull()
    old = F.coalesce(old, F.lit(False))
    rel = F.when(~old, _value("pairs", "rel_alt"))
    lat = F.when(old, F.get("triple", F.lit(1))).otherwise(_value("pairs", "latitude"))
    lon = F.when(old, F.get("triple", F.lit(0))).otherwise(_value("pairs", "longitude"))
    alt = F.when(old, F.coalesce(_value("pairs", "barometer"), F.get("triple", F.lit(2)))).otherwise(F.coalesce(_value("pairs", "abs_alt"), rel, F.lit(0.0)))
    rows = told.select("track_id", F.col("ord").cast("long").alias("ord"), "t", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"), rel.alias("rel_alt"), *(_value("pairs", c, GIMBAL + c).alias(c) for c in ("yaw", "pitch", "roll")))
    return rebase(rows.where("t is not null and lat is not null and lon is not null"), "track_id", ["ord"]).select(*COLUMNS)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("track_id"), F.col("value").alias("text")))


def time_cell(cell: Column) -> Column:
    """Seconds, or an ISO-8601 time as epoch seconds; anything else is an error."""
    iso = F.unix_micros(F.try_to_timestamp(cell)) / 1e6
    return F.coalesce(F.trim(cell).try_cast("double"), iso, F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(cell, F.lit("null")))).cast("double"))


def _cell(df: DataFrame, name: str | int | None) -> Column | None:
    """A column by name, or by index from 0."""
    if name is None:
        return None
    if isinstance(name, int) or str(name).isdigit():
        if int(name) >= len(df.columns):
            raise ValueError(f"no column number {name}")
        return F.col(f"`{df.columns[int(name)]}`")
    if name not in df.columns:
        raise ValueError(f"missing column: {name}")
    return F.col(f"`{name}`")


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str | int | None]) -> DataFrame:
    """A CSV log with a header; columns maps t, lat, lon, alt and the optional fields to names or indices.

    An empty altitude is 0; a file is read by one task, because its order counts.
    """
    lines = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).csv(path)  # so files are never split
    get = {k: _cell(lines, columns.get(k)) for k in ("t", "lat", "lon", "alt", *OPTIONAL)}
    for k in ("t", "lat", "lon"):
        if get[k] is None:
            raise ValueError(f"no column given for {k}")
    value = lambda k: F.lit(None).cast("double") if get[k] is None else F.nullif(F.trim(get[k]), F.lit("")).cast("double")
    rows = lines.select(F.col("_metadata.file_path").alias("track_id"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("ord"), time_cell(get["t"]).alias("t"), value("lat").alias("lat"), value("lon").alias("lon"), F.coalesce(value("alt"), F.lit(0.0)).alias("alt"), *(value(k).alias(k) for k in OPTIONAL))
    return rebase(rows, "track_id", ["ord"]).select(*COLUMNS)


def read_exif(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of records as exiftool writes them; records without position are skipped."""
    schema = "array<struct<GPSLatitude:double,GPSLongitude:double,GPSAltitude:double,SampleTime:double>>"
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("track_id"), F.posexplode(F.from_json("value", schema)).alias("ord", "r"))
    null = F.lit(None).cast("double")
    rows = docs.where("r.GPSLatitude is not null and r.GPSLongitude is not null").select("track_id", F.col("ord").cast("long").alias("ord"), F.coalesce(F.col("r.SampleTime"), F.col("ord").cast("double")).alias("t"), F.col("r.GPSLatitude").alias("lat"), F.col("r.GPSLongitude").alias("lon"), F.coalesce("r.GPSAltitude", F.lit(0.0)).alias("alt"), *(null.alias(c) for c in OPTIONAL))
    return rebase(rows, "track_id", ["ord"]).select(*COLUMNS)


def decode_mavlink(messages: DataFrame) -> DataFrame:
    """Decoded MAVLink messages (track_id, ord, type, t, lat, lon, alt, relative_alt, hdg) to telemetry.

    Positions are scaled from integers; raw GPS fixes count only until the
    first fused position of the track; rows are sorted by time.
    """
    first = messages.where("type = 'GLOBAL_POSITION_INT'").groupBy("track_id").agg(F.min("ord").alias("__first"))
    used = messages.join(first, "track_id", "left").where("type = 'GLOBAL_POSITION_INT' or (type = 'GPS_RAW_INT' and (__first is null or ord < __first))")
    fused = F.col("type") == "GLOBAL_POSITION_INT"
    null = F.lit(None).cast("double")
    yaw = F.when(fused & F.col("hdg").isNotNull() & (F.col("hdg") != 65535), F.col("hdg") / 100.0)
    rows = used.select(F.col("track_id").cast("string").alias("track_id"), F.col("ord").cast("long").alias("ord"), F.col("t").cast("double").alias("t"), (F.col("lat") / 1e7).alias("lat"), (F.col("lon") / 1e7).alias("lon"), (F.col("alt") / 1e3).alias("alt"), F.when(fused, F.col("relative_alt") / 1e3).alias("rel_alt"), yaw.alias("yaw"), null.alias("pitch"), null.alias("roll"))
    return rebase(rows, "track_id", ["t", "ord"]).select(*COLUMNS)


def read_mavlink(spark: SparkSession, path: str, **options) -> DataFrame:
    """Binary logs, read in ranges (options: chunk, stamped), or, of a path that ends in .parquet, messages decoded beforehand."""
    from .mavlink import MavlinkDataSource

    if path.rstrip("/").endswith(".parquet"):
        return decode_mavlink(spark.read.parquet(path))
    spark.dataSource.register(MavlinkDataSource)
    return decode_mavlink(spark.read.format("mavlink").options(**{k: str(v) for k, v in options.items()}).load(path))


READERS: dict[str, Callable[..., DataFrame]] = {"dji_srt": read_srt, "csv": read_csv, "exif": read_exif, "mavlink": read_mavlink}


def read_telemetry(spark: SparkSession, format: str, path: str, **options) -> DataFrame:
    """Telemetry of a known format; an unknown one, or no path, is an error (as is a missing file, when Spark lists it)."""
    if not path:
        raise ValueError("no telemetry path")
    if format not in READERS:
        raise ValueError(f"unknown telemetry format: {format}")
    return READERS[format](spark, path, **options)


def require_samples(telemetry: DataFrame) -> DataFrame:
    """The same rows; an error if there are none."""
    if telemetry.isEmpty():
        raise ValueError("no position samples")
    return telemetry


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Check-points (lat, lon, alt) with the usual other names; malformed rows are skipped."""
    lines = spark.read.option("header", True).csv(path)
    names = {"lat": ("lat", "latitude"), "lon": ("lon", "longitude"), "alt": ("alt", "altitude", "abs_alt")}
    cells = {k: [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in v if c in lines.columns] for k, v in names.items()}
    if not all(cells.values()):
        return spark.createDataFrame([], "lat double, lon double, alt double")
    return lines.select(*(F.coalesce(*v).try_cast("double").alias(k) for k, v in cells.items())).where("lat is not null and lon is not null and alt is not null")
