"""Keyframes and per-minute track statistics over a stream of positions.

Batch and stream give the same keyframes for positions that arrive in order of
time within a track; a late position, older than the last one seen, is not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import EARTH_RADIUS_M


def _distance(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(a)))


def live_keyframes(positions: DataFrame, least_m: float) -> DataFrame:
    """Stream of (track_id, t, lat, lon) to the positions at which the distance since the last keyframe reaches least_m."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if last is None:
                acc, take = 0.0, True
            elif r.t < last[0]:
                continue
            else:
                acc = last[3] + _distance(last[1], last[2], r.lat, r.lon)
                take = acc >= least_m
            if take:
                acc = 0.0
                out.append((key[0], r.t, r.lat, r.lon))
            last = (float(r.t), float(r.lat), float(r.lon), float(acc))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["track_id", "t", "lat", "lon"])

    kind = positions.schema["track_id"].dataType.simpleString()
    return positions.groupBy("track_id").applyInPandasWithState(update, f"track_id {kind}, t double, lat double, lon double", "t double, lat double, lon double, acc double", "append", GroupStateTimeout.NoTimeout)


def live_minutes(positions: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Counts and height range of each track and window; windows close when the watermark passes them."""
    return positions.withWatermark(time, late).groupBy("track_id", F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.min("alt").alias("alt_min"), F.max("alt").alias("alt_max"))
