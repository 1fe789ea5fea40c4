"""Colours, gates, confidences, rounding and other scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights, exposure limits, confidence cap of each fallback level, label expansion.
LUMA = {"b": 0.114, "g": 0.587, "r": 0.299}
CLIP_LOW, CLIP_HIGH = 5, 250
LEVEL_CAPS = {0: 1.00, 1: 0.95, 2: 0.85, 3: 0.70, 4: 0.50, 5: 0.35, 6: 0.20}
LEVEL_LABELS = {0: "full quality", 1: "full method (local)", 2: "reduced settings", 3: "alternative method", 4: "prior-only geometry", 5: "near-passthrough", 6: "minimal viable"}
LABEL_EXPANSION = {
    "animal": ("bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe"),
    "vehicle": ("car", "truck", "bus", "motorcycle", "bicycle", "train", "boat", "airplane"),
}


def to_gray(b: Column, g: Column, r: Column) -> Column:
    return LUMA["b"] * b + LUMA["g"] * g + LUMA["r"] * r


def accept_frame(varlap: Column, low: Column, high: Column, min_varlap: float, max_low: float, max_high: float) -> Column:
    """All limits are inclusive."""
    return (varlap >= min_varlap) & (low <= max_low) & (high <= max_high)


def color_scale(largest: Column) -> Column:
    """Factor that brings colours to 0..255, told from the largest value of the whole table."""
    return F.when(largest <= 1.0 + 1e-6, F.lit(255.0)).otherwise(F.lit(1.0))


def to_byte(value: Column) -> Column:
    """Clipped to 0..255 and cut off, not rounded."""
    return F.when(value.isNotNull(), F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), value)))).cast("short")


def widened_color(value: Column, largest: Column) -> Column:
    """16-bit colour of LAS: 8-bit tables are shifted up."""
    return F.when(largest <= 255, F.shiftleft(value.cast("int"), 8)).otherwise(value.cast("int"))


def box_pixel(value: Column, size: Column) -> Column:
    """Box corner cut to an integer and kept within the image."""
    return F.least(size, F.greatest(F.lit(0), value.cast("int")))


def expanded_labels(classes: Column) -> Column:
    """The classes and what they stand for, each once, in order."""
    table = F.create_map(*(x for k, v in LABEL_EXPANSION.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    more = F.transform(classes, lambda c: F.coalesce(F.try_element_at(table, c), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(classes, F.flatten(more))))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def share(part: Column, whole: Column) -> Column:
    """min(1, part / whole); 0 without a whole."""
    ratio = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return F.least(F.lit(1.0), ratio)


def fit_confidence(sigma: Column, rmse: Column) -> Column:
    """How far a fit's error stays within its expected error."""
    ratio = sigma / (rmse + 1e-6)
    return F.when(ratio.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)))


def without(fraction: Column) -> Column:
    """1 - min(1, fraction)"""
    return F.when(fraction.isNotNull(), 1 - F.least(F.lit(1.0), fraction))


def blend(measured: Column, cap: Column) -> Column:
    """min(measured, cap) to four places; null stays null; values outside 0..1 are an error."""
    wrong = F.raise_error(F.concat(F.lit("confidence outside 0..1: "), measured.cast("string"))).cast("double")
    return F.when(measured.isNull(), F.lit(None).cast("double")).when(measured.between(0.0, 1.0), F.bround(F.least(measured, cap), 4)).otherwise(wrong)


def level_cap(level: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in LEVEL_CAPS.items():
        out = F.when(level == k, F.lit(v)).otherwise(out)
    return out


def level_label(level: Column) -> Column:
    out = F.concat(F.lit("L"), level.cast("string"))
    for k, v in LEVEL_LABELS.items():
        out = F.when(level == k, F.lit(v)).otherwise(out)
    return out


def rmse3(a: list[Column], b: list[Column]) -> Column:
    """Aggregate: root of the mean squared distance of 3-D rows."""
    squares = sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))
    return F.sqrt(F.avg(squares))
