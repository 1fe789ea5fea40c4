"""Frame quality from pixel arrays (row-major), and masks from detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import CLIP_HIGH, CLIP_LOW, accept_frame, box_pixel


def laplacian_values(pixels: Column, width: int, height: int) -> Column:
    """4-neighbour Laplacian of the interior of a gray image."""
    if width < 3 or height < 3:
        raise ValueError("image too small for a Laplacian")
    inner = F.sequence(F.lit(0), F.lit((width - 2) * (height - 2) - 1))

    def value(i: Column) -> Column:
        at = (F.floor(i / (width - 2)) + 1).cast("int") * width + i % (width - 2) + 1
        return F.get(pixels, at - 1) + F.get(pixels, at + 1) + F.get(pixels, at - width) + F.get(pixels, at + width) - 4 * F.get(pixels, at)

    return F.transform(inner, value)


def variance_of_laplacian(pixels: Column, width: int, height: int) -> Column:
    """Population variance of the Laplacian; in one row, without a shuffle."""
    n = float((width - 2) * (height - 2))
    values = laplacian_values(pixels, width, height)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    # Two passes over the row: the mean is taken off first, so that large gray values cost no precision.
    return F.aggregate(F.transform(F.array(values), lambda v: F.struct(v.alias("v"), mean(v).alias("m"))), F.lit(0.0), lambda s, p: s + F.aggregate(p["v"], F.lit(0.0), lambda t, x: t + (x - p["m"]) * (x - p["m"]))) / n


def exposure(pixels: Column) -> tuple[Column, Column]:
    """Shares of pixels that are crushed, and blown out."""
    n = F.size(pixels).cast("double")
    return F.size(F.filter(pixels, lambda v: v <= CLIP_LOW)) / n, F.size(F.filter(pixels, lambda v: v >= CLIP_HIGH)) / n


def frame_quality(frames: DataFrame, pixels: str, width: int, height: int, min_varlap: float, max_low: float, max_high: float) -> DataFrame:
    """frames with varlap, clip_low, clip_high and accepted."""
    low, high = exposure(F.col(pixels))
    scored = frames.withColumn("varlap", variance_of_laplacian(F.col(pixels), width, height)).withColumn("clip_low", low).withColumn("clip_high", high)
    return scored.withColumn("accepted", accept_frame(F.col("varlap"), F.col("clip_low"), F.col("clip_high"), min_varlap, max_low, max_high))


#: Pixels of a mask's row that one long holds.
WORD = 64


def mask_bits(detections: DataFrame, labels: DataFrame, least_score: float, dilation: int = 0) -> DataFrame:
    """(frame, v, word, bits): pixels word * WORD and on of row v covered by wanted detections' boxes, grown by the dilation, as bits from the lowest.

    detections: frame, label, score, x0, y0, x1, y1, width, height; labels:
    label, small.  Growing boxes by half the (odd) structuring element equals
    dilating their union by it.  A box is a few longs for each of its rows, which are
    united where they are read.
    """
    r, ahead = dilation // 2, max(0, dilation - 1 - dilation // 2)
    wanted = detections.where(F.col("score") >= least_score).join(labels, "label", "left_semi")
    w, h = F.col("width"), F.col("height")
    x0, x1, y0, y1 = box_pixel(F.col("x0"), w), box_pixel(F.col("x1"), w), box_pixel(F.col("y0"), h), box_pixel(F.col("y1"), h)
    full = wanted.where((x1 > x0) & (y1 > y0))
    grown = full.select("frame", F.greatest(F.lit(0), x0 - ahead).cast("int").alias("left"), F.least(w - 1, x1 - 1 + r).cast("int").alias("right"), F.greatest(F.lit(0), y0 - ahead).cast("int").alias("top"), F.least(h - 1, y1 - 1 + r).cast("int").alias("bottom"))
    words = grown.withColumn("word", F.explode(F.sequence(F.floor(F.col("left") / WORD).cast("int"), F.floor(F.col("right") / WORD).cast("int"))))
    first, last = F.greatest(F.lit(0), F.col("left") - F.col("word") * WORD), F.least(F.lit(WORD - 1), F.col("right") - F.col("word") * WORD)
    ones = F.lit(-1).cast("long")
    bits = F.call_function("shiftleft", ones, first).bitwiseAND(F.call_function("shiftrightunsigned", ones, F.lit(WORD - 1) - last))
    rows = words.select("frame", "word", bits.alias("bits"), F.explode(F.sequence("top", "bottom")).alias("v"))
    return rows.groupBy("frame", "v", "word").agg(F.bit_or("bits").alias("bits"))


def mask_pixels(detections: DataFrame, labels: DataFrame, least_score: float, dilation: int = 0) -> DataFrame:
    """(frame, u, v): the distinct pixels of ``mask_bits``."""
    single = mask_bits(detections, labels, least_score, dilation).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).where(F.bit_get("bits", F.col("u")) == 1)
    return single.select("frame", (F.col("word") * WORD + F.col("u")).alias("u"), "v")


def mask_fraction(mask: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, dynamic_frac) of masks as pixels or as bits."""
    n = F.sum(F.bit_count("bits")) if "bits" in mask.columns else F.count(F.lit(1))
    return mask.groupBy("frame").agg((n / F.lit(float(width * height))).alias("dynamic_frac"))


def largest_model(models: DataFrame, run: str, size: str, name: str) -> DataFrame:
    """The reconstruction with the most registered images of each run; the first named wins a tie."""
    return models.groupBy(run).agg(F.max_by(name, F.struct(F.col(size), -F.col("ord"))).alias(name), F.max(size).alias(size))


def painter_order(items: DataFrame, scene: str, depth: str) -> DataFrame:
    """Rank from far to near."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(scene).orderBy(F.desc(depth), "item")))
