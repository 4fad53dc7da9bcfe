"""Coordinate algebra for figures: crop, zoom, paste, downscale."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY
from ..storage import shuffled, with_facts
from .stencil import dims, with_dims


def crop(df: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The part of each picture in that window, clipped to the picture; empty windows give no rows."""
    x, y = max(0, int(x)), max(0, int(y))
    part = df.where((F.col("x") >= x) & (F.col("x") < x + int(w)) & (F.col("y") >= y) & (F.col("y") < y + int(h)))
    return part.withColumns({"x": (F.col("x") - x).cast("int"), "y": (F.col("y") - y).cast("int")})


def zoom(df: DataFrame, k: int) -> DataFrame:
    """Every pixel as a k x k square."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    wide = df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return wide.withColumns({"y": F.col("y") * k + F.col("_i"), "x": F.col("x") * k + F.col("_j")}).drop("_i", "_j")


def beside(left: DataFrame, right: DataFrame, gap: int = 12) -> DataFrame:
    """Two pictures side by side on white."""
    at = dims(left).select("image_id", (F.col("_w") + gap).alias("_dx"))
    moved = with_facts(right, at).withColumn("x", F.col("x") + F.col("_dx")).drop("_dx")
    return on_white(left.unionByName(moved))


def below(top: DataFrame, bottom: DataFrame, gap: int = 16) -> DataFrame:
    """Two pictures one above the other on white."""
    at = dims(top).select("image_id", (F.col("_h") + gap).alias("_dy"))
    moved = with_facts(bottom, at).withColumn("y", F.col("y") + F.col("_dy")).drop("_dy")
    return on_white(top.unionByName(moved))


def on_white(df: DataFrame) -> DataFrame:
    """A dense grid: places without a pixel are opaque white."""
    grid = dims(df).withColumn("y", F.explode(F.expr("sequence(0, _h - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, _w - 1)")))
    filled = grid.select(*KEY).join(shuffled(df.select(*KEY, *"rgba")), list(KEY), "left")
    return filled.select(*KEY, *(F.coalesce(c, F.lit(255)).cast("int").alias(c) for c in "rgba"))


def downscale(df: DataFrame, height: int, lobes: int = 3) -> DataFrame:
    """Opaque pictures reduced to at most that height by a separable Lanczos filter; smaller ones stay."""
    held = with_dims(df).withColumn("_s", F.least(F.lit(1.0), F.lit(float(height)) / F.col("_h")))
    for axis, n in (("x", "_w"), ("y", "_h")):
        other = "y" if axis == "x" else "x"
        m = F.greatest(F.lit(1), F.floor(F.col(n) * F.col("_s"))).cast("int")
        held = held.withColumn("_m", m).withColumn("_k", F.col(n) / F.col("_m"))
        lo, hi = (F.floor((F.col(axis) + 0.5 + sign * (F.col("_k") * lobes)) / F.col("_k") - 0.5).cast("int") for sign in (-1, 1))
        held = held.withColumn("_t", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi + 1, F.col("_m") - 1))))
        u = F.col(axis) + 0.5 - (F.col("_t") + 0.5) * F.col("_k")
        held = held.withColumn("_u", u / F.col("_k")).where(F.abs("_u") < lobes)
        sinc = lambda v: F.when(F.abs(v) < 1e-12, 1.0).otherwise(F.sin(v * math.pi) / (v * math.pi))
        held = held.withColumn("_wt", sinc(F.col("_u")) * sinc(F.col("_u") / lobes))
        keys = ["image_id", "_h", "_w", "_s", other, "_t"]
        held = held.groupBy(*keys).agg(*((F.sum(F.col(c) * F.col("_wt")) / F.sum("_wt")).alias(c) for c in "rgb")).withColumnRenamed("_t", axis)
    level = lambda c: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(255.0)).cast("int")
    return held.select(*KEY, *(level(c).alias(c) for c in "rgb"), F.lit(255).alias("a"))
