"""Alpha channel rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import INTERIOR_ALPHA, STRAY_ALPHA
from .stencil import any_in_window


def alpha_flags(df: DataFrame) -> DataFrame:
    """df plus `interior` (a >= 248, none lower around) and `stray` (a <= 2, none higher around)."""
    df = df.withColumns({"_low": F.col("a") < INTERIOR_ALPHA, "_seen": F.col("a") > STRAY_ALPHA})
    df = any_in_window(any_in_window(df, "_low", 1, "_lows"), "_seen", 1, "_seens")
    flags = {"interior": ~F.col("_low") & ~F.col("_lows"), "stray": ~F.col("_seen") & ~F.col("_seens")}
    return df.withColumns(flags).drop("_low", "_seen", "_lows", "_seens")


def apply_alpha(flagged: DataFrame, mode: str = "normalize") -> DataFrame:
    """Interior alpha to 255 (normalize only), stray alpha to 0 (every mode), and black where nothing is seen."""
    a = F.when(F.col("stray"), 0).when(F.col("interior") & F.lit(mode == "normalize"), 255).otherwise(F.col("a"))
    out = flagged.withColumn("a", a.cast("int"))
    return out.withColumns({c: F.when(F.col("a") == 0, 0).otherwise(F.col(c)).cast("int") for c in "rgb"})


def alpha_counters(flagged: DataFrame) -> DataFrame:
    """Per picture: interior pixels that aren't 255 and stray ones that aren't 0, by source alpha."""
    return flagged.groupBy("image_id").agg(
        F.count_if(F.col("interior") & (F.col("a") != 255)).alias("alpha_interior_snapped_px"),
        F.count_if(F.col("stray") & (F.col("a") != 0)).alias("alpha_stray_zeroed_px"),
    )
