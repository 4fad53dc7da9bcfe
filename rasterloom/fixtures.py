"""Synthetic pictures derived from the driver's `orders` table by integer arithmetic; they test meaning, not picture quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), cents.alias("c"))


def paint(rows: DataFrame, image: Column, grain: bool = True, gap: bool = True) -> DataFrame:
    """Pixels from k' (y, x) and c: blocks of 20 x 20, grain of two levels, a transparent margin with an alpha ramp."""
    g = F.col("c") % 5 - 2 if grain else F.lit(0)
    blk = F.expr("y div 20") * 7 + F.expr("x div 20")
    hole = (F.col("y") < 4) | (F.col("x") < 4)
    shade = lambda base, step, span: F.when(hole, 255).otherwise(blk * step % span + base + g).cast("int")
    edge = (F.col("y") == 4) | (F.col("x") == 4)
    a = F.when(hole, F.col("c") % 3).when(edge, 128).when((F.col("y") == 5) & (F.col("x") % 10 == 0) & F.lit(gap), 20).otherwise(253)
    return rows.select(
        image.alias("image_id"), "y", "x", shade(40, 37, 180).alias("r"), shade(60, 53, 160).alias("g"), shade(50, 71, 170).alias("b"), a.cast("int").alias("a")
    )


def raster(spark: SparkSession, sf_dir: str, grain: bool = True) -> DataFrame:
    """One picture, 100 wide. grain=False: the same without grain, an after picture in closed form."""
    at = _orders(spark, sf_dir).select(F.expr("cast(k div 100 as int)").alias("y"), F.expr("cast(k % 100 as int)").alias("x"), "c")
    return paint(at, F.lit("orders"), grain)


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 50 x 50, without the low-alpha pixels of row 5."""
    at = _orders(spark, sf_dir).select(F.expr("k div 2500").alias("i"), F.expr("cast(k % 2500 div 50 as int)").alias("y"), F.expr("cast(k % 50 as int)").alias("x"), "c")
    return paint(at, F.concat(F.lit("img"), F.col("i").cast("string")), gap=False)


def ragged_mask() -> Column:
    """A mask of many small regions on the raster."""
    return (F.col("a") >= 24) & ((F.col("r") * 7 + F.col("g") * 2 + F.col("b")) % 11 > 4)


def block_label() -> Column:
    return (F.expr("y div 20") * 7 + F.expr("x div 20")).cast("int")
