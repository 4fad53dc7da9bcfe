"""Pixel rows dealt to parts of a picture (bands of rows, or tiles), with the pixels around them that an operator needs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _parts(c: str, halo: int, size: int):
    return F.explode(F.expr(f"sequence(cast(floor(({c} - {halo}) / {size}) as int), cast(floor(({c} + {halo}) / {size}) as int))"))


def dealt_bands(df: DataFrame, halo: int, rows: int, out: str = "band") -> DataFrame:
    """df with the number of each band of `rows` rows that a pixel is in or within `halo` rows of; bands outside the picture have only such pixels."""
    return df.withColumn(out, _parts("y", halo, rows))


def dealt_tiles(df: DataFrame, halo: int, rows: int, cols: int) -> DataFrame:
    """The same for tiles, numbered ty, tx."""
    return df.withColumn("ty", _parts("y", halo, rows)).withColumn("tx", _parts("x", halo, cols))


def plane(part: pd.DataFrame, col: str, y0: int, x0: int, shape: tuple[int, int]) -> np.ndarray:
    """A column of a dense part as a plane whose first pixel is (y0, x0)."""
    out = np.zeros(shape, part[col].dtype if part[col].dtype != object else np.float64)
    out[part["y"].to_numpy() - y0, part["x"].to_numpy() - x0] = part[col].to_numpy()
    return out
