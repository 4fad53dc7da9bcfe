"""Neighbourhood operators. Each runs one pass of windows along rows and one along columns.

Windows are partitioned by (image, row) and (image, column), so one huge picture still spreads over its rows, and a pass shuffles each
pixel once whatever the radius; the median works in tiles. What lies outside the picture is an explicit choice per operator: reflect (box sums),
clamp (median) or nothing (masks).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import KEY, LAB
from ..storage import with_facts
from .bands import dealt_tiles, plane


def dims(df: DataFrame) -> DataFrame:
    """image_id, _h, _w."""
    return df.groupBy("image_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))


def with_dims(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df plus _h, _w of its pictures, or of those in `of`."""
    return with_facts(df, dims(df if of is None else of))


def _reflected(i: str, n: str, r: int) -> Column:
    """All places in [-r, n - 1 + r] that mirror to i (edges are not repeated)."""
    return F.expr(f"""case when {n} = 1 then sequence(-{r}, {r}) else array_distinct(filter(flatten(transform(
        sequence(-({r} div (2 * ({n} - 1)) + 1), {r} div (2 * ({n} - 1)) + 1),
        k -> array(cast({i} + k * 2 * ({n} - 1) as int), cast(k * 2 * ({n} - 1) - {i} as int)))), p -> p >= -{r} and p < {n} + {r})) end""")


def _clamped(i: str, n: str, r: int) -> Column:
    """All places in [-r, n - 1 + r] that clamp to i."""
    return F.expr(f"sequence(if({i} = 0, -{r}, {i}), if({i} = {n} - 1, {n} - 1 + {r}, {i}))")


def _pass(df: DataFrame, axis: str, r: int, pad, aggs: dict[str, Column]) -> DataFrame:
    """One windowed pass along `axis` over the padded line; aggs: output name to an aggregate."""
    other, n = ("y", "_w") if axis == "x" else ("x", "_h")
    line = Window.partitionBy("image_id", other).orderBy("_p").rowsBetween(-r, r)
    wide = df.withColumn("_p", F.explode(pad(axis, n, r)))
    wide = wide.withColumns({k: v.over(line) for k, v in aggs.items()})
    return wide.where(F.col("_p") == F.col(axis)).drop("_p")


def box_sums(df: DataFrame, cols: Sequence[str], r: int) -> DataFrame:
    """df plus `<c>_sum`: sums over (2r+1)^2 windows, reflected at the edges. df: a dense grid without nulls in cols."""
    out = with_dims(df)
    out = _pass(out, "x", r, _reflected, {f"_h_{c}": F.sum(F.col(c).cast("double")) for c in cols})
    out = _pass(out, "y", r, _reflected, {f"{c}_sum": F.sum(f"_h_{c}") for c in cols})
    return out.drop("_h", "_w", *(f"_h_{c}" for c in cols))


def box_mean(df: DataFrame, cols: Sequence[str], r: int) -> DataFrame:
    """df plus `<c>_mean`."""
    return box_sums(df, cols, r).withColumns({f"{c}_mean": F.col(f"{c}_sum") / float((2 * r + 1) ** 2) for c in cols}).drop(*(f"{c}_sum" for c in cols))


def box_count(df: DataFrame, mask: str, r: int) -> DataFrame:
    """df plus `count`: true pixels in each window, mirrored ones included."""
    out = box_sums(df.withColumn("_m", F.col(mask).cast("int")), ["_m"], r)
    return out.withColumn("count", F.col("_m_sum").cast("long")).drop("_m", "_m_sum")


def masked_box_mean(df: DataFrame, cols: Sequence[str], valid: str, r: int) -> DataFrame:
    """df plus `<c>_mean` over valid pixels only; 0 where a window has none."""
    held = df.withColumns({"_ok": F.col(valid).cast("double"), **{f"_v_{c}": F.when(F.col(valid), F.col(c)).otherwise(0.0) for c in cols}})
    out = box_mean(held, [*(f"_v_{c}" for c in cols), "_ok"], r)
    out = out.withColumns({f"{c}_mean": F.col(f"_v_{c}_mean") / F.greatest(F.col("_ok_mean"), F.lit(1e-6)) for c in cols})
    return out.drop("_ok", "_ok_mean", *(n for c in cols for n in (f"_v_{c}", f"_v_{c}_mean")))


def local_std(df: DataFrame, cols: Sequence[str], r: int) -> DataFrame:
    """df plus `<c>_std`: sqrt(max(E[v^2] - E[v]^2, 0)) of each window."""
    held = df.withColumns({f"_q_{c}": F.col(c) * F.col(c) for c in cols})
    out = box_mean(held, [*cols, *(f"_q_{c}" for c in cols)], r)
    var = {f"{c}_std": F.sqrt(F.greatest(F.col(f"_q_{c}_mean") - F.col(f"{c}_mean") * F.col(f"{c}_mean"), F.lit(0.0))) for c in cols}
    return out.withColumns(var).drop(*(n for c in cols for n in (f"_q_{c}", f"_q_{c}_mean", f"{c}_mean")))


def local_spread(df: DataFrame, r: int, cols: Sequence[str] = LAB) -> DataFrame:
    """df plus `spread`: the largest of the channels' window deviations."""
    return local_std(df, cols, r).withColumn("spread", F.greatest(*(f"{c}_std" for c in cols))).drop(*(f"{c}_std" for c in cols))


def median_filter(df: DataFrame, col: str, r: int = 4, rows: int = 128, cols: int = 256) -> DataFrame:
    """df plus `<col>_median` over (2r+1)^2 windows, edges repeated. df: a dense grid.

    Pixels go once to each tile that needs them; inside a tile the middle value of each window is selected, not sorted, a few rows at a time.
    """
    side, name = 2 * r + 1, f"{col}_median"
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def work(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(part["ty"].iloc[0]) * rows, int(part["tx"].iloc[0]) * cols
        y, x = part["y"].to_numpy(), part["x"].to_numpy()
        own = (y >= y0) & (y < y0 + rows) & (x >= x0) & (x < x0 + cols)
        out = part.loc[own].drop(columns=["ty", "tx"])
        if not own.any():
            return out.assign(**{name: np.zeros(0)})
        top, left, low, right = y.min(), x.min(), y.max(), x.max()
        v = plane(part, col, top, left, (low - top + 1, right - left + 1)).astype(np.float64)
        y1, x1 = y[own].max() + 1, x[own].max() + 1
        # where the part ends before its halo does, the picture ends
        v = np.pad(v, ((r - (y0 - top), max(0, y1 + r - 1 - low)), (r - (x0 - left), max(0, x1 + r - 1 - right))), mode="edge")
        windows, found = sliding_window_view(v, (side, side)), np.empty((y1 - y0, x1 - x0))
        for at in range(0, len(found), 16):
            few = windows[at : at + 16, : x1 - x0].reshape(-1, side * side)
            found[at : at + 16] = np.partition(few, side * side // 2, axis=1)[:, side * side // 2].reshape(-1, x1 - x0)
        return out.assign(**{name: found[y[own] - y0, x[own] - x0]})

    return dealt_tiles(df, r, rows, cols).groupBy("image_id", "ty", "tx").applyInPandas(work, schema)


def any_in_window(df: DataFrame, mask: str, r: int, out: str = "any") -> DataFrame:
    """df plus a flag: is the mask true anywhere in the (2r+1)^2 window?"""
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-r, r)
    col = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-r, r)
    return df.withColumn("_any", F.max(mask).over(row)).withColumn(out, F.max("_any").over(col)).drop("_any")


def dilate(df: DataFrame, mask: str, radius: int, out: str = "mask") -> DataFrame:
    """df plus the mask grown to the pixels within `radius` steps (|dy| + |dx|); outside counts as false.

    First the distance to the nearest true pixel of the own row, then the least of that plus the row distance.
    """
    if radius <= 0:
        return df.withColumn(out, F.col(mask))
    row = Window.partitionBy("image_id", "y").orderBy("x")
    here = F.when(F.col(mask), F.col("x"))
    left = F.last(here, ignorenulls=True).over(row.rowsBetween(-radius, 0))
    right = F.first(here, ignorenulls=True).over(row.rowsBetween(0, radius))
    far = F.lit(radius + 1)
    df = df.withColumn("_d", F.least(F.coalesce(F.col("x") - left, far), F.coalesce(right - F.col("x"), far)))
    col = Window.partitionBy("image_id", "x").orderBy("y")
    near = [F.coalesce(F.lag("_d", k).over(col) if k > 0 else F.lead("_d", -k).over(col), far) + abs(k) for k in range(-radius, radius + 1) if k]
    return df.withColumn(out, F.least(F.col("_d"), *near) <= radius).drop("_d")


def erode(df: DataFrame, mask: str, radius: int, out: str = "mask") -> DataFrame:
    """df plus the mask less the pixels within `radius` steps of a false one; outside counts as true."""
    grown = dilate(df.withColumn("_not", ~F.col(mask)), "_not", radius, "_grown")
    return grown.withColumn(out, ~F.col("_grown")).drop("_not", "_grown")


def close_mask(df: DataFrame, mask: str, radius: int, out: str = "mask") -> DataFrame:
    return erode(dilate(df, mask, radius, "_closed"), "_closed", radius, out).drop("_closed")


def gradient_magnitude(df: DataFrame, col: str, out: str = "gradient") -> DataFrame:
    """|v - left| + |v - above|, 0 across the edge."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    v = F.col(col)
    df = df.withColumn("_gx", F.abs(v - F.coalesce(F.lag(col).over(row), v)))
    return df.withColumn(out, F.col("_gx") + F.abs(v - F.coalesce(F.lag(col).over(column), v))).drop("_gx")


def laplacian_range(df: DataFrame, col: str) -> DataFrame:
    """df plus `laplacian` and `range` of the 3x3 window; null on the border."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    v, w, e = F.col(col), F.lag(col).over(row), F.lead(col).over(row)
    df = df.withColumns({"_we": w + e, "_lo": F.when(w.isNotNull() & e.isNotNull(), F.least(v, w, e)), "_hi": F.when(w.isNotNull() & e.isNotNull(), F.greatest(v, w, e))})
    at = lambda c: (F.lag(c).over(column), F.lead(c).over(column))
    (n, s), (lo1, lo2), (hi1, hi2) = at(col), at("_lo"), at("_hi")
    inside = n.isNotNull() & s.isNotNull() & F.col("_lo").isNotNull()
    df = df.withColumns({
        "laplacian": n + s + F.col("_we") - v * 4.0,
        "range": F.when(inside, F.greatest("_hi", hi1, hi2) - F.least("_lo", lo1, lo2)),
    })
    return df.drop("_we", "_lo", "_hi")


def detail_field(df: DataFrame, r: int = 2, limit: float = 48.0) -> DataFrame:
    """key, a and d_r, d_g, d_b: level less the window mean, clipped."""
    out = box_mean(df, ["r", "g", "b"], r)
    clip = lambda c: F.greatest(F.least(F.col(c) - F.col(f"{c}_mean"), F.lit(limit)), F.lit(-limit))
    return out.select(*KEY, "a", *(clip(c).alias(f"d_{c}") for c in "rgb"))


def render_detail(field: DataFrame, gain: float | Column) -> DataFrame:
    """Grey-centred picture of a detail field, truncated to bytes; alpha carried over."""
    shade = lambda c: F.floor(F.least(F.greatest(F.col(f"d_{c}") * gain + 128.0, F.lit(0.0)), F.lit(255.0))).cast("int")
    return field.select(*KEY, *(shade(c).alias(c) for c in "rgb"), "a")
