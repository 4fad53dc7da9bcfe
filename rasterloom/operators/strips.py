"""Pictures as strips of packed rows: the layout for megapixels.

A strip holds up to BAND whole rows of a picture as RGBA bytes; a picture is a few dozen rows of a table instead of millions. Rows that an
operator needs from the strips above and below are cut out of their bytes (`substring`) and sent along, so a pass shuffles (1 + 2 halo / BAND)
times four bytes a pixel. A task's memory grows with a picture's width and never with its height.

`clean_strips` does what plans.clean does without snap, in one such pass: CIELab, the range-weighted local mean, bytes, alpha rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import KNEE, LUMA, RGB_TO_XYZ, WHITE, XYZ_TO_RGB
from ..model import INTERIOR_ALPHA, MIN_ALPHA, PIXELS, STRAY_ALPHA, Options
from .bilateral import taps
from .metrics import auto_radius
from .stencil import with_dims

BAND = 64
STRIPS = "image_id string, band int, h int, w int, data binary"
#: Pixels of a block of the kernel: its planes stay in a core's cache.
BLOCK = 32768


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Strips of a dense pixel relation."""
    dealt = with_dims(pixels.select("image_id", "y", "x", *"rgba")).withColumn("band", F.expr(f"y div {BAND}"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        band, h, w = (int(part[c].iloc[0]) for c in ("band", "_h", "_w"))
        out = np.zeros((min(BAND, h - band * BAND), w, 4), np.uint8)
        out[part["y"] - band * BAND, part["x"]] = part[list("rgba")]
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "band": [band], "h": [h], "w": [w], "data": [out.tobytes()]})

    return dealt.groupBy("image_id", "band").applyInPandas(pack, STRIPS)


def to_pixels(strips: DataFrame) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, band, w, data in batch.itertuples(index=False):
                flat = np.frombuffer(data, np.uint8).reshape(-1, 4).astype(np.int32)
                y, x = divmod(np.arange(len(flat), dtype=np.int32), w)
                yield pd.DataFrame({"image_id": image_id, "y": y + band * BAND, "x": x, **dict(zip("rgba", flat.T))})

    return strips.select("image_id", "band", "w", "data").mapInPandas(work, PIXELS)


def with_halo(strips: DataFrame, halo: Column, most: int) -> DataFrame:
    """image_id, band, h, w, `parts`: the strip's bytes between those of up to `halo` rows above and below, each with its first row. halo: at most `most` rows."""
    reach, line = -(-most // BAND), F.col("w") * 4
    held = strips.withColumn("_n", F.expr("cast(octet_length(data) div (w * 4) as int)")).withColumn("_halo", halo)
    pieces = []
    for step in range(-reach, reach + 1):  # to the strip `step` below
        lo = F.greatest(F.lit(step * BAND) - F.col("_halo"), F.lit(0)) if step > 0 else F.lit(0)
        hi = F.least(F.lit((step + 1) * BAND) + F.col("_halo"), F.col("_n")) if step < 0 else F.col("_n")
        pieces.append(F.struct((F.col("band") + step).alias("to"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))
    sent = held.withColumn("p", F.explode(F.array(*pieces))).where("p.to >= 0 and p.to <= (h - 1) div 64 and p.lo < p.hi".replace("64", str(BAND)))
    cut = F.substring("data", (F.col("p.lo") * line + 1).cast("int"), ((F.col("p.hi") - F.col("p.lo")) * line).cast("int"))
    sent = sent.select("image_id", F.col("p.to").alias("band"), "h", "w", F.struct((F.col("band") * BAND + F.col("p.lo")).alias("y"), cut.alias("data")).alias("part"))
    return sent.groupBy("image_id", "band").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.sort_array(F.collect_list("part")).alias("parts"))


def rows_of(parts: list, w: int) -> tuple[int, np.ndarray]:
    """The first row and the (rows, w, 4) bytes of a strip with its halo."""
    return parts[0]["y"], np.frombuffer(b"".join(bytes(p["data"]) for p in parts), np.uint8).reshape(-1, w, 4)


@lru_cache(maxsize=1)
def _linear() -> np.ndarray:
    v = np.arange(256) / 255.0
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def lab_of(rgb: np.ndarray) -> np.ndarray:
    """(3, ...) CIELab of (..., 3) sRGB bytes."""
    lin = _linear()[rgb]
    xyz = [sum(lin[..., i] * m for i, m in enumerate(row)) / w for row, w in zip(RGB_TO_XYZ, WHITE)]
    fx, fy, fz = (np.where(t > KNEE**3, np.cbrt(t), t / (3 * KNEE**2) + 4.0 / 29.0) for t in xyz)
    return np.stack([fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0])


def bytes_of(lab: np.ndarray) -> np.ndarray:
    """(..., 3) sRGB bytes of (3, ...) CIELab, half to even, clipped to the gamut in linear light."""
    fy = (lab[0] + 16.0) / 116.0
    f = fy + lab[1] / 500.0, fy, fy - lab[2] / 200.0
    xyz = [np.where(t > KNEE, t * t * t, (t - 4.0 / 29.0) * (3 * KNEE**2)) * w for t, w in zip(f, WHITE)]
    lin = [np.clip(sum(x * m for x, m in zip(xyz, row)), 0.0, 1.0) for row in XYZ_TO_RGB]
    unit = [np.where(v <= 0.0031308, v * 12.92, v ** (1.0 / 2.4) * 1.055 - 0.055) for v in lin]
    return np.stack([np.clip(np.rint(u * 255.0), 0, 255).astype(np.uint8) for u in unit], axis=-1)


def local_mean(lab: np.ndarray, ok: np.ndarray, lo: int, hi: int, radius: int, sigma_range: float, stride: int, kind: type) -> np.ndarray:
    """Range-weighted local means of rows lo to hi of (3, rows, w) planes, in blocks whose planes are made once.

    Values are scaled so that a squared distance is its own exponent. Pixels that aren't ok, and those around the picture, get a value so
    far off that their weight is 0.
    """
    rows, w = ok.shape
    top, below, unit, far = max(0, radius - lo), max(0, hi + radius - rows), math.sqrt(2.0) * sigma_range, kind(1e5)
    wide = np.full((3, rows + top + below, w + 2 * radius), far, kind)
    wide[:, top : top + rows, radius : radius + w] = np.where(ok, lab / unit, far)
    steps = [(dy, dx, kind(math.log(s))) for dy, dx, s in taps(radius, stride)]
    out, cols = np.empty((3, hi - lo, w), kind), min(w, BLOCK // 2)
    each = max(1, BLOCK // cols)
    for y in range(lo, hi, each):
        for x in range(0, w, cols):
            n, m = min(each, hi - y), min(cols, w - x)
            mid = np.ascontiguousarray(wide[:, top + y : top + y + n, radius + x : radius + x + m])
            d, wt, total, weight = np.empty((3, n, m), kind), np.empty((n, m), kind), np.zeros((3, n, m), kind), np.zeros((n, m), kind)
            for dy, dx, space in steps:
                there = wide[:, top + y + dy : top + y + dy + n, radius + x + dx : radius + x + dx + m]
                np.subtract(there, mid, out=d)
                np.multiply(d, d, out=d)
                np.add(d[0], d[1], out=wt)
                np.add(wt, d[2], out=wt)
                np.subtract(space, wt, out=wt)
                np.exp(wt, out=wt)
                np.add(weight, wt, out=weight)
                np.multiply(there, wt, out=d)
                np.add(total, d, out=total)
            out[:, y - lo : y - lo + n, x : x + m] = total / weight
    return out * kind(unit)


def _near(mask: np.ndarray) -> np.ndarray:
    """Is the mask true anywhere in the 3x3 window?"""
    wide = np.pad(mask, 1)
    line = wide[:, :-2] | wide[:, 1:-1] | wide[:, 2:]
    return line[:-2] | line[1:-1] | line[2:]


def _flags(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """interior and stray, of alpha rows with a row above and below where there is one."""
    return ~_near(a < INTERIOR_ALPHA), ~_near(a > STRAY_ALPHA)


def _clean_rows(rgba: np.ndarray, lo: int, hi: int, radius: int, opts: Options, kind: type) -> np.ndarray:
    ok = rgba[..., 3] >= MIN_ALPHA
    out = rgba[lo:hi].copy()
    with np.errstate(all="ignore"):  # pixels that aren't valid give no mean
        mean = local_mean(lab_of(rgba[..., :3]), ok, lo, hi, radius, opts.sigma_range, opts.stride, kind)
        shown = bytes_of(np.where(ok[lo:hi], mean, 0.0).astype(np.float64))
    out[..., :3][ok[lo:hi]] = shown[ok[lo:hi]]
    interior, stray = (f[lo:hi] for f in _flags(rgba[..., 3]))
    if opts.alpha_mode == "normalize":
        out[interior, 3] = 255
    out[stray, 3] = 0
    out[out[..., 3] == 0, :3] = 0
    if opts.alpha_mode == "flatten":
        share = out[..., 3:].astype(np.float64) / 255.0
        out[..., :3] = np.rint(out[..., :3] * share + (1.0 - share) * np.array(opts.bg_color, np.float64)).astype(np.uint8)
        out[..., 3] = 255
    return out


def clean_strips(strips: DataFrame, opts: Options | None = None, kind: type = np.float32) -> DataFrame:
    """Cleaned strips. kind: the floats of the local mean; single ones differ from plans.clean by one level on a few pixels in a million, double ones by none but for the last bit of a float."""
    opts = opts or Options()
    if opts.snap:
        raise ValueError("snap needs regions: use plans.clean")
    fixed = opts.radius
    radius = F.lit(fixed) if fixed is not None else auto_radius(F.col("w"), F.col("h"))
    near = with_halo(strips, F.greatest(radius, F.lit(1)), max(fixed or 0, 24)).withColumn("radius", radius)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, band, h, w, parts, radius in batch.itertuples(index=False):
                first, rgba = rows_of(list(parts), w)
                lo = band * BAND - first
                done = _clean_rows(rgba, lo, min(lo + BAND, len(rgba)), radius, opts, kind)
                yield pd.DataFrame({"image_id": [image_id], "band": [band], "h": [h], "w": [w], "data": [done.tobytes()]})

    return near.select("image_id", "band", "h", "w", "parts", "radius").mapInPandas(work, STRIPS)


def noise_values(strips: DataFrame) -> DataFrame:
    """image_id, name (lab or luma), v, n: absolute Laplacians of flat valid pixels inside the picture, and how often each strip has each."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, band, h, w, parts in batch.itertuples(index=False):
                first, rgba = rows_of(list(parts), w)
                lo, hi = max(1, band * BAND - first), min(band * BAND - first + BAND, len(rgba) - 1)
                if hi <= lo or w < 3:
                    continue
                ok = rgba[..., 3] >= MIN_ALPHA
                level = {"lab": np.where(ok, lab_of(rgba[..., :3])[0], 0.0), "luma": sum(rgba[..., i] * m for i, m in enumerate(LUMA))}
                for name, v in level.items():
                    n, s, west, east, mid = v[lo - 1 : hi - 1, 1:-1], v[lo + 1 : hi + 1, 1:-1], v[lo:hi, :-2], v[lo:hi, 2:], v[lo:hi, 1:-1]
                    three = [v[a : a + hi - lo, b : w - 2 + b] for a in (lo - 1, lo, lo + 1) for b in range(3)]
                    flat = (np.maximum.reduce(three) - np.minimum.reduce(three) < 3.0) & ok[lo:hi, 1:-1]
                    found, times = np.unique(np.abs(n + s + (west + east) - mid * 4.0)[flat], return_counts=True)
                    yield pd.DataFrame({"image_id": image_id, "name": name, "v": found, "n": times})

    near = with_halo(strips, F.lit(1), 1).select("image_id", "band", "h", "w", "parts")
    return near.mapInPandas(work, "image_id string, name string, v double, n long")


def alpha_counts(strips: DataFrame) -> DataFrame:
    """image_id and the counters of alpha.alpha_counters."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, band, h, w, parts in batch.itertuples(index=False):
                first, rgba = rows_of(list(parts), w)
                lo = band * BAND - first
                a = rgba[..., 3]
                interior, stray = (f[lo : lo + BAND] for f in _flags(a))
                own = a[lo : lo + BAND]
                yield pd.DataFrame({"image_id": [image_id], "i": [int((interior & (own != 255)).sum())], "s": [int((stray & (own != 0)).sum())]})

    near = with_halo(strips, F.lit(1), 1).select("image_id", "band", "h", "w", "parts")
    return near.mapInPandas(work, "image_id string, i long, s long").groupBy("image_id").agg(F.sum("i").alias("alpha_interior_snapped_px"), F.sum("s").alias("alpha_stray_zeroed_px"))
