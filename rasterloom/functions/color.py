"""sRGB bytes, CIELab (D65), luma and compositing as columns; everything stays in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LAB, MIN_ALPHA, Colour

# sRGB primaries to XYZ and back, the D65 white point, the knee of CIELab, and luma weights.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
KNEE = 6.0 / 29.0
LUMA = (0.2126, 0.7152, 0.0722)


def _mix(weights: tuple, channels: list[Column]) -> Column:
    first, *rest = [c * float(w) for w, c in zip(weights, channels)]
    for c in rest:
        first = first + c
    return first


def linear(byte: Column) -> Column:
    """Linear light of an sRGB byte (or a level in 0..255)."""
    v = byte.cast("double") / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def with_lab(df: DataFrame, rgb: tuple = ("r", "g", "b"), out: tuple = LAB, valid: Column | None = None) -> DataFrame:
    """df plus three Lab columns; zeros where `valid` is false."""
    tmp = [f"_lin{i}" for i in range(3)] + [f"_f{i}" for i in range(3)]
    df = df.withColumns({n: linear(F.col(c)) for n, c in zip(tmp[:3], rgb)})
    lin = [F.col(n) for n in tmp[:3]]
    xyz = [_mix(m, lin) / w for m, w in zip(RGB_TO_XYZ, WHITE)]
    curve = lambda t: F.when(t > KNEE**3, F.cbrt(t)).otherwise(t / (3 * KNEE**2) + 4.0 / 29.0)
    df = df.withColumns({n: curve(t) for n, t in zip(tmp[3:], xyz)})
    fx, fy, fz = (F.col(n) for n in tmp[3:])
    lab = [fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0]
    keep = (lambda c: c) if valid is None else (lambda c: F.when(valid, c).otherwise(0.0))
    return df.withColumns({n: keep(c) for n, c in zip(out, lab)}).drop(*tmp)


def with_srgb(df: DataFrame, lab: tuple = LAB, out: tuple = ("sr", "sg", "sb")) -> DataFrame:
    """df plus sRGB in 0..1, clipped to the gamut in linear light."""
    tmp = [f"_x{i}" for i in range(3)] + [f"_l{i}" for i in range(3)]
    fy = (F.col(lab[0]) + 16.0) / 116.0
    f = (fy + F.col(lab[1]) / 500.0, fy, fy - F.col(lab[2]) / 200.0)
    back = lambda t: F.when(t > KNEE, t * t * t).otherwise((t - 4.0 / 29.0) * (3 * KNEE**2))
    df = df.withColumns({n: back(t) * w for n, t, w in zip(tmp[:3], f, WHITE)})
    xyz = [F.col(n) for n in tmp[:3]]
    df = df.withColumns({n: F.least(F.greatest(_mix(m, xyz), F.lit(0.0)), F.lit(1.0)) for n, m in zip(tmp[3:], XYZ_TO_RGB)})
    code = lambda v: F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1.0 / 2.4)) * 1.055 - 0.055)
    return df.withColumns({n: code(F.col(v)) for n, v in zip(out, tmp[3:])}).drop(*tmp)


def to_byte(unit: Column) -> Column:
    """0..1 to a byte, half to even."""
    return F.least(F.greatest(F.rint(unit * 255.0), F.lit(0.0)), F.lit(255.0)).cast("int")


def lab_delta(a: tuple, b: tuple) -> Column:
    """Euclidean Lab distance of two triples of column names."""
    d = [F.col(x) - F.col(y) for x, y in zip(a, b)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def luma(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    """Rec. 709 luma of gamma-encoded levels."""
    return _mix(LUMA, [F.col(c) if isinstance(c, str) else c for c in (r, g, b)])


def is_valid(alpha: Column | str = "a") -> Column:
    return (F.col(alpha) if isinstance(alpha, str) else alpha) >= MIN_ALPHA


def flatten(df: DataFrame, color: Colour = (255, 255, 255)) -> DataFrame:
    """Composite on a solid colour: r, g, b blended half to even, a = 255."""
    share = F.col("a").cast("double") / 255.0
    mixed = {c: F.rint(F.col(c) * share + (1.0 - share) * float(bg)).cast("int") for c, bg in zip("rgb", color)}
    return df.withColumns({**mixed, "a": F.lit(255)})


def rendered_luma(background: Colour = (255, 255, 255), r: str = "r", g: str = "g", b: str = "b", a: str = "a") -> Column:
    """Luma as seen on a page of that colour, unrounded."""
    share = F.col(a).cast("double") / 255.0
    return luma(*(float(bg) - share * (float(bg) - F.col(c)) for c, bg in zip((r, g, b), background)))


def parse_color_column(text: Column) -> Column:
    """struct(r, g, b) of colour names as `parse_color` reads them, null where it would refuse."""
    t = F.lower(F.trim(text))
    t = F.when(t == "white", "ffffff").when(t == "black", "000000").otherwise(F.regexp_replace(t, "^#", ""))
    t = F.when(F.length(t) == 3, F.regexp_replace(t, "(.)", "$1$1")).otherwise(t)
    part = lambda i: F.conv(F.substring(t, i, 2), 16, 10).cast("int")
    return F.when(t.rlike("^[0-9a-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))
