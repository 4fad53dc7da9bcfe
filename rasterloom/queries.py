"""The raster operators as queries over fixture pictures, and the same in DuckDB SQL written independently of the Spark plans.

Values are rounded to 6 places (pixels) or 4 (statistics) on both sides, since the engines add floats in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import color
from .model import KEY, LAB, Options
from .operators import alpha, bilateral, figures, metrics, regions, stencil
from .operators import strips as packed
from .plans import clean as plan
from .sources import images, ledger
from .storage import shuffled, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """key and cols, rounded; -0.0 becomes 0.0."""
    return df.select(*KEY, *((F.round(c, places) + 0.0).alias(c) for c in cols))


# ---------------------------------------------------------------- SQL pieces
def _raster_sql(name: str = "px", grain: str = "c % 5 - 2") -> str:
    return f"""{name} as (select 'orders' image_id, y, x,
  cast(case when hole then 255 else 40 + (blk * 37) % 180 + g end as int) r, cast(case when hole then 255 else 60 + (blk * 53) % 160 + g end as int) g,
  cast(case when hole then 255 else 50 + (blk * 71) % 170 + g end as int) b,
  cast(case when hole then c % 3 when y = 4 or x = 4 then 128 when y = 5 and x % 10 = 0 then 20 else 253 end as int) a
 from (select y, x, c, {grain} g, (y // 20) * 7 + (x // 20) blk, (y < 4 or x < 4) hole
  from (select cast(o_orderkey // 100 as int) y, cast(o_orderkey % 100 as int) x, cast(round(o_totalprice * 100) as bigint) c from orders)))"""


PX, AFTER = _raster_sql(), _raster_sql("ax", "0")
DIM = "dim as (select max(y) + 1 h, max(x) + 1 w from px)"


def _luma_sql(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"({r} * 0.2126::double + {g} * 0.7152::double + {b} * 0.0722::double)"


def _lab_sql(name: str, src: str, out: tuple = LAB, where: str = "true", rgb: str = "rgb", tail: str = "") -> str:
    """CTE name: all of src plus three Lab columns, 0 where `where` is false."""
    lin = ", ".join(f"case when {c}{tail} / 255.0::double <= 0.04045 then {c}{tail} / 255.0::double / 12.92 else pow(({c}{tail} / 255.0::double + 0.055) / 1.055, 2.4::double) end _i{i}" for i, c in enumerate(rgb))
    xyz = ", ".join(f"({' + '.join(f'_i{j} * {m!r}::double' for j, m in enumerate(row))}) / {w!r}::double _x{i}" for i, (row, w) in enumerate(zip(color.RGB_TO_XYZ, color.WHITE)))
    k = "(6.0::double / 29.0::double)"
    f = ", ".join(f"case when _x{i} > {k} * {k} * {k} then cbrt(_x{i}) else _x{i} / (3 * {k} * {k}) + 4.0::double / 29.0::double end _f{i}" for i in range(3))
    vals = ("_f1 * 116.0::double - 16.0::double", "(_f0 - _f1) * 500.0::double", "(_f1 - _f2) * 200.0::double")
    cols = ", ".join(f"case when {where} then {v} else 0.0::double end {n}" for v, n in zip(vals, out))
    return f"""{name}_i as (select *, {lin} from {src}), {name}_x as (select *, {xyz} from {name}_i), {name}_f as (select *, {f} from {name}_x),
{name} as (select * exclude (_i0, _i1, _i2, _x0, _x1, _x2, _f0, _f1, _f2), {cols} from {name}_f)"""


def _rgb_sql(name: str, src: str, lab: tuple = LAB, out: tuple = ("sr", "sg", "sb")) -> str:
    k = "(6.0::double / 29.0::double)"
    fy = f"({lab[0]} + 16.0::double) / 116.0::double"
    f = (f"({fy} + {lab[1]} / 500.0::double)", f"({fy})", f"({fy} - {lab[2]} / 200.0::double)")
    xyz = ", ".join(f"(case when {v} > {k} then pow({v}, 3) else ({v} - 4.0::double / 29.0::double) * 3 * {k} * {k} end) * {w!r}::double _x{i}" for i, (v, w) in enumerate(zip(f, color.WHITE)))
    lin = ", ".join(f"least(greatest({' + '.join(f'_x{j} * {m!r}::double' for j, m in enumerate(row))}, 0.0::double), 1.0::double) _l{i}" for i, row in enumerate(color.XYZ_TO_RGB))
    enc = ", ".join(f"case when _l{i} <= 0.0031308 then _l{i} * 12.92::double else pow(_l{i}, 1.0::double / 2.4::double) * 1.055::double - 0.055::double end {n}" for i, n in enumerate(out))
    return f"{name}_x as (select *, {xyz} from {src}), {name}_l as (select *, {lin} from {name}_x), {name} as (select * exclude (_x0, _x1, _x2, _l0, _l1, _l2), {enc} from {name}_l)"


def _box_sql(name: str, src: str, cols: list[str], r: int) -> str:
    """CTE name: y, x and <c>_mean by direct sums over mirrored taps."""
    mirror = lambda i, n: f"case when {n} = 1 then 0 else least((({i}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)), 2 * ({n} - 1) - (({i}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1))) end"
    sums = ", ".join(f"sum(n.{c}::double) / {(2 * r + 1) ** 2}.0::double {c}_mean" for c in cols)
    return f"""{name}_t as (select p.y, p.x, {mirror('p.y + dy', 'h')} ny, {mirror('p.x + dx', 'w')} nx from {src} p, dim, range(-{r}, {r + 1}) a(dy), range(-{r}, {r + 1}) b(dx)),
{name} as (select t.y, t.x, {sums} from {name}_t t join {src} n on n.y = t.ny and n.x = t.nx group by t.y, t.x)"""


def _median_sql(name: str, src: str, col: str) -> str:
    return f"""{name}_t as (select p.y, p.x, least(greatest(p.y + dy, 0), h - 1) ny, least(greatest(p.x + dx, 0), w - 1) nx from {src} p, dim, range(-4, 5) a(dy), range(-4, 5) b(dx)),
{name} as (select t.y, t.x, median(n.{col}) {col}_median from {name}_t t join {src} n on n.y = t.ny and n.x = t.nx group by t.y, t.x)"""


def _near_sql(name: str, src: str, mask: str, r: int, out: str, diamond: bool) -> str:
    """CTE name: y, x, out: is mask true at an in-bounds pixel within r (steps if diamond, else window)?"""
    limit = f"where abs(dy) + abs(dx) <= {r}" if diamond else ""
    return f"""{name} as (select p.y, p.x, bool_or(n.{mask}) {out} from {src} p, (select dy, dx from range(-{r}, {r + 1}) a(dy), range(-{r}, {r + 1}) b(dx) {limit}) t
 join {src} n on n.y = p.y + t.dy and n.x = p.x + t.dx group by p.y, p.x)"""


def _smooth_sql(name: str, src: str, radius: str, stride: int, sigma: float = 1.5) -> str:
    """CTE name: y, x and smoothed Lab of valid pixels of src; radius is an SQL expression over dim."""
    d2 = " + ".join(f"pow(p.{c} - n.{c}, 2)" for c in LAB)
    return f"""{name}_t as (select dy * {stride} dy, dx * {stride} dx, exp(-(dy * dy + dx * dx) * {stride * stride} / (2.0::double * pow(greatest(1.0::double, rad / 2.0::double), 2))) ws
  from (select {radius} rad from dim) r, range(-24, 25) a(dy), range(-24, 25) b(dx) where (dy * dy + dx * dx) * {stride * stride} <= rad * rad),
{name}_w as (select p.y, p.x, exp(-({d2}) / (2.0::double * {sigma}::double * {sigma}::double)) * ws wt, {', '.join(f'n.{c}' for c in LAB)}
  from {src} p, {name}_t t join {src} n on n.y = p.y + t.dy and n.x = p.x + t.dx where p.valid and n.valid),
{name} as (select y, x, {', '.join(f'sum(wt * {c}) / sum(wt) {c}' for c in LAB)} from {name}_w group by y, x)"""


VALID = f"v as (select *, a >= 24 valid, {_luma_sql()} l from px)"
BOTH = f"""both_ as (select p.image_id, p.y, p.x, p.r, p.g, p.b, p.a, q.r r2, q.g g2, q.b b2, q.a a2, p.a >= 24 valid, p.a >= 24 and q.a <> 0 seen,
  {_luma_sql('p.r', 'p.g', 'p.b')} l1, {_luma_sql('q.r', 'q.g', 'q.b')} l2 from px p join ax q using (y, x))"""


def _r(cols, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 {c.split('.')[-1]}" for c in cols)


def _lit(df: DataFrame) -> DataFrame:
    return df.withColumns({"valid": color.is_valid(), "l": color.luma()})


# ---------------------------------------------------------------- colour and per-pixel maps
@query(f"with {PX} select * from px")
def raster_pixels(spark, d):
    return fixtures.raster(spark, d)


@query(f"with {PX}, {_lab_sql('lab', 'px')} select image_id, y, x, {_r(LAB)} from lab")
def srgb_to_lab(spark, d):
    return rounded(color.with_lab(fixtures.raster(spark, d)), *LAB)


@query(f"with {PX}, {_lab_sql('lab', 'px')}, up as (select * replace (lab_l + 5 as lab_l) from lab), {_rgb_sql('s', 'up')} select image_id, y, x, {_r(('sr', 'sg', 'sb'))} from s")
def lab_to_srgb(spark, d):
    lab = color.with_lab(fixtures.raster(spark, d)).withColumn("lab_l", F.col("lab_l") + 5)
    return rounded(color.with_srgb(lab), "sr", "sg", "sb")


@query(f"with {PX} select image_id, y, x, r, g, b from px")
def lab_roundtrip(spark, d):
    back = color.with_srgb(color.with_lab(fixtures.raster(spark, d)))
    return back.select(*KEY, *(color.to_byte(F.col(f"s{c}")).alias(c) for c in "rgb"))


LAB2 = tuple(f"{c}2" for c in LAB)


def _both(spark, d) -> DataFrame:
    return metrics.pair(fixtures.raster(spark, d), fixtures.raster(spark, d, grain=False))


@query(f"with {PX}, {AFTER}, {BOTH}, {_lab_sql('one', 'both_')}, {_lab_sql('two', 'one', LAB2, tail='2')} select image_id, y, x, round(sqrt({' + '.join(f'pow({a} - {b}, 2)' for a, b in zip(LAB, LAB2))}), 6) delta from two")
def lab_delta(spark, d):
    both = color.with_lab(color.with_lab(_both(spark, d)), ("r2", "g2", "b2"), LAB2)
    return rounded(both.withColumn("delta", color.lab_delta(LAB, LAB2)), "delta")


@query(f"with {PX}, {VALID} select image_id, y, x, round(l, 6) l from v")
def luma(spark, d):
    return rounded(_lit(fixtures.raster(spark, d)), "l")


def _flatten_sql(c: tuple) -> str:
    mixed = ", ".join(f"round_even({n} * (a / 255.0::double) + (1.0::double - a / 255.0::double) * {v}, 0)::int {n}" for n, v in zip("rgb", c))
    return f"with {PX} select image_id, y, x, {mixed}, 255::int a from px"


@query(_flatten_sql((255, 255, 255)))
def flatten_white(spark, d):
    return color.flatten(fixtures.raster(spark, d))


@query(_flatten_sql((10, 20, 30)))
def flatten_colour(spark, d):
    return color.flatten(fixtures.raster(spark, d), (10, 20, 30))


def _rendered_sql(r="r", g="g", b="b", a="a") -> str:
    return _luma_sql(*(f"(255.0::double - {a} / 255.0::double * (255.0::double - {c}))" for c in (r, g, b)))


@query(f"with {PX} select image_id, y, x, round({_rendered_sql()}, 6) l from px")
def rendered_luma(spark, d):
    return rounded(fixtures.raster(spark, d).withColumn("l", color.rendered_luma()), "l")


@query(f"with {PX} select image_id, count(*) filter (a >= 24)::bigint valid, count(*)::bigint total from px group by 1")
def valid_mask_count(spark, d):
    return fixtures.raster(spark, d).groupBy("image_id").agg(F.count_if(color.is_valid()).alias("valid"), F.count(F.lit(1)).alias("total"))


def _orders(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"))


@query("""with o as (select o_orderkey k, printf('%06x', (o_orderkey * 7919 + 255) % 16777216) x from orders),
 c as (select k, case k % 7 when 0 then '#' || x when 1 then upper(x) when 2 then ' #' || x[1:3] || ' ' when 3 then 'White' when 4 then 'black' when 5 then '#' || x[1:2] else k || ',2,3' end said from o),
 t as (select k, said, case lower(trim(said)) when 'white' then 'ffffff' when 'black' then '000000' else ltrim(lower(trim(said)), '#') end n from c),
 h as (select k, said, case when length(n) = 3 then n[1] || n[1] || n[2] || n[2] || n[3] || n[3] else n end n from t),
 j as (select k, said, n, regexp_full_match(n, '[0-9a-f]{6}') ok from h)
 select k, said, case when ok then ('0x' || n[1:2])::int else -1 end r, case when ok then ('0x' || n[3:4])::int else -1 end g, case when ok then ('0x' || n[5:6])::int else -1 end b from j""")
def parse_color(spark, d):
    """Names of colours, good and bad ones, made of order numbers."""
    x = F.lpad(F.lower(F.hex((F.col("k") * 7919 + 255) % 16777216)), 6, "0")
    forms = [F.concat(F.lit("#"), x), F.upper(x), F.concat(F.lit(" #"), F.substring(x, 1, 3), F.lit(" ")), F.lit("White"), F.lit("black"), F.concat(F.lit("#"), F.substring(x, 1, 2)), F.concat(F.col("k"), F.lit(",2,3"))]
    said = _orders(spark, d).withColumn("said", F.element_at(F.array(*forms), (F.col("k") % 7 + 1).cast("int")))
    said = said.withColumn("c", color.parse_color_column(F.col("said")))
    return said.select("k", "said", *(F.coalesce(F.col("c")[n], F.lit(-1)).alias(n) for n in "rgb"))


# ---------------------------------------------------------------- stencils
@query(f"with {PX}, {VALID}, {DIM}, {_box_sql('m', 'v', ['l'], 2)} select image_id, y, x, round(l_mean, 6) l_mean from m join px using (y, x)")
def box_mean_r2(spark, d):
    return rounded(stencil.box_mean(_lit(fixtures.raster(spark, d)), ["l"], 2), "l_mean")


@query(f"with {PX}, u as (select *, (a >= 24)::int m from px), {DIM}, {_box_sql('m_', 'u', ['m'], 1)} select image_id, y, x, round(m_mean * 9)::bigint count from m_ join px using (y, x)")
def box_count_r1(spark, d):
    return stencil.box_count(_lit(fixtures.raster(spark, d)), "valid", 1).select(*KEY, "count")


@query(f"with {PX}, {VALID}, u as (select *, case when valid then l else 0 end lv, valid::int ok from v), {DIM}, {_box_sql('m', 'u', ['lv', 'ok'], 2)} select image_id, y, x, round(lv_mean / greatest(ok_mean, 1e-6), 6) l_mean from m join px using (y, x)")
def masked_box_mean_r2(spark, d):
    return rounded(stencil.masked_box_mean(_lit(fixtures.raster(spark, d)), ["l"], "valid", 2), "l_mean")


@query(f"with {PX}, {VALID}, u as (select *, l * l q from v), {DIM}, {_box_sql('m', 'u', ['l', 'q'], 2)} select image_id, y, x, round(greatest(q_mean - l_mean * l_mean, 0), 4) var from m join px using (y, x)")
def local_std_r2(spark, d):
    out = stencil.local_std(_lit(fixtures.raster(spark, d)), ["l"], 2)
    return rounded(out.withColumn("var", F.col("l_std") * F.col("l_std")), "var", places=4)


def _spread_sql(name: str, src: str, r: int, cols: tuple, out: str) -> str:
    sq = ", ".join(f"{c} * {c} q{i}" for i, c in enumerate(cols))
    std = ", ".join(f"sqrt(greatest(q{i}_mean - {c}_mean * {c}_mean, 0))" for i, c in enumerate(cols))
    return f"{name}_u as (select y, x, {', '.join(cols)}, {sq} from {src}), {_box_sql(name + '_m', name + '_u', [*cols, 'q0', 'q1', 'q2'], r)}, {name} as (select y, x, greatest({std}) {out} from {name}_m)"


@query(f"with {PX}, {DIM}, {_lab_sql('lab', 'px')}, {_spread_sql('s', 'lab', 2, LAB, 'spread')} select image_id, y, x, round(spread, 4) spread from s join px using (y, x)")
def local_spread_r2(spark, d):
    return rounded(stencil.local_spread(color.with_lab(fixtures.raster(spark, d)), 2), "spread", places=4)


@query(f"with {PX}, {VALID}, {DIM}, {_median_sql('m', 'v', 'l')} select image_id, y, x, round(l_median, 6) l_median from m join px using (y, x)")
def median_9x9(spark, d):
    return rounded(stencil.median_filter(_lit(fixtures.raster(spark, d)), "l"), "l_median")


MASK = "mk as (select image_id, y, x, r, g, b, a, a >= 24 and (r * 7 + g * 2 + b) % 11 > 4 m from px)"


def _masked(spark, d) -> DataFrame:
    return fixtures.raster(spark, d).withColumn("m", fixtures.ragged_mask())


@query(f"with {PX}, {MASK}, {_near_sql('n', 'mk', 'm', 1, 'hit', False)} select image_id, y, x, hit from n join px using (y, x)")
def any_in_window_r1(spark, d):
    return stencil.any_in_window(_masked(spark, d), "m", 1, "hit").select(*KEY, "hit")


@query(f"with {PX}, {MASK}, {_near_sql('n', 'mk', 'm', 2, 'hit', True)} select image_id, y, x, hit from n join px using (y, x)")
def dilate_r2(spark, d):
    return stencil.dilate(_masked(spark, d), "m", 2, "hit").select(*KEY, "hit")


_ERODE = "inv as (select y, x, not m o from mk), " + _near_sql("n", "inv", "o", 2, "bad", True)


@query(f"with {PX}, {MASK}, {_ERODE} select image_id, y, x, not bad hit from n join px using (y, x)")
def erode_r2(spark, d):
    return stencil.erode(_masked(spark, d), "m", 2, "hit").select(*KEY, "hit")


@query(f"with {PX}, {MASK}, {_near_sql('up', 'mk', 'm', 2, 'hit', True)}, inv as (select y, x, not hit o from up), {_near_sql('n', 'inv', 'o', 2, 'bad', True)} select image_id, y, x, not bad hit from n join px using (y, x)")
def close_r2(spark, d):
    return stencil.close_mask(_masked(spark, d), "m", 2, "hit").select(*KEY, "hit")


@query(f"with {PX}, {VALID} select p.image_id, p.y, p.x, round(coalesce(abs(p.l - w.l), 0) + coalesce(abs(p.l - n.l), 0), 6) gradient from v p left join v w on w.y = p.y and w.x = p.x - 1 left join v n on n.x = p.x and n.y = p.y - 1")
def gradient_magnitude(spark, d):
    return rounded(stencil.gradient_magnitude(_lit(fixtures.raster(spark, d)), "l"), "gradient")


_LAP = """lap as (select p.image_id, p.y, p.x, bool_and(p.valid) valid, sum(case when dy = 0 and dx = 0 then -4 when dy = 0 or dx = 0 then 1 else 0 end * n.l) laplacian, max(n.l) - min(n.l) rng, count(*) k
 from v p, range(-1, 2) a(dy), range(-1, 2) b(dx) join v n on n.y = p.y + dy and n.x = p.x + dx group by 1, 2, 3)"""


@query(f"with {PX}, {VALID}, {_LAP} select image_id, y, x, round(laplacian, 6) + 0.0 laplacian, round(rng, 6) \"range\" from lap where k = 9")
def laplacian_range(spark, d):
    return rounded(stencil.laplacian_range(_lit(fixtures.raster(spark, d)), "l"), "laplacian", "range").where("range is not null")


_SIGMA = "case when count(*) filter (k = 9 and valid and rng < 3) >= 64 then sqrt(pi() / 2) / 6 * median(abs(laplacian)) filter (k = 9 and valid and rng < 3) else 0 end"


@query(f"with {PX}, {VALID}, {_LAP} select image_id, round({_SIGMA}, 4)::double sigma from lap group by 1")
def robust_sigma(spark, d):
    return metrics.robust_sigma(_lit(fixtures.raster(spark, d)), "l").select("image_id", F.round("sigma", 4).alias("sigma"))


# ---------------------------------------------------------------- smoothing, alpha, the whole pipeline
_SMOOTH_IN = f"{PX}, {DIM}, u as (select *, a >= 24 valid from px), {_lab_sql('lab', 'u', where='valid')}"


@query(f"with {_SMOOTH_IN}, {_smooth_sql('s', 'lab', '3', 1)} select image_id, y, x, {_r(['s.' + c for c in LAB])} from s join px using (y, x)")
def bilateral_r3_s1(spark, d):
    held = plan.prepare(fixtures.raster(spark, d)).where("valid")
    return rounded(bilateral.smooth_tiles(held, 3, 1.5, 1), *LAB)


@query(f"with {_SMOOTH_IN}, {_smooth_sql('s', 'lab', '4', 2)} select image_id, y, x, {_r(['s.' + c for c in LAB])} from s join px using (y, x)")
def bilateral_r4_s2(spark, d):
    held = plan.prepare(fixtures.raster(spark, d)).where("valid")
    return rounded(bilateral.smooth_tiles(held, 4, 1.5, 2), *LAB)


_FLAGS = f"""am as (select *, a < 248 low, a > 2 shown from px), {_near_sql('lo', 'am', 'low', 1, 'lows', False)}, {_near_sql('sh', 'am', 'shown', 1, 'shows', False)},
fl as (select p.*, a >= 248 and not lows interior, a <= 2 and not shows stray from px p join lo using (y, x) join sh using (y, x))"""


def _alpha_sql(mode: str) -> str:
    a = "case when stray then 0 when interior then 255 else a end" if mode == "normalize" else "case when stray then 0 else a end"
    return f"select image_id, y, x, {', '.join(f'case when na = 0 then 0 else {c} end::int {c}' for c in 'rgb')}, na::int a from (select *, {a} na from fl)"


@query(f"with {PX}, {_FLAGS} {_alpha_sql('normalize')}")
def alpha_normalize(spark, d):
    return alpha.apply_alpha(alpha.alpha_flags(fixtures.raster(spark, d))).drop("interior", "stray")


@query(f"with {PX}, {_FLAGS} {_alpha_sql('keep')}")
def alpha_keep(spark, d):
    return alpha.apply_alpha(alpha.alpha_flags(fixtures.raster(spark, d)), "keep").drop("interior", "stray")


@query(f"with {PX}, {_FLAGS} select image_id, count(*) filter (interior and a <> 255)::bigint alpha_interior_snapped_px, count(*) filter (stray and a <> 0)::bigint alpha_stray_zeroed_px from fl group by 1")
def alpha_counters(spark, d):
    return alpha.alpha_counters(alpha.alpha_flags(fixtures.raster(spark, d)))


_AUTO = "greatest(3, least(24, round_even(16.0::double * sqrt(h * w / 1572516.0::double), 0)))::int"


def _clean_sql(mode: str) -> str:
    byte = ", ".join(f"case when p.a >= 24 then least(greatest(round_even(s{c} * 255.0::double, 0), 0), 255)::int else p.{c} end {c}" for c in "rgb")
    base = f"with raw as (select * from (with {PX} select * from px)), {DIM.replace('px', 'raw')}, u as (select *, a >= 24 valid from raw), {_lab_sql('lab', 'u', where='valid')}, {_smooth_sql('s', 'lab', _AUTO, 1)}, {_rgb_sql('t', 's')}, px as (select p.image_id, p.y, p.x, {byte}, p.a from raw p left join t using (y, x)), {_FLAGS}"
    if mode != "flatten":
        return f"{base} {_alpha_sql(mode)}"
    mixed = ", ".join(f"round_even({n} * (a / 255.0::double) + (1.0::double - a / 255.0::double) * 255, 0)::int {n}" for n in "rgb")
    return f"{base} select image_id, y, x, {mixed}, 255::int a from ({_alpha_sql('keep')})"


@query(_clean_sql("normalize"))
def clean_default(spark, d):
    return plan.clean(fixtures.raster(spark, d))


@query(_clean_sql("normalize"))
def clean_packed(spark, d):
    """The same on strips of packed rows, in double floats."""
    strips = packed.from_pixels(fixtures.raster(spark, d))
    return packed.to_pixels(packed.clean_strips(strips, kind=np.float64))


@query(_clean_sql("flatten"))
def clean_flatten(spark, d):
    return plan.clean(fixtures.raster(spark, d), Options(alpha_mode="flatten"))


def _batch_info_sql() -> str:
    """The info row of every picture of the batch, by joins on the picture too."""
    px = """bp as (select 'img' || i image_id, y, x, cast(case when hole then 255 else 40 + (blk * 37) % 180 + g end as int) r, cast(case when hole then 255 else 60 + (blk * 53) % 160 + g end as int) g,
 cast(case when hole then 255 else 50 + (blk * 71) % 170 + g end as int) b, cast(case when hole then c % 3 when y = 4 or x = 4 then 128 else 253 end as int) a
 from (select i, y, x, c, c % 5 - 2 g, (y // 20) * 7 + (x // 20) blk, (y < 4 or x < 4) hole from (select o_orderkey // 2500 i, o_orderkey % 2500 // 50 y, o_orderkey % 50 x, cast(round(o_totalprice * 100) as bigint) c from orders)))"""
    near = "from bl p, range(-1, 2) e(dy), range(-1, 2) f(dx) join bl n on n.image_id = p.image_id and n.y = p.y + dy and n.x = p.x + dx group by 1, 2, 3"
    weight = "case when dy = 0 and dx = 0 then -4 when dy = 0 or dx = 0 then 1 else 0 end"
    each = ", ".join(f"sum({weight} * n.{c}) lap_{c}, max(n.{c}) - min(n.{c}) rng_{c}" for c in ("lab_l", "l1"))
    sigma = lambda c: f"round(case when count(*) filter (k = 9 and valid and rng_{c} < 3) >= 64 then sqrt(pi() / 2) / 6 * median(abs(lap_{c})) filter (k = 9 and valid and rng_{c} < 3) else 0 end, 4)::double"
    return f"""with {px}, bv as (select *, a >= 24 valid, {_luma_sql()} l1 from bp), {_lab_sql('bl', 'bv', where='valid')},
nn as (select p.image_id, p.y, p.x, bool_and(p.valid) valid, count(*) k, {each}, max(p.a) a, min(n.a) low, max(n.a) high {near})
select image_id, {sigma('lab_l')} sigma_grain_lab, {sigma('l1')} sigma_grain_srgb_levels, greatest(3, least(24, round_even(16.0::double * sqrt((max(x) + 1) * (max(y) + 1) / 1572516.0::double), 0)))::int radius,
 1.5::double sigma_range, 1::int stride, false snap, 0::bigint snapped_px, 0::bigint snapped_blocks, 'normalize' alpha_mode,
 count(*) filter (low >= 248 and a <> 255)::bigint alpha_interior_snapped_px, count(*) filter (high <= 2 and a <> 0)::bigint alpha_stray_zeroed_px from nn group by 1"""


@query(_batch_info_sql())
def clean_batch_info(spark, d):
    return plan.clean_with_info(fixtures.batch(spark, d))[1].drop("size", "bg_color")


# ---------------------------------------------------------------- regions and their models
@query(f"with {PX}, {DIM}, u as (select *, a >= 24 valid from px), {_lab_sql('lab', 'u', where='valid')}, w as (select *, valid::int ok from lab), {_box_sql('m', 'w', [*LAB, 'ok'], 4)} select image_id, y, x, valid and greatest({', '.join(f'abs({c} - {c}_mean / greatest(ok_mean, 1e-6))' for c in LAB)}) <= 0.5 flat from m join lab using (y, x)")
def flat_mask(spark, d):
    return plan.flat_mask(plan.prepare(fixtures.raster(spark, d)), 3, 0.5).select(*KEY, "flat")


_RUNS = """isl as (select image_id, y, x, x - row_number() over (partition by y order by x) i from mk where m),
runs as (select y, min(x) x0, max(x) x1, y::bigint * 4294967296 + min(x) node from isl group by y, i),
ln as (select a.node u, b.node v from runs a join runs b on a.y = b.y + 1 and b.x0 <= a.x1 and a.x0 <= b.x1), nb as (select u, v from ln union all select v, u from ln),
cc as (select node, node root from runs union select nb.v, cc.root from cc join nb on nb.u = cc.node where cc.root < nb.v),
rt as (select node, min(root) root from cc group by node), nm as (select root, (row_number() over (order by root) - 1)::int as label from (select distinct root from rt)),
comp as (select 'orders' image_id, y, unnest(range(x0, x1 + 1))::int x, label from runs join rt using (node) join nm using (root))"""


@query(f"with recursive {PX}, {MASK}, {_RUNS} select image_id, y, x, label from comp")
def components(spark, d):
    return regions.label_components(_masked(spark, d), "m")


@query(f"with recursive {PX}, {MASK}, {_RUNS} select image_id, label, count(*)::bigint size from comp group by all")
def component_sizes(spark, d):
    return regions.component_sizes(regions.label_components(_masked(spark, d), "m"))


def _labelled(spark, d) -> DataFrame:
    return plan.prepare(fixtures.raster(spark, d)).where("valid").withColumn("label", fixtures.block_label())


_BLOCKS = f"{PX}, u as (select *, (y // 20) * 7 + (x // 20) as label from px where a >= 24), {_lab_sql('lab', 'u')}"


@query(f"with {_BLOCKS} select image_id, label::int as label, count(*)::bigint size, {', '.join(f'round(avg({c}), 4) m_{c}' for c in LAB)} from lab group by 1, 2")
def component_means(spark, d):
    got = regions.component_means(_labelled(spark, d))
    return got.select("image_id", "label", "size", *(F.round(f"m_{c}", 4).alias(f"m_{c}") for c in LAB))


def _slope_sql(own: str, other: str, c: str) -> str:
    return f"case when var_pop(x) * var_pop(y) - pow(covar_pop(y, x), 2) > 1e-4 then (var_pop({other}) * covar_pop({c}, {own}) - covar_pop(y, x) * covar_pop({c}, {other})) / (var_pop(x) * var_pop(y) - pow(covar_pop(y, x), 2)) else 0 end"


_PLANES = f"pl as (select image_id, label, avg(y) cy, avg(x) cx, count(*) n, {', '.join(f'avg({c}) off_{c}, {_slope_sql("y", "x", c)} dy_{c}, {_slope_sql("x", "y", c)} dx_{c}' for c in LAB)} from lab group by 1, 2)"
_AT = {c: f"off_{c} + dy_{c} * (lab.y - cy) + dx_{c} * (lab.x - cx)" for c in LAB}


@query(f"with {_BLOCKS}, {_PLANES}, rs as (select label, greatest({', '.join(f'sqrt(avg(pow(lab.{c} - ({_AT[c]}), 2)))' for c in LAB)}) rms from lab join pl using (label) group by 1) select image_id, label::int as label, n::bigint size, round(cy, 4) cy, round(cx, 4) cx, {', '.join(f'round({k}_{c}, 4) + 0.0 {k}_{c}' for c in LAB for k in ('off', 'dy', 'dx'))}, round(rms, 4) rms from pl join rs using (label)")
def component_planes(spark, d):
    got = regions.component_planes(_labelled(spark, d))
    return got.select("image_id", "label", "size", *((F.round(c, 4) + 0.0).alias(c) for c in got.columns[3:]))


@query(f"with {_BLOCKS}, {_PLANES} select lab.image_id, lab.y, lab.x, lab.label::int as label, {', '.join(f'round({_AT[c]}, 5) + 0.0 {c}' for c in LAB)} from lab join pl using (label)")
def plane_paint(spark, d):
    held = _labelled(spark, d)
    got = regions.plane_field(held, regions.component_planes(held))
    return got.select(*KEY, "label", *((F.round(c, 5) + 0.0).alias(c) for c in LAB))


@query(f"""with recursive {PX}, {MASK}, {_RUNS} select 'orders' image_id, phase::int phase, u::int u, v::int v from (
 select distinct 0 phase, a.label u, b.label v from comp a join comp b on a.y = b.y and b.x = a.x + 1 where a.label <> b.label union all
 select distinct 1, a.label, b.label from comp a join comp b on a.x = b.x and b.y = a.y + 1 where a.label <> b.label union all
 select distinct 2 + (p.y // 20 = q.y // 20)::int, (p.y // 20) * 7 + p.x // 20, (q.y // 20) * 7 + q.x // 20 from px p join px q on (q.x, q.y) in ((p.x + 1, p.y), (p.x, p.y + 1)) where p.a >= 24 and q.a >= 24 and ((p.y // 20) * 7 + p.x // 20) <> ((q.y // 20) * 7 + q.x // 20))""")
def neighbour_pairs(spark, d):
    """Of components (none touch: phases 0 and 1 are empty) and of blocks (phases 3 and 2)."""
    one = regions.neighbour_pairs(regions.label_components(_masked(spark, d), "m"))
    two = regions.neighbour_pairs(_labelled(spark, d)).withColumn("phase", 3 - F.col("phase"))
    return one.unionByName(two)


def _seeded(spark, d) -> tuple[DataFrame, DataFrame]:
    held = plan.prepare(fixtures.raster(spark, d)).withColumn("label", fixtures.block_label())
    core = F.col("valid") & (F.col("y") % 20).between(6, 13) & (F.col("x") % 20).between(6, 13)
    held = stored(held.withColumn("label", F.when(core, F.col("label"))), "seeded")
    return held, held.where("label is not null")


_SEEDS = f"{PX}, {DIM}, u0 as (select *, a >= 24 valid from px), {_lab_sql('lab', 'u0', where='valid')}, sd as (select *, (y // 20) * 7 + (x // 20) as label from lab where valid and y % 20 between 6 and 13 and x % 20 between 6 and 13)"


def _grow_sql(models: str, at: dict[str, str], tol: float, rounds: int = 48) -> str:
    """Round by round: c<i> are the pixels that would join in round i, f<i> those that do, k<i> all that have a label by then."""
    d = f"greatest({', '.join(f'abs(p.{c} - ({at[c]}))' for c in LAB)})"
    out = [f"with {_SEEDS}, {models}, ct as (select h * w n, greatest(16, least(48, h // 32 + 8)) most from dim)", "f0 as materialized (select y, x, label from sd)", "k0 as materialized (select * from f0)"]
    for i in range(1, rounds + 1):
        out += [
            f"""c{i} as materialized (select y, x, label from (select p.y, p.x, f.label, row_number() over (partition by p.y, p.x order by {d}, o) i
 from f{i - 1} f, (values (1, 0, 0), (-1, 0, 1), (0, 1, 2), (0, -1, 3)) t(dy, dx, o) join lab p on p.y = f.y - t.dy and p.x = f.x - t.dx join md on md.label = f.label
 where {d} <= {tol} and not exists (select 1 from k{i - 1} k where k.y = p.y and k.x = p.x)) where i = 1)""",
            f"f{i} as materialized (select c.* from c{i} c, ct where {i} <= most and (select count(*) from c{i}) >= 0.001 * n)",
            f"k{i} as materialized (select * from k{i - 1} union all select * from f{i})",
        ]
    return ", ".join(out) + f" select 'orders' image_id, y, x, label::int as label from k{rounds}"


_MEANS = f"md as (select label, {', '.join(f'avg({c}) m_{c}' for c in LAB)} from sd group by 1)"


@query(_grow_sql(_MEANS, {c: f"m_{c}" for c in LAB}, 3.0))
def grow_labels(spark, d):
    held, seeds = _seeded(spark, d)
    return regions.grow(held, regions.component_means(seeds), 3.0, planes=False)


@query(_grow_sql(_PLANES.replace("pl as", "md as").replace("from lab", "from sd"), {c: f"off_{c} + dy_{c} * (p.y - cy) + dx_{c} * (p.x - cx)" for c in LAB}, 3.0))
def grow_planes(spark, d):
    held, seeds = _seeded(spark, d)
    return regions.grow(held, regions.component_planes(seeds), 3.0, planes=True)


def _pairs_sql(n: int, src: str) -> str:
    """pr<n>: touching labels of src (y, x, label), side by side first, each phase in order; names<n>: the labels with their places."""
    side = lambda phase, step: f"select distinct {phase} phase, a.label u, b.label v from {src} a join {src} b on b.y = a.y + {1 - step} and b.x = a.x + {step} where a.label <> b.label"
    return f"""names{n} as materialized (select label, row_number() over (order by label) i from (select distinct label from {src})),
pr{n} as materialized (select row_number() over (order by phase, u, v) j, a.i u, b.i v from ({side(0, 1)} union all {side(1, 0)}) p join names{n} a on a.label = p.u join names{n} b on b.label = p.v)"""


def _union_sql(n: int, models: str, near: str, passes: int) -> str:
    """to<n>: label and the place of its root among the roots, after ordered unions; the state is the list of roots by label's place. near compares the models p and q."""
    return f"""un{n} as (select 0::bigint j, (select list(i order by i) from names{n}) roots union all
 select j, case when roots[u] <> roots[v] and ok then list_transform(roots, lambda z: case when z = roots[v] then roots[u] else z end) else roots end from (
  select r.j + 1 j, r.roots, w.u, w.v, (select {near} from names{n} a, names{n} b, {models} p, {models} q where a.i = r.roots[w.u] and b.i = r.roots[w.v] and p.label = a.label and q.label = b.label) ok
  from un{n} r join pr{n} w on w.j = r.j % (select count(*) from pr{n}) + 1 where r.j < {passes} * (select count(*) from pr{n}))),
fin{n} as materialized (select unnest(roots) root, generate_subscripts(roots, 1) i from un{n} where j = (select max(j) from un{n})),
to{n} as materialized (select label, (dense_rank() over (order by root) - 1)::int as new from fin{n} join names{n} using (i))"""


_MERGE_MEANS = f"""with recursive {_BLOCKS}, md as materialized (select label, {', '.join(f'avg({c}) m_{c}' for c in LAB)} from lab group by 1), {_pairs_sql(0, 'lab')},
{_union_sql(0, 'md', ' and '.join(f'abs(p.m_{c} - q.m_{c}) <= 40.0' for c in LAB), 3)}
select image_id, new as label, count(*)::bigint size, {', '.join(f'round(avg({c}), 4) m_{c}' for c in LAB)} from lab join to0 using (label) group by 1, 2"""


@query(_MERGE_MEANS)
def merge_labels(spark, d):
    held = stored(_labelled(spark, d), "labelled")
    got = regions.merge_means(held.select(*KEY, "label"), regions.component_means(held), held.select(*KEY, *LAB), 40.0)[1]
    return got.select("image_id", "label", "size", *(F.round(f"m_{c}", 4).alias(f"m_{c}") for c in LAB))


def _merge_planes_sql(tol: float, slope_tol: float, passes: int = 3) -> str:
    """A pass is a fresh union over the planes of the labels so far, which are fitted anew after it."""
    near = " and ".join([f"abs(p.off_{c} - q.off_{c}) <= {tol}" for c in LAB] + [f"abs(p.{k}_{c} - q.{k}_{c}) <= {slope_tol}" for c in LAB for k in ("dy", "dx")])
    fit = lambda n, src: _PLANES.replace("pl as", f"pl{n} as materialized").replace("from lab", f"from {src}")
    out = [f"with recursive {_BLOCKS}, g0 as materialized (select * from lab), {fit(0, 'g0')}"]
    for n in range(passes):
        out += [_pairs_sql(n, f"g{n}"), _union_sql(n, f"pl{n}", near, 1), f"g{n + 1} as materialized (select g.* replace (new as label) from g{n} g join to{n} using (label))", fit(n + 1, f"g{n + 1}")]
    cols = ", ".join(f"round({c}, 4) + 0.0 {c}" for c in ["cy", "cx", *(f"{k}_{c}" for c in LAB for k in ("off", "dy", "dx"))])
    return ", ".join(out) + f" select image_id, label::int as label, {cols} from pl{passes}"


@query(_merge_planes_sql(40.0, 0.4))
def merge_planes(spark, d):
    held = stored(_labelled(spark, d), "labelled")
    got = regions.merge_planes(held.select(*KEY, "label"), regions.component_planes(held), held.select(*KEY, *LAB), 40.0, 0.4)[1]
    return got.select("image_id", "label", *((F.round(c, 4) + 0.0).alias(c) for c in got.columns if c not in ("image_id", "label")))


@query()
def clean_snap_plane(spark, d):
    return plan.clean(fixtures.raster(spark, d), Options(snap=True))


@query()
def clean_snap_constant(spark, d):
    return plan.clean(fixtures.raster(spark, d), Options(snap=True, snap_mode="constant"))


# ---------------------------------------------------------------- measurements
_BOTH = f"{PX}, {AFTER}, {DIM}, {BOTH}"
_TILES = "tl as (select image_id, (y - 4) // 32 ty, (x - 4) // 32 tx, stddev_pop(l1) s1, stddev_pop(l2) s2, avg(l2) m2, median(l1) p1, bool_and(valid) ok from both_, dim where y >= 4 and x >= 4 and (y - 4) // 32 < (h - 8) // 32 and (x - 4) // 32 < (w - 8) // 32 group by 1, 2, 3)"
_BEST = """tb as (select image_id, k::int "rank", (tx * 32 + 4)::int x, (ty * 32 + 4)::int y, round(s1, 3) std_before, round(s2, 3) + 0.0 std_after, round(m2 - p1, 3) + 0.0 bias_levels from (select *, row_number() over (order by case when ok then s1 else 'inf'::double end, ty, tx) k from tl) where k <= 4)"""


@query(f"with {_BOTH}, {_TILES} select image_id, ty::int ty, tx::int tx, round(case when ok then s1 else -1 end, 6)::double score from tl")
def tile_scores(spark, d):
    got = metrics.tile_scores(_both(spark, d))
    return got.select("image_id", F.col("ty").cast("int"), F.col("tx").cast("int"), F.when(F.col("score") == float("inf"), -1.0).otherwise(F.round("score", 6)).alias("score"))


@query(f"with {_BOTH}, {_TILES}, {_BEST} select * from tb")
def flattest_tiles(spark, d):
    return metrics.flattest_tiles(_both(spark, d), 4).withColumns({c: F.col(c) + 0.0 for c in ("std_after", "bias_levels")})


_DELTA = """dl as (select image_id, count(*) filter (seen)::bigint pixels_valid, round(avg(abs(l2 - l1)) filter (seen), 3) mean_abs_delta_levels, round(quantile_cont(abs(l2 - l1), 0.99) filter (seen), 3) p99_abs_delta_levels,
 round(max(abs(l2 - l1)) filter (seen), 3) max_abs_delta_levels, round(avg((abs(l2 - l1) > 2)::int) filter (seen), 5) frac_gt2_levels, round(avg((abs(l2 - l1) > 8)::int) filter (seen), 5) frac_gt8_levels, round(corr(l1, l2) filter (seen), 6) corr_luma from both_ group by 1)"""


@query(f"with {_BOTH}, {_DELTA} select * exclude (corr_luma) from dl")
def delta_stats(spark, d):
    return metrics.delta_stats(_both(spark, d)).drop("corr_luma")


@query(f"with {_BOTH}, {_DELTA} select image_id, corr_luma from dl")
def luma_corr(spark, d):
    return metrics.delta_stats(_both(spark, d)).select("image_id", "corr_luma")


_REN = f"""rd as (select image_id, abs({_rendered_sql('r2', 'g2', 'b2', 'a2')} - {_rendered_sql()}) d from both_), rn as (select image_id, round(max(d), 3) rendered_max_abs_delta_levels, round(avg(d), 3) rendered_mean_abs_delta_levels,
 round(quantile_cont(d, 0.99), 3) rendered_p99_abs_delta_levels, round(avg((d > 8)::int), 5) rendered_frac_gt8_levels from rd group by 1)"""


@query(f"with {_BOTH}, {_REN} select * from rn")
def rendered_stats(spark, d):
    return metrics.rendered_stats(_both(spark, d))


_FLAT = f"""{_median_sql('m1', 'both_', 'l1')}, {_median_sql('m2', 'both_', 'l2')}, {_lab_sql('la', 'both_')}, {_lab_sql('lb', 'la', LAB2, tail='2')},
fv as (select image_id, count(*)::bigint flat_px, round(avg(abs(l1 - l1_median)), 4) local_variation_flat_px_before, round(avg(abs(l2 - l2_median)), 4) local_variation_flat_px_after,
 round(quantile_cont(sqrt({' + '.join(f'pow({a} - {b}, 2)' for a, b in zip(LAB, LAB2))}), 0.99), 3) "max_deltaE_flat_px" from lb join m1 using (y, x) join m2 using (y, x), dim
 where y > 0 and x > 0 and y < h - 1 and x < w - 1 and valid and abs(l1 - l1_median) < 0.8 group by 1)"""


@query(f"with {_BOTH}, {_FLAT} select * from fv")
def flat_variation(spark, d):
    return metrics.flat_variation(_both(spark, d))


_SIGMAS = ", ".join(f"{_LAP.replace('lap as', f'lap{i} as').replace('from v p', f'from v{i} p').replace('join v n', f'join v{i} n')}, sg{i} as (select image_id, round({_SIGMA}, 4)::double {n} from lap{i} group by 1)" for i, n in ((1, "sigma_grain_before_levels"), (2, "sigma_grain_after_levels")))
_SUM = "ts as (select image_id, round(avg(std_before), 3) flat_tile_std_before_mean, round(avg(std_after), 3) flat_tile_std_after_mean, round(median(std_after), 3) flat_tile_std_after_median, count(*) filter (std_after <= 0.1)::bigint flat_tiles_cleaned, round(max(abs(bias_levels)), 3) flat_tile_bias_absmax from tb group by 1)"


@query(f"with {_BOTH}, v1 as (select *, l1 l from both_), v2 as (select image_id, y, x, l2 l, seen valid from both_), {_SIGMAS}, {_TILES}, {_BEST}, {_SUM}, {_DELTA}, {_REN}, {_FLAT} select * exclude (flat_px) from dl join rn using (image_id) join sg1 using (image_id) join sg2 using (image_id) left join ts using (image_id) left join fv using (image_id)")
def image_metrics(spark, d):
    got = metrics.image_metrics(fixtures.raster(spark, d), fixtures.raster(spark, d, grain=False), tiles=4)
    return got.drop("size", "render_background", "original_composited", "flat_tiles")


@query()
def metrics_text(spark, d):
    return metrics.metrics_text(metrics.image_metrics(fixtures.raster(spark, d), fixtures.raster(spark, d, grain=False), tiles=4))


_DETAIL = f"{PX}, {DIM}, {_box_sql('m', 'px', ['r', 'g', 'b'], 2)}, df as (select image_id, y, x, a, {', '.join(f'greatest(least({c} - {c}_mean, 48), -48) d_{c}' for c in 'rgb')} from m join px using (y, x))"


@query(f"with {_DETAIL} select image_id, y, x, a, {_r(('d_r', 'd_g', 'd_b'))} from df")
def detail_field(spark, d):
    got = stencil.detail_field(fixtures.raster(spark, d))
    return got.select(*KEY, "a", *((F.round(f"d_{c}", 6) + 0.0).alias(f"d_{c}") for c in "rgb"))


@query(f"with {_DETAIL} select image_id, y, x, {', '.join(f'floor(least(greatest(round(d_{c}, 6) * 12.5 + 128.01, 0), 255))::int {c}' for c in 'rgb')}, a from df")
def render_detail(spark, d):
    """At 12.5 with centre 128.01: exact half levels would fall either way with the order of additions."""
    field = stencil.detail_field(fixtures.raster(spark, d))
    field = field.withColumns({f"d_{c}": F.round(f"d_{c}", 6) + 0.01 / 12.5 for c in "rgb"})
    return stencil.render_detail(field, 12.5)


@query(f"""with {_DETAIL}, mg as (select *, (abs(d_r) + abs(d_g) + abs(d_b)) / 3 mg from df), bl as (select y // 32 ty, x // 32 tx, avg(mg) lv, bool_and(a >= 24) ok from mg, dim where y // 32 < h // 32 and x // 32 < w // 32 group by 1, 2),
 ct as (select quantile_cont(lv, 0.1) c from bl where ok), bs as (select avg(lv) base from bl, ct where ok and lv <= c) select 'orders' image_id, round(least(greatest(12 / greatest(coalesce((select base from bs), avg(mg)), 0.02), 1), 64), 4) gain from mg""")
def auto_gain(spark, d):
    field = stencil.detail_field(fixtures.raster(spark, d)).withColumn("valid", color.is_valid())
    return metrics.auto_gain(field).select("image_id", F.round("gain", 4).alias("gain"))


@query(f"with {PX}, {VALID} select image_id, round(quantile_cont(l, 0.5), 4) p50, round(least(greatest(80 / greatest(quantile_cont(l, 0.75) - quantile_cont(l, 0.25), 1), 1), 24), 4) gain from v group by 1")
def boost_stats(spark, d):
    got = metrics.boost_stats(_lit(fixtures.raster(spark, d)), "l")
    return got.select("image_id", F.round("p50", 4).alias("p50"), F.round("gain", 4).alias("gain"))


@query(f"""with {PX}, {VALID}, q as (select quantile_cont(l, 0.5) p50, least(greatest(80 / greatest(quantile_cont(l, 0.75) - quantile_cont(l, 0.25), 1), 1), 24) gain from v)
 select image_id, y, x, {', '.join(f'floor(least(greatest(({c} - p50) * gain + 110.0::double, 0), 255))::int {c}' for c in 'rgb')}, a from px, q""")
def boost(spark, d):
    return metrics.boost(fixtures.raster(spark, d))


@query(f"""with {PX}, {AFTER}, {DIM}, gy as (select unnest(range((select 2 * h + 16 from dim)))::int y), gx as (select unnest(range((select w from dim)))::int x)
 select 'orders' image_id, gy.y, gx.x, {', '.join(f'coalesce(p.{n}, q.{n}, 255)::int {n}' for n in 'rgba')} from gy, gx, dim left join px p on p.y = gy.y and p.x = gx.x left join ax q on q.y = gy.y - h - 16 and q.x = gx.x""")
def paste_below(spark, d):
    return figures.below(fixtures.raster(spark, d), fixtures.raster(spark, d, grain=False))


@query(f"with {PX} select image_id, ((y - 10) * 3 + i)::int y, ((x - 20) * 3 + j)::int x, r, g, b, a from px, range(3) a_(i), range(3) b_(j) where x >= 20 and x < 36 and y >= 10 and y < 34")
def crop_zoom(spark, d):
    return figures.zoom(figures.crop(fixtures.raster(spark, d), 20, 10, 16, 24), 3)


@query(f"with {PX}, {AFTER}, {DIM} select 'orders' image_id, gy::int y, gx::int x, coalesce(p.r, q.r, 255)::int r, coalesce(p.g, q.g, 255)::int g, coalesce(p.b, q.b, 255)::int b, coalesce(p.a, q.a, 255)::int a from dim, (select unnest(range((select h from dim))) gy), (select unnest(range(2 * (select w from dim) + 12)) gx) left join px p on p.y = gy and p.x = gx left join ax q on q.y = gy and q.x + 112 = gx")
def paste_beside(spark, d):
    return figures.beside(fixtures.raster(spark, d), fixtures.raster(spark, d, grain=False))


def _lanczos_sql(height: int, lobes: int = 3) -> str:
    """A pass along x, then one along y, by direct sums over all places within the filter."""
    sinc = lambda v: f"case when abs({v}) < 1e-12 then 1 else sin({v} * pi()) / ({v} * pi()) end"
    flat = ", ".join(f"round_even({n} * (a / 255.0::double) + (1.0::double - a / 255.0::double) * 255, 0) {n}" for n in "rgb")
    size = f"sz as (select greatest(1, floor(w * least(1, {height}.0::double / h)))::int mw, greatest(1, floor(h * least(1, {height}.0::double / h)))::int mh, h, w from dim)"
    out = [f"with {PX}, {DIM}, {size}, fl as (select y, x, {flat} from px)"]
    for name, src, axis, n, m, other in (("px1", "fl", "x", "w", "mw", "y"), ("px2", "px1", "y", "h", "mh", "x")):
        u = f"(({axis} + 0.5::double - (t + 0.5::double) * ({n}::double / {m})) / ({n}::double / {m}))"
        taps = f"{name}_t as (select {axis}, t, {u} u from (select distinct {axis} from {src}), sz, range(sz.{m}) r(t))"
        wt = f"({sinc('u')}) * ({sinc(f'(u / {lobes})')})"
        out.append(f"{taps}, {name}_w as (select *, {wt} wt from {name}_t where abs(u) < {lobes})")
        out.append(f"{name} as (select {other}, t::int as {axis}, {', '.join(f'sum({c} * wt) / sum(wt) {c}' for c in 'rgb')} from {src} join {name}_w using ({axis}) group by 1, 2)")
    level = ", ".join(f"least(greatest(round_even({c}, 0), 0), 255)::int {c}" for c in "rgb")
    return ", ".join(out) + f" select 'orders' image_id, y, x, {level}, 255::int a from px2"


@query(_lanczos_sql(60))
def downscale(spark, d):
    return figures.downscale(color.flatten(fixtures.raster(spark, d)), 60)


def _crops_sql(size: int) -> str:
    lab = f"{_lab_sql('c1', 'both_')}, {_lab_sql('c2', 'c1', LAB2, tail='2')}, cl as (select * replace ({', '.join(f'case when valid then {a} else {b} end as {a}' for a, b in zip(LAB, LAB2))}) from c2)"
    grad = "gr as (select p.y, p.x, coalesce(abs(p.l2 - w.l2), 0) + coalesce(abs(p.l2 - n.l2), 0) gradient from both_ p left join both_ w on w.y = p.y and w.x = p.x - 1 left join both_ n on n.x = p.x and n.y = p.y - 1)"
    al = "al as (select y, x, so, sc, gradient, abs(l2 - l1) dm, valid::int cv from s1 join s2 using (y, x) join gr using (y, x) join both_ using (y, x))"
    r = size // 2
    pick = "fl as (select y, x, case when cv_mean > 0.995 and so_mean < 1.5 then so_mean - sc_mean else -1e9 end cleaned, case when cv_mean > 0.995 and so_mean > 0.6 and so_mean < 6.0 then gradient_mean / (1 + dm_mean) else -1e9 end kept from bm)"
    one = lambda i, k: f"(select 'orders' image_id, {i}::int crop, '{k}' kind, greatest(least(x - {r}, w - {size}), 0)::int x, greatest(least(y - {r}, h - {size}), 0)::int y, {size}::int w, {size}::int h from fl, dim order by round({k}, 9) desc, fl.y, fl.x limit 1)"
    return f"with {_BOTH}, {lab}, {_spread_sql('s1', 'cl', 4, LAB, 'so')}, {_spread_sql('s2', 'cl', 4, LAB2, 'sc')}, {grad}, {al}, {_box_sql('bm', 'al', ['so', 'sc', 'gradient', 'dm', 'cv'], r)}, {pick} {one(1, 'cleaned')} union all {one(2, 'kept')}"


@query(_crops_sql(32))
def pick_crops(spark, d):
    return metrics.pick_crops(_both(spark, d), 32)


_SIZES_SQL = "select o_orderkey k, (16 + o_orderkey % 4081)::int w, (16 + o_orderkey * 31 % 4081)::int h, (1 + o_orderkey % 3)::int s, o_orderkey % 2 = 0 n from orders"


def _sizes(spark, d) -> DataFrame:
    """Sizes of pictures and settings, made of order numbers."""
    k = F.col("k")
    return _orders(spark, d).select("k", (k % 4081 + 16).cast("int").alias("w"), (k * 31 % 4081 + 16).cast("int").alias("h"), (k % 3 + 1).cast("int").alias("stride"), (k % 2 == 0).alias("snap"))


@query(f"select k, w, h, greatest(3, least(24, round_even(16.0::double * sqrt(w::double * h / 1572516.0::double), 0)))::int radius from ({_SIZES_SQL})")
def auto_radius(spark, d):
    return _sizes(spark, d).select("k", "w", "h", metrics.auto_radius(F.col("w"), F.col("h")).alias("radius"))


@query(f"select k, w, h, s stride, n snap, round(3.0 * pow(w::double * h / 1572516.0::double, 1.4::double) / case when s >= 2 then 3.4 else 1 end * case when n then 5 else 1 end, 3) as seconds from ({_SIZES_SQL})")
def estimate_seconds(spark, d):
    return _sizes(spark, d).withColumn("seconds", F.round(metrics.estimate_seconds(*(F.col(c) for c in ("w", "h", "stride", "snap"))), 3))


@query(f"with {PX}, nn as (select p.y, p.x, count(distinct (n.r, n.g, n.b)) k, count(*) c, bool_and(p.a >= 24) ok from px p, range(-1, 2) a_(dy), range(-1, 2) b_(dx) join px n on n.y = p.y + dy and n.x = p.x + dx group by 1, 2) select 'orders' image_id, round(avg((k = 1)::int), 6) uniform_share from nn where c = 9 and ok")
def uniform_share(spark, d):
    return metrics.uniform_share(_lit(fixtures.raster(spark, d)))


@query(f"with {PX}, {VALID} select p.image_id, d::int lag, round(median(pow(p.l - q.l, 2) / 2), 4) v from v p, (values (1), (4), (12)) t(d) join v q on q.y = p.y and q.x = p.x + d where p.valid and q.valid group by 1, 2")
def variogram(spark, d):
    return metrics.variogram(_lit(fixtures.raster(spark, d)), "l")


# ---------------------------------------------------------------- files
_ENDS = (".PNG", ".jpeg", ".txt", ".e.webp", ".tif", "")
_FILES_SQL = f"select o_orderkey k, '/in/' || case when o_orderkey % 4 = 0 then 'sub.d/' else '' end || 'p' || o_orderkey || (['{"', '".join(_ENDS)}'])[o_orderkey % {len(_ENDS)} + 1] path from orders"
_NAMES_SQL = f"f as (select k, path, regexp_replace(path, '[.][^./]*$', '-clean.png') beside from ({_FILES_SQL}) where regexp_matches(lower(path), '[.](png|jpg|jpeg|webp|bmp|tif|tiff|gif|ppm)$')), t as (select *, '/out/' || regexp_extract(beside, '[^/]*$') target from f)"


def _files(spark, d) -> DataFrame:
    """Paths of files, pictures and others, made of order numbers."""
    k = F.col("k")
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (k % len(_ENDS) + 1).cast("int"))
    path = F.concat(F.lit("/in/"), F.when(k % 4 == 0, "sub.d/").otherwise(""), F.lit("p"), k.cast("string"), end)
    return images.only_images(_orders(spark, d).select("k", path.alias("path")))


@query(f"with {_NAMES_SQL} select path, beside, target from t")
def output_names(spark, d):
    return _files(spark, d).select("path", images.output_path(F.col("path")).alias("beside"), images.output_path(F.col("path"), out_dir="/out").alias("target"))


@query(f"with {_NAMES_SQL} select path from t where target not in (select target from t where k % 3 = 0)")
def skip_existing(spark, d):
    files = _files(spark, d)
    there = files.where("k % 3 = 0").select(images.output_path(F.col("path"), out_dir="/out").alias("path"))
    return images.not_yet_done(files, there, out_dir="/out").select("path")


@query(f"""with {_NAMES_SQL} select path, case k % 5 when 1 then '/out/other-' || k || '-clean.png' else target end output, case when k % 5 < 2 and k % 2 = 0 and k % 15 <> 0 then 'skip' else 'clean' end as "action" from t""")
def batch_plan(spark, d):
    """What a batch does with each picture: two fifths are in the ledger, half of these under another name; of every other one the output is there; a fifteenth of the sources have changed since."""
    k = F.col("k")
    files = _files(spark, d).select("k", "path", F.regexp_extract("path", "^(.*)/", 1).alias("root"), F.lit(9).cast("long").alias("length"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    target = images.output_path(F.col("path"), out_dir="/out")
    known = files.where(k % 5 < 2).withColumn("output", F.when(k % 5 == 1, F.concat(F.lit("/out/other-"), k, F.lit("-clean.png"))).otherwise(target))
    known = known.withColumn("length", F.when(k % 15 == 0, 8).otherwise(9).cast("long"))
    book = known.select("path", "length", "modified", "output", F.lit("cleaned").alias("status"))
    there = known.where(k % 2 == 0).select(F.col("output").alias("path"))
    return ledger.planned(files.drop("k"), book, there, out_dir="/out").select("path", "output", "action")


@query("with b as (select 'img' || (o_orderkey // 2500) image_id, count(*) n from orders group by 1) select image_id, 50::int width, (n // 50)::int height, 'decoded' status from b")
def png_roundtrip(spark, d):
    """Encoded and decoded again; `decoded` if every pixel came back."""
    pixels = fixtures.batch(spark, d)
    back = images.decode_png(images.encode_png(pixels))
    same = pixels.join(shuffled(back.select(*KEY, *(F.col(c).alias(f"{c}2") for c in "rgba"))), list(KEY), "left")
    bad = F.count_if(~F.coalesce((F.col("r") == F.col("r2")) & (F.col("g") == F.col("g2")) & (F.col("b") == F.col("b2")) & (F.col("a") == F.col("a2")), F.lit(False)))
    return same.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.when(bad == 0, "decoded").otherwise("differs").alias("status"))


@query()
def report_json(spark, d):
    before = fixtures.raster(spark, d)
    done, info = plan.clean_with_info(before)
    return images.report_json(info, metrics.image_metrics(before, done, tiles=4))
