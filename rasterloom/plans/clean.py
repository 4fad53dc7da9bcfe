"""The cleaning pipeline: pixels in, cleaned pixels and an info row per picture out; all pictures in one query."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..model import KEY, LAB, Options
from ..operators import alpha, regions, stencil
from ..operators.bilateral import smooth
from ..operators.metrics import auto_radius as radius_of
from ..operators.metrics import robust_sigma
from ..operators.quantiles import exact_quantiles
from ..storage import shuffled, stored, with_facts


def prepare(pixels: DataFrame) -> DataFrame:
    """pixels plus `valid` and Lab (0 where not valid)."""
    held = pixels.select(*KEY, *(F.col(c).cast("int").alias(c) for c in "rgba")).withColumn("valid", color.is_valid())
    return color.with_lab(held, valid=F.col("valid"))


def flat_mask(lab: DataFrame, radius: int, tol: float) -> DataFrame:
    """lab (key, valid, Lab) plus `flat`: valid and within tol of the local mean of valid pixels in every channel."""
    out = stencil.masked_box_mean(lab, LAB, "valid", max(4, radius * 2 // 3))
    near = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}_mean")) for c in LAB)) <= tol
    return out.withColumn("flat", F.col("valid") & near).drop(*(f"{c}_mean" for c in LAB))


def snap(lab: DataFrame, radius: int, opts: Options) -> tuple[DataFrame, DataFrame]:
    """(Lab after repainting flat regions, image_id/snapped_px/snapped_blocks). lab: key, valid, Lab, a stored table."""
    mask = flat_mask(lab, radius, opts.snap_tol).select(*KEY, "flat")
    if opts.close_radius:
        mask = stencil.close_mask(mask, "flat", opts.close_radius, "flat")
    mask = stored(stencil.erode(mask, "flat", opts.aa_band, "flat"), "flat")
    labels = stored(regions.label_components(mask, "flat"), "labels")
    labelled = lab.join(shuffled(labels), list(KEY))
    planes = opts.snap_mode == "plane"
    models = stored(regions.component_planes(labelled) if planes else regions.component_means(labelled), "models")
    good = models.where(F.col("size") >= opts.min_block)
    if planes:
        middle = exact_quantiles(good, ["image_id"], "rms", [0.5])
        limit = middle.select("image_id", F.greatest(F.lit(0.5), F.col("q")[0] * opts.plane_tol).alias("_limit"))
        good = good.join(limit, "image_id").where("rms <= _limit")
    good = stored(good.select("image_id", "label"), "seeds")
    seeds = labelled.where("valid").join(good, ["image_id", "label"], "left_semi").select(*KEY, "label")
    field = stored(lab.select(*KEY, *LAB).join(shuffled(seeds), list(KEY), "left"), "field")
    # a picture without a seed is left as it is
    models = models.join(good.select("image_id").distinct(), "image_id", "left_semi")
    grown = stored(regions.grow(field, models, opts.snap_tol, planes), "grown")
    plain = stored(lab.select(*KEY, *LAB), "plain")
    if planes:
        grown, fitted = regions.merge_planes(grown, models, plain, opts.merge_tol, opts.slope_tol)
        paint = regions.plane_field(grown, fitted)
    else:
        grown, fitted = regions.merge_means(grown, models, plain, opts.merge_tol)
        paint = grown.join(fitted, ["image_id", "label"]).select(*KEY, *(F.col(f"m_{c}").alias(c) for c in LAB))
    paint = paint.select(*KEY, *(F.col(c).alias(f"p_{c}") for c in LAB))
    out = lab.join(shuffled(paint), list(KEY), "left").select(*KEY, *(F.coalesce(f"p_{c}", c).alias(c) for c in LAB))
    counts = fitted.groupBy("image_id").agg(F.count(F.lit(1)).alias("snapped_blocks"))
    counts = grown.groupBy("image_id").agg(F.count(F.lit(1)).alias("snapped_px")).join(counts, "image_id")
    return out, counts.select("image_id", "snapped_px", "snapped_blocks")


def _clean_at(pixels: DataFrame, radius: int, opts: Options, strategy: str) -> tuple[DataFrame, DataFrame | None]:
    held = prepare(pixels)
    if not opts.snap:  # pixels that aren't valid get their source colour back anyway
        smoothed, snapped = smooth(held.where("valid"), radius, opts.sigma_range, opts.stride, strategy), None
    else:
        smoothed = smooth(held, radius, opts.sigma_range, opts.stride, strategy)
        smoothed = stored(held.select(*KEY, "valid").join(shuffled(smoothed), list(KEY)), "smoothed")
        smoothed, snapped = snap(smoothed, radius, opts)
    shown = color.with_srgb(smoothed).select(*KEY, *(color.to_byte(F.col(f"s{c}")).alias(f"n_{c}") for c in "rgb"))
    out = held.drop(*LAB).join(shuffled(shown), list(KEY), "left")
    out = out.select(*KEY, *(F.when(F.col("valid"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"), "a")
    out = alpha.apply_alpha(alpha.alpha_flags(out), opts.alpha_mode).drop("interior", "stray")
    if opts.alpha_mode == "flatten":
        out = color.flatten(out, opts.bg_color)
    return out.select(*KEY, *"rgba"), snapped


def clean(pixels: DataFrame, opts: Options | None = None, strategy: str = "auto") -> DataFrame:
    """Cleaned pixels (image_id, y, x, r, g, b, a). Nothing is measured for an info row."""
    return _cleaned(pixels, opts or Options(), strategy)[0]


def clean_with_info(pixels: DataFrame, opts: Options | None = None, strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(cleaned pixels, one info row per picture)."""
    opts = opts or Options()
    done, snapped = _cleaned(pixels, opts, strategy)
    return done, info(pixels, opts, None if opts.radius is None else F.lit(opts.radius), snapped)


def _cleaned(pixels: DataFrame, opts: Options, strategy: str) -> tuple[DataFrame, DataFrame | None]:
    """(cleaned pixels, counts of snapped ones). Pictures are grouped by radius where it is automatic."""
    if opts.radius is not None:
        return _clean_at(pixels, opts.radius, opts, strategy)
    sizes = stored(stencil.dims(pixels).select("image_id", radius_of(F.col("_w"), F.col("_h")).alias("_radius")), "sizes")
    done = snapped = None
    by_radius = sorted(r[0] for r in sizes.select("_radius").distinct().collect())  # 3 to 24: at most 22 numbers, however many pictures
    sized = pixels if len(by_radius) == 1 else with_facts(pixels, sizes)
    for radius in by_radius:
        part = sized if len(by_radius) == 1 else sized.where(F.col("_radius") == radius)
        got, more = _clean_at(part.drop("_radius"), radius, replace(opts, radius=radius), strategy)
        done = got if done is None else done.unionByName(got)
        snapped = more if snapped is None else snapped.unionByName(more)
    if done is None:
        done = pixels.select(*KEY, *"rgba")
    return done, snapped


def info(pixels: DataFrame, opts: Options, radius=None, snapped: DataFrame | None = None) -> DataFrame:
    """What was measured and done, per picture. The measured noise is reported only; no pixel depends on it."""
    held = prepare(pixels).withColumn("l1", color.luma())
    flags = alpha.alpha_counters(alpha.alpha_flags(pixels))
    out = stencil.dims(pixels)
    lab = robust_sigma(held, LAB[0], out="_sl")
    out = out.join(lab, "image_id").join(robust_sigma(held, "l1", out="_ss"), "image_id").join(flags, "image_id")
    if snapped is not None:
        out = out.join(snapped, "image_id", "left")
    else:
        out = out.withColumns({"snapped_px": F.lit(0).cast("long"), "snapped_blocks": F.lit(0).cast("long")})
    sigma = F.col("_sl") if opts.sigma_grain is None else F.lit(float(opts.sigma_grain))
    return out.select(
        "image_id", F.array("_w", "_h").alias("size"), F.round(sigma, 4).alias("sigma_grain_lab"), F.round("_ss", 4).alias("sigma_grain_srgb_levels"),
        (radius if radius is not None else radius_of(F.col("_w"), F.col("_h"))).alias("radius"), F.lit(round(opts.sigma_range, 3)).alias("sigma_range"), F.lit(opts.stride).alias("stride"),
        F.lit(opts.snap).alias("snap"), F.coalesce("snapped_px", F.lit(0)).alias("snapped_px"), F.coalesce("snapped_blocks", F.lit(0)).alias("snapped_blocks"),
        F.lit(opts.alpha_mode).alias("alpha_mode"), F.array(*map(F.lit, opts.bg_color)).alias("bg_color"), "alpha_interior_snapped_px", "alpha_stray_zeroed_px",
    )
