"""Properties on seeded pictures, and brute-force versions in numpy of what SQL can't say."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.model import LAB, Options, Params, auto_radius, estimate_seconds, parse_color
from rasterloom.operators import bilateral, figures, metrics, regions, stencil
from rasterloom.plans import clean as plan
from rasterloom.sources import images
from rasterloom.storage import stored
from rasterloom.streaming import folder


def picture(spark, rgba, name="p"):
    h, w, _ = rgba.shape
    y, x = np.mgrid[:h, :w]
    pdf = pd.DataFrame({"image_id": name, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32")})
    for i, c in enumerate("rgba"):
        pdf[c] = rgba[..., i].ravel().astype("int32")
    return spark.createDataFrame(pdf)


def field(spark, values, name="p", **more):
    h, w = values.shape
    y, x = np.mgrid[:h, :w]
    pdf = pd.DataFrame({"image_id": name, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": values.ravel()})
    for k, v in more.items():
        pdf[k] = v.ravel()
    return spark.createDataFrame(pdf)


def grid(df, cols, shape):
    pdf = df.toPandas()
    cols = list(cols) if cols == "rgba" or not isinstance(cols, str) else [cols]
    out = np.full((*shape, len(cols)), np.nan)
    out[pdf["y"], pdf["x"]] = pdf[cols].to_numpy(dtype=float)
    return out[..., 0] if len(cols) == 1 else out


def opaque(h, w, rgb, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    out = np.full((h, w, 4), 255.0)
    out[..., :3] = np.asarray(rgb, float)
    out[..., :3] += rng.normal(0, noise, (h, w, 3)) if noise else 0
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def cleaned(spark, rgba, **opts):
    return grid(plan.clean(picture(spark, rgba), Options(**opts)), "rgba", rgba.shape[:2])


@pytest.mark.parametrize("shape,r", [((24, 24), 5), ((3, 7), 4), ((1, 6), 2), ((5, 1), 3)])
def test_box_mean_equals_padded_sums(spark, shape, r):
    v = np.random.default_rng(1).normal(size=shape)
    got = grid(stencil.box_mean(field(spark, v), ["v"], r), "v_mean", shape)
    pad = np.pad(v, r, mode="reflect")
    want = np.array([[pad[y : y + 2 * r + 1, x : x + 2 * r + 1].mean() for x in range(shape[1])] for y in range(shape[0])])
    assert np.allclose(got, want)


def test_masked_box_mean_never_leaks(spark):
    v, ok = np.zeros((20, 20)), np.ones((20, 20), bool)
    v[:4, :4], ok[:4, :4] = 1e6, False
    got = grid(stencil.masked_box_mean(field(spark, v, ok=ok), ["v"], "ok", 4), "v_mean", v.shape)
    assert (got == 0).all()
    plain = stencil.masked_box_mean(field(spark, v, ok=np.ones_like(ok)), ["v"], "ok", 2).select("y", "x", "v_mean")
    assert np.allclose(grid(plain, "v_mean", v.shape), grid(stencil.box_mean(field(spark, v), ["v"], 2), "v_mean", v.shape))


@pytest.mark.parametrize("r", [1, 2, 3])
def test_dilate_erode_close(spark, r):
    m = np.random.default_rng(5).random((17, 23)) < 0.2
    df = field(spark, m.astype(float), m=m)
    want = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m)):
        for dy in range(-r, r + 1):
            for dx in range(-r + abs(dy), r - abs(dy) + 1):
                if 0 <= y + dy < 17 and 0 <= x + dx < 23:
                    want[y + dy, x + dx] = True
    assert (grid(stencil.dilate(df, "m", r, "o"), "o", m.shape) == want).all()
    once = stencil.close_mask(df, "m", r, "o")
    twice = stencil.close_mask(once.withColumn("m", F.col("o")), "m", r, "o")
    assert (grid(once, "o", m.shape) == grid(twice, "o", m.shape)).all()


def test_smooth_strategies_agree_and_constant_is_fixed(spark):
    rgba = opaque(40, 50, (70, 66, 80), 2.0)
    rgba[:6, :9, 3] = 0
    held = plan.prepare(picture(spark, rgba))
    one = grid(bilateral.smooth_relational(held, 4, 1.5), LAB, (40, 50))
    two = grid(bilateral.smooth_tiles(held, 4, 1.5, tile=16), LAB, (40, 50))
    assert np.allclose(one, two)
    flat = plan.prepare(picture(spark, opaque(20, 20, (120, 130, 140))))
    assert np.allclose(grid(bilateral.smooth_tiles(flat, 5, 1.5), LAB, (20, 20)), grid(flat, LAB, (20, 20)))


def test_grain_goes_and_colour_stays(spark):
    rgba = opaque(96, 96, (70, 66, 80), 1.0)
    out = cleaned(spark, rgba, radius=6)
    for i in range(3):
        assert out[..., i].std() < 0.6 * rgba[..., i].std()
        assert abs(out[..., i].mean() - rgba[..., i].mean()) < 0.4


def test_stroke_edge_and_ramp_survive(spark):
    stroke = opaque(60, 60, (200, 200, 200), 2.0, 2)
    stroke[:, 30:32, :3] = 120
    out = cleaned(spark, stroke, radius=6)
    assert out[:, :20, 0].mean() - out[:, 30:32, 0].mean() > 0.7 * 80
    ramp = opaque(40, 120, (0, 0, 0))
    ramp[..., :3] = np.clip(np.rint(np.linspace(200, 235, 120)[None, :, None] + np.random.default_rng(1).normal(0, 2, (40, 120, 3))), 0, 255)
    out = cleaned(spark, ramp, radius=6)
    assert np.corrcoef(out[..., 0].mean(0), np.linspace(200, 235, 120))[0, 1] > 0.99


def test_alpha_rules(spark):
    rgba = np.full((60, 60, 4), 200, np.uint8)
    rgba[..., 3] = 0
    rgba[10:50, 10:50, 3] = 253
    rgba[0, 0] = (255, 255, 255, 1)
    out = cleaned(spark, rgba)
    assert tuple(out[0, 0]) == (0, 0, 0, 0) and out[20, 20, 3] == 255
    assert cleaned(spark, rgba, alpha_mode="keep")[20, 20, 3] == 253
    info = plan.clean_with_info(picture(spark, rgba))[1].first()
    assert info["alpha_stray_zeroed_px"] == 1 and info["radius"] == 3


def test_low_alpha_keeps_its_colour(spark):
    rgba = opaque(40, 40, (90, 90, 90))
    rgba[:8] = (240, 240, 240, 20)
    out = cleaned(spark, rgba)
    assert (out[:6] == (240, 240, 240, 20)).all()


def test_flatten(spark):
    rgba = np.zeros((4, 4, 4), np.uint8)
    rgba[..., 3] = 128
    got = grid(color.flatten(picture(spark, rgba)), "rgba", (4, 4))
    assert set(got[..., 0].ravel()) <= {127.0, 128.0} and (got[..., 3] == 255).all()
    solid = opaque(5, 5, (1, 2, 3), 5)
    assert (grid(color.flatten(picture(spark, solid), (9, 9, 9)), "rgba", (5, 5)) == solid).all()


def brute_components(m):
    label, n = np.full(m.shape, -1), 0
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            if m[y, x] and label[y, x] < 0:
                stack, label[y, x] = [(y, x)], n
                while stack:
                    a, b = stack.pop()
                    for p, q in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= p < m.shape[0] and 0 <= q < m.shape[1] and m[p, q] and label[p, q] < 0:
                            label[p, q] = n
                            stack.append((p, q))
                n += 1
    return label


@pytest.mark.parametrize("p", [0.3, 0.6])
def test_components_equal_flood_fill(spark, p):
    m = np.random.default_rng(3).random((25, 31)) < p
    got = grid(regions.label_components(field(spark, m.astype(float), m=m), "m"), "label", m.shape)
    want = brute_components(m).astype(float)
    assert (np.nan_to_num(got, nan=-1.0) == want).all()


def test_spiral_is_one_component(spark):
    m = np.zeros((21, 21), bool)
    y = x = 0
    dy, dx = 0, 1
    m[0, 0] = True
    for _ in range(400):
        ny, nx = y + dy, x + dx
        ahead = (ny + dy, nx + dx)
        if not (0 <= ny < 21 and 0 <= nx < 21) or 0 <= ahead[0] < 21 and 0 <= ahead[1] < 21 and m[ahead]:
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            if not (0 <= ny < 21 and 0 <= nx < 21) or m[ny, nx]:
                break
        y, x = ny, nx
        m[y, x] = True
    assert brute_components(m).max() == 0
    got = regions.label_components(field(spark, m.astype(float), m=m), "m").select("label").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_empty_mask_and_table(spark):
    m = np.zeros((4, 4), bool)
    assert regions.label_components(field(spark, m.astype(float), m=m), "m").count() == 0
    none = spark.createDataFrame([], "image_id string, y int, x int, r int, g int, b int, a int")
    assert plan.clean(none).count() == 0


def lab_field(spark, lab, label=None, valid=None):
    h, w, _ = lab.shape
    y, x = np.mgrid[:h, :w]
    pdf = pd.DataFrame({"image_id": "p", "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32")})
    for i, c in enumerate(LAB):
        pdf[c] = lab[..., i].ravel()
    pdf["valid"] = True if valid is None else valid.ravel()
    df = spark.createDataFrame(pdf)
    return df if label is None else df.withColumn("label", F.lit(None).cast("int")) if (label < 0).all() else df.join(
        field(spark, label.astype(float)).select("image_id", "y", "x", F.when(F.col("v") >= 0, F.col("v").cast("int")).alias("label")), ["image_id", "y", "x"])


def test_exact_plane_is_recovered(spark):
    y, x = np.mgrid[:24, :32].astype(float)
    lab = np.stack([10 + 0.5 * y + 0.25 * x, 20 - 0.3 * y, 5 + 0.1 * x], -1)
    got = regions.component_planes(lab_field(spark, lab, np.zeros((24, 32), int))).first()
    assert abs(got["dy_lab_l"] - 0.5) < 1e-9 and abs(got["dx_lab_l"] - 0.25) < 1e-9 and abs(got["dy_lab_a"] + 0.3) < 1e-9 and got["rms"] < 1e-5
    strip = regions.component_planes(lab_field(spark, lab[:1], np.zeros((1, 32), int))).first()
    assert strip["dx_lab_l"] == 0.0


def brute_grow(lab, label, means, tol, rounds):
    out = label.copy()
    h, w = out.shape
    for _ in range(rounds):
        new = {}
        for y in range(h):
            for x in range(w):
                if out[y, x] >= 0:
                    continue
                best = None
                for o, (p, q) in enumerate(((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1))):
                    if 0 <= p < h and 0 <= q < w and out[p, q] >= 0:
                        d = np.abs(lab[y, x] - means[out[p, q]]).max()
                        if d <= tol and (best is None or d < best[0]):
                            best = (d, out[p, q])
                if best:
                    new[y, x] = best[1]
        if len(new) < max(1, 0.001 * h * w):
            return out
        for at, k in new.items():
            out[at] = k
    return out


def test_growth_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    lab = rng.normal(50, 0.4, (30, 36, 3))
    lab[:, 18:] += 1.2
    label = np.full((30, 36), -1)
    label[4:8, 4:8], label[20:24, 28:32] = 0, 1
    means = np.array([lab[label == k].mean(0) for k in (0, 1)])
    held = stored(lab_field(spark, lab, label), "t")
    got = regions.grow(held, regions.component_means(held.where("label is not null")), 1.1, planes=False)
    want = brute_grow(lab, label, means, 1.1, 16)
    assert (np.nan_to_num(grid(got, "label", label.shape), nan=-1.0) == want).all()


def test_merging_means_equals_brute_force(spark):
    # a chain 0 - 1 - 2 - 3: neighbours are close, the ends are not; the pair order decides who joins whom
    values = [10.0, 10.8, 11.6, 30.0]
    label = np.repeat(np.arange(4), 5)[None, :].repeat(6, 0)
    lab = np.stack([np.take(values, label)] * 3, -1)
    held = stored(lab_field(spark, lab, label), "t")
    labels, means = regions.merge_means(held.select("image_id", "y", "x", "label"), regions.component_means(held), held.select("image_id", "y", "x", *LAB), 1.0)
    # (0,1) join under 0; (1,2) compares root 0 (10.0) with 2 (11.6): too far in every pass, since means stay stale
    assert grid(labels, "label", label.shape)[0].tolist() == [0.0] * 10 + [1.0] * 5 + [2.0] * 5
    assert sorted(round(r["m_lab_l"], 6) for r in means.collect()) == [10.4, 11.6, 30.0]


def brute_merge(names, level, slope, pairs, tol, slope_tol, passes):
    """label to root by one ordered union over the whole picture."""
    above = {n: n for n in names}

    def root(n):
        while above[n] != n:
            n = above[n]
        return n

    for _ in range(passes):
        for u, v in pairs:
            a, b = root(u), root(v)
            if a != b and np.abs(level[a] - level[b]).max() <= tol and np.abs(slope[a] - slope[b]).max() <= slope_tol:
                above[b] = a
    return {n: root(n) for n in names if root(n) != n}


@pytest.mark.parametrize("kind", ["means", "planes"])
def test_clusters_merge_as_one_ordered_union_does(spark, kind):
    """Random region graphs of two pictures; chains merge through roots whose own models are near though the neighbours' are not."""
    rng = np.random.default_rng(len(kind))
    values, slopes = ([f"m_{c}" for c in LAB], []) if kind == "means" else ([f"off_{c}" for c in LAB], [f"{k}_{c}" for c in LAB for k in ("dy", "dx")])
    rows, links, want, sizes = [], [], set(), []
    for image in ("p", "q"):
        level, slope = rng.uniform(0, 9, (60, 3)) * (1, 0.1, 0.1) + 50.0 * (np.arange(60) % 3)[:, None], rng.uniform(0, 0.15, (60, len(slopes) or 1)) * bool(slopes)
        pairs = sorted({(int(rng.integers(0, 2)), *map(int, rng.choice(60, 2, replace=False))) for _ in range(200)})
        rows += [(image, i, *map(float, level[i]), *(map(float, slope[i]) if slopes else ())) for i in range(60)]
        links += [(image, *p) for p in pairs]
        want |= {(image, n, r) for n, r in brute_merge(range(60), level, slope, [p[1:] for p in pairs], 1.0, 0.12, 3).items()}
    models = stored(spark.createDataFrame(rows, "image_id string, label int, " + ", ".join(f"{c} double" for c in values + slopes)), "t")
    pairs = stored(spark.createDataFrame(links, "image_id string, phase int, u int, v int"), "t")
    got = {tuple(r) for r in regions._mapped(models, pairs, values, slopes, 1.0, 0.12, 3).select("image_id", "label", "root").collect()}
    assert got == want and len(want) > 12
    clusters = regions.merge_clusters(models, pairs, dict.fromkeys(values, 1.0) | dict.fromkeys(slopes, 0.12))
    assert clusters.select("image_id", "cluster").distinct().count() > 2


def test_merging_planes_refits(spark):
    label = np.repeat(np.arange(4), 5)[None, :].repeat(6, 0)
    lab = np.stack([np.take([10.0, 10.8, 11.2, 30.0], label)] * 3, -1)
    held = stored(lab_field(spark, lab, label), "t")
    labels, planes = regions.merge_planes(held.select("image_id", "y", "x", "label"), regions.component_planes(held), held.select("image_id", "y", "x", *LAB), 1.0, 0.5)
    # pass 1: 0+1 (10.4, refitted); 1-2 is 1.2 from root 0; pass 2: 10.4 and 11.2 join; 30 stays
    assert len(set(grid(labels, "label", label.shape)[0])) == 2 and planes.count() == 2


def test_merging_nothing_keeps_models(spark):
    label = np.repeat(np.arange(2), 5)[None, :].repeat(4, 0)
    lab = np.stack([np.take([10.0, 50.0], label)] * 3, -1)
    held = stored(lab_field(spark, lab, label), "t")
    before = regions.component_planes(held)
    labels, planes = regions.merge_planes(held.select("image_id", "y", "x", "label"), before, held.select("image_id", "y", "x", *LAB), 1.0, 0.5)
    assert (grid(labels, "label", label.shape) == label).all() and planes.count() == 2


@pytest.mark.parametrize("mode", ["plane", "constant"])
def test_snap_makes_a_block_one_colour(spark, mode):
    rgba = opaque(64, 64, (90, 92, 110), 1.2, 3)
    done, info = plan.clean_with_info(picture(spark, rgba), Options(snap=True, snap_mode=mode, radius=6))
    row = info.first()
    assert row["snapped_px"] > 0.5 * 64 * 64 and row["snapped_blocks"] >= 1
    out = grid(done, "rgba", (64, 64))
    assert out[..., 0].std() < 0.5


def test_snap_plane_follows_a_ramp_that_constant_flattens(spark):
    rgba = np.zeros((96, 96, 4), np.uint8)
    rgba[4:92, 4:92, 3] = 255
    rgba[..., :3] = 120
    rgba[..., 1] = np.rint(np.linspace(100, 114, 96))[None, :]
    stds = {m: np.nanstd(cleaned(spark, rgba, snap=True, snap_mode=m, radius=6)[20:76, 20:76, 1]) for m in ("plane", "constant")}
    assert stds["plane"] > 0.8 * rgba[20:76, 20:76, 1].std()
    assert stds["constant"] < stds["plane"]


def test_metrics_are_honest_about_compositing(spark):
    rgba = opaque(64, 64, (200, 200, 200), 1.0, 1)
    rgba[20:44, 20:44] = (30, 30, 30, 90)
    done = plan.clean(picture(spark, rgba), Options(alpha_mode="flatten"))
    naive = metrics.image_metrics(picture(spark, rgba), done).first()
    fair = metrics.image_metrics(picture(spark, rgba), done, composite=(255, 255, 255)).first()
    assert naive["max_abs_delta_levels"] > 50 and fair["max_abs_delta_levels"] < naive["max_abs_delta_levels"] / 5
    assert naive["pixels_valid"] == fair["pixels_valid"]
    assert len(naive["flat_tiles"]) == 1
    assert metrics.metrics_text(metrics.image_metrics(picture(spark, rgba), done)).first()["text"].count("\n") == 5


def test_small_picture_has_null_tile_figures(spark):
    m = metrics.image_metrics(*[picture(spark, opaque(16, 16, (90, 90, 90), 1))] * 2).first()
    assert m["flat_tiles"] is None and m["corr_luma"] is not None and m["sigma_grain_before_levels"] > 0


def test_detail_gain(spark):
    gains = []
    for noise in (0.5, 2.0, 3.0):
        f = stencil.detail_field(picture(spark, opaque(96, 96, (200, 200, 200), noise, 4))).withColumn("valid", color.is_valid())
        gains.append(metrics.auto_gain(f).first()["gain"])
    assert gains == sorted(gains, reverse=True)
    tiny = stencil.detail_field(picture(spark, opaque(16, 16, (9, 9, 9), 1))).withColumn("valid", color.is_valid())
    assert 1 <= metrics.auto_gain(tiny).first()["gain"] <= 64
    ramp = np.full((32, 32, 4), 255, np.uint8)
    ramp[..., :3] = np.arange(32)[None, :, None]
    assert np.abs(grid(stencil.detail_field(picture(spark, ramp)), "d_r", (32, 32))[:, 2:-2]).max() < 1e-9


def test_colours_and_settings():
    assert parse_color(" #FA0 ") == (255, 170, 0) and parse_color("black") == (0, 0, 0) and parse_color([1, 2, 3]) == (1, 2, 3)
    for bad in ("#12", "1,2,3", "zzzzzz", (1, 2), (0, 0, 256)):
        with pytest.raises(ValueError):
            parse_color(bad)
    p = Params.from_strings({"stride": "2", "snap": "false", "strength": "0.5", "radius": "junk", "unknown": "1", "write_report": "on"})
    assert (p.stride, p.snap, p.strength, p.radius, p.write_report) == (2, False, 0.5, 0, True)
    assert p.options().radius is None and Params(alpha="flatten", bg_color="#102030").measured_on() == ((16, 32, 48), (16, 32, 48)) and p.measured_on() == ((255, 255, 255), None)
    assert auto_radius(1254, 1254) == 16 and auto_radius(16, 16) == 3 and auto_radius(4096, 4096) == 24
    assert math.isclose(estimate_seconds(1254, 1254), 3.0) and estimate_seconds(1254, 1254, Params(stride=2)) < 1
    assert Params(stride=2).summary() == "stride=2" and Params().summary() == "default" and Options(strength=9).sigma_range == 8.0


def test_crop_is_clipped_and_downscale_keeps_a_constant(spark):
    df = picture(spark, opaque(20, 30, (50, 60, 70)))
    assert figures.crop(df, 25, 15, 50, 50).count() == 25 and figures.crop(df, 40, 0, 5, 5).count() == 0
    small = grid(figures.downscale(df, 10), "rgba", (10, 15))
    assert (small == (50, 60, 70, 255)).all()


def test_files_round_trip(spark, tmp_path):
    clear, solid = opaque(70, 40, (10, 20, 30), 9, 1), opaque(5, 6, (200, 100, 50), 9, 2)
    clear[..., 3] = np.random.default_rng(1).integers(0, 256, (70, 40))
    images.save_images(picture(spark, clear, "a/clear.png").unionByName(picture(spark, solid, "b/Solid.PNG")), str(tmp_path / "in"), "")
    (tmp_path / "in" / "bad.png").write_bytes(b"no picture")
    (tmp_path / "in" / "note.txt").write_text("x")
    pixels, errors = images.read_images(spark, str(tmp_path / "in"))
    assert [r["path"].rsplit("/", 1)[-1] for r in errors.collect()] == ["bad.png"]
    for name, want in (("clear.png", clear), ("Solid.png", solid)):
        got = grid(pixels.where(F.col("image_id").endswith(name)), "rgba", want.shape[:2])
        assert (got == want).all()
    assert (tmp_path / "in" / "Solid.png").read_bytes()[25] == 2 and (tmp_path / "in" / "clear.png").read_bytes()[25] == 6
    assert [r["path"].rsplit("/", 1)[-1] for r in images.list_images(spark, str(tmp_path / "in")).collect()] == ["Solid.png", "bad.png", "clear.png"]


def test_stream_cleans_new_files(spark, tmp_path):
    images.save_images(picture(spark, opaque(20, 20, (90, 80, 70), 1), "one"), str(tmp_path / "in"))
    folder.clean_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    assert [p.name for p in (tmp_path / "out").glob("*.png")] == ["one-clean.png"]
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "image_id string, seq int, v string")
    assert sorted(r["v"] for r in folder.latest(rows).collect()) == ["new", "only"]


def test_pictures_of_one_name_keep_files_of_their_own(spark, tmp_path):
    both = picture(spark, opaque(8, 8, (9, 8, 7), 0), "x/a.png").unionByName(picture(spark, opaque(8, 8, (90, 80, 70), 0), "y/a.png")).unionByName(picture(spark, opaque(8, 8, (1, 2, 3), 0), "y/b.png"))
    images.save_images(both, str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").glob("*.png"))
    assert len(names) == 3 and names[-1] == "b.png" and all(n.startswith("a-") for n in names[:2])


def test_public_names():
    import rasterloom

    assert all(hasattr(rasterloom, n) for n in rasterloom.__all__)


def test_command_line(spark, tmp_path, capsys):
    from rasterloom import cli

    images.save_images(picture(spark, opaque(48, 48, (90, 80, 70), 1), "one"), str(tmp_path / "in"))
    assert cli.main(["clean", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--report"]) == 0
    assert {p.name for p in (tmp_path / "out").iterdir()} >= {"one-clean.png", "one-report.json"}
    assert cli.main(["clean", str(tmp_path / "in"), "-o", str(tmp_path / "out")]) == 0
    assert "cleaned 0" in capsys.readouterr().out
    assert cli.main(["compare", str(tmp_path / "in" / "one.png"), "-o", str(tmp_path / "cmp"), "--crop", "4,4,20,20"]) == 0
    assert {"overview.png", "detail-1-4_4.png"} <= {p.name for p in (tmp_path / "cmp").iterdir()}


def grey_alpha_png(grid, depth=8, laced=0):
    """A grey PNG with alpha of (h, w, 2) bytes, whose lines take the five filters in turn."""
    import struct
    import zlib

    h, w, _ = grid.shape
    wide = np.repeat(grid, depth // 8, axis=2).astype(int).reshape(h, -1)
    step, raw = depth // 4, b""
    for y in range(h):
        up = wide[y - 1] if y else np.zeros(w * step, int)
        left, corner = (np.r_[np.zeros(step, int), v[:-step]] for v in (wide[y], up))
        p = left + up - corner
        near = np.stack([left, up, corner])
        paeth = np.take_along_axis(near, np.abs(p - near).argmin(0)[None], 0)[0]
        guess = (0 * up, left, up, (left + up) // 2, paeth)[y % 5]
        raw += bytes([y % 5]) + ((wide[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 4, 0, 0, laced))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_alpha_of_grey_pictures_is_kept(spark, tmp_path):
    rng = np.random.default_rng(19)
    grid = rng.integers(0, 256, (23, 17, 2))
    for depth in (8, 16):
        assert (images.grey_alpha(grey_alpha_png(grid, depth)) == grid[:, :, 1].ravel()).all()
    (tmp_path / "a + b la.png").write_bytes(grey_alpha_png(grid))
    flat = np.full((4, 4, 2), (90, 10))
    (tmp_path / "flat.png").write_bytes(grey_alpha_png(flat))
    pixels, errors = images.read_images(spark, str(tmp_path))
    got = pixels.where("image_id like '%la.png'").orderBy("y", "x").toPandas()
    assert (got["a"].to_numpy() == grid[:, :, 1].ravel()).all() and errors.count() == 0
    assert pixels.where("image_id like '%/flat.png'").select("r", "a").distinct().count() == 1
    assert pixels.where("image_id like '%/flat.png' and a = 10 and r = g and g = b").count() == 16


def test_stream_keeps_the_alpha_of_grey_pictures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    grid = np.full((32, 32, 2), (90, 120))
    (tmp_path / "in" / "grey [1].png").write_bytes(grey_alpha_png(grid))
    folder.clean_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    pixels, errors = images.read_images(spark, str(tmp_path / "out"))
    assert {r["a"] for r in pixels.select("a").distinct().collect()} == {120} and pixels.count() == 1024 and errors.count() == 0
