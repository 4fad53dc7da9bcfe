"""Batches of files: names, skipping, the ledger, reports; pictures as strips."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import cli
from rasterloom.model import Options
from rasterloom.operators import metrics, strips
from rasterloom.operators import alpha as alpha_rules
from rasterloom.operators.quantiles import exact_quantiles
from rasterloom.plans import clean as plan
from rasterloom.sources import images, ledger
from rasterloom.storage import stored

from .test_raster import grey_alpha_png, grid, opaque, picture


def pixmap(rgba, kind="P6"):
    h, w = rgba.shape[:2]
    flat = rgba[..., :3].reshape(-1, 3)
    body = flat.tobytes() if kind == "P6" else "\n".join(" ".join(map(str, p)) for p in flat).encode()
    return f"{kind}\n# made here\n{w} {h}\n255\n".encode() + body


def put(path, rgba):
    os.makedirs(path.parent, exist_ok=True)
    path.write_bytes(pixmap(rgba))


def said(capsys):
    return capsys.readouterr().out.strip().splitlines()


def test_names_depend_on_the_path_alone_and_runs_skip_what_is_done(spark, tmp_path, capsys):
    src, out = tmp_path / "in", tmp_path / "out"
    put(src / "x" / "a.ppm", opaque(20, 20, (90, 80, 70), 1, 1))
    go = ["clean", str(src), "--recursive", "-o", str(out), "--radius", "3"]
    assert cli.main(go) == 0 and (out / "x" / "a-clean.png").exists()
    put(src / "y" / "a.ppm", opaque(20, 20, (10, 80, 70), 1, 2))
    put(src / "x" / "a.PPM", opaque(20, 20, (1, 80, 170), 1, 3))  # asks for the name that x/a.ppm has
    (src / "bad.png").write_bytes(b"no picture")
    said(capsys)
    assert cli.main(go) == 1
    lines = said(capsys)
    assert lines[-1] == "cleaned 2, skipped 1, failed 1" and f"failed {src}/bad.png: can't be decoded" in lines and f"skipped {src}/x/a.ppm: exists" in lines
    made = sorted(str(p.relative_to(out)) for p in out.rglob("*.png"))
    assert made[1:] == ["x/a-clean.png", "y/a-clean.png"] and made[0].startswith("x/a-") and len(made) == 3
    # the failed one is tried again, the others are done
    assert cli.main(go) == 1 and said(capsys)[-1] == "cleaned 0, skipped 3, failed 1"
    # a source that changed is cleaned again, under its name
    os.remove(src / "bad.png")
    put(src / "y" / "a.ppm", opaque(24, 20, (10, 80, 70), 1, 2))
    assert cli.main(go) == 0 and said(capsys)[-1] == "cleaned 1, skipped 2, failed 0"
    book = {r["path"]: r for r in ledger.known(spark, str(out / "_ledger")).collect()}
    assert book[f"{src}/bad.png"]["status"] == "failed" and book[f"{src}/y/a.ppm"]["output"] == f"{out}/y/a-clean.png"


def test_results_stand_beside_their_sources(spark, tmp_path, capsys):
    put(tmp_path / "one.ppm", opaque(40, 30, (90, 80, 70), 1, 1))
    assert cli.main(["clean", str(tmp_path), "--radius", "3"]) == 0 and (tmp_path / "one-clean.png").exists()
    said(capsys)
    assert cli.main(["clean", str(tmp_path), "--radius", "3"]) == 0 and said(capsys)[-1] == "cleaned 0, skipped 1, failed 0"
    report = tmp_path / "deep" / "numbers.json"
    assert cli.main(["clean", str(tmp_path / "one.ppm"), "-o", str(tmp_path / "named.png"), "--radius", "3", "--report", str(report)]) == 0
    assert (tmp_path / "named.png").exists() and set(json.loads(report.read_text())) == {"info", "metrics"}
    assert cli.main(["clean", str(tmp_path / "nowhere.png")]) == 2
    assert cli.main(["compare", str(tmp_path / "one.ppm"), "--radius", "3", "--suffix=-fine", "--no-auto-crop"]) == 0
    about = json.loads((tmp_path / "one-compare" / "report.json").read_text())["info"]
    assert (tmp_path / "one-fine.png").exists() and about == {"input": f"{tmp_path}/one.ppm", "cleaned": f"{tmp_path}/one-fine.png"}


def ragged(h, w, seed):
    rng = np.random.default_rng(seed)
    rgba = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
    rgba[: h // 2, :, :3] = 128 + rng.integers(-3, 4, (h // 2, w, 3))
    rgba[5:-5, 5:-5, 3] = 253
    rgba[:3, :, 3] = rng.integers(0, 3, (3, w))
    return rgba


@pytest.mark.parametrize("opts", [Options(radius=5), Options(radius=70, stride=9, alpha_mode="keep"), Options(radius=3, alpha_mode="flatten", bg_color=(9, 80, 200))])
def test_strips_clean_as_pixels_do(spark, opts):
    rgba = ragged(150, 37, opts.radius)
    held = stored(strips.from_pixels(picture(spark, rgba)), "t")
    assert held.count() == 3 and (grid(strips.to_pixels(held), "rgba", (150, 37)) == rgba).all()
    want = grid(plan.clean(picture(spark, rgba), opts), "rgba", (150, 37))
    assert (grid(strips.to_pixels(strips.clean_strips(held, opts, np.float64)), "rgba", (150, 37)) == want).all()
    single = grid(strips.to_pixels(strips.clean_strips(held, opts)), "rgba", (150, 37))
    assert np.abs(single.astype(int) - want).max() <= 1 and (single != want).mean() < 1e-3


def test_strips_measure_as_pixels_do(spark):
    rgba = ragged(150, 37, 2)
    held = stored(strips.from_pixels(picture(spark, rgba)), "t")
    flags = alpha_rules.alpha_counters(alpha_rules.alpha_flags(picture(spark, rgba))).first()
    assert strips.alpha_counts(held).first() == flags
    lab = plan.prepare(picture(spark, rgba))
    sigma = metrics.robust_sigma(lab, "lab_l").first()["sigma"]
    got = {r["name"]: r for r in exact_quantiles(strips.noise_values(held), ["image_id", "name"], "v", [0.5], "n").collect()}
    assert sigma > 0 and np.isclose(got["lab"]["q"][0] * np.sqrt(np.pi / 2) / 6, sigma)


def test_blocks_of_the_kernel_make_no_difference(monkeypatch):
    rng = np.random.default_rng(5)
    lab, ok = rng.normal(50, 2, (3, 40, 90)), rng.random((40, 90)) < 0.8
    got = []
    for size in (64, 32768):
        monkeypatch.setattr(strips, "BLOCK", size)
        got.append(strips.local_mean(lab, ok, 7, 33, 6, 1.5, 1, np.float64)[:, ok[7:33]])
    assert (got[0] == got[1]).all()


def test_pictures_are_written_band_by_band(spark, tmp_path):
    one, two = ragged(300, 41, 1), opaque(200, 70, (1, 2, 3), 5, 2)
    both = picture(spark, one, "a").unionByName(picture(spark, two, "b"))
    names = spark.createDataFrame([("a", "deep/a 1.png"), ("b", "b#2.png")], "image_id string, name string")
    images.save_strips(stored(strips.from_pixels(both), "t"), names, str(tmp_path / "out dir"))
    assert sorted(p.name for p in (tmp_path / "out dir").rglob("*")) == ["a 1.png", "b#2.png", "deep"]
    for name, want in (("deep/a 1.png", one), ("b#2.png", two)):
        back, errors = images.read_images(spark, str(tmp_path / "out dir" / name))
        assert (grid(back, "rgba", want.shape[:2]) == want).all() and errors.isEmpty()


def laced(grid_):
    """An interlaced grey PNG with alpha, unfiltered."""
    import struct
    import zlib

    h, w, _ = grid_.shape
    raw = b""
    for y0, x0, dy, dx in ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)):
        part = grid_[y0::dy, x0::dx].astype(np.uint8)
        if part.size:
            raw += b"".join(b"\x00" + line.tobytes() for line in part)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 4, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape", [(23, 17), (1, 1), (3, 2), (8, 9)])
def test_interlaced_grey_pictures_keep_their_alpha(shape):
    g = np.random.default_rng(3).integers(0, 256, (*shape, 2))
    assert (images.grey_alpha(laced(g)) == g[:, :, 1].ravel()).all() and (images.grey_alpha(grey_alpha_png(g)) == g[:, :, 1].ravel()).all()


def test_pixmaps_and_interlaced_files_are_read(spark, tmp_path):
    rgba, g = opaque(9, 7, (200, 90, 10), 9, 4), np.random.default_rng(3).integers(0, 256, (23, 17, 2))
    (tmp_path / "a.ppm").write_bytes(pixmap(rgba))
    (tmp_path / "b.PPM").write_bytes(pixmap(rgba, "P3"))
    (tmp_path / "c.png").write_bytes(laced(g))
    (tmp_path / "short.ppm").write_bytes(b"P6 9 9 255\n123")
    pixels, errors = images.read_images(spark, str(tmp_path))
    assert [r["path"] for r in errors.collect()] == [f"{tmp_path}/short.ppm"]
    for name in ("a.ppm", "b.PPM"):
        assert (grid(pixels.where(F.col("image_id").endswith(name)), "rgba", (9, 7)) == rgba).all()
    c = pixels.where("image_id like '%c.png'").orderBy("y", "x").toPandas()
    assert (c["a"].to_numpy() == g[:, :, 1].ravel()).all() and (c["r"].to_numpy() == g[:, :, 0].ravel()).all()
    assert images._ppm(b"P5 2 1 65535\n\x00\x00\xff\xff") == (1, 2, 1, b"\x00\xff") and images._ppm(b"P4 8 8 1\n")[3] is None
