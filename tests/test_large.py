"""Plans that tables of pixels need: no broadcast of pixels, and no picture in one task."""

import re

import numpy as np
import pytest

from rasterloom.model import KEY, LAB
from rasterloom.operators import bilateral, metrics, regions
from rasterloom.plans import clean
from rasterloom.queries import QUERIES
from rasterloom.storage import stored, with_facts

from .test_raster import grid, lab_field


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of what the regions' steps store."""
    seen = []

    def noted(df, name):
        seen.append(plan_of(df))
        return stored(df, name)

    monkeypatch.setattr(regions, "stored", noted)
    return seen


def pixels_broadcast(plan: str) -> bool:
    return bool(re.search(r"BroadcastHashJoin \[image_id#\d+, y#\d+, x#\d+\]", plan))


@pytest.mark.parametrize("kind", ["means", "planes"])
def test_merging_broadcasts_no_pixels(spark, plans, kind):
    label = np.repeat(np.arange(4), 5)[None, :].repeat(6, 0)
    lab = np.stack([np.take([10.0, 10.8, 11.2, 30.0], label)] * 3, -1)
    held = stored(lab_field(spark, lab, label), "t")
    labels, colours = held.select(*KEY, "label"), held.select(*KEY, *LAB)
    if kind == "means":
        got = regions.merge_means(labels, regions.component_means(held), colours, 1.0)
    else:
        got = regions.merge_planes(labels, regions.component_planes(held), colours, 1.0, 0.5)
    plans += [plan_of(df) for df in got]
    assert any("SortMergeJoin [image_id" in p for p in plans) and not any(map(pixels_broadcast, plans))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_clusters_of_a_long_chain(spark, monkeypatch, plans, limit):
    """Boxes that grow link by link: as many rounds of jobs as links before, one now; and the same clusters by rounds over the table."""
    monkeypatch.setattr(regions, "UNION_PAIRS", limit)
    n = 12 if limit else 5
    # every other region lies beside the one before; the rest comes within reach only as the box grows
    rows = [("p", i, float(-i if i % 2 else i)) for i in range(n)] + [("p", n, 900.0)]
    models = stored(spark.createDataFrame(rows, "image_id string, label int, m double"), "t")
    links = [("p", 0, 0, i) for i in range(1, n + 1)]
    pairs = stored(spark.createDataFrame(links, "image_id string, phase int, u int, v int"), "t")
    plans.clear()
    got = regions.merge_clusters(models, pairs, {"m": 2.0})
    assert sorted((r["label"], r["cluster"]) for r in got.collect()) == [(i, 0) for i in range(n)]
    assert not limit or len(plans) < 6


def test_png_roundtrip_broadcasts_no_pixels(spark):
    plan = plan_of(QUERIES["png_roundtrip"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin [image_id" in plan and not pixels_broadcast(plan)


SOLO = re.compile(r"hashpartitioning\(image_id#\d+, \d+\)")


@pytest.fixture
def unsized(spark):
    """Every table counts as too large to be broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


DIR = "/root/testdata/sf0.001"


def test_metrics_keep_no_picture_in_one_task(spark, unsized, monkeypatch):
    seen = []

    def noted(df, name):
        seen.append((name, plan_of(df)))
        return stored(df, name)

    monkeypatch.setattr(metrics, "stored", noted)
    QUERIES["image_metrics"](spark, DIR)
    assert [n for n, _ in seen] == ["pairs", "measured"] and not any(SOLO.search(p) for _, p in seen)


def test_facts_of_many_pictures_come_without_broadcast(spark, unsized):
    df = spark.range(3000).selectExpr("concat('p', id % 3) image_id", "cast(id div 30 as int) y", "cast(id % 30 as int) x")
    facts = spark.createDataFrame([(f"p{i}", i * 10) for i in range(3)], "image_id string, f int")
    got = with_facts(df, facts, few=2)
    assert got.columns == ["image_id", "y", "x", "f"] and got.count() == 3000 and not got.where("f <> 10 * cast(substring(image_id, 2) as int)").count()
    assert "Broadcast" not in plan_of(got) and not SOLO.search(plan_of(got))


def test_few_taps_move_pixels_once(spark):
    """29 taps were 29 rows a pixel."""
    plan = plan_of(QUERIES["bilateral_r3_s1"](spark, DIR))
    assert "Join" not in plan and "FlatMapGroupsInPandas" in plan


@pytest.mark.parametrize("shape,tile", [((20, 33), 8), ((7, 9), 96), ((16, 40), 16)])
def test_tiles_equal_direct_sums(spark, shape, tile):
    """Pixels that aren't valid too: they get a value from valid ones that are near, or keep theirs; tiles are cut to the picture."""
    rng = np.random.default_rng(3)
    lab, ok = rng.normal(50, 2, (*shape, 3)), rng.random(shape) > 0.3
    df = lab_field(spark, lab, valid=ok)
    got = grid(bilateral.smooth_tiles(df, 3, 1.5, tile=tile), LAB, shape)
    for y, x in np.ndindex(shape):
        total, weight = np.zeros(3), 0.0
        for dy, dx, space in bilateral.taps(3):
            q = y + dy, x + dx
            if 0 <= q[0] < shape[0] and 0 <= q[1] < shape[1] and ok[q]:
                w = np.exp(-((lab[y, x] - lab[q]) ** 2).sum() / 4.5) * space
                total, weight = total + w * lab[q], weight + w
        assert np.allclose(got[y, x], total / weight if weight >= 0.5 else lab[y, x])


def test_growth_keeps_no_picture_in_one_task(spark, unsized):
    plan = plan_of(QUERIES["grow_labels"](spark, DIR))
    assert "BroadcastHashJoin [image_id" in plan and not SOLO.search(plan)


def test_clean_keeps_no_picture_in_one_task_and_measures_nothing(spark, unsized, monkeypatch):
    monkeypatch.setattr(clean, "info", None)
    assert not SOLO.search(plan_of(QUERIES["clean_default"](spark, DIR)))


def test_flat_mask_keeps_no_picture_in_one_task(spark, unsized):
    """A step of snap."""
    assert not SOLO.search(plan_of(QUERIES["flat_mask"](spark, DIR)))
