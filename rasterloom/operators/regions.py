"""Connected components, region models, growth and merging.

Components are found within bands of rows first; then links across the bands' borders join groups of bands, and groups of groups.
Growth settles all its rounds within bands that overlap. Merging, whose result depends on the order of pairs, works in clusters of regions
whose models are near enough to merge at all. So no step needs a whole picture in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY, LAB
from ..storage import shuffled, stored, with_facts
from .bands import dealt_bands, plane

_NODE = 1 << 32  # a run is the number y * _NODE + x0, so the least node of a region is its first run in raster order
#: Rows of a band; bands that one step joins; columns of a bucket in which runs meet across a border.
BAND, GROUP, BUCKET = 64, 32, 64
#: Pairs of regions, of all pictures, that are joined picture by picture.
UNION_PAIRS = 1_000_000
_RUNS = "image_id string, band int, y int, x0 int, x1 int, node long, root long"
_MOVED = "image_id string, node long, root long"


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - at, size)


def _union(u: np.ndarray, v: np.ndarray) -> dict[int, int]:
    """Node to the least node that links (u, v) join it with; nodes of links only."""
    above: dict[int, int] = {}

    def root(i: int) -> int:
        above.setdefault(i, i)
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = root(a), root(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {i: root(i) for i in above}


def _local(part: pd.DataFrame) -> pd.DataFrame:
    """Runs of a band's true pixels, with the first run of the region that each belongs to within the band."""
    at = np.sort(part["y"].to_numpy().astype(np.int64) * _NODE + part["x"].to_numpy())
    first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    node, last = at[first], at[np.r_[first[1:], len(at)] - 1]
    y, x0, x1 = node // _NODE, node % _NODE, last % _NODE
    # a run meets those of the row above that begin before its end and end after its beginning
    lo, hi = np.searchsorted(last, node - _NODE), np.searchsorted(node, last - _NODE, side="right")
    size = np.maximum(hi - lo, 0)
    roots = _union(np.repeat(node, size), node[_spans(lo, size)])
    root = np.array([roots.get(n, n) for n in node.tolist()], np.int64)
    return pd.DataFrame({"image_id": part["image_id"].iloc[0], "band": part["band"].iloc[0], "y": y, "x0": x0, "x1": x1, "node": node, "root": root})


def band_runs(df: DataFrame, mask: str) -> DataFrame:
    """image_id, band, y, x0, x1, node, root of the maximal horizontal runs of true pixels, root within the band."""
    on = df.where(F.col(mask)).select(*KEY, F.expr(f"y div {BAND}").cast("int").alias("band"))
    return on.groupBy("image_id", "band").applyInPandas(_local, _RUNS)


def border_links(runs: DataFrame) -> DataFrame:
    """image_id, band, u, v: roots of runs that touch across the border above the band. Runs meet in buckets of columns, so never all of a row with all of the next."""
    bucket = F.explode(F.expr(f"sequence(x0 div {BUCKET}, x1 div {BUCKET})")).alias("b")
    low = runs.where(f"y % {BAND} = 0").select("image_id", "band", "x0", "x1", F.col("root").alias("u"), bucket)
    up = runs.where(f"y % {BAND} = {BAND - 1}").select("image_id", (F.col("band") + 1).alias("band"), F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col("root").alias("v"), bucket)
    return low.join(up, ["image_id", "band", "b"]).where("p0 <= x1 and x0 <= p1").select("image_id", "band", "u", "v").distinct()


def _joined(part: pd.DataFrame) -> pd.DataFrame:
    moved = {n: r for n, r in _union(part["u"].to_numpy(), part["v"].to_numpy()).items() if n != r}
    return pd.DataFrame({"image_id": part["image_id"].iloc[0], "node": list(moved), "root": list(moved.values())})


def closure(links: DataFrame) -> DataFrame:
    """image_id, node, root for every root of a band that belongs to an earlier one. links: image_id, band, u, v, a stored table.

    GROUP neighbouring bands are joined by one task, then GROUP such groups, and so on: the number of steps is the logarithm of the
    picture's height, and a task sees the links of GROUP - 1 borders only.
    """
    last, size, moved = links.agg(F.max("band")).first()[0], 1, None
    while last is not None and size <= last:
        inner = f"(band - 1) div {size} <> band div {size} and (band - 1) div {size * GROUP} = band div {size * GROUP}"
        here = links.where(inner).select("image_id", F.expr(f"band div {size * GROUP}").alias("g"), "u", "v")
        for end in "uv" if moved is not None else "":
            now = moved.select("image_id", F.col("node").alias(end), F.col("root").alias("_r"))
            here = here.join(now, ["image_id", end], "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
        new = stored(here.groupBy("image_id", "g").applyInPandas(_joined, _MOVED), "joined")
        if moved is None:
            moved = new
        else:
            later = new.select("image_id", F.col("node").alias("root"), F.col("root").alias("_r"))
            moved = moved.join(later, ["image_id", "root"], "left").select("image_id", "node", F.coalesce("_r", "root").alias("root"))
            moved = stored(moved.unionByName(new), "joined")
        size *= GROUP
    return links.sparkSession.createDataFrame([], _MOVED) if moved is None else moved


def label_components(df: DataFrame, mask: str) -> DataFrame:
    """image_id, y, x, label of true pixels: 4-connected regions, numbered from 0 by their first run in raster order.

    Regions within a band are found by one task, those that cross borders by `closure`; numbers come from counts by row, summed down the picture.
    """
    runs = stored(band_runs(df, mask), "runs")
    moved = closure(stored(border_links(runs), "links"))
    firsts = runs.where("node = root").select("image_id", "y", "node").join(moved.select("image_id", "node"), ["image_id", "node"], "left_anti")
    firsts = stored(firsts, "firsts")
    down = Window.partitionBy("image_id").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)  # a row for each row of the picture
    before = firsts.groupBy("image_id", "y").agg(F.count(F.lit(1)).alias("_k")).withColumn("_k", F.coalesce(F.sum("_k").over(down), F.lit(0)))
    along = F.row_number().over(Window.partitionBy("image_id", "y").orderBy("node"))
    names = firsts.withColumn("_i", along).join(before, ["image_id", "y"]).select("image_id", F.col("node").alias("root"), (F.col("_k") + F.col("_i") - 1).cast("int").alias("label"))
    whole = moved.select("image_id", F.col("node").alias("root"), F.col("root").alias("_r"))
    named = runs.join(whole, ["image_id", "root"], "left").withColumn("root", F.coalesce("_r", "root")).join(names, ["image_id", "root"])
    return named.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("size"))


def component_means(df: DataFrame, cols: tuple = LAB) -> DataFrame:
    """image_id, label, size and m_<c>. df: labelled pixels with cols."""
    return df.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("size"), *(F.avg(c).alias(f"m_{c}") for c in cols))


def component_planes(df: DataFrame, cols: tuple = LAB) -> DataFrame:
    """Least-squares plane per region: label, size, cy, cx, off_<c>, dy_<c>, dx_<c>, rms (of the worst channel).

    One aggregation of centred moments; the residual comes from the same moments. Shapes without area get slope 0.
    """
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    aggs = [F.count(F.lit(1)).alias("size"), F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.var_pop(y).alias("_yy"), F.var_pop(x).alias("_xx"), F.covar_pop(y, x).alias("_yx")]
    for c in cols:
        aggs += [F.avg(c).alias(f"off_{c}"), F.var_pop(c).alias(f"_v_{c}"), F.covar_pop(c, y).alias(f"_y_{c}"), F.covar_pop(c, x).alias(f"_x_{c}")]
    m = df.groupBy("image_id", "label").agg(*aggs).withColumn("_det", F.col("_xx") * F.col("_yy") - F.col("_yx") * F.col("_yx"))
    ok = F.col("_det") > 1e-4
    slope = lambda a, b, p, q: F.when(ok, (F.col(a) * F.col(p) - F.col(b) * F.col(q)) / F.col("_det")).otherwise(0.0)
    m = m.withColumns({f"dy_{c}": slope("_xx", "_yx", f"_y_{c}", f"_x_{c}") for c in cols} | {f"dx_{c}": slope("_yy", "_yx", f"_x_{c}", f"_y_{c}") for c in cols})
    rest = [F.greatest(F.col(f"_v_{c}") - F.col(f"dy_{c}") * F.col(f"_y_{c}") - F.col(f"dx_{c}") * F.col(f"_x_{c}"), F.lit(0.0)) for c in cols]
    m = m.withColumn("rms", F.sqrt(F.greatest(*rest)))
    return m.select("image_id", "label", "size", "cy", "cx", *(f"{k}_{c}" for c in cols for k in ("off", "dy", "dx")), "rms")


def plane_at(c: str, y: str = "y", x: str = "x"):
    """The plane's value of channel c at a pixel, from the columns of component_planes."""
    return F.col(f"off_{c}") + F.col(f"dy_{c}") * (F.col(y) - F.col("cy")) + F.col(f"dx_{c}") * (F.col(x) - F.col("cx"))


def plane_field(labelled: DataFrame, planes: DataFrame, cols: tuple = LAB) -> DataFrame:
    """image_id, y, x, label and the plane's value per channel."""
    both = labelled.select(*KEY, "label").join(planes, ["image_id", "label"])
    return both.select(*KEY, "label", *(plane_at(c).alias(c) for c in cols))


def _grown(cols: list[str], planes: bool, tol: float, most: int, rows: int):
    """Growth in one band: all rounds at once, since what a round does is known from `most` rows around the band."""

    def work(part: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        image_id, band = part["image_id"].iloc[0], int(part["band"].iloc[0])
        y0, x0 = int(part["y"].min()), int(part["x"].min())
        shape = int(part["y"].max()) - y0 + 1, int(part["x"].max()) - x0 + 1
        h, w = shape
        lab = np.stack([plane(part, c, y0, x0, shape).ravel() for c in LAB])
        there = np.zeros(shape, bool)
        there[part["y"] - y0, part["x"] - x0] = True
        label = np.full(h * w, -1, np.int64)
        seeds = part[part["label"].notna()]
        at = models["label"].to_numpy()
        by, order = models[cols].to_numpy(np.float64), np.argsort(at)
        label[(seeds["y"].to_numpy() - y0) * w + seeds["x"].to_numpy() - x0] = order[np.searchsorted(at, seeds["label"].to_numpy().astype(np.int64), sorter=order)]
        open_ = there.ravel() & (label < 0)
        born = np.where(label >= 0, 0, -1)
        front = np.flatnonzero(label >= 0)
        for turn in range(1, most + 1):
            asked = []
            for o, (dy, dx) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1))):  # the front lies below, above, right, left
                y, x = front // w - dy, front % w - dx
                ok = (y >= 0) & (y < h) & (x >= 0) & (x < w)
                p = y[ok] * w + x[ok]
                new = open_[p]
                asked.append((p[new], label[front[ok][new]], np.full(int(new.sum()), o)))
            p, m, o = (np.concatenate(a) for a in zip(*asked))
            if planes:
                ry, rx = p // w + y0 - by[m, cols.index("cy")], p % w + x0 - by[m, cols.index("cx")]
                at_p = [by[m, cols.index(f"off_{c}")] + by[m, cols.index(f"dy_{c}")] * ry + by[m, cols.index(f"dx_{c}")] * rx for c in LAB]
            else:
                at_p = [by[m, cols.index(f"m_{c}")] for c in LAB]
            d = np.max([np.abs(v[p] - q) for v, q in zip(lab, at_p)], axis=0) if len(p) else np.zeros(0)
            near = d <= tol
            p, m, o, d = p[near], m[near], o[near], d[near]
            first = np.lexsort((o, d, p))
            first = first[np.r_[True, p[first][1:] != p[first][:-1]]] if len(p) else first
            front = p[first]
            if not len(front):
                break
            label[front], born[front], open_[front] = m[first], turn, False
        own = np.flatnonzero(label >= 0)
        y, x = own // w + y0, own % w + x0
        inside = (y >= band * rows) & (y < (band + 1) * rows)
        own, y, x = own[inside], y[inside], x[inside]
        return pd.DataFrame({"image_id": image_id, "y": y, "x": x, "label": at[label[own]], "born": born[own]})

    return work


def grow(df: DataFrame, models: DataFrame, tol: float, planes: bool, rounds: int | None = None, rows: int = 128) -> DataFrame:
    """image_id, y, x, label after synchronous growth of the seeds.

    df: a dense grid with Lab and `label` (null: not a seed), stored. An unknown pixel looks at its neighbours below, above, right and
    left; the least worst-channel distance to the neighbour's model wins, the first on ties, and it joins if that is at most
    tol. A round that adds no pixel or under a thousandth of the picture is not applied and ends the growth of that picture.
    Models don't change meanwhile and a round reaches one pixel far, so a band's growth is settled by the rows that the rounds can reach
    from: bands take these along and note each pixel's round. Counts by round over all bands then tell which rounds count.
    """
    cols = [c for c in models.columns if c.startswith(("m_", "off_", "dy_", "dx_")) or c in ("cy", "cx")]
    size = df.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"), (F.max("y") + 1).alias("_h"))
    size = stored(size.withColumn("_most", F.lit(rounds) if rounds else F.greatest(F.lit(16), F.least(F.lit(48), F.expr("_h div 32 + 8")))), "sizes")
    most = rounds or size.agg(F.coalesce(F.max("_most"), F.lit(16))).first()[0]  # 48 at most
    held = dealt_bands(df.select(*KEY, *LAB, "label"), most, rows)
    asked = held.where("label is not null").select("image_id", "band", "label").distinct()
    asked = stored(asked.join(models.select("image_id", "label", *cols), ["image_id", "label"]), "seeded-bands")
    # bands that no seed can reach stay as they are
    held = held.join(asked.select("image_id", "band").distinct(), ["image_id", "band"], "left_semi")
    grown = held.groupBy("image_id", "band").cogroup(asked.groupBy("image_id", "band")).applyInPandas(_grown(cols, planes, tol, most, rows), "image_id string, y int, x int, label int, born int")
    grown = stored(grown, "grown")
    added = grown.groupBy("image_id", "born").agg(F.count(F.lit(1)).alias("_k"))
    turns = size.select("image_id", "_n", F.explode(F.sequence(F.lit(1), F.col("_most"))).alias("born")).join(added, ["image_id", "born"], "left")
    ends = turns.where("coalesce(_k, 0) < 0.001 * _n or coalesce(_k, 0) = 0").groupBy("image_id").agg(F.min("born").alias("_end"))
    ends = size.join(ends, "image_id", "left").select("image_id", F.coalesce("_end", F.col("_most") + 1).alias("_end"))
    return with_facts(grown, ends).where("born < _end").select(*KEY, "label")


def neighbour_pairs(labels: DataFrame) -> DataFrame:
    """image_id, phase (0 side by side, 1 one above the other), u, v: distinct labels that touch."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    pairs = None
    for phase, (line, at) in enumerate(((row, "x"), (column, "y"))):
        nxt = labels.select("image_id", "label", F.when(F.lead(at).over(line) == F.col(at) + 1, F.lead("label").over(line)).alias("v"))
        got = nxt.where("v is not null and v <> label").select("image_id", F.lit(phase).alias("phase"), F.col("label").alias("u"), "v").distinct()
        pairs = got if pairs is None else pairs.unionByName(got)
    return pairs


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("image_id", F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.where("v > u").select("image_id", F.col("u").alias("n"), F.col("v").alias("far")).join(least, ["image_id", "n"])
    return moved.select("image_id", F.col("far").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("image_id", "u").agg(F.min("v").alias("m"))
    moved = edges.join(least, ["image_id", "u"]).select("image_id", F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("image_id", "u", F.col("m").alias("v"))).where("u <> v").distinct()


def star_closure(links: DataFrame) -> DataFrame:
    """image_id, node, root (the least of its component) for every node but the roots; links: image_id, u, v with u > v, of any shape."""
    edges, before = stored(links.distinct(), "star"), None
    while True:
        sign = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == before or not sign["n"]:
            return edges.select("image_id", F.col("u").alias("node"), F.col("v").alias("root"))
        before, edges = sign, stored(_small_star(_large_star(edges)), "star")


def _boxed(within: dict[str, float]):
    """The rest of merge_clusters for one picture: clusters that touch are joined while their boxes are near, until no two are."""

    def work(boxes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        boxes = boxes.sort_values("cluster")
        names, tol = boxes["cluster"].to_numpy(), np.array(list(within.values()))
        lo, hi = (boxes[[f"{e}_{c}" for c in within]].to_numpy(np.float64, copy=True) for e in ("lo", "hi"))
        u, v = (np.searchsorted(names, pairs[n].to_numpy()) for n in "uv")
        root = np.arange(len(names))
        while (near := ((lo[u] - hi[v] <= tol) & (lo[v] - hi[u] <= tol)).all(1)).any():
            moved = _union(u[near], v[near])
            at, to = (np.fromiter(n, np.int64, len(moved)) for n in (moved.keys(), moved.values()))
            np.minimum.at(lo, to, lo[at])
            np.maximum.at(hi, to, hi[at])
            now = np.arange(len(names))
            now[at] = to
            root, u, v = now[root], now[u], now[v]
            u, v = u[u != v], v[u != v]
        own = root != np.arange(len(names))
        return pd.DataFrame({"image_id": boxes["image_id"].iloc[0], "node": names[own], "root": names[root[own]]})

    return work


def merge_clusters(models: DataFrame, pairs: DataFrame, within: dict[str, float]) -> DataFrame | None:
    """image_id, label, cluster of the regions that could merge at all; None if none could. models, pairs: stored tables.

    Regions merge only if the models of two regions of theirs are within the tolerances (column to tolerance). So clusters grow from single
    regions: two that touch are joined if the boxes around their models are that near in every column, until no two are. What ordered merging
    does in one cluster depends on no other. Boxes only grow, so the order in which clusters are joined doesn't matter: many pairs are joined by rounds over
    the whole table, and once UNION_PAIRS or fewer are left, which may take hundreds of rounds more, picture by picture.
    """
    member, joined = models.select("image_id", "label", F.col("label").alias("cluster")), False
    open_ = pairs.select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    open_ = stored(open_, "open")
    while left := open_.count():
        held = models.join(member, ["image_id", "label"]) if joined else models.withColumn("cluster", F.col("label"))
        boxes = held.groupBy("image_id", "cluster").agg(*(f(c).alias(f"{e}_{c}") for c in within for e, f in (("lo", F.min), ("hi", F.max))))
        few = left <= UNION_PAIRS
        if few:
            ends = open_.select("image_id", F.col("u").alias("cluster")).unionByName(open_.select("image_id", F.col("v").alias("cluster"))).distinct()
            boxes = boxes.join(ends, ["image_id", "cluster"], "left_semi")
            roots = boxes.groupBy("image_id").cogroup(open_.groupBy("image_id")).applyInPandas(_boxed(within), _MOVED)
        else:
            near = open_
            for n in "uv":
                side = boxes.select("image_id", F.col("cluster").alias(n), *(F.col(f"{e}_{c}").alias(f"{e}_{c}_{n}") for c in within for e in ("lo", "hi")))
                near = near.join(side, ["image_id", n])
            for c, tol in within.items():
                near = near.where((F.col(f"lo_{c}_u") - F.col(f"hi_{c}_v") <= tol) & (F.col(f"lo_{c}_v") - F.col(f"hi_{c}_u") <= tol))
            roots = star_closure(stored(near.select("image_id", "u", "v"), "near"))
        roots = stored(roots.select("image_id", F.col("node").alias("cluster"), F.col("root").alias("_r")), "roots")
        if roots.isEmpty():
            break
        member = stored(member.join(roots, ["image_id", "cluster"], "left").select("image_id", "label", F.coalesce("_r", "cluster").cast("int").alias("cluster")), "members")
        joined = True
        if few:
            break
        for n in "uv":
            now = roots.select("image_id", F.col("cluster").alias(n), F.col("_r").alias(f"_{n}"))
            open_ = open_.join(now, ["image_id", n], "left").withColumn(n, F.coalesce(f"_{n}", n)).drop(f"_{n}")
        open_ = stored(open_.where("u <> v").select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "open")
    if not joined:
        return None
    several = member.groupBy("image_id", "cluster").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("image_id", "cluster")
    return stored(member.join(several, ["image_id", "cluster"], "left_semi").select("image_id", "label", "cluster"), "members")


def _merger(values: list[str], slopes: list[str], tol: float, slope_tol: float, passes: int):
    """Ordered union of touching regions whose models agree; a pass goes through the pairs in order and compares the roots' models."""

    def merge(models: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        names = models["label"].tolist()
        at = {n: i for i, n in enumerate(names)}
        level, slope = models[values].to_numpy(), models[slopes].to_numpy() if slopes else None
        above = list(range(len(names)))

        def root(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        ordered = pairs.sort_values(["phase", "u", "v"])[["u", "v"]].to_numpy().tolist()
        for _ in range(passes):
            changed = False
            for u, v in ordered:
                a, b = root(at[u]), root(at[v])
                if a != b and abs(level[a] - level[b]).max() <= tol and (slope is None or abs(slope[a] - slope[b]).max() <= slope_tol):
                    above[b] = a
                    changed = True
            if not changed:
                break
        roots = [names[root(i)] for i in range(len(names))]
        return pd.DataFrame({"image_id": models["image_id"].iloc[0], "label": names, "root": roots})[lambda d: d["label"] != d["root"]]

    return merge


def _mapped(models: DataFrame, pairs: DataFrame, values: list[str], slopes: list[str], tol: float, slope_tol: float, passes: int) -> DataFrame:
    """image_id, label, root of the regions that merge into another. models, pairs: stored tables."""
    kind = "image_id string, label int, root int"
    member = merge_clusters(models, pairs, dict.fromkeys(values, tol) | dict.fromkeys(slopes, slope_tol))
    if member is None:
        return models.sparkSession.createDataFrame([], kind)
    of = lambda n: member.select("image_id", F.col("label").alias(n), F.col("cluster").alias(f"c_{n}"))
    inside = pairs.join(of("u"), ["image_id", "u"]).join(of("v"), ["image_id", "v"]).where("c_u = c_v").select("image_id", F.col("c_u").alias("cluster"), "phase", "u", "v")
    inside = stored(inside, "inside")
    held = models.join(member, ["image_id", "label"])
    work = _merger(values, slopes, tol, slope_tol, passes)
    return stored(held.groupBy("image_id", "cluster").cogroup(inside.groupBy("image_id", "cluster")).applyInPandas(work, kind), "mapped")


def _renumbered(names: DataFrame, mapped: DataFrame) -> DataFrame:
    """image_id, label, new: the roots' places among the roots of a picture, counted bucket by bucket. names: image_id, label."""
    roots = names.join(mapped, ["image_id", "label"], "left").withColumn("root", F.coalesce("root", "label"))
    heads = roots.select("image_id", "root").distinct().withColumn("_b", F.expr("root div 4096"))
    down = Window.partitionBy("image_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = heads.groupBy("image_id", "_b").agg(F.count(F.lit(1)).alias("_k")).withColumn("_k", F.coalesce(F.sum("_k").over(down), F.lit(0)))
    along = F.row_number().over(Window.partitionBy("image_id", "_b").orderBy("root"))
    new = heads.withColumn("_i", along).join(before, ["image_id", "_b"]).select("image_id", "root", (F.col("_k") + F.col("_i") - 1).cast("int").alias("new"))
    return stored(roots.join(new, ["image_id", "root"]).select("image_id", "label", "new"), "renumbered")


def merge_means(labels: DataFrame, means: DataFrame, lab: DataFrame, tol: float, passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(labels, means) after merging touching regions whose means differ by at most tol in every channel.

    Means stay as they were through all passes; at the end regions are renumbered and averaged anew. labels, lab: stored tables.
    """
    values = [f"m_{c}" for c in LAB]
    names = stored(means.select("image_id", "label", *values), "means")
    mapped = _mapped(names, stored(neighbour_pairs(labels), "pairs"), values, [], tol, 0.0, passes)
    new = _renumbered(names.select("image_id", "label"), mapped)
    now = stored(labels.join(new, ["image_id", "label"]).select(*KEY, F.col("new").alias("label")), "merged")
    fitted = component_means(now.join(shuffled(lab), list(KEY)))
    whole = new.select("image_id", F.col("new").alias("label")).distinct().join(fitted, ["image_id", "label"], "left")
    return now, whole.na.fill(0)


def merge_planes(labels: DataFrame, planes: DataFrame, lab: DataFrame, tol: float, slope_tol: float, passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(labels, planes) after merging touching regions whose planes agree in offset (tol) and slopes (slope_tol).

    Each pass starts from single regions; pictures in which something merged are renumbered and fitted anew, others keep their planes.
    """
    fit = [f"{k}_{c}" for c in LAB for k in ("off", "dy", "dx")]
    values, slopes = [f"off_{c}" for c in LAB], [f"{k}_{c}" for c in LAB for k in ("dy", "dx")]
    planes = stored(planes.select("image_id", "label", "cy", "cx", *fit), "planes")
    for _ in range(passes):
        mapped = _mapped(planes, stored(neighbour_pairs(labels), "pairs"), values, slopes, tol, slope_tol, 1)
        if mapped.isEmpty():
            break
        touched = stored(mapped.select("image_id").distinct(), "touched")
        new = _renumbered(planes.join(touched, "image_id", "left_semi").select("image_id", "label"), mapped)
        moved = labels.join(new, ["image_id", "label"]).select(*KEY, F.col("new").alias("label"))
        labels = stored(moved.unionByName(labels.join(touched, "image_id", "left_anti").select(*KEY, "label")), "merged")
        fitted = component_planes(labels.join(touched, "image_id", "left_semi").join(shuffled(lab), list(KEY))).select("image_id", "label", "cy", "cx", *fit)
        names = new.select("image_id", F.col("new").alias("label")).distinct()
        fitted = names.join(fitted, ["image_id", "label"], "left").na.fill(0.0)
        planes = stored(fitted.unionByName(planes.join(touched, "image_id", "left_anti")), "planes")
    return labels, planes
