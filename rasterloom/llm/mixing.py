"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A tree domain > language > source holds integer weights. The token budget goes down the tree: every node
shares its budget among its children by weight, no child gets more than its subtree can supply
(tokens x max_epochs), and what a full child leaves goes to its siblings. Because a node's own share is capped
by its subtree's supply one level higher, a shortage reaches the ancestors' siblings only when all siblings are full.

A leaf with budget b and t tokens gives b div t whole epochs and, of the next epoch, the prefix of its documents in
the order md5(seed|epoch|id) whose running token sum stays within b mod t.

Cases: null tree columns count as ''; null or empty text has 0 tokens; a leaf of 0 tokens gets no budget and its
documents are left out; weight 0 leaves a node and all below it out; rows with equal ids are tied and enter or stay out together; an empty table gives an empty result.
Internal columns start with `_mix_`, so other names never clash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, maybe_broadcast, stored, words_expr

LEVELS = ("_mix_0", "_mix_1", "_mix_2")
#: Hex digits of the order key that name a bin; only the one bin of a leaf in which its prefix ends is sorted.
BIN_DIGITS = 3


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), id_text(doc_id)))


def slim_rows(docs: DataFrame, tree: Sequence[Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, leaf and token count of each row: the only pass over the texts that the plan needs."""
    cols = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(LEVELS, tree, strict=True)]
    return docs.select(F.col(id_col).alias("_mix_id"), *cols, words_expr(F.col(text_col)).alias("_mix_tok"))


def _weight(names: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """Integer weight of a node, given by its path; 1 if the path is not listed."""
    out = F.lit(1)
    for path, w in weights.items():
        if len(path) == len(names):
            here = F.lit(True)
            for n, v in zip(names, path, strict=True):
                here = here & (F.col(n) == v)
            out = F.when(here, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def waterfill(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Share `_mix_total` (of the parent, on each row) among children by `_mix_w`, none above `_mix_cap`.

    In the order of cap/weight, a child is full iff cap * (weights from it on) <= weight * (what is left before it);
    the rest get the same level per weight. Integer arithmetic: decimal(38,0) products, floors, and the units that
    floors lose go one each to the first unfilled children.
    """
    dec = lambda c: c.cast("decimal(38,0)")
    kids = children.where("_mix_w > 0").withColumn("_mix_r", F.col("_mix_cap") / F.col("_mix_w"))
    order = Window.partitionBy(*parent).orderBy("_mix_r", name)
    all_of = Window.partitionBy(*parent)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    kids = kids.withColumns({
        "_mix_left": F.greatest(F.col("_mix_total") - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0)), F.lit(0)),
        "_mix_ws": F.sum("_mix_w").over(onward),
    })
    kids = kids.withColumn("_mix_full", dec(F.col("_mix_cap")) * dec(F.col("_mix_ws")) <= dec(F.col("_mix_w")) * dec(F.col("_mix_left")))
    kids = kids.withColumn("_mix_open", F.row_number().over(order))
    kids = kids.withColumn("_mix_first", F.min(F.when(~F.col("_mix_full"), F.col("_mix_open"))).over(all_of))
    kids = kids.withColumns({
        "_mix_full": F.coalesce(F.col("_mix_open") < F.col("_mix_first"), F.lit(True)),
        "_mix_l": F.max(F.when(F.col("_mix_open") == F.col("_mix_first"), F.col("_mix_left"))).over(all_of),
        "_mix_lw": F.max(F.when(F.col("_mix_open") == F.col("_mix_first"), F.col("_mix_ws"))).over(all_of),
    })
    exact = F.expr("cast((cast(_mix_w as decimal(38,0)) * cast(_mix_l as decimal(38,0))) div cast(_mix_lw as decimal(38,0)) as bigint)")
    kids = kids.withColumn("_mix_got", F.when(F.col("_mix_full"), F.col("_mix_cap")).otherwise(exact))
    lost = F.least(F.sum("_mix_cap").over(all_of), F.col("_mix_total")) - F.sum("_mix_got").over(all_of)
    kids = kids.withColumn("_mix_lost", lost)
    extra = (~F.col("_mix_full")) & (F.col("_mix_open") - F.col("_mix_first") < F.col("_mix_lost"))
    return kids.withColumn("_mix_got", F.least(F.col("_mix_got") + extra.cast("long"), F.col("_mix_cap")))


def leaf_plan(slim: DataFrame, weights: Mapping[tuple[str, ...], int], budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: tokens, budget, whole epochs, and where the prefix of the next epoch ends.

    The budget is floor(budget_share in thousandths x all tokens / 1000).
    """
    leaves = slim.groupBy(*LEVELS).agg(F.sum("_mix_tok").alias("_mix_t")).where("_mix_t > 0")
    leaves = stored(leaves.withColumn("_mix_cap", F.col("_mix_t") * max_epochs), "mix-leaves")
    per_mille = round(budget_share * 1000)
    total = leaves.agg(F.expr(f"coalesce(sum(_mix_t), 0) * {per_mille} div 1000").alias("_mix_total"))
    got = None
    for depth in (1, 2, 3):
        names = list(LEVELS[:depth])
        nodes = leaves.groupBy(*names).agg(F.sum("_mix_cap").alias("_mix_cap")).withColumn("_mix_w", _weight(names, weights))
        if got is None:
            nodes = nodes.join(F.broadcast(total), how="inner")
        else:
            nodes = nodes.join(got, names[:-1])
        got = waterfill(nodes, names[:-1], names[-1]).select(*names, F.col("_mix_got").alias("_mix_total"))
    plan = leaves.join(got, list(LEVELS)).withColumns({
        "_mix_whole": F.expr("_mix_total div _mix_t"),
        "_mix_rest": F.expr("_mix_total % _mix_t"),
    })
    plan = stored(plan.select(*LEVELS, "_mix_t", F.col("_mix_total").alias("_mix_b"), "_mix_whole", "_mix_rest"), "mix-plan")
    keyed = _keyed(slim.join(maybe_broadcast(plan), list(LEVELS)), seed)
    bins = keyed.groupBy(*LEVELS, "_mix_bin").agg(F.sum("_mix_tok").alias("_mix_bt"))
    upto = F.sum("_mix_bt").over(Window.partitionBy(*LEVELS).orderBy("_mix_bin"))
    bins = bins.withColumn("_mix_upto", upto).join(plan, list(LEVELS))
    # the first bin that the prefix does not hold whole
    cut = bins.where("_mix_upto > _mix_rest").groupBy(*LEVELS).agg(F.min(F.struct("_mix_bin", F.expr("_mix_upto - _mix_bt").alias("o"))).alias("c"))
    cut = cut.select(*LEVELS, F.col("c._mix_bin").alias("_mix_cut"), F.col("c.o").alias("_mix_base"))
    return stored(plan.join(cut, list(LEVELS), "left"), "mix-cut")


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    rows = rows.withColumn("_mix_key", order_key(seed, F.col("_mix_whole") + 1, F.col("_mix_id")))
    return rows.withColumn("_mix_bin", F.substring("_mix_key", 1, BIN_DIGITS))


def take(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with `_mix_id`, `_mix_tok` and the leaf columns, plus `_mix_n`: how many epochs take the row (0 if none).

    Only the rows of each leaf's cut bin are shuffled and sorted; the rest is decided where it is read.
    """
    keyed = _keyed(rows.join(maybe_broadcast(plan), list(LEVELS)), seed)
    sure = keyed.where("_mix_cut is null or _mix_bin <> _mix_cut")
    sure = sure.withColumn("_mix_n", F.expr("_mix_whole + cast(coalesce(_mix_bin < _mix_cut, true) as bigint)"))
    edge = keyed.where("_mix_bin = _mix_cut")
    so_far = F.sum("_mix_tok").over(Window.partitionBy(*LEVELS).orderBy("_mix_key", "_mix_id"))
    edge = edge.withColumn("_mix_n", F.expr("_mix_whole") + (so_far + F.col("_mix_base") <= F.col("_mix_rest")).cast("long"))
    return sure.unionByName(edge)
