"""Exact quantiles of groups of any size, by counts of value buckets.

A group's wanted ranks start with the interval from its least to its largest value. While an interval holds many values, these are
counted in BUCKETS buckets of equal width (combined before the shuffle), and the bucket that holds the rank is the next interval,
from its own least to its own largest value: an interval shrinks each time, since its ends lie in different buckets. Few values are
ordered in a window. So no task holds all values of a group, as an exact percentile's buffer does, and all groups and ranks go
through the same few passes over a stored table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

BUCKETS, FEW = 4096, 100_000
#: Rows of (group, rank), a few numbers each, that may be broadcast.
STATE = 100_000


def exact_quantiles(values: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float] | Column, weight: str | None = None, few: int = FEW, keep: bool = True) -> DataFrame:
    """keys, `n` and `q`, an array with the linearly interpolated quantile for each of probs.

    probs may be an array column over keys. weight: how many values a row stands for (whole, positive). Null and NaN values count
    for nothing; a group without others has no row. keep: store the values first (not needed where they come from a stored table at little cost).
    """
    keys = list(keys)
    wanted = probs if isinstance(probs, Column) else F.array(*(F.lit(float(p)) for p in probs))
    v, count = F.col(col).cast("double"), (F.col(weight) if weight else F.lit(1)).cast("long")
    held = values.select(*keys, v.alias("_v"), count.alias("_c")).where("_v is not null and not isnan(_v)")
    held = stored(held, "values") if keep else held
    groups = held.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("_p", wanted)
    place = lambda p: p * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.transform("_p", lambda p: F.array(F.floor(place(p)), F.ceil(place(p))))))
    here, facts = [*keys, "_rank"], ["_lo", "_hi", "_in", "_left", "n", "_p"]
    state = groups.withColumns({"_rank": F.explode(ranks), "_in": F.col("n")}).withColumn("_left", F.col("_rank"))
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_in") > few)
    while True:
        state = stored(state.select(*here, *facts), "ranks")
        rows, many = state.agg(F.count(F.lit(1)), F.count_if(wide)).first()
        small = F.broadcast if rows <= STATE else lambda df: df
        if not many:
            break
        # ranks of one interval share its counts
        ends = [*keys, "_lo", "_hi"]
        inside = held.join(small(state.where(wide).select(*ends).distinct()), keys).where("_v between _lo and _hi")
        bucket = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        counts = inside.groupBy(*ends, bucket.alias("_b")).agg(F.sum("_c").alias("_k"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_k").over(Window.partitionBy(*ends).orderBy("_b"))
        found = counts.withColumn("_upto", upto).join(small(state.where(wide)), ends).where("_left < _upto and _left >= _upto - _k")
        found = found.select(*here, F.col("_low").alias("_lo"), F.col("_high").alias("_hi"), F.col("_k").alias("_in"), (F.col("_left") - (F.col("_upto") - F.col("_k"))).alias("_left"), "n", "_p")
        state = state.where(~wide).unionByName(found)
    kept = ["n", "_p"]
    done = state.where("_lo >= _hi").select(*here, *kept, F.col("_lo").alias("_v"))
    inside = held.join(small(state.where("_lo < _hi")), keys).where("_v between _lo and _hi")
    upto = F.sum("_c").over(Window.partitionBy(*here).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).where("_left < _upto and _left >= _upto - _c").select(*here, *kept, "_v")
    at = F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")  # two ranks a quantile
    out = done.unionByName(found).groupBy(*keys).agg(F.first("n").alias("n"), F.first("_p").alias("_p"), at)

    def value(p: Column) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when(low == high, a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    return out.select(*keys, "n", F.transform("_p", value).alias("q"))
