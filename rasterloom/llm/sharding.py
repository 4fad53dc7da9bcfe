"""Extendible hashing of documents into shards of bounded size (DataFrame functions only).

The directory is indexed by a prefix of the 60 hash bits of the key. A bucket is split on its next bit only if its
bytes exceed the limit, so a document's shard is its shortest hash prefix whose bucket fits. Bytes are summed per cell
(prefix of `bits` bits) with map-side combination; only cells that still exceed the limit are refined.

Cases: null text has 0 bytes; a null key hashes as ''; a single document larger than the limit is a shard of its own
page; rows that no bit can separate (equal keys, beyond 60 bits) are dealt to overflow pages of that bucket by
size, each within the limit; an empty table gives no rows. A row of the input travels as one struct, so that columns of any name
and type may stand in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, maybe_broadcast, stored

HASH_BITS = 60
#: Bits beyond the even split that the first step looks at, and bits that each refinement adds: cells stay few beside the shards.
FIRST_BITS, STEP_BITS = 4, 12


def hash_bits(key: Column) -> Column:
    """The first 60 bits of md5(key as text), as a bigint."""
    return F.conv(F.substring(F.md5(id_text(key)), 1, 15), 16, 10).cast("bigint")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, HASH_BITS - depth)


def _resolve(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For cells (`_sh_cell` = prefix of `high` bits, `_sh_b`), the shallowest fitting prefix of depth low..high."""
    ups = cells.select(
        "_sh_cell", "_sh_b", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_sh_d")
    ).withColumn("_sh_p", F.expr(f"shiftright(_sh_cell, {high} - _sh_d)"))
    # stored: the skewed upper prefixes can be split in the join
    sums = ups.groupBy("_sh_d", "_sh_p").agg(F.sum("_sh_b").alias("_sh_s")).where(F.col("_sh_s") <= limit).select("_sh_d", "_sh_p")
    sums = maybe_broadcast(stored(sums, "shard-prefixes"))
    # a prefix that fits has all of its own prolongations fit: the shard is the shortest
    return ups.join(sums, ["_sh_d", "_sh_p"]).groupBy("_sh_cell").agg(F.min("_sh_d").cast("int").alias("_sh_depth"))


def directory(slim: DataFrame, limit: int) -> list[tuple[DataFrame, int]]:
    """[(cells with `_sh_depth`, bits)], coarse to fine; each holds the cells that its bits resolve.

    slim: `_sh_h`, `_sh_bytes`, a stored table.
    """
    total = slim.agg(F.coalesce(F.sum("_sh_bytes"), F.lit(0)).alias("t")).first()["t"]
    bits = min(HASH_BITS, max(0, int(total // limit).bit_length()) + FIRST_BITS)
    levels, low, rows = [], 0, slim
    while True:
        cells = rows.groupBy(prefix(F.col("_sh_h"), bits).alias("_sh_cell")).agg(F.sum("_sh_bytes").alias("_sh_b"))
        cells = stored(cells, "shard-cells")
        levels.append((stored(_resolve(cells, low, bits, limit), "shard-directory"), bits))
        big = cells.where(F.col("_sh_b") > limit)
        if bits == HASH_BITS or not big.limit(1).count():
            return levels
        rows = rows.join(maybe_broadcast(stored(big, "shard-big")), prefix(F.col("_sh_h"), bits) == F.col("_sh_cell"), "left_semi")
        low, bits = bits + 1, min(HASH_BITS, bits + STEP_BITS)


def assign(docs: DataFrame, limit: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus `shard_depth` (bits used), `shard` (those bits as text, with `/page` after overflow) and `shard_bytes`.

    Output columns of these names replace columns of docs of the same name.
    """
    docs = docs.drop("shard", "shard_depth", "shard_bytes")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    sized = docs.select(F.struct(*docs.columns).alias("_sh_row"), hash_bits(F.col(key_col)).alias("_sh_h"), size.alias("_sh_bytes"))
    slim = stored(sized.select("_sh_h", "_sh_bytes"), "shard-rows")
    out = sized.withColumn("_sh_depth", F.lit(None).cast("int"))
    for cells, bits in directory(slim, limit):
        found = cells.select("_sh_cell", F.col("_sh_depth").alias("_sh_found"))
        out = out.join(maybe_broadcast(found), prefix(F.col("_sh_h"), bits) == F.col("_sh_cell"), "left")
        out = out.withColumn("_sh_depth", F.coalesce("_sh_depth", "_sh_found")).drop("_sh_cell", "_sh_found")
    bits60 = F.lpad(F.conv(F.col("_sh_h").cast("string"), 10, 2), HASH_BITS, "0")
    fits = out.where("_sh_depth is not null").withColumn("shard", F.substring(bits60, F.lit(1), F.col("_sh_depth")))
    whole = slim.groupBy("_sh_h").agg(F.sum("_sh_bytes").alias("b")).where(F.col("b") > limit).limit(1).count()
    if whole:
        rest = _overflow(out.where("_sh_depth is null").drop("_sh_depth"), limit)
        rest = rest.withColumn("shard", F.concat(bits60, F.lit("/"), F.col("_sh_page"))).drop("_sh_page")
        fits = fits.unionByName(rest.withColumn("_sh_depth", F.lit(HASH_BITS)))
    return fits.select("_sh_row.*", F.col("_sh_depth").alias("shard_depth"), "shard", F.col("_sh_bytes").alias("shard_bytes"))


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for rows whose 60 bits are equal and together exceed the limit.

    Sizes within a hash go to size classes (powers of two): a page of class c takes limit div 2**(c+1) rows, one at least, numbered in
    the order of the stored rows. Each part of the stored table numbers its own rows, from where the parts before it end, so
    that no task meets all rows of a hash.
    """
    klass = F.floor(F.log2(F.greatest(F.col("_sh_bytes"), F.lit(1)))).cast("int")
    held = stored(rows.withColumns({"_sh_class": klass, "_sh_i": F.monotonically_increasing_id()}), "shard-overflow")
    held = held.withColumn("_sh_part", F.shiftright("_sh_i", 33))
    keys = ["_sh_h", "_sh_class"]
    before = Window.partitionBy(*keys).orderBy("_sh_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy(*keys, "_sh_part").agg(F.count(F.lit(1)).alias("_sh_n"))  # a row for each part
    parts = parts.withColumn("_sh_from", F.coalesce(F.sum("_sh_n").over(before), F.lit(0))).drop("_sh_n")
    slim = held.select(*keys, "_sh_part", "_sh_i").withColumn("_sh_at", F.row_number().over(Window.partitionBy(*keys, "_sh_part").orderBy("_sh_i")) - 1)
    per = F.greatest(F.lit(1), F.expr(f"cast({int(limit)} div shiftleft(2L, _sh_class) as bigint)"))
    page = F.concat_ws("-", F.col("_sh_class").cast("string"), F.floor((F.col("_sh_from") + F.col("_sh_at")) / per).cast("string"))
    paged = slim.join(maybe_broadcast(stored(parts, "shard-parts")), [*keys, "_sh_part"]).select("_sh_i", page.alias("_sh_page"))
    return held.join(paged, "_sh_i").drop("_sh_i", "_sh_part", "_sh_class")
