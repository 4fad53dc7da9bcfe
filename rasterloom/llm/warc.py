"""Not-modified revisits of web captures, resolved by an as-of join.

Each revisit (a capture without payload, from a 304 answer) takes the payload of the latest earlier full response of its canonical
URL. Validators must agree: the entity tag if both have one (weak comparison: a leading W/ is ignored), else the last-modified
text if both have one, else nothing speaks against it. The headers of the response are kept, and those that a 304 may
update (PERMITTED) are taken from the revisit. A revisit whose latest response does not agree stays `mismatch`, one without any `missing`.

Scale: captures are range-partitioned by (canonical URL, time, id), so a URL with a third of all rows lies in many partitions; each
carries the last response in from the partitions before, through a table of one row per URL and partition. Only ids travel there; payloads
are fetched afterwards by an equi-join that AQE can split.

Cases: ties in time are ordered by id; null url is a canonical URL of its own ('' as well); null times come first; a null capture id is
kept but serves no revisit; repeated rows are kept; of responses that share an id one serves; null headers count as empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The headers that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change what a URL names.
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref)"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, http as https, no www., default port, fragment, tracking parameters, or trailing slash; '' for null."""
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.regexp_replace(u, "#.*$", "")
    head = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0))
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    head = F.regexp_replace(head, "^http://", "https://")
    head = F.regexp_replace(head, "^https://www[.]", "https://")
    head = F.regexp_replace(head, ":(80|443)$", "")
    rest = F.regexp_replace(rest, f"([?&]){TRACKING}=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/+$", "")
    return F.concat(head, rest)


def _tag(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "^W/", "")


def resolve(captures: DataFrame) -> DataFrame:
    """capture_id, url, canonical_url, at, kind, status (full, resolved, mismatch or missing), base_id, headers (merged) and payload (filled in).

    captures: capture_id long, url string, at (any ordered type), kind ('response', else a revisit), etag, last_modified,
    headers map<string,string> (lower-case names), payload. Other columns are left out.
    """
    empty = F.expr("cast(map() as map<string,string>)")
    rows = captures.select(
        F.col("capture_id").cast("long").alias("capture_id"), "url", canonical_url(F.col("url")).alias("canonical_url"), "at", "kind",
        F.coalesce(F.col("kind") == "response", F.lit(False)).alias("full"), "etag", "last_modified", F.coalesce("headers", empty).alias("headers"), "payload",
    )
    # all but the payloads of responses, in order of URL and time
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.withColumn("payload", F.when(~F.col("full"), F.col("payload"))).repartitionByRange(parts, "canonical_url", "at", "capture_id")
    keys = stored(keys.withColumn("part", F.spark_partition_id()), "warc-keys")
    serves = F.col("full") & F.col("capture_id").isNotNull()
    me = F.struct("at", "capture_id", "etag", "last_modified")
    order = Window.partitionBy("part", "canonical_url").orderBy("at", "capture_id", F.desc("full"))
    near = keys.withColumn("base", F.last(F.when(serves, me), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # the last response of each part, carried to the parts after it
    ends = keys.groupBy("part", "canonical_url").agg(F.max(F.when(serves, me)).alias("e"))
    back = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", "canonical_url", F.last("e", ignorenulls=True).over(back).alias("carried")).where("carried is not null")
    near = near.where("not full").join(carried, ["part", "canonical_url"], "left").withColumn("base", F.coalesce("base", "carried"))
    tags = F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), _tag(F.col("etag")) == _tag(F.col("base.etag")))
    dates = F.when(F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull(), F.trim("last_modified") == F.trim("base.last_modified"))
    agree = F.coalesce(tags, dates, F.lit(True))
    status = F.when(F.col("base").isNull(), "missing").when(agree, "resolved").otherwise("mismatch")
    found = near.withColumn("status", status).withColumn("base_id", F.when(F.col("status") == "resolved", F.col("base.capture_id")))
    base = rows.where(serves).select(F.col("capture_id").alias("base_id"), F.col("headers").alias("base_headers"), F.col("payload").alias("base_payload"))
    if keys.where(serves).groupBy("capture_id").count().where("count > 1").limit(1).count():
        # of responses that share an id the one with the least payload and headers serves
        one = F.struct("base_headers", "base_payload")
        base = base.groupBy("base_id").agg(F.min_by(one, F.struct(F.col("base_payload"), F.to_json("base_headers"))).alias("b")).select("base_id", "b.*")
    done = found.join(base, "base_id", "left")
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("base_headers", lambda k, _: ~F.array_contains(F.map_keys(update), k))
    ok = F.col("status") == "resolved"
    done = done.withColumns({
        "headers": F.when(ok, F.map_concat(kept, update)).otherwise(F.col("headers")),
        "payload": F.when(ok, F.col("base_payload")).otherwise(F.col("payload")),
    })
    whole = rows.where("full").withColumns({"status": F.lit("full"), "base_id": F.lit(None).cast("long")})
    out = ("capture_id", "url", "canonical_url", "at", "kind", "status", "base_id", "headers", "payload")
    return whole.select(*out).unionByName(done.select(*out))
