"""Tables in the shared folder: they cut lineage in loops, survive lost executors, and go with the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local runs (removed at exit) and an error on a cluster, whose machines share none."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own[app] = "file://" + own
    return _own[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which goes when the driver ends or drop_stored is called."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_all)
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete every table that `stored` has made: call it once results that may read them are written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop()[1])
        path.getFileSystem(conf).delete(path, True)


def _drop_all() -> None:
    try:
        if _made and _made[-1][0].sparkContext._jsc is not None:
            drop_stored(_made[-1][0])
    except Exception:  # the session has ended before: its folder is left to whoever owns it
        _made.clear()


def shuffled(df: DataFrame) -> DataFrame:
    """df, a table of pixels, to be joined by shuffles: its files are so much smaller than its rows that Spark would send them all through the driver to broadcast them."""
    return df.hint("merge")


def with_facts(df: DataFrame, facts: DataFrame, few: int = 100_000, parts: int = 64) -> DataFrame:
    """df, a table of pixels, with the columns of facts, a row a picture.

    A join on the picture alone would bring a picture's pixels into one task, and keep them there for the windows behind it. So few
    facts are broadcast; many are repeated, and a picture's rows of pixels are dealt to the copies.
    """
    held = stored(facts, "facts")
    if held.limit(few + 1).count() <= few:
        return df.join(F.broadcast(held), "image_id")
    copies = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return df.withColumn("_part", F.pmod("y", F.lit(parts))).join(copies, ["image_id", "_part"]).drop("_part")


def maybe_broadcast(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """df, a stored table, broadcast if it has at most limit rows of a few numbers; else its join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
