"""What became of each picture of a batch: a stored table that names outputs, decides what is skipped, and keeps reasons.

A row is (path, length, modified, output, status, reason, at): status is cleaned, failed or skipped. Each run appends its rows; the
latest one of a path that isn't `skipped` counts. An output's name depends on the picture's place below its root; where two pictures ask for one
output, it belongs to the one that has it in the ledger, else to the first by path, and the others' names get a hash of their path. So
names stay the same whatever other pictures a run has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .images import only_images, plain_path

LEDGER = "path string, length long, modified timestamp, output string, status string, reason string, at timestamp"


def listing(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """root, path, length, modified of the images in folders, or of the files named; contents are not read. A path that is not there is an error of Spark's."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = None
    for p in paths:
        one = reader.load(p).select(plain_path("path").alias("path"), "length", F.col("modificationTime").alias("modified")).withColumn("root", F.lit(p.rstrip("/")))
        found = one if found is None else found.unionByName(one)
    first = Window.partitionBy("path").orderBy(F.length("root"), "root")  # a file that several paths name
    return only_images(found).withColumn("_i", F.row_number().over(first)).where("_i = 1").select("root", "path", "length", "modified")


def _or_empty(spark: SparkSession, df, schema: str) -> DataFrame:
    try:
        return df()
    except Exception as e:  # the folder is not there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def known(spark: SparkSession, ledger: str) -> DataFrame:
    """The row that counts of each path; an empty table where there is no ledger."""
    rows = _or_empty(spark, lambda: spark.read.schema(LEDGER).parquet(ledger), LEDGER).where("status <> 'skipped'")
    held = F.struct("length", "modified", "output", "status", "reason", "at")
    return rows.groupBy("path").agg(F.max_by(held, "at").alias("r")).select("path", "r.*")


def existing(spark: SparkSession, folder: str) -> DataFrame:
    """path of every file below a folder; empty where it is not there."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return _or_empty(spark, lambda: reader.load(folder).select(plain_path("path").alias("path")), "path string")


def planned(files: DataFrame, ledger: DataFrame, there: DataFrame, suffix: str = "-clean", out_dir: str | None = None, overwrite: bool = False, output: str | None = None) -> DataFrame:
    """files plus `output` and `action`: clean, or skip with `reason`.

    A picture is skipped if its output is there, unless the ledger tells that the source has changed since. Outputs of earlier runs that lie among
    the files are left out. output: the file for a single picture.
    """
    made = ledger.where("status = 'cleaned'").select(F.col("output").alias("path")).distinct()
    files = files.join(made, "path", "left_anti")
    inner = F.when(F.startswith("path", F.concat("root", F.lit("/"))), F.substr(F.col("path"), F.length("root") + 2)).otherwise(F.regexp_extract("path", "[^/]*$", 0))
    inner = F.col("path") if out_dir is None else F.concat(F.lit(out_dir.rstrip("/") + "/"), inner)
    stem = F.regexp_replace(inner, r"\.[^./]*$", "")
    asked = files.withColumns({"_stem": stem, "_ask": F.lit(output) if output else F.concat(stem, F.lit(f"{suffix}.png"))})
    own = ledger.select("path", *(F.col(c).alias(f"_{c}") for c in ("length", "modified", "output", "status")))
    owner = ledger.select(F.col("output").alias("_ask"), F.col("path").alias("_owner"))
    owner = owner.groupBy("_ask").agg(F.min("_owner").alias("_owner"))
    asked = asked.join(own, "path", "left").join(owner, "_ask", "left")
    new = Window.partitionBy("_ask").orderBy("path")  # pictures that ask for one name: few, as they share folder and stem, or folder arguments
    asked = asked.withColumn("_first", F.min(F.when(F.col("_output").isNull(), F.col("path"))).over(new.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    free = (F.coalesce("_owner", "path") == F.col("path")) & (F.col("_first") == F.col("path"))
    apart = F.concat("_stem", F.lit("-"), F.substring(F.md5("path"), 1, 8), F.lit(f"{suffix}.png"))
    named = asked.withColumn("output", F.lit(output) if output else F.coalesce("_output", F.when(free, F.col("_ask")).otherwise(apart)))
    named = named.join(there.select(F.col("path").alias("output")).distinct().withColumn("_there", F.lit(True)), "output", "left")
    changed = F.col("_output").isNotNull() & ((F.col("_length") != F.col("length")) | (F.col("_modified") != F.col("modified")))
    skip = F.coalesce("_there", F.lit(False)) & ~changed & F.lit(not overwrite)
    return named.select("path", "length", "modified", "output", F.when(skip, "skip").otherwise("clean").alias("action"), F.when(skip, "exists").alias("reason"))


def append(rows: DataFrame, ledger: str) -> None:
    """rows: path, length, modified, output, status, reason."""
    rows.withColumn("at", F.current_timestamp()).select("path", "length", "modified", "output", "status", "reason", "at").write.mode("append").parquet(ledger)
