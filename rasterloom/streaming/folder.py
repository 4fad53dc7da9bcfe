"""Pictures that arrive in a folder, cleaned file by file; each file stands alone, so no state is kept between batches."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from ..model import Options
from ..plans.clean import clean
from ..sources.images import only_images, read_images, save_images, unpack

_IMAGE = StructType([StructField("origin", StringType()), StructField("height", IntegerType()), StructField("width", IntegerType()),
                     StructField("nChannels", IntegerType()), StructField("mode", IntegerType()), StructField("data", BinaryType())])


def incoming(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the image source's rows for files that appear in folder."""
    schema = StructType([StructField("image", _IMAGE)])
    return spark.readStream.format("image").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder).select("image.*")


def clean_stream(spark: SparkSession, folder: str, out_dir: str, checkpoint: str, opts: Options | None = None, suffix: str = "-clean") -> StreamingQuery:
    """Clean every new picture of folder into out_dir and stop when all that is there is done. A batch that runs again writes the same files."""

    def work(batch: DataFrame, number: int) -> None:
        good = only_images(batch, "origin").where("height > 0")
        # grey files are read by name (the source gives it URL-encoded), for their alpha; a batch has at most files_per_batch
        grey = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(row["origin"])) for row in good.where("nChannels = 1").select("origin").collect()]
        pixels = unpack(good.where("nChannels <> 1"))
        if grey:
            pixels = pixels.unionByName(read_images(batch.sparkSession, grey)[0])
        if grey or not good.isEmpty():
            save_images(clean(pixels, opts), out_dir, suffix)

    return incoming(spark, folder).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(results: DataFrame, key: str = "image_id", seq: str = "seq") -> DataFrame:
    """Of several results of a picture, the one asked for last."""
    rest = F.struct(*results.columns)
    return results.groupBy(key).agg(F.max_by(rest, seq).alias("_r")).select("_r.*")
