"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written to the shared folder as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontam, mixing, near_dup, quality, queries, sharding
from rasterloom.llm.common import fresh, stored

#: The mixing stage asks for as many tokens as there are, so that it re-weights rather than thins.
STAGE_SHARE, STAGE_EPOCHS = 1.0, 4
STAGE_WEIGHTS: dict[tuple[str, ...], int] = {
    ("web",): 3, ("curated",): 2,
    ("web", "en"): 6, ("web", "de"): 3, ("web", "fr"): 3, ("web", "es"): 2,
    ("curated", "en"): 4, ("curated", "de"): 2, ("curated", "fr"): 2, ("curated", "es"): 2,
    ("web", "en", "src0"): 4,
}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects."""
    model = quality.train(docs, queries.table(spark, sf_dir, "labels"))
    (name,) = fresh(docs, "_q")
    kept = docs.withColumn(name, quality.scorer(docs, model)).where(F.col(f"{name}.p_good") >= 0.5)
    return kept.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each class of near copies."""
    return near_dup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix: a row for each epoch that takes a document."""
    slim = stored(mixing.slim_rows(docs, queries.mix_tree()), "mix-rows")
    plan = mixing.leaf_plan(slim, STAGE_WEIGHTS, STAGE_SHARE, STAGE_EPOCHS, queries.MIX_SEED)
    tree = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(mixing.LEVELS, queries.mix_tree())]
    rows = docs.select(F.struct(*docs.columns).alias("_mix_row"), F.col("doc_id").alias("_mix_id"), mixing.words_expr(F.col("text")).alias("_mix_tok"), *tree)
    taken = mixing.take(rows, plan, queries.MIX_SEED).where("_mix_n > 0")
    return taken.withColumn("_mix_e", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n")))).select("_mix_row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard; epochs of a document are rows of their own shards' limit."""
    return sharding.assign(docs, queries.SHARD_BYTES)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the classifier, the sketches or the templates; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of sf_dir."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
