"""The registered queries against their SQL, and the pipeline stage by stage, over small tables."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from rasterloom.llm import decontam, near_dup, queries

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    rel = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    have = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str)
    assert have == sorted(map(tuple, rel.fetchall()), key=str)


def test_every_operator_is_registered():
    found = __spark_entry__.queries()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in found)] == [] and "pipeline" in found


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    quality, near, clean, mixed, shards = (f for _, f in corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    one = quality(spark, docs, DIR)
    assert one.columns == docs.columns and 0 < one.count() < docs.count()
    two = near(spark, one, DIR)
    classes = {r["doc_id"]: r["class_id"] for r in near_dup.classes(one).collect()}
    assert two.columns == docs.columns and ids(two) == {d for d, c in classes.items() if d == c}
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    three = clean(spark, two, DIR)
    assert three.columns == docs.columns and ids(three) == ids(two) - {r["doc_id"] for r in decontam.leaks(two, bench).collect()}
    four = mixed(spark, three, DIR)
    assert four.columns == docs.columns and ids(four) <= ids(three)
    five = shards(spark, four, DIR)
    assert five.count() == four.count() and ids(five) == ids(four)
    sizes = five.groupBy("shard").sum("shard_bytes").collect()
    assert all(r[1] <= queries.SHARD_BYTES for r in sizes)


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0
