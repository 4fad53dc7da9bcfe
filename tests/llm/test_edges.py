"""Deep pages, and input columns of any type with the names that the operators use inside."""

import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import chat, decontam, html_text, near_dup, pii, quality, queries, sharding, token_count

DIR = "/root/testdata/sf0.001"


def read_text(html):
    p = html_text.Page(html, html_text._Names())
    return p.text([False] * len(p.parent))[0]


@pytest.mark.parametrize("depth", [100, 511, 512, 600, 100_000])
def test_pages_keep_all_text_at_any_depth(depth):
    down, up = "<div>" * depth, "</div>" * depth
    assert read_text(f'<div class="wrap"><article><p>first</p>{down}x{up}<p>tail</p></article></div>') == "first x tail"
    assert read_text(f"<article>{down}a<nav><p>menu</p></nav>b{up}</article>c") == "a b"
    assert read_text(f"{down}k<nav>menu {down}menu{up} menu</nav>{up}l") == "k l"
    assert read_text(f"{down}<b><i>k</i></b> l{up}{'</div>' * 9}m") == "k l m"


def test_deep_pages_take_linear_time_and_are_templates_too():
    def seconds(n):
        began = time.process_time()
        html_text.Page("<div>a" * n + "</div>" * n, html_text._Names())
        return time.process_time() - began

    assert seconds(200_000) < 8 * seconds(50_000) + 0.5
    one, two = (html_text.subtree_keys(html_text.Page(f"<p>{t}</p>" + "<div>" * 3000 + "box" + "</div>" * 3000, html_text._Names())) for t in "ab")
    assert one[0] != two[0] and (one[1:] == two[1:]).all() and len(set(one.tolist())) > 2990


def inner_names():
    """Every name beginning with `_` or used as an alias in the operators."""
    found = set()
    for f in [*Path(queries.__file__).parent.glob("*.py"), Path(corpus_pipeline.__file__)]:
        found |= set(re.findall(r"[\"'](_[a-z]+_?[a-z0-9]*)[\"']", f.read_text()))
        found |= set(re.findall(r"alias\(\"([a-z_]+)\"\)", f.read_text()))
    return sorted(found)


def with_clashes(df, extra=True):
    """df with a column of each inner name that it has not, and a map column."""
    more = {n: F.lit(7) for n in inner_names() if n not in df.columns}
    return df.withColumns(more | ({"a_map": F.create_map(F.lit("k"), F.lit(1))} if extra else {}))


def rows(df, cols=None):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


def test_operators_ignore_columns_of_inner_names(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    bench, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("benchmark", "labels"))
    odd = with_clashes(docs)
    assert "_nd_id" in odd.columns and "_q_id" in odd.columns and "_sh_h" in odd.columns and len(odd.columns) > 60
    same = ["doc_id", "text"]
    assert rows(near_dup.keep_one(odd), same) == rows(near_dup.keep_one(docs), same)
    assert rows(decontam.drop_leaks(odd, with_clashes(bench)), same) == rows(decontam.drop_leaks(docs, bench), same)
    got = sharding.assign(odd, 5000)
    assert rows(got, ["doc_id", "shard"]) == rows(sharding.assign(docs, 5000), ["doc_id", "shard"])
    assert got.columns == [c for c in odd.columns if c not in ("shard", "shard_depth", "shard_bytes")] + ["shard_depth", "shard", "shard_bytes"]
    assert {r["_sh_h"] for r in got.collect()} == {7}
    one, two = (quality.train(d, n) for d, n in ((docs, labels), (odd, with_clashes(labels))))
    assert (one.weights == two.weights).all()
    assert rows(quality.select_good(odd, two), ["doc_id", "keep"]) == rows(quality.select_good(docs, one), ["doc_id", "keep"])
    assert rows(pii.find(odd), ["doc_id", "spans"]) == rows(pii.find(docs), ["doc_id", "spans"])
    assert rows(token_count.count_tokens(odd)) == rows(token_count.count_tokens(docs))
    turns = spark.read.parquet(f"{DIR}/conversations.parquet").limit(80)
    windows = [chat.digests(chat.read_back(chat.format_windows(t, 64, 2, 16))) for t in (turns, with_clashes(turns))]
    assert rows(windows[0]) == rows(windows[1], windows[0].columns)


def test_pipeline_stages_ignore_columns_of_inner_names(spark):
    docs = with_clashes(spark.read.parquet(f"{DIR}/documents.parquet").limit(60))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and {r["_q"] for r in out.select("_q").collect()} <= {7} and {r["_mix_id"] for r in out.select("_mix_id").collect()} <= {7}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == 60


def test_repeated_ids_stay_within_the_training_bound(spark):
    docs = spark.createDataFrame([(1, "some text"), (1, "another text"), (1, "a third"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.training_rows(docs, labels, most=1).count() == 1 and quality.training_rows(docs, labels, most=2).count() == 2
    assert quality.training_rows(docs, labels).count() == 4


def test_overflow_pages_hold_rows_of_any_type(spark):
    df = spark.range(400).select(F.lit(5).alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 90 + 1).cast("int")).alias("text"), F.create_map(F.lit("i"), "id").alias("m"), "id").repartition(7)
    got = sharding.assign(df, 1000)
    sizes = got.groupBy("shard").agg(F.sum("shard_bytes").alias("b")).collect()
    assert got.select("id").distinct().count() == got.count() == 400 and all(r["b"] <= 1000 for r in sizes) and len(sizes) < 60
    assert all(r["m"] == {"i": r["id"]} for r in got.collect())
