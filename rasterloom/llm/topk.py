"""Exact top-k by inner product with block-at-a-time pruning.

A vector is a document whose terms are its components, made integers by floor(SCALE x component). Documents go to blocks of
consecutive rows; a block keeps the largest and least value of each term and a forward index (its matrix). For a query the block's
bound is the sum over terms of query weight x (largest if the weight is positive, else least). Blocks are taken in
order of falling bound and scored through their forward index until the bound is below the query's kth score so far; equal bounds
are still scored, for the sake of ties. Every batch of rows gives its own k best a query; a last grouping by query merges them.

Queries are taken QUERY_ROWS at a time (bounded, broadcast), each lot against all rows in blocks, so memory does not grow with the
tables. Scores are exact: products are summed in 64-bit integers unless the sums stay below 2**53, where doubles are exact too.

Cases: vectors null, empty or with a null or non-finite component take no part; shorter vectors count as padded with 0;
a query id on several rows is one query, by its least vector; candidates of the query's own id are left out; repeated candidate ids are
ranked as many times as they stand; ties go to the smaller id; null ids take no part; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, BLOCK_ROWS, QUERY_ROWS = 1024, 256, 4096
_SCHEMA = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id (long) and v (array of long): the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    ok = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return ok.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column as an integer matrix, padded with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    width = max(width or 0, int(sizes.max(initial=0)))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def best_of(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best rows of x, by score down and id up."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (x, q))
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * width
    kind = np.float64 if most < 2**53 else np.int64
    x, q = x.astype(kind), q.astype(kind)
    starts = np.arange(0, len(ids), BLOCK_ROWS)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    first = np.argsort(-bounds, axis=1, kind="stable")
    out = []
    for n in range(len(q)):
        got_s, got_i, kth = np.empty(0, kind), np.empty(0, np.int64), None
        for b in first[n]:
            if kth is not None and bounds[n, b] < kth:
                break
            at = slice(starts[b], starts[b] + BLOCK_ROWS)
            s, i = x[at] @ q[n], ids[at]
            keep = i != qids[n]
            if kth is not None:
                keep &= s >= kth
            if not keep.any():
                continue
            got_s, got_i = np.r_[got_s, s[keep]], np.r_[got_i, i[keep]]
            if len(got_s) > k:
                top = np.lexsort((got_i, -got_s))[:k]
                got_s, got_i = got_s[top], got_i[top]
            if len(got_s) == k:
                kth = got_s.min()
        out.append((got_i, got_s.astype(np.int64)))
    return out


def _search(held, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = best_of(batch.column("id").to_numpy(), _matrix(batch.column("v")), qids, q, k)
            sizes = [len(i) for i, _ in found]
            yield pa.record_batch(
                [pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                names=["query_id", "vec_id", "score"],
            )

    return search


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows where is_query holds, against all rows of vectors."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    asked = usable(vectors.where(is_query), id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    lots = -(-asked.count() // QUERY_ROWS) or 1
    parts = None
    for lot in range(lots):
        # a hash deals the ids to lots of about QUERY_ROWS
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(lots)) == lot).orderBy("id").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        q = _matrix(got.column("v").chunk(0))
        held = spark.sparkContext.broadcast((got.column("id").to_numpy(), q))
        part = rows.mapInArrow(_search(held, k), _SCHEMA)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], _SCHEMA)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
