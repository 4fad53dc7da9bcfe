"""Ranked lexical search, exact, by impact-ordered score-at-a-time evaluation.

A posting's impact is its whole share of a score: w(term) x ((10**9 tf) div (1000 tf + 8 m)), see BODY. Documents go to blocks; a block
groups its postings by term and exact impact, and a query takes the groups of its terms by falling impact, adding them to the
scores of the documents. What a document can still get is at most the sum, over the query's terms, of the largest impact not yet
taken. Evaluation stops as soon as that proves which documents can be among the k best (all others stay below the kth
score, be it of this block or of earlier blocks of the task), and the scores of these are completed from the block's forward
index. Documents at equal scores are never dropped by a bound. Each task keeps its k best for a query; a window over (query) ranks
those of all tasks.

The texts are read once for each lot of queries (LOT query terms; a stated query set): a stored index has, for each document, its
length and the frequencies of the lot's terms. Spark sums up lengths and counts documents by term over that index. Memory holds one lot of
queries and one block of postings, however many documents there are.

Cases: null and empty texts have no terms and don't count as documents; null document ids count in the statistics but can't be returned;
repeated ids are documents of their own; rows of one item are one query of all their terms; null items and items without terms
give no rows; equal scores go by ascending document; scores of 0 aren't returned; an empty table gives none. Only ids and texts are
read of either table, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Shares of a document's length in m, of 100; frequencies and weights are taken in thousandths.
BODY = 90
#: Query terms of a lot, postings of a block, and documents whose scores are completed at once.
LOT, BLOCK_POSTINGS, COMPLETE = 1_000_000, 1_000_000, 64
#: Bytes that end a term (ASCII but letters and digits) become blanks; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_HITS = "item long, doc long, score long"


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return raw.translate(_FOLD).split()


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [sorted(set(terms(x.as_py()))) for x in batch.column("text")]
        item = np.repeat(batch.column("item").to_numpy(), [len(g) for g in got])
        yield pa.record_batch([pa.array(item, pa.int64()), pa.array([t for g in got for t in g], pa.binary())], names=["item", "term"])


def _index(held):
    """A row for each document: its length in terms, and the query terms in it with their frequencies."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for batch in batches:
            size, bounds, which, often = [], [0], [], []
            for x in batch.column("text"):
                found = terms(x.as_py())
                seen = Counter(map(number.get, found))
                seen.pop(None, None)
                size.append(len(found))
                which += seen
                often += seen.values()
                bounds.append(len(which))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(a, pa.int32())) for a in (which, often)]
            yield pa.record_batch([batch.column("doc"), pa.array(size, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])

    return index


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of the next."""
    at = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - at, size)


class Block:
    """Postings of some documents: by (term, impact down), and by document."""

    def __init__(self, docs: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        some = impact > 0
        doc, term, impact = doc[some], term[some], impact[some]
        self.docs = docs
        self.own_term, self.own_impact = term, impact  # forward index: by document
        self.own_at = np.searchsorted(doc, np.arange(len(docs) + 1))
        order = np.lexsort((-impact, term))
        self.doc, term, impact = doc[order], term[order], impact[order]
        new = np.r_[True, (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])] if len(term) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.start, len(term)])
        self.term, self.impact = term[self.start], impact[self.start]

    def best(self, asked: np.ndarray, mask: np.ndarray, k: int, kth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the documents that may be among the k best of a query, with their scores; kth: a score that k documents elsewhere reach (or 0)."""
        lo, hi = np.searchsorted(self.term, asked), np.searchsorted(self.term, asked, side="right")
        groups = _spans(lo, hi - lo)
        if not len(groups):
            return groups, groups
        falling = np.argsort(-self.impact[groups], kind="stable")
        owner = np.repeat(np.arange(len(asked)), hi - lo)[falling]
        groups = groups[falling]
        upto, impact = np.cumsum(self.size[groups]), self.impact[groups]
        got = np.zeros(len(self.docs), np.int64)
        done, step = 0, max(1, int(upto[-1]) >> 6)
        while True:
            left = np.zeros(len(asked), np.int64)
            left[owner[done:][::-1]] = impact[done:][::-1]  # the largest of each term is written last
            rest = int(left.sum())
            least = max(kth, int(np.partition(got, -k)[-k]) if len(got) >= k else 0)
            if rest < max(least, 1):
                may = np.flatnonzero((got + rest >= least) & (got > 0))
                if len(may) <= max(COMPLETE, k) or done == len(groups):
                    break
            if done == len(groups):
                may = np.flatnonzero(got > 0)
                break
            to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + step, side="right")))
            part = groups[done:to]
            np.add.at(got, self.doc[_spans(self.start[part], self.size[part])], np.repeat(impact[done:to], self.size[part]))
            done, step = to, step * 2
        if done == len(groups):
            return may, got[may]
        mask[asked] = True
        size = self.own_at[may + 1] - self.own_at[may]
        at = _spans(self.own_at[may], size)
        score = np.zeros(len(may), np.int64)
        np.add.at(score, np.repeat(np.arange(len(may)), size), np.where(mask[self.own_term[at]], self.own_impact[at], 0))
        mask[asked] = False
        return may, score


def _blocks(batch: pa.RecordBatch, weight: np.ndarray, n_docs: int, length: int) -> Iterator[Block]:
    at = batch.column("terms").offsets.to_numpy()
    term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
    doc, n = batch.column("doc").to_numpy(), batch.column("n").to_numpy()
    at, lo = at - at[0], 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_POSTINGS, side="right")) - 1)
        row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
        t, f = term[at[lo] : at[hi]], tf[at[lo] : at[hi]]
        m = (100 - BODY) + (BODY * n[lo:hi] * n_docs) // max(length, 1)
        yield Block(doc[lo:hi], row, t, weight[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m[row])))
        lo = hi


def _rank(held, k: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, at, asked, weight, n_docs, length = held.value
        mask, none = np.zeros(len(weight), bool), np.zeros(0, np.int64)
        best = [(none, none)] * len(items)
        for batch in batches:
            for block in _blocks(batch, weight, n_docs, length):
                for i in range(len(items)):
                    doc, score = best[i]
                    row, more = block.best(asked[at[i] : at[i + 1]], mask, k, int(score[-1]) if len(score) == k else 0)
                    if len(row):
                        doc, score = np.r_[doc, block.docs[row]], np.r_[score, more]
                        top = np.lexsort((doc, -score))[:k]
                        best[i] = doc[top], score[top]
        size = [len(d) for d, _ in best]
        if sum(size):
            columns = np.repeat(items, size), np.concatenate([d for d, _ in best]), np.concatenate([s for _, s in best])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["item", "doc", "score"])

    return rank


def _of_lot(slim: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """item, doc, score: k best a task for the queries asked (item, term), which the driver and every task can hold."""
    spark = slim.sparkSession
    got = asked.orderBy("item", "term").toArrow().combine_chunks()
    if not got.num_rows:
        return spark.createDataFrame([], _HITS)
    item, word = got.column("item").to_numpy(), got.column("term").to_pylist()
    number = {t: i for i, t in enumerate(sorted(set(word)))}
    words = spark.sparkContext.broadcast(number)
    index = stored(slim.mapInArrow(_index(words), "doc long, n long, terms array<int>, tfs array<int>"), "lexical-index")
    words.destroy()
    n_docs, length = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weights, weight = df.select("term", w.alias("w")).toArrow(), np.zeros(len(number), np.int64)
    weight[weights.column("term").to_numpy()] = weights.column("w").to_numpy()
    items, first = np.unique(item, return_index=True)
    held = spark.sparkContext.broadcast((items, np.r_[first, len(item)], np.array([number[t] for t in word]), weight, n_docs, length))
    out = stored(index.where(F.col("doc").isNotNull() & (F.size("terms") > 0)).mapInArrow(_rank(held, k), _HITS), "lexical-hits")
    held.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item, rank (from 1), id, score of the k best documents for every item."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), _text(text_col).alias("text"))
    queries = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), _text(query_col).alias("text"))
    asked = stored(queries.mapInArrow(_query_terms, "item long, term binary").distinct(), "lexical-queries")
    lots = -(-asked.count() // LOT) or 1
    parts = [_of_lot(slim, asked.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == lot), k) for lot in range(lots)]
    hits = reduce(DataFrame.unionByName, parts)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
