"""Quality classifier: ordinal cumulative-link regression on hashed text features.

P(grade <= k) = logistic(t_k - w.x) with ordered thresholds t_0 < t_1 < ... and one weight vector w shared by all of them.
x holds presence features hashed to 2**BITS buckets: lower-cased words, the first five letters of longer ones, the shapes of tokens (case, trailing marks)
and coarse counts of repetition. The expected grade is the sum over k of P(grade > k); a text is selected when
P(grade >= want) >= cut.

Training takes at most MAX_TRAIN labelled rows, those with the least xxhash64(doc_id, 11): a documented bound, so the fit is the same
job at every corpus size. It runs in numpy on the driver over bucket numbers only; scoring covers every row in executors
with a weight vector of fixed size (2**BITS floats).

Grades come from the labels: 2 = good and not toxic, 1 = one of the two, 0 = neither; null labels are left out.

Cases: null text counts as ''; a text without words has the bias feature only; a document labelled twice counts twice; no usable
labels (or one grade only) give weights of 0 and thresholds from the add-one grade shares; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

BITS, MAX_TRAIN, GRADES = 18, 20_000, 3
_TOKEN_END = re.compile(r"[^\w\s]+$")


class _Buckets(dict):
    """Token to the buckets of its word and its shape, of those in `only` (all, if None); forgets all when it holds 200,000 tokens."""

    def __init__(self, only: frozenset[int] | None = None) -> None:
        super().__init__()
        self.only = only

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        core = token[:-1] if token[-1] in ".,;:?" else token
        word = core.lower()
        if core.isalpha() and word.isalpha():  # most tokens: what parts() would find, sooner
            found = [_UPPER] if len(core) > 1 and core.isupper() else []
            found.append(bucket("w" + word))
            if len(word) > 5:
                found.append(bucket("p" + word[:5]))
        else:
            found = self.parts(token)
        b = self[token] = tuple(found) if self.only is None else tuple(b for b in found if b in self.only)
        return b

    @staticmethod
    def parts(token: str) -> list[int]:
        end = _TOKEN_END.search(token)
        mark = end.group()[-3:] if end else ""
        stem = token[: end.start()] if end else token
        case = "U" if len(stem) > 1 and stem.isupper() else "l"
        shape = f"#{case}{mark if len(mark) != 1 or mark not in '.,;:?' else ''}"
        if not stem:
            shape += token[:3]
        found = [bucket(shape)] if shape != "#l" else []
        for word in re.findall(r"\w+", token.lower()):
            found.append(bucket("w" + word))
            if len(word) > 5:
                found.append(bucket("p" + word[:5]))
        return found


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature if feature.isascii() else feature.encode("utf-8", "surrogatepass")) >> (32 - BITS)


_UPPER = bucket("#U")


def features(text: str, cache: _Buckets) -> list[int]:
    """Distinct buckets of a text, in increasing order; only those that the cache keeps."""
    tokens = text.split()
    kinds = set(tokens)
    out = set(chain.from_iterable(map(cache.__getitem__, kinds)))
    if len(tokens) >= 20:
        # how much of the text repeats: an adjacent repeat is rare in prose
        repeats = sum(map(eq, tokens, islice(tokens, 1, None))) / len(tokens)
        shares = {bucket(f"=types{int(8 * len(kinds) / len(tokens))}"), bucket(f"=repeats{min(4, int(10 * repeats))}")}
        out |= shares if cache.only is None else shares & cache.only
    return sorted(out)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and k (columns)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, order: np.ndarray, n_grades: int = GRADES, rounds: int = 300, rate: float = 1.0, l1: float = 1.0, seen: int = 3) -> Model:
    """Proximal Adagrad on the mean negative log-likelihood; buckets of fewer than `seen` rows get no weight.

    flat: the rows' buckets one after the other (int32); sizes: buckets a row; order: the order in which rows are summed.
    The L1 penalty of a bucket is l1 x its noise, sqrt(rows that have it) / rows. The second half of the rounds refits the buckets that the penalty left, without it, so that it shrinks none of them.
    Beyond flat itself, memory goes with the buckets that enter the fit: the rest is counted a block of rows at a time.
    """
    size = 1 << BITS
    w = np.zeros(size)
    share = (np.bincount(grades, minlength=n_grades) + 1) / (len(grades) + n_grades) if len(grades) else np.full(n_grades, 1 / n_grades)
    below = np.cumsum(share)[:-1]
    t = np.log(below / (1 - below))
    if len(np.unique(grades)) < 2:
        return Model(w.astype(np.float32), t)
    ends, step = np.r_[0, np.cumsum(sizes)], 500
    df, total = np.zeros(size, np.int64), np.zeros(size)
    for i in range(0, len(sizes), step):
        part = flat[ends[i] : ends[min(i + step, len(sizes))]]
        df += np.bincount(part, minlength=size)
        total += np.bincount(part, weights=np.repeat(grades[i : i + step], sizes[i : i + step]), minlength=size)
    # only buckets whose mean grade is off by more than noise would take it enter the fit
    off = np.abs(total - df * grades.mean()) / np.sqrt(np.maximum(df, 1)) / grades.std()
    enters = (off >= 3) & (df >= seen)
    place = np.empty(len(sizes), np.int32)
    place[order] = np.arange(len(sizes), dtype=np.int32)
    parts = []
    for i in range(0, len(sizes), step):
        part = flat[ends[i] : ends[min(i + step, len(sizes))]]
        use = enters[part]
        parts.append((part[use], np.repeat(place[i : i + step], sizes[i : i + step])[use]))
    flat, owner = (np.concatenate(p) for p in zip(*parts))
    del parts
    by_row = np.argsort(owner, kind="stable")
    flat, owner, grades = flat[by_row], owner[by_row], grades[order]
    names, flat = np.unique(flat, return_inverse=True)
    v, n = np.zeros(len(names)), len(sizes)
    gv, gt = np.full(len(v), 1e-8), np.full(len(t), 1e-8)
    penalty = l1 * np.sqrt(df[names]) / n
    low, high = grades > 0, grades < n_grades - 1
    for turn in range(rounds):
        s = np.bincount(owner, weights=v[flat], minlength=n)
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        up = np.where(high, sig(t[np.minimum(grades, n_grades - 2)] - s), 1.0)
        lo = np.where(low, sig(t[np.maximum(grades - 1, 0)] - s), 0.0)
        p = np.maximum(up - lo, 1e-9)
        du, dl = up * (1 - up) / p, lo * (1 - lo) / p  # d log p / d t_grade and, negated, / d t_{grade-1}
        ds = (du - dl) / n  # gradient of the loss by the score
        g = np.bincount(flat, weights=ds[owner], minlength=len(v))
        tg = np.array([(dl[grades == k + 1].sum() - du[grades == k].sum()) / n for k in range(n_grades - 1)])
        gv += g * g
        gt += tg * tg
        step = rate / np.sqrt(gv)
        v = v - step * g
        if turn < rounds // 2:
            v = np.sign(v) * np.maximum(np.abs(v) - step * penalty, 0)
        if turn == rounds // 2 - 1:  # the rest of the rounds see these alone
            kept = v != 0
            names, v, gv = names[kept], v[kept], np.full(kept.sum(), 1e-8)
            stay = kept[flat]
            owner, flat = owner[stay], (np.cumsum(kept) - 1)[flat[stay]]
        t = np.sort(t - rate / np.sqrt(gt) * tg)
    w[names] = v
    return Model(w.astype(np.float32), t)


def grade_of(quality: Column, toxic: Column) -> Column:
    return (quality.cast("int") + 1 - toxic.cast("int")).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """buckets (array of int), grade, h (hash of the buckets) of at most `most` labelled rows."""
    label, grade = fresh(docs, "_q_id", "_q_grade")
    named = labels.select(F.col(id_col).alias(label), grade_of(F.col("quality"), F.col("toxic")).alias(grade)).where(F.col(label).isNotNull() & F.col(grade).isNotNull())
    few = named.orderBy(F.xxhash64(label, F.lit(11)), label, grade).limit(most)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.join(F.broadcast(few), F.col(id_col) == F.col(label)).select(_buckets(text).alias("buckets"), F.col(grade).alias("grade"))
    # an id on several documents gives a row for each
    return rows.withColumn("h", F.xxhash64("buckets")).orderBy("h", "grade").limit(most)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _buckets(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    cache = _Buckets()
    for texts in it:
        yield pd.Series([np.array(features(t, cache), np.int32) for t in texts])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    got = training_rows(docs, labels, most, id_col, text_col).toArrow().combine_chunks()
    if not got.num_rows:
        return fit(*(np.empty(0, np.int32),) * 2, np.empty(0, np.int64), np.empty(0, np.int64))
    buckets = got.column("buckets").chunk(0)
    grades, sizes = got.column("grade").to_numpy().astype(np.int64), np.diff(buckets.offsets.to_numpy())
    # in a fixed order: sums of floats depend on it
    order = np.lexsort((got.column("h").to_numpy(), sizes, grades))
    return fit(buckets.flatten().to_numpy(), sizes, grades, order)


def scorer(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct (expected_grade, p_good): for docs' session, with the weights as a broadcast of fixed size."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, p_good double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        # most buckets weigh nothing: tokens that have no other are done with one look-up
        cache = _Buckets(frozenset(np.flatnonzero(m.weights).tolist()))
        for texts in it:
            s = np.array([m.weights[features(t, cache)].sum(dtype=np.float64) if t else 0.0 for t in texts])
            tails = m.tails(s)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_good": tails[:, -1]})

    return score(F.coalesce(F.col(text_col), F.lit("")))


def select_good(docs: DataFrame, model: Model, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with `expected_grade`, `p_good` and `keep` (p_good >= cut); columns of docs with these names are replaced."""
    docs = docs.drop("expected_grade", "p_good", "keep")
    (q,) = fresh(docs, "_q")
    scored = docs.withColumn(q, scorer(docs, model, text_col))
    return scored.select(*docs.columns, f"{q}.expected_grade", f"{q}.p_good", (F.col(f"{q}.p_good") >= cut).alias("keep"))
