"""Benchmark decontamination by template canonicalisation.

A text becomes tokens (blank-separated, marks at the ends stripped, lower-cased); numbers, names and units become the
typed placeholders <num>, <name>, <unit>. A name is a capitalised token; whether one that begins a sentence is a name can't be told, so
texts have two templates, with those tokens as words and as names, and each is judged on its own. A unit is a word of UNITS after a number. Windows of WINDOW template tokens of every document are hash-joined with those of the benchmark. Hits of a
document and an item on one alignment (document position - item position) count together: the item is found if at least
NEED of its windows hit there (all, if it has fewer: runs of WINDOW + NEED - 1 = 13 tokens) and the slots agree, i.e. each
value of a benchmark slot stands for one document value and back. So `3 apples ... 3` is caught as `7 apples ... 7`, not as `7 ... 9`.
Where slots disagree, an alignment still counts if at least VERBATIM of its windows hit word for word: a long passage copied with a number edited.
Windows of under LEAST plain tokens say nothing as templates: they are joined by their literal tokens, so verbatim copies are found.

Before the join a bitmap of fixed size over the benchmark's window hashes (2**FILTER_BITS bits, whatever the benchmark's
size) thins the documents' windows where they are made; it has no false negatives, and the join is exact.

Cases: null text is empty; items of no token never match; items of 1 to WINDOW - 1 tokens match as one window of
their own length (literally, if it has under LEAST plain tokens: a one-word item is found in every document with that word);
null doc_id is reported as null; repeated rows of an id count once; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, maybe_broadcast, stored
from .near_dup import _mix

WINDOW, NEED, LEAST, VERBATIM, FILTER_BITS = 8, 6, 5, 24, 24
# Unit words.
UNITS = frozenset(
    "mm cm m km in ft yd mi miles mile inch inches feet foot mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent usd eur gbp dollar dollars euro euros cent cents pound pounds degrees mph kmh kwh w kw v volts".split()
)
_NUMBER = re.compile(r"[-+]?[$€£]?\d+(?:[.,:/-]\d+)*%?")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_CAP, _END, _NUM, _UNIT = (np.uint64(1 << i) for i in range(4))
_FLAGS = np.uint64(15)
_SLOT = {kind: np.uint64(xxhash.xxh64_intdigest(kind)) & ~_FLAGS for kind in ("<num>", "<name>", "<unit>")}
_P = np.uint64(0x9E3779B97F4A7C15)
#: Sets hashes of literal windows apart from those of templates.
_LITERAL = np.uint64(0xD6E8FEB86659FD93)


class _Tokens(dict):
    """Token to its hash with four flag bits (capitalised, ends a sentence, number, unit); 0 if nothing but marks."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        core = _EDGE.sub("", token)
        value = 0
        if any(map(str.isalnum, core)):
            low = core.lower()
            value = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) & ~15
            value |= core[0].isupper() | (token.rstrip("\"')]»”")[-1:] in ".!?:") << 1 | bool(_NUMBER.fullmatch(core)) << 2 | (low in UNITS) << 3
        elif token[-1:] in ".!?":
            value = 2
        self[token] = value
        return value


Template = tuple[np.ndarray, np.ndarray]


def templates(text: str, tokens: _Tokens) -> tuple[Template, Template]:
    """Twice the template token hashes of a text, and for slots the hash of their value (0 elsewhere): capitalised tokens that begin a sentence as words, as names."""
    words = text.split()
    x = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
    ends = np.r_[True, (x & _END) > 0][: len(x)]
    plain = (x & ~_FLAGS) > 0
    if not plain.all():  # a mark that stands alone still ends a sentence
        at = np.maximum.accumulate(np.where(plain, np.arange(len(x)), -1))
        lone = np.flatnonzero(~plain & ((x & _END) > 0))
        for i in lone:
            nxt = i + 1
            while nxt < len(x) and not plain[nxt]:
                nxt += 1
            if nxt < len(x):
                ends[nxt] = True
        prev = np.r_[-1, at[:-1]]
        skipped = plain & (prev >= 0) & (prev < np.arange(len(x)) - 1)
        ends[skipped] |= (x[prev[skipped]] & _END) > 0
        x, ends = x[plain], ends[plain]
    number = (x & _NUM) > 0
    unit = ((x & _UNIT) > 0) & np.r_[False, number[:-1]][: len(x)]
    capital = ((x & _CAP) > 0) & ~number & ~unit
    value = x & ~_FLAGS
    out = []
    for name in (capital & ~ends, capital):
        t = np.where(number, _SLOT["<num>"], np.where(name, _SLOT["<name>"], np.where(unit, _SLOT["<unit>"], value)))
        out.append((t, np.where(number | name | unit, value, np.uint64(0))))
    return out[0], out[1]


def windows(t: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` template tokens."""
    n = len(t) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = h * _P + t[j : j + n]
    return _mix(h)


def window_keys(t: np.ndarray, slots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of all windows of `size` tokens, and which of them are literal: those of under LEAST plain tokens."""
    h = windows(t, size)
    if not len(h):
        return h, np.empty(0, bool)
    plain = np.cumsum(np.r_[0, slots == 0])
    literal = plain[size:] - plain[:-size] < LEAST
    if literal.any():
        h = np.where(literal, _mix(windows(np.where(slots != 0, slots, t), size) + _LITERAL), h)
    return h, literal


def all_windows(pair: tuple[Template, Template], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of both templates, in up to three lots: kind (3: of both, 1 or 2: of that one alone), places, keys, literal flags, and the slots of the text."""
    (h, literal), (h2, literal2) = (window_keys(*x, size) for x in pair)
    same = h == h2
    for kind, keys, lit, slots, use in ((3, h, literal, pair[0][1], same), (1, h, literal, pair[0][1], ~same), (2, h2, literal2, pair[1][1], ~same)):
        at = np.flatnonzero(use)
        if len(at):
            yield kind, at, keys[at], lit[at], slots


_WINDOWS = "item_id long, ipos int, h long, bslots array<long>, literal boolean, kind int, total int, templates array<int>"


def _bench(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = _Tokens()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            pair = templates(text, tokens)
            if not len(pair[0][0]):
                continue
            size = min(WINDOW, len(pair[0][0]))
            lots = list(all_windows(pair, size))
            total = sum(len(at) for kind, at, *_ in lots if kind & 1)
            plain = [int(sum((~literal).sum() for kind, _, _, literal, _ in lots if kind & of)) for of in (1, 2)]
            for kind, at, keys, literal, slots in lots:
                rows += [(item, i, k, slots[i : i + size].view(np.int64).tolist(), lit, kind, total, plain) for i, k, lit in zip(at.tolist(), keys.view(np.int64).tolist(), literal.tolist())]
        cols = list(zip(*rows)) or [[]] * 8
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item_id", "ipos", "h", "bslots", "literal", "kind", "total", "templates"])


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    slim = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(slim.mapInArrow(_bench, _WINDOWS), "bench-windows")


def _bitmap(bench: DataFrame) -> np.ndarray:
    """Bits of the first FILTER_BITS bits of all hashes, gathered as at most 2**(FILTER_BITS - 6) longs."""
    top = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = bench.select(F.shiftright(top, 6).alias("i"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))").alias("b"))
    got = words.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[got.column("i").to_numpy()] = got.column("b").to_numpy()
    return bits.view(np.uint64)


def _scan(held, sizes: list[int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bits = _Tokens(), held.value
        for batch in batches:
            ids, pos, hs, slots, kinds, own = [], [], [], [], [], batch.column("doc_id")
            for row, text in enumerate(batch.column("text").to_pylist()):
                pair = templates(text, tokens)
                for size in sizes:
                    for kind, at, h, _, s in all_windows(pair, size):
                        top = h >> np.uint64(64 - FILTER_BITS)
                        hit = np.flatnonzero(bits[top >> np.uint64(6)] >> (top & np.uint64(63)) & np.uint64(1))
                        ids += [row] * len(hit)
                        kinds += [kind] * len(hit)
                        pos += at[hit].tolist()
                        hs += h[hit].view(np.int64).tolist()
                        slots += [s[i : i + size].view(np.int64) for i in at[hit]]
            yield pa.record_batch(
                [own.take(pa.array(ids, pa.int64())), pa.array(pos, pa.int32()), pa.array(hs, pa.int64()), pa.array(slots, pa.list_(pa.int64())), pa.array(kinds, pa.int32())],
                names=["doc_id", "pos", "h", "dslots", "dkind"],
            )

    return scan


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows (item windows found on the best alignment), share of the item's windows, verbatim (no slot differs)."""
    spark = docs.sparkSession
    bench = benchmark_windows(benchmark)
    sizes = sorted(r[0] for r in bench.select(F.size("bslots")).distinct().collect())  # 1 to WINDOW
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = spark.sparkContext.broadcast(_bitmap(bench))
    hits = slim.mapInArrow(_scan(held, sizes), "doc_id long, pos int, h long, dslots array<long>, dkind int")
    both = hits.join(maybe_broadcast(bench), "h").where(F.size("dslots") == F.size("bslots"))
    of = F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda x: F.col("kind").bitwiseAND(F.col("dkind")).bitwiseAND(x) > 0)).alias("of")
    slots = F.filter(F.arrays_zip("bslots", "dslots"), lambda s: s["bslots"] != 0).alias("s")
    both = both.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("diag"), "ipos", "literal", "total", "templates", of, slots)
    same = F.forall("s", lambda x: x["bslots"] == x["dslots"])
    # what is grouped is at most an item's windows
    by = both.groupBy("doc_id", "item_id", "diag", "of").agg(
        F.count_distinct("ipos").alias("n"), F.count_distinct(F.when(~F.col("literal"), F.col("ipos"))).alias("nt"), F.count_distinct(F.when(same, F.col("ipos"))).alias("exact"),
        F.max("total").alias("total"), F.max(F.element_at("templates", F.col("of"))).alias("templates"), F.array_distinct(F.flatten(F.collect_set("s"))).alias("s")
    )
    agree = (F.size("s") == F.size(F.array_distinct(F.transform("s", lambda x: x["bslots"])))) & (F.size("s") == F.size(F.array_distinct(F.transform("s", lambda x: x["dslots"]))))
    # literal windows can make up for templates, but their lack in a copy with other values takes nothing away
    enough = (F.col("n") >= F.least(F.lit(NEED), F.col("total"))) | ((F.col("templates") > 0) & (F.col("nt") >= F.least(F.lit(NEED), F.col("templates"))))
    by = by.where((agree & enough) | (F.col("exact") >= VERBATIM))
    best = by.groupBy("doc_id", "item_id").agg(F.max(F.struct("n", same.alias("same"), "total")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").cast("long").alias("n_windows"), (F.col("b.n") / F.col("b.total")).alias("share"), F.col("b.same").alias("verbatim"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id has a leak; rows of null id go only if a row of null id leaks."""
    (name,) = fresh(docs, "_dc_id")
    ids = stored(leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(name)).distinct(), "leak-ids")
    return docs.join(maybe_broadcast(ids), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
