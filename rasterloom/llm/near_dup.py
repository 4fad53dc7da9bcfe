"""Near-duplicate documents by Order MinHash, verified by banded alignment of words.

Texts are lower-cased word sequences (runs of word characters). A k-mer is four words, labelled with its
occurrence number. For each of `SKETCHES` hash functions the `PICK` least labelled k-mers are kept in text order; their
hash is a bucket key, so two texts share a key only if the same k-mers come in the same order. Exact copies (equal
texts) are one class first. In every bucket each document is aligned with the bucket's least id, which joins the usual groups.

What that leaves open, documents of buckets whose leader turned one down and all texts of up to `SHORT` words (of whose k-mers too few
may survive the edits), is settled exactly, without listing a bucket's pairs. Texts of the wanted similarity share a known number of
word pairs, so each puts up only its rarest ones, as many as such texts must share one of (prefix filtering):
  - under a word pair of at most `FEW` texts all of them meet, so a row meets a bounded number of others;
  - texts with a word pair of more texts first meet `LEADERS` leaders of it, which joins large groups; then those of different classes meet
    under their rarest single words, if their lengths and a bitmap of their words (`BITMAP` bits) allow the similarity.
So two texts that share a bucket, or are short, end in different classes only if no chain of links joins them.
Two texts are linked if 1 - distance / longer length >= `SIMILARITY`, where distance is the word edit distance.

Cases: null text counts as ''; equal texts are copies, empty ones too; texts of one to `K + PICK - 2` words have all
k-mers they hold (the whole text if shorter than four words) as their key; texts with no word link to equal texts only; rows
with null id get class null; rows with one id and different texts are joined in one class; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, maybe_broadcast, stored
from .components import components

K, PICK, SKETCHES, SIMILARITY = 4, 2, 64, 0.8
#: Texts of up to so many words all meet under their rarest words, so that no pair of them is missed.
SHORT = 100
#: Word pairs of at most so many open texts let all of them meet; texts with one of more texts meet under single words.
FEW = 64
#: Documents of a frequent word pair that all others of it meet first.
LEADERS = 4
#: Bits of the bitmap of a text's words.
BITMAP = 2048
#: Documents of a word that meet in one part of a join.
BLOCK = 512
#: Bits of a word's hash that name the slot it is counted in.
SLOT_BITS = 18
WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.random.default_rng(7).integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
#: Columns of a sketch block, so that one very long text needs no more than 64 x this many hashes at once.
_BLOCK = 1 << 14


class _WordHashes(dict):
    """Word to 64-bit hash; forgets all when it holds 200,000 words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX2
    return x ^ (x >> np.uint64(29))


def kmer_hashes(words: list[str], hashes: _WordHashes, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of words, in order; one for the whole text if it is shorter."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * _MIX + w[j : j + n]
    return _mix(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """h with the occurrence number (0, 1, ...) of each equal hash mixed in."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return h
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    occ = np.empty(len(s), np.uint64)
    occ[order] = np.arange(len(s)) - first
    return np.where(occ > 0, _mix(h + occ * _MIX), h)


def order_sketch(h: np.ndarray) -> np.ndarray:
    """SKETCHES keys from the k-mer hashes h of a text."""
    x = labelled(h)
    p = min(PICK, len(x))
    best = np.empty((SKETCHES, 0), np.uint64)
    at = np.empty((SKETCHES, 0), np.int64)
    for start in range(0, len(x), _BLOCK):
        part = x[start : start + _BLOCK]
        r = part * _SEEDS[:, None]
        r ^= r >> np.uint64(32)
        r *= _MIX2
        rows = np.arange(SKETCHES)
        for _ in range(min(p, len(part))):
            i = r.argmin(axis=1)
            best = np.c_[best, r[rows, i]]
            at = np.c_[at, i + start]
            r[rows, i] = np.uint64(2**64 - 1)
        if best.shape[1] > p:
            top = np.argsort(best, axis=1, kind="stable")[:, :p]
            best, at = np.take_along_axis(best, top, 1), np.take_along_axis(at, top, 1)
    at = np.sort(at, axis=1)
    key = np.arange(1, SKETCHES + 1, dtype=np.uint64) * _MIX
    for j in range(p):
        key = _mix(key * _MIX + h[at[:, j]])
    return key


_SKETCH_SCHEMA = "doc_id long, copy string, n_words int, keys array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        n_words, keys = [], []
        for text in batch.column("text").to_pylist():
            words = WORD.findall(text.lower())
            n_words.append(len(words))
            keys.append(order_sketch(kmer_hashes(words, hashes)).view(np.int64) if words else np.empty(0, np.int64))
        sizes = np.cumsum([0, *map(len, keys)], dtype=np.int32)
        flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("copy"), pa.array(n_words, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), flat)],
            names=["doc_id", "copy", "n_words", "keys"],
        )


def edit_distance(a: list[str], b: list[str], most: int) -> int | None:
    """Word edit distance of a and b if it is at most `most`, else None.

    Banded alignment: on the diagonals within `most` of the main one, the furthest reach for 0, 1, 2, ... edits. Beyond
    12 edits bit vectors over the band take over, whose cost does not grow with the square of the edits.
    """
    if abs(len(a) - len(b)) > most:
        return None
    head = 0
    for x, y in zip(a, b):
        if x != y:
            break
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        d = max(len(a), len(b))
        return d if d <= most else None
    if len(a) < len(b):
        a, b = b, a
    ids: dict[str, int] = {}
    x = [ids.setdefault(w, len(ids)) for w in a]
    y = [ids.setdefault(w, len(ids)) for w in b]
    counts = np.bincount(x, minlength=len(ids)) - np.bincount(y, minlength=len(ids))
    if max(counts[counts > 0].sum(), -counts[counts < 0].sum()) > most:
        return None  # words without a partner alone cost more
    n, m = len(x), len(y)
    reach = {0: _slide(x, y, 0, 0)}
    if reach[0] == n == m:
        return 0
    for e in range(1, min(most, 12) + 1):
        new = {}
        for k in range(max(-e, -n), min(e, m) + 1):  # k = j - i
            i = max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -2))
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            new[k] = i = _slide(x, y, i, i + k)
            if i == n and i + k == m:
                return e
        reach = new
    return _banded(x, y, min(most, n)) if most > 12 else None


def _slide(x: list[int], y: list[int], i: int, j: int) -> int:
    n, m = len(x), len(y)
    while i < n and j < m and x[i] == y[j]:
        i += 1
        j += 1
    return i


def _banded(x: list[int], y: list[int], most: int) -> int | None:
    """Edit distance on the band |i - j| <= t, with t grown until it proves the distance or reaches `most`."""
    held: dict[int, int] = {}
    for i, w in enumerate(x):
        held[w] = held.get(w, 0) | 1 << i
    t = max(64, abs(len(x) - len(y)))
    while True:
        t = min(t, most)
        d = _band(held, len(x), y, t)
        if d is not None or t == most:
            return d
        t *= 4


def _band(held: dict[int, int], n: int, y: list[int], t: int) -> int | None:
    """The distance if it is at most t, from the band's columns as bit vectors of vertical differences.

    Bit b of a column j stands for row j - t + b; held[w] has bit i - 1 for every row i whose word is w. Rows up to 0 count as equal
    to row 0, so their differences are 0. The distance is followed down the band's lower edge to row n, then along it.
    """
    m = len(y)
    mask, edge = (1 << 2 * t + 1) - 1, 1 << 2 * t
    rise, fall, d = mask ^ ((1 << t) - 1), 0, t
    for j in range(1, m + 1):
        s = j - t - 1
        p = held.get(y[j - 1], 0)
        same = (p >> s if s >= 0 else p << -s) & mask
        diag = ((((same & rise) + rise) ^ rise) | same | fall) & mask  # rows that a diagonal step reaches free
        up, down = fall | (mask ^ (diag | rise)), diag & rise
        if j + t <= n:
            d += not diag & edge
        else:
            b = n - j + t
            d += (up >> b & 1) - (down >> b & 1)
            if d - (m - j) > t:
                return None
        low = diag >> 1
        rise, fall = down | (mask ^ (low | up)), low & up
    return d if d <= t else None


def similarity(a: list[str], b: list[str], least: float = SIMILARITY) -> float | None:
    """1 - edit distance / longer length, or None where that is under least. No words: 1.0 for both, else None."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    d = edit_distance(a, b, int((1 - least) * longer + 1e-9))
    return None if d is None else 1 - d / longer


def _verify(least: float):
    @F.pandas_udf("double")
    def verified(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last: tuple[str, list[str]] = ("", [])
        for left, right in it:
            out = []
            for a, b in zip(left, right):
                if a != last[0]:
                    last = (a, WORD.findall(a.lower()))
                out.append(similarity(last[1], WORD.findall(b.lower()), least))
            yield pd.Series(out, dtype="float64")

    return verified


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("copy"), text.alias("text"))
    return stored(slim.mapInArrow(_sketch, _SKETCH_SCHEMA), "omh-sketches")


def _meet(rows: DataFrame) -> DataFrame:
    """rows (key, doc, n) of keys that several documents share, with the least of them as leader."""
    heads = rows.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("lead"), F.max("doc").alias("top"))
    met = rows.join(heads.where("lead.doc < top"), "key").where("doc <> lead.doc")
    return met.select("key", "doc", "n", F.col("lead.doc").alias("leader"), F.col("lead.n").alias("ln"))


def shared_least(n: int, q: int, least: float) -> int:
    """Runs of q words that a text of n words shares at least (copies counted) with any text of similarity `least` or more.

    An edit breaks at most q of the longer text's runs; the least over all longer lengths L is at L = n or where one more edit comes in.
    """
    edits = lambda m: int((1 - least) * m + 1e-9)
    most, e = int(n / least + 1e-9), edits(n)
    more = min(max(n, int(np.ceil((e + 1) / (1 - least) - 1e-9))) if least < 1 else n, most)
    return max(1, min(m - q + 1 - q * edits(m) for m in (n, more, most)))


def _meet_leaders(rows: DataFrame, leaders: int, least: float) -> DataFrame:
    """Distinct pairs (leader, doc) of different classes: each of rows (key, doc, n, root) with `leaders` documents of its key, chosen by a hash.

    Leaders are found among those of 32 salted parts of a key, so no key is sorted as a whole.
    """
    salt, order = F.pmod(F.xxhash64("doc"), F.lit(32)), (F.xxhash64("doc", F.lit(1)), "doc")
    part = rows.withColumn("salt", salt).withColumn("i", F.row_number().over(Window.partitionBy("key", "salt").orderBy(*order))).where(F.col("i") <= leaders)
    lead = part.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("i") <= leaders)
    lead = maybe_broadcast(stored(lead.groupBy("key").agg(F.collect_list(F.struct("doc", "n", "root")).alias("lead")), "omh-leaders"))
    fits = lambda x: F.least(F.col("n"), x["n"]) >= least * F.greatest(F.col("n"), x["n"]) - 1e-9
    to = F.filter("lead", lambda x: (x["root"] != F.col("root")) & fits(x))
    met = rows.join(lead, "key").select("doc", F.explode(to).alias("to"))
    return met.select(F.least("to.doc", "doc").alias("leader"), F.greatest("to.doc", "doc").alias("doc")).distinct()


_FITS = "least(x.n, y.n) >= {least} * greatest(x.n, y.n) - 1e-9"


def _meet_few(rows: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (leader, doc) of different classes under one key. rows: key, doc, n, root, with at most FEW rows a key."""
    on = F.expr("x.key = y.key and x.doc < y.doc and x.root <> y.root and " + _FITS.format(least=least))
    return rows.alias("x").join(rows.alias("y"), on).select(F.col("x.doc").alias("leader"), F.col("y.doc").alias("doc")).distinct()


def _meet_all(rows: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (leader, doc) of different classes under one key whose lengths and bitmaps allow the similarity. rows: key, doc, n, root, bits.

    Every pair has a document outside the key's largest class, so a large class is not met with itself; the other side
    is dealt in parts of about BLOCK documents. Words without a partner cost one edit in the longer text at least, so a pair may differ in
    2 x edits - (longer - shorter) words, and in no more bits.
    """
    sides = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    keys = sides.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("big"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("k"))
    keys = stored(keys.where("k > 1").select("key", "big", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")), "omh-keys")
    held = stored(rows.join(keys, "key"), "omh-all")
    x = held.where("root <> big").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("x")
    y = held.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).alias("y")
    differ = " + ".join(f"bit_count(x.bits.b{i} ^ y.bits.b{i})" for i in range(BITMAP // 64))
    on = F.expr(f"""x.key = y.key and x.part = y.part and x.root <> y.root and (y.root = y.big or y.doc < x.doc) and {_FITS.format(least=least)}
        and {differ} <= 2 * floor({1 - least} * greatest(x.n, y.n) + 1e-9) - abs(x.n - y.n)""")
    return x.join(y, on).select(F.least("x.doc", "y.doc").alias("leader"), F.greatest("x.doc", "y.doc").alias("doc")).distinct()


_TOKEN_SCHEMA = "doc long, tokens array<long>"


def _runs(q: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            out = [labelled(kmer_hashes(WORD.findall(text.lower()), hashes, q)).view(np.int64) for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], names=["doc", "tokens"])

    return runs


def _rare_pairs(docs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """docs (doc, n; distinct and stored), a row for each of the rarest word pairs that a text of the similarity must share one of; `key`, and `c`, the texts that put it up.

    Pairs of one text alone meet nobody: they count as the rarest and are left out.
    """
    held = stored(texts.join(maybe_broadcast(docs.select(F.col("doc").alias("id"))), "id", "left_semi").mapInArrow(_runs(2), _TOKEN_SCHEMA), "omh-word-pairs")
    rows = held.select("doc", F.explode("tokens").alias("key"))
    often = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "omh-often")  # stored: skew can be split in the join
    shared = rows.join(often, "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("k"))  # at most a text's word pairs
    fewest = F.udf(lambda n: shared_least(n, 2, least), "int")
    sizes = docs.select("n").distinct().withColumn("must", fewest("n"))
    # of a text's pairs all but must - 1 are put up, rarest first, those that stand alone before the others
    put = F.greatest(F.lit(0), F.size("k") - F.col("must") + 1)
    kept = docs.join(maybe_broadcast(stored(sizes, "omh-sizes")), "n").join(shared, "doc").select("doc", "n", F.explode(F.slice("k", F.lit(1), put)).alias("k")).select("doc", "n", "k.key")
    kept = stored(kept, "omh-put-up")
    return kept.join(stored(kept.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "omh-often"), "key")


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task and slot: how many tokens of the task fall into it."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_slot(batch.column("tokens").flatten().to_numpy()), minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["slot", "n"])


_BITS = pa.struct([(f"b{i}", pa.int64()) for i in range(BITMAP // 64)])


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """BITMAP bits, as longs, with a bit set for each token."""
    bits = np.zeros(BITMAP, np.uint8)
    bits[tokens.view(np.uint64) % np.uint64(BITMAP)] = 1
    return np.packbits(bits).view(np.int64)


def _rarest(held, least: float):
    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            out, maps = [], []
            for x in batch.column("tokens").to_numpy(zero_copy_only=False):
                x = np.asarray(x, np.int64)
                maps.append(bitmap(x))
                x = x[np.lexsort((x, counts[_slot(x)]))[: len(x) - shared_least(len(x), 1, least) + 1]]
                out.append(x[counts[_slot(x)] > 1])  # a word that stands once meets nobody
            table = np.array(maps, np.int64).reshape(len(maps), BITMAP // 64)
            bits = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], fields=list(_BITS))
            yield pa.record_batch([batch.column("doc"), pa.array(out, pa.list_(pa.int64())), bits], names=["doc", "tokens", "bits"])

    return rarest


def _rare_words(docs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """docs (doc, n, ...; distinct and stored), a row for each of the rarest occurrence-labelled words that a text of the similarity must share one of, as `key`, with the text's `bits`.

    Any order will do for that, so words are counted by hash slot, in a table of fixed size (2**SLOT_BITS numbers) that every task gets;
    rare ones first keeps passages that many texts share out of it.
    """
    held = texts.join(maybe_broadcast(docs.select(F.col("doc").alias("id"))), "id", "left_semi")
    held = stored(held.mapInArrow(_runs(1), _TOKEN_SCHEMA), "omh-words")
    got = held.select("tokens").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    schema = f"{_TOKEN_SCHEMA}, bits struct<{', '.join(f'{f.name}: bigint' for f in _BITS)}>"
    rare = held.mapInArrow(_rarest(docs.sparkSession.sparkContext.broadcast(counts), least), schema)
    return docs.join(rare, "doc").select(*docs.columns, "bits", F.explode("tokens").alias("key"))


def _aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (leader, doc), distinct and stored, with their similarity (null: under least)."""
    ids = pairs.select(F.col("doc").alias("id")).unionByName(pairs.select(F.col("leader").alias("id"))).distinct()
    ids = maybe_broadcast(stored(ids, "omh-ids"))
    held = stored(texts.join(ids, "id", "left_semi"), "omh-texts")
    a = held.select(F.col("id").alias("leader"), F.col("text").alias("a"))
    b = held.select(F.col("id").alias("doc"), F.col("text").alias("b"))
    both = pairs.join(b, "doc").join(a, "leader")
    return stored(both.select("leader", "doc", _verify(least)("a", "b").alias("sim")), "omh-aligned")


def linked(sk: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """node, root of the classes that verified links make of the representatives of exact copies; those without a link are left out. sk: sketches(docs)."""
    reps = sk.where("n_words > 0").groupBy("copy").agg(F.min(F.struct("doc_id", "n_words", "keys")).alias("r"))
    reps = stored(reps.select(F.col("r.doc_id").alias("doc"), F.col("r.n_words").alias("n"), "r.keys"), "omh-reps")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.where("id is not null")
    rows = reps.select("doc", "n", F.explode("keys").alias("key"))
    met = stored(_meet(rows), "omh-met")
    fits = F.least("n", "ln") >= least * F.greatest("n", "ln") - 1e-9
    aligned = _aligned(stored(met.where(fits).select("leader", "doc").distinct(), "omh-pairs"), texts, least)
    roots = stored(components(_links(aligned)), "omh-roots")
    left = stored(_apart(met, maybe_broadcast(roots), "leader", "doc").select("key", "doc"), "omh-left")
    # all documents of the buckets in which the leader turned one down meet again, and all short texts
    keys = maybe_broadcast(stored(left.select("key").distinct(), "omh-keys"))
    short = reps.where(F.col("n") <= SHORT).select("doc", "n")
    again = stored(rows.join(keys, "key", "left_semi").select("doc", "n").unionByName(short).distinct(), "omh-again")
    put = stored(_rare_pairs(again, texts, least), "omh-rare")
    many = put.where(F.col("c") > FEW)
    rest = stored(many.select("doc", "n").distinct(), "omh-rest")
    frequent = rest.limit(1).count() > 0
    pairs = _meet_few(_rooted(put.where(F.col("c") <= FEW), roots), least)
    if frequent:
        pairs = pairs.unionByName(_meet_leaders(_rooted(many, roots), LEADERS, least)).distinct()
    aligned, roots = _more(aligned, roots, pairs, texts, least)
    if frequent:
        words = stored(_rare_words(rest, texts, least), "omh-rare")
        aligned, roots = _more(aligned, roots, _meet_all(_rooted(words, roots), least), texts, least)
    return roots


def _more(aligned: DataFrame, roots: DataFrame, pairs: DataFrame, texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(aligned, roots) after the alignment of those pairs (leader, doc) that are not yet aligned."""
    pairs = stored(pairs.join(aligned, ["leader", "doc"], "left_anti"), "omh-pairs")
    if not pairs.limit(1).count():
        return aligned, roots
    more = _aligned(pairs, texts, least)
    return aligned.unionByName(more), merged(roots, _links(more))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root; a stored table) after more links (a, b): only the classes that a link joins are touched."""
    at = maybe_broadcast(roots)
    of = lambda c, name: at.select(F.col("node").alias(c), F.col("root").alias(name))
    both = links.select("a", "b").join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    both = stored(both.where("a <> b").distinct(), "omh-joins")
    if not both.limit(1).count():
        return roots
    moved = maybe_broadcast(stored(components(both), "omh-moved"))
    known = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(known.unionByName(moved.join(at.select("node"), "node", "left_anti").select("node", "root")), "omh-roots")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (doc, ...) with the root of doc's class: doc itself if it has no link."""
    return rows.join(maybe_broadcast(roots).withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))


def _apart(pairs: DataFrame, roots: DataFrame, a: str, b: str) -> DataFrame:
    """pairs whose ends are in different classes. roots: node, root of every node with a link."""
    of = lambda c, name: roots.select(F.col("node").alias(c), F.col("root").alias(name))
    both = pairs.join(of(a, "_ra"), a, "left").join(of(b, "_rb"), b, "left")
    return both.where(F.coalesce("_ra", a) != F.coalesce("_rb", b)).drop("_ra", "_rb")


def _links(aligned: DataFrame) -> DataFrame:
    return aligned.where("sim is not null").select(F.col("leader").alias("a"), F.col("doc").alias("b"), "sim")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id: one row per row of docs; class_id is the least id of the document's class."""
    sk = sketches(docs, id_col, text_col)
    # texts that stand once are their own class; a stored side lets skewed copies be split
    first = sk.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("copy", "rep")
    member = sk.select("doc_id", "copy").join(maybe_broadcast(stored(first, "omh-copies")), "copy", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    member = stored(member, "omh-members")
    # an id that stands on rows of different texts ties those texts together
    same = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    roots = merged(linked(sk, docs, id_col, text_col, least), same)
    out = member.join(maybe_broadcast(roots), F.col("rep") == F.col("node"), "left")
    out = out.select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    lost = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(lost)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class: its least id. Rows with null id stay; rows that repeat an id count as one."""
    name, row = fresh(docs, "_nd_id", "_nd_row")
    kept = stored(classes(docs, id_col, text_col).where("doc_id = class_id").select(F.col("doc_id").alias(name)).distinct(), "omh-kept")
    out = docs.join(maybe_broadcast(kept), F.col(id_col) == F.col(name), "left_semi")
    again = stored(out.groupBy(F.col(id_col).alias(name)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name), "omh-repeated")
    if again.limit(1).count():  # of rows with one id the least stays
        same = maybe_broadcast(again)
        held = F.struct(*docs.columns)
        least_row = out.join(same, F.col(id_col) == F.col(name), "left_semi").groupBy(F.col(id_col).alias(name)).agg(F.min_by(held, F.to_json(held)).alias(row))
        out = out.join(same, F.col(id_col) == F.col(name), "left_anti").unionByName(least_row.select(f"{row}.*"))
    return out.unionByName(docs.where(F.col(id_col).isNull()))
