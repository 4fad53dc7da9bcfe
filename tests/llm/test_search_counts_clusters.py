"""Lexical search, token counts and centroid clustering against brute force, with nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from rasterloom.llm import lexical, lloyd, token_count

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- 11 lexical search
def brute_search(docs, items, k):
    rows = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    total, length = sum(1 for _, c in rows if c), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOW)))
    out = []
    for item, ts in asked.items():
        scores = []
        for i, c in rows:
            if not c or i is None:
                continue
            m = 10 + (90 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def searched(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item long, terms string")
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc int")
    return sorted(tuple(r) for r in lexical.search(d, q, k).select("item_id", "rank", "doc_id", "score").collect())


def test_search_equals_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Éa", "É", "ÄB", "x_y", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties
    docs += [(3, docs[3][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, " .,;\x00\t"), (2003, "w1\x00w2|w3 " * 5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(25)] + [(3, "w2 W7"), (None, "w1"), (50, None), (51, "nowhere"), (52, docs[7][1])]
    assert searched(spark, docs, items) == brute_search(docs, items, 10)
    assert searched(spark, docs, items, 1) == brute_search(docs, items, 1)


def test_search_in_lots_and_empty_tables(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 3} c") for i in range(50)]
    items = [(i, f"a{i} b{i % 3}") for i in range(9)]
    monkeypatch.setattr(lexical, "LOT", 4)
    assert searched(spark, docs, items) == brute_search(docs, items, 10)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []
    assert searched(spark, [(1, ""), (2, None)], items) == []


def block(rng, n_docs, n_terms, each):
    held = [(d, t) for d in range(n_docs) for t in sorted(rng.sample(range(n_terms), each))]
    doc, term = (np.array(x) for x in zip(*held))
    return lexical.Block(np.arange(n_docs), doc, term, np.array([rng.choice([1, 2, 3, 50, 900]) * (1 + t % 5) for _, t in held]))


def test_blocks_stop_early_and_stay_exact():
    rng, stopped = random.Random(5), 0
    for _ in range(30):
        b = block(rng, 900, 40, 12)
        asked, mask = np.array(sorted(rng.sample(range(40), 6))), np.zeros(40, bool)
        score = np.zeros(900, np.int64)
        for d, t, i in zip(np.repeat(np.arange(900), np.diff(b.own_at)), b.own_term, b.own_impact):
            score[d] += i if t in asked else 0
        for kth in (0, int(np.sort(score)[-5]), int(score.max()) + 1):
            row, got = b.best(asked, mask, 10, kth)
            assert (score[row] == got).all() and not mask.any()
            stopped += len(row) < (score > 0).sum()
            want = [d for d in np.lexsort((np.arange(900), -score))[:10] if score[d] >= max(kth, 1)]
            assert set(want) <= set(row.tolist())
    assert stopped > 60


def test_batches_fall_into_small_blocks(monkeypatch):
    """A task's k best are the same in one block and in many, with list columns that don't begin at 0."""
    rng = random.Random(9)
    lists = [sorted(rng.sample(range(30), rng.randrange(0, 9))) for _ in range(300)]
    tfs = [[rng.randrange(1, 5) for _ in x] for x in lists]
    n = [sum(x) + rng.randrange(1, 9) for x in tfs]
    columns = [pa.array(range(300), pa.int64()), pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
    batch = pa.record_batch(columns, names=["doc", "n", "terms", "tfs"]).slice(20)
    items, asked = np.arange(5), np.array([t for _ in range(5) for t in sorted(rng.sample(range(30), 4))])

    class Held:
        value = items, np.arange(0, 21, 4), asked, np.array([rng.randrange(0, 9) * 100 for _ in range(30)]), 280, sum(n[20:])

    found = []
    for postings in (1, 20, 1_000_000):
        monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
        found.append([out.to_pylist() for out in lexical._rank(Held, 7)(iter([batch]))])
    assert found[0] == found[1] == found[2] and found[0]


# ---------------------------------------------------------------- 12 token counts
ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b▁ ▁", "\n", "\n\n a\n", " \n ", "a\tb\nc d", "x²y ², ½ ①", "é ﬁ Ａ", "</s><s> <unk> <0x0A>", "a\x00b",
    "日本語 テキスト。", "1234 5,6.7", "don't can't_x __", "\r\n a　b", "🙂🙂 🙂", "#include <a.h>\n\tint main(){return 0;}\n", "x" * 5000, " " * 40 + "a", "aaa " * 6000,
]


@pytest.mark.parametrize("head", [24 << 20, 2000, 0])
def test_token_counts_equal_the_library(spark, monkeypatch, head):
    """With all, some and none of the pre-tokens broadcast."""
    monkeypatch.setattr(token_count, "HEAD_BYTES", head)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(7)
    chars = "aaaeeeinrst  \n\t.,;'\"-_()0123▁ßéñÄ²日🙂" + "thenand"
    texts = ODD + ["".join(rng.choices(chars, k=rng.randrange(1, 200))) for _ in range(150)] + [t["text"] for t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "twice over"), (None, "twice over"), (4, "a b")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id int, text string, piece string, n_head int")
    got = sorted(token_count.count_tokens(df).collect(), key=str)
    want = []
    for i, t in rows:
        ids = model.encode(t or "")
        want.append((i, len((t or "").encode()), len(ids), len(ids) > 4096))
    assert [tuple(r) for r in got] == sorted(want, key=lambda w: str(dict(zip(("doc_id", "n_bytes", "n_tokens", "over_limit"), w))) and _as_row(w))
    assert any(w[3] for w in want)


def _as_row(w):
    return f"Row(doc_id={w[0]}, n_bytes={w[1]}, n_tokens={w[2]}, over_limit={w[3]})"


def test_token_counts_of_an_empty_table(spark):
    out = token_count.count_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


# ---------------------------------------------------------------- 13 clustering
def brute_lloyd(rows, k, rounds, size):
    """rows: (id, integer vector)."""
    kept = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in kept[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for c, vs in groups.items():
            cents[c] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *near(v)) for i, v in rows]
    inertia = {c: sum(d for _, d, x in found if x == c) for c in {x for _, _, x in found}}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in found), key=str)


@pytest.mark.parametrize("k,size", [(8, 64), (3, 2), (40, 2)])
def test_clusters_equal_brute_force(spark, k, size):
    rng = random.Random(k)
    mid = [[rng.uniform(-3, 3) for _ in range(size)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(mid)]) for i in range(300)]
    rows += [(i, [float(rng.randrange(3)) for _ in range(size)]) for i in range(300, 360)]  # ties and repeated vectors
    rows += [(7, rows[7][1]), (None, rows[9][1])]
    bad = [(900, None), (901, []), (902, [1.0] * (size + 1)), (903, [None] + [1.0] * (size - 1)), (904, [float("nan")] + [1.0] * (size - 1)), (905, [float("inf")] * size)]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows + bad], "vec_id long, embedding array<double>, cluster string, node int")
    got = sorted((tuple(r) for r in lloyd.cluster(df, k, 10, size).collect()), key=str)
    assert got == brute_lloyd([(i, [math.floor(1024 * x) for x in v]) for i, v in rows], k, 10, size)


def test_clusters_few_vectors_large_components_and_empty_tables(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(1, [1e30, -1e30]), (2, [0.5, 0.25]), (3, [0.5, 0.25])]
    got = {r["vec_id"]: r for r in lloyd.cluster(spark.createDataFrame(rows, kind), 8, 10, 2).collect()}
    assert set(got) == {1, 2, 3} and got[1]["distance"] == 0 and got[2]["cluster"] == got[3]["cluster"] and got[2]["inertia"] == 0
    assert lloyd.cluster(spark.createDataFrame([], kind), 8, 10, 2).count() == 0
    assert lloyd.cluster(spark.createDataFrame([(1, [1.0])], kind), 8, 10, 2).count() == 0


def test_trees_cover_and_prune():
    rng = np.random.default_rng(1)
    mid = rng.integers(-20_000, 20_000, (12, 16))
    x = np.concatenate([mid[rng.integers(0, 12, 1500)] + rng.integers(-300, 300, (1500, 16)), np.tile(mid[:1], (40, 1))])
    t = lloyd.cover_tree(x, lloyd.LEAF)
    assert sorted(t.order) == list(range(len(x)))
    for i in range(len(t.node)):
        far = np.sqrt(((t.x[t.lo[i] : t.hi[i]] - t.x[t.node[i]]).astype(float) ** 2).sum(1))
        assert far.max() <= t.radius[i] and t.lo[i] <= t.node[i] < t.hi[i]
        kids = range(t.child[i], t.child[i] + t.n_child[i])
        if kids:
            assert [t.lo[j] for j in kids] == [t.lo[i], *[t.hi[j] for j in kids][:-1]] and t.node[kids[0]] == t.node[i]
            assert all(np.linalg.norm(t.x[t.node[a]] - t.x[t.node[b]]) > t.radius[i] / lloyd.BASE / (1 + 1e-9) for a in kids for b in kids if a < b)
    c = lloyd.cover_tree(mid[:8], 1)
    best, whole, compared = lloyd.meet(t, c, c.order)
    d = ((t.x[:, None] - mid[None, :8]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and compared < 0.05 * d.size and sum((hi - lo).sum() for lo, hi, _ in whole) > 0.9 * len(x)
