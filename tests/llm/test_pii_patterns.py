"""Scoring of personal-data patterns against a plain loop, secrets behind keys on the table, hashes of long words, nulls and repeats."""

import random
import re
import time

from pyspark.sql import functions as F

from rasterloom.llm import pii
from rasterloom.storage import stored


def brute_patterns(edges):
    """context to score of the accepted ones. edges: (context, surface, seed)."""
    links = {}
    for c, s, seed in edges:
        links[c, s] = links.get((c, s), False) or seed
    conf = {}
    for (_, s), seed in links.items():
        conf[s] = max(conf.get(s, 0.0), float(seed))
    for turn in range(pii.ROUNDS):
        scores, seeds = {}, {}
        for c in {c for c, _ in links}:
            own = [s for k, s in links if k == c]
            scores[c] = sum(conf[s] for s in own) / (len(own) + pii.SMOOTH)
            seeds[c] = sum(links[c, s] for s in own)
        for s in conf:
            conf[s] = max(max(float(links[k]) for k in links if k[1] == s), max(scores[c] for c, x in links if x == s))
    return {c: scores[c] for c in scores if scores[c] >= pii.ACCEPT and seeds[c] >= pii.SEEDS}


def test_scores_equal_a_plain_loop(spark):
    rng = random.Random(8)
    edges = [(f"c{c}", s, rng.random() < share) for c, share in enumerate((1.0, 0.9, 0.8, 0.5, 0.1, 0.0)) for s in rng.sample(range(60), 18)]
    edges += [(f"few{i}", 100 + i, True) for i in range(3)] + edges[:10]
    got = {r["context"]: r["score"] for r in pii.patterns(stored(spark.createDataFrame(edges, "context string, surface long, seed boolean"), "t")).collect()}
    want = brute_patterns(edges)
    assert got.keys() == want.keys() and want and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_secrets_behind_keys_are_found_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    secret = re.compile(r"token = \"([0-9a-f]{40})\"", re.I)
    texts = {r["doc_id"]: r["text"] for r in docs.where("lower(text) like '%token = %'").select("doc_id", "text").collect()}
    want = {(i, *m.span(1)) for i, t in texts.items() for m in secret.finditer(t)}
    rows = pii.find(docs).where("n_id > 0").select("doc_id", "spans").collect()
    found = {(r["doc_id"], *map(int, s.split(":")[1:])) for r in rows for s in r["spans"].split(",") if s.startswith("id:")}
    assert len(want) > 100 and len(want & found) > 0.9 * len(want)
    assert len(found - want) < 0.1 * len(found)


def test_keys_come_from_patterns_and_not_from_one_name(spark):
    """Any name before any separator, once five keys stand behind it; the same shape in free text, and few of a name, stay."""
    rng = random.Random(3)
    key = lambda: "".join(rng.choices("abcdef0123456789", k=32))
    rows = [(i, f"w{chr(97 + i)} auth_code: '{key()}' end") for i in range(9)] + [(20, "auth_code: 'abc12345' short"), (21, f"lone {key()} here"), (22, f"other=<{key()}>")]
    got = {r["doc_id"]: r["n_id"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 1 for i in range(9)) and got[20] == 1 and got[21] == got[22] == 0


def test_words_of_any_length_differ_by_all_their_characters():
    a, b = "q" * 30_000, "p" + "q" * 29_999
    one, two, same = (pii._Contexts(f"{x} 1234567").of(len(x) + 1, len(x) + 8)[0] for x in (a, b, a))
    assert one != two and one == same and len(one) < 40

    def seconds(n):
        text = "u1@example.org," * n
        began = time.process_time()
        held = pii._Contexts(text)
        for m in re.finditer(r"u1@example\.org", text):
            held.of(*m.span())
        return time.process_time() - began

    assert seconds(8000) < 8 * seconds(2000) + 0.5


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, "mail a@b.cc"), (None, "mail a@b.cc"), (1, None), (1, ""), (2, "word " * 200_000 + "x@y.zz 4111 1111 1111 1111"), (2, "z" * 300_000)]
    got = pii.find(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, found string")).collect()
    assert sorted((r["doc_id"] is None, r["n_email"], r["n_card"]) for r in got) == sorted([(True, 1, 0)] * 2 + [(False, 0, 0)] * 3 + [(False, 1, 1)])
    empty = pii.find(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and "spans" in empty.columns
    assert pii.find(spark.createDataFrame([(1, "a")], "doc_id long, text string").where(F.lit(False))).count() == 0
