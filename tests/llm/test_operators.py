"""The ten operators against brute-force versions, with nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import chat, components, decontam, html_text, mixing, near_dup, pii, quality, queries, sharding, topk, warc

WORDS = [f"{a}{b}" for a in "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu".split() for b in "n r s t m".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))


# ---------------------------------------------------------------- 1 mixing
def brute_fill(total, kids):
    """{name: budget} for kids name -> (cap, weight) by repeatedly filling the children below the level."""
    got, left, open_ = {}, total, {k: v for k, v in kids.items() if v[1] > 0}
    while open_:
        ws = sum(w for _, w in open_.values())
        k = min(open_, key=lambda k: (open_[k][0] / open_[k][1], k))
        cap, w = open_[k]
        if cap * ws <= w * left:
            got[k], left = cap, left - cap
            del open_[k]
            continue
        order = sorted(open_, key=lambda k: (open_[k][0] / open_[k][1], k))
        share = {k: open_[k][1] * left // ws for k in order}
        for k in order[: left - sum(share.values())]:
            share[k] += 1
        got |= share
        break
    return got


def test_waterfill_equals_brute_force(spark):
    rng = random.Random(3)
    for total in (0, 7, 100, 1000, 10_000):
        kids = {f"k{i}": (rng.choice([0, 1, 5, 50, 400, 3000]), rng.choice([0, 1, 1, 2, 7])) for i in range(9)}
        df = spark.createDataFrame([(k, c, w, total) for k, (c, w) in kids.items()], "name string, _mix_cap long, _mix_w long, _mix_total long")
        got = {r["name"]: r["_mix_got"] for r in mixing.waterfill(df, [], "name").collect()}
        assert got == brute_fill(total, kids)


def mix(spark, rows, share=0.5, weights=None, epochs=4):
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, c string")
    slim = mixing.slim_rows(df, [F.col("a"), F.col("b"), F.col("c")])
    plan = mixing.leaf_plan(slim, weights or {}, share, epochs, 5)
    return mixing.take(slim, plan, 5)


def test_mixing_epochs_prefixes_and_redistribution(spark):
    rows = [(i, "w " * 10, "x", "en", "s") for i in range(10)] + [(100 + i, "w " * 10, "y", "en", None) for i in range(90)] + [(None, None, None, None, None), (5000, "", "x", "en", "s")]
    got = {r["_mix_id"]: r["_mix_n"] for r in mix(spark, rows).collect()}
    # 500 tokens; x may give 100 x 4 epochs, its half is 250: 2 whole epochs and a prefix of 50
    assert sum(10 * n for k, n in got.items() if k is not None and k < 100) == 250
    assert sum(10 * n for k, n in got.items() if k is not None and 100 <= k < 5000) == 250
    # a shortage of x (one epoch only) goes to y
    got = {r["_mix_id"]: r["_mix_n"] for r in mix(spark, rows, epochs=1).collect()}
    assert sum(10 * n for k, n in got.items() if k is not None and k < 100) == 100 and sum(10 * n for k, n in got.items() if k is not None and 100 <= k < 5000) == 400
    # the prefix follows the seeded order
    order = sorted(range(100, 190), key=lambda i: hashlib.md5(f"5|1|{i}".encode()).hexdigest())
    assert {k for k, n in got.items() if n and k is not None and k >= 100 and k < 5000} == set(order[:40])


def test_mixing_runs_out_on_the_table(spark):
    """Leaves and whole languages of the registered query reach what they can give, and the rest goes to their siblings."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.leaf_plan(mixing.slim_rows(docs, queries.mix_tree()), queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_EPOCHS, queries.MIX_SEED).collect()
    full = [r["_mix_b"] == r["_mix_t"] * queries.MIX_EPOCHS for r in plan]
    langs = {}
    for r, f in zip(plan, full):
        langs.setdefault((r["_mix_0"], r["_mix_1"]), []).append(f)
    assert any(full) and not all(full) and any(map(all, langs.values())) and not all(map(all, langs.values()))


def test_mixing_empty(spark):
    assert mix(spark, []).count() == 0
    assert mix(spark, [(1, None, "x", "y", "z"), (1, None, "x", "y", "z")]).count() == 0


# ---------------------------------------------------------------- 2 decontamination
def find_leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, h int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, h int")
    return {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontam.leaks(d, b).collect()}


QUESTION = "in a garden beside the river a farmer plants 12 rows of apple trees and each row holds 7 trees how many trees does the farmer plant in 12 rows"


def test_leaks_are_found_with_other_values(spark):
    rng = random.Random(1)
    pad = lambda t: f"{prose(rng, 40)} {t} {prose(rng, 40)}"
    again = QUESTION.replace("12", "35").replace("7", "9")
    broken = QUESTION.replace("12", "35", 1)
    docs = [(1, pad(QUESTION)), (2, pad(again)), (3, pad(broken)), (4, prose(rng, 300)), (5, None), (6, ""), (None, pad(QUESTION)), (1, pad(QUESTION)), (7, pad(" ".join(QUESTION.split()[:10])))]
    got = find_leaks(spark, docs, [(10, QUESTION), (11, None), (12, "too short"), (13, prose(rng, 30))])
    assert got == {(1, 10): True, (2, 10): False, (None, 10): True}
    assert find_leaks(spark, docs, []) == {} and find_leaks(spark, [], [(10, QUESTION)]) == {}


def test_short_items_and_names(spark):
    short = "what colour is the sky today"
    rng = random.Random(2)
    named = "then Alice gave Bob the red book that Alice bought in town and Bob thanked Alice for the lovely present"
    swap = named.replace("Alice", "Carol").replace("Bob", "Dave")
    got = find_leaks(spark, [(1, f"{prose(rng, 9)} {short} {prose(rng, 9)}"), (2, f"{prose(rng, 20)} {swap} {prose(rng, 20)}")], [(1, short), (2, named)])
    assert got == {(1, 1): True, (2, 2): False}


def test_items_poor_in_plain_tokens_are_found_verbatim(spark):
    rng = random.Random(29)
    items = [(1, "Compute 12 + 30 - 7 + 44 and 5 times 9 and then 3 + 8 minus 2"), (2, "What is 7 times 8"), (3, "Zorbu kwax flim")]
    docs = [(i, f"{prose(rng, 20)} {t} {prose(rng, 20)}") for i, t in items]
    docs += [(12, f"{prose(rng, 20)} What is 7 times 9 {prose(rng, 20)}"), (13, f"{prose(rng, 20)} zorbu kwax {prose(rng, 20)}")]
    assert find_leaks(spark, docs, items) == {(i, i): True for i, _ in items}


def test_names_that_begin_sentences(spark):
    rng = random.Random(31)
    item = "Anna has 3 apples in her bag. Anna buys 4 more of them today. Anna eats 3 of the apples at noon. Anna wants to know what is left."
    swap = item.replace("Anna", "Carol").replace("3", "5").replace("4", "9")
    mixed = swap.replace("Carol wants", "Bob wants")
    docs = [(i, f"{prose(rng, 30)}. {t} {prose(rng, 30)}") for i, t in enumerate((item, swap, mixed, f"we heard that {swap}", "Apples are sold here. Anna has 3 apples."))]
    assert find_leaks(spark, docs, [(1, item)]) == {(0, 1): True, (1, 1): False, (3, 1): False}


def test_long_passages_with_an_edited_number(spark):
    rng = random.Random(37)
    words = prose(rng, 70).split()
    words[5] = words[40] = "17"
    item = " ".join(words)
    words[40] = "18"
    got = find_leaks(spark, [(1, f"{prose(rng, 20)} {' '.join(words)} {prose(rng, 20)}"), (2, prose(rng, 90))], [(1, item)])
    assert got == {(1, 1): False}


def test_leaks_equal_brute_force(spark):
    """Against windows and alignments in plain Python, on the driver's tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    seen = decontam._Tokens()
    tpl = lambda rows, of: {i: tuple(map(list, decontam.templates(t or "", seen)[of])) for i, t in rows}
    want = set()
    for of in (0, 1):
        D, B = tpl(map(tuple, docs.collect()), of), tpl(map(tuple, bench.collect()), of)
        for item, (bt, bs) in B.items():
            if len(bt) < decontam.LEAST:
                continue
            size = min(decontam.WINDOW, len(bt))
            own = {i: tuple(bt[i : i + size]) for i in range(len(bt) - size + 1) if sum(v == 0 for v in bs[i : i + size]) >= decontam.LEAST}
            for doc, (dt, ds) in D.items():
                at = {}
                for j in range(len(dt) - size + 1):
                    at.setdefault(tuple(dt[j : j + size]), []).append(j)
                by = {}
                for i, win in own.items():
                    for j in at.get(win, ()):
                        by.setdefault(j - i, set()).add(i)
                for diag, hit in by.items():
                    pairs = {(bs[k], ds[k + diag]) for i in hit for k in range(i, i + size) if bs[k]}
                    agree = len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
                    exact = sum(bs[i : i + size] == ds[i + diag : i + diag + size] for i in hit)
                    if agree and len(hit) >= min(decontam.NEED, len(own)) or exact >= decontam.VERBATIM:
                        want.add((doc, item))
    assert got == want


# ---------------------------------------------------------------- 3 quality
def test_quality_ranks_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = quality.train(docs, train)
    assert (np.diff(model.thresholds) >= 0).all()
    out = quality.select_good(docs.withColumn("keep", F.lit("clash")), model).join(test.select("doc_id", (quality.grade_of(F.col("quality"), F.col("toxic")) == 2).alias("good")), "doc_id").where("good is not null").toPandas()
    assert (out["keep"] == out["good"]).mean() > 0.85


def test_quality_features_by_the_short_way_equal_the_long_way():
    """Plain words skip the patterns, and scoring looks only at buckets that weigh something: neither changes what is found."""
    tokens = "a A be BE Be. BE, longer, LONGER? don't naïve É ß. İa İstanbul. ﬁne ÉTÉ, x1 1. ... . ?! word!! U.S. over-all \U0001d400bc end: end; (in) I I.".split()
    cache = quality._Buckets()
    assert all(set(cache[t]) == set(quality._Buckets.parts(t)) for t in tokens)
    text = " ".join(tokens * 2)
    only = frozenset(quality.features(text, cache)[::3])
    assert quality.features(text, quality._Buckets(only)) == sorted(only)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    out = quality.select_good(docs, model)
    assert out.count() == 4 and out.where("expected_grade is null").count() == 0
    assert quality.select_good(docs.limit(0), model).count() == 0
    ones = spark.createDataFrame([(1, 1, 0), (2, None, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.training_rows(docs, ones).count() == 1


# ---------------------------------------------------------------- 4 HTML
def page(i, body):
    return (i, f"https://site.test/{i}", f"<html><head><title>t</title><style>x{{}}</style></head><body><div>Join the club today</div><header>Top</header><nav><ul><li>Home</ul></nav>{body}<footer>End</footer></body></html>")


def test_templates_and_markup_go(spark):
    rng = random.Random(4)
    said = {i: prose(rng, 30) for i in range(12)}
    rows = [page(i, f"<div class=body><p>{said[i]} &amp; more&nbsp;&#233;</p><p>two\n  words{i}<br>here</p></div><script>var a = '<p>no</p>';</script><div class='comments'>me too</div>") for i in said]
    rows += [(100, None, None), (101, "https://other.test/", ""), (102, "https://other.test/", "<p>a<p>b</i><!-- never closed <p>c"), (100, None, "<article>x <b>y</b>z</article><aside>ad</aside>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(df).collect())
    for i, s in said.items():
        want = f"{s} & more é two words{i} here"
        assert got[i] == (i, want, len(want))
    assert got[12:] == [(100, "", 0), (100, "x yz", 4), (101, "", 0), (102, "a b", 3)]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_recurring_boxes_inside_articles_go_and_repeated_articles_stay(spark):
    rng = random.Random(31)
    said = {i: prose(rng, 30) for i in range(10)}
    rows = [page(i, f"<article><h1>h{i}</h1><div class=box><p>Get our letter each week</p></div><p>{s}</p></article>") for i, s in said.items()]
    rows += [(100 + i, f"https://again.test/{i}", "<article><h1>same</h1><p>one article on many pages</p></article>") for i in range(9)]
    rows += [(200 + i, f"https://again.test/x{i}", f"<article><p>{prose(rng, 9)}</p></article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in said} == {i: f"h{i} {s}" for i, s in said.items()}
    assert {got[100 + i] for i in range(9)} == {"same one article on many pages"} and all(got[200 + i] for i in range(9))


def only_text(html):
    p = html_text.Page(html, html_text._Names())
    return p.text([False] * len(p.parent))[0]


@pytest.mark.parametrize("html,want", [
    ('<p title="the hidden truth">keep me</p>', "keep me"), ('<a onclick="hidden=1">link</a>', "link"), ('<p data-id="ad-1">keep</p>', "keep"),
    ('<p data-style="display:none">keep</p>', "keep"), ('<div class="main-content no-sidebar"><p>b</p></div>', "b"), ('<div class="page has-comments">x</div>', "x"),
    ('<div class="related-work">w</div>', "w"), ('<div class="site-footer">no</div><p hidden>no</p><div class=ad>no</div><i aria-hidden=true>no</i>yes', "yes"),
    ('<article class="post tag-notice"><header class="entry-header"><h1>t</h1></header>c</article>out', "t c"), ("a < b &amp; c<b>d</b", "a < b & cd"), ("x<!-- y", "x"), ("x<p a='y", "x"),
])
def test_markup_is_read_by_whole_names(html, want):
    assert only_text(html) == want


@pytest.mark.parametrize("part", ["<a ", "<div>x", '<p a="', "<li><ul><b>", "<span hidden>x", "<p><table>", "<", "</", "<script>", "&lt;"])
def test_hostile_pages_take_linear_time(part):
    def seconds(n):
        began = time.process_time()
        html_text.Page(part * (n // len(part)), html_text._Names())
        return time.process_time() - began

    assert seconds(1 << 19) < 6 * seconds(1 << 17) + 0.5


def test_hosts_without_semantic_markup(spark):
    """Boxes known by nothing but their recurrence go, by either way of handing the template out; subtree counts equal a brute-force count."""
    rng = random.Random(37)
    boxes = [f"<div><ul><li>{prose(rng, 2)}</li><li>{prose(rng, 3)}</li></ul><span>{prose(rng, 4)}</span></div>" for _ in range(4)]
    rows, want = [], {}
    for i in range(40):
        said = prose(rng, 20)
        rows.append((i, f"http://Plain.test/{i}", f"<body>{boxes[i % 4]}<div><p>{said}</p><p>short</p></div>{boxes[(i + 1) % 4]}"))
        want[i] = said
    rows += [(100 + i, f"http://few.test/{i}", f"<div>{boxes[0]}</div><p>w{i}</p>") for i in range(3)]  # too few pages to tell
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1000, 0):
        got = {r["page_id"]: r for r in html_text.main_text(df, most_keys=most).collect()}
        assert {i: got[i]["text"] for i in want} == want and all(got[i]["n_template"] for i in want)
        assert all(got[100 + i]["n_template"] == 0 and len(got[100 + i]["text"]) > 4 for i in range(3))
    names, seen = html_text._Names(), {}
    for _, url, source in rows:
        host = re.match("http://([^/]*)", url)[1].lower()
        p = html_text.Page(source, names, html_text._host_seed(host))
        for key in set(html_text.subtree_keys(p).tolist()):
            seen.setdefault((host, key), set()).add(tuple(b[0] for b in p.kept()))
    pages = {h: len({tuple(b[0] for b in html_text.Page(s, names).kept()) for _, u, s in rows if h in u.lower()}) for h in ("plain.test", "few.test")}
    brute = {k for (h, k), on in seen.items() if k and len(on) >= html_text.MIN_PAGES and len(on) >= (html_text.CERTAIN if k & 1 else html_text.SHARE) * pages[h]}
    slim = df.select(html_text.host_of(F.col("url")).alias("host"), "html")
    assert {r["key"] for r in html_text.template_keys(slim).collect()} == brute and brute


def test_template_acts_on_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    assert html_text.main_text(pages).agg(F.sum("n_template")).first()[0] > 0


# ---------------------------------------------------------------- 5 sharding
def brute_shards(sizes, limit):
    bits = {k: format(int(hashlib.md5(k.encode()).hexdigest()[:15], 16), "060b") for k, _ in sizes}
    out = {}

    def split(rows, depth):
        if sum(n for _, n in rows) <= limit:
            out.update({k: bits[k][:depth] for k, _ in rows})
        elif depth < 60:
            for b in "01":
                split([r for r in rows if bits[r[0]][depth] == b], depth + 1)

    split(sizes, 0)
    return out


def test_sharding_equals_recursive_splits(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.choice([0, 1, 10, 100, 1000])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1))
    got = {str(r["doc_id"]): r["shard"] for r in sharding.assign(df, 3000).collect()}
    assert got == brute_shards([(str(i), len(t)) for i, t in rows], 3000)


def test_sharding_overflow_and_cases(spark):
    rows = [(7, "y" * 100)] * 50 + [(None, None), (None, "z"), (8, "w" * 5000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 1000)
    sizes = {r["shard"]: r["b"] for r in got.groupBy("shard").agg(F.sum("shard_bytes").alias("b")).collect()}
    assert got.count() == 53 and sorted(sizes.values())[-1] == 5000 and all(b <= 1000 for b in sizes.values() if b != 5000)
    assert sharding.assign(got.limit(0).select("doc_id", "text"), 10).count() == 0


# ---------------------------------------------------------------- 6 WARC
def test_revisits_equal_a_loop(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        full = rng.random() < 0.3
        tag, lm = rng.choice([None, '"a"', 'W/"a"', '"b"']), rng.choice([None, "mon", "tue"])
        url = rng.choice(["http://www.A.test/x/", "https://a.test/x?utm_source=1", "https://a.test/y?b=2&ref=q", None])
        rows.append((i, url, rng.choice([None, 1, 2, 3, 4, 5]), "response" if full else "revisit", tag, lm, rng.choice([None, {"date": str(i), "content-length": "9"}]), f"body{i}" if full else None))
    df = spark.createDataFrame(rows, "capture_id long, url string, at int, kind string, etag string, last_modified string, headers map<string,string>, payload string")
    got = {r["capture_id"]: r for r in warc.resolve(df.withColumn("status", F.lit("clash"))).collect()}
    assert len(got) == 300
    canon = {"http://www.A.test/x/": "https://a.test/x", "https://a.test/x?utm_source=1": "https://a.test/x", "https://a.test/y?b=2&ref=q": "https://a.test/y?b=2", None: ""}
    key = lambda r: (r[2] is not None, r[2] or 0, r[0])
    plain = lambda t: re.sub("^W/", "", t)
    for r in rows:
        g = got[r[0]]
        assert g["canonical_url"] == canon[r[1]]
        if r[3] == "response":
            assert (g["status"], g["payload"]) == ("full", r[7])
            continue
        before = [b for b in rows if b[3] == "response" and canon[b[1]] == canon[r[1]] and key(b) < key(r)]
        if not before:
            assert g["status"] == "missing"
            continue
        b = max(before, key=key)
        ok = plain(r[4]) == plain(b[4]) if r[4] and b[4] else r[5] == b[5] if r[5] and b[5] else True
        assert g["status"] == ("resolved" if ok else "mismatch")
        if ok:
            assert g["base_id"] == b[0] and g["payload"] == b[7]
            want = dict(b[6] or {}) | {k: v for k, v in (r[6] or {}).items() if k in warc.PERMITTED}
            assert g["headers"] == want
    assert warc.resolve(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 7 near duplicates
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[i : i + (kind != 1)] = [prose(rng, 1)] if kind < 2 else []
    return words


def test_banded_distance_equals_the_full_table():
    rng = random.Random(8)
    for n in (5, 40, 120):
        for edits in (0, 1, 5, 15, 40):
            a = prose(rng, n).split()
            b = edited(rng, a, min(edits, n - 2))
            d = distance(a, b)
            for most in (0, d - 1, d, d + 1, n):
                if most >= 0:
                    assert near_dup.edit_distance(a, b, most) == (d if d <= most else None)


def classes_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    return sorted(((r["doc_id"], r["class_id"]) for r in near_dup.classes(df).collect()), key=str)


def test_near_copies_meet_and_others_stay_alone(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for g in range(12):
        base = prose(rng, rng.choice([30, 60, 150])).split()
        for k in range(rng.choice([1, 2, 5])):
            i = g * 100 + k
            rows.append((i, " ".join(edited(rng, base, k and max(1, len(base) // 40)))))
            want[i] = g * 100
    passage = prose(rng, 60)
    for i in range(2000, 2020):  # a shared passage makes no copy
        rows.append((i, f"{prose(rng, 70)} {passage} {prose(rng, 70)}"))
        want[i] = i
    got = dict(classes_of(spark, rows))
    assert got == want


def test_hot_bucket_with_several_groups(spark):
    """Groups that share a long passage, so that all of them meet in the same buckets: each is found, none is joined to another."""
    rng = random.Random(13)
    passage, rows, want = prose(rng, 100), [], {}
    for g in range(8):
        own = prose(rng, 60).split()
        for k in range(6):
            rows.append((g * 10 + k, passage + " " + " ".join(edited(rng, own, 2 if k else 0))))
            want[g * 10 + k] = g * 10
    assert dict(classes_of(spark, rows)) == want


def test_near_duplicate_cases(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "x y z"), (6, "q"), (7, "?!")]
    # different texts with the same words are near copies; texts without a word are copies only if they are equal
    assert classes_of(spark, rows) == sorted([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5), (None, None), (6, 6), (7, 7)], key=str)
    assert classes_of(spark, []) == []
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "5", "6", "7", "None"])


def scattered(rng, words, n):
    """words with n of them replaced, at places all over the text."""
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = prose(rng, 1) + "z"
    return words


def test_short_texts_and_scattered_edits(spark):
    """Pairs of 5 to 15 words with a middle word changed, and of 200 words at 0.8 to 0.95, against all-pairs alignment."""
    rng = random.Random(17)
    rows, pairs = [], []
    for n in [5, 6, 7, 9, 11, 12, 13, 15] * 5:
        a = prose(rng, n).split()
        pairs.append((a, [*a[: n // 2], "changed", *a[n // 2 + 1 :]]))
    for n in (16, 30, 60, 100):
        pairs += [(a, scattered(rng, a, n // 5)) for a in (prose(rng, n).split() for _ in range(5))]
    exact = len(pairs)
    for sim in (0.8, 0.85, 0.9, 0.95):
        pairs += [(a, scattered(rng, a, round(200 * (1 - sim)))) for a in (prose(rng, 200).split() for _ in range(10))]
    for k, (a, b) in enumerate(pairs):
        assert distance(a, b) <= 0.2 * len(a)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = dict(classes_of(spark, rows))
    found = [got[2 * k] == got[2 * k + 1] == 2 * k for k in range(len(pairs))]
    assert all(found[:exact]) and sum(found[exact:]) >= 0.9 * (len(pairs) - exact)


def test_drifting_chains_in_one_bucket(spark):
    """Chains of copies, each edited from the one before, that all share a passage: classes equal the components of all pairs."""
    rng = random.Random(19)
    texts, passage = [], prose(rng, 60).split()
    for _ in range(8):
        own = prose(rng, 60).split()
        for _ in range(40):
            texts.append(passage + own)
            own = scattered(rng, own, 14)
    ids = rng.sample(range(1000), len(texts))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if near_dup.similarity(texts[i], texts[j]) is not None:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    assert dict(classes_of(spark, [(d, " ".join(t)) for d, t in zip(ids, texts)])) == {d: least[find(i)] for i, d in enumerate(ids)}


def test_a_taken_document_still_meets_the_others(spark):
    """Leader ~ D and D ~ E but leader not ~ E, with D and E behind 40 other documents of their only common rare word."""
    rng = random.Random(23)
    common, rows, want = prose(rng, 20).split(), [], {}
    for g in range(8):
        base = prose(rng, 80).split()
        e = [f"{w}x{g}" if i % 5 == 0 else w for i, w in enumerate(base)]
        own = {0: base + common, 60: base, 61: e} | {k: rng.sample(base, 80) for k in range(1, 41)}
        rows += [(g * 100 + k, " ".join(w)) for k, w in own.items()]
        want |= {g * 100 + k: g * 100 if k in (60, 61) else g * 100 + k for k in own}
    for i in range(2000, 2060):  # make the leader's further words frequent
        rows.append((i, " ".join(rng.sample(common, 20) + prose(rng, 40).split())))
        want[i] = i
    assert dict(classes_of(spark, rows)) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 8 top-k
def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(700)]
    vecs[3] = (3, vecs[2][1])
    vecs += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (None, [1.0] * 16), (904, []), (905, [0.5])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in topk.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ints = {i: np.pad(np.floor(np.array(v) * 1024).astype(np.int64), (0, 16 - len(v))) for i, v in vecs if i is not None and (i < 900 or i == 905)}
    for q in range(0, 700, 100):
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:10]
        assert [got[q][k] for k in range(1, 11)] == [(i, -s) for s, i in best]
    assert set(got) == set(range(0, 700, 100))
    assert topk.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.search(df.where("vec_id in (0, 1)"), F.col("vec_id") == 0).count() == 1


# ---------------------------------------------------------------- 9 personal data
def brute_spans(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m.group())]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(5)
    bits = ["a.b@c.de", "x@y", "@", "..@a.b.c", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+49 (30) 123-4567", "+1", "+123456789012345678", "é", "\U0001f600", "12", "-", " ", "@@", "a", ".", "0000.1.1.1", "+", "(", "5500005555555559"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    rows = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert [s for s in rows[i]["spans"].split(",") if s and not s.startswith("id:")] == want
    assert pii.find(df.limit(0)).count() == 0


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"please write to mail contact: person{i}@example.org or not") for i in range(40)]
    rows += [(100, "then mail contact: person-774411 should be asked"), (101, "some order number 774412 of other kind")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["n_id"] == 1 and got[100]["spans"] == "id:19:32" and got[101]["n_id"] == 0 and got[0]["n_email"] == 1


def test_grouped_and_digit_free_identifiers_are_found(spark):
    rng = random.Random(41)
    rows = [(i, f"{prose(rng, 5)} my mail is u{i}@example.org thanks {prose(rng, 5)}") for i in range(30)]
    rows += [(50 + i, f"{prose(rng, 5)} please call +49 30 {i + 100} 4567 today {prose(rng, 5)}") for i in range(30)]
    rows += [(100, "oh my mail is jane dot at example dot org thanks"), (101, "oh my mail is @jane_doe thanks"), (102, "please call 743 555 3824 today"), (103, "a @jane_doe b"), (104, "x" * 300 + " please call 743 555 3824 soon")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    part = lambda i, t: t[slice(*map(int, got[i]["spans"].split(":")[1:]))]
    texts = dict(rows)
    assert part(101, texts[101]) == "jane_doe" and part(102, texts[102]) == "743 555 3824" and part(104, texts[104]) == "743 555 3824"
    assert got[103]["n_id"] == 0 and got[0]["n_email"] == 1 and got[50]["n_phone"] == 1


# ---------------------------------------------------------------- 10 chat
def digests(turns):
    turns = [(r or "", t or "") for r, t in turns]
    said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget,turns,tokens", [(2048, 2, 256), (40, 2, 20), (12, 3, 4), (10, 0, 0), (5, 1, 100)])
def test_chat_round_trip(spark, budget, turns, tokens):
    rng = random.Random(9)
    odd = ["<|turn|>", "<|end|>", "~0", "~1~", "[INST]", "</s>", "\n", "a b", "é", "\U0001f600", "", "~", "<", "|>"]
    rows, want = [], {}
    for c in range(40):
        said = [(rng.choice(["user", "assistant"]) if t or c % 2 else "system", "".join(rng.choice(odd) + rng.choice(["", " x", " "]) for _ in range(rng.randrange(12))) if rng.random() < 0.95 else None) for t in range(rng.randrange(1, 25))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(said)]
        want[c] = digests(said)
    rng.shuffle(rows)
    df = queries.with_control_conversation(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)))
    windows = chat.format_windows(df, budget, turns, tokens)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.read_back(windows)).collect()}
    want[-7] = digests([("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])
    assert got == want
    # a later window repeats the system turn and at most `turns` more
    for r in windows.where("window > 0").collect():
        assert r["n_repeated"] <= turns + 1
    # new turns fit what system turn and history leave of the budget, but for a turn that is too long by itself
    size = lambda x: len(re.findall(r"[^ \t\n\r]+", x))
    for r in windows.collect():
        said = [chat_plain(p.split("\n", 1)[1][: -len(chat.END)]) for p in r["formatted"].split(chat.TURN)[1:]]
        new = [size(x) for x in said[r["n_repeated"]:]]
        assert r["formatted"].startswith(f"{chat.TURN}system\n") or r["conv_id"] % 2 or r["conv_id"] < 0
        held = sum(map(size, said[: r["n_repeated"]]))
        if not r["window"] and r["formatted"].startswith(f"{chat.TURN}system\n"):
            held, new = new[0], new[1:]
        assert sum(new) <= max(1, budget - held) or len(new) == 1 or r["window"] == 0 and sum(map(bool, new)) == 1


def chat_plain(text):
    return text.replace("~2", "[").replace("~1", "<").replace("~0", "~")


def test_chat_windows_act_on_the_table(spark):
    w = queries.chat_windows(spark, "/root/testdata/sf0.01")
    got = w.agg(F.count_if(F.col("window") > 0).alias("later"), F.count_if(F.col("n_repeated") > 0).alias("again"), F.count_distinct("conv_id").alias("n")).first()
    assert got["later"] > got["n"] / 2 and got["again"] > got["n"] / 2


def test_chat_of_fifty_thousand_turns(spark):
    n = 50_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.format_string("this is the turn number %d of a long talk", "id").alias("text"))
    began = time.time()
    got = chat.digests(chat.read_back(chat.format_windows(df))).first()
    assert time.time() - began < 90
    want = digests([("assistant" if i % 2 else "user", f"this is the turn number {i} of a long talk") for i in range(n)])
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == want


def test_chat_cases(spark):
    rows = [(None, None, None, None), (1, 0, "odd\nrole", "x"), (1, 0, "odd\nrole", "x"), (2, None, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.read_back(chat.format_windows(df))).collect()}
    assert got == {None: 1, 1: 2, 2: 1}
    assert chat.format_windows(df.limit(0)).count() == 0
