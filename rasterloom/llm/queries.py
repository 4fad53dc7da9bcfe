"""The operators as queries over the driver's tables, with production parameters and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html_text, lexical, lloyd, mixing, near_dup, pii, quality, sharding, token_count, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1 mixing
MIX_SEED, MIX_SHARE, MIX_EPOCHS = 17, 1.2, 2
#: Target weights of the tree; nodes that are not named weigh 1. Some ask for more than there is, so that leaves and whole languages run out.
MIX_WEIGHTS: dict[tuple[str, ...], int] = {
    ("web",): 3, ("curated",): 2,
    ("web", "en"): 2, ("web", "de"): 3, ("web", "fr"): 3, ("web", "es"): 12,
    ("curated", "en"): 4, ("curated", "de"): 2, ("curated", "fr"): 2, ("curated", "es"): 2,
    ("curated", "en", "src1"): 40,
}


def mix_tree() -> list:
    """Domain (sources with an even number are web), language, source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1).cast("long")
    return [F.when(F.coalesce(number, F.lit(0)) % 2 == 0, "web").otherwise("curated"), F.col("lang"), F.col("source")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stored

    slim = stored(mixing.slim_rows(table(spark, sf_dir, "documents"), mix_tree()), "mix-rows")
    plan = mixing.leaf_plan(slim, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    taken = mixing.take(slim, plan, MIX_SEED).where("_mix_n > 0")
    domain, lang, source = mixing.LEVELS
    return taken.select(
        F.col("_mix_id").alias("doc_id"), F.col(domain).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.col("_mix_tok").alias("n_tokens"), F.col("_mix_n").alias("copies"), F.col("_mix_b").alias("leaf_budget"),
    )


def _mix_weight_sql(depth: int, names: list[str]) -> str:
    out = []
    for path, w in MIX_WEIGHTS.items():
        if len(path) == depth:
            out.append("when " + " and ".join(f"{n} = '{v}'" for n, v in zip(names, path)) + f" then {w}")
    return f"case {' '.join(out)} else 1 end" if out else "1"


def _mix_level_sql(depth: int) -> str:
    """CTEs n<depth> (nodes), f<depth> (fill order) and g<depth> (budget of each node)."""
    names = ["domain", "lang", "source"][:depth]
    cols, parent = ", ".join(names), ", ".join(names[:-1])
    part = f"partition by {parent}" if parent else ""
    up = f"join g{depth - 1} using ({parent})" if parent else "cross join total"
    return f"""
n{depth} as (select {cols}, sum(cap)::hugeint cap, ({_mix_weight_sql(depth, names)})::hugeint w from leaves group by {cols}),
o{depth} as (select n{depth}.*, got total, row_number() over ({part} order by cap::double / w::double, {names[-1]}) i from n{depth} {up} where w > 0),
p{depth} as (select *, greatest(total - coalesce(sum(cap) over ({part} order by i rows between unbounded preceding and 1 preceding), 0), 0)::hugeint rest,
  sum(w) over ({part} order by i rows between current row and unbounded following)::hugeint ws from o{depth}),
q{depth} as (select *, min(case when cap * ws > w * rest then i end) over ({part}) f from p{depth}),
r{depth} as (select *, max(case when i = f then rest end) over ({part}) l, max(case when i = f then ws end) over ({part}) lw from q{depth}),
s{depth} as (select *, case when f is null or i < f then cap else (w * l) // lw end base from r{depth}),
t{depth} as (select *, least(sum(cap) over ({part}), total) - sum(base) over ({part}) lost from s{depth}),
g{depth} as (select {cols}, least(base + case when f is not null and i >= f and i - f < lost then 1 else 0 end, cap)::hugeint got from t{depth})"""


_TOKENS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> ''))::bigint"
OP1_SQL = f"""
with d as (select doc_id, case when coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as bigint), 0) % 2 = 0 then 'web' else 'curated' end as domain,
  coalesce(lang, '') lang, coalesce(source, '') source, {_TOKENS} tok from documents),
leaves as (select domain, lang, source, sum(tok)::bigint t, sum(tok)::bigint * {MIX_EPOCHS} cap from d group by all having sum(tok) > 0),
total as (select (coalesce(sum(t), 0) * {round(MIX_SHARE * 1000)}) // 1000 got from leaves),
{_mix_level_sql(1)},{_mix_level_sql(2)},{_mix_level_sql(3)},
plan as (select domain, lang, source, t, got::bigint b, (got // t)::bigint whole, (got % t)::bigint rest from leaves join g3 using (domain, lang, source)),
k as (select d.*, b, whole, rest, md5('{MIX_SEED}|' || (whole + 1)::varchar || '|' || coalesce(doc_id::varchar, '')) as mkey from d join plan using (domain, lang, source)),
c as (select *, sum(tok) over (partition by domain, lang, source order by mkey, doc_id) upto from k)
select doc_id, domain, lang, source, tok n_tokens, whole + (upto <= rest)::bigint copies, b leaf_budget from c where whole + (upto <= rest)::bigint > 0"""


# --- 2 decontamination, 3 quality
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected documents, with expected grade and tail probability."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.select_good(docs, model).where("keep").select("doc_id", "expected_grade", "p_good")


# --- 4 HTML
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


# --- 5 sharding
#: Not a power of two of the corpora at hand, so that only some buckets are split once more.
SHARD_BYTES = 900_000


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return out.select("doc_id", "shard_depth", "shard", "shard_bytes")


OP5_SQL = f"""
with d as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h, coalesce(octet_length(encode(text)), 0)::bigint n from documents),
s as (select g.d::int depth, h >> (60 - g.d)::int p, sum(n) b from d, range(0, 61) g(d) group by all),
a as (select d.doc_id, d.h, d.n, min(s.depth) depth from d join s on s.p = d.h >> (60 - s.depth) where s.b <= {SHARD_BYTES} group by d.doc_id, d.h, d.n)
select doc_id, depth shard_depth, left(right(repeat('0', 60) || format('{{:b}}', h), 60), depth) shard, n shard_bytes from a"""


# --- 6 WARC
def captures(pages: DataFrame) -> DataFrame:
    """Captures over time of the section front pages that `pages` belongs to: two of three are revisits, tags change every 64 pages."""
    p = F.col("page_id")
    tag = F.concat(F.lit('"v'), F.floor(p / 64).cast("string"), F.lit('"'))
    return pages.select(
        p.alias("capture_id"),
        F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+/[a-z]+", 0), F.regexp_extract("url", "[?#].*$", 0)).alias("url"),
        p.alias("at"), F.when(p % 3 == 0, "response").otherwise("revisit").alias("kind"),
        F.when(p % 5 == 0, F.lit(None)).otherwise(F.when(p % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)).alias("etag"),
        F.when(p % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("day "), F.floor(p / 128).cast("string"))).alias("last_modified"),
        F.create_map(F.lit("date"), p.cast("string"), F.lit("content-length"), F.length("html").cast("string")).alias("headers"),
        F.when(p % 3 == 0, F.col("html")).alias("payload"),
    )


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve(captures(table(spark, sf_dir, "pages")))
    return out.select(
        "capture_id", "canonical_url", "kind", "status", "base_id",
        F.col("headers")["date"].alias("header_date"), F.col("headers")["content-length"].alias("header_length"), F.md5(F.col("payload").cast("binary")).alias("payload_md5"),
    )


OP6_SQL = """
with p as (select page_id, html, regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+') || regexp_extract(url, '[?#].*$') u from pages),
h as (select *, lower(regexp_extract(regexp_replace(u, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) head, regexp_replace(u, '#.*$', '') v from p),
c as (select page_id, html, regexp_replace(regexp_replace(regexp_replace(head, '^http://', 'https://'), '^https://www[.]', 'https://'), ':(80|443)$', '')
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(v, length(head) + 1), '([?&])(utm_[a-z]+|gclid|fbclid|ref)=[^&]*', '\\1', 'g'), '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/+$', '') curl,
  page_id % 3 = 0 as whole, case when page_id % 5 <> 0 then '"v' || (page_id // 64) || '"' end tag, case when page_id % 7 <> 0 then 'day ' || (page_id // 128) end lm from h),
w as (select *, last_value(case when whole then page_id end ignore nulls) over (partition by curl order by page_id rows between unbounded preceding and 1 preceding) b from c),
j as (select w.*, b.tag btag, b.lm blm, b.html bhtml from w left join c b on w.b = b.page_id),
s as (select *, case when whole then 'full' when b is null then 'missing'
  when coalesce(case when tag is not null and btag is not null then tag = btag end, case when lm is not null and blm is not null then lm = blm end, true) then 'resolved' else 'mismatch' end status from j)
select page_id capture_id, curl canonical_url, case when whole then 'response' else 'revisit' end kind, status, case when status = 'resolved' then b end base_id,
  page_id::varchar header_date, case when status = 'resolved' then length(bhtml) else length(html) end::varchar header_length,
  case when status = 'resolved' then md5(bhtml) when whole then md5(html) end payload_md5 from s"""


# --- 7 near duplicates
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


# --- 8 top-k
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP8_SQL = """
with v as (select vec_id, pos, floor(1024 * x::double)::bigint x from (select vec_id, unnest(embedding) x, generate_subscripts(embedding, 1) pos from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)),
s as (select q.vec_id query_id, v.vec_id, sum(q.x * v.x)::bigint score from v q join v using (pos) where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id group by all),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 10"""


# --- 9 personal data
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


# --- 10 chat
def with_control_conversation(turns: DataFrame) -> DataFrame:
    """turns plus conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    more = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)


#: Small windows, so that most conversations are split and repeat history.
CHAT_BUDGET, CHAT_HISTORY_TURNS, CHAT_HISTORY_TOKENS = 128, 2, 48


def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_control_conversation(table(spark, sf_dir, "conversations"))
    return chat.format_windows(turns, CHAT_BUDGET, CHAT_HISTORY_TURNS, CHAT_HISTORY_TOKENS)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.read_back(chat_windows(spark, sf_dir)))


# --- 11 lexical search
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"
OP11_SQL = f"""
with r as (select row_number() over () rid, doc_id, regexp_extract_all({_FOLDED}, {_TERM}) ts from documents),
t as (select rid, unnest(ts) term from r),
tf as (select rid, term, count(*) tf from t group by all),
n as (select rid, count(*) n from t group by rid),
s as (select count(*) nn, sum(n)::bigint ll from n),
w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint w from tf, s group by term, nn),
q as (select distinct item_id, unnest(regexp_extract_all({_FOLDED}, {_TERM})) term from benchmark),
c as (select item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint score
  from q join tf using (term) join w using (term) join n using (rid), s where item_id is not null group by item_id, rid),
o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int "rank", doc_id, score from c join r using (rid) where score > 0 and doc_id is not null)
select item_id, "rank", doc_id, score from o where "rank" <= 10"""


# --- 12 token counts
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


# --- 13 clustering
CLUSTERS, ROUNDS, COMPONENTS = 8, 10, 64


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, COMPONENTS)


def _round_sql(i: int) -> str:
    """a<i>: assignments to the centroids c<i>; c<i+1>: the centroids after them."""
    return f"""
d{i} as (select r, k, sum((x.x - c.x) * (x.x - c.x))::bigint d from x join c{i} c using (pos) group by r, k),
a{i} as (select r, k, d from (select *, row_number() over (partition by r order by d, k) o from d{i}) where o = 1),
m{i} as (select k, pos, sum(x)::bigint s, count(*) n from a{i} join x using (r) group by k, pos),
c{i + 1} as materialized (select c.k, c.pos, coalesce((s - ((s % n) + n) % n) // n, c.x)::bigint x from c{i} c left join m{i} using (k, pos))"""


OP13_SQL = f"""
with v as (select row_number() over () r, vec_id, embedding from embeddings
  where embedding is not null and len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
x as materialized (select r, pos, floor(1024 * e::double)::bigint x from (select r, unnest(embedding) e, generate_subscripts(embedding, 1) pos from v)),
s as (select r, row_number() over (order by sha256('3:' || coalesce(vec_id::varchar, '')), embedding) - 1 k from v),
c0 as materialized (select k, pos, x from x join s using (r) where k < {CLUSTERS}),{",".join(map(_round_sql, range(ROUNDS + 1)))},
h as (select k, sha256(string_agg(x::varchar, ',' order by pos)) sha from c{ROUNDS} group by k)
select vec_id, k::int as "cluster", d distance, sum(d) over (partition by k)::bigint cluster_inertia, sum(d) over ()::bigint inertia, sha centroid_sha256
from a{ROUNDS} join v using (r) join h using (k)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_decontamination, op3_quality, op4_html_text, op5_sharding, op6_warc_revisits, op7_near_duplicates, op8_topk, op9_pii, op10_chat, op11_lexical_search, op12_token_counts, op13_clusters)
}
ORACLE: dict[str, str] = {"op1_mixing": OP1_SQL, "op5_sharding": OP5_SQL, "op6_warc_revisits": OP6_SQL, "op8_topk": OP8_SQL, "op11_lexical_search": OP11_SQL, "op13_clusters": OP13_SQL}
