"""Personal data: fixed patterns, and identifiers that bootstrapped contexts reveal.

Base spans (leftmost, non-overlapping per kind): email, ip, card, phone by the patterns below and their checks.
Bootstrapping: seeds are the base spans, and tokens whose shape alone tells (KEY_CHARS characters or more of letters, digits and -_+/=, with KEY_MIX of
both letters and digits at least, as generated keys have). A span's lexical patterns are
  the two words before it, and the word before and the word after it (in lower case, with 0 for runs of digits; a word of over WORD_CHARS characters stands
  for a hash of all its characters),
  its key: the name before an assignment or colon right before it, with what stands between (`token = "`),
  the word before it with its own shape: runs of its characters by class and length.
Candidates have the same patterns: every other token with LEAST_DIGITS digits or more, taken together with the
groups of digits that follow it, @handles, and addresses spelled `x at y dot z`. Spark scores the graph of patterns and instances in turns: a
pattern's score is the mean confidence of its distinct instances, smoothed by SMOOTH unknown ones; an instance that is no seed
takes the best score of its patterns. After ROUNDS turns, candidates under patterns of score >= ACCEPT that at least SEEDS
different seeds support are found, as spans of kind `id`; seeds by shape need such a pattern as well. Base spans stay as they are, and the four counts are theirs.

Cases: null text is empty and has no spans; rows are kept one by one, with null or repeated ids too; at most the seeds and
candidates of a text travel, never the text; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

# The base patterns, by kind.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)(?:(?P<digits>[^\s0-9]*+[0-9]\S*+(?:\x20[(+]?[0-9][0-9().-]*+(?=\s|[,;:!?]|\Z))*+)|@[A-Za-z0-9_]{2,}+|[\w.-]++\x20[(\[]?at[)\]]?\x20[\w-]++\x20[(\[]?dot[)\]]?\x20\w++)")
_WORD = re.compile(r"\S+")
_ALNUM = re.compile(r"[^\W_]")
_RADIX, _PRIME = 1_000_003, (1 << 61) - 1
KINDS = ("email", "ip", "card", "phone")
LEAST_DIGITS, SMOOTH, ROUNDS, ACCEPT, SEEDS, WORD_CHARS = 4, 1.0, 3, 0.8, 5, 64
KEY_CHARS, KEY_MIX = 20, 5
_KEY = re.compile(r"[A-Za-z0-9_+/=-]+")
_NAME = re.compile(r"([\w.-]{1,64})([ \t]{0,2}[:=]{1,2}>?[ \t]{0,2}[\"'`(\[]?)\Z")
#: Characters before a span that its key is sought in.
_NAME_REACH = 72
_RUNS = re.compile(r"[^\W_]+|\s+|.", re.S)


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, sought from each @ so that long runs cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p) < 20 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


class _Contexts:
    """Patterns of spans of a text, each found in time that does not grow with the text."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends, self._sums = text, [], [], {}
        for m in _WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def _word(self, start: int, end: int) -> str:
        """The part of a word from start to end."""
        if end - start <= WORD_CHARS:
            return re.sub(r"[0-9]+", "0", self.text[start:end].lower())
        # sums over the whole word, made once, give the hash of any part of it
        i = bisect.bisect_right(self.starts, start) - 1
        if i not in self._sums:
            sums, h = [0], 0
            for c in self.text[self.starts[i] : self.ends[i]]:
                h = (h * _RADIX + (48 if c in "0123456789" else ord(c.lower()[0])) + 1) % _PRIME
                sums.append(h)
            self._sums[i] = sums
        sums, a, b = self._sums[i], start - self.starts[i], end - self.starts[i]
        return f"#{b - a}:{(sums[b] - sums[a] * pow(_RADIX, b - a, _PRIME)) % _PRIME:x}"

    def _shaped(self, start: int, end: int, before: str) -> list[str]:
        """The word before the span with the span's shape, and the key before it, if there is one."""
        runs = []
        for m in _RUNS.finditer(self.text, start, min(end, start + WORD_CHARS)):
            x = m.group()
            runs.append(f"{'9' if x.isdigit() else 'a' if x.isalpha() else 'm' if x[0].isalnum() else x[0]}{len(x)}")
        out = [f"{before} shaped {' '.join(runs)} of {end - start}"]
        name = _NAME.search(self.text[max(0, start - _NAME_REACH) : start])
        return [f"key {name[1].lower()}{name[2]}", *out] if name else out

    def of(self, start: int, end: int) -> list[str]:
        """Of the span: the two words before it, and the word before and the word after it; letters or digits right at the span count as a word, mere marks don't."""
        i = bisect.bisect_left(self.starts, start)  # words that begin before the span
        if i and self.ends[i - 1] > start and not self._says(self.starts[i - 1], start):
            i -= 1
        before = [self._word(self.starts[j], min(self.ends[j], start)) for j in range(max(0, i - 2), i)]
        k = bisect.bisect_right(self.ends, end)  # the first word that ends behind the span
        if k < len(self.starts) and self.starts[k] < end and not self._says(end, self.ends[k]):
            k += 1
        after = ""
        if k < len(self.starts):
            first = max(self.starts[k], end)
            after = self._word(first, self.ends[k])
        last = before[-1] if before else ""
        return [" ".join(before), f"{last}|{after}", *self._shaped(start, end, last)]

    def _says(self, start: int, end: int) -> bool:
        """Is there a letter or digit?"""
        return _ALNUM.search(self.text, start, end) is not None


def by_shape(x: str) -> bool:
    """Is it a generated key, by its shape?"""
    return len(x) >= KEY_CHARS and _KEY.fullmatch(x) is not None and sum(map(str.isalpha, x)) >= KEY_MIX and sum(map(str.isdigit, x)) >= KEY_MIX


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("contexts", pa.list_(pa.string())), ("surface", pa.int64()), ("seed", pa.bool_())])
_SCHEMA = "doc_id long, base_sha256 string, n_email long, n_ip long, n_card long, n_phone long, found array<struct<kind string, start int, end int, contexts array<string>, surface long, seed boolean>>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, counts, found = [], {k: [] for k in KINDS}, []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            rows = [(k, s, e) for k in KINDS for s, e in base[k]]
            for k in KINDS:
                counts[k].append(len(base[k]))
            digest.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in rows).encode()).hexdigest())
            own = None
            if rows or _TOKEN.search(text):
                own = _Contexts(text)
            out = [(k, s, e, own.of(s, e), _hash(text[s:e].lower()), True) for k, s, e in rows]
            taken = sorted((s, e) for _, s, e in rows)
            i = 0
            for m in _TOKEN.finditer(text) if own else ():
                s, e = m.span()
                while i < len(taken) and taken[i][1] <= s:
                    i += 1
                if any(a < e for a, b in taken[i : i + 4] if b > s) or m["digits"] and sum(map(str.isdigit, m.group())) < LEAST_DIGITS:
                    continue
                while not text[s].isalnum():
                    s += 1
                while not text[e - 1].isalnum():
                    e -= 1
                out.append((None, s, e, own.of(s, e), _hash(text[s:e].lower()), by_shape(text[s:e])))
            found.append([dict(zip(("kind", "start", "end", "contexts", "surface", "seed"), x)) for x in out])
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(digest, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(found, pa.list_(_SPAN))],
            names=["doc_id", "base_sha256", *(f"n_{k}" for k in KINDS), "found"],
        )


def patterns(found: DataFrame) -> DataFrame:
    """Accepted patterns (context, score). found: context, surface, seed (is it one?), a stored table."""
    edges = stored(found.groupBy("context", "surface").agg(F.max(F.col("seed").cast("int")).alias("seed")), "pii-edges")
    names = edges.groupBy("surface").agg(F.max("seed").cast("double").alias("conf"))
    scores = None
    for turn in range(ROUNDS):
        scored = edges.join(names, "surface").groupBy("context").agg(
            (F.sum("conf") / (F.count(F.lit(1)) + SMOOTH)).alias("score"), F.sum("seed").alias("seeds")
        )
        scores = stored(scored, "pii-patterns")
        if turn + 1 < ROUNDS:
            # seeds stay certain; other instances are as sure as their best pattern
            best = edges.join(scores, "context").groupBy("surface").agg(F.greatest(F.max(F.col("seed").cast("double")), F.max("score")).alias("conf"))
            names = stored(best, "pii-instances")
    return scores.where((F.col("score") >= ACCEPT) & (F.col("seeds") >= SEEDS)).select("context", "score")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the four counts, base_sha256, spans (kind:start:end, ...) and n_id (found by context)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stored(slim.mapInArrow(_extract, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    found = rows.select("row", F.explode("found").alias("f")).select("row", "f.*").withColumn("context", F.explode("contexts"))
    good = maybe_broadcast(stored(patterns(found.select("context", "surface", "seed")), "pii-accepted"))
    extra = found.where("kind is null").join(good, "context").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("more"))
    rows = rows.join(extra, "row", "left")
    more = F.coalesce(F.transform("more", lambda x: F.format_string("id:%d:%d", x["start"], x["end"])), F.expr("cast(array() as array<string>)"))
    base = F.transform(F.filter("found", lambda x: x["kind"].isNotNull()), lambda x: F.format_string("%s:%d:%d", x["kind"], x["start"], x["end"]))
    return rows.select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.array_join(F.concat(base, more), ",").alias("spans"), F.size(more).cast("long").alias("n_id")
    )
