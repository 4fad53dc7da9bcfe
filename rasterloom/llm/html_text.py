"""Main text of HTML pages by site template removal.

First pass: each page is read into its element subtrees (every block element, menus and footers too); a subtree's hash stands for the element's
name, class and id, its own text and the hashes of the subtrees in it, together with the host. Spark counts on how many different pages
of a host each stands, pages of equal main text counting once since sites do repeat whole articles. Subtrees on at least MIN_PAGES such pages and SHARE of the
host's are template, since sites deal a page's menus and boxes from a few; those that may be the text itself, inside the main element (whose own subtree never
counts) or a paragraph, heading or cell, only on CERTAIN of the host's pages. Second pass: the html is read again and the subtrees of the
template are deleted. Only the hashes are shuffled, never html or text.

What stands on one page only is then judged by markup: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments go by element, role, or class and id (whole names, split at - and _, all parts of which must be known), and of a page with <article> or
<main> (or an element so named) the rest outside it.

Cases: null or empty html gives an empty text; a closing tag closes up to its opening one, a closing tag of an inline element never a block; a block closes an open <p>;
an unclosed comment, script or tag runs to the end; elements may stand at any depth (a stack entry each); pages with null url share
the host ''; rows are kept one by one, with null or repeated ids too; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

MIN_PAGES, SHARE, CERTAIN = 5, 0.01, 0.5
#: Hashes of template subtrees (8 bytes each) that every task may get; beyond it they are joined to the pages.
TEMPLATE_KEYS = 1_000_000
# Element names and the words that name page parts.
_RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp".split())
_DROP = frozenset("head nav footer aside form button dialog menu canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_TEXT_LEVEL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt td th caption figcaption address option legend".split())
_CLOSES_P = _BLOCK - frozenset("option caption tbody td tfoot th thead tr legend html body".split())
_COMMENTS = frozenset("comment comments disqus replies respond".split())
_NOISE = _COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs cookie cookies consent "
    "dropdown footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion "
    "recommended related share sharing sidebar sidebars signup skyscraper social sponsor sponsored sponsors subscribe toolbar widget widgets".split()
)
_BESIDE = frozenset(
    "site page global main primary secondary top bottom left right inner outer box block list item items container wrapper wrap section area content body text title "
    "links link bar form row col column group unit slot area author meta module panel blog responsive sticky fixed mobile desktop".split()
)
#: Words of parts that belong to the article itself: beside them a header is the article's.
_OWN = frozenset("post posts article articles entry story".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_MAIN_NAMES = frozenset("article main post-content post-body entry-content article-body article-content articlebody main-content story-body".split())
_LAST = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_SAME = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))?+)?+")
_TAG_END = re.compile(r"[\s/]*+>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in _RAW}
_TOP = ("", -1, False, False, False, False)
_PARTS = re.compile(r"[-_]+")


class _Names(dict):
    """Class or id name to (noise, noise on an article or main element too)."""

    def __missing__(self, name: str) -> tuple[bool, bool]:
        if len(self) >= 50_000:
            self.clear()
        parts = {p for p in _PARTS.split(name.lower()) if p and not p.isdigit()}
        noise = parts & _NOISE
        known = parts <= _NOISE | _BESIDE | (frozenset() if noise <= {"header", "masthead", "banner"} else _OWN)
        found = self[name] = (bool(noise) and known, bool(noise & _COMMENTS) and known)
        return found


def _judge(tag: str, attrs: dict[str, str], in_main: bool, names: _Names) -> tuple[bool, bool]:
    """(noise by markup, holds the main text) of an element."""
    drop, main = tag in _DROP or tag == "header" and not in_main, tag in ("article", "main")
    if not attrs:
        return drop, main and not drop
    role = attrs.get("role", "").strip().lower()
    called = attrs.get("class", "").split() + attrs.get("id", "").split()
    drop |= role in _NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
    drop |= "display:none" in attrs.get("style", "").replace(" ", "").lower()
    if tag not in ("html", "body"):
        drop |= any(names[n][main] for n in called)
    main |= role in ("main", "article") or not _MAIN_NAMES.isdisjoint(n.lower() for n in called)
    return drop, main and not drop


class Page:
    """A page read once, in time linear in its length.

    blocks: (text, number of the innermost subtree or -1, noise by markup, inside the main element). Subtree numbers grow from the outside in; `parent`,
    `own` (may be the page's own text) and `hashes` (0: no template candidate) are by number.
    """

    def __init__(self, source: str, names: _Names, host: int = 0) -> None:
        self.blocks: list[tuple[str, int, bool, bool]] = []
        self.parent, self.own, self.hashes = array("q"), bytearray(), array("Q")
        self._names, self._host = names, host
        self._text: list[str] = []
        self._open: list[tuple[str, int, bool, bool, bool, bool]] = []  # tag, subtree, noise, in main, a main element itself, in an inline element that is noise
        self._at: dict[str, list[int]] = {}  # tag: places in _open
        self._blocks: list[int] = []  # places of block elements in _open
        self._said: list[int] = []  # hashes of the open subtrees so far
        self._read(source)
        self._flush()
        self._cut(0)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            stop = source.find("<", at)
            if stop < 0:
                stop = n
            if stop > at:
                self._say(entities.unescape(source[at:stop]))
            if stop >= n - 1:
                self._say(source[stop:])
                return
            c = source[stop + 1]
            if c.isascii() and c.isalpha():
                at = self._start(source, stop + 1)
            elif c == "/":
                m = _NAME.match(source, stop + 2)
                end = source.find(">", stop + 2)
                at = end + 1 if end >= 0 else n
                if m and end >= 0:
                    self._end(m.group().lower())
            elif c in "!?":
                if source.startswith("<!--", stop):
                    end = source.find("-->", stop + 4)
                    at = end + 3 if end >= 0 else n
                else:
                    end = source.find(">", stop + 2)
                    at = end + 1 if end >= 0 else n
            else:
                self._say("<")
                at = stop + 1

    def _say(self, text: str) -> None:
        if not (self._open and self._open[-1][5]):
            self._text.append(text)

    def _start(self, source: str, at: int) -> int:
        """Read the start tag whose name begins at `at`; the place after it."""
        m = _NAME.match(source, at)
        tag, at, attrs = m.group().lower(), m.end(), {}
        while not (done := _TAG_END.match(source, at)):
            m = _ATTR.match(source, at)
            if not m:  # the text ends within the tag
                return len(source)
            at = m.end()
            attrs.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = done.end()
        if tag in _RAW:
            if source[at - 2] == "/" and tag in ("svg", "math"):
                return at
            end = _RAW_END[tag].search(source, at)
            return end.end() if end else len(source)
        if tag in _BLOCK:
            self._flush()
        elif tag == "br":
            self._text.append(" ")
        if tag in _CLOSES_P:
            self._close("p")
        if tag in _LAST:
            for same in _SAME.get(tag, (tag,)):
                self._close(same, _LAST[tag])
        if tag not in _VOID and not (source[at - 2] == "/" and tag not in _BLOCK):
            self._push(tag, attrs)
        return at

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        _, subtree, noise, main, _, mute = self._open[-1] if self._open else _TOP
        drop, holds = _judge(tag, attrs, main, self._names)
        holds = holds and not noise
        self._at.setdefault(tag, []).append(len(self._open))
        if tag in _BLOCK:
            self._blocks.append(len(self._open))
            if tag not in ("html", "body"):
                self.parent.append(subtree)
                self.own.append(main or tag in _TEXT_LEVEL)
                self.hashes.append(0)
                subtree = len(self.parent) - 1
                self._said.append(xxhash.xxh3_64_intdigest(f"{tag} {attrs.get('class', '')} {attrs.get('id', '')}".encode("utf-8", "surrogatepass"), self._host))
        self._open.append((tag, subtree, noise or drop, main or holds, holds, mute or drop and tag not in _BLOCK))

    def _flush(self) -> None:
        words = " ".join("".join(self._text).split())
        self._text.clear()
        if words:
            _, subtree, noise, main, _, _ = self._open[-1] if self._open else _TOP
            self.blocks.append((words, subtree, noise, main))
            if self._said:
                self._said[-1] = xxhash.xxh3_64_intdigest(b"\x00" + words.encode("utf-8", "surrogatepass"), self._said[-1])

    def _cut(self, i: int) -> None:
        """Close all from place i in _open on."""
        if self._blocks and self._blocks[-1] >= i:
            self._flush()
        while len(self._open) > i:
            tag, subtree, _, _, holds, _ = self._open.pop()
            self._at[tag].pop()
            if tag in _BLOCK:
                self._blocks.pop()
                if tag not in ("html", "body"):
                    said = self._said.pop()
                    if self._said:
                        self._said[-1] = xxhash.xxh3_64_intdigest(b"\x01" + said.to_bytes(8, "little"), self._said[-1])
                    self.hashes[subtree] = 0 if holds else said

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
        places = self._at.get(tag)
        if places and (tag in _BLOCK or not self._blocks or self._blocks[-1] < places[-1]):
            self._cut(places[-1])

    def _close(self, tag: str, within: tuple = ()) -> None:
        """Close the innermost open `tag` unless an element of `within` lies in it."""
        if places := self._at.get(tag):
            if not any((p := self._at.get(w)) and p[-1] > places[-1] for w in within):
                self._cut(places[-1])

    def kept(self) -> list[tuple[str, int]]:
        """(text, innermost subtree) of the blocks that markup leaves: in the main element, if the page has one."""
        kept = [b for b in self.blocks if not b[2]]
        mains = [b for b in kept if b[3]]
        return [b[:2] for b in mains or kept]

    def text(self, is_template: list[bool]) -> tuple[str, int]:
        """The page's text without template subtrees, and how many blocks were deleted as template."""
        gone = bytearray(len(self.parent))
        for s, p in enumerate(self.parent):
            gone[s] = is_template[s] or p >= 0 and gone[p]
        deleted = sum(s >= 0 and gone[s] for _, s, _, _ in self.blocks)
        return " ".join(words for words, s in self.kept() if s < 0 or not gone[s]), deleted


def subtree_keys(page: Page) -> np.ndarray:
    """Template keys by subtree number: the hash with its last bit telling whether it may be the page's own text; 0 for no candidate."""
    h = np.frombuffer(page.hashes, np.uint64) if page.hashes else np.empty(0, np.uint64)
    key = h & np.uint64(2**64 - 2) | np.frombuffer(bytes(page.own), np.uint8).astype(np.uint64)
    return np.where(h > 0, key, np.uint64(0)).view(np.int64)


def _host_seed(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page (hash of the main text), keys: the page's subtrees, and 0 for the page itself."""
    names = _Names()
    for batch in batches:
        hosts, pages, keys = [], [], []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if source:
                seed = _host_seed(host)
                page = Page(source, names, seed)
                hosts.append(seed)
                pages.append(xxhash.xxh3_64_intdigest("\x00".join(b[0] for b in page.kept()).encode("utf-8", "surrogatepass")))
                keys.append(np.unique(np.r_[subtree_keys(page), 0]))
        longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.record_batch([longs(hosts), longs(pages), pa.array(keys, pa.list_(pa.int64()))], names=["host", "page", "keys"])


def template_keys(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, certain: float = CERTAIN) -> DataFrame:
    """key: the hashes of template subtrees (each for one host). pages: host, html."""
    seen = pages.select("host", "html").mapInArrow(_hashes, "host long, page long, keys array<long>")
    seen = seen.select("host", "page", F.explode("keys").alias("key"))
    counts = seen.distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    counts = stored(counts, "page-subtrees")
    sites = counts.where("key = 0").select("host", F.col("n").alias("pages"))
    enough = F.col("n") >= F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, F.lit(certain)).otherwise(F.lit(share)) * F.col("pages")
    return stored(counts.where("key <> 0").join(sites, "host").where(enough).select("key").distinct(), "page-template")


_TEXTS = "page_id long, url string, text string, n_chars long, n_template long"


def _texts(held):
    """Rows with their texts. held: a broadcast of the sorted template keys, or None where each row has its own in `gone`."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for batch in batches:
            out, chars, deleted = [], [], []
            gone = batch.column("gone").to_pylist() if held is None else [held.value] * batch.num_rows
            for host, source, template in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), gone):
                if not source:
                    text, n = "", 0
                else:
                    page = Page(source, names, _host_seed(host))
                    keys = subtree_keys(page)
                    text, n = page.text(_held(keys, np.sort(np.asarray(template if template is not None else [], np.int64))) if held is None else _held(keys, template))
                out.append(text)
                chars.append(len(text))
                deleted.append(n)
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(chars, pa.int64()), pa.array(deleted, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_template"],
            )

    return texts


def _held(keys: np.ndarray, template: np.ndarray) -> list[bool]:
    """Which keys stand in the sorted template."""
    if not len(template):
        return [False] * len(keys)
    at = np.minimum(np.searchsorted(template, keys), len(template) - 1)
    return ((template[at] == keys) & (keys != 0)).tolist()


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, certain: float = CERTAIN, most_keys: int = TEMPLATE_KEYS) -> DataFrame:
    """page_id, url, text, n_chars, n_template (blocks deleted as template): one row per row of pages (page_id, url, html)."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    keys = template_keys(slim, min_pages, share, certain)
    if keys.limit(most_keys + 1).count() <= most_keys:
        template = np.sort(keys.toArrow().column("key").to_numpy())
        return slim.mapInArrow(_texts(pages.sparkSession.sparkContext.broadcast(template)), _TEXTS)
    # pages of one host and equal html have equal template subtrees
    same = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    own = slim.withColumn("same", same).select("host", "same", "html").mapInArrow(_own_keys, "host string, same string, key long")
    gone = own.join(keys, "key").groupBy("host", "same").agg(F.collect_set("key").alias("gone"))
    return slim.withColumn("same", same).join(gone, ["host", "same"], "left").drop("same").mapInArrow(_texts(None), _TEXTS)


def _own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _Names()
    for batch in batches:
        hosts, same, keys = [], [], []
        for host, md5, source in zip(*(batch.column(c).to_pylist() for c in ("host", "same", "html"))):
            own = np.unique(subtree_keys(Page(source, names, _host_seed(host)))) if source else np.empty(0, np.int64)
            hosts += [host] * len(own)
            same += [md5] * len(own)
            keys.append(own)
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(same, pa.string()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], names=["host", "same", "key"])
