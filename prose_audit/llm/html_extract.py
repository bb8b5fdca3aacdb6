"""Main text of web pages: blocks by markup, boilerplate by suffix arrays over the pages of a host.

A tolerant tokenizer turns a page into elements and blocks of text. Menus, footers, asides, scripts and what is hidden
go by their tags. Words of classes and ids (sidebar, comments, cookie) and forms are signs only: an element with a sign
stays if it has a name for content as well, or if it holds most of the page's text and no other element for content does;
readers' comments don't.
Names that speak about a part (``has-comments``, ``no-ads``, ``share-enabled``) are no signs. The blocks of the best zone
of a page remain: articles, else the main part, else all; the main part comes before articles of a third of its text.

The token streams of a host's pages, with a mark at each end of a block, are concatenated and their suffixes
sorted (prefix doubling), with the lengths of common prefixes of neighbours. Where they are RUN tokens or
longer, neighbours are one run; a run on enough distinct pages of the host is boilerplate. Every token that
such runs cover goes, inside of blocks too, and unique runs stay. Where markup names no article, a few pages
are enough; from an article only what most pages of the host have goes. Pages with equal blocks count as one
page, so copies of a page don't make its text boilerplate.

Each page is parsed once; its blocks are stored, and each kind of page (host and blocks) is cleaned once. Kinds of
hosts over SHARE_BYTES of text (or a 1,000,000th of all) lie in several suffix arrays, drawn by their hash. A run that is on
enough pages of the host is so in one of them at least; such candidates are then counted in all shares of the host, so
the result is that of one array over the whole host. A task holds one share.

Defined cases: a null html is the empty page, with empty text; a null url, or one without a host, belongs to
the empty host; repeated rows get equal texts; unclosed elements end with the page; very long pages are parsed
and compared whole; an empty table gives no rows. Other columns of the input are dropped.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, map_batches, stored
from .url_filter import split_url

#: Tokens of a run; common prefixes are measured up to DEPTH tokens.
RUN, DEPTH = 8, 8
#: Distinct pages that make a run boilerplate, at least and as a share of the host's: for pages without an
#: article, and for an article's own text.
FEW, MOST = (3, 0.02), (10, 0.6)
#: Bytes of text of one suffix array; at most so many hosts have several; kinds of pages that a task remembers.
SHARE_BYTES, HEAVY_HOSTS, SEEN = 3 << 20, 1_000_000, 200_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: The token between blocks, which no word can be.
MARK = "\n"

OTHER, MAIN, ARTICLE, HEADING_ONLY, DROPPED = 0, 1, 2, 3, 4

# Element names of HTML by what they mean here.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
LEFT_OUT = {"nav", "footer", "aside", "noscript", "template", "svg", "math", "object", "button", "select", "head", "dialog", "menu", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role that are signs; the soft ones not beside a word for content; those for readers' comments.
HARD_WORDS = set(
    "ad ads advert advertisement adverts advertising adsense adslot sponsor sponsored promo promotion comment comments disqus replies respond "
    "cookie cookies consent gdpr notice notices footer nav navbar navigation menu breadcrumb breadcrumbs related recommended share sharing social "
    "newsletter subscribe signup login contentinfo complementary pagination pager skip".split()
)
SOFT_WORDS = set("sidebar header masthead banner widget widgets alert overlay modal popup search form dialog toolbar hidden".split())
CONTENT_WORDS = set("article content entry story post main body text".split())
COMMENT_WORDS = set("comment comments disqus replies respond".split())
#: Beside one of these a word is no sign: the name speaks about the part, or reads like a heading.
ABOUT_WORDS = set("has have no not with without is js enabled disabled open closed on off allowed count of about for to in and the".split())
ARTICLE_WORDS = {"articlebody", "article-body", "article-content", "post-content", "post-body", "entry-content", "story-body", "article", "post", "entry"}
MAIN_WORDS = {"main", "content", "main-content", "page-content"}
#: An element for content counts against a sign from this share of the page's text on; the main part's own text outweighs
#: articles of this many times less.
OTHER_SHARE, TEASER = 0.1, 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+)|<", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """What an element's tag and names say, and its place in the page."""

    __slots__ = ("parent", "end", "gone", "sign", "comment", "named", "header", "zone", "chars")

    def __init__(self, parent: int, tag: str, attributes: str) -> None:
        self.parent, self.end, self.chars = parent, 0, 0
        self.gone, self.header, self.named = tag in LEFT_OUT, tag == "header", False
        self.sign, self.comment = tag == "form", False
        self.zone = ARTICLE if tag == "article" else MAIN if tag == "main" else OTHER
        if not attributes:
            return
        found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        names = " ".join(found.get(k, "") for k in ("class", "id", "role")).split()
        plain = {n.lower() for n in names} | set(found.get("itemprop", "").lower().split())
        if plain & ARTICLE_WORDS:
            self.zone, self.named = ARTICLE, True
        elif plain & MAIN_WORDS:
            self.zone, self.named = max(self.zone, MAIN), True
        if tag in ("html", "body", "main"):
            return
        self.gone = self.gone or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
        parts = [set(WORDS.findall(CAMEL.sub(" ", n).lower())) for n in names]
        told = set().union(*[p for p in parts if not p & ABOUT_WORDS]) if parts else set()
        self.comment = bool(told & COMMENT_WORDS)
        if tag == "article":
            self.sign = self.comment
        elif told & HARD_WORDS:
            self.sign = True
        elif told & SOFT_WORDS:
            if not told & CONTENT_WORDS:
                self.sign = True
            elif "header" in told:
                self.header = True


class Page:
    """Elements of a page in the order of their beginnings, and its blocks: element, text, whether it is a heading, and
    its characters outside and inside of links."""

    def __init__(self, page: str) -> None:
        self.elements = [Element(0, "html", "")]
        self.blocks: list[tuple[int, str, bool, int, int]] = []
        self._parse(page)
        for i in range(len(self.elements) - 1, 0, -1):
            own = self.elements[i]
            above = self.elements[own.parent]
            above.chars += own.chars
            above.end = max(above.end, own.end, i)
        for i, e in enumerate(self.elements):
            e.end = max(e.end, i)

    def _parse(self, page: str) -> None:
        elements, found = self.elements, self.blocks
        open_: list[tuple[str, int]] = []
        names: Counter[str] = Counter()  # of open elements
        own, hidden, heading, linked = 0, False, False, 0
        parts: list[str] = []
        link_chars = chars = 0

        def flush() -> None:
            nonlocal parts, link_chars, chars
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text and not hidden:
                    found.append((own, text, heading, chars - link_chars, link_chars))
                    elements[own].chars += chars - link_chars
                parts, link_chars, chars = [], 0, 0

        at, end = 0, len(page)
        while at < end:
            token = TOKEN.match(page, at)
            at = token.end()
            text = token[7]
            if text is not None or token[0] == "<":
                if not hidden:
                    text = text or "<"
                    parts.append(text)
                    chars += len(text)
                    link_chars += len(text) * linked
                continue
            name = token[2] or token[5]
            if name is None:
                continue
            name = name.lower()
            attributes = (token[3] if token[2] else token[6]).strip()
            if not (token[1] or token[4]):
                if name in RAW:
                    close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = close.end() if close else end
                    continue
                if name == "a":
                    linked = 1
                if name in VOID:
                    if name in INLINE:
                        if name == "br":
                            parts.append(" ")
                    else:
                        flush()
                    continue
                if name in INLINE:
                    if attributes:
                        new = Element(own, name, attributes)
                        if new.gone or new.sign or new.zone or new.header:
                            flush()
                            open_.append((name, own))
                            names[name] += 1
                            elements.append(new)
                            own, hidden = len(elements) - 1, hidden or new.gone
                    continue
                flush()
                heading = name in HEADINGS
                if name == "p" and open_ and open_[-1][0] == "p":
                    own = open_.pop()[1]
                    hidden = elements[own].gone
                    names["p"] -= 1
                if not attributes.endswith("/") or name not in ("path", "g"):
                    open_.append((name, own))
                    names[name] += 1
                    new = Element(own, name, attributes)
                    new.gone = new.gone or hidden
                    elements.append(new)
                    own, hidden = len(elements) - 1, new.gone
            else:
                if name == "a":
                    linked = 0
                if name not in INLINE:
                    flush()
                    heading = False
                if names[name]:
                    if name in INLINE:
                        flush()
                    closed = ""
                    while closed != name:
                        closed, own = open_.pop()
                        names[closed] -= 1
                    hidden = elements[own].gone
        flush()

    def _needed(self, i: int) -> bool:
        """Whether an element has most of the page's text, and no other element for content has much of it; readers'
        comments are never needed, however long."""
        own, whole = self.elements[i], self.elements[0].chars
        if own.comment or 2 * own.chars <= whole:
            return False
        return not any(e.zone and not e.gone and not e.sign and (j > own.end or e.end < i) and e.chars >= max(1, OTHER_SHARE * whole) for j, e in enumerate(self.elements))

    def zones(self) -> list[tuple[int, str]]:
        """Zone and text of every block, in order, without those left out and, outside of articles, those that are links
        for the most part."""
        zone = [OTHER] * len(self.elements)
        for i, e in enumerate(self.elements):
            around = zone[e.parent]
            if around == DROPPED or e.gone:
                zone[i] = DROPPED
            elif e.sign and (e.comment or not e.named) and not self._needed(i):
                zone[i] = DROPPED
            elif e.header and not e.named and around == OTHER:
                zone[i] = OTHER if self._needed(i) else DROPPED
            elif around == HEADING_ONLY or e.header and not e.named:
                zone[i] = HEADING_ONLY
            else:
                zone[i] = max(around, e.zone)
        out = []
        for i, text, heading, plain, linked in self.blocks:
            own = zone[i]
            if own != DROPPED and (own != HEADING_ONLY or heading) and (own in (ARTICLE, HEADING_ONLY) or linked < plain):
                out.append((ARTICLE if own == HEADING_ONLY else own, text))
        return out


def blocks(page: str) -> list[tuple[int, str]]:
    """Zone and text of every block of a page that its markup leaves in."""
    return Page(page).zones()


def best_zone(found: list[tuple[int, str]]) -> int:
    """The zone that holds a page's main text: by what is marked, unless the articles are but teasers in the main part."""
    best = max((z for z, _ in found), default=OTHER)
    if best == ARTICLE:
        size = [sum(len(t) for z, t in found if z == zone) for zone in (MAIN, ARTICLE)]
        return MAIN if size[0] > TEASER * size[1] else ARTICLE
    return best


def main_blocks(page: str) -> tuple[int, list[str]]:
    """The best zone of a page and the texts of its blocks."""
    found = blocks(page)
    best = best_zone(found)
    return best, [text for zone, text in found if zone == best]


def stream(texts: list[str]) -> list[str]:
    """The words of blocks with a mark before the first, between them and after the last one."""
    out = [MARK]
    for text in texts:
        out += text.split(" ")
        out.append(MARK)
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``tokens`` in the order of their first 2 * DEPTH - 1 tokens or more, and for each the length of
    the prefix that it shares with the one before (0 for the first; longer ones count as 2 * DEPTH - 1)."""
    n = len(tokens)
    base = np.int64(max(n, int(tokens.max())) + 2)
    rank, step, ranks = tokens.astype(np.int64), 1, []
    while True:
        ranks.append(rank.astype(np.int32))
        if step > DEPTH:
            break
        moved = np.zeros(n, np.int64)
        moved[: max(0, n - step)] = rank[step:] + 1
        key = rank * base + moved
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        step *= 2
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 2, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        same &= (a + (1 << k) <= n) & (b + (1 << k) <= n)
        shared[1:] += same << k
        a += same << k
        b += same << k
    return order, shared


def numbered(streams: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """The words of some pages' streams as numbers, with one of its own at the end of each page, and what has which number."""
    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    tokens = np.concatenate([np.fromiter(map(numbers.__getitem__, chain(words, (MARK,))), np.int64, len(words) + 1) for words in streams])
    ends = np.cumsum([len(words) + 1 for words in streams]) - 1
    tokens[ends] = len(numbers) + np.arange(len(ends))  # no run goes over the end of a page
    return tokens, list(numbers)


def repeats(streams: list[list[str]], tokens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of RUN tokens of some pages' streams by a suffix array: for each place where one begins, the place and the
    run; of each run on how many of the pages it stands, and its first place. A page ends with a token of its own."""
    if tokens is None:
        tokens = numbered(streams)[0]
    lengths = np.array([len(words) + 1 for words in streams])
    page, ends = np.repeat(np.arange(len(streams)), lengths), np.cumsum(lengths) - 1
    order, shared = suffix_array(tokens)
    run = np.cumsum(shared < RUN)
    fits = order + RUN <= ends[page[order]]
    order, run = order[fits], run[fits]
    # runs ascend, and most of them stand at one place
    new = np.append(True, run[1:] != run[:-1])[: len(run)]
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    places = np.diff(first, append=len(run))
    many = places[run] > 1
    kinds = np.sort(run[many] * np.int64(len(streams)) + page[order[many]])
    kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])[: len(kinds)]] // len(streams)
    pages = np.where(places > 1, np.bincount(kinds, minlength=len(first)), 1)
    return order, run, pages, order[first]


def run_pages(streams: list[list[str]], least: int = 1) -> tuple[list[str], list[int]]:
    """The runs of some pages' streams as texts, and on how many of the pages each stands, where those are ``least`` or more."""
    _, _, counts, first = repeats(streams)
    enough = counts >= least
    words = [w for own in streams for w in [*own, ""]]
    return [" ".join(words[i : i + RUN]) for i in first[enough].tolist()], counts[enough].tolist()


def uncovered(words: list[str], covered: np.ndarray) -> str:
    """The blocks of a stream without the tokens covered; empty blocks go."""
    kept = [w if w == MARK or not gone else "" for w, gone in zip(words, covered.tolist())]
    return "\n".join(x for x in (" ".join(filter(None, block.split(" "))) for block in " ".join(kept).split(MARK)) if x)


def thresholds(pages: int) -> tuple[int, int]:
    """Distinct pages of a host that make a run boilerplate, outside of articles and in them."""
    few, most = (max(least, math.ceil(share * pages - 1e-9)) for least, share in (FEW, MOST))
    return few, most


def clean_host(kinds: list[tuple[int, list[str]]]) -> list[str]:
    """The texts of all distinct pages of a host, each a zone and blocks, without the runs that enough of them have."""
    few, most = thresholds(len(kinds))
    if len(kinds) < few:
        return [MARK.join(texts) for _, texts in kinds]
    streams = [stream(texts) for _, texts in kinds]
    places, run, counts, _ = repeats(streams)
    total = sum(len(words) + 1 for words in streams)
    covers = []
    for least in (few, most):
        starts = places[counts[run] >= least]
        edges = np.bincount(starts, minlength=total + 1) - np.bincount(starts + RUN, minlength=total + 1)
        covers.append(np.cumsum(edges)[:-1] > 0)
    out, at = [], 0
    for (zone, texts), words in zip(kinds, streams):
        own = covers[zone == ARTICLE][at : at + len(words)]
        out.append(uncovered(words, own) if own.any() else MARK.join(texts))
        at += len(words) + 1
    return out


class Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: str) -> int:
        own = self[word] = xxhash.xxh64_intdigest(word)
        return own


def run_sums(own: np.ndarray) -> np.ndarray:
    """Hashes of runs by place from hashes of words: sums of these, each by a power of an odd number."""
    n = len(own) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(RUN):
        total = total * FACTOR + own[k : k + n]
    return (total ^ (total >> np.uint64(31))).view(np.int64)


def hashed_runs(words: list[str], hashes: Hashes | None = None) -> np.ndarray:
    """The hashes of a stream's runs, by place; streams of one share have their words' ``hashes`` in common."""
    known = Hashes() if hashes is None else hashes
    return run_sums(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of the values are in the other, ascending array."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def unique_text(texts: list[str], boilerplate: np.ndarray, hashes: Hashes | None = None) -> str:
    """Blocks without the tokens that the runs of ``boilerplate`` (their hashes, ascending) cover."""
    if not len(boilerplate):
        return MARK.join(texts)
    words = stream(texts)
    starts = np.flatnonzero(among(hashed_runs(words, hashes), boilerplate))
    if not len(starts):
        return MARK.join(texts)
    edges = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + RUN, minlength=len(words) + 1)
    return uncovered(words, np.cumsum(edges)[:-1] > 0)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, host, html)`` → page_id, url, host, kind, size, blocks: the hash of a page's zone and blocks,
    and where a task meets that kind of page first, the bytes of its texts and the blocks, packed. Stored."""
    schema = "page_id long, url string, host string, kind long, size long, blocks binary"
    out_schema = arrow_schema(pages.sparkSession, schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            page_id, url, host, html = batch.columns
            kinds, sizes, packed = [], [], []
            for own, page in zip(host.to_pylist(), html):
                zone, texts = main_blocks(page.as_py())
                data = MARK.join([str(zone), *texts]).encode()
                kind = xxhash.xxh64_intdigest(data) - (1 << 63)
                new = bool(texts) and (own, kind) not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((own, kind))
                kinds.append(kind)
                sizes.append(len(data) if new else None)
                packed.append(pack(data) if new else None)
            columns = [page_id, url, host, pa.array(kinds, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    return stored(map_batches(pages.select("page_id", "url", "host", "html"), parse, schema, rows=500), "html-pages")


def unpack(packed: bytes) -> tuple[int, list[str]]:
    zone, *texts = zstandard.decompress(packed).decode().split(MARK)
    return int(zone), texts


#: Main texts of the pages that carry their blocks; ``copied``: once for each kind that other pages are copies of.
CLEANED = "page_id long, url string, host string, kind long, copied boolean, text string"


class Share:
    """The rows of one share of a host: its kinds of pages, the pages that carry them, the kinds that have copies."""

    def __init__(self, table: pa.Table) -> None:
        self.host = table["host"][0].as_py() if table.num_rows else None
        self.kinds: dict[int, tuple[int, list[str]]] = {}
        self.pages: list[tuple] = []
        self.copied: set[int] = set()
        for page_id, url, kind, packed in zip(*(table[c] for c in ("page_id", "url", "kind", "blocks"))):
            kind, data = kind.as_py(), packed.as_py()
            if data is None:
                self.copied.add(kind)
                continue
            self.pages.append((page_id.as_py(), url.as_py(), kind))
            if kind not in self.kinds:
                self.kinds[kind] = unpack(data)

    def cleaned(self, texts: list[str]) -> pa.Table:
        """Rows of CLEANED, given the texts of the kinds."""
        of, out, todo = dict(zip(self.kinds, texts)), [], set(self.copied)
        for page_id, url, kind in self.pages:
            out.append({"page_id": page_id, "url": url, "host": self.host, "kind": kind, "copied": kind in todo, "text": of[kind]})
            todo.discard(kind)
        return pa.Table.from_pylist(out, schema=CLEANED_ARROW)


CLEANED_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("kind", pa.int64()), ("copied", pa.bool_()), ("text", pa.string())])
RUN_ARROW = pa.schema([("host", pa.string()), ("run", pa.int64()), ("n", pa.int64())])


def _clean_host(table: pa.Table) -> pa.Table:
    """A host with one share."""
    share = Share(table)
    return share.cleaned(clean_host(list(share.kinds.values())))


def _candidates(table: pa.Table) -> pa.Table:
    """The runs of a share that the host's pages may have often enough: what is on fewer than this share of the pages of
    each suffix array is so of the host's."""
    share = Share(table)
    if not share.kinds:
        return RUN_ARROW.empty_table()
    streams = [stream(texts) for _, texts in share.kinds.values()]
    tokens, words = numbered(streams)
    _, _, counts, first = repeats(streams, tokens)
    first = first[counts >= math.ceil(FEW[1] * len(streams) - 1e-9)]
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    hashes = np.unique(run_sums(own[np.minimum(tokens, len(own) - 1)])[first])  # no run has the end of a page
    return pa.table([pa.array([share.host] * len(hashes), pa.string()), pa.array(hashes), pa.nulls(len(hashes), pa.int64())], schema=RUN_ARROW)


def _count_runs(table: pa.Table, runs: pa.Table) -> pa.Table:
    """On how many pages of the share each of the runs stands; the row without a run has all its pages."""
    share, wanted, counts, hashes = Share(table), np.sort(runs["run"].to_numpy()), Counter(), Hashes()
    if len(wanted):
        for _, texts in share.kinds.values():
            here = hashed_runs(stream(texts), hashes)
            counts.update(set(here[among(here, wanted)].tolist()))
    rows = [(None, len(share.kinds)), *counts.items()]
    return pa.table([pa.array([share.host] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], schema=RUN_ARROW)


def _clean_share(table: pa.Table, runs: pa.Table) -> pa.Table:
    """A share of a host with several, given the runs that enough of the host's pages have."""
    share, few, hashes = Share(table), runs["run"].to_numpy(), Hashes()
    most = np.sort(few[runs["most"].to_numpy(zero_copy_only=False).astype(bool)])
    few = np.sort(few)
    return share.cleaned([unique_text(texts, most if zone == ARTICLE else few, hashes) for zone, texts in share.kinds.values()])


def cleaned_pages(parsed: DataFrame) -> DataFrame:
    """``parsed`` (see ``parsed_pages``) → rows of CLEANED, for the pages that carry their blocks.

    The shares of hosts are shuffled once, for all steps on them. A host's candidates are on 2 % of the pages
    of a share, so they are at most 50 times the tokens of a share's mean page, for each share that finds its own.
    """
    own = parsed.filter("blocks is not null").select("host", "kind", "page_id", "url", "size", "blocks")
    sizes = own.groupBy("host").agg(F.sum("size").alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    share_bytes = max(SHARE_BYTES, total / HEAVY_HOSTS)
    # hosts over a 1,000,000th of all bytes are fewer than 1,000,000
    heavy = stored(sizes.filter(F.col("bytes") > share_bytes).select("host", F.ceil(F.col("bytes") / share_bytes).cast("int").alias("shares")), "html-hosts")
    copied = parsed.groupBy("host", "kind").agg(F.count("*").alias("n"), F.count("blocks").alias("own")).filter("n > own and own > 0")
    rows = own.drop("size").unionByName(copied.select("host", "kind"), allowMissingColumns=True)
    dealt = rows.join(F.broadcast(heavy), "host", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    dealt = dealt.withColumn("share", F.pmod("kind", "shares").cast("int")).select("host", "share", "kind", "page_id", "url", "shares", "blocks")
    small, large = (dealt.filter(c).drop("shares").groupBy("host", "share") for c in ("shares = 1", "shares > 1"))
    once = small.applyInArrow(_clean_host, CLEANED)
    if heavy.isEmpty():
        return once

    def of_shares(runs: DataFrame):
        return runs.join(F.broadcast(heavy), "host").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares").groupBy("host", "share")

    found = "host string, run long, n long"
    candidates = large.applyInArrow(_candidates, found).select("host", "run").distinct()
    counts = large.cogroup(of_shares(candidates)).applyInArrow(_count_runs, found).groupBy("host", "run").agg(F.sum("n").alias("n"))
    pages = F.max(F.when(F.col("run").isNull(), F.col("n"))).over(Window.partitionBy("host"))
    few, most = (F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("pages") - 1e-9)) for least, share in (FEW, MOST))
    common = counts.withColumn("pages", pages).filter(F.col("run").isNotNull() & (F.col("n") >= few)).select("host", "run", (F.col("n") >= most).alias("most"))
    return once.unionByName(large.cogroup(of_shares(common)).applyInArrow(_clean_share, CLEANED))


def main_texts(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` → page_id, url, text, n_chars."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(split_url()[0], F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    parsed = parsed_pages(own)
    texts = cleaned_pages(parsed)
    copies = parsed.filter("blocks is null").select("page_id", "url", "host", "kind").join(texts.filter("copied").select("host", "kind", "text"), ["host", "kind"], "left")
    rows = texts.select("page_id", "url", "text").unionByName(copies.select("page_id", "url", F.coalesce("text", F.lit("")).alias("text")))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
