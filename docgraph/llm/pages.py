"""Main text of web pages: markup where it tells, repeated runs of a host's pages where it does not.

A page is parsed into blocks. Elements that hold menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments (by tag, role, class or id) are left out; a header within an article is part of it. If the page
marks its article (article, else main, else an element whose class or id says content), its text is that element's; if
main holds more than twice the text of the articles, they are teasers, and all of main and the articles is the text.

All pages are compared within their host, by what is open on them: all blocks of a page that marks no article; of others what
stands outside the article, furniture too, and elements in it whose class or id holds a word of furniture beside one that is
not (related-work). The token streams are put end to end, and a suffix array with longest common prefixes finds runs of
RUN tokens or more that stand in two different pages. Of pages that mark no article the runs are removed, and
what is unique stays; of a marked article an element in doubt goes if runs cover half of its tokens or more. Pages equal in all tokens count as one there. A host's pages are dealt to shards of about
SHARD pages, so that no host is one task's; what a shard holds on one page alone is looked up in the host's other
shards by 64-bit hashes of all windows of RUN tokens, so that the text doesn't depend on the shards. Repeated runs never
remove marked articles: copies of an article on several pages are articles all the same.

Edge cases: null html has an empty text, a null or odd url counts as one host; unclosed, unopened and wrongly nested
tags are closed where HTML closes them or ignored; an unclosed comment, script, style, textarea, title, noscript,
template, iframe, xmp or noframes runs to the end, of other raw elements never closed just the tag goes; repeated rows keep their rows; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.llm.common import Words, materialize, mix, slices, table, text_buffers, windows

RUN = 8
SHARD = 512

#: Tags whose content is never part of a text.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes", "svg", "math", "select", "object", "audio", "video", "canvas")
#: Those of another language, which a slash may close.
FOREIGN = ("svg", "math")
#: Those that only lose their tag if they never close; the others run to the end.
SKIPPED = (*FOREIGN, "select", "object", "audio", "video", "canvas")
#: Tags of page furniture.
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset", "datalist"}
#: Roles of page furniture.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words in a class or id that say what an element is for.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside",
    "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "comment", "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "widget", "pagination", "pager", "toolbar",
}
#: Words beside them that tell of layout, not of what a text is about.
LAYOUT = {
    "area", "articles", "author", "bar", "block", "bottom", "box", "btn", "button", "buttons", "card", "center", "col", "column", "container", "content", "count", "entry", "feed", "fixed", "float", "form", "global", "group",
    "icon", "icons", "inner", "item", "items", "js", "layout", "left", "links", "link", "list", "lists", "main", "meta", "mobile", "module", "news", "outer", "page", "panel", "policy", "post", "posts", "primary", "right",
    "row", "secondary", "section", "site", "slot", "small", "stories", "sticky", "story", "text", "thread", "title", "top", "ui", "unit", "user", "view", "wp", "wrap", "wrapper", "zone",
}
#: Words in a class or id that mark the article where no tag does.
CONTENT = {"content", "article", "post", "entry", "story", "main", "body-text", "articlebody", "post-content", "entry-content", "article-body"}
#: Tags without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags that stand within a line.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "link", "meta", "param", "source", "track", "embed", "area",
}
#: Which open element ends when another of the kind begins, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|[!?/][^>]*>|/?[a-zA-Z][^>]*>)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPLIT = re.compile(r"[\s_\-]+")

#: Kinds of elements, BOTH being an article within main.
DROP, PLAIN, NAMED, MAIN, ARTICLE, BOTH = -1, 0, 1, 2, 3, 4
#: Added to the kind of an element that the host's pages decide on.
DOUBT = 10


def _kind(tag: str, attrs: str, inside: int) -> int:
    """What an element is, from its tag and attributes; inside: the kind of the element around it."""
    if tag in FURNITURE and not (tag == "header" and inside >= ARTICLE):
        return DROP
    kind = ARTICLE if tag == "article" else MAIN if tag == "main" else PLAIN
    if attrs and not attrs.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
        if found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or "hidden" in found:
            return DROP
        if kind == PLAIN and ("class" in found or "id" in found) and tag not in ("body", "html"):
            names = f"{found.get('class', '')} {found.get('id', '')}".lower()
            words = set(SPLIT.split(names))
            furniture = NAMES - ({"header"} if inside >= ARTICLE else set())
            if words & furniture:
                sure = inside < NAMED or any(own & furniture and all(w in LAYOUT or w in NAMES or not w.isalpha() for w in own) for own in (set(SPLIT.split(n)) for n in names.split()))
                return DROP if sure else DOUBT
            if words & CONTENT or set(names.split()) & CONTENT:
                return NAMED
    return kind


def _within(outer: int, own: int) -> int:
    """The kind of a block in an element `own` in an element `outer`."""
    if DROP in (outer, own):
        return DROP
    return BOTH if outer == MAIN and own == ARTICLE else max(outer, own)


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block outside furniture: the kind is the most telling element around it."""
    return [(kind, text) for kind, _, text in _blocks(page) if kind != DROP]


def _blocks(page: str | None) -> list[tuple[int, int, str]]:
    """(kind, doubt, text) of each block, furniture too: doubt is the number of the element in doubt around it, or 0."""
    page = page or ""
    out: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int, int]] = []
    kind, doubt, doubts, at = PLAIN, 0, 0, 0
    closed: dict[str, re.Pattern | None] = {}
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((kind, doubt, text))
            parts.clear()

    def shut(n: int) -> tuple[int, int]:
        del stack[n:]
        return stack[-1][1:] if stack else (PLAIN, 0)

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            parts.append(htmllib.unescape(page[at:]))
            break
        if m.start() > at:
            parts.append(htmllib.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in INLINE:
                        flush()
                    kind, doubt = shut(k)
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:
            if tag in FOREIGN and m[3].endswith("/"):
                continue
            if tag not in closed:
                closed[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>" if tag not in FOREIGN else rf"</{tag}\s*>", re.IGNORECASE | re.ASCII)
            end = closed[tag] and closed[tag].search(page, at)
            if end is None:
                closed[tag] = None  # nor is there one further on
            at = end.end() if end else at if tag in SKIPPED else len(page)
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" and tag not in VOID | {"body", "html"}:
                    kind, doubt = shut(k)
                    break
                if stack[k][0] not in INLINE:
                    break
            if tag in ENDS:
                own, stop = ENDS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in stop:
                        break
                    if stack[k][0] in own:
                        kind, doubt = shut(k)
                        break
        if tag not in VOID:
            own, inner = _kind(tag, m[3], kind), doubt
            if own == DOUBT:
                own = PLAIN
                if not doubt:
                    doubts += 1
                    inner = doubts
            new = _within(kind, own)
            if (new, inner) != (kind, doubt) and tag in INLINE:
                flush()
            stack.append((tag, new, inner))
            kind, doubt = new, inner
    flush()
    return out


def article(page: str | None) -> tuple[list[tuple[int, str]] | None, list[str]]:
    """(doubt, text) of the blocks of a page's marked article, or None; and the blocks that the host's pages are compared by."""
    found = _blocks(page)
    best = max((k for k, _, _ in found), default=DROP)
    if best <= PLAIN:
        own = [t for k, _, t in found if k == PLAIN]
        return (None, own) if own else ([], [t for _, _, t in found])
    least = best
    if best >= ARTICLE:
        size = lambda *kinds: sum(len(t) for k, _, t in found if k in kinds)
        least = MAIN if size(MAIN, BOTH) > 2 * size(ARTICLE, BOTH) else ARTICLE
    kept = [(d, t) for k, d, t in found if k >= least]
    return kept, [*(t for d, t in kept if d), *(t for k, _, t in found if k < least)]


def main_text(page: str | None) -> tuple[str | None, list[str]]:
    """The text of a page that marks its article, with all that is in doubt; else None and its blocks."""
    kept, open_ = article(page)
    return (None, open_) if kept is None else (" ".join(t for _, t in kept), [])


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes, and ranks of all substrings of 1, 2, 4, ... tokens, by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, step, n = [rank], 1, len(tokens)
    while n > 1 and step < n and rank.max() < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        step *= 2
    return np.argsort(rank, kind="stable"), ranks


def common(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix in order with the one before it."""
    n = len(order)
    a, b = order[:-1], order[1:]
    size = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + size, b + size
        inside = (i + (1 << k) <= n) & (j + (1 << k) <= n)
        same = inside & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])
        size += same << k
    return np.concatenate([[0], size])


def unique_runs(streams: list[list[str]], run: int = RUN, elsewhere: list[np.ndarray] | None = None) -> list[list[str]]:
    """Token streams without the runs of `run` tokens or more that two different streams share; equal ones count once."""
    return [[t for t, g in zip(s, gone.tolist()) if not g] for s, gone in zip(streams, shared_runs(streams, run, elsewhere))]


def shared_runs(streams: list[list[str]], run: int = RUN, elsewhere: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each token of each stream whether it is in a run of `run` tokens or more that another stream shares; equal ones count once.

    elsewhere: for each stream, where runs begin that streams not given here share."""
    keys = [tuple(s) for s in streams]
    distinct = list(dict.fromkeys(keys))
    numbers: dict[str, int] = {}
    tokens, owner = [], []
    for k, s in enumerate(distinct):
        tokens.extend(numbers.setdefault(t, len(numbers)) for t in s)
        owner.extend([k] * len(s))
        tokens.append(-1 - k)  # no run goes beyond a page
        owner.append(k)
    if not tokens:
        return [np.zeros(0, bool) for _ in streams]
    order, ranks = suffix_array(np.array(tokens, np.int64))
    lcp = common(order, ranks)
    group = np.cumsum(lcp < run)
    page = np.array(owner)[order]
    first = page[np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])]
    group -= group[0]
    mixed = np.zeros(group[-1] + 1, bool)
    mixed[group[page != first[group]]] = True
    at = order[mixed[group]]
    if elsewhere is not None:
        places = dict(zip(keys, elsewhere))
        starts = np.cumsum([0, *(len(s) + 1 for s in distinct)])
        at = np.unique(np.concatenate([at, *(places[s] + lo for s, lo in zip(distinct, starts))]))
    gone = np.zeros(len(tokens) + run + 1, np.int64)
    gone[at] += 1
    gone[at + run] -= 1
    gone = np.cumsum(gone)[: len(tokens)] > 0
    at_ = dict(zip(distinct, np.cumsum([0, *(len(s) + 1 for s in distinct)]).tolist()))
    return [gone[at_[k] : at_[k] + len(k)] for k in keys]


def run_hashes(texts: pa.Array | pa.ChunkedArray, seed: int) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its windows of RUN tokens, by where they begin."""
    data, offsets = text_buffers(texts)
    out: list[np.ndarray] = []
    for lo, hi in slices(offsets):
        words = Words(data, offsets, lo, hi, lower=False)
        hashes = mix(windows(words.hashes(), RUN) ^ np.uint64(seed % 2**64))
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            out.append(hashes[a : max(a, b - RUN + 1)])
    return out


def shared_elsewhere(parts: DataFrame) -> DataFrame:
    """(part, h): windows that one content of a part holds and that another content of the same host holds in another part.

    parts: part, host_key, content and text of each page. A part gives each of its windows once, without a content if several
    of its contents hold it; such windows it finds itself and does not ask for."""

    def run(group: pa.Table) -> pa.Table:
        part, content = group["part"][0].as_py(), group["content"].to_numpy()
        found = run_hashes(group["text"], group["host_key"][0].as_py())
        h = np.concatenate(found)
        c = np.repeat(content, [len(f) for f in found])
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(h))[: len(first)] - 1
        several = c[first] != c[last]
        return pa.table({"h": pa.array(h[first].view(np.int64)), "content": pa.array(c[first], mask=several), "part": pa.array(np.full(len(first), part))})

    held = parts.groupBy("part").applyInArrow(run, "h long, content long, part long")
    own = W.partitionBy("h")
    told = held.withColumn("other", (F.min("content").over(own) != F.max("content").over(own)) | (F.count("*").over(own) > F.count("content").over(own)))
    return told.filter("content is not null and other").select("part", "h")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))

    def parse(batches):
        for batch in batches:
            text, pieces, doubts, stream = [], [], [], []
            for html in batch.column(2).to_pylist():
                kept, open_ = article(html)
                sure = kept is not None and not any(d for d, _ in kept)
                text.append(" ".join(t for _, t in kept) if sure else None)
                pieces.append([] if sure or kept is None else [t for _, t in kept])
                doubts.append(None if sure or kept is None else [d for d, _ in kept])
                # what tells pages with different articles and the same furniture apart
                own = [] if kept is None or not open_ else ["\0" + hashlib.md5(" ".join(t for _, t in kept).encode("utf-8", "surrogatepass")).hexdigest()]
                stream.append(" ".join(open_ + own))
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(pieces, pa.list_(pa.string())), pa.array(doubts, pa.list_(pa.int32())), pa.array(stream, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "pieces", "doubts", "stream"])

    parsed = materialize(rows.mapInArrow(parse, "page_id long, url string, text string, pieces array<string>, doubts array<int>, stream string"), "parsed")
    told = parsed.filter("text is not null").select("page_id", "url", "text")

    # what is open on all pages, by host and shard
    open_ = parsed.filter("stream <> ''").select("page_id", "url", F.col("text").isNotNull().alias("told"), "pieces", "doubts", F.col("stream").alias("text"), host.alias("host"))
    shards = open_.groupBy("host").agg(F.expr(f"count(*) div {SHARD} + 1").alias("shards"))
    open_ = open_.join(shards, "host").withColumn("shard", F.pmod(F.xxhash64("url", "page_id"), "shards"))
    open_ = open_.select("page_id", "url", "told", "pieces", "doubts", "text", F.xxhash64("host").alias("host_key"), F.xxhash64("text").alias("content"), F.xxhash64("host", "shard").alias("part"), "shards")
    asked = shared_elsewhere(open_.filter("shards > 1").select("part", "host_key", "content", "text"))

    def compare(group: pa.Table, shared: pa.Table) -> pa.Table:
        elsewhere = None
        if len(shared):
            known = shared["h"].to_numpy().view(np.uint64)
            elsewhere = [np.flatnonzero(np.isin(h, known)) for h in run_hashes(group["text"], group["host_key"][0].as_py())]
        streams = [t.split(" ") for t in group["text"].to_pylist()]
        gone = shared_runs(streams, RUN, elsewhere)
        ask = np.flatnonzero(~group["told"].to_numpy(zero_copy_only=False))
        some, texts = group.take(pa.array(ask)), []
        for k, pieces, doubts in zip(ask.tolist(), some["pieces"].to_pylist(), some["doubts"].to_pylist()):
            if doubts is None:
                texts.append(" ".join(t for t, g in zip(streams[k], gone[k].tolist()) if not g))
                continue
            sizes = [t.count(" ") + 1 if d else 0 for t, d in zip(pieces, doubts)]
            owner = np.repeat(doubts, sizes)  # the elements in doubt stand first in the stream
            shared, total = np.bincount(owner, gone[k][: len(owner)], max(doubts) + 1), np.bincount(owner, minlength=max(doubts) + 1)
            texts.append(" ".join(t for t, d in zip(pieces, doubts) if not d or 2 * shared[d] < total[d]))
        return pa.table({"page_id": some["page_id"], "url": some["url"], "text": pa.array(texts, pa.string())})

    groups = open_.select("page_id", "url", "told", "pieces", "doubts", "text", "host_key", "part").groupBy("part")
    compared = groups.cogroup(asked.groupBy("part")).applyInArrow(compare, "page_id long, url string, text string")
    return told.unionByName(compared).withColumn("n_chars", F.length("text").cast("long"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
