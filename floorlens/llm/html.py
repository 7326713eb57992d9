"""Main text of web pages, by structure and by a suffix array of each host's pages.

A page is cut into blocks (runs of text between block-level tags), each in a zone: ``content`` inside
an article or main element, ``loose`` for text in it that no paragraph, heading, list item or table cell
holds, ``chrome`` inside a menu, header, footer, sidebar, notice, advert, form or comment section, else
``open``. Script, style and other unseen text is no block at all.

The host suffix array finds the runs of at least MIN_RUN tokens (or whole blocks) that stand on at least
two distinct pages of a host; pages of the same visible text are one page. It decides

* open blocks: they lose the tokens that such runs cover; what is left of them is kept;
* loose blocks: one that such runs cover wholly goes, unless the article is a copy, of whose characters
  at least half are in blocks that other pages have too.

Structure alone decides for content (kept) and chrome (dropped): articles and passages that are copied
within a host repeat like boilerplate, and whole articles are wanted.

A host's pages are dealt in groups of about GROUP tokens by a hash, each group being sorted in one task,
so no host is gathered whole. What repeats across groups is found by exact counts over all pages, summed
map-side: blocks by (host, block), and runs by (host, hash of MIN_RUN tokens in a row). A run of at least
MIN_RUN tokens is the union of its windows, so the windows that stand in two groups of a host, sent to
these groups, cover the same tokens as a suffix array of the whole host would.

Defined results: a null or empty html gives an empty text; a null url is a host of its own; tags that
are never closed end with their container or the page; repeated rows are pages of their own and get the
same text; an empty table gives no rows; other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import Scratch, materialise, skewed_left_join

CONTENT, LOOSE, CHROME, OPEN = "content", "loose", "chrome", "open"
#: Shortest repeated run in tokens, tokens of a host that share a task.
MIN_RUN, GROUP = 8, 1 << 16
#: Most hosts whose page counts are broadcast.
BROADCAST_HOSTS = 50_000

UNSEEN = {"script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "audio", "video", "head", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CHROME_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu"}
CONTENT_TAGS = {"article", "main"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
BLOCK_TAGS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose text is the article's own.
PROSE_TAGS = {"article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "th", "pre", "blockquote", "figcaption", "caption"}
#: Words that mark chrome wherever they stand in a class or id.
CHROME_WORDS = {
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "footer", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter",
    "subscribe", "signup", "login", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "comments", "commentlist", "disqus", "pagination", "pager", "toolbar",
}
#: Words that mark chrome alone or beside a word for its place or box, as in "ad-slot" or "site-header".
CHROME_NAMES = {"ad", "ads", "banner", "promo", "notice", "share", "sharing", "social", "comment", "reply", "replies", "respond", "related", "recommended", "widget", "aside", "skip", "masthead", "header", "side"}
BOX_WORDS = {
    "site", "page", "top", "bottom", "left", "right", "global", "main", "box", "bar", "block", "area", "container", "wrapper", "wrap", "section", "slot", "unit", "column", "col", "panel",
    "link", "links", "button", "buttons", "icon", "icons", "list", "item", "items", "form", "thread", "posts", "articles", "stories", "content", "tools", "inner", "outer",
}
#: First words of names that tell of a state, as in "has-sidebar".
STATE_WORDS = {"has", "no", "with", "without", "is", "hide", "show", "not"}
_NAME_CUT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def chrome_name(names: str, inside: bool) -> bool:
    """Whether one of the names of a class or id attribute marks chrome.

    inside: the element is part of an article, where a name such as menu-recipe may tell of its subject: there all
    words of the name must be chrome's or tell of a box.
    """
    for name in names.split():
        words = [w.lower() for w in _NAME_CUT.split(name) if w]
        if not words or words[0] in STATE_WORDS:
            continue
        if any(w in CHROME_WORDS for w in words) and (not inside or all(w in CHROME_WORDS or w in CHROME_NAMES or w in BOX_WORDS for w in words)):
            return True
        marks = [w for w in words if w in CHROME_NAMES and not (inside and w in ("header", "banner"))]
        if marks and all(w in CHROME_NAMES or w in BOX_WORDS for w in words) and len(words) < 4:
            return True
    return False


#: Elements that end when one of the same kind begins in the same container.
SELF_CLOSING = {"p": "p", "li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "t", "th": "t", "option": "option"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+))""")


_UNDISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)


def _zone(tag: str, attributes: str, zone: str) -> str:
    if zone == CHROME:
        return CHROME
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    roles = found.get("role", "").lower().split()
    if tag in CHROME_TAGS or any(r in CHROME_ROLES for r in roles) or "hidden" in attributes.lower().split() or _UNDISPLAYED.search(found.get("style", "")):
        # A heading group of the article itself is part of the article.
        return CHROME if not (tag == "header" and zone == CONTENT) else zone
    if tag in ("html", "body", "article", "main"):
        return CONTENT if tag in CONTENT_TAGS else zone
    if chrome_name(found.get("class", ""), zone == CONTENT) or chrome_name(found.get("id", ""), zone == CONTENT):
        return CHROME
    return CONTENT if "main" in roles or "article" in roles else zone


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of a page's blocks in order; white space is one space, ends are trimmed."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str, bool]] = [("", OPEN, True)]  # tag, zone, seen

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                zone = stack[-1][1]
                if zone == CONTENT and next((t for t, *_ in reversed(stack) if t in BLOCK_TAGS), "article") not in PROSE_TAGS:
                    zone = LOOSE
                out.append((zone, joined))

    if not page:
        return out
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and stack[-1][2]:
            text.append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and stack[-1][2]:
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        if tag in BLOCK_TAGS or tag in UNSEEN:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if any(stack[j][1] != stack[k - 1][1] for j in range(k, len(stack))):
                        flush()
                    del stack[k:]
                    break
                if tag in SELF_CLOSING and stack[k][0] in ("article", "main", "div", "section", "table", "ul", "ol", "nav", "body"):
                    break
            continue
        if tag in VOID:
            continue
        if tag in SELF_CLOSING:
            for k in range(len(stack) - 1, 0, -1):
                if SELF_CLOSING.get(stack[k][0]) == SELF_CLOSING[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK_TAGS:
                    break
        elif tag in BLOCK_TAGS:
            # A block-level element ends an open paragraph.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK_TAGS:
                    break
        if tag in UNSEEN:
            if m[0].endswith("/>"):
                continue
            if tag in ("script", "style", "title", "iframe", "noscript", "template"):
                end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if tag == "head":
                stack.append((tag, stack[-1][1], False))
                continue
        if tag == "body" and stack[-1][0] == "head":
            stack.pop()
        zone = _zone(tag, m[3] or "", stack[-1][1])
        if zone != stack[-1][1]:
            flush()
        stack.append((tag, zone, stack[-1][2] and tag not in UNSEEN))
    flush()
    return out


# ------------------------------------------------------- suffix arrays


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of an integer array in order, by prefix doubling, and the lengths that neighbours share.

    The ranks of every doubling are kept: two suffixes share 2**k tokens if they have one rank in round
    k, so that lengths take a step for each round, not for each token.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    ranks, step, order = [rank], 1, np.argsort(rank, kind="stable")
    while n > 1:
        second = np.full(n, -1, np.int32)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(n, np.int32)
        rank[order] = new
        if new[-1] == n - 1:
            break
        ranks.append(rank)
        step *= 2
    shared = np.zeros(n, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for k in reversed(range(len(ranks))):
        most = n - (1 << k)
        ok = (left <= most) & (right <= most)
        # A suffix shorter than a round's step has a rank of its own there, so equal ranks are equal tokens.
        ok[ok] = ranks[k][left[ok]] == ranks[k][right[ok]]
        at = np.flatnonzero(ok)
        left[at] += 1 << k
        right[at] += 1 << k
        shared[at + 1] += 1 << k
    return order, shared


def repeated(ids: np.ndarray, page: np.ndarray, least: int = MIN_RUN) -> np.ndarray:
    """Which tokens lie in a run of at least ``least`` tokens that stands on at least two pages.

    ids must hold a value of its own at the end of each block, so that no run leaves its block.
    """
    n = len(ids)
    covered = np.zeros(n + 1, np.int64)
    if n < 2:
        return covered[:n] > 0
    order, shared = suffix_array(ids)
    # A suffix's longest run shared with another page: with the nearest suffix of another page before
    # it and after it. Between suffixes of one page the shared length can only fall.
    best, on = np.zeros(n, np.int64), page[order].tolist()
    link, places = shared.tolist(), order.tolist()
    for ahead in (True, False):
        low = 0
        for k in range(1, n) if ahead else range(n - 2, -1, -1):
            before, both = (k - 1, link[k]) if ahead else (k + 1, link[k + 1])
            low = both if on[before] != on[k] else min(low, both)
            if low >= least and low > best[places[k]]:
                best[places[k]] = low
    hit = np.flatnonzero(best)
    np.add.at(covered, hit, 1)
    np.add.at(covered, np.minimum(hit + best[hit], n), -1)
    return np.cumsum(covered[:n]) > 0


# ---------------------------------------------------------------- Spark

_KIND = pa.list_(pa.struct([("place", pa.int32()), ("zone", pa.string()), ("text", pa.string())]))
_BLOCKS = "array<struct<place:int,zone:string,text:string>>"


def outside(found: list[tuple[str, str]]) -> list[dict]:
    """The blocks that a page's host may decide or that tell of it: all but content, and that too if some text is loose."""
    loose = any(z == LOOSE for z, _ in found)
    return [{"place": i, "zone": z, "text": t} for i, (z, t) in enumerate(found) if z != CONTENT or loose]


def _parse_outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, html, by a digest of the page's visible text, the tokens and the blocks outside articles."""
    for batch in batches:
        found = [blocks(h.as_py()) for h in batch.columns[-1]]
        digest = [blake2b("\n".join(t for _, t in page).encode("utf-8", "surrogatepass"), digest_size=16).digest() for page in found]
        kept = [outside(page) for page in found]
        tokens = [sum(1 + b["text"].count(" ") for b in page) for page in kept]
        columns = [pa.array(digest, pa.binary()), pa.array(tokens, pa.int64()), pa.array(kept, _KIND)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "page", "tokens", "blocks"])


def _parse_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, html, by the text of a page that has content and chrome only, or else by all blocks but chrome."""
    for batch in batches:
        found = [[(i, z, t) for i, (z, t) in enumerate(blocks(h.as_py())) if z != CHROME] for h in batch.columns[-1]]
        sure = [all(z == CONTENT for _, z, _ in page) for page in found]
        text = pa.array(["\n".join(t for *_, t in page) if s else None for page, s in zip(found, sure, strict=True)], pa.string())
        kept = pa.array([None if s else [dict(zip(("place", "zone", "text"), b, strict=True)) for b in page] for page, s in zip(found, sure, strict=True)], _KIND)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text, kept], names=[*batch.schema.names[:-1], "whole", "blocks"])


def token_windows(texts: pa.Array, least: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``least`` tokens that lie in one block, with the place of their first token
    among all blocks' tokens, and the numbers of tokens of each block."""
    raw, offsets = tk.string_buffers(texts)
    # Blocks are joined by spaces; other white space was replaced when they were cut.
    starts, ends, owner = tk.word_spans(raw, offsets)
    words, n = tk.span_hashes(raw, starts, ends), max(len(starts) - least + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(least):
        rolled = tk.mix64(rolled * np.uint64(0xD1342543DE82EF95) + words[k : k + n] + np.uint64(1))
    at = np.flatnonzero(owner[:n] == owner[least - 1 :][:n])
    return rolled[at].view(np.int64), at, tk.counts_of(owner, len(offsets) - 1)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, group, window) of the pages (host, group, blocks), each once in a batch and host's group."""
    for batch in batches:
        listed = batch.column(2)
        window, at, size = token_windows(listed.flatten().field("text"))
        page = np.repeat(np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy())), size)[at]
        rows = pa.table({"host": batch.column(0).take(pa.array(page)), "group": batch.column(1).take(pa.array(page)), "window": window})
        yield from rows.group_by(["host", "group", "window"]).aggregate([]).to_batches()


def cover(streams: list[list[tuple[int, str, str]]], least: int = MIN_RUN, elsewhere: np.ndarray | None = None) -> list[tuple[int, dict[int, str]]]:
    """For each page of a group, given its blocks (place, zone, text) outside articles: how many tokens
    are covered by runs that other pages have too, and the open blocks' texts without them.

    elsewhere: hashes of windows that stand on pages of other groups.
    """
    words = [[t.split(" ") for _, _, t in page] for page in streams]
    flat = [w for page in words for block in page for w in (*block, None)]
    number: dict[str, int] = {}
    ids = np.array([-1 - i if w is None else number.setdefault(w, len(number)) for i, w in enumerate(flat)], np.int64)
    owner = np.repeat(np.arange(len(streams)), [sum(len(b) + 1 for b in page) for page in words])
    found = repeated(ids, owner, least)
    if elsewhere is not None and len(elsewhere):
        window, place, size = token_windows(pa.array([t for page in streams for _, _, t in page], pa.string()), least)
        block = np.repeat(np.arange(len(size)), size)
        # A block ends with a value of its own in ``ids``.
        place = place[np.isin(window, elsewhere)]
        place = place + block[place]
        for k in range(least):
            found[place + k] = True
    hit = found.tolist()
    out, at = [], 0
    for page, parts in zip(streams, words, strict=True):
        total, kept = 0, {}
        for (place, zone, _), block in zip(page, parts, strict=True):
            marks = hit[at : at + len(block)]
            at += len(block) + 1
            total += sum(marks)
            if (zone == OPEN and any(marks)) or (zone == LOOSE and all(marks)):
                kept[place] = " ".join(w for w, m in zip(block, marks, strict=True) if not m)
        out.append((total, kept))
    return out


_COVER = "host string, page binary, n_covered long, left map<int,string>"


def _cover_group(key: tuple, group: pa.Table, windows: pa.Table) -> pa.Table:
    streams = [[(b["place"], b["zone"], b["text"]) for b in page if b["zone"] != CONTENT] for page in group.column("blocks").to_pylist()]
    found = cover(streams, elsewhere=windows.column("window").to_numpy())
    maps = pa.array([list(kept.items()) for _, kept in found], pa.map_(pa.int32(), pa.string()))
    return pa.table({"host": pa.array([key[0].as_py()] * len(found), pa.string()), "page": group.column("page"), "n_covered": pa.array([n for n, _ in found], pa.int64()), "left": maps})


def decisions(held: DataFrame) -> DataFrame:
    """What the hosts decide, for every row of ``held`` (page_id, hash, host, html) with something outside its article.

    page_id, hash, n_covered, left (what is left of blocks, by place), dropped (places of open blocks that
    repeat whole) and copied (whether the article is a copy); all but the first two are null where the host
    has no other page.
    """
    parsed = held.select("page_id", "hash", "host", "html").mapInArrow(tk.freeing(_parse_outside), f"page_id long, hash long, host string, page binary, tokens long, blocks {_BLOCKS}")
    parsed = materialise(parsed.where(F.size("blocks") > 0), "html-outside")
    own = parsed.groupBy("host", "page").agg(F.count(F.lit(1)).alias("__rows"), F.first("tokens").alias("tokens"), F.first("blocks").alias("blocks"))
    own = materialise(own, "html-pages")
    hosts = own.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("tokens") / GROUP).alias("groups"), F.count(F.lit(1)).alias("__rows")).where("n > 1")
    hosts = materialise(hosts, "html-hosts")
    streams = skewed_left_join(own, hosts, ["host"], broadcast_rows=BROADCAST_HOSTS).where(F.col("n").isNotNull())
    streams = streams.withColumn("group", F.pmod(F.xxhash64("page"), F.col("groups")))
    # Hosts of one group need no count across groups.
    seen = streams.where(F.col("groups") > 1).select("host", "group", F.filter("blocks", lambda b: b["zone"] != CONTENT).alias("blocks"))
    kind = "host string, group long, window long"
    if hosts.where("groups > 1").isEmpty():
        wide = held.sparkSession.createDataFrame([], kind)
    else:
        spread = materialise(seen.mapInArrow(tk.freeing(_windows), kind).distinct(), "html-windows")
        # A run of a large host may stand in all its groups: only the least and the largest are gathered for it.
        ends = spread.groupBy("host", "window").agg(F.min("group").alias("a"), F.max("group").alias("z"), F.count(F.lit(1)).alias("__rows")).where("a < z")
        several = materialise(ends.select("host", "window", "__rows", F.lit(True).alias("several")), "html-several")
        wide = skewed_left_join(spread, several, ["host", "window"]).where("several").select("host", "group", "window")
    covered = materialise(streams.groupBy("host", "group").cogroup(wide.groupBy("host", "group")).applyInArrow(_cover_group, _COVER), "html-covered")

    single = own.select("host", "page", F.explode("blocks").alias("b")).where(F.col("b.zone") != CHROME)
    single = materialise(single.select("host", "page", F.col("b.place").alias("place"), F.col("b.zone").alias("zone"), F.length("b.text").alias("size"), F.md5(F.col("b.text").cast("binary")).alias("block")), "html-blocks")
    twice = single.groupBy("host", "block").agg(F.min("page").alias("a"), F.max("page").alias("z"), F.count(F.lit(1)).alias("__rows")).where("a < z").select("host", "block", "__rows", F.lit(True).alias("again"))
    told = skewed_left_join(single, materialise(twice, "html-twice"), ["host", "block"]).withColumn("again", F.coalesce("again", F.lit(False)))
    inside = F.col("zone").isin(CONTENT, LOOSE)
    told = told.groupBy("host", "page").agg(
        F.array_compact(F.collect_set(F.when(F.col("again") & (F.col("zone") == OPEN), F.col("place")))).alias("dropped"),
        (2 * F.sum(F.when(inside & F.col("again"), F.col("size")).otherwise(0)) >= F.sum(F.when(inside, F.col("size")).otherwise(0))).alias("copied"),
    )
    found = covered.join(told, ["host", "page"], "left").join(own.select("host", "page", "__rows"), ["host", "page"])
    rows = skewed_left_join(parsed.select("page_id", "hash", "host", "page"), materialise(found, "html-found"), ["host", "page"])
    return rows.select("page_id", "hash", "n_covered", "left", "dropped", "copied")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_covered (tokens outside articles that repeat on the host) of every page.

    Pages are parsed twice, once for what stands outside articles and once for the texts, which costs
    less than to store or shuffle all blocks. Rows are told apart by page_id, url and html.
    """
    url, page = F.coalesce("url", F.lit("")), F.col("html").cast("string")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    held = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), F.xxhash64(url, page, F.md5(F.coalesce(page, F.lit("")).cast("binary"))).alias("hash"), page.alias("html"))
    with Scratch(pages.sparkSession) as scratch:
        found = decisions(held).dropDuplicates(["page_id", "hash"])
        found = materialise(found.select(F.col("page_id").alias("p"), F.col("hash").alias("h"), "n_covered", "left", "dropped", "copied"), "html-decisions")
        scratch.keep(found)

    def kept(b):
        left = F.try_element_at("left", b["place"])
        gone = F.coalesce(F.array_contains("dropped", b["place"]), F.lit(False))
        boilerplate = F.coalesce(left == "", F.lit(False)) & ~F.coalesce("copied", F.lit(False))
        return F.when(b["zone"] == CONTENT, b["text"]).when(b["zone"] == LOOSE, F.when(~boilerplate, b["text"])).when(~gone, F.coalesce(left, b["text"]))

    texts = held.select("page_id", "url", "hash", "html").mapInArrow(tk.freeing(_parse_texts), f"page_id long, url string, hash long, whole string, blocks {_BLOCKS}")
    # Always by a shuffle, as a large table needs it: the decisions grow with the pages.
    joined = texts.join(found.hint("merge"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("hash") == F.col("h")), "left")
    text = F.array_join(F.filter(F.transform("blocks", kept), lambda t: F.coalesce(t != "", F.lit(False))), "\n")
    return joined.select("page_id", "url", F.coalesce("whole", text).alias("text"), F.coalesce("n_covered", F.lit(0)).alias("n_covered"))
