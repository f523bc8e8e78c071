"""Main text of web pages: what the structure marks, without what the pages of the host repeat."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slot_filter, slot_of, slot_test, table

#: Tokens of the shortest repeat that counts.
MIN_TOKENS = 8
#: Share of the host's pages that a repeat must be found on, and the least number of pages: for text that the structure marks as
#: the page's article, where only what lies outside articles counts as found, and for text that it leaves open.
MAIN_SHARE, MAIN_PAGES = 0.5, 10
OPEN_SHARE, OPEN_PAGES = 0.2, 2
#: Tokens of a repeat that counts in open text wherever OPEN_PAGES pages of the host have it.
LONG_TOKENS = 25
#: Pages whose streams share one suffix array; larger hosts are dealt into several, which exchange what they find.
CHUNK_PAGES = 400
#: Words whose hashes a task remembers, about 30 MB.
WORDS = 200_000

# Fixed values of HTML.
_RAW = frozenset("script style noscript template textarea title iframe svg canvas xmp annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CHROME = frozenset("nav header footer aside form button select menu dialog search head fieldset".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification sidebar side-bar nav navbar navigation menu breadcrumb breadcrumbs footer header comment comments commentlist disqus respond replies share sharing social related recommended subscribe newsletter signup login popup modal overlay pagination pager toolbar widget".split()
)
#: Words that leave a name what it is: cookie-notice-box is a notice, notice-board-history is not.
_PLAIN_NAMES = frozenset("site page main top bottom left right global primary secondary mobile desktop box bar container wrapper wrap block section area inner outer list link links item items form button buttons icons posts post user reader slot unit content".split())
#: Names that say too little within an article, where a header may be a section's and a share one of votes; there they need a second such name or
#: one of the words after them.
_WEAK_NAMES = frozenset("header footer banner notice notices notification share sharing social related recommended subscribe widget promotion comment".split())
_FURNITURE = frozenset("site global bar buttons icons links".split())
#: A tag without < in it, the usual case; it stops at the next <, so what it can't read costs no more than that.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"'=]|=\s*+(?:"[^"<]*"|'[^'<]*'|[^\s<>"'][^\s<>]*+)?)*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR_NAME = re.compile(r"[\s/]*+(>|=?[^\s/>=]*+)(\s*+=\s*+)?")
_UNQUOTED = re.compile(r"[^\s>]*+")
_ATTR = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPLIT = re.compile(r"[\s_-]+")


def tag_end(html: str, at: int) -> int:
    """Where the tag's attributes that start at `at` end: the place of its >, or -1 if the page ends within the tag. A quote that is
    never closed ends at the next >. Every search goes on from where the last one ended."""
    while True:
        m = _ATTR_NAME.match(html, at)
        if m[1] == ">":
            return m.end(1) - 1
        at = m.end()
        if at >= len(html):
            return -1
        if m[2]:
            quote = html[at]
            if quote in "\"'":
                close = html.find(quote, at + 1)
                if close < 0:
                    return html.find(">", at + 1)
                at = close + 1
            else:
                at = _UNQUOTED.match(html, at).end()
        elif m.end() == m.start():
            return -1


def tags(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, closing) of the page's tags in order, in time linear in its length; the name is empty for comments
    and the like. The caller may send() where to go on. A tag within which the page ends takes the rest."""
    at = 0
    while (at := html.find("<", at)) >= 0:
        follows = html[at + 1 : at + 2]
        name, attrs, closing = "", "", False
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
        elif follows in ("!", "?"):
            end = html.find(">", at)
            end = len(html) if end < 0 else end + 1
        elif m := _TAG.match(html, at):
            end, closing, name, attrs = m.end(), bool(m[1]), m[2].lower(), m[3]
        elif m := _NAME.match(html, at + 1 + (follows == "/")):
            close = tag_end(html, m.end())
            end, closing, name = (len(html), follows == "/", "") if close < 0 else (close + 1, follows == "/", m[0].lower())
            attrs = html[m.end() : close] if close >= 0 else ""
        else:
            at += 1
            continue
        on = yield at, end, name, attrs, closing
        at = end if on is None else on
        if on is not None:
            yield  # answers the send()


def _named(name: str, apart: frozenset[str], within: bool = False) -> bool:
    """Whether a class or id is that of page furniture: one of the names, or several words that are names or say nothing. Within an article a weak
    name alone isn't enough."""
    parts = [x for x in _SPLIT.split(name) if x]
    if name not in apart and not (any(x in apart for x in parts) and all(x in apart or x in _PLAIN_NAMES for x in parts)):
        return False
    strong = [x for x in (parts if name not in apart else [name]) if x in apart and x not in _WEAK_NAMES]
    return not within or bool(strong) or len([x for x in parts if x in apart or x in _FURNITURE]) >= 2


def _chrome(tag: str, attrs: str, within: bool = False) -> bool:
    if tag in _CHROME:
        return True
    if not attrs.strip() or tag in ("html", "body"):
        return False
    found = {k.lower(): unescape((v or "").strip("\"'")) for k, v in _ATTR.findall(attrs)}
    if found.get("role", "").lower() in _CHROME_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    names = (found.get("class", "") + " " + found.get("id", "")).lower().split()
    if tag == "main":
        return False
    return any(_named(x, _COMMENTS, False) if tag == "article" else _named(x, _CHROME_NAMES, within) for x in names)


_COMMENTS = frozenset(["comment", "comments"])
#: Elements that end at an article within them, where a page has no other: they weren't closed.
_UNCLOSED = frozenset("div section p span form nav header aside footer".split())


def blocks(html: str, lenient: bool = False) -> list[tuple[str, int, float]]:
    """(text, depth, linked) of the page's blocks in order. depth: 2 in an article, 1 in a main element, -1 in what is chrome by its
    element, role, class or id, else 0. linked: the share of characters within links.

    Character references are decoded, white space is one space, blocks end where a block element starts or ends. A main element that
    starts within chrome ends that chrome, as it wasn't closed; so does an article (but a reader comment) in an element that is
    chrome by its class or id, and if lenient in any.
    """
    out: list[tuple[str, int, float]] = []
    stack: list[tuple[str, bool]] = []
    chrome_at: list[int] = []
    parts: list[str] = []
    aside: list[str] = []
    skip = depth_article = depth_main = links = linked = at = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, 2 if depth_article else 1 if depth_main else 0, min(1.0, linked / len(text))))
            parts.clear()
            linked = 0
        if aside:
            text = " ".join("".join(aside).split())
            if text:
                out.append((text, -1, 0.0))
            aside.clear()

    def pop_to(k: int) -> None:
        nonlocal skip, depth_article, depth_main, links
        while len(stack) > k:
            tag, chrome = stack.pop()
            if chrome:
                chrome_at.pop()
            skip -= chrome
            depth_article -= tag == "article"
            depth_main -= tag == "main"
            links -= tag == "a"

    def text(upto: int) -> None:
        nonlocal linked
        if upto > at:
            s = unescape(html[at:upto])
            (aside if skip else parts).append(s)
            if links and not skip:
                linked += len(s.strip())

    found = tags(html)
    opened: dict[str, int] = {}
    for start, end, tag, attrs, closing in found:
        text(start)
        at = end
        if not tag:
            continue
        if tag in _BLOCK:
            close()
        elif tag == "br":
            (aside if skip else parts).append("\n")
        if closing:
            if opened.get(tag):  # else a search through the whole stack for each stray end tag
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
                for x, _ in stack[k:]:
                    opened[x] -= 1
                pop_to(k)
        elif tag in _RAW:
            if not attrs.rstrip().endswith("/"):
                raw = _RAW_END[tag].search(html, at)
                at = raw.start() if raw else len(html)
                found.send(at)
        elif tag not in _VOID:
            chrome = _chrome(tag, attrs, depth_article > 0)
            if tag in ("article", "main") and not chrome and skip:
                k = chrome_at[0]
                if tag == "main" or (lenient and stack[k][0] in _UNCLOSED) or stack[k][0] not in _CHROME:
                    for x, _ in stack[k:]:
                        opened[x] -= 1
                    pop_to(k)
            if not attrs.rstrip().endswith("/") or tag in _BLOCK:
                if chrome:
                    chrome_at.append(len(stack))
                stack.append((tag, chrome))
                opened[tag] = opened.get(tag, 0) + 1
                skip += chrome
                depth_article += tag == "article"
                depth_main += tag == "main"
                links += tag == "a"
    text(len(html))
    close()
    return out


_RAW_END = {tag: re.compile(rf"</{tag}[\s>/]", re.I) for tag in _RAW}


def page_blocks(html: str | None) -> tuple[bool, list[tuple[str, bool]]]:
    """Whether the structure marks a main text, and the blocks of the page with whether the structure would keep each: what is in articles and
    main elements, of the latter beside an article only what isn't mostly links; without any, what isn't chrome nor mostly links."""
    found = blocks(html or "")
    if html and not any(d == 2 for _, d, _ in found) and "<article" in html.lower():
        again = blocks(html, lenient=True)
        found = again if any(d == 2 for _, d, _ in again) else found
    main, article = any(d > 0 for _, d, _ in found), any(d == 2 for _, d, _ in found)
    keep = lambda d, linked: d == 2 or (d == 1 and (not article or linked < 0.5)) if main else d == 0 and linked < 0.5
    return main, [(t, keep(d, linked)) for t, d, linked in found]


def main_text(html: str | None) -> str | None:
    """The text of the page's articles and main elements by structure alone; None if it has neither."""
    main, found = page_blocks(html)
    return "\n\n".join(t for t, k in found if k) if main else None


def suffix_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first `length` tokens: the suffix array's order, built by doubling prefixes until they are that
    long. Suffixes with equal ranks share that prefix, and stand side by side in the array."""
    rank, have = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while have < length:
        step = min(have, length - have)
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-step] = rank[step:]
        rank, have = np.unique(rank * (len(rank) + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64), have + step
    return rank


def numbered(streams: list[list[str]]) -> list[np.ndarray]:
    """The streams with a number for each word."""
    words: dict[str, int] = {}
    return [np.fromiter((words.setdefault(w, len(words)) for w in s), np.int64, len(s)) for s in streams]


def page_counts(streams: list[np.ndarray], n: int, outside: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each page's stream (of numbers from 0), on how many of the pages each substring of n tokens that starts there is found (0 where
    the stream ends before); with `outside`, found among the tokens that it marks. One suffix array over the streams, each ended by a token of its own."""
    size = np.fromiter((len(s) + 1 for s in streams), np.int64, len(streams))
    page = np.repeat(np.arange(len(streams)), size)
    ends = np.cumsum(size) - 1
    tokens = np.concatenate([x for p, s in enumerate(streams) for x in (s.astype(np.int64), [-1 - p])]) if len(streams) else np.zeros(0, np.int64)
    counts = np.zeros(len(tokens), np.int64)
    whole = np.arange(len(tokens)) + n <= ends[page] if len(streams) else np.zeros(0, bool)
    if whole.any():
        rank = suffix_ranks(tokens, n)[whole]
        found = np.concatenate([x for o in outside for x in (starts_in(o, n), [False])])[whole] if outside is not None else slice(None)
        pairs = np.unique((rank * len(streams) + page[whole])[found])
        counts[whole] = np.bincount(pairs // len(streams), minlength=int(rank.max()) + 1)[rank]
    return [counts[a:b] for a, b in zip(np.concatenate([[0], ends[:-1] + 1]), ends, strict=True)] if len(streams) else []


def starts_in(marked: np.ndarray, n: int) -> np.ndarray:
    """Where substrings of n tokens start that are all marked."""
    out = np.zeros(len(marked), bool)
    if len(marked) >= n:
        gaps = np.concatenate([[0], np.cumsum(~marked)])
        out[: len(marked) - n + 1] = gaps[n:] == gaps[:-n]
    return out


def outside_articles(main: bool, texts: list[str], keep: list[bool]) -> np.ndarray:
    """Which of a page's tokens aren't in what its structure marks as the article."""
    size = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
    return ~(np.repeat(np.array(keep, bool), size) & main)


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which tokens lie in a substring of n that starts at one of those marked."""
    edge = np.zeros(len(starts) + 1, np.int64)
    edge[:-1] += starts
    at = np.flatnonzero(starts) + n
    np.subtract.at(edge, at, 1)
    return np.cumsum(edge)[:-1] > 0


def least_pages(pages: int, main: bool) -> int:
    """Pages of a host of so many that a repeat of MIN_TOKENS must be found on."""
    share, least = (MAIN_SHARE, MAIN_PAGES) if main else (OPEN_SHARE, OPEN_PAGES)
    return max(least, ceil(pages * share))


def tokens_of(texts: list[str]) -> list[str]:
    return [w for t in texts for w in t.split(" ")]


def unique_text(texts: list[str], keep: list[bool], hit: np.ndarray) -> str:
    """The blocks that are kept, without the tokens that are hit. A page all of whose kept tokens are hit keeps them: copies of a page
    aren't boilerplate."""
    size = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
    if not (~hit & np.repeat(np.array(keep, bool), size)).any():
        return "\n\n".join(t for t, k in zip(texts, keep, strict=True) if k)
    kept, at = [], 0
    for t, k, n in zip(texts, keep, size.tolist(), strict=True):
        if k and not hit[at : at + n].any():
            kept.append(t)
        elif k and not hit[at : at + n].all():
            kept.append(" ".join(w for w, h in zip(t.split(" "), hit[at : at + n], strict=True) if not h))
        at += n
    return "\n\n".join(kept)


def unique_runs(pages: list[tuple[bool, list[str], list[bool]]]) -> list[str]:
    """The texts of all of a host's pages, given as (main, texts of the blocks, which of them the structure keeps)."""
    streams = numbered([tokens_of(texts) for _, texts, _ in pages])
    beside, out = page_counts(streams, MIN_TOKENS, [outside_articles(*p) for p in pages]), []
    some_open = not all(main for main, _, _ in pages)
    short, long = (page_counts(streams, n) if some_open else beside for n in (MIN_TOKENS, LONG_TOKENS))
    for (main, texts, keep), a, b, c in zip(pages, short, long, beside, strict=True):
        hit = covered((c if main else a) >= least_pages(len(pages), main), MIN_TOKENS)
        out.append(unique_text(texts, keep, hit if main else hit | covered(b >= OPEN_PAGES, LONG_TOKENS)))
    return out


def hashes(tokens: list[str], seen: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each token; seen remembers them."""
    if len(seen) > WORDS:
        seen.clear()
    ids = list(map(seen.get, tokens))
    if None in ids:
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = seen[tokens[i]] = xxhash.xxh3_64_intdigest(tokens[i].encode("utf-8", "replace"))
    return np.array(ids, np.uint64)


def codes(tokens: list[str], seen: dict[str, int]) -> np.ndarray:
    """16 bits of each token's hash. Tokens that share them make a candidate of what is none, which the count then drops."""
    return hashes(tokens, seen).astype("<u2")


def windows(each: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n of the hashes in a row. They are compared within a host only."""
    each, m = each.astype(np.uint64), max(0, len(each) - n + 1)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[j : j + m]
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _rows(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in names), strict=True)


def small_hosts(pages: DataFrame, kind: str) -> DataFrame:
    """The texts of pages of hosts of one chunk: a host after the other streams by, and is one suffix array."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, held = None, []

        def settle() -> list[tuple]:
            texts = unique_runs([p[2:] for p in held])
            out = [(p[0], p[1], t) for p, t in zip(held, texts, strict=True)]
            held.clear()
            return out

        def batch(found: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((like.column("_id").type, pa.string(), pa.string()))], ["_id", "_url", "text"])

        for b in batches:
            found = []
            for h, *page in _rows(b, "_host", "_id", "_url", "_main", "_texts", "_keep"):
                if h != host:
                    found += settle()
                    host = h
                held.append(page)
            yield batch(found, b)
        if held:
            yield batch(settle(), b)

    return pages.repartition("_host").sortWithinPartitions("_host").select("_host", "_id", "_url", "_main", "_texts", "_keep").mapInArrow(read, f"_id {kind}, _url string, text string")


def large_hosts(pages: DataFrame, kind: str, scratch: Scratch) -> DataFrame:
    """As small_hosts, of rows with _pages (the host's) and _chunk, to the same texts, however a host is dealt into chunks.

    What is found on a share of the host's pages is found on that share of some chunk's, so each chunk's suffix array gives the
    candidates: at most the chunk's tokens per page, over the share. Chunks get two bytes a token, which is enough for that. The
    candidates are exchanged by hash, counted over the host's pages by the tokens' full hashes, and those on enough pages come
    back to every page. Long repeats on any two pages, of which one is open, are counted by the hashes of the windows of all pages of hosts that have open ones.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            out = [codes(tokens_of(t), seen).tobytes() for t in b.column("_texts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_host"), b.column("_chunk"), pa.array(out, pa.binary())], ["_host", "_chunk", "_codes"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def settle() -> pa.RecordBatch:
            streams = [np.frombuffer(x, "<u2") for x in held]
            least, found = ceil(len(held) * OPEN_SHARE), set()
            for s, n in zip(streams, page_counts(streams, MIN_TOKENS), strict=True):
                if (n >= least).any():
                    h = windows(s, MIN_TOKENS)
                    found.update(h[n[: len(h)] >= least].tolist())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.string()), pa.array(list(found), pa.int64())], ["_host", "h"])

        for b in batches:
            for h, c, x in _rows(b, "_host", "_chunk", "_codes"):
                if (h, c) != key:
                    if held:
                        yield settle()
                    key = (h, c)
                held.append(x)
        if held:
            yield settle()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            found: dict[tuple[str, int], list[int]] = {}
            for h, main, texts, keep, candidates in _rows(b, "_host", "_main", "_texts", "_keep", "_hashes"):
                each = hashes(tokens_of(texts), seen)
                asked = np.isin(windows(each.astype("<u2"), MIN_TOKENS), np.array(candidates, np.int64))
                each, beside = windows(each, MIN_TOKENS), starts_in(outside_articles(main, texts, keep), MIN_TOKENS)[: len(asked)]
                for x in np.unique(each[asked]).tolist():
                    found.setdefault((h, x), [0, 0])[0] += 1
                for x in np.unique(each[asked & beside]).tolist():
                    found[h, x][1] += 1
            on = [pa.array([n[k] for n in found.values()], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64()), *on], ["_host", "h", "on", "beside"])

    def cut_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            for row, h, main, texts in _rows(b, "_row", "_host", "_main", "_texts"):
                found = windows(hashes(tokens_of(texts), seen), LONG_TOKENS)
                once = np.unique(found, return_index=True)[1]
                at = np.sort(once) if main else np.arange(len(found))  # nothing long goes from an article's page, so where it has it again doesn't matter
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array([h] * len(at), pa.string()), pa.array(found[at]), pa.array(np.isin(at, once)), pa.array(np.full(len(at), main))], ["_row", "_at", "_host", "h", "_first", "_main"])

    def settle_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            out = []
            for main, total, texts, keep, often, on, beside, long in _rows(b, "_main", "_pages", "_texts", "_keep", "_hashes", "_on", "_beside", "_long"):
                tokens = tokens_of(texts)
                starts = np.zeros(len(tokens), bool)
                if often:
                    h = windows(hashes(tokens, seen), MIN_TOKENS)
                    starts[: len(h)] = np.isin(h, np.array(often, np.int64)[np.array(beside if main else on, np.int64) >= least_pages(total, main)])
                hit = covered(starts, MIN_TOKENS)
                if long and not main:
                    starts = np.zeros(len(tokens), bool)
                    starts[np.array(long, np.int64)] = True
                    hit |= covered(starts, LONG_TOKENS)
                out.append(unique_text(texts, keep, hit))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_url"), pa.array(out, pa.string())], ["_id", "_url", "text"])

    deal = ["_host", "_chunk"]
    proposed = scratch.write(pages.select(*deal, "_texts").mapInArrow(encode, "_host string, _chunk int, _codes binary").repartition(*deal).sortWithinPartitions(*deal).mapInArrow(propose, "_host string, h long").distinct())
    # lists of a host's hashes are written: Spark then knows their size, and moves the pages to them only if they are too large to broadcast
    asked = scratch.write(proposed.groupBy("_host").agg(F.collect_list("h").alias("_hashes")))
    scratch.release()
    counted = pages.join(asked, "_host").select("_host", "_main", "_texts", "_keep", "_hashes").mapInArrow(count, "_host string, h long, on long, beside long").groupBy("_host", "h").agg(F.sum("on").alias("on"), F.sum("beside").alias("beside"))
    often = counted.join(pages.select("_host", "_pages").distinct(), "_host").filter(F.col("on") >= F.greatest(F.lit(OPEN_PAGES), F.ceil(F.col("_pages") * OPEN_SHARE)))
    told = scratch.write(often.groupBy("_host").agg(F.collect_list(F.struct("h", "on", "beside")).alias("_found")).select("_host", F.col("_found.h").alias("_hashes"), F.col("_found.on").alias("_on"), F.col("_found.beside").alias("_beside")))
    # written for the same reason: as a plan of unknown size, hosts with open pages would have every page's text moved to them, even if there are none
    beside = scratch.write(pages.filter("not _main").select("_host").distinct())
    at = pages.join(beside, "_host", "left_semi").select("_row", "_host", "_main", "_texts").mapInArrow(cut_long, "_row long, _at int, _host string, h long, _first boolean, _main boolean")
    twice = at.filter("_first").groupBy("_host", "h").agg(F.count("*").alias("on")).filter(F.col("on") >= OPEN_PAGES).select("_host", "h")
    long = scratch.write(at.filter("not _main").select("_row", "_at", "_host", "h").join(twice, ["_host", "h"]).groupBy("_row").agg(F.collect_list("_at").alias("_long")))
    rows = pages.join(told, "_host", "left").join(long, "_row", "left")
    return rows.select("_id", "_url", "_main", "_pages", "_texts", "_keep", "_hashes", "_on", "_beside", "_long").mapInArrow(settle_pages, f"_id {kind}, _url string, text string")


def extract_html(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_pages: int = CHUNK_PAGES) -> DataFrame:
    """One row per row of pages: the id, url, text (empty if none), n_chars.

    The structure is the prior: it says which blocks of a page may be its text (page_blocks). Then the host decides: the token streams of all blocks of all its
    pages are concatenated. From an article go tokens in a substring of MIN_TOKENS or more that MAIN_SHARE of the host's pages (MAIN_PAGES at least) have
    outside articles: passages that articles share stay. From pages without article or main element, those that OPEN_SHARE (OPEN_PAGES) of its pages have, or any of LONG_TOKENS that two
    have. What is left are the unique runs.

    Hosts of at most chunk_pages pages are one suffix array in one task. Larger ones are dealt into chunks of about that many, by hash, each
    with its suffix array; what chunks find is exchanged and counted over the whole host, so results don't depend on chunk_pages.
    Null html is empty; pages without host count as one host, so do those without url. Repeated rows are pages of their own: copies of a page keep
    their text. Pages of any length are read in time linear in it. An empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    kind = rows.schema["_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [page_blocks(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([m for m, _ in found], pa.bool_()), pa.array([[t for t, _ in f] for _, f in found], pa.list_(pa.string())), pa.array([[k for _, k in f] for _, f in found], pa.list_(pa.bool_()))],
                    ["_id", "_url", "_main", "_texts", "_keep"],
                )

    scratch = Scratch(rows.sparkSession, "html")
    host = F.lower(F.regexp_extract(F.coalesce("_url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    seen = scratch.write(rows.mapInArrow(read, f"_id {kind}, _url string, _main boolean, _texts array<string>, _keep array<boolean>").withColumns({"_host": host, "_row": F.monotonically_increasing_id()}))
    large = scratch.write(seen.groupBy("_host").agg(F.count("*").alias("_pages")).filter(F.col("_pages") > chunk_pages))
    flagged = slot_test(seen.withColumn("_slot", slot_of(F.col("_host"))), "_slot", slot_filter(large.select(slot_of(F.col("_host")).alias("slot")).distinct()), "_maybe")
    small = flagged.filter("not _maybe").select(*seen.columns).unionAll(flagged.filter("_maybe").join(large, "_host", "left_anti").select(*seen.columns))
    out = small_hosts(small, kind)
    if large.take(1):
        dealt = flagged.filter("_maybe").join(large, "_host").withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.ceil(F.col("_pages") / chunk_pages)).cast("int"))
        out = out.unionAll(large_hosts(dealt.select(*seen.columns, "_pages", "_chunk"), kind, scratch))
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))
