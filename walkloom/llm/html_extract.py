"""HTML extraction: the main text of pages, by their elements and a suffix array over the pages of a host.

A page is cut into blocks of visible text. Blocks in its article (or main) element are the text, but for
menus, sidebars, forms, comments and the like inside; elements that say what they are (nav, footer, a class
"ad", ...) never are. What stands outside of the article is concatenated, page after page, for each host, and
a suffix array over these token streams, sorted to the depth LONG, shows where a run of LONG tokens or more
(ends of blocks count) stands on pages of different text. On a page without such an element, the runs that are
so repeated are removed from the blocks that say nothing of themselves (a whole block, or LONG tokens of it),
and the rest is kept.

Pages are dealt by host; a host whose pages are larger than HOST_CHARS is split in groups of its pages, and runs
that stand in several groups are found by names of their tokens, counted over the groups. A task holds one group.

Defined results: null html is empty; white space is Unicode's; a <br> is white space; a nested article is a
reader's comment; pages of equal text are one page, so copies don't remove each other; of a page nearly all
of which is repeated (NEAR_COPY) no text is removed as repeated, as it is the near copy of another; a null or
odd url has the host ""; repeated rows each get a row; an empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm.common import materialize, pieces

#: Tokens of a repeated run at least, ends of blocks included.
LONG = 10
#: Characters of html of a host's group of pages.
HOST_CHARS = 1 << 22
#: Share of a page's tokens that repeat, from which it is a near copy.
NEAR_COPY = 0.8
#: Share of a block's characters in links, from which it is a menu.
LINKS = 0.6

# Elements, by the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe noscript template svg math canvas object audio video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: An end tag of an inline element or paragraph closes nothing beyond these.
SCOPES = BLOCKS - {"p"}
#: What a start tag ends, and what that doesn't look beyond.
LISTS = frozenset("ul ol dl menu table tbody thead tfoot select div article section main aside nav header footer form blockquote body".split())
IMPLIED = {"li": ({"li"}, LISTS), "dd": ({"dd", "dt"}, LISTS), "dt": ({"dd", "dt"}, LISTS), "tr": ({"tr"}, LISTS - {"div"}), "td": ({"td", "th"}, LISTS | {"tr"}), "th": ({"td", "th"}, LISTS | {"tr"}), "option": ({"option"}, LISTS)}
PARAGRAPH = ({"p"}, LISTS | {"li", "dd", "dt", "td", "th", "caption", "figcaption"})
IN_HEAD = frozenset("head meta link base title style script noscript template".split())

# What elements, roles and the words of classes and ids say of themselves (fixed values).
CHROME_TAGS = frozenset("nav footer aside form button select dialog menu search head fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars footer masthead "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended recommendations "
    "comment comments disqus respond replies pagination pager widget widgets toolbar topbar skip".split()
)
HEADER_WORDS = frozenset("header topnav".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
TEXT_WORDS = frozenset("article articlebody content entry post story".split())
HINTED = BLOCKS | {"span", "ins"}

TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?|<[!?/][^>]*+>?""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?![\w-])""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}

#: Kinds of blocks: of the article, of the main element, what says nothing of itself, what is no text, and a form's, which may hold a whole page.
ARTICLE, MAIN, OPEN, CHROME, FORM = range(5)


def _attributes(raw: str) -> dict[str, str]:
    if not raw or "=" not in raw and "hidden" not in raw:
        return {}
    return {k.lower(): (v or "").strip("\"'") for k, v in reversed(ATTRIBUTE.findall(raw))}  # the first of a name counts


def _kind(tag: str, at: dict[str, str], kind: int) -> int:
    """The kind of what an element holds, in an element of a kind."""
    if kind == CHROME or kind == FORM and tag not in ("article", "main"):
        return kind
    if tag in CHROME_TAGS:
        return FORM if tag == "form" and kind == OPEN else CHROME
    style = at.get("style")
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or style and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style, re.I):
        return CHROME
    words = {w.lower() for k in ("class", "id") for w in WORD.findall(at.get(k, ""))}
    if tag == "article":
        return CHROME if kind == ARTICLE or words & COMMENT_WORDS else ARTICLE
    if tag in ("html", "body"):
        return kind
    role = at.get("role", "").lower()
    if tag == "header" and kind != ARTICLE or role in CHROME_ROLES:
        return CHROME
    if role == "article" or at.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    if tag == "main" or role == "main":
        return kind if kind == ARTICLE else MAIN
    if tag in HINTED and words:
        if words & COMMENT_WORDS and not words & {"article", "open", "enabled"} or not words & TEXT_WORDS and (words & CHROME_WORDS or kind == OPEN and words & HEADER_WORDS):
            return CHROME
    return kind


def blocks(page: str) -> list[tuple[str, int]]:
    """The visible text of a page, as blocks (text, kind) in order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: name, the kind that holds outside, whether it stands alone
    parts: list[str] = []
    kind, links, linked, at, end = OPEN, 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, CHROME if kind == FORM or kind == OPEN and linked >= LINKS * len(text) else kind))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        """Ends the open elements from the k-th on."""
        nonlocal kind, links
        if any(x[2] for x in stack[k:]):
            flush()
        kind = stack[k][1]
        links -= sum(x[0] == "a" for x in stack[k:])
        del stack[k:]

    def imply(ends, fence) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                return close(k)
            if stack[k][0] in fence:
                return None

    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3])
            continue
        if m[1] or m[4]:  # an end tag
            fence = () if tag in SCOPES else SCOPES
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in fence:
                    break
            continue
        raw = m[3] or m[6] or ""
        if tag in RAW and not (tag in ("svg", "math") and raw.endswith("/")):
            done = CLOSING[tag].search(page, at)
            if done or tag in ("script", "style"):
                at = done.end() if done else end
                continue
        if tag == "br":
            parts.append(" ")
        if tag not in IN_HEAD:
            imply({"head"}, SCOPES - {"head"})
        if tag in BLOCKS:
            imply(*PARAGRAPH)
        if tag in IMPLIED:
            imply(*IMPLIED[tag])
        new = kind if tag in VOID else _kind(tag, _attributes(raw), kind)
        alone = tag in BLOCKS or new != kind
        if alone:
            flush()
        if tag not in VOID:
            stack.append((tag, kind, alone))
            kind = new
            links += tag == "a"
    flush()
    return out


def split(found: list[tuple[str, int]]) -> tuple[list[str], list[tuple[str, int]]]:
    """The blocks of the article (else of the main element), and all others, where there is none as (text, OPEN) or (text, CHROME)."""
    for kind in (ARTICLE, MAIN):
        text = [t for t, k in found if k == kind]
        if text:
            return text, [(t, CHROME) for t, k in found if k != kind]
    return [], found


# ---- repeated runs


def _numbers(streams: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Token streams of pages (their blocks' hashes) one after another, and each token's page. A block ends with 0, a page with a number of its own."""
    zero, parts, page = np.zeros(1, "u8"), [], []
    for k, blocks_ in enumerate(streams):
        own = [x for b in blocks_ for x in (b, zero)] + [np.array([k + 1], "u8")]
        parts += own
        page.append(np.full(sum(map(len, own)), k))
    return (np.concatenate(parts), np.concatenate(page)) if parts else (np.zeros(0, "u8"), np.zeros(0, int))


def suffix_array(tokens: np.ndarray, depth: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order by their first tokens, to a depth, and each suffix's rank: equal where that many tokens are.

    By prefix doubling: ranks of twice the depth are those of pairs of ranks. What is beyond the end is less than all.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype("i8") + 1
    done = 1
    while done < depth:
        by = min(done, depth - done)
        then = np.zeros(len(rank), "i8")
        then[: len(rank) - by] = rank[by:]
        rank = np.unique(rank * (len(rank) + 2) + then, return_inverse=True)[1].astype("i8") + 1
        done += by
    return np.argsort(rank, kind="stable"), rank


def repeated(tokens: np.ndarray, page: np.ndarray, text: np.ndarray, also: np.ndarray | None = None, depth: int = LONG) -> np.ndarray:
    """Which tokens lie in a run of that many that stands on pages of different text (text: a page's digest). also: names of runs that do so elsewhere."""
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < depth:
        return covered
    order, rank = suffix_array(tokens, depth)
    digest, sorted_rank = text[page][order], rank[order]
    first = np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]])  # neighbours that share their first tokens
    several = np.minimum.reduceat(digest, first) != np.maximum.reduceat(digest, first)
    starts = np.zeros(n, bool)
    starts[order] = np.repeat(several, np.diff(np.r_[first, n]))
    if also is not None and len(also):
        starts[: n - depth + 1] |= np.isin(names(tokens, depth), also)
    starts[n - depth + 1 :] = False
    starts[: n - depth + 1] &= page[: n - depth + 1] == page[depth - 1 :]
    edges = np.zeros(n + 1, int)
    edges[:n] += starts
    edges[depth:] -= starts[: n - depth + 1]
    return np.cumsum(edges[:n]) > 0


def names(tokens: np.ndarray, depth: int = LONG) -> np.ndarray:
    """A 64-bit number of each run of that many tokens."""
    out = np.zeros(max(0, len(tokens) - depth + 1), "u8")
    for k in range(depth):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (tokens[k : k + len(out)] ^ (tokens[k : k + len(out)] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def within(covered: np.ndarray, depth: int = LONG) -> np.ndarray:
    """Of a block's covered tokens, those that count: the whole block, or pieces of that many tokens. A shorter piece is where a run of the blocks beside it goes on by chance."""
    if covered.all() or not covered.any():
        return covered
    edges = np.flatnonzero(np.diff(np.r_[0, covered.view("i1"), 0]))
    out = covered.copy()
    for a, b in zip(edges[::2], edges[1::2]):
        out[a:b] = b - a >= depth
    return out


def _hashes(text: str) -> np.ndarray:
    """Of a block's tokens; above all numbers that end pages."""
    return np.array([xxhash.xxh3_64_intdigest(w) | 1 << 63 for w in text.split(" ")], "u8")


def _streams(pages: list[dict]):
    hashed = [[_hashes(t) for t in p["others"]] for p in pages]
    tokens, page = _numbers(hashed)
    return hashed, tokens, page, np.array([p["digest"] for p in pages], "i8")


def _texts(pages: list[dict], also: np.ndarray | None):
    """The pages of a group with text and the number of repeated tokens outside of the article."""
    hashed, tokens, page, digest = _streams(pages)
    covered = repeated(tokens, page, digest, also)
    at = 0
    for p, blocks_ in zip(pages, hashed):
        own, here = [], 0
        for b in blocks_:
            own.append(within(covered[at + here : at + here + len(b)]))
            here += len(b) + 1
        at += here + 1
        count = sum(int(c.sum()) for c in own)
        kept = p["article"]
        if not kept:
            free = [(t.split(" "), c) for t, k, c in zip(p["others"], p["kinds"], own) if k == OPEN]
            much = sum(int(c.sum()) for _, c in free) > NEAR_COPY * sum(len(c) for _, c in free)
            kept = [" ".join(t if much else [w for w, gone in zip(t, c) if not gone]) for t, c in free]
        yield {"page_id": p["page_id"], "url": p["url"], "text": "\n".join(x for x in kept if x), "repeated_tokens": count}


def _parsed(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("part", pa.int64()), ("article", pa.list_(pa.string())), ("others", pa.list_(pa.string())), ("kinds", pa.list_(pa.int32())), ("digest", pa.int64())])
    for b in pieces(batches, 200):
        rows = []
        for r in b.to_pylist():
            article, others = split(blocks(r["html"] or ""))
            digest = xxhash.xxh3_64_intdigest("\n".join([*article, "\0", *(t for t, _ in others)])) - (1 << 63)
            rows.append({"page_id": r["page_id"], "url": r["url"], "host": r["host"], "part": digest % r["parts"], "article": article, "others": [t for t, _ in others], "kinds": [k for _, k in others], "digest": digest})
        yield pa.RecordBatch.from_pylist(rows, schema)


_PAGE = "page_id long, url string, host string, part long, article array<string>, others array<string>, kinds array<int>, digest long"


def parse(pages: DataFrame) -> DataFrame:
    """Of pages (page_id, url, host, parts, html): page_id, url, host, part (of so many, by the digest), article (blocks), others (blocks), kinds (of the others), digest (of all visible text)."""
    return pages.select("page_id", "url", "host", "parts", "html").mapInArrow(_parsed, _PAGE)


def _name_rows(batches):
    """Of each page, the names of its runs, once each."""
    schema = pa.schema([("host", pa.string()), ("part", pa.int64()), ("name", pa.int64()), ("digest", pa.int64())])
    for b in pieces(batches, 200):
        for p in b.to_pylist():
            _, tokens, _, _ = _streams([p])
            own = np.unique(names(tokens[:-1])).view("i8")  # without the end of the page
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([p["host"]] * len(own)), pa.array(np.full(len(own), p["part"])), pa.array(own), pa.array(np.full(len(own), p["digest"]))], schema=schema)


def _groups(batches):
    """Sorted rows of a partition, group by group: the names of runs that other groups have too, then pages."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("repeated_tokens", pa.int64())])
    key, also, pages = None, [], []

    def out():
        rows = list(_texts(pages, np.array(also, "i8").view("u8")))
        for k in range(0, len(rows), 500):
            yield pa.RecordBatch.from_pylist(rows[k : k + 500], schema)

    for b in pieces(batches, 500):
        for r in b.to_pylist():
            if key != (r["host"], r["part"]):
                yield from out()
                key, also, pages = (r["host"], r["part"]), [], []
            if r["name"] is not None:
                also.append(r["name"])
            else:
                pages.append(r)
    yield from out()


def extract(pages: DataFrame, host_chars: int = HOST_CHARS) -> DataFrame:
    """page_id, url, text, n_chars, repeated_tokens (tokens outside of the article that lie in runs which the host repeats) of each page (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), F.col("html").cast("string"))
    # A row for each host that is split; Spark knows the written table's size, and broadcasts it only below its threshold.
    large = pages.groupBy(F.col("host").alias("_host")).agg(F.sum(F.length("html")).alias("_chars")).filter(F.col("_chars") > host_chars)
    large = materialize(large.select("_host", F.ceil(F.col("_chars") / host_chars).cast("long").alias("_parts")), "hosts")
    pages = pages.join(large, F.col("host") == F.col("_host"), "left")
    dealt = parse(pages.withColumn("parts", F.coalesce("_parts", F.lit(1))))
    # Equal pages are in one group. A name is sent once a task, however many pages have it, and comes back to the groups that have it.
    runs = parse(pages.filter("_parts is not null").withColumn("parts", F.col("_parts"))).select("host", "part", "others", "digest").mapInArrow(_name_rows, "host string, part long, name long, digest long")
    shared = runs.select("host", "name", "part").distinct().groupBy("host", "name").agg(F.collect_set("part").alias("parts"), F.count("*").alias("n")).filter("n > 1")
    shared = shared.select("host", F.explode("parts").alias("part"), "name")
    rows = dealt.select("host", "part", "page_id", "url", "article", "others", "kinds", "digest").unionByName(shared, allowMissingColumns=True)
    found = rows.repartition("host", "part").sortWithinPartitions("host", "part", F.col("name").isNull()).mapInArrow(_groups, "page_id long, url string, text string, repeated_tokens long")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "repeated_tokens")
