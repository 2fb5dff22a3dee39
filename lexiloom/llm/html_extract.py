"""Main text of web pages by union-free wrappers.

A page is read as a token stream and its element structure kept as nested sequences of blocks. A
host's wrapper is a regular expression without unions over such sequences: a block is required,
optional or repeated, and its text is constant or a slot. A page gives a wrapper of its own, with
tandem repeats of one or more blocks folded into groups; two wrappers are aligned by their longest
common subsequence of blocks, level by level. A block that one side lacks becomes optional, texts that differ
become a slot. Wrappers of a host are aligned one after another in each reading task, then in salted
groups, then once; what is shuffled are wrappers. A block's kind is its tag and classes with digits as one mark; ids differ from
page to page and are no part of it. A wrapper keeps at most LEVEL blocks of a sequence and BLOCKS in all, those of
the most pages, so its size follows the template and not the pages.

The wrapper decides where the article is: the deepest block, not repeated, that holds seven tenths of the host's slot
text outside furniture, with a block beside it that holds a title of the page's own. A thread is a block whose slot text is
one repeated group of blocks of the same form without headings; beside a block that has a heading and prose it holds
reader comments or teasers, and is no part of the article. Where the block found holds article or main containers with a quarter
of its slot text, it is these. A page that lacks the block, and a host without slots, is judged by its own text alone.

In the article, texts go that the host's pages share: a text under the same kind of block on nine tenths of
the pages, at least five, inside repeated groups too, which a wrapper holds as one slot. On a host of two to four pages,
where no article or main container is found, a block beside the article's own goes if all of its texts are on every
page. Texts are counted by host and text over all tasks, without a cap. A host most of whose text is shared holds copies of
an article, and keeps it.

Menus, notices, forms, adverts, comments and other furniture vary like articles, so they also go by element, role
and name: a class or id that is a furniture word as a whole decides. One that has it as a part (cookie-bar) never decides
alone: the wrapper must find the block on half of the host's pages, at least three, and find that it is repeated or a thread, that
half of its characters are links, or that half are the same on all pages but for digits. A block named for
related texts stays where it is prose and not links.

Elements nested deeper than DEPTH leave no block of their own, so nothing here is bound by a page's depth; their text stays.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.lineage import materialise

# A quote opens a value only right after an equals sign, and only where it is closed.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>{
        _ATTRS
    })(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_PART = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {
    name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template iframe noembed noframes xmp textarea title".split()
}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
# A start tag ends an open element of these names, up to the fence.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_ENDS = ({"p"}, {"button", "td", "th", "table", "body"})

GONE = frozenset(
    "nav footer aside form script style noscript template iframe svg canvas object button select textarea input dialog menu head title audio video map".split()
)
GONE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split()
)
GONE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe"
    " subscription signup login comment comments commentlist disqus respond reply replies sidebar widget widgets related recommended recommendations share sharing social nav navbar"
    " navigation menu breadcrumb breadcrumbs pagination pager footer masthead popup modal overlay toolbar skip paywall".split()
)
MAIN_WORDS = frozenset(
    (
        "articlebody", "article-body", "article_body", "post-content", "entry-content", "article-content", "main-content", "story-body",
        "post-body",
    )
)
LINK_WORDS = frozenset("related recommended recommendations".split())
WHOLE = frozenset(("p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"))

DEPTH, LEVEL, BLOCKS = 60, 128, 4096
GONE_, HINT, MAIN, ARTICLE, LINKS = 1, 2, 4, 8, 16


class Block:
    """A block of a page: its kind, flags, children, and text runs between them in order; how many characters of its own runs are links."""

    __slots__ = ("kind", "tag", "flags", "items", "linked")

    def __init__(self, kind: str, tag: str, flags: int = 0) -> None:
        self.kind, self.tag, self.flags, self.items, self.linked = kind, tag, flags, [], 0

    def sizes(self) -> tuple[int, int]:
        """Characters, and those of links, in the block and below."""
        chars = linked = 0
        todo = [self]
        while todo:
            b = todo.pop()
            linked += b.linked
            for item in b.items:
                if isinstance(item, str):
                    chars += len(item)
                else:
                    todo.append(item)
        return chars, linked


def _block(tag: str, attrs: str) -> Block:
    """What an element is by its tag and attributes."""
    kind, flags = tag, GONE_ if tag in GONE else ARTICLE if tag == "article" else MAIN if tag == "main" else 0
    if attrs.strip(" /\n\t"):
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
        role, classes = found.get("role", "").lower(), found.get("class", "").split()
        names = [n.lower() for n in (*classes, *found.get("id", "").split())]
        kind = ".".join([tag, *sorted({_DIGITS.sub("#", c.lower()) for c in classes})])
        if role in GONE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(
            r"display\s*:\s*none", found.get("style", ""), re.I
        ):
            flags |= GONE_
        if tag not in ("html", "body", "article", "main"):
            if not (GONE_WORDS - LINK_WORDS).isdisjoint(names):
                flags |= GONE_
            elif not LINK_WORDS.isdisjoint(names):
                flags |= GONE_ if flags & GONE_ else GONE_ | LINKS
            elif not GONE_WORDS.isdisjoint(w.lower() for n in (*classes, found.get("id", "")) for w in _PART.split(n)):
                flags |= HINT
        if role == "article" or found.get("itemprop", "").lower() == "articlebody":
            flags |= ARTICLE
        elif role == "main" or not MAIN_WORDS.isdisjoint(names):
            flags |= MAIN
    return Block(kind, tag, flags)


def parse(html: str) -> Block:
    """The page's blocks. Unclosed and stray tags are borne; inline elements leave no block unless they are furniture."""
    root = Block("#root", "#root")
    stack: list[tuple[Block, str]] = [(root, "#root")]
    opened: Counter = Counter()  # names on the stack, so that what is not there is not looked for
    text: list[str] = []
    at, size, deep = 0, len(html), 0
    link, linked = 0, 0  # the stack's height where a link was opened, and link characters since the last flush

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            text.clear()
            if whole:
                stack[-1][0].items.append(whole)
                stack[-1][0].linked += min(linked, len(whole))
            linked = 0

    def open_(block: Block, name: str) -> None:
        nonlocal deep
        above = stack[-1][0]
        if deep < DEPTH or block.flags & GONE_ and not above.flags & GONE_:
            above.items.append(block)
            deep += 1
        else:
            block = above
        stack.append((block, name))
        opened[name] += 1

    def close(to: int) -> None:
        nonlocal deep, link
        flush()
        link = link if link <= to else 0
        for k in range(len(stack) - 1, to - 1, -1):
            deep -= stack[k][0] is not stack[k - 1][0]
            opened[stack[k][1]] -= 1
            if stack[k][0] is not stack[k - 1][0] and stack[k][0].flags & LINKS:
                chars, links = stack[k][0].sizes()
                if chars >= 40 and 4 * links < chars:
                    stack[k][0].flags &= ~(GONE_ | LINKS)
        del stack[to:]

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text.append(html[at:])
            break
        if lt > at:
            text.append(html[at:lt])
            linked += lt - at if link else 0
        m = _TOKEN.match(html, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m["name"]
        if not name:
            if m["cdata"]:
                text.append(m["cdata"])
            continue
        name = name.lower()
        if m["close"]:
            link = 0 if name == "a" else link
            if opened[name] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][1] == name))
            continue
        attrs = m["attrs"]
        if name in RAW:
            end = RAW[name].search(html, at)
            at = end.end() if end else size
            continue
        if name in ("br", "wbr"):
            text.append(" " if name == "br" else "")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in INLINE:
            if name == "a":
                link = len(stack) if "href" in attrs.lower() else 0
            if attrs and (b := _block(name, attrs)).flags & GONE_:
                flush()
                open_(b, name)
            continue
        flush()
        ends, fence = _ENDS.get(name, _P_ENDS)
        if any(opened[e] > 0 for e in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] in fence:
                    break
                if stack[i][1] in ends:
                    close(i)
                    break
        if name == "body" and opened["head"] > 0:
            close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][1] == "head"))
        b = _block(name, attrs)
        if attrs.rstrip().endswith("/"):
            continue
        open_(b, name)
    close(1)
    return root


# A wrapper block: [kind, least, most (1 or 2: repeated), pages that had it, characters, text, children, flags, link characters].
# text: None without, a checksum while constant, "*" for a slot.


def wrapper(block: Block, masked: bool = False) -> list:
    """A page's own wrapper. In blocks whose name only hints at furniture, texts that differ in digits alone are the same."""
    children = []
    masked = masked or bool(block.flags & HINT)
    for item in block.items:
        if isinstance(item, str):
            seen = _DIGITS.sub("#", item) if masked else item
            children.append(["#", 1, 1, 1, len(item), zlib.crc32(seen.encode("utf-8", "replace")), [], 0, 0])
        else:
            children.append(wrapper(item, masked))
    return [block.kind, 1, 1, 1, 0, None, fold(children), block.flags, block.linked]


def fold(seq: list) -> list:
    """Tandem repeats of up to four blocks become groups that repeat; of a long sequence, the blocks of the most pages stay."""
    for period in (1, 2, 3, 4):
        out: list = []
        for item in seq:
            out.append(item)
            while len(out) >= 2 * period and all(
                out[-period + i][0] == out[-2 * period + i][0] for i in range(period)
            ) and (period > 1 or out[-1][0] != "#"):
                late = out[-period:]
                del out[-period:]
                for i in range(period):
                    a = _merge(out[-period + i], late[i])
                    a[2], a[3] = 2, max(out[-period + i][3], late[i][3])
                    out[-period + i] = a
        seq = out
    if len(seq) > LEVEL:
        kept = sorted(range(len(seq)), key=lambda i: (-seq[i][3], min(i, len(seq) - 1 - i), i))[:LEVEL]
        seq = [seq[i] for i in sorted(kept)]
    return seq


def _merge(a: list, b: list) -> list:
    text = a[5] if a[5] == b[5] else "*"
    return [a[0], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], a[4] + b[4], text, align(a[6], b[6]) if a[6] or b[6] else [], a[7] | b[7], a[8] + b[8]]


def merge(a: list, b: list) -> list:
    """One wrapper for two, of at most BLOCKS blocks: those on the most pages."""
    out = _merge(a, b)
    pages: list[int] = []
    todo = [out]
    while todo:
        w = todo.pop()
        pages.append(w[3])
        todo += w[6]
    if len(pages) > BLOCKS:
        cut = sorted(pages, reverse=True)[BLOCKS]
        todo = [out]
        while todo:
            w = todo.pop()
            w[6] = [c for c in w[6] if c[3] > cut]
            todo += w[6]
    return out


def align(a: list, b: list) -> list:
    """One sequence for two: what both have in order is merged, the rest is optional. Sequences have at most LEVEL blocks."""
    head = 0
    while head < min(len(a), len(b)) and a[head][0] == b[head][0]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail][0] == b[-1 - tail][0]:
        tail += 1
    p, q = a[head : len(a) - tail], b[head : len(b) - tail]
    out = [_merge(x, y) for x, y in zip(a[:head], b[:head], strict=True)]
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        for j in range(len(q) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if p[i][0] == q[j][0] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(p) or j < len(q):
        if i < len(p) and j < len(q) and p[i][0] == q[j][0]:
            out.append(_merge(p[i], q[j]))
            i, j = i + 1, j + 1
        elif j == len(q) or i < len(p) and best[i + 1][j] >= best[i][j + 1]:
            out.append([p[i][0], 0, *p[i][2:]])
            i += 1
        else:
            out.append([q[j][0], 0, *q[j][2:]])
            j += 1
    out += [_merge(x, y) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    return fold(out)


def _tag(w: list) -> str:
    return w[0].split(".", 1)[0]


def _within(w: list) -> Iterator[list]:
    todo = [w]
    while todo:
        x = todo.pop()
        yield x
        todo += x[6]


def slots(w: list) -> int:
    """Slot characters in the block and below."""
    return sum(x[4] for x in _within(w) if x[5] == "*")


def thread(w: list) -> bool:
    """Whether the block's slot text is one repeated group of blocks, other than paragraphs, without titles of its own."""
    whole = slots(w)
    if not whole or any(_tag(x) in ("h1", "h2") and slots(x) for x in _within(w)):
        return False
    while True:
        if sum(slots(c) for c in w[6] if c[2] > 1 and _tag(c) != "#" and (_tag(c) == "li" or _tag(c) not in WHOLE)) >= 0.8 * whole:
            return True
        w = next((c for c in w[6] if slots(c) >= 0.8 * whole), None)
        if w is None:
            return False


def hinted(w: list, pages: int) -> bool:
    """Whether a block whose name has a furniture word as a part is furniture, by what the host's pages hold there."""
    if not w[7] & HINT or w[3] < max(3, pages / 2):
        return False
    chars, links = sum(x[4] for x in _within(w)), sum(x[8] for x in _within(w))
    return w[2] > 1 or 2 * links >= chars or 2 * slots(w) <= chars or thread(w)


def _masses(w: list, pages: int) -> dict[int, int]:
    """Slot characters outside furniture below each wrapper block."""
    out: dict[int, int] = {}

    def mass(x: list) -> int:
        if x[7] & GONE_ or hinted(x, pages):
            m = 0
        else:
            m = (x[4] if x[5] == "*" else 0) + sum(mass(c) for c in x[6])
        out[id(x)] = m
        return m

    mass(w)
    return out


def region(w: list) -> set[int]:
    """The wrapper blocks that are the article, by id(); none where the wrapper has no slots."""
    mass = _masses(w, w[3])
    total = mass[id(w)]
    if not total:
        return set()

    def titled(x: list, kinds: tuple) -> int:
        """Characters of slot headings in a block that is not furniture."""
        if x[7] & GONE_ or not mass.get(id(x)):
            return 0
        return mass[id(x)] if _tag(x) in kinds else sum(titled(c, kinds) for c in x[6])

    at, beside = w, []
    while True:
        if any(_tag(c) in ("h1", "h2", "h3") and not c[7] & GONE_ for c in at[6]):
            break
        single = [c for c in at[6] if c[2] == 1 and mass[id(c)] and _tag(c) not in WHOLE]
        titles = {id(c): titled(c, ("h1", "h2")) for c in single}
        if any(titles[id(c)] and mass[id(c)] - titles[id(c)] >= max(titles[id(c)], 0.05 * total) for c in single):
            for c in at[6]:
                if not titles.get(id(c)) and thread(c):
                    total -= mass[id(c)]
                    mass[id(c)] = 0
        heavy = next((c for c in single if mass[id(c)] >= 0.7 * total), None)
        if heavy is None:
            break
        if not titled(heavy, ("h1",)):
            beside += [c for c in single if c is not heavy and titled(c, ("h1",))]
        at = heavy
    for flag in (ARTICLE, MAIN):
        found: list[list] = []
        todo = [at]
        while todo:
            x = todo.pop()
            if x[7] & flag and mass[id(x)]:
                found.append(x)
            elif mass[id(x)]:
                todo += x[6]
        if sum(mass[id(x)] for x in found) >= 0.25 * mass[id(at)]:
            return {id(x) for x in found}
    return {id(x) for x in (at, *beside)}


def marked(w: list, where: set[int]) -> bool:
    """Whether the article is in article or main containers."""
    return all(x[7] & (ARTICLE | MAIN) for x in _within(w) if id(x) in where)


def _matched(block: Block, w: list | None) -> list:
    """(item, its wrapper block or None) for a block's items, in order."""
    if w is None or not w[6]:
        return [(x, None) for x in block.items]
    out, at = [], 0
    for item in block.items:
        kind = "#" if isinstance(item, str) else item.kind
        found = next((k for k in (*range(at, len(w[6])), *range(at)) if w[6][k][0] == kind), None)
        if found is not None:
            at = found if w[6][found][2] > 1 else found + 1
        out.append((item, None if found is None else w[6][found]))
    return out


def _name(kind: str, text: str) -> int:
    """A signed 64-bit hash of a text under a kind of block."""
    h = xxhash.xxh64_intdigest(f"{kind} {text}".encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def page_texts(root: Block) -> dict[int, int]:
    """The different texts of a page, furniture left out, as names and lengths."""
    found: dict[int, int] = {}
    todo = [root]
    while todo:
        b = todo.pop()
        for item in b.items:
            if isinstance(item, str):
                found[_name(b.kind, item)] = len(item)
            elif not item.flags & GONE_:
                todo.append(item)
    return found


def main_text(html: str | None, w: list | None = None, shared: frozenset[int] = frozenset(), where: set[int] | None = None) -> str:
    """The article's blocks joined by empty lines; w: the host's wrapper; shared: names of the texts that its pages share; where: its region()."""
    if not html:
        return ""
    root = parse(html)
    where = region(w) if w is not None and where is None else where
    pages = w[3] if w is not None else 0
    parts: list[tuple[Block, list | None]] = []

    def find(b: Block, bw: list | None) -> None:
        if bw is not None and id(bw) in where:
            parts.append((b, bw))
        else:
            for item, iw in _matched(b, bw):
                if iw is not None and not isinstance(item, str):
                    find(item, iw)

    if where and pages > 1:
        find(root, w)
    if not parts:
        alone = wrapper(root)
        for x in _within(alone):  # all of a lone page's text may vary
            x[5] = "*" if x[5] is not None else None
        where = region(alone)
        find(root, alone)
        parts = [(b, None) for b, _ in parts]
    out: list[str] = []
    few = pages < 5

    def all_shared(b: Block) -> bool:
        return all(_name(b.kind, x) in shared if isinstance(x, str) else x.flags & GONE_ or all_shared(x) for x in b.items)

    def walk(b: Block, bw: list | None, headed: bool, top: bool) -> None:
        for item, iw in _matched(b, bw):
            if isinstance(item, str):
                if few or not shared or _name(b.kind, item) not in shared:
                    out.append(item)
            elif item.flags & GONE_ or item.flags & HINT and iw is not None and hinted(iw, pages) or not headed and item.tag == "header":
                continue
            elif not (few and shared and top and item.tag not in WHOLE and all_shared(item)):
                walk(item, iw, headed, False)

    for b, bw in parts or [(root, None)]:
        walk(b, bw, bool(b.flags & (ARTICLE | MAIN)), True)
    return "\n\n".join(out)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, '' without one. A port or user is not part of it."""
    return F.lower(
        F.coalesce(
            F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), F.lit("")),
            F.lit(""),
        )
    )


def infer_wrappers(pages: DataFrame, host: str, page: str, html: str, hosts_held: int = 2000, texts_held: int = 200_000) -> DataFrame:
    """(host, wrapper as JSON, names of the texts that its pages share).

    Pages are parsed once, and what is written are wrappers and counts of texts, by host and reading task. Wrappers are
    aligned in the reading tasks, then in salted groups, then once; counts are added by host and text, so a host's go to all tasks.
    """
    counts = pa.list_(pa.struct([("name", pa.int64()), ("n", pa.int64()), ("size", pa.int64())]))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        n = 0

        def out() -> pa.RecordBatch:
            rows = [(h, *v) for h, v in held.items()]
            first, wrappers, texts = ([r[i] for r in rows] for i in (1, 2, 3))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()), pa.array(first, pa.string()),
                    pa.array([json.dumps(w) for w in wrappers], pa.string()), pa.array([w[3] for w in wrappers], pa.int64()),
                    pa.array([[{"name": k, "n": c, "size": z} for k, (c, z) in t.items()] for t in texts], counts),
                ],
                names=["host", "first", "wrapper", "pages", "texts"],
            )

        for part in parts:
            for h, p, body in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if body:
                    root = parse(body)
                    w = wrapper(root)
                    if h in held:
                        held[h][:2] = min(held[h][0], p), merge(held[h][1], w)
                    else:
                        held[h] = [p, w, {}]
                    texts = held[h][2]
                    n -= len(texts)
                    for name, size in page_texts(root).items():
                        texts[name] = (texts[name][0] + 1 if name in texts else 1, size)
                    n += len(texts)
                    if len(held) >= hosts_held or n >= texts_held:
                        yield out()
                        held.clear()
                        n = 0
        if held:
            yield out()

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        frame, total = frame.sort_values("first"), None
        for x in frame["wrapper"]:
            total = json.loads(x) if total is None else merge(total, json.loads(x))
        return pd.DataFrame(
            {
                "host": [frame["host"].iloc[0]], "first": [frame["first"].iloc[0]], "wrapper": [json.dumps(total)],
                "marked": [marked(total, region(total))],
            }
        )

    shape = "host string, first string, wrapper string, marked boolean"
    found = materialise(
        pages.select(host, F.coalesce(F.col(page).cast("string"), F.lit("")).alias(page), html).mapInArrow(
            read, "host string, first string, wrapper string, pages long, texts array<struct<name: long, n: long, size: long>>"
        )
    )
    salted = found.select("host", "first", "wrapper", F.pmod(F.xxhash64("first"), F.lit(64)).alias("salt"))
    wrappers = salted.groupBy("host", "salt").applyInPandas(merged, shape).groupBy("host").applyInPandas(merged, shape)
    hosts = found.groupBy("host").agg(
        F.sum("pages").alias("pages"),
        F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + t["n"] * t["size"])).alias("chars"),
    )
    texts = found.select("host", F.inline("texts")).groupBy("host", "name").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    everywhere = texts.where("n > 1").join(hosts, "host").where("n >= 0.9 * pages")
    shared = everywhere.groupBy("host").agg(
        F.collect_list("name").alias("shared"), F.sum(F.col("n") * F.col("size")).alias("same"), F.max("pages").alias("pages"),
        F.max("chars").alias("chars"),
    ).where("2 * same <= chars")
    kept = F.when((F.col("pages") >= 5) | ~F.col("marked"), F.col("shared"))
    return wrappers.join(shared, "host", "left").select("host", "wrapper", F.coalesce(kept, F.array().cast("array<long>")).alias("shared"))


def extract_main_text(
    pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = 1 << 25
) -> DataFrame:
    """A row for each row: id_, url, text, n_chars (code points).

    Null or empty html gives an empty text; a null or odd url counts as a host of its own name ''. A
    page with no element at all is its text. White space, no-break spaces included, is one space within
    a block. Wrappers are broadcast if they measure at most broadcast_bytes together and else joined by host.
    Repeated rows and null ids keep their rows. Other columns are left out.
    """
    picked = pages.select(
        F.col(id_).alias("id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"),
        host_of(F.col(url).cast("string")).alias("host"),
    )
    wrappers = materialise(infer_wrappers(picked, "host", "id", "html"))
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host") + 8 * F.size("shared"))).first()[0] or 0
    joined = picked.join(
        F.broadcast(wrappers) if size <= broadcast_bytes else wrappers, "host", "left"
    ).select("id", "url", "html", "host", "wrapper", "shared")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for part in parts:
            texts = []
            for at, (body, h, w) in enumerate(zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
                if w and h not in held:
                    if len(held) > 1000:
                        held.clear()
                    blocks = json.loads(w)
                    held[h] = (blocks, frozenset(part.column(5)[at].as_py()), region(blocks))
                texts.append(main_text(body, *held[h]) if w else main_text(body))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    return joined.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("id", id_)
