"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of tokens: each word scores positive and each tag negative,
with weights by tag and by the kind of element that a word stands in. The weights
are log odds of standing inside the main text, counted over labelled pages: at
most ``MAX_PAGES`` pages (by a hash of the id) whose own markup labels the main
text with exactly one <article>. A linear scan finds the contiguous region with
the greatest sum; within it, elements that hold no main text by their kind or by
a whole class or role (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
reader comments, articles inside an article) are left out. Blocks keep page order. Only tags and words that are scored are
counted, a tag never costs more than half a word of its own element, and a kind
that the labelled pages do not show neither ends a region nor outweighs its words.

Edge cases: a null or empty page gives an empty text; pages without any region
of positive score give an empty text; unclosed elements end where the article
begins or the page ends; without labelled pages, default weights are used;
repeated rows get equal results; further columns are not read.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 1000
#: Score of a link's word where no labelled page has a link that is scored.
UNSEEN = 0.1

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Elements whose content is no markup.
_RAW = frozenset({"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"})
#: Elements that hold no main text.
_OFF = frozenset({"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "object", "canvas", "audio", "video", "head"})
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
_INLINE = frozenset({"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"})
_KNOWN = _INLINE | _OFF | frozenset({"html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "header", "hr"})
#: Elements that a name may mark as a part of the page (an id on a heading or an anchor is a link target only).
_HOLDERS = frozenset({"div", "section", "ul", "ol", "table"})
#: Words that name what is no main text, as a whole class or id, or as a part of one whose other parts are words of place.
_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe
    signup login paywall comment comments commentlist respond replies disqus reactions nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar widget related recommended teaser
    share sharing social footer masthead topbar toolbar skip search contentinfo complementary dialog form""".split()
)
_PLACES = frozenset(
    "site page main top bottom left right side box bar container wrapper wrap area section block list item items link links slot unit inner outer post posts entry article global primary secondary reader readers user users thread header group panel row col column body wp".split()
)
_CUT = re.compile(r"[-_]+|(?<=[a-z])(?=[0-9])")
_SPACE = re.compile(r"\s+")


@dataclass
class Weights:
    """Scores of a word by the element that it stands in, and of tags."""

    word: dict[str, float] = field(default_factory=lambda: {"a": -0.5, "li": 0.2, "title": -2.0})
    tag: dict[str, float] = field(default_factory=lambda: {"a": -2.0, "li": -2.0, "p": -0.2, "br": -0.1, "h1": -0.1})
    word_default: float = 1.0
    tag_default: float = -1.0


def tokens(page: str) -> Iterator[tuple[int, str, str]]:
    """(kind, name, text): kind 0 text, 1 start tag, 2 end tag, 3 start of what is left out, 4 its end. text: of a start tag its attributes."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield 0, "", page[at:]
            return
        if lt > at:
            yield 0, "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            nxt = page[lt + 1 : lt + 2]
            if nxt.isalpha() or nxt == "/":
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield 0, "", "<"
                at = lt + 1
            continue
        name, at = m[2].lower(), m.end()
        if m[1]:
            yield 2, name, ""
            continue
        if name in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
            at = n if end is None else end.end()
            continue
        yield 1, name, m[3]


def _named(value: str) -> bool:
    """Whether a whole class, id or role names what is no main text: "site-nav" does, "navigation-methods" does not."""
    parts = _CUT.split(value.lower())
    if parts in (["site", "header"], ["page", "header"]):
        return True
    return any(p in _NAMES for p in parts) and all(p in _NAMES or p in _PLACES or p.isdigit() for p in parts)


def _off(name: str, attrs: str, depth: int) -> int:
    """Whether an element holds no main text: 2 by its kind or place, 1 by what its attributes say, 0 not. depth: of open articles."""
    if name in _OFF or (name == "header" and not depth) or (name == "article" and depth):
        return 2
    if not attrs or name in ("html", "body", "main"):
        return 0
    if _HIDDEN.search(attrs):
        return 1
    for what, *values in _ATTR.findall(attrs):
        value = "".join(values).strip()
        if what.lower() == "id":
            if name in _HOLDERS and _named(value):
                return 1
        elif any(map(_named, value.split())):
            return 1
    return 0


def parse(page: str) -> list[tuple[str, str, str, bool]]:
    """The page as items (what, name, text, inside an article): what is "w" for text that may count, "-" for text that is left out, "t" for a tag, "x" for one that is left out, "s" for space.

    One pass with constant work for each tag. What is left out ends with its end
    tag; where that is missing, with the next <article>, <main> or <body>. A
    page's only article also ends what its attributes alone leave out.
    """
    found = list(tokens(page))
    open_by: dict[str, list[int]] = {}
    closed = set()
    articles = 0
    for i, (kind, name, _) in enumerate(found):
        if kind == 1:
            open_by.setdefault(name, []).append(i)
            articles += name == "article"
        elif kind == 2 and open_by.get(name):
            closed.add(open_by[name].pop())
    out: list[tuple[str, str, str, bool]] = []
    stack: list[tuple[str, int, bool, str]] = []  # open elements: name, how left out, whether closed, and the name that their words go by
    count: Counter[str] = Counter()
    off = firm = inside = 0  # left out; of these, those that an article does not end

    def pop() -> str:
        nonlocal off, firm, inside
        name, hide, shut, _ = stack.pop()
        count[name] -= 1
        off -= hide > 0
        firm -= hide == 2 and shut or (hide == 1 and shut and articles != 1)
        inside -= name in ("article", "main")
        return name

    for i, (kind, name, text) in enumerate(found):
        parent = stack[-1][3] if stack else ""
        if kind == 0:
            out.append((("-" if off else "w") if text.strip() else "s", parent, text, inside > 0))
            continue
        if kind == 1:
            if name in ("article", "main", "body") and off and not firm:
                while stack:
                    pop()
                parent = ""
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                while stack and stack[-1][0] == name:  # these close themselves
                    pop()
            opens = name not in _VOID and not text.endswith("/")
            hide = _off(name, text, count["article"]) if opens else 0
            inside += opens and name in ("article", "main")
            out.append(("x" if off or hide else "t", name, "", inside > 0))
            if opens:
                shut = i in closed
                above = stack[-1][3] if stack else ""
                stack.append((name, hide, shut, name if name == "a" or name not in _INLINE else above))
                count[name] += 1
                off += hide > 0
                firm += hide == 2 and shut or (hide == 1 and shut and articles != 1)
        else:
            out.append(("x" if off else "t", "/" + name, "", inside > 0))
            if count[name]:
                while pop() != name:
                    pass
    return out


def _name(tag: str) -> str:
    bare = tag.lstrip("/")
    return tag if bare in _KNOWN else ("/" if tag.startswith("/") else "") + "other"


def best_region(items: list[tuple[str, str, str, bool]], w: Weights) -> tuple[int, int]:
    """First and end item of the contiguous region with the greatest sum of scores; of equal ones, the first and shortest."""
    best, lo, hi = 0.0, 0, 0
    run, start = 0.0, 0
    for i, (what, name, text, _) in enumerate(items):
        if what == "w":
            s = w.word.get(_name(name), w.word_default) * len(text.split())
        elif what == "t":
            s = w.tag.get(_name(name), w.tag_default)
        else:
            s = 0.0  # what is left out anyway neither speaks for a region nor ends it
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, lo, hi = run, start, i + 1
    return lo, hi


def blocks(items: list[tuple[str, str, str, bool]], lo: int, hi: int) -> list[str]:
    """The texts of the blocks of a region, without what is left out."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(now))).strip()
        if text:
            out.append(text)
        now.clear()

    for what, name, text, _ in items[lo:hi]:
        if what == "w":
            now.append(text)
        elif what == "s":
            now.append(" ")
        elif what in "tx":
            bare = name.lstrip("/")
            if bare == "br":
                now.append(" ")
            elif bare not in _INLINE:
                close()
    close()
    return out


def text_of(page: str, w: Weights) -> str:
    """The main text of one page."""
    items = parse(page)
    lo, hi = best_region(items, w)
    return "\n".join(blocks(items, lo, hi))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter[tuple[str, bool]] = Counter()
    for b in batches:
        for page in b.column(0).to_pylist():
            page = page or ""
            if len(re.findall(r"<article[\s>]", page)) != 1:
                continue
            for what, name, text, inside in parse(page):
                if what == "w":
                    count["w " + _name(name), inside] += len(text.split())
                elif what == "t":  # what is left out is not scored either
                    count["t " + _name(name), inside] += 1
    yield pa.RecordBatch.from_pydict({"feature": [k for k, _ in count], "inside": [i for _, i in count], "n": list(count.values())}, schema=pa.schema([("feature", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Weights:
    """Weights from at most ``max_pages`` labelled pages."""
    sample = pages.where(F.col("html").contains("<article")).select(F.col("page_id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(max_pages)
    rows = (
        pages.join(F.broadcast(sample), F.col("page_id") == F.col("id"), "left_semi")
        .select("html")
        .mapInArrow(_count, "feature string, inside boolean, n long")
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b"))
        .collect()
    )  # a row for each known tag at most
    w = Weights()
    if not rows:
        return w
    w.word["a"], w.tag, w.tag_default = UNSEEN, {}, -UNSEEN / 2
    odds = {r["feature"]: math.log((r["a"] + 0.5) / (r["b"] + 0.5)) for r in rows}
    for feature, x in odds.items():
        kind, _, name = feature.partition(" ")
        if kind == "w":
            w.word[name] = max(-2.0, min(2.0, x))
    for feature, x in odds.items():
        kind, _, name = feature.partition(" ")
        if kind == "t":
            # tags never score positive; a start and an end tag together cost one word of their element at most
            own = abs(w.word.get(name.lstrip("/"), w.word_default))
            w.tag[name] = -0.02 if x > 0 else max(-own / 2, x * 4 - 1)
    return w


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                texts = [text_of(x.as_py() or "", weights) for x in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
