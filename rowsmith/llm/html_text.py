"""Main text of web pages by the maximum-scoring subsequence of a page's tokens.

A page is a sequence of words and tags.  A word scores by its place: the block it stands in, whether
it is linked, and what its elements are called (tag, role, class and id), the best and the
worst of these.  Tags score below zero.  One linear scan finds the contiguous region of the greatest
sum; words of the region that score below zero by themselves (an advert in the article) are left out,
and so cost it little.

Weights are log-odds from labelled pages, those that name their content with <article> or
<main>: words inside it against words outside, at most ``SAMPLE`` pages of at most ``SAMPLE_BYTES``
bytes; both bound the fit alone.  Each starts from a prior, worth ``PRIOR_WORDS`` words, since most sites' names for
menus, adverts or comments occur in no sample.  Being inside or outside of named content has a
weight like any other, which pages that name none don't use.

No element is judged by its name that holds the page's content: one around named content, or, where
none is named, one with over half of the words.  A class is read as a compound: "no-sidebar", "has-sidebar"
or "comments-open" tell a state of the page, not that the element is a sidebar or holds comments.

Text: character references are decoded, white space inside a block (a <br> too) becomes one
space, blocks are trimmed and joined by one line feed.  Defined cases: null and empty
pages, and pages without any word, give an empty text; hidden elements, scripts and the like give none;
broken markup is read as browsers do as far as this needs (unclosed, crossed and stray tags,
raw script text); very long pages are read whole; repeated rows each have their result; of regions
that score alike the first, shortest one counts; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_BYTES = 2000, 200_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the first kind, unless one of the second stands between.
_ENDS: dict[str, tuple[frozenset, frozenset]] = {
    **dict.fromkeys(("li",), (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir")))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("tr", "table")))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",)))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
}
#: Elements that are no text of the page, whatever they are called.
_SILENT = frozenset("head noscript template iframe object video audio canvas svg select datalist".split())
_TAGS = frozenset("nav header footer aside form button label menu dialog fieldset".split())
_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot dfp sponsor sponsored sponsors promo promos promotion promoted
    cookie cookies consent gdpr notice notices notification popup modal overlay paywall alert disclaimer banner
    sidebar sidebars aside rail nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer
    comment comments commentlist disqus replies respond discussion
    share sharing social related recommended recommendations newsletter subscribe subscription signup login search
    form widget widgets pagination pager toolbar skip""".split()
)
_CONTENT = frozenset("article post entry story content body text main".split())
_ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of a class after which a word names no element, and those that end a class that tells a state.
_MODIFIERS = frozenset("no non not with without has have hide hides hidden show shows is toggle".split())
_STATES = frozenset("open closed enabled disabled visible active free less count on off layout page template ready loaded".split())
#: Weights before any page is seen, for one word; what isn't here weighs nothing.
FURNITURE, CONTENT, INSIDE = -6.0, 1.0, 2.5
PRIOR_WORDS = 20
#: What a word that is left out anyway costs a region around it at most; inside named content nothing.
LEFT_OUT = -0.25
_BLOCK_PRIOR = {"p": 1.0, "h1": 0.8, "h2": 0.6, "h3": 0.5, "h4": 0.5, "blockquote": 0.8, "pre": 0.8, "figcaption": 0.3, "td": 0.2, "li": 0.3, "div": 0.4, "none": 0.4}


def _prior(key: str) -> float:
    kind, name = key[0], key[2:]
    if kind == "b":
        return -0.6 if name.endswith("@a") else _BLOCK_PRIOR.get(name, 0.3)
    if kind == "n":
        return FURNITURE if name in _NAMES else CONTENT if name in _CONTENT else -2.0 if name == "header" else 0.0
    return {"t:content": INSIDE, "t:outside": -4.0, "t:header": -4.0}.get(key, FURNITURE)


def _names(token: str, alone: bool) -> Iterator[str]:
    """The parts of one class or id that may name its element; alone: only one that is the whole."""
    parts = [p.lower() for p in _PART.findall(token)]
    if (alone and len(parts) > 1) or (len(parts) > 1 and parts[-1] in _STATES):
        return
    for i, p in enumerate(parts):
        if not (i and parts[i - 1] in _MODIFIERS):
            yield p


def _called(name: str, attrs: str, inside: bool) -> tuple[list[str], bool, bool]:
    """(keys of what an element is called, whether it names content, whether it is hidden); inside: within named content."""
    keys, content, hidden = [], name in ("article", "main"), name in _SILENT
    if name in _TAGS and not (name == "header" and inside):
        keys.append(f"t:{name}")
    for key, value in _ATTRIBUTE.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true" and name in BLOCKS) or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
        elif key == "role" and value.lower() in _ROLES:
            keys.append(f"r:{value.lower()}")
        elif (key == "role" and value.lower() == "main") or (key == "itemprop" and value.lower() == "articlebody"):
            content = True
        elif key in ("class", "id") and name not in ("body", "html"):
            for token in value.split():
                keys += [f"n:{p}" for p in _names(token, content) if not (inside and p == "header")]
    return keys, content, hidden


@dataclass
class Element:
    """keys: what it is called; named: it names content; within: so does it or one around it; holds: named content is inside."""

    parent: int
    name: str
    keys: list[str]
    named: bool
    within: bool
    hidden: bool
    words: int = 0
    holds: bool = False


@dataclass
class Page:
    """items: (kind, key, words, text, block, element) in page order; text items have kind 0, tags 1."""

    items: list[tuple[int, str, int, str, int, int]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element(-1, "", [], False, False, False)])
    named: bool = False


def tokenise(source: str) -> Page:
    page = Page()
    items, elements = page.items, page.elements
    open_ = [0]
    block = links = 0
    tag_block = "none"
    at = 0

    def text(raw: str) -> None:
        if elements[open_[-1]].hidden:
            return
        if "&" in raw:
            raw = html.unescape(raw)
        n = len(raw.split())
        elements[open_[-1]].words += n
        items.append((0, f"b:{tag_block}{'@a' if links else ''}", n, raw, block, open_[-1]))

    def close_to(depth: int) -> None:
        nonlocal links
        while len(open_) > depth:
            links -= elements[open_.pop()].name == "a"

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue  # comments, raw text elements, declarations
        name = name.lower()
        is_block = name in BLOCKS
        if is_block:
            block += 1
            if not m["close"]:
                if elements[open_[-1]].name == "p":
                    close_to(len(open_) - 1)
                kinds, bounds = _ENDS.get(name, (frozenset(), frozenset()))
                for depth in range(len(open_) - 1, 0, -1) if kinds else ():
                    here = elements[open_[depth]].name
                    if here in bounds:
                        break
                    if here in kinds:
                        close_to(depth)
                        break
            if name == "body":
                for depth in range(1, len(open_)):
                    if elements[open_[depth]].name == "head":
                        close_to(depth)
                        break
        elif name == "br" and not elements[open_[-1]].hidden:
            items.append((0, f"b:{tag_block}", 0, " ", block, open_[-1]))
        if not elements[open_[-1]].hidden:
            items.append((1, name, 0, "", block, open_[-1]))
        if m["close"]:
            if is_block:
                tag_block = "div"
            for depth in range(len(open_) - 1, 0, -1):
                here = elements[open_[depth]].name
                if here == name:
                    close_to(depth)
                    break
                if not is_block and here in BLOCKS:
                    break  # an inline end tag doesn't close a block
            continue
        attrs = m["attrs"]
        if is_block:
            tag_block = name
            if elements[open_[-1]].name == "a" and name not in ("div", "h1", "h2", "h3", "h4", "h5", "h6", "p"):
                close_to(len(open_) - 1)
        if name in VOID or (attrs.endswith("/") and not is_block):
            continue
        if name == "a":
            if elements[open_[-1]].name == "a":
                close_to(len(open_) - 1)
            links += 1
        around = elements[open_[-1]]
        keys, content, hidden = _called(name, attrs, around.within)
        if not (is_block or name == "a" or keys or hidden or content):
            continue
        named = content and not hidden and not around.hidden and not any(_prior(k) <= FURNITURE for k in keys)
        elements.append(Element(open_[-1], name, keys, named, around.within or named, hidden or around.hidden))
        open_.append(len(elements) - 1)
        page.named |= named
    if at < len(source):
        text(source[at:])
    _acquit(page)
    return page


def _acquit(page: Page) -> None:
    """Takes their names from elements that hold the page's content."""
    elements = page.elements
    for e in reversed(elements):
        if e.parent >= 0:
            around = elements[e.parent]
            around.words += e.words
            around.holds |= e.holds or e.named
    for e in elements:
        if e.holds if page.named else 2 * e.words > elements[0].words and e.name in ("div", "section", "form", "table", "tbody", "tr", "td", "center", "body", "html"):
            e.keys = []


@dataclass
class Weights:
    """Log-odds of a word by key: "b:" its block, "t:", "r:", "n:" what an element around it is called; and of ``tags``."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, key: str) -> float:
        found = self.words.get(key)
        if found is None:
            found = self.words[key] = _prior(key)
        return found


def _keys(page: Page) -> list[list[str]]:
    """What the elements around each element, and it itself, are called."""
    out: list[list[str]] = []
    for e in page.elements:
        own = list(dict.fromkeys((out[e.parent] if e.parent >= 0 else []) + e.keys))
        out.append(own)
    return out


def learn(pages: list[str]) -> Weights:
    """Weights from the pages that name their content; priors where nothing was seen."""
    inside, outside, tags_in, tags_out = Counter(), Counter(), Counter(), Counter()
    total_in = total_out = 0
    for source in pages:
        page = tokenise(source)
        if not page.named:
            continue
        called = _keys(page)
        for kind, key, n, _, _, at in page.items:
            within = page.elements[at].within
            if kind:
                (tags_in if within else tags_out)[key] += 1
                continue
            total_in, total_out = total_in + n * within, total_out + n * (not within)
            into = inside if within else outside
            for k in (key, *called[at], "t:content" if within else "t:outside"):
                into[k] += n
    weights = Weights()
    for key in set(inside) | set(outside):
        seen = inside[key] + outside[key]
        # As many words inside as outside: the odds are the place's own.
        odds = math.log((inside[key] + 1) / (total_in + 2)) - math.log((outside[key] + 1) / (total_out + 2))
        bound = {"b": 2.0, "t": INSIDE if key == "t:content" else -FURNITURE}.get(key[0], -FURNITURE)
        weights.words[key] = (PRIOR_WORDS * _prior(key) + seen * max(-bound, min(bound, odds))) / (PRIOR_WORDS + seen)
    t_in, t_out = sum(tags_in.values()) + 1, sum(tags_out.values()) + 1
    for key in set(tags_in) | set(tags_out):
        odds = math.log((100 * tags_in[key] / t_in + 1) / (100 * tags_out[key] / t_out + 1))
        weights.tags[key] = min(-0.02, 0.05 * max(-2.0, min(2.0, odds)) - 0.05)
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """[lo, hi) of the maximum-scoring contiguous subsequence; empty if nothing scores above zero."""
    best, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, lo, hi = run, start, i + 1
    return lo, hi


def word_scores(page: Page, weights: Weights) -> list[float]:
    """The score of one word of each item; of tags theirs."""
    best, worst = [], []
    for e in page.elements:
        own = [weights.of(k) for k in e.keys]
        best.append(max([0.0, *own, *([best[e.parent]] if e.parent >= 0 else [])]))
        worst.append(min([0.0, *own, *([worst[e.parent]] if e.parent >= 0 else [])]))
    inside, outside = weights.of("t:content"), weights.of("t:outside")
    out = []
    for kind, key, _, _, _, at in page.items:
        if kind:
            out.append(weights.tags.get(key, -0.05))
        elif page.named:
            within = page.elements[at].within
            out.append(weights.of(key) + max(best[at], inside if within else 0.0) + min(worst[at], 0.0 if within else outside))
        else:
            out.append(weights.of(key) + best[at] + worst[at])
    return out


def extract(source: str | None, weights: Weights) -> str:
    page = tokenise(source or "")
    scores = word_scores(page, weights)
    lo, hi = best_region([s if kind else n * max(s, 0.0 if page.elements[at].within else LEFT_OUT) for (kind, _, n, _, _, at), s in zip(page.items, scores, strict=True)])
    out: list[str] = []
    last, parts = None, []
    for (kind, _, _, text, block, _), score in zip(page.items[lo:hi], scores[lo:hi], strict=True):
        if kind or score <= 0:
            continue
        if block != last and parts:
            out.append("".join(parts))
            parts = []
        last = block
        parts.append(text)
    out.append("".join(parts))
    return "\n".join(t for t in (" ".join(b.split()) for b in out) if t)


def train(pages: DataFrame) -> Weights:
    """Learns from at most SAMPLE pages (least hash first) that name their content."""
    named = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.octet_length("html") <= SAMPLE_BYTES)).select(F.xxhash64("html").alias("h"), "html")
    # Hashes first: a bounded number of them goes to the scan, so no task merges many pages.
    chosen = [r.h for r in named.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    if not chosen:
        return learn([])
    picked = F.broadcast(pages.sparkSession.createDataFrame([(h,) for h in chosen], "h long"))
    rows = named.join(picked, "h").dropDuplicates(["h"])
    return learn([r.html for r in sorted(rows.collect(), key=lambda r: r.h)])


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    weights = train(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                texts = [extract(h.as_py(), weights) for h in rows.column(2)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
