"""Main text of web pages by tag-path ratios.

The text blocks of a page are grouped by their path of block tags from the root. A path's text ratio is its text length
per block, its punctuation ratio the punctuation per block; both are smoothed along the page, multiplied, and the blocks
on paths above a threshold are content. Around them, headings of content and plain items of a list or table between content
count too, as they are short by nature; lists of links don't. The article is the content of the container that holds most
of it and of the articles beside that, less what the markup itself calls a menu, header, footer, sidebar, notice, advert,
form or comment.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import per_batch

#: Elements by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div body td html".split())
ARTICLE = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What is short by nature; text in these is content between content unless it is mostly links.
ITEM = frozenset("li dt dd td th caption figcaption pre summary".split())
OUTSIDE = frozenset("nav footer aside button select option input label menu dialog head search".split())
#: Elements that may also wrap a whole page.
FORMS = frozenset("form fieldset".split())
#: Whole class names, ids and roles of what is no article.
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside nav "
    "navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social "
    "related recommended recommendations trending widget comment comments commentlist disqus reply replies respond "
    "pagination pager toolbar copyright disclaimer complementary contentinfo paywall toc tags "
    "ad-banner ad-box ad-container ad-slot ad-wrapper banner-ad site-header page-header site-footer page-footer "
    "main-nav main-menu main-navigation site-nav site-navigation nav-bar nav-menu navigation-menu top-nav top-bar "
    "side-bar left-sidebar right-sidebar sidebar-left sidebar-right cookie-banner cookie-bar cookie-notice "
    "cookie-consent newsletter-signup newsletter-form subscribe-form search-form login-form share-buttons share-bar "
    "social-share social-links social-media related-posts related-articles related-links related-content "
    "recommended-posts comment-list comment-form comments-area comments-section comment-section".split()
)
#: Words that make a name one of these wherever they stand in it (reader-comments, adUnit, newsletter_box), unless the
#: name starts by saying that something is there or not (has-sidebar, no-comments).
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments cookie cookies "
    "disqus newsletter paywall popup promo sidebar sponsor sponsored sponsors".split()
)
STATES = frozenset("has have is no not with without hide hides show shows".split())
#: Headings over an article's own list of links.
SOURCES = frozenset(
    "sources|references|notes|footnotes|bibliography|literature|further reading|works cited|citations|quellen|literatur|"
    "einzelnachweise|références|notes et références|fuentes|referencias|bibliografía".split("|")
)
#: Start tags that end an open element of the same family.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
ENDS_PARAGRAPH = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟]")

#: Smoothing: weights of the neighbours one and two text nodes away.
SMOOTH = np.array([0.06, 0.24, 0.4, 0.24, 0.06])

#: A path is content if its score is at least this part of the page's mean score weighted by text.
THRESHOLD = 0.25


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    outside: bool
    path: int
    named: bool = False
    inside: str = ""
    linked: bool = False


@dataclass(slots=True)
class Node:
    element: int
    block: int
    text: str


@dataclass(slots=True)
class Block:
    """What stands between two ends of blocks: an element of it, its text's length and marks, the length in links."""

    element: int
    path: int
    length: int = 0
    marks: int = 0
    linked: int = 0


def _outside(tag: str, attributes: str, parents: list[Element], at: int) -> tuple[bool, bool]:
    """Whether an element is no article for certain, and whether its name alone says so."""
    if tag in OUTSIDE:
        return True, False
    if tag == "header":  # the page's; an article's own header has its title
        while at >= 0:
            if parents[at].tag in ARTICLE:
                return False, False
            at = parents[at].parent
        return True, False
    if tag in ("body", "html", "article", "main"):
        return False, False
    named = tag in FORMS
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "style" and _UNSEEN.search(value):
            return True, False
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True, False
        if name in ("class", "id", "role"):
            named = named or not BOILERPLATE.isdisjoint(value.lower().split()) or any(map(_tells, value.split()))
    return False, named


def _tells(name: str) -> bool:
    """Whether one of a name's words says that it is no article."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return bool(parts) and parts[0] not in STATES and not SIGNS.isdisjoint(parts)


def parse(page: str) -> tuple[list[Element], list[Node]]:
    """Elements and text nodes in page order; block numbers rise wherever a block begins or ends."""
    elements, nodes = [Element("", -1, False, 0)], []
    paths: dict[tuple[int, str], int] = {}
    stack, block, at, n = [0], 0, 0, len(page)
    open_tags: dict[str, int] = defaultdict(int)  # so that no end tag looks for a start that isn't open

    def text(part: str) -> None:
        if part:
            nodes.append(Node(stack[-1], block, part))

    def pop_to(depth: int) -> None:
        nonlocal block
        if any(elements[e].tag in BLOCK for e in stack[depth:]):
            block += 1
        for e in stack[depth:]:
            open_tags[elements[e].tag] -= 1
        del stack[depth:]

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        text(page[at:start])
        found = _TOKEN.match(page, start)
        if found is None:  # no markup, or a tag whose quotes don't end
            tagged = page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] == "/"
            end = page.find(">", start) if tagged else start
            if end < 0:
                text(page[start:])
                break
            if not tagged:
                text("<")
            at = end + 1
            continue
        at = found.end()
        if found[2] is None:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:-3])
            continue
        tag = found[2].lower()
        if found[1]:
            if open_tags[tag]:
                pop_to(next(d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].tag == tag))
            elif tag in BLOCK:
                block += 1
            continue
        if tag in RAW:
            if not found[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in ENDS_PARAGRAPH or tag in CLOSES:
            family = CLOSES.get(tag, {"p"} if tag in ENDS_PARAGRAPH else set())
            for d in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in family) else ():
                open_tag = elements[stack[d]].tag
                if open_tag in family:
                    pop_to(d)
                    if tag not in CLOSES:
                        break
                elif open_tag in BLOCK and open_tag != "p":
                    break
        if tag in BLOCK:
            block += 1
        if tag in VOID or found[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        parent = elements[stack[-1]]
        outside, named = (True, False) if parent.outside else _outside(tag, found[3], elements, stack[-1])
        path = paths.setdefault((parent.path, tag), len(paths) + 1) if tag in BLOCK else parent.path
        kind = tag if tag in HEADING or tag in ITEM else parent.inside
        elements.append(Element(tag, stack[-1], outside, path, named, kind, parent.linked or tag == "a"))
        stack.append(len(elements) - 1)
        open_tags[tag] += 1
    return elements, nodes


def blocks_of(elements: list[Element], nodes: list[Node]) -> dict[int, Block]:
    """The blocks of the given nodes by number, in page order."""
    blocks: dict[int, Block] = {}
    for node in nodes:
        element = elements[node.element]
        block = blocks.get(node.block)
        if block is None:
            block = blocks[node.block] = Block(node.element, element.path)
        block.length += len(node.text)
        block.marks += len(_PUNCTUATION.findall(node.text))
        if element.linked:
            block.linked += len(node.text)
    return blocks


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Smoothed and fused text and punctuation ratios of each tag path among the given blocks."""
    count, length, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for block in blocks:
        count[block.path] += 1
        length[block.path] += block.length
        marks[block.path] += block.marks
    paths = [b.path for b in blocks]
    ratios = []
    for total in (length, marks):
        row = np.array([total[p] / count[p] for p in paths])
        ratios.append(np.convolve(np.pad(row, 2, mode="edge"), SMOOTH, mode="valid"))
    fused = ratios[0] * (1 + ratios[1])
    scores: dict[int, list[float]] = defaultdict(list)
    for p, score in zip(paths, fused):
        scores[p].append(score)
    return {p: float(sum(s) / len(s)) for p, s in scores.items()}


def content_paths(blocks: list[Block]) -> set[int]:
    """The paths whose score is at least THRESHOLD of the mean."""
    scores = path_scores(blocks)
    mean = sum(scores[b.path] * b.length for b in blocks) / sum(b.length for b in blocks)
    return {p for p, score in scores.items() if score >= THRESHOLD * mean}


def held_text(elements: list[Element], blocks: list[Block], content: set[int]) -> tuple[dict[int, int], int]:
    """Length of the content text in each element that has some, and in all."""
    held = [0] * len(elements)
    for block in blocks:
        if block.path in content:
            held[block.element] += block.length
    for e in range(len(elements) - 1, 0, -1):  # children come after their parents
        held[elements[e].parent] += held[e]
    return defaultdict(int, {e: n for e, n in enumerate(held) if n}), held[0]


def rule_out(elements: list[Element], nodes: list[Node]) -> None:
    """Marks as outside what lies in an element that its name rules out.

    A name does not rule out an element with most of the content text that holds the page's first article or main, without
    those an h1, or if there is neither nearly all such text: that one wraps the page.
    """
    named = [e for e, x in enumerate(elements) if x.named and not x.outside]
    if not named:
        return
    seen = list(blocks_of(elements, [n for n in nodes if not elements[n.element].outside]).values())
    held, total = held_text(elements, seen, content_paths(seen)) if seen else ({}, 0)
    marks = [e for e, x in enumerate(elements) if x.tag in ARTICLE and not x.outside][:1]
    marks = marks or [e for e, x in enumerate(elements) if x.tag == "h1" and not x.outside]
    around = set()
    for at in marks:
        while at > 0:
            around.add(at)
            at = elements[at].parent
    for e in named:
        most = 2 * held.get(e, 0) > total and (e in around or not marks and 5 * held[e] >= 4 * total)
        elements[e].outside = not most
    for x in elements[1:]:  # parents come first
        x.outside = x.outside or elements[x.parent].outside


def articles_of(elements: list[Element], blocks: list[Block], content: set[int]) -> list[int]:
    """The elements that hold the article: the nearest one around most of the content text, and articles beside it."""
    held, total = held_text(elements, blocks, content)
    semantic = [e for e in held if elements[e].tag in ARTICLE]
    if semantic:  # of nested ones the inner, unless it has less
        best = max(semantic, key=lambda e: (held[e], e))
        beside = [e for e in semantic if elements[e].parent == elements[best].parent]
        if 2 * sum(held[e] for e in beside) >= total:
            return beside
    inner = [e for e in held if elements[e].tag in CONTAINER and held[e] >= 0.6 * total]
    return [max(inner, default=0)]


def within(elements: list[Element], roots: list[int]) -> list[bool]:
    """Whether each element is one of the roots or lies in one."""
    out, tops = [False] * len(elements), set(roots)
    for e, x in enumerate(elements):  # parents come first
        out[e] = e in tops or x.parent >= 0 and out[x.parent]
    return out


def chosen(elements: list[Element], blocks: dict[int, Block], sources: set[int] = frozenset()) -> set[int]:
    """Numbers of the article's blocks: those on content paths in it, their headings, and plain items between them.

    Links listed under one of the headings ``sources`` are content too. An article whose container has no h1 gets the
    last one before it that is no link: headlines often have a container of their own.
    """
    content = content_paths(list(blocks.values()))
    held = within(elements, articles_of(elements, list(blocks.values()), content))
    rows = [(n, b) for n, b in blocks.items() if held[b.element]]
    kept: set[int] = set()
    before = listed = False
    waiting: list[int] = []
    over = None  # the heading right above
    for number, block in rows:
        kind = elements[block.element].inside
        if kind in HEADING:
            listed = number in sources
        elif kind not in ITEM:
            listed = False
        if listed and (kind in HEADING or kind in ITEM):
            kept.add(number)
            continue
        above, over = over, number if kind in HEADING and kind != "h1" else None
        link = kind in ITEM and 2 * block.linked >= block.length and not block.marks  # smoothing lifts it beside content
        if block.path in content and not link:
            kept.update([number, *waiting])
            waiting, before = [], True
        elif kind in HEADING:
            waiting.append(number)
        elif kind in ITEM and before and not link:
            kept.update([number, *waiting])
            waiting = []
        else:
            waiting, before = [], False
            if link:  # a heading over links goes with them
                kept.discard(above)
    if kept and not any(elements[b.element].inside == "h1" for n, b in rows if n in kept):
        first = min(kept)
        heads = [n for n, b in blocks.items() if n < first and elements[b.element].inside == "h1" and 2 * b.linked < b.length]
        kept.update(heads[-1:])
    return kept


def main_text(page: str) -> str:
    """Blocks of the article in page order, joined by newlines; white space inside a block is one blank."""
    elements, nodes = parse(page)
    for node in nodes:
        node.text = html.unescape(node.text) if "&" in node.text else node.text
    rule_out(elements, [n for n in nodes if n.text and not n.text.isspace()])
    inside = [n for n in nodes if not elements[n.element].outside]
    filled = [n for n in inside if n.text and not n.text.isspace()]
    if not filled:
        return ""
    found = blocks_of(elements, filled)
    heads: dict[int, list[str]] = defaultdict(list)
    for node in filled:
        if elements[node.element].inside in HEADING:
            heads[node.block].append(node.text)
    sources = {n for n, parts in heads.items() if " ".join("".join(parts).split()).rstrip(":").lower() in SOURCES}
    kept = chosen(elements, found, sources)
    blocks: dict[int, list[str]] = defaultdict(list)
    for node in inside:
        if node.block in kept:
            blocks[node.block].append(node.text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars.

    Null or empty html, and pages without an article, give the empty text. Nothing is kept between rows; repeated rows
    give repeated rows, an empty table an empty one.
    """

    def make(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return {
            "page_id": batch.column(0),
            "url": batch.column(1),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }

    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
    )
    return per_batch(rows, "page_id long, url string, text string, n_chars long", make)
