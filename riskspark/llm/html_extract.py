"""Main text of web pages from tag-path ratios.

A page is read as a list of blocks, each with its path of block-level tags from the root. Text length and punctuation are
summed per path and divided by the number of blocks there; both ratios are smoothed over the paths with the same parent,
fused, and damped by the share of linked text. Paths above a share of the best one hold the article, and the element
around them is read whole but for paths that are mostly links. Parts that are
never article text by their tag or by the class, id or role of an element (menus, adverts, comments and so
on) have no weight, and a page that marks its article is read inside that mark alone. What holds the marked article is no such
part, and neither is what has the class or id of one but holds most of the text of a page without a mark.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import col

# Tags without content, tags that hold no page text, tags that stay inside a block, and tags that
# close an open tag of the same kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg math canvas video audio title select xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
ASIDE_TAGS = frozenset("nav footer aside form button menu dialog fieldset head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related recommended share sharing "
    "social comment comments reply replies respond disqus discussion footer header masthead topbar pagination pager login search skip".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？…]")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?:>|\Z)|[^>]*(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKENS = re.compile(r"[a-z]+(?:[-_0-9]+[a-z]+)*")
_WORDS = re.compile(r"[a-z]+")
# Words after the head of a token (ad-container, comments-area), before a state (with-sidebar), before the header of an article.
TAILS = frozenset(
    "area bar block body bottom box btn button buttons container content form group icons inner item items left link links list main message "
    "outer panel post posts primary right secondary section text top wrap wrapper".split()
)
STATES = frozenset("with without has no is".split())
HEADED = frozenset("article entry post story content".split())


@dataclass
class Block:
    path: str
    aside: bool
    article: bool
    element: int = -1
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    read: str | None = None

    def text(self) -> str:
        """Ask for it when the page is read to the end: it is put together once."""
        if self.read is None:
            self.read = " ".join("".join(self.parts).split())
        return self.read


def _names_aside(value: str, in_article: bool) -> bool:
    """Whether a token of a class or id, or its head word, names an aside."""
    for token in _TOKENS.findall(value):
        words = _WORDS.findall(token)
        if words[0] in STATES and len(words) > 1:
            continue
        while len(words) > 1 and words[-1] in TAILS:
            words.pop()
        if words[-1] in ASIDE_WORDS and not (words[-1] == "header" and (in_article or words[0] in HEADED)):
            return True
    return False


def _is_aside(name: str, attrs: str, in_article: bool) -> int:
    """0 for no aside, 1 for one by class or id or a form, 2 by another tag or role, 3 for what is hidden."""
    found = 0
    if name in ASIDE_TAGS or name == "header" and not in_article:
        found = 1 if name == "form" else 2
    for key, *values in _ATTR.findall(attrs):
        value = "".join(values).lower()
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return 3
        if key == "role" and value in ASIDE_ROLES:
            found = max(found, 2)
        # The root and the marked article are never an aside, whatever their classes say.
        if key in ("class", "id") and name not in ("html", "body", *ARTICLE_TAGS) and _names_aside(value, in_article):
            found = max(found, 1)
    return found


@dataclass
class Element:
    """``aside`` as by _is_aside, of the element alone; a ``frame`` may be the root of the content; ``size`` is the text
    without links, all elements inside included."""

    parent: int
    aside: int
    article: bool
    hidden: bool
    frame: bool
    size: int = 0


def _free(elements: list[Element], out: list[Block], most: float) -> None:
    """Take the aside mark from what holds the page's article, and from marks by class or id that hold most of the text."""
    sizes = [max(0, len(t) - t.count(" ") - b.linked) for b in out for t in (b.text(),)]
    for b, size in zip(out, sizes, strict=True):
        if b.element >= 0 and not elements[b.element].hidden:
            elements[b.element].size += size
    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].size += e.size
    whole = sum(e.size for e in elements if e.parent < 0)
    plain = sum(size for b, size in zip(out, sizes, strict=True) if not b.aside)
    marked = [k for k, e in enumerate(elements) if e.article and (e.parent < 0 or not elements[e.parent].article)]
    freed = False
    if marked:
        # The longest marked article, unless the text outside of asides is longer: then it is but a teaser.
        k = max(marked, key=lambda k: elements[k].size)
        around, size = elements[k].parent, elements[k].size
        while around >= 0:
            if 0 < elements[around].aside < 3 and size > plain:
                elements[around].aside, freed = 0, True
            around = elements[around].parent
    if not marked or not plain:
        for e in elements:
            if e.aside == 1 and e.size > most * whole:
                e.aside, freed = 0, True
    if freed:
        inside = []
        for e in elements:
            inside.append(e.aside > 0 or e.parent >= 0 and inside[e.parent])
        for b in out:
            b.aside = b.element >= 0 and inside[b.element]


def blocks(page: str, most: float = 0.75) -> list[Block]:
    """Blocks of text in page order. A cut-off tag at the end of the page is markup."""
    return _read(page, most)[0]


def _read(page: str, most: float) -> tuple[list[Block], list[Element]]:
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, aside, article: of the element and all around it; its number
    elements: list[Element] = []
    fresh = True

    def add(text: str) -> None:
        nonlocal fresh
        if not text:
            return
        if fresh or not out:
            aside, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            out.append(Block("/".join(t for t, *_ in stack if t not in INLINE), aside, article, stack[-1][3] if stack else -1))
            fresh = False
        text = html.unescape(text)
        out[-1].parts.append(text)
        if any(t == "a" for t, *_ in stack):
            out[-1].linked += len("".join(text.split()))

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name not in INLINE:
            fresh = True
        elif name in ("br", "img", "wbr") and not m["close"]:
            if name == "br" and out and not fresh:
                out[-1].parts.append(" ")
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        attrs = m["attrs"]
        if name in RAW and not attrs.rstrip(">").endswith("/"):
            end = re.compile(rf"</{name}(?![A-Za-z0-9-])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or attrs.rstrip(">").endswith("/") and name not in INLINE:
            continue
        if name not in INLINE:
            # A block ends an open paragraph, and an item ends the item before it inside the same list or table.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in CLOSES.get(name, ()):
                    del stack[k:]
                    break
                if stack[k][0] in LIMITS.get(name, ()) or stack[k][0] not in INLINE and name not in CLOSES:
                    break
        around = stack[-1] if stack else ("", False, False, -1)
        aside = _is_aside(name, attrs, around[2])
        hidden = aside == 3 or around[3] >= 0 and elements[around[3]].hidden
        elements.append(Element(around[3], aside, around[2] or name in ARTICLE_TAGS, hidden, name not in INLINE and name not in ("html", "body", "p")))
        stack.append((name, around[1] or aside > 0, around[2] or name in ARTICLE_TAGS, len(elements) - 1))
    add(page[at:])
    _free(elements, out, most)
    return out, elements


@dataclass(frozen=True)
class ExtractConfig:
    smoothing: float = 0.5
    least_share: float = 0.1
    most_linked: float = 0.7
    most_text: float = 0.75
    root_share: float = 0.8


def content_paths(found: list[Block], cfg: ExtractConfig) -> tuple[set[str], set[str]]:
    """Paths whose smoothed, fused ratios reach the threshold, and those that are mostly links. ``found`` holds no asides and no empty blocks."""
    sums: dict[str, list[float]] = {}
    for b in found:
        text = b.text()
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for i, v in enumerate((1, len(text), len(PUNCTUATION.findall(text)), b.linked)):
            s[i] += v
    ratios = {p: (n_chars / n, marks / n) for p, (n, n_chars, marks, _) in sums.items()}
    family: dict[str, list[str]] = {}
    for p in ratios:
        family.setdefault(p.rpartition("/")[0], []).append(p)
    scores = {}
    for p, own in ratios.items():
        others = family[p.rpartition("/")[0]]
        chars, marks = (own[i] + cfg.smoothing * (max(ratios[o][i] for o in others) - own[i]) for i in (0, 1))
        n, n_chars, _, linked = sums[p]
        scores[p] = 0.0 if linked > cfg.most_linked * n_chars else chars * (1 + marks) * (1 - linked / max(n_chars, 1))
    most = max(scores.values(), default=0)
    return {p for p, s in scores.items() if s > 0 and s >= cfg.least_share * most}, {p for p, s in scores.items() if s <= 0}


def content_root(content: list[Block], elements: list[Element], share: float) -> int:
    """The deepest element, inline ones and paragraphs aside, that holds ``share`` of the text of the blocks ``content``; -1 for the page."""
    held = [0] * len(elements)
    for b in content:
        if b.element >= 0:
            held[b.element] += len(b.text())
    for k in range(len(elements) - 1, -1, -1):
        if elements[k].parent >= 0:
            held[elements[k].parent] += held[k]
    whole = sum(len(b.text()) for b in content)
    # Elements come before those inside them, and no two apart hold more than half each.
    return max((k for k, n in enumerate(held) if n >= share * whole and elements[k].frame), default=-1)


def main_text(page: str | None, cfg: ExtractConfig = ExtractConfig()) -> str:
    """Text of the main blocks in page order, one line each.

    In a marked article these are all blocks but those on paths that are mostly links. Otherwise they are the blocks on
    content paths, with all others inside the element that holds nearly all of the text of these, or, if that
    is the whole page, all others between the first and the last of them.
    """
    found, elements = _read(page or "", cfg.most_text)
    found = [b for b in found if not b.aside and b.text()]
    marked = [b for b in found if b.article]
    paths, linked = content_paths(marked or found, cfg)
    if marked:
        return "\n".join(b.text() for b in marked if b.path not in linked)
    at = [k for k, b in enumerate(found) if b.path in paths]
    if not at:
        return ""
    root = content_root([found[k] for k in at], elements, cfg.root_share)
    inside: list[bool] = []
    for k, e in enumerate(elements):
        inside.append(root >= 0 and (k == root or e.parent >= 0 and inside[e.parent]))

    def kept(k: int, b: Block) -> bool:
        return b.path in paths or b.path not in linked and (at[0] < k < at[-1] or b.element >= 0 and inside[b.element])

    return "\n".join(b.text() for k, b in enumerate(found) if kept(k, b))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", cfg: ExtractConfig = ExtractConfig()) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row; null and empty pages have an empty text.

    Repeated rows give repeated results. Other columns are ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), cfg) for page in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(col(pages, id_col).cast("long").alias("page_id"), col(pages, url_col).alias("url"), col(pages, html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
