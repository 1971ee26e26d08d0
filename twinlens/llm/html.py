"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to the elements around them, each
element's points are discounted by the share of its text that is links, and the best container is kept with its siblings that
aren't mostly links. Elements that mark page furniture by tag, role, class or id give no points and no text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?:(?!\]\]>)[^<])*+\]\]>|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")
#: Names of a layout, not of what it names: has-sidebar, no-ads.
_LAYOUT = re.compile(r"(?<![a-z])(?:has|with|without|no)[-_]+[a-z]+")

#: Elements whose content is text up to their own end tag, none of it part of the page's text.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "xmp", "svg", "canvas", "title", "object", "noembed", "noframes", "annotation", "annotation-xml"}
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Page furniture by tag.
FURNITURE = {"head", "nav", "footer", "form", "aside", "button", "select", "datalist", "menu", "dialog", "audio", "video", "fieldset", "header"}
#: Page furniture by a word of role, class or id: what is named by kind, and what only holds links as a rule.
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
ADVERT_WORDS = set("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion".split())
NOTICE_WORDS = set("cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall dialog".split())
HEADER_WORDS = {"header", "banner", "masthead"}
PLACE_WORDS = set("sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs topbar footer contentinfo complementary form search toolbar pagination pager".split())
LINK_WORDS = set("discussion related recommended recommendations share sharing social widget widgets tagcloud copyright disclaimer".split())
#: Of those, words that an article's own block may have, too, if it isn't a list of links.
MENU_WORDS = LINK_WORDS | set("menu menus search toolbar form".split())
#: Words that mark comments and adverts wherever they stand, and those that mark a single paragraph.
STRONG_WORDS = ADVERT_WORDS | COMMENT_WORDS
PARAGRAPH_WORDS = (STRONG_WORDS | NOTICE_WORDS) - {"reply", "respond"}
FURNITURE_WORDS = STRONG_WORDS | NOTICE_WORDS | HEADER_WORDS | PLACE_WORDS | LINK_WORDS
CONTENT_WORDS = {"article", "content", "main", "post", "entry", "story", "text", "body"}
#: What a container's points are multiplied by if its tag or words name content.
CONTENT_BONUS = 1.25
#: The share of an element's points from which the one around it is taken instead, and the share of links of a sibling that goes.
CLIMB, MOST_LINKS = 0.6, 0.5
#: Elements inside a line of text.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var "
    "math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mphantom menclose".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag of these closes an open paragraph.
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre section table ul li dd dt".split()) | HEADINGS
#: A start tag closes the open element of these names, unless one of the fences is in between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FENCES = {"table", "td", "th", "button", "body"}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd"}


def _marks(attrs: str) -> tuple[set[str], bool]:
    """Words of role, class and id, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            words.update(_WORDS.findall(_LAYOUT.sub(" ", value)))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return words, hidden


class _Tree:
    """Elements of a page in page order, and its text in pieces that each belong to one of them."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.words, self.hidden = ["#page"], [-1], [set()], [False]
        self.pieces: list[tuple[int, str, bool]] = []
        self._stack, self._open = [0], Counter({"#page": 1})
        self._links: list[int] = []
        at = 0
        while at < len(html):
            found = _MARKUP.search(html, at)
            self._text(html[at : found.start() if found else len(html)])
            if not found:
                break
            at = found.end()
            tag = (found["tag"] or found["tag2"] or "").lower()
            if not tag:
                continue
            attrs, end = found["attrs"] or found["attrs2"] or "", found["end"] or found["end2"]
            if end:
                self._end(tag)
            elif tag in RAW and not attrs.endswith("/"):
                close = _RAW_END[tag].search(html, at)
                at = close.start() if close else len(html)
            else:
                self._start(tag, attrs)

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._stack[-1], text, bool(self._links)))

    def _break(self) -> None:
        self.pieces.append((self._stack[-1], "", False))

    def _pop(self, depth: int) -> None:
        for node in self._stack[depth:]:
            self._open[self.tag[node]] -= 1
        del self._stack[depth:]
        while self._links and self._links[-1] >= depth:
            self._links.pop()

    def _close(self, names: set[str], fences: set[str]) -> None:
        if any(self._open[n] for n in names):
            for depth in range(len(self._stack) - 1, 0, -1):
                if (tag := self.tag[self._stack[depth]]) in names:
                    self._pop(depth)
                    return
                if tag in fences:
                    return

    def _start(self, tag: str, attrs: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self._break()
            return
        words, hidden = _marks(attrs) if attrs.strip(" /") else (set(), False)
        if tag == "a":
            self._links.append(len(self._stack) - 1)
        if tag in INLINE and not hidden and not words & FURNITURE_WORDS:
            return
        if tag in CLOSES_P:
            self._close({"p"}, FENCES)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag not in INLINE:
            self._break()
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.words.append(words)
        self.hidden.append(hidden)
        self._stack.append(len(self.tag) - 1)
        self._open[tag] += 1

    def _end(self, tag: str) -> None:
        if tag == "a" and self._links:
            self._links.pop()
        if self._open[tag]:
            for depth in range(len(self._stack) - 1, 0, -1):
                here = self.tag[self._stack[depth]]
                if here == tag:
                    self._pop(depth)
                    break
                if tag in INLINE and here not in INLINE:
                    break
        if tag not in INLINE:
            self._break()


def _amounts(tree: _Tree) -> tuple[list[int], list[int]]:
    """Characters of text and of links in each element with all that it holds, without what is furniture by tag, hidden, a comment or an advert."""
    n = len(tree.tag)
    text, links, gone = [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        gone[i] = gone[tree.parent[i]] or tree.hidden[i] or tree.tag[i] in FURNITURE and tree.tag[i] not in ("header", "form") or bool(tree.words[i] & STRONG_WORDS) and tree.tag[i] not in ("html", "body")
    for node, piece, link in tree.pieces:
        if not gone[node] and (size := len(piece.strip())):
            text[node] += size
            links[node] += size * link
    for i in range(n - 1, 0, -1):
        text[tree.parent[i]] += text[i]
        links[tree.parent[i]] += links[i]
    return text, links


def _furniture(tree: _Tree) -> list[bool]:
    """Whether each element is page furniture or hidden, or inside of such."""
    n = len(tree.tag)
    tag, parent, words = tree.tag, tree.parent, tree.words
    inside = [False] * n  # of an article or main element
    holds = [False] * n  # an article or main element or a first heading
    leads = [False] * n  # a main element, a first heading or the page's first article
    first = next((i for i in range(1, n) if tag[i] == "article" and not words[i] & COMMENT_WORDS), 0)
    text, links = _amounts(tree) if any(w & FURNITURE_WORDS for w in words) else ([0] * n, [0] * n)
    for i in range(n - 1, 0, -1):
        if tag[i] in ("main", "h1") or i == first or leads[i]:
            leads[parent[i]] = True
        if tag[i] in ("article", "main", "h1") or holds[i]:
            holds[parent[i]] = True
    gone = [False] * n
    for i in range(1, n):
        p = parent[i]
        inside[i] = inside[p] or tag[i] in ("article", "main")
        marked = words[i] & FURNITURE_WORDS
        linked = 2 * links[i] >= text[i]
        if tag[i] in ("html", "body"):
            out = False
        elif tag[i] in ("article", "main"):
            out = bool(marked & COMMENT_WORDS)
        elif tag[i] == "header" or marked and not marked - HEADER_WORDS and tag[i] not in PARAGRAPHS | HEADINGS:
            out = not (inside[p] and holds[i])
        elif tag[i] == "form" or marked == {"form"} and tag[i] not in PARAGRAPHS | HEADINGS:
            out = not holds[i]
        elif tag[i] in FURNITURE or not marked or leads[i]:
            out = tag[i] in FURNITURE
        elif tag[i] in PARAGRAPHS | HEADINGS:
            # one paragraph is no menu, sidebar or footer
            out = bool(marked & (STRONG_WORDS if tag[i] in HEADINGS else PARAGRAPH_WORDS))
        elif marked & STRONG_WORDS:
            out = True
        elif not marked - LINK_WORDS or inside[p] and (tag[i] == "section" or not marked - MENU_WORDS):
            # kept unless it is a list of links
            out = linked
        else:
            out = inside[p] or 2 * (text[i] - links[i]) <= text[0] - links[0]  # what holds most of the page's text is no furniture
        gone[i] = gone[p] or out or tree.hidden[i]
    return gone


def scores(tree: _Tree, gone: list[bool]) -> tuple[list[float], list[int], list[int]]:
    """Points of every element, and the characters of text and of links in it.

    A paragraph (or what has text of its own) gives 1, 1 for each comma and 1 for each 100 characters, 3 at most, times the share of its text
    that is no link: all to the element around it, half to the next one, a third to the one after. What names content counts more; then the
    points are multiplied by the share of all the element's text that is no link.
    """
    n = len(tree.tag)
    tag, parent = tree.tag, tree.parent
    own, linked, commas = [0] * n, [0] * n, [0] * n
    for node, text, link in tree.pieces:
        if not gone[node] and text and (size := len(text.strip())):
            own[node] += size
            linked[node] += size * link
            commas[node] += text.count(",") + text.count("、") + text.count("，")
    score, total, links = [0.0] * n, own[:], linked[:]
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
        links[parent[i]] += links[i]
    for i in range(1, n):
        if gone[i] or not own[i] or tag[i] in HEADINGS:
            continue
        points = (1 + commas[i] + min(own[i] / 100, 3)) * (1 - linked[i] / own[i])
        up = parent[i] if tag[i] in PARAGRAPHS or tag[i] in INLINE else i
        for share in (1, 2, 3):
            if up <= 0:
                break
            score[up] += points / share
            up = parent[up]
    for i in range(1, n):
        if score[i]:
            score[i] *= (CONTENT_BONUS if tag[i] in ("article", "main") or tree.words[i] & CONTENT_WORDS else 1) * (1 - links[i] / max(total[i], 1))
    return score, total, links


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order with white space as single spaces. Null, empty and text-free pages give ''.

    Taken is the container with the most points, or one around it with nearly as many, and what lies beside it or beside an element around it, unless that is mostly
    links. So parts of an article in wrappers of their own, however deep, stay. Where the container is the page itself, lists of links go, as only there nothing tells a menu from an article's own list.
    """
    if not html:
        return ""
    tree = _Tree(html)
    n = len(tree.tag)
    tag, parent = tree.tag, tree.parent
    gone = _furniture(tree)
    score, total, links = scores(tree, gone)
    best = max(range(n), key=lambda i: (score[i], -i))
    if not score[best]:
        best = 0  # headings alone, or text outside every element
    while parent[best] > 0 and tag[parent[best]] not in ("body", "html") and score[parent[best]] >= CLIMB * score[best]:
        best = parent[best]
    whole = best == 0 or tag[best] in ("body", "html")
    around = [False] * n  # the elements that hold the container: an article's parts may lie beside it at any level
    at = best
    while at > 0 and not whole:
        at = parent[at]
        around[at] = True
    kept = [False] * n
    kept[0] = best == 0
    for i in range(1, n):
        sibling = around[parent[i]] and not around[i] and total[i] and links[i] < MOST_LINKS * total[i]
        menu = whole and tag[i] in ("ul", "ol") and total[i] and links[i] > 0.8 * total[i]
        kept[i] = (i == best or kept[parent[i]] or bool(sibling)) and not gone[i] and not menu
    wraps = [around[i] and i > 0 and tag[i] not in ("body", "html") for i in range(n)]  # whose own text stands beside the container
    return " ".join(unescape("".join(text or " " for node, text, link in tree.pieces if kept[node] or wraps[node] and not link)).split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Whole pages are parsed, however long or broken. Null or empty html gives an empty text; rows with null or
    repeated ids are kept as they are; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    found = pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
