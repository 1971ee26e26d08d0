"""Tree scoring against a plain scorer over a plain parse, and texts that must not be lost."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from twinlens.llm.html import main_text

FURNITURE = {"nav", "aside", "footer"}


class Node:
    def __init__(self, tag, words=(), parent=None):
        self.tag, self.words, self.parent, self.parts, self.points = tag, set(words), parent, [], 0.0

    def texts(self, linked=False):
        """(text, whether it is a link) of all that isn't furniture."""
        for part in self.parts:
            if isinstance(part, str):
                yield part, linked
            elif not part.gone():
                yield from part.texts(linked or part.tag == "a")

    def gone(self):
        return self.tag in FURNITURE or "ad" in self.words

    def amounts(self):
        texts = list(self.texts())
        return sum(len(t.strip()) for t, _ in texts), sum(len(t.strip()) for t, link in texts if link)

    def nodes(self):
        yield self
        for part in self.parts:
            if isinstance(part, Node):
                yield from part.nodes()

    def own(self):
        """Texts that belong to this element: its own and those of links in it."""
        for part in self.parts:
            if isinstance(part, str):
                yield part, False
            elif part.tag == "a":
                yield from ((t, True) for t, _ in part.texts())


class Plain(HTMLParser):
    def __init__(self, page):
        super().__init__()
        self.top = self.at = Node("#page")
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs).get("class", "").split(), self.at)
        self.at.parts.append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def brute(page):
    top = Plain(page).top
    elements = [n for n in top.nodes() if n.tag not in ("a", "#page") and not any(x.gone() for x in chain(n))]
    for n in elements:
        own = [(t.strip(), link) for t, link in n.own() if t.strip()]
        size = sum(len(t) for t, _ in own)
        if not size or n.tag in ("h1", "h2"):
            continue
        free = 1 - sum(len(t) for t, link in own if link) / size
        points = (1 + sum(t.count(",") for t, _ in own) + min(size / 100, 3)) * free
        up, share = (n.parent if n.tag in ("p", "li") else n), 1
        while share <= 3 and up.tag != "#page":
            up.points += points / share
            up, share = up.parent, share + 1
    for n in elements:
        size, links = n.amounts()
        n.points *= (1.25 if n.tag in ("article", "main") or "content" in n.words else 1) * (1 - links / max(size, 1))
    best = max(elements, key=lambda n: n.points, default=top)
    if not best.points:
        best = top
    while best.parent is not None and best.parent.tag not in ("#page", "body") and best.parent.points >= 0.6 * best.points:
        best = best.parent
    whole = best.tag in ("#page", "body")
    around = [] if whole else list(chain(best))[1:]
    out = []

    def tell(n):
        size, links = n.amounts()
        if n.gone() or whole and n.tag == "ul" and size and links > 0.8 * size:
            return
        for part in n.parts:
            if isinstance(part, str):
                out.append(part)
            elif part.tag == "a":
                tell(part)
            else:
                out.append(" ")
                tell(part)
                out.append(" ")

    def level(n):
        """What lies beside the container, in it and in the elements around it."""
        for part in n.parts:
            if isinstance(part, str):
                out.append(part if n.tag not in ("#page", "body") else "")
            elif part is best or part not in around and part.tag != "a" and (size := part.amounts())[0] and size[1] < 0.5 * size[0]:
                out.append(" ")
                tell(part)
                out.append(" ")
            elif part in around:
                out.append(" ")
                level(part)
                out.append(" ")

    if whole:
        tell(best)
    else:
        level(around[-1])
    return " ".join("".join(out).split())


def chain(n):
    while n is not None:
        yield n
        n = n.parent


def random_page(rng, depth=0):
    parts = []
    for _ in range(int(rng.integers(1, 4 if depth else 5))):
        kind = rng.random()
        if depth < 4 and kind < 0.45:
            tag = rng.choice(["div", "div", "section", "aside", "nav"])
            mark = rng.choice(["", "", " class='content'", " class='ad'", " class='x'"])
            parts.append(f"<{tag}{mark}>{random_page(rng, depth + 1)}</{tag}>")
        elif kind < 0.55:
            parts.append("<ul>" + "".join(f"<li><a>item {i}</a>{' of it' * int(rng.integers(0, 3))}</li>" for i in range(int(rng.integers(1, 5)))) + "</ul>")
        elif kind < 0.62:
            parts.append(f"<h2>Heading {int(rng.integers(0, 99))}</h2>")
        else:
            words = [rng.choice(["river", "fish,", "stone", "<a>link here</a>", "bank,"]) for _ in range(int(rng.integers(1, 60)))]
            parts.append(f"<p>{' '.join(words)}</p>")
    return "".join(parts)


@pytest.mark.parametrize("seed", range(60))
def test_brute_force(seed):
    page = f"<body>{random_page(np.random.default_rng(seed))}</body>"
    assert main_text(page) == brute(page), page


LONG = "A long sentence about rivers, their fish, their banks and the stones in them, told at length. " * 4


def test_nothing_of_an_article_is_lost():
    links = "<ul><li><a href=1>A study of rivers</a></li><li><a href=2>A study of banks</a></li></ul>"
    page = f"<body><nav><a>Home</a></nav><div class=post><h1>Rivers</h1><p>{LONG}</p><p class='related'>Related work counts fish.</p><p id='form'>The form is round.</p><p>So <math><mi>x</mi><mo>+</mo><mn>1</mn></math> it is.</p><h2>References</h2>{links}</div></body>"
    assert main_text(page) == f"Rivers {LONG}Related work counts fish. The form is round. So x+1 it is. References A study of rivers A study of banks"


def test_short_and_long_blocks_side_by_side():
    assert main_text(f"<div class=post><p>Short.</p></div><div class=x><p>{LONG}</p></div>") == f"Short. {LONG}".strip()


def test_divs_only():
    page = f"<body><div><div><a href=1>Home</a> <a href=2>News</a></div><div><h1>Title</h1><div><p>{LONG}</p></div><div><p>Short end.</p></div></div><div class=footer>Imprint</div></div></body>"
    assert main_text(page) == f"Title {LONG}Short end."
    assert main_text("<body><ul><li><a>Home</a></li></ul><p>Alone.</p></body>") == "Alone."


def test_time_grows_with_the_page():
    def took(page):
        best = 9.0
        for _ in range(3):
            began = time.process_time()
            main_text(page)
            best = min(best, time.process_time() - began)
        return best

    for part in ("<script>x</script><p>a</p>", "<![CDATA[ a <p>b</p>", "<svg><p>a</svg>", "<p class='x>y</p>", "<div><b>a"):
        assert took(part * 20000) < 16 * max(took(part * 2500), 0.01), part


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_wrapped_paragraphs_of_the_given_pages(spark, small, depth):
    """Each paragraph in wrappers of its own: the text is the same."""
    import re

    pages = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect() if r["html"]]
    pages = [p for p in pages if "<article" in p][:60]
    for page in pages:
        head, start, rest = page.partition("<article")
        body, end, tail = rest.rpartition("</article>")
        wrapped = re.sub(r"<p>(.*?)</p>", lambda m: "<div>" * depth + m[0] + "</div>" * depth, body, flags=re.DOTALL)
        for tag in ("article", "div"):
            before = (head + start + body + end + tail).replace("<article", f"<{tag}").replace("</article>", f"</{tag}>")
            after = (head + start + wrapped + end + tail).replace("<article", f"<{tag}").replace("</article>", f"</{tag}>")
            assert main_text(after) == main_text(before)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div><div><p>{0}</p></div></div><div><div><p>Second {0}</p></div></div>", "{0} Second {0}"),
        ("<div class=page><div class=col><div><p>{0}</p></div></div><div class=col><div><p>Second {0}</p></div></div></div>", "{0} Second {0}"),
        ("<div><p>Before it.</p><div><div><div><p>{0}</p><p>{0}</p></div></div></div></div>", "Before it. {0} {0}"),
        ("<div><div><h1>Title</h1></div><div><div><p>{0}</p></div></div></div>", "Title {0}"),
        ("<article><p>{0}</p><div class=menu><p>The menu of the inn has fish, and bread.</p></div><div class=search><p>The search went on.</p></div><p class=reply>She gave no reply.</p></article>", "{0} The menu of the inn has fish, and bread. The search went on. She gave no reply."),
        ("<article><p>{0}</p><div class=menu><a href=1>Home</a> <a href=2>News</a></div></article>", "{0}"),
        ("<nav><a>Home</a></nav><div><div class=sidebar><p>Archive.</p></div><div><div><p>{0}</p></div></div></div><footer>Imprint</footer>", "{0}"),
    ],
)
def test_known_article_text(page, want):
    assert main_text("<body>" + page.format(LONG.strip()) + "</body>") == want.format(LONG.strip())
