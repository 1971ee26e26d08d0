import pytest

from twinlens.llm.html import main_text

BODY = "<p>One long sentence, with commas, about rivers and their fish, and more of it.</p>" * 3
TEXT = " ".join(["One long sentence, with commas, about rivers and their fish, and more of it."] * 3)


@pytest.mark.parametrize("mark", ["layout has-sidebar", "sidebar-right", "page search social", "with-ads", "ad-free"])
def test_a_marked_wrapper_keeps_its_article(mark):
    assert main_text(f"<body><div class='{mark}'><article>{BODY}</article></div></body>") == TEXT


def test_marked_parts_of_an_article_stay():
    page = f"<article><h1>Rivers</h1>{BODY}<h2 id='related-work'>Related work</h2><p>Earlier, others counted.</p><section id='discussion'><p>We discuss it, at length.</p></section></article>"
    assert main_text(page) == f"Rivers {TEXT} Related work Earlier, others counted. We discuss it, at length."


def test_most_of_the_text_is_no_furniture():
    assert main_text(f"<body><div class='share'><a href='x'>Share</a></div><div class='social notice'>{BODY}</div></body>") == TEXT


@pytest.mark.parametrize("part", ["<div class='comments'><article class='comment'><p>First, nice.</p></article></div>", "<section class='comments'><article><p>First, nice.</p></article></section>", "<div class='ad'><p>Buy it, now.</p></div>", "<section class='related'><a href='x'>Another page</a></section>", "<div class='sidebar'><p>Archive, tags.</p></div>"])
def test_furniture_still_goes(part):
    assert main_text(f"<body><article>{BODY}{part}</article></body>") == TEXT
    assert main_text(f"<body><article>{BODY}</article>{part}</body>") == TEXT
