"""A marked block has one verdict whatever its length."""

from __future__ import annotations

import pytest

from cuesmith.llm.html_text import main_text

SENTENCE = "A sentence of plain words that could stand in any story of the day. "
STORY = "".join(f"<p>{SENTENCE * 3}</p>" for _ in range(4))
WANT = "T\n" + "\n".join([(SENTENCE * 3).strip()] * 4)
NAV = "<div class=top><a href=/>Home</a> <a href=/a>About</a></div><ul><li><a href=/b>One</a><li><a href=/c>Two</a><li><a href=/d>Three</a></ul>"
MARKED = "ad-container ad-slot promo-box related-stories newsletter-signup subscribe-box site-notice cookie-bar sidebar-left sponsored-content post-comments gdpr paywall site-header share-bar social-links ad_unit_2 widget".split()


@pytest.mark.parametrize("name", MARKED)
@pytest.mark.parametrize("many", [1, 2, 4, 40])
def test_marked_blocks_go(name, many):
    block = f"<div class='{name}'><p>{SENTENCE * many}</p></div>"
    half = STORY.replace("</p><p>", f"</p>{block}<p>", 1)
    assert main_text(f"<body>{NAV}<article><h1>T</h1>{half}</article></body>") == WANT
    assert main_text(f"<body>{NAV}<article><h1>T</h1>{STORY}</article>{block}</body>") == WANT
    assert main_text(f"<body>{NAV}{block}<article><h1>T</h1>{STORY}</article></body>") == WANT
    assert main_text(f"<body>{NAV}<div><h1>T</h1>{STORY}</div>{block}</body>") == WANT


@pytest.mark.parametrize("name", ["notice-board", "social-history", "has-sidebar", "page-with-comments", "layout-sidebar-left", "article-header", "reading", "adventure", "no-ads"])
@pytest.mark.parametrize("many", [1, 2, 4, 40])
def test_what_is_named_otherwise_stays(name, many):
    block = f"<div class='{name}'><p>{SENTENCE * many}</p></div>"
    out = main_text(f"<body>{NAV}<article><h1>T</h1>{STORY}{block}</article></body>")
    assert out == WANT + "\n" + (SENTENCE * many).strip()
