"""What the smoothed ratios and their threshold decide, and a plain version of the method."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cuesmith.llm import html_text
from cuesmith.llm.html_text import main_text

PARA = "<p>A paragraph of the story that is long enough to stand out from whatever surrounds it, with words of its own.</p>"
WORDS = "A paragraph of the story that is long enough to stand out from whatever surrounds it, with words of its own."
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>A linked headline of some length number {i}</a></li>" for i in range(20)) + "</ul>"


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]


def test_scores_decide(pages, monkeypatch):
    texts = [main_text(h) for h in pages]
    with monkeypatch.context() as m:
        m.setattr(html_text.Page, "scores", lambda self: [1.0] * len(self.texts))
        assert sum(main_text(h) != t for h, t in zip(pages, texts, strict=True)) > 0.9 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_text, "_threshold", lambda scores: math.inf)
        assert not any(map(main_text, pages))


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div id=x>{}</div>", "<div class=post><div class=body>{}</div></div>", "{}"])
def test_unmarked_lists_of_links_and_adverts_go(around):
    nav = "<body><div>" + "".join(f"<a href=/{i}>menu {i}</a> " for i in range(9)) + "</div>"
    want = "\n".join(["Title", WORDS, WORDS, "Short one.", WORDS])
    for middle in (LINKS, "<div>" + LINKS + "</div>", "<div><a href=/buy>Buy the new thing now, at half its price</a></div>", "<div><a href=/a><b>Offer</b></a> <a href=/b>Order now</a></div>"):
        page = nav + around.format(f"<h1>Title</h1>{PARA}{PARA}{middle}<p>Short one.</p>{PARA}") + "<footer>All rights</footer>"
        assert main_text(page) == want, page
        assert main_text(page.replace(middle, "").replace("<h1>", middle + "<h1>")) == want


def test_comments_go():
    comment = "<p>I read this twice and must say that it is the best that I have seen on the subject in many years of reading.</p>"
    story = f"<article><h1>Title</h1>{PARA}<p>End.</p>"
    want = f"Title\n{WORDS}\nEnd."
    for page in (
        f"<body>{story}</article><article>{comment * 6}</article>",
        f"<body>{story}<article>{comment * 6}</article><article>{comment}</article></article>",
        f"<body>{story}</article><section id=comments>{comment * 6}</section>",
        f"<body>{story}<h2>3 Comments</h2>{comment * 3}</article>",
        f"<body>{story}<div class='comment-list'>{comment * 3}</div></article>",
        f"<body><div><h1>Title</h1>{PARA}<p>End.</p></div><div><h3>Comments (2)</h3><div>{comment}</div><div>{comment}</div></div>",
    ):
        assert main_text(page) == want, page


def test_prose_in_containers_of_doubtful_names_stays():
    for name in ("notice-board", "share", "social-history", "related"):
        assert main_text(f"<body><nav><a href=/>Home</a></nav><article><h1>T</h1><section class={name}>{PARA}{PARA}</section></article>") == f"T\n{WORDS}\n{WORDS}"
    assert main_text(f"<body><article><h1>T</h1>{PARA}<div class=share-box>Tell a friend</div>{PARA}</article>") == f"T\n{WORDS}\n{WORDS}"


def test_divs_as_paragraphs_and_tables():
    assert main_text(f"<body><div>menu</div><div id=c><div>{WORDS}</div><div>Yes.</div><div>{WORDS}</div></div>").endswith(f"{WORDS}\nYes.\n{WORDS}")
    assert main_text(f"<article><header><h1>T</h1></header><div>{PARA}</div><table><tr><th>k<td>v</table></article>").startswith(f"T\n{WORDS}")


def plain_content(page: html_text.Page) -> list[bool]:
    """The method written out over whole arrays: every pair of lines for the smoothing, every cut for the two clusters."""
    n = len(page.texts)
    own = np.array([page.worths[i] * max(0, len(page.texts[i]) - page.linked[i]) for i in range(n)])
    ratio = np.log1p(own / np.array(page.tags))
    apart = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    near = (apart <= html_text.REACH) & np.array([[(page.homes[i], page.worths[i]) == (page.homes[j], page.worths[j]) for j in range(n)] for i in range(n)])
    weight = np.where(near, np.exp(-(apart**2) / (2 * html_text.SIGMA**2)), 0)
    score = weight @ ratio / weight.sum(1)
    low, high = score.min(), score.max()
    for _ in range(20):
        above = score >= (low + high) / 2
        if above.all():
            high = low
            break
        low, high = score[~above].mean(), score[above].mean()
    marked = (score >= (low + high) / 2) & (score > 0)

    def around(block):
        while block:
            yield block
            block = page.above[block]
        yield 0

    holding = {b for i in range(n) if marked[i] for b in around(page.homes[i])}
    direct = {page.homes[i] for i in range(n) if marked[i]}
    out = []
    for i in range(n):
        tag = page.tag_of[page.blocks[i]]
        outer = next(b for b in around(page.above[page.homes[i]]) if not b or page.tag_of[b] in html_text.HOMES)
        beside = page.homes[i] in direct or tag in html_text.HEADINGS and (page.homes[i] in holding or tag == "h1" and outer in holding)
        out.append(bool(marked[i] or page.worths[i] == 1 and 2 * page.linked[i] < len(page.texts[i]) and beside))
    return out


def test_like_the_plain_version(pages):
    made = [f"<body>{LINKS}<div><h2>x</h2>{PARA}</div><td>{PARA}{LINKS}</td>", f"<div class=ad-box>{PARA}</div><p>b</p>{PARA}", "<h1>only</h1>"]
    for h in pages + made:
        page = html_text.Page(h)
        assert page.content() == plain_content(page)
