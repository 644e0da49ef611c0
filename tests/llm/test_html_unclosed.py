"""Pages that leave out </head>, </button> or </select>."""

from __future__ import annotations

from cuesmith.llm.html_text import main_text

ARTICLE = "<article><h1>News</h1><p>A text that is long enough to be seen as content of the page.</p></article>"
TEXT = "News\nA text that is long enough to be seen as content of the page."


def test_head_ends_at_the_body():
    head = "<!doctype html><html><head><meta charset=utf-8><title>T</title><script>var a;</script><noscript><img src=x></noscript>"
    for page in (f"{head}<body>{ARTICLE}</body></html>", f"{head}{ARTICLE}", f"{head}</head><body>{ARTICLE}</body></html>", f"{head}<body>\n{ARTICLE}"):
        assert main_text(page) == TEXT, page
    assert main_text("<head><title>T</title>plain words of a page") == "plain words of a page"
    assert main_text("<head><title>T</title><style>p {}</style>") == ""


def test_unclosed_buttons_end_at_the_next_block():
    for page in (f"<body>\n<button>Menu\n{ARTICLE}</body>", f"<body><select><option>a<option>b{ARTICLE}</body>", f"<body><button>A<button>B{ARTICLE}<button>C</button></body>"):
        assert main_text(page) == TEXT, page
    assert main_text(f"<body>{ARTICLE.replace('</article>', '<button><div>Click</div><p>here</p></button></article>')}</body>") == TEXT
