"""Main text of HTML pages from streamed parser events.

The standard library's parser sends start, end and text events; they become
lines (runs of text between block-level tags), each with the number of its
characters, tags and linked characters.  A line's score is its text-to-tag ratio
on a log scale, where linked characters and those in elements that are never
content count nothing.  Scores are smoothed along the page with a Gaussian that
stays within a container, and the threshold between the two clusters of smoothed
scores marks content lines.  The page's text is the marked lines, and those short
lines without links that stand beside marked ones in their own container.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import slices

# HTML's block-level elements, elements without text of their own,
# void elements, and elements and roles that are never content.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("head script style template noscript iframe object svg math canvas audio video select button textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
# Classes and ids of such elements as a whole, and of reader comments; words within a class or id that only speak against content.
NEVER = frozenset("ad ads advert adverts advertisement advertising sponsored masthead breadcrumb breadcrumbs nav navbar navigation menu pagination pager footer sidebar consent cookie cookies cookie-banner cookie-notice notice notices newsletter popup modal".split())
COMMENTS = frozenset("comment comments comment-list comments-area commentlist disqus disqus_thread reader-comments replies respond".split())
AGAINST = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pagination paywall popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe subscription widget".split())
# Those that speak against content beside any word, and words that say nothing of it beside the others.
CLEARLY = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr navbar newsletter pagination paywall popup promo promoted sidebar sponsored subscribe".split())
PLAIN = frozenset("a article articles area bar block body bottom box btn button buttons card column container content entry form group inner item items left link links list main news outer overlay page pane panel post posts primary right row secondary section signup site slot stories story strip the top unit wrap wrapper zone".split())
# Words that tell of a page's state or plan instead of the element's kind.
STATES = frozenset("has with without no is show hide layout".split())
COMMENT_HEADING = re.compile(r"\W*(?:\d+\W+)?(?:reader |user )?(?:comments?|responses|replies|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)(?:\W+\d+)?\W*", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers of lines; a cell counts as one only for the blocks inside it.
HOMES = frozenset("article main section div body td th".split())
#: A p is closed by these starting; li, dt, dd, tr, td, th and option by their like.
CLOSES_P = BLOCKS - {"body", "caption", "dd", "dt", "head", "html", "legend", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "li"} | {"li", "dd", "dt"}
LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What a head may hold; anything else starts the body, as </head> and <body> may be left out.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Silent elements that a page may fail to close: the next tag of their name tells.
UNCLOSED = {tag: re.compile(rf"<(/?){tag}\b", re.I) for tag in ("button", "select")}
SIGMA, REACH = 1.0, 3
#: Bytes of pages that are taken together.
PART = 1 << 20
KERNEL = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]


def _speaks_against(tag: str, name: str) -> bool:
    """Whether a class or id marks its element as no content, however long it is:
    by a clear word, or where all its words are marks or say nothing.  A section
    named by one unclear word alone may be content, as may what is named by a word
    of another kind (a social-history)."""
    words = {w for w in re.split(r"[-_]+|\d+", name) if w}
    marks = words & AGAINST
    if "header" in words and words & {"site", "global", "top"} and not words & STATES:
        return True
    if not marks or words & STATES:
        return False
    return bool(marks & CLEARLY) or words <= AGAINST | PLAIN and not (tag == "section" and len(words) == 1)


def _worth(tag: str, attrs: list[tuple[str, str | None]], in_story: bool) -> float:
    """What a character inside the element counts for: 0 or 1."""
    if tag in BOILER or tag == "header" and not in_story:
        return 0.0
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in BOILER_ROLES:
            return 0.0
        if name in ("class", "id") and value and tag not in ("html", "body", "main"):
            names = value.lower().split()
            if not COMMENTS.isdisjoint(names) or tag != "article" and not NEVER.isdisjoint(names) or "header" in names and not in_story:
                return 0.0
            if tag != "article" and any(_speaks_against(tag, n) for n in names):
                return 0.0
    return 1.0


class Lines(HTMLParser):
    """Lines as (text, tags, linked characters, innermost block, worth).

    Blocks are numbered as they open; ``above``, ``home`` and ``tag_of`` have each
    one's enclosing block, its innermost container and its tag (0: none)."""

    def __init__(self, page: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.starts = page, [0]  # and where each line of it starts, as needed
        self.loose: list[int] = []  # depths of open elements of UNCLOSED without an end tag
        self.lines: list[tuple[str, int, int, int, float]] = []
        self.open: list[tuple[str, int, bool, float]] = []  # tag, innermost block, silent, worth
        self.count: Counter[str] = Counter()  # of open elements by tag
        self.above, self.home, self.tag_of = [0], [0], [""]
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        words = "".join(self.text).split()
        if words:
            block, worth = (self.open[-1][1], self.open[-1][3]) if self.open else (0, 1.0)
            self.lines.append((" ".join(words), self.tags, self.linked, block, worth))
        if words or self.tags:
            self.text, self.tags, self.linked = [], 0, 0

    def is_unclosed(self, tag: str) -> bool:
        line, offset = self.getpos()
        while len(self.starts) < line:
            self.starts.append(self.page.index("\n", self.starts[-1]) + 1)
        after = UNCLOSED[tag].search(self.page, self.starts[line - 1] + offset + 1)
        return not (after and after.group(1))

    def end_head(self) -> None:
        self.flush()
        self.cut(next(i for i, x in enumerate(self.open) if x[0] == "head"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.count["head"] and tag not in IN_HEAD and (self.open[-1][0] == "head" or tag == "body" and not self.count["template"]):
            self.end_head()
        if tag in BLOCKS:
            self.flush()
            if self.loose and tag not in ("option", "legend"):
                self.cut(self.loose[0])
            if tag in CLOSES_P:
                self.close_to(("p",), stop=("table", "td", "th", "button"))
            if tag in LIKE:
                self.close_to(LIKE[tag], stop=("ul", "ol", "dl", "table", "select", "menu"))
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ")
            return
        _, block, silent, worth = self.open[-1] if self.open else ("", 0, False, 1.0)
        # An article's own header holds its title.
        worth = min(worth, _worth(tag, attrs, bool(self.count["article"] or self.count["main"])))
        if tag in BLOCKS:
            self.above.append(block)
            self.home.append(len(self.above) - 1 if tag in HOMES else self.home[block])
            self.tag_of.append(tag)
            block = len(self.above) - 1
        if tag in UNCLOSED and self.is_unclosed(tag):
            self.loose.append(len(self.open))
        self.open.append((tag, block, silent or tag in SILENT, worth))
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID or not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if self.open[-1][1] != (self.open[i - 1][1] if i else 0):
                    self.flush()
                self.cut(i)
                return
            if self.open[i][0] in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag doesn't close a block

    def close_to(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self.cut(i)
            elif self.open[i][0] in stop or self.open[i][0] in BLOCKS:
                return

    def cut(self, at: int) -> None:
        self.count.subtract(x[0] for x in self.open[at:])
        del self.open[at:]
        while self.loose and self.loose[-1] >= at:
            self.loose.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.end_head()
        if not (self.open and self.open[-1][2]):
            self.text.append(data)
            if self.count["a"] > 0:
                self.linked += len(data.strip())


def _smoothed(scores: list[float], stretch: list[tuple]) -> list[float]:
    """Gaussian means of the scores; only lines of the same stretch are near each other."""
    n, out = len(scores), []
    for i in range(n):
        total = weight = 0.0
        for j in range(max(0, i - REACH), min(n, i + REACH + 1)):
            if stretch[j] == stretch[i]:
                total += KERNEL[j - i + REACH] * scores[j]
                weight += KERNEL[j - i + REACH]
        out.append(total / weight)
    return out


def _threshold(scores: list[float]) -> float:
    """The middle of the two means that a two-cluster split settles on."""
    low, high = min(scores), max(scores)
    for _ in range(20):
        middle = (low + high) / 2
        below, above = [s for s in scores if s < middle], [s for s in scores if s >= middle]
        if not below:
            return low
        means = sum(below) / len(below), sum(above) / len(above)
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


class Page:
    """A page's lines with what each one's characters count for."""

    def __init__(self, html: str) -> None:
        parser = Lines(html)
        parser.feed(html)
        parser.close()
        parser.flush()
        self.above, self.home, self.tag_of = parser.above, parser.home, parser.tag_of
        self.texts = [x[0] for x in parser.lines]
        self.tags = [max(1, x[1]) for x in parser.lines]
        self.linked = [x[2] for x in parser.lines]
        self.blocks = [x[3] for x in parser.lines]
        self.worths = [x[4] for x in parser.lines]
        # A block's number is larger than those of the blocks around it, and those inside it follow it.
        self.last = list(range(len(self.above)))
        for block in range(len(self.above) - 1, 0, -1):
            self.last[self.above[block]] = max(self.last[self.above[block]], self.last[block])
        self.after_comment_headings()
        self.within_the_story()
        self.homes = self.homes_of_lines()

    def own(self, i: int) -> float:
        return self.worths[i] * max(0, len(self.texts[i]) - self.linked[i])

    def inside(self, i: int, block: int) -> bool:
        return block <= self.blocks[i] <= self.last[block]

    def masses(self) -> list[float]:
        """Counted characters in each block."""
        mass = [0.0] * len(self.above)
        for i, block in enumerate(self.blocks):
            mass[block] += self.own(i)
        return self.summed(mass)

    def summed(self, each: list[float]) -> list[float]:
        for block in range(len(each) - 1, 0, -1):
            each[self.above[block]] += each[block]
        return each

    def after_comment_headings(self) -> None:
        """From a heading of reader comments to the end of its container nothing counts."""
        until, home = -1, 0
        for i, block in enumerate(self.blocks):
            if block > until and self.tag_of[block] in HEADINGS and len(self.texts[i]) < 60 and COMMENT_HEADING.fullmatch(self.texts[i]):
                home = self.home[block]
                until = self.last[home]
            if home <= block <= until or until >= 0 and not home:
                self.worths[i] = 0.0

    def within_the_story(self) -> None:
        """Where an article (or else main) is the page's story, nothing outside it
        counts, nor do articles within it that have no h1 of their own."""
        mass, titled = self.masses(), [0.0] * len(self.above)
        for block, tag in enumerate(self.tag_of):
            titled[block] += tag == "h1"
        self.summed(titled)
        for kind in ("article", "main"):
            found, past = [], 0
            for block, tag in enumerate(self.tag_of):
                if tag == kind and block > past and mass[block]:
                    found.append(block)
                    past = self.last[block]
            if found:
                story = max(found, key=lambda e: (titled[e] > 0, mass[e], -e))
                if mass[story] * (10 if titled[story] else 2) >= mass[0]:
                    replies = [e for e, tag in enumerate(self.tag_of) if tag == "article" and story < e <= self.last[story] and titled[story] and not titled[e]]
                    apart, past = [0] * len(self.above), -1
                    for e in replies:
                        if e > past:
                            past = self.last[e]
                            apart[e : past + 1] = [1] * (past + 1 - e)
                    for i, block in enumerate(self.blocks):
                        if not self.inside(i, story) or apart[block]:
                            self.worths[i] = 0.0
                return

    def homes_of_lines(self) -> list[int]:
        """Each line's container.  Text right in a cell belongs to the table's, text
        right in a div to the one around it, if that has no paragraphs of its own."""
        of, paragraphs = [], set()
        for block in self.blocks:
            around = self.home[self.above[block]] if self.tag_of[block] in ("td", "th") else self.home[block]
            of.append(around)
            if self.tag_of[block] == "p":
                paragraphs.add(around)
        for i, block in enumerate(self.blocks):
            if self.tag_of[block] == "div" and (around := self.home[self.above[block]]) not in paragraphs:
                of[i] = around
        return of

    def scores(self) -> list[float]:
        """Smoothed text-to-tag ratios, on a log scale: one very long paragraph does not hide the others."""
        ratios = [math.log1p(self.own(i) / self.tags[i]) for i in range(len(self.texts))]
        return _smoothed(ratios, list(zip(self.homes, self.worths, strict=True)))

    def content(self) -> list[bool]:
        """Which lines are the page's text."""
        scores = self.scores()
        limit = _threshold(scores)
        marked = [s >= limit and s > 0 for s in scores]
        holds = [0.0] * len(self.above)
        for i, own in enumerate(marked):
            holds[self.homes[i]] += own
        beside = {h for h, n in enumerate(holds) if n}
        self.summed(holds)
        kept = []
        for i, own in enumerate(marked):
            plain = self.worths[i] == 1 and 2 * self.linked[i] < len(self.texts[i])
            home, tag = self.homes[i], self.tag_of[self.blocks[i]]
            title = tag in HEADINGS and (holds[home] or tag == "h1" and holds[self.home[self.above[home]]])
            kept.append(own or plain and bool(home in beside or title))
        return kept


def main_text(html: str | None) -> str:
    """The page's main text, one line for each block; empty if there is none."""
    page = Page(html or "")
    return "\n".join(t for t, kept in zip(page.texts, page.content(), strict=True) if kept) if page.texts else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    text: content lines in page order, white space inside a block
    as one space, joined by line feeds; empty for a null or empty page or one
    without content.  n_chars: its code points.  Nulls in other columns pass
    through, repeated rows give repeated rows, an empty table an empty result;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 2, PART):
                texts = [main_text(x.as_py()) for x in rows.column(2)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
