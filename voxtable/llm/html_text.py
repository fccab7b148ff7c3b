"""Main text of web pages by text-to-tag ratios.

The standard library's HTML parser streams events; a page becomes lines, one for
each block-level run of text, with the number of tags met in it and the block
that contains it. Lines in elements whose tag or role is of the page's frame by
definition (menus, footers, side columns, forms) are set aside. The others' ratio of
text to tags, where link text counts as tags, is weighted by hints: more inside
article or main, less inside elements with frame words in their class or id. The
weighted ratios are smoothed along the page by a Gaussian and split in two clusters,
and a region, the nearest article, main or other containing block, is content when
lines of the upper cluster hold at least half of its text. All lines of a content
region are kept, whatever their own ratio, so that short paragraphs and headings
stay; a small region inside a kept one follows it, and a single line of the upper
cluster is kept outside any.

A class or id word alone does not remove an element: one that holds all articles
and main parts of the page, and its top headings or half of its text, is the page and
not its frame. On a page without any it is one that holds all top headings and a quarter of the text, and without these half
of the text. Other elements with such words are frames, as comments are whatever
their length.

Frames inside a line, as buttons, choices, hidden parts and parts of a line with frame words, take
their own text out of it and leave the line whole.

Character references are decoded, white space inside a line becomes one space,
lines are trimmed and joined by line feeds in page order.

Defined cases: a null or empty page gives an empty text; malformed markup (open
paragraphs, missing end tags, cut-off pages) is read as far as it goes, where a comment or
tag without an end reaches to the end of the page; a page
of one line keeps it; text outside any block belongs to the page's own region;
repeated rows are extracted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text.
SILENT = frozenset("script style noscript template head title svg iframe object canvas audio video map".split())
#: Their text belongs to the page's frame.
FRAME = frozenset("nav header footer aside form button select option textarea menu dialog fieldset label datalist output progress".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar status note".split())
#: Words of class and id names.
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay "
    "comment comments commentlist disqus reply replies respond reader "
    "share sharing social related recommended newsletter subscribe subscription signup login search widget widgets pagination pager".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Parts of a line; frame words of theirs set their own text aside.
INLINE = frozenset("a abbr b bdi bdo cite code data em font i ins kbd mark q s small span strong sub sup time tt u var".split())
#: Blocks that can be a region of their own.
REGIONS = frozenset("article main section div body td blockquote center table".split())
CONTENT = frozenset(("article", "main"))
#: An opening tag ends open elements of these kinds inside the same block.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: A paragraph ends where these begin.
ENDS_P = BLOCKS - frozenset("body html caption dd dt frameset legend li optgroup option summary tbody td tfoot th thead title tr".split())
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")
SIGMA = 1.0


#: Weight of a line's ratio inside article or main; a line elsewhere has 1.
CONTENT_WEIGHT = 6.0
#: The first of them marks the page's main part.
TITLES = ("h1", "h2", "h3", "h4", "h5", "h6")


def _frame(tag: str, attrs: list, inside: bool) -> tuple[bool, bool]:
    """(the element is a frame by its tag or attributes, its class or id has frame words); ``inside``: of an article or main, whose header holds its title."""
    if tag in FRAME and not (tag == "header" and inside):
        return True, False
    words = False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if value and name == "role" and value.lower() in FRAME_ROLES:
            return True, False
        if value and name in ("class", "id") and tag not in ("html", "body"):
            words = words or not FRAME_WORDS.isdisjoint(WORDS.findall(value.lower()))
    return False, words


class Lines(HTMLParser):
    """Collects (text, tags, link characters, region, suspect, title) of each line outside frames.

    Regions know the one around them and the article or main they are in; suspects,
    elements with frame words, know the one around them and the main parts and top
    headings in them. Open elements are found by their tag's and the
    blocks' own stacks, so a page takes linear time however deep it nests.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int, int]] = []  # tag, silent, frame, region, suspect
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag
        self.blocks: list[int] = []  # places of open blocks
        self.firm: list[int] = []  # and of those that are no paragraphs
        self.kinds = ["page"]  # of each region
        self.above = [0]
        self.article = [0]
        self.suspects = [0]  # the suspect around each
        self.parts = [0]  # articles and main parts in each, inner suspects left out
        self.heads = [0]  # and top headings
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0

    def state(self) -> tuple[bool, bool, int, int]:
        return self.open[-1][1:] if self.open else (False, False, 0, 0)

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            *_, region, suspect = self.state()
            self.lines.append((text, self.tags, self.linked, region, suspect, any(self.last(t) >= 0 for t in TITLES)))
        self.text, self.tags, self.linked = [], 0, 0

    def last(self, tag: str) -> int:
        own = self.places.get(tag)
        return own[-1] if own else -1

    def pop(self, at: int) -> None:
        # Blocks inside a frame are not of the line around it.
        if any(x[0] in BLOCKS and not (k and self.open[k - 1][2]) for k, x in enumerate(self.open[at:], at)):
            self.end_line()
        for tag, *_ in reversed(self.open[at:]):
            self.places[tag].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        while self.firm and self.firm[-1] >= at:
            self.firm.pop()
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P else ())
        if closes:
            at = max(map(self.last, closes))
            if at >= 0 and (not self.firm or self.firm[-1] <= at):
                self.pop(at)
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS and not self.state()[1]:
            self.end_line()
        if tag in VOID:
            return
        silent, around, region, suspect = self.state()
        hard, words = _frame(tag, attrs, bool(self.article[region]))
        frame = around or hard or words and tag in INLINE
        if tag in REGIONS:
            self.kinds.append(tag)
            self.above.append(region)
            self.article.append(len(self.kinds) - 1 if tag in CONTENT and not words and not self.article[region] else self.article[region])
            region = len(self.kinds) - 1
        if words and not frame:
            for column, value in ((self.suspects, suspect), (self.parts, 0), (self.heads, 0)):
                column.append(value)
            suspect = len(self.suspects) - 1
        elif not frame and not silent:
            self.parts[suspect] += tag in CONTENT
            self.heads[suspect] += tag == TITLES[0]
        place = len(self.open)
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCKS and not around:
            self.blocks.append(place)
            if tag != "p":
                self.firm.append(place)
        self.open.append((tag, silent or tag in SILENT, frame, region, suspect))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self.last(tag)
        if at >= 0:
            if tag in BLOCKS or not self.blocks or self.blocks[-1] < at:  # an inline end tag does not reach out of its block
                self.pop(at)
        elif tag == "p":
            self.end_line()

    def handle_data(self, data: str) -> None:
        silent, frame, *_ = self.state()
        if not silent and not frame:
            self.text.append(data)
            if any(x[0] == "a" for x in self.open[-4:]):
                self.linked += len(data)

    def close(self) -> None:
        # A comment or tag that never ends holds the rest of the page, as in the HTML standard. The parser
        # has looked for its end once; left to it, it would look again from each bracket inside.
        if re.match("<[A-Za-z/!?]", self.rawdata):
            self.rawdata = ""
        super().close()
        self.end_line()

    def frames(self) -> list[bool]:
        """Which suspects, or those around them, are frames after all."""
        own, parts, heads = [0] * len(self.suspects), self.parts[:], self.heads[:]
        for text, _, linked, _, suspect, _ in self.lines:
            own[suspect] += max(0, len(text) - linked)
        for k in range(len(own) - 1, 0, -1):  # inner ones come later
            for column in (own, parts, heads):
                column[self.suspects[k]] += column[k]

        def spared(k: int) -> bool:
            if parts[0]:
                return parts[k] == parts[0] and (heads[k] == heads[0] or 2 * own[k] >= own[0])
            return heads[k] == heads[0] and 4 * own[k] >= own[0] if heads[0] else 2 * own[k] >= own[0]

        out = [False]
        for k in range(1, len(own)):
            out.append(out[self.suspects[k]] or not spared(k))
        return out


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian of three sigma to either side, weights renormalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    # The ends have fewer neighbours.
    padded = np.pad(ratios, reach)
    weight = np.pad(np.ones(len(ratios)), reach)
    return np.convolve(padded, kernel, "valid") / np.convolve(weight, kernel, "valid")


def threshold(values: np.ndarray) -> float:
    """The value that splits a list into two clusters (means by alternation); the least if all are alike."""
    low, high = float(values.min()), float(values.max())
    if high <= 1.5 * low:
        return low
    for _ in range(50):
        cut = (low + high) / 2
        a, b = float(values[values < cut].mean()) if (values < cut).any() else low, float(values[values >= cut].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


def extract(html: str) -> str:
    """The main text of a page."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    frames = parser.frames()
    lines = [x for x in parser.lines if not frames[x[4]]]
    if not lines:
        return ""
    kinds, article = parser.kinds, parser.article
    own = [article[x[3]] or x[3] for x in lines]
    ratios = np.array([(CONTENT_WEIGHT if article[r] else 1.0) * max(0, len(t) - linked) / (1 + tags + linked / 20) for t, tags, linked, r, _, _ in lines])
    smoothed = smooth(ratios)
    split = threshold(smoothed)
    # A box beside long text is lifted by it alone; a title may be.
    upper = (smoothed >= split) & ((ratios >= split / 4) | np.array([x[5] or article[x[3]] > 0 for x in lines]))
    total: dict[int, int] = {}
    good: dict[int, int] = {}
    for (t, *_), r, u in zip(lines, own, upper):
        total[r] = total.get(r, 0) + len(t)
        good[r] = good.get(r, 0) + len(t) * bool(u)
    largest = max(total, key=lambda r: (article[r] > 0, total[r]))
    kept = {r for r in total if 2 * good[r] >= total[r]} or {largest}
    if article[largest]:  # short articles on pages of long lines
        kept.add(largest)
    # The kept region that each region is in; regions around others come first.
    inside: list[int | None] = []
    for r, around in enumerate(parser.above):
        inside.append(r if r in kept else inside[around] if r else None)
    linked: dict[int, int] = {}
    for (_, _, n, *_), r in zip(lines, own):
        linked[r] = linked.get(r, 0) + n

    def stays(r: int, u: bool) -> bool:
        q = inside[r]
        return r in kept or u and not article[r] or q is not None and 10 * total[r] <= total[q] and 2 * linked[r] < total[r]

    return "\n".join(t for (t, *_), r, u in zip(lines, own, upper) if stays(r, bool(u)))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``; one pass, no shuffle."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py() or "") for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, T.StructType([rows.schema["page_id"], rows.schema["url"]]).add("text", T.StringType()).add("n_chars", T.LongType()))
