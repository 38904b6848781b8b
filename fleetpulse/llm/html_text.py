"""Main text of web pages from streamed parser events, text-to-tag ratios and smoothed clustering.

A page is fed to the standard library's parser in chunks. Its events become lines, one for each block element, each with
its number of text characters and of tags. Lines inside navigation, adverts, forms, reader comments and the like are
boilerplate by their elements. Over the remaining lines the text-to-tag ratio is smoothed by a Gaussian and split into
two clusters by a threshold; the lines of the upper cluster choose the content region: the article or main around the innermost
region element that holds most of their text, or, where there is none, the innermost div or body that
holds all of them (a section is a part of its article). Every line of that region that isn't boilerplate is kept, short paragraphs between long ones included.

Headings are boilerplate by no mark, and inside an article an id counts only if all its words are marks. An article inside another
article or main whose class or id has marks alone (``comment``) is boilerplate. A form that holds more than half of the text isn't furniture.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed, joined by one line
break and never dropped or shortened otherwise. Null or empty pages, and pages without a content line, give an empty text. An
empty table stays empty, repeated rows give the same text, very long pages are fed chunk by chunk. Other input columns
pass through, but for one with the name of the output column, which is replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import free_name, importable

CHUNK = 1 << 16
# Elements by their part in a page.
NO_TEXT = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea button datalist title".split())
FURNITURE = frozenset("nav footer aside dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGION = frozenset("article main section div body".split())
BLOCK = REGION | NO_TEXT | FURNITURE | frozenset(
    "form html p h1 h2 h3 h4 h5 h6 header hgroup ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption "
    "address details summary fieldset legend hr center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening element ends, up to the nearest of the second set.
ENDS = {
    "p": ({"p"}, BLOCK - {"p"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Words of class, id, role or label attributes that mark an element as no part of the article.
MARKS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar sidebar aside rail widget footer masthead ad ads "
    "adv advert adverts advertisement adsense adslot banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist respond reply "
    "replies disqus discussion share sharing social related recommended recommendations trending popular outbrain taboola skip "
    "complementary contentinfo search dialog alertdialog toast paywall disclaimer".split()
)
HEADER_MARKS = frozenset("header topbar".split())
#: In a class such as ``no-sidebar`` or ``with-comments`` the mark says what stands beside the element.
UNMARKS = frozenset("no with without has".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class PageLines(HTMLParser):
    """Collects lines as (text, number of tags, chain of region elements, number of the form around them or 0)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], int]] = []
        self.open: list[tuple[str, bool, int]] = []  # element, whether it hides its text, region number or -1
        self.hidden, self.regions, self.kinds = 0, (0,), ["page"]
        self.forms, self.form, self.depth = 0, 0, 0
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        line = " ".join("".join(self.text).split()) if self.text else ""
        if line:
            self.lines.append((line, self.tags, self.regions, self.form))
        if line or not self.text:
            self.tags = 0
        self.text = []

    def hides(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NO_TEXT or tag in FURNITURE:
            return True
        in_article = any(t in ("article", "main") for t, _, _ in self.open)
        if tag == "header" and not in_article:
            return True
        if tag in ("html", "body", "main") or (tag == "article" and not in_article):
            return False
        for name, value in attrs:
            if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and value and re.search(r"display\s*:\s*none", value):
                return True
            if name in ("class", "id", "role", "aria-label") and value and tag not in HEADINGS:
                for token in value.split():
                    words = {w.lower() for w in WORDS.findall(token)}
                    if in_article and (name == "id" or tag == "article") and not words <= MARKS:
                        continue
                    if not words & UNMARKS and (words & MARKS or (words & HEADER_MARKS and not in_article)):
                        return True
        return False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            self.end_open("p", BLOCK - {"p"}) if tag not in ("p", "html", "body") else None
        if tag in ENDS:
            own, up_to = ENDS[tag]
            for t in own:
                self.end_open(t, up_to)
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "img", "hr", "wbr"):
                self.text.append(" " if tag != "wbr" else "")
            return
        if tag in ("td", "th"):
            self.text.append(" ")
        if tag in BLOCK or tag not in INLINE:
            hides = self.hides(tag, attrs)
            region = -1
            if tag in REGION:
                region = len(self.kinds)
                self.kinds.append(tag)
                self.regions += (region,)
            self.hidden += hides
            if tag == "form":
                self.depth += 1
                if self.depth == 1:
                    self.forms += 1
                    self.form = self.forms
            self.open.append((tag, hides, region))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end_open(self, tag: str, up_to) -> None:
        """Ends the nearest open element of this name, unless one of ``up_to`` stands before it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.close_from(k)
                return
            if self.open[k][0] in up_to:
                return

    def close_from(self, k: int) -> None:
        if any(t in BLOCK for t, _, _ in self.open[k:]):
            self.flush()
        for tag, hides, region in self.open[k:]:
            self.hidden -= hides
            if tag == "form":
                self.depth -= 1
                self.form = self.form if self.depth else 0
            if region >= 0:
                self.regions = self.regions[: self.regions.index(region)]
        del self.open[k:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        elif tag not in VOID and (tag in BLOCK or tag not in INLINE):
            self.end_open(tag, ())

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


# Elements that never hide text by themselves and needn't be kept on the stack.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small strike strong sub sup time tt u var".split())


def smoothed_ratios(chars: list[int], tags: list[int], sigma: float) -> np.ndarray:
    """Characters per tag of each line, under a Gaussian of ``sigma`` lines whose weights add up to one at the ends too."""
    ratio = np.array(chars, float) / np.maximum(1, np.array(tags, float))
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return (np.convolve(ratio, kernel)[reach:-reach]) / (np.convolve(np.ones(len(ratio)), kernel)[reach:-reach])


def upper_cluster(x: np.ndarray) -> np.ndarray:
    """Two-means threshold on a line: the half-way point between the means of the values above and below it."""
    if len(x) < 2 or np.ptp(x) <= 1e-9 * np.abs(x).max():
        return np.ones(len(x), bool)
    cut = x.mean()
    for _ in range(50):
        new = (x[x > cut].mean() + x[x <= cut].mean()) / 2
        if new == cut:
            break
        cut = new
    return x > cut


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.8) -> str:
    """Content lines of one page. ``share``: part of the chosen lines' text that the region inside an article or main holds at least."""
    if not html:
        return ""
    page = PageLines()
    for start in range(0, len(html), CHUNK):
        page.feed(html[start : start + CHUNK])
    page.close()
    page.flush()
    in_form: dict[int, int] = {}
    for t, _, _, form in page.lines:
        in_form[form] = in_form.get(form, 0) + len(t)
    lines = [(t, n, regions) for t, n, regions, form in page.lines if not form or 2 * in_form[form] > sum(in_form.values())]
    if not lines:
        return ""
    chars = [len(t) for t, _, _ in lines]
    chosen = upper_cluster(smoothed_ratios(chars, [n for _, n, _ in lines], sigma))
    held: dict[int, int] = {}
    for n, (_, _, regions), take in zip(chars, lines, chosen.tolist()):
        if take:
            for r in regions:
                held[r] = held.get(r, 0) + n
    region = max(r for r, n in held.items() if n >= share * held[0])  # inner regions have larger numbers
    chain = next(regions[: regions.index(region) + 1] for _, _, regions in lines if region in regions)
    around = max(r for r, n in held.items() if n == held[0] and page.kinds[r] != "section")  # a section is a part of what is around it
    top = next((r for r in reversed(chain) if page.kinds[r] in ("article", "main")), around)
    return "\n".join(t for t, _, regions in lines if top in regions)


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text", sigma: float = 1.0, share: float = 0.8) -> DataFrame:
    """Each row with its main text in ``out`` instead of its html."""
    keep = [c for c in pages.columns if c not in (html, out)]
    hidden = free_name(keep, "__html")
    lean = importable(pages).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias(hidden))
    schema = lean.drop(hidden).withColumn(out, F.lit("")).schema

    def run(batches):
        for batch in batches:
            texts = [main_text(h, sigma, share) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, out])

    return lean.mapInArrow(run, schema)
