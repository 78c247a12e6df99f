"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; inline elements never cut. First pass, on each block alone: blocks in
boilerplate containers (menus, headers outside the article, footers, asides, forms, adverts, notices, reader comments,
by tag, role or whole class/id token; ids of headings don't count) are bad; of the others, blocks that are links
throughout are bad, those with words beside many links are linked, long blocks with many stop words are good, those
with some are nearly good, very short ones and headings are short, those without stop words are bad. On a page whose
text has hardly any of the known stop words, its language is not among the lists: there length decides alone. If no block is good, the nearly good ones are, and if there are none of
these either, the short ones.

Second pass: nearly good, short and linked blocks inherit from the nearest decided block on either side, near being
counted in element borders that lie between. A nearly good block is kept if either of the two is good, a linked one if
both are, a short one if the nearer is (of two as near, both must be).

Article and main elements are a prior: only if their blocks outside boilerplate hold more than half of the text that
these rules keep on the whole page (where they keep none, of all text outside boilerplate and links), blocks outside are
bad, and the two passes run again on the blocks inside. There the mark's border counts as a good neighbour, a short
block between neighbours as near to it is kept if either is good, and blocks without stop words are nearly good rather
than bad, since they may be tables, lists or quotes.

Results for odd input: null or empty html gives an empty text; markup cut off anywhere is read as far as it goes; an
attribute's quote that never closes is a character like others, so the tag ends at the next ``>``; a page with nothing
but boilerplate and links gives an empty text; repeated rows each get their text; an empty table gives an empty result.
Very long pages are read whole, in time that grows with their length, whatever their nesting. Columns of ``pages`` called
text or n_chars, in upper or lower case, are replaced by the results; all others but the html stay, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import accumulate, dropwhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverframe.llm.common import brought_back, set_aside

# Which elements break a block, hold no text, or are never main text; words in class, id or role that name boilerplate.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template svg iframe textarea title".split())
BOILER_TAGS = frozenset("nav footer aside form header menu dialog button select".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead sidebar side aside widget related recommended comment comments reply replies respond discussion disqus "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social toolbar pagination pager search form complementary contentinfo dialog tags copyright legal".split()
)
#: Words that may stand before (PLACES) or after (HOLDERS) boilerplate words in one class or id token, and other known tokens.
PLACES = frozenset("site page main global top bottom primary secondary sticky mobile".split())
HOLDERS = frozenset("list area box bar container wrapper wrap block inner link links button buttons icon icons item items title form slot unit".split())
BOILER_TOKENS = frozenset(
    "post-comments article-comments entry-comments comment-body comment-content comment-text comments-section comment-section entry-footer post-footer article-footer "
    "related-posts related-articles related-stories related-content recommended-posts recommended-articles recommended-content sponsored-content sponsored-post "
    "post-tags entry-tags article-tags post-share article-share post-navigation privacy-notice google-ad".split()
)
STOP_WORDS = frozenset(
    # English, German, French, Spanish
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so what up said about than into them can only other do new some could these two may then first any my now such like our over me even most made after also did many must before back through years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three "
    "der die das und ist nicht ein eine zu den von mit dem sich auf für im des es auch als an er hat aus bei nach sie wie war wird oder um noch nur über so zum haben vor bis mehr durch sein man einer wir aber ich ihr "
    "le la les et des un une de du est en que qui dans pour pas au sur ne se par plus ce il elle avec sont son aux ou mais nous vous ont cette ses comme leur être fait "
    "el los las y una del en es por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos".split()
)

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_PART = re.compile(r"=\s*([\"'])|>")
ENDINGS = {t: re.compile(f"</{t}(?=[\\s>/])", re.I) for t in SKIPPED}
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SIZE = re.compile(r"\d+(?:x\d+)?")
WORD = re.compile(r"\w+")
SPACES = re.compile(r"\s+")


# An opening tag first ends the open elements named here, within the nearest element of the second set.
P_SCOPE = frozenset("caption td th table html".split())
P_ENDERS = BLOCK_TAGS - frozenset("body caption html legend tbody td tfoot th thead tr".split())
ITEM_SCOPE = BLOCK_TAGS - frozenset("address div p".split())
ITEM_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: An end tag of another element does not reach out of these.
CELLS = frozenset("td th caption".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())


class Limits:
    """The first pass's numbers, in code points and shares."""

    long, short, link_share, high_stop, low_stop = 140, 40, 0.35, 0.20, 0.10


def attributes(attrs: str) -> dict[str, str]:
    """A tag's attributes by lower-case name, values in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attrs):
        if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0]:
            value = value[1:-1]
        out.setdefault(name.lower(), value.lower())
    return out


def names_boilerplate(token: str) -> bool:
    """Whether a class or id token is a boilerplate word or a known compound of such words, places and holders."""
    if token in BOILER_WORDS:
        return True
    parts = [x for x in re.split(r"[_\-]+", token) if x]
    if "-".join(parts) in BOILER_TOKENS:
        return True
    while parts and (parts[-1] in HOLDERS or SIZE.fullmatch(parts[-1])) and parts[-1] not in BOILER_WORDS:
        parts.pop()
    named = list(dropwhile(PLACES.__contains__, parts))
    return bool(named) and BOILER_WORDS.issuperset(named)


def boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element holds boilerplate whatever its text."""
    if tag in BOILER_TAGS and not (tag == "header" and in_article):
        return True
    if attrs and tag not in ("html", "body", "article", "main"):
        has = attributes(attrs)
        if "hidden" in has or has.get("aria-hidden") == "true":
            return True
        if re.search(r"(?:^|;)display:none(?:!important)?(?:;|$)", re.sub(r"\s+", "", has.get("style", ""))):
            return True
        if not BOILER_WORDS.isdisjoint(has.get("role", "").split()):
            return True
        tokens = has.get("class", "").split() + (has.get("id", "").split() if tag not in HEADINGS else [])
        return any(map(names_boilerplate, tokens))
    return False


def pieces(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """The page in order as (text before, end tag?, tag name, attributes); the last one has no tag."""
    start = at = 0
    unclosed: set[str] = set()
    while (at := html.find("<", at)) >= 0:
        m = TAG.match(html, at)
        closing, tag, attrs = False, "", ""
        if m:
            closing, tag, end = bool(m[1]), m[2].lower(), m.end()
            while (part := TAG_PART.search(html, end)) and part[1]:
                close = -1 if part[1] in unclosed else html.find(part[1], part.end())
                if close < 0:
                    unclosed.add(part[1])
                end = close + 1 if close >= 0 else part.end()
            attrs, end = (html[m.end() : part.start()], part.end()) if part else (html[m.end() :], len(html))
        elif html.startswith(("<!", "<?", "</"), at):
            mark = "-->" if html.startswith("<!--", at) else "]]>" if html.startswith("<![CDATA[", at) else ">"
            end = html.find(mark, at + (4 if mark == "-->" else 2))
            end = end + len(mark) if end >= 0 else len(html)
        else:
            at += 1
            continue
        yield html[start:at], closing, tag, attrs
        if tag in SKIPPED and not closing and not attrs.endswith("/"):
            close = ENDINGS[tag].search(html, end)
            end = close.start() if close else len(html)
        start = at = end
    yield html[start:], False, "", ""


class Page:
    """The open elements of a page that is being read, and the block that text goes to."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, block?, boilerplate, article, muted outside
        self.open: dict[str, list[int]] = defaultdict(list)  # places of open elements by tag
        self.blocks_at: list[int] = []
        self.p_scope: list[int] = []
        self.item_scope: list[int] = []
        self.cells: list[int] = []
        self.boiler = self.article = self.muted = 0  # muted: open inline boilerplate in the present block
        self.text: list[str] = []
        self.linked = self.crossed = 0  # characters in links; element borders since the last block

    def flush(self) -> Iterator[tuple[str, int, bool, bool, bool, int]]:
        said = SPACES.sub(" ", "".join(self.text)).strip()
        if said:
            heading = any(self.stack[i][0] in HEADINGS for i in self.blocks_at[-2:])
            yield said, self.linked, heading, self.boiler > 0, self.article > 0, max(1, self.crossed)
            self.crossed = 0
        self.text, self.linked = [], 0

    def push(self, tag: str, block: bool, boiler: bool) -> None:
        at = len(self.stack)
        article = tag in ("article", "main")
        self.stack.append((tag, block, boiler, article, self.muted))
        self.open[tag].append(at)
        if not block:
            self.muted += 1
            return
        self.blocks_at.append(at)
        self.muted = 0
        self.boiler += boiler
        self.article += article
        self.crossed += 1
        for places, scope in ((self.p_scope, P_SCOPE), (self.item_scope, ITEM_SCOPE), (self.cells, CELLS)):
            if tag in scope:
                places.append(at)

    def pop_to(self, at: int) -> None:
        """Ends the open elements from place ``at`` on."""
        while len(self.stack) > at:
            tag, block, boiler, article, muted = self.stack.pop()
            self.open[tag].pop()
            self.muted = muted
            if block:
                self.blocks_at.pop()
                self.boiler -= boiler
                self.article -= article
                self.crossed += 1
                for places in (self.p_scope, self.item_scope, self.cells):
                    if places and places[-1] == len(self.stack):
                        places.pop()


def blocks_of(html: str) -> Iterator[tuple[str, int, bool, bool, bool, int]]:
    """The page's blocks in order: text, characters in links, heading?, in boilerplate?, in a marked article?, element borders since the block before."""
    page, link = Page(), False
    for text, closing, tag, attrs in pieces(html):
        if text and not page.muted:
            part = unescape(text)
            page.text.append(part)
            page.linked += len(part.strip()) if link else 0
        if tag == "br":
            page.text.append(" ")
        elif tag == "a":
            link = not closing
        elif closing:
            places = page.open.get(tag)
            inside = places and (tag in TABLE_PARTS or not page.cells or places[-1] > page.cells[-1])
            if tag in BLOCK_TAGS or inside and page.blocks_at and page.blocks_at[-1] > places[-1]:
                yield from page.flush()
                link = False
            if inside:
                page.pop_to(places[-1])
        elif tag in BLOCK_TAGS:
            yield from page.flush()
            link = False
            if tag in ITEM_ENDS and page.item_scope and page.stack[page.item_scope[-1]][0] in ITEM_ENDS[tag]:
                page.pop_to(page.item_scope[-1])
            if tag in P_ENDERS and page.open["p"] and (not page.p_scope or page.open["p"][-1] > page.p_scope[-1]):
                page.pop_to(page.open["p"][-1])
            if tag not in VOID_TAGS:
                page.push(tag, True, page.muted > 0 or boilerplate(tag, attrs, page.article > 0))
        elif tag and tag not in VOID_TAGS and tag not in SKIPPED and (attrs or tag in BOILER_TAGS) and boilerplate(tag, attrs, page.article > 0):
            page.push(tag, False, True)
    yield from page.flush()


def stop_share(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(text: str, linked: int, heading: bool, boiler: bool, inside: bool, stops: tuple[int, int], limits=Limits) -> str:
    """good, near (nearly good), short, linked or bad; ``inside``: the block is in the page's article; ``stops``: its ``stop_share``."""
    n = len(text)
    if boiler:
        return "bad"
    if linked / n > limits.link_share:
        return "linked" if WORD.search(text) and linked < n else "bad"
    if heading or n < limits.short:
        return "bad" if linked else "short"
    stop, words = stops
    if stop >= limits.high_stop * words:
        return "good" if n > limits.long else "near"
    return "near" if inside or stop >= limits.low_stop * words else "bad"


def second_pass(labels: list[str], at: list[int], edges: tuple[int, int] | None = None) -> list[bool]:
    """Whether each block is kept, ambiguous ones by their nearest decided neighbours.

    ``at`` are the blocks' places, counted in element borders. ``edges`` are the places of an article's border, which
    counts as a good neighbour, and inside which ``good`` wins between neighbours that are as near.
    """
    n = len(labels)
    sides = []
    for order, edge in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        seen: tuple[str, int] | None = ("good", edges[edge]) if edges else None
        side: list = [None] * n
        for i in order:
            side[i] = seen
            if labels[i] in ("good", "bad"):
                seen = (labels[i], at[i])
        sides.append(side)
    keep = []
    for i, label in enumerate(labels):
        near = [(abs(at[i] - place), seen) for seen, place in filter(None, (sides[0][i], sides[1][i]))]
        least = min(near, default=(0, ""))[0]
        said = [seen == "good" for d, seen in near if d == least]
        either = [seen == "good" for _, seen in near]
        keep.append(label == "good" or label == "near" and any(either) or label == "linked" and len(either) == 2 and all(either) or label == "short" and (any(said) if edges else bool(said) and all(said)))
    return keep


def passes(blocks: list[tuple], at: list[int], stops: list[tuple[int, int]], edges: tuple[int, int] | None = None) -> list[bool]:
    """Both passes on a page's blocks, or on those inside its article if ``edges`` are the places of that one's border."""
    open_ = [s for b, s in zip(blocks, stops, strict=True) if not b[3] and b[1] / len(b[0]) <= Limits.link_share]
    known = 2 * sum(s for s, _ in open_) >= Limits.low_stop * sum(w for _, w in open_)
    labels = [first_pass(*b[:4], edges is not None, s if known else (1, 1)) for b, s in zip(blocks, stops, strict=True)]
    if "good" not in labels:
        standing = "near" if "near" in labels else "short"
        labels = ["good" if x == standing else x for x in labels]
    kept = second_pass(labels, at, edges)
    for i, b in enumerate(blocks):  # a heading right before kept text belongs to it
        if b[2] and labels[i] == "short" and not kept[i] and i + 1 < len(blocks) and kept[i + 1]:
            kept[i] = True
    return kept


def extract(html: str | None) -> str:
    """The page's main text: kept blocks in order, one line each."""
    blocks = list(blocks_of(html or ""))
    at = list(accumulate(b[5] for b in blocks))
    stops = [(0, 0) if b[3] else stop_share(b[0]) for b in blocks]
    kept = passes(blocks, at, stops)
    marked = [i for i, b in enumerate(blocks) if b[4] and not b[3]]
    if marked:
        good = [b for b, k in zip(blocks, kept, strict=True) if k] or [b for b in blocks if not b[3] and b[1] / len(b[0]) <= Limits.link_share]
        if 2 * sum(len(b[0]) for b in good if b[4]) > sum(len(b[0]) for b in good):
            blocks, at, stops = [blocks[i] for i in marked], [at[i] for i in marked], [stops[i] for i in marked]
            kept = passes(blocks, at, stops, (at[0] - 1, at[-1] + 1))
    return "\n".join(b[0] for b, k in zip(blocks, kept, strict=True) if k)


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars."""

    @F.pandas_udf("string")
    def texts(html: pd.Series) -> pd.Series:
        return html.map(extract)

    aside = set_aside(pages, html_col)
    out = aside.withColumn("text", texts(F.coalesce(html_col, F.lit("")))).withColumn("n_chars", F.length("text").cast("long"))
    return brought_back(out, aside.drop(html_col), pages.drop(html_col), "text", "n_chars")
