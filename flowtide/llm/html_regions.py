"""Main text of web pages: text-to-tag ratios of page lines, smoothed and clustered.

The parser of the standard library reports a page as events. Block tags end a line; a line has its text, the number
of tags in it and around it, and the chain of elements it stands in. Lines that a page itself marks as something
else (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) never count as text. The ratio
of text to tags per line is smoothed by a Gaussian on a log scale, and the smoothed ratios are split in two clusters. The
smallest container that holds all lines of the upper cluster is the content region, or the <article> or <main> around
it. Every line of that region is kept, also short ones, but link lists and teaser cards without an upper line.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names and the words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img".split())
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea "
                   "button datalist".split())
ASIDE = frozenset("nav header footer aside form dialog menu fieldset search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                        "toolbar".split())
#: A class or id marks a part only where each piece of it ("cookie-notice", "site-footer") is one of these or a place.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion promotions banner "
    "cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe signup login nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget footer header masthead share sharing social toolbar pagination pager skip".split())
#: Parts that have articles of their own, so an <article> inside says nothing about them.
OTHER_ARTICLES = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended".split())
PLACES = frozenset("site page main global primary secondary top bottom left right side bar box list block wrapper container area section".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())
#: A start tag of these closes an open <p>, as browsers do.
CLOSES_P = PARAGRAPHS - {"td", "th", "figcaption"} | frozenset("div article section ul ol dl table form main hr address figure nav "
                                                             "header footer aside fieldset details menu".split())
_BLANKS = re.compile(r"\s+")
SIGMA = 1.5


#: Elements that are never the region by themselves.
NO_REGION = PARAGRAPHS | frozenset("ul ol dl table thead tbody tfoot tr figure".split())
#: A block without an upper line is a link list from so many links, when so much of its text is in them.
LIST_LINKS, LIST_SHARE = 3, 0.9


def aside_kind(label: str) -> str:
    """'own' where a whole class token names comments or related articles, 'part' where it names another part."""
    kind = ""
    for token in label.lower().split():
        pieces = [w for w in re.split("[_-]+", token) if w]
        if all(w in ASIDE_WORDS or w in OTHER_ARTICLES or w in PLACES for w in pieces):
            if any(w in OTHER_ARTICLES for w in pieces):
                return "own"
            if any(w in ASIDE_WORDS for w in pieces):
                kind = "part"
    return kind


class Lines(HTMLParser):
    """Lines of a page: (text, tags, path of element numbers, links, characters in links, numbers of aside elements)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, number, excluded, inside a marked region, inside a link, aside elements around
        self.stack: list[tuple[str, int, bool, bool, bool, tuple[int, ...]]] = []
        self.count, self.tags, self.parts, self.lines = 0, 0, [], []
        self.links, self.link_chars = 0, 0
        self.kinds: dict[int, str] = {}  # number -> tag, "article" and "main" also by role
        self.articles_own: set[int] = set()  # aside elements whose articles are not the page's
        self.lifted: set[int] = set()  # elements with an aside word that turned out to hold an <article> or <main>

    def end_line(self):
        text = _BLANKS.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, tuple(e[1] for e in self.stack if e[0] not in INLINE), self.links,
                               self.link_chars, self.stack[-1][5] if self.stack else ()))
            self.tags = 0
        self.parts, self.links, self.link_chars = [], 0, 0

    def _excluded(self):
        return bool(self.stack and self.stack[-1][2])

    def handle_starttag(self, tag, attrs):
        self.tags += not self._excluded()
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.end_line()
        if tag in CLOSES_P:
            self._close("p", CLOSES_P - {"p"})
        if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            self._close(tag, frozenset(("ul", "ol", "dl", "table", "select")))
        if tag in VOID:
            return
        self.count += 1
        named = dict(attrs)
        label = f"{named.get('class') or ''} {named.get('id') or ''}"
        top = self.stack[-1] if self.stack else ("", 0, False, False, False, ())
        main = "main" if tag == "main" or named.get("role") == "main" else (
            "article" if tag == "article" or named.get("role") == "article" or named.get("itemprop") == "articleBody" else "")
        # A header inside the article may hold its heading, so that one counts as text.
        aside = tag in ASIDE and tag != "form" and not (tag == "header" and top[3])
        odd = tag in SILENT or aside or (named.get("role") or "").lower() in ASIDE_ROLES or "hidden" in named
        kind = "" if tag in ("html", "body") else aside_kind(label)
        if main and not (kind == "own" and "comment" in label.lower()):
            kind = ""
            if not odd and not top[2]:
                # What holds it is no menu or form; comments and related articles stay what they are.
                self.lifted.update(k for k in top[5] if main == "main" or not self.articles_own.intersection(top[5]))
        marks = top[5]
        if kind or tag == "form":
            marks += (self.count,)
            if kind == "own":
                self.articles_own.add(self.count)
        self.kinds[self.count] = main or tag
        if tag == "a":
            self.links += 1
        self.stack.append((tag, self.count, top[2] or odd, top[3] or bool(main), top[4] or tag == "a", marks))

    def _close(self, tag, until):
        """Closes the innermost open ``tag`` unless one of ``until`` stands further in."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.end_line()
                del self.stack[k:]
                return
            if self.stack[k][0] in until:
                return

    def handle_endtag(self, tag):
        self.tags += not self._excluded()
        if tag not in INLINE and tag != "br":
            self.end_line()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self._excluded():
            self.parts.append(data)
            if self.stack and self.stack[-1][4]:
                self.link_chars += len(_BLANKS.sub(" ", data).strip())


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbouring lines; weights are normalised at the ends."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(weights[abs(i - j)], values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def threshold(values: list[float], rounds: int = 20) -> float:
    """The border between two clusters: the middle of the two means, moved until it rests."""
    cut = sum(values) / len(values)
    for _ in range(rounds):
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high:
            break
        moved = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if moved == cut:
            break
        cut = moved
    return min(cut, max(values))


def main_text(html: str | None) -> str:
    """Blocks of the content region, joined by empty lines; '' where there is none.

    The region is the smallest container, never a paragraph or list, that holds all lines of the upper ratio cluster,
    or the outermost <article>, else <main>, around that. Outside of one, paragraphs beside the region and sections
    beside a section belong to it, and so do the h1 and h2 directly before it. An inner <article> without an upper
    line is a card and goes, as does a link list without one, unless the list stands in an <article>.
    """
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    _finish(parser)
    kinds = parser.kinds
    lines = [line for line in parser.lines if parser.lifted.issuperset(line[5])]
    if not lines:
        return ""
    ratios = smooth([math.log1p(len(text) / max(1, tags)) for text, tags, *_ in lines])
    border = threshold(ratios)
    upper = [line for line, ratio in zip(lines, ratios) if ratio >= border]
    upper = [line for line in upper if line[4] < LIST_SHARE * len(line[0])] or upper

    shared = list(upper[0][2])
    for line in upper:
        same = 0
        while same < min(len(shared), len(line[2])) and shared[same] == line[2][same]:
            same += 1
        del shared[same:]
    while shared and kinds[shared[-1]] in NO_REGION:
        shared.pop()
    for kind in ("article", "main"):
        at = next((i for i, k in enumerate(shared) if kinds[k] == kind), None)
        if at is not None:
            del shared[at + 1:]
            break
    marked = at is not None
    depth, anchored = len(shared), {k for line in upper for k in line[2]}

    def inside(path) -> bool:
        same = 0
        while same < min(depth, len(path)) and shared[same] == path[same]:
            same += 1
        if same == depth:
            return True
        if marked or any(kinds[k] in ("article", "main") for k in path[same:]):
            return False
        child = kinds[path[same]] if same < len(path) else "p"
        if child == "section":
            return kinds[shared[same]] == "section"
        return child in NO_REGION and same > 0 and kinds[shared[same - 1]] not in ("html", "body")

    texts, links, link_chars = {}, {}, {}
    for text, _, path, n, chars, _ in lines:
        for k in path:
            if k not in anchored:
                texts[k] = texts.get(k, 0) + len(text)
                links[k] = links.get(k, 0) + n
                link_chars[k] = link_chars.get(k, 0) + chars
    lists = {k for k, n in links.items() if n >= LIST_LINKS and link_chars[k] >= LIST_SHARE * (texts[k] - n)}

    def other(path) -> bool:
        if any(kinds[k] == "article" and k not in anchored for k in path):
            return True
        return not any(kinds[k] == "article" for k in path) and any(k in lists for k in path)

    keep = [inside(line[2]) and not other(line[2]) for line in lines]
    first = next((i for i, k in enumerate(keep) if k), 0)
    while first and lines[first - 1][2] and kinds[lines[first - 1][2][-1]] in ("h1", "h2") and not other(lines[first - 1][2]):
        first -= 1
        keep[first] = True
    return "\n\n".join(line[0] for line, k in zip(lines, keep) if k)


def _finish(parser: Lines) -> None:
    """Ends a page. A tag cut off by the page's end is markup, not text; a cut-off reference stays as it stands."""
    rest = parser.rawdata
    at = rest.rfind("<")
    if at >= 0 and re.match(r"<(?:[a-zA-Z/!?])", rest[at:]) and ">" not in rest[at:]:
        parser.rawdata = rest[:at]
    elif rest.endswith("<"):
        parser.rawdata = rest
    parser.close()
    parser.end_line()


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page, one without text and one that only has parts of other kinds give '' and 0. Ids and urls
    may be null or repeated and are returned as they are. Other columns are not read. An empty table gives an empty
    result.
    """

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
