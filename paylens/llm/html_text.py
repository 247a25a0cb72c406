"""Main text of web pages by tag-path ratios.

A page is read into blocks: text between block-level tags, each with its
root-to-leaf path of block-level tags and their class and id names. For each
path the text length, punctuation, linked text and number of blocks are summed;
length and punctuation per block are smoothed over the blocks in page order and
fused with the share of text outside links and a weight of the path's names.
Paths over a threshold, a share of the mean over all text, hold content. Where
article and main tags hold most of it, they are the content nodes. Elsewhere the
content node is the deepest node that holds all of it, or the outermost node
around that whose names tell of an article. What lies in a content node comes
out whole, short blocks too, but for menus, notices, adverts, forms and reader
comments.

Tags, roles and hidden elements decide what is not the article, and so do names
of reader comments. Other names only suggest it. A name of nothing but listed
words marks what it names, unless that holds an article or most of the page's
text: then it is a wrapper and the name counts for nothing, as does a form
around the content. A name that only mentions a listed word (``has-sidebar``,
``read-more-intro``) halves the score of its path, which then decides. On
paragraphs, headings and quotes only names of adverts and notices count.

Null html, and pages without text, have an empty text. Repeated rows come out
as often as they come in, and an empty table gives an empty one. Very long or
deep pages are read whole; memory grows with the page's length, since a path is
a number for its parent path and last tag. A tie between nodes that hold all
content goes to the deepest; there is no other.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_rows, prepare

# Tags of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is not the page's. One that does not end in its parent ends where it starts, a select at the next block.
MUTE = frozenset("noscript template svg math select object audio video canvas".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
_P, _KEEPS_P = frozenset({"p"}), frozenset("td th button table article section div body li blockquote".split())
#: A start tag ends an open one of these, if no container of the kind lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Tags and names of what is not the article.
OTHER_TAGS = frozenset("nav footer aside form menu dialog head button search fieldset".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer foot sidebar side sidenav aside rail"
    " cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay disclaimer"
    " comment comments commentlist respond reply replies disqus discussion reactions"
    " related recommended recommendations more share sharing social follow newsletter subscribe subscription signup login"
    " widget widgets form search tags taglist skip copyright legal".split()
)
#: Names of reader comments. What they name is never a wrapper.
COMMENT_NAMES = frozenset("comment comments commentlist respond replies disqus".split())
#: The names that count on paragraphs, headings and quotes.
SURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr"
    " breadcrumb breadcrumbs newsletter subscribe notice notices notification alert pagination copyright".split()
)
PROSE_TAGS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 hgroup figcaption".split())
#: Words that make a name tell how a page is laid out, not what the node is.
LAYOUT_WORDS = frozenset("has have with without no not is layout sticky show hide enable enabled disable disabled open closed wrap wrapper".split())
#: Words that leave a name what its other words tell.
PLACE_WORDS = frozenset(
    "list area section box block container item items inner outer site page main top bottom left right post posts article articles entry content"
    " link links bar panel unit slot button buttons".split()
)
#: Names of what holds an article, taken before the others where a tag has both.
MAIN_NAMES = frozenset("article post story content entry main body text".split())

# Quotes hold a value only just after the sign of equality; elsewhere they are letters of a name or value.
_ATTRIBUTES = r"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?|=)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?¿¡…、。，！？；：]")

SMOOTHING = (0.25, 0.5, 0.25)
#: Share of the mean score, weighted by text, that a path needs.
THRESHOLD = 0.3
#: Share of the content paths' text that article and main tags must hold to be the content nodes.
HELD = 0.6


#: What tags and names suggest of a node: nothing, perhaps or likely not the article, surely not.
NONE, WEAK, STRONG, SURE = range(4)
#: Share of the page's text outside links that makes a node a wrapper: for a weak mark, a form or a node around an article; for others.
MOST, NEARLY_ALL = 0.5, 0.8
#: Weight of names in the score of a path.
PRIOR = {NONE: 1.0, WEAK: 0.5, STRONG: 0.1, SURE: 0.0}


def _plain(words: list[str]) -> bool:
    """A name says what the node is, and does not only mention it."""
    if LAYOUT_WORDS.intersection(words):
        return False
    return words[-1] in OTHER_NAMES or bool(SURE_NAMES.intersection(words)) or all(w in OTHER_NAMES or w in PLACE_WORDS for w in words)


@lru_cache(maxsize=50_000)
def _described(tag: str, attributes: str) -> tuple[str, bool, int, bool]:
    """A tag's part of a path, whether it or its names tell of an article, how surely of something else, and whether the tag does."""
    found = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(attributes)} if attributes else {}
    names = sorted({*found.get("class", "").split(), *found.get("id", "").split()})
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden") == "true"
    worded = [[p.lower() for p in _NAME_PARTS.findall(n)] for n in names]
    parts = {p for words in worded for p in words}
    marked = tag in ("article", "main") or role == "main"
    main = marked or bool(parts & MAIN_NAMES) and not parts & (OTHER_NAMES - {"body", "text"})
    level = STRONG if tag == "form" or role == "form" else NONE
    if hidden or tag in OTHER_TAGS - {"form"} or role in OTHER_ROLES - {"form"}:
        level = SURE
    elif tag not in ("html", "body", "main"):
        listed = SURE_NAMES if tag in PROSE_TAGS else OTHER_NAMES
        telling = [words for words in worded if listed.intersection(words)]
        if any(COMMENT_NAMES.intersection(words) and not LAYOUT_WORDS.intersection(words) for words in telling):
            level = SURE
        elif tag != "article" and not main and telling:
            level = max(level, STRONG if any(map(_plain, telling)) else WEAK)
    return f"/{tag}{''.join('.' + n for n in names)}", main, level, marked


class Node:
    """A block-level element. ``path`` numbers the paths of a page; ``other`` and ``main`` hold once the page is ``judged``."""

    __slots__ = ("tag", "parent", "path", "depth", "level", "named", "marked", "other", "main", "chrome", "mass", "articles", "place")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = "", page: "Page | None" = None):
        self.tag, self.parent = tag, parent
        self.mass = self.articles = 0
        self.other = self.main = self.chrome = False
        if parent is None:
            self.path, self.depth, self.level, self.named, self.marked = 0, 0, NONE, False, False
        else:
            label, self.named, self.level, self.marked = _described(tag, attributes)
            self.path = page.paths.setdefault((parent.path, label), len(page.paths) + 1)
            self.depth = parent.depth + 1


class Page:
    """The elements of a page, parents first, and its blocks: node, text, linked code points."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[Node] = [Node("", None)]
        self.blocks: list[tuple[Node, str, int]] = []

    def judge(self) -> None:
        """Which nodes are not the article, from what tags and names suggest and from the text that nodes hold."""
        nodes = self.nodes
        for place, n in enumerate(nodes):
            n.place = place
        sure = [False] * len(nodes)
        for n in nodes[1:]:
            sure[n.place] = sure[n.parent.place] or n.level == SURE
        for node, text, linked in self.blocks:
            if not sure[node.place]:
                node.mass += max(0, len(text) - linked)
        for n in reversed(nodes[1:]):
            if n.marked and not sure[n.place]:
                n.articles = n.mass  # outermost articles count whole
            n.parent.mass += n.mass
            n.parent.articles += n.articles
        whole, in_articles = nodes[0].mass, nodes[0].articles
        for n in nodes[1:]:
            if n.level in (WEAK, STRONG):
                easy = n.level == WEAK or n.tag == "form" or (n.articles and 2 * n.articles >= n.mass)
                if n.mass >= (MOST if easy else NEARLY_ALL) * whole > 0 and (2 * n.articles >= in_articles):
                    n.level = NONE
        for n in nodes[1:]:
            up = n.parent
            # A header outside of the article is the page's.
            n.other = up.other or n.level >= STRONG or (n.tag == "header" and not up.main)
            n.main = (n.named or up.main) and not n.other
            n.level = SURE if n.other else max(n.level, up.level)
            # In a header inside the article, only headings and their subtitles belong to it.
            n.chrome = n.tag == "header" or (up.chrome and n.tag not in _HEADINGS)


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p hgroup".split())


@lru_cache(maxsize=None)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _past(page: str, tag: str, at: int, around: set[str], unended: set[int]) -> int:
    """Where a muted element that starts before ``at`` ends.

    It does not end in its parent if the end tag of an element around it comes
    first; then this is ``at``, and such elements of its kind are noted.
    """
    starts, inner = [at], Counter()
    while match := _TOKEN.search(page, at):
        at = max(match.end(), at + 1)
        if match[2] is None:
            continue
        name = match[2].lower()
        if name == tag:
            if not match[1]:
                if not match[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                    starts.append(at)
            elif starts.pop() and not starts:
                return at
        elif name in RAW and not match[1]:
            end = _end_of(name).search(page, at)
            at = end.end() if end else len(page)
        elif name in BLOCKS and tag == "select" and name != "hr":
            return match.start()
        elif name in BLOCKS and not match[1]:
            inner[name] += 1
        elif name in BLOCKS:
            if not inner[name] and name in around:
                break
            inner[name] = max(0, inner[name] - 1)
    if tag == "select":
        return len(page)
    unended.update(starts)
    return starts[0]


def read(page: str) -> Page:
    """The elements of a page and its blocks with text, in page order."""
    got = Page()
    stack: list[Node] = [got.nodes[0]]
    opened: Counter[str] = Counter()
    links = 0
    out = got.blocks
    pieces: list[tuple[str, bool]] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join([p for p, _ in pieces]).split())
            if text:
                linked = sum(len(" ".join(p.split())) for p, inside in pieces if inside)
                out.append((stack[-1], text, linked))
            pieces.clear()

    def end_from(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    def close(tags, until=frozenset()) -> None:
        """End the nearest open tag of the kind, and all in it."""
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                end_from(k)
                return
            if stack[k].tag in until:
                return

    at, size = 0, len(page)
    unended: set[int] = set()
    while at < size:
        match = _TOKEN.search(page, at)
        if match is None:
            pieces.append((html.unescape(page[at:]), links > 0))
            break
        if match.start() > at:
            pieces.append((html.unescape(page[at : match.start()]), links > 0))
        at = max(match.end(), at + 1)
        if match[2] is None:
            continue
        tag = match[2].lower()
        if tag in MUTE:
            if not match[1] and at not in unended and not (tag in ("svg", "math") and match[3].rstrip().endswith("/")):
                at = _past(page, tag, at, {t for t, n in opened.items() if n}, unended)
            continue
        if match[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                if tag == "p" and not opened["p"]:
                    flush()
                else:
                    close((tag,))
            continue
        if tag == "br" or tag == "wbr":
            pieces.append((" " if tag == "br" else "", links > 0))
        elif tag == "a":
            links += 1
        elif tag in RAW:
            end = _end_of(tag).search(page, at)
            at = end.end() if end else size
        elif tag in BLOCKS or tag == "head" or tag == "button":
            if tag in CLOSES_P:
                close(_P, _KEEPS_P)
            if tag in ENDS:
                close(*ENDS[tag])
            flush()
            links = 0
            if tag in VOID:
                continue
            if tag == "body":
                end_from(1 + sum(n.tag == "html" for n in stack[1:2]))
            stack.append(Node(tag, stack[-1], match[3].strip(), got))
            got.nodes.append(stack[-1])
            opened[tag] += 1
    flush()
    return got


def _smooth(values: list[float]) -> list[float]:
    before, own, after = SMOOTHING
    n = len(values)
    return [before * values[max(0, i - 1)] + own * values[i] + after * values[min(n - 1, i + 1)] for i in range(n)]


def path_scores(blocks: list[tuple[Node, str, int]]) -> dict[int, float]:
    """The fused ratio of each path."""
    sums: dict[int, list[float]] = {}
    for node, text, linked in blocks:
        s = sums.setdefault(node.path, [0.0, 0.0, 0.0, 0.0])
        for k, v in enumerate((len(text), len(_PUNCTUATION.findall(text)), linked, 1)):
            s[k] += v
    length = _smooth([sums[n.path][0] / sums[n.path][3] for n, _, _ in blocks])
    points = _smooth([sums[n.path][1] / sums[n.path][3] for n, _, _ in blocks])
    scores: dict[int, list[float]] = {}
    for (node, _, _), a, b in zip(blocks, length, points):
        s = sums[node.path]
        unlinked = 1 - min(1.0, s[2] / s[0])
        prior = PRIOR[node.level] * (2.0 if node.main else 1.0)
        # The path's total tells one long run of paragraphs from many lone blocks.
        scores.setdefault(node.path, []).append(a * (1 + b) * unlinked * prior * s[0] ** 0.5)
    return {p: sum(v) / len(v) for p, v in scores.items()}


def main_text(page: str | None) -> str:
    """The article of a page, blocks parted by two newlines; empty if there is none."""
    got = read(page or "")
    got.judge()
    blocks = got.blocks
    scores = path_scores(blocks)
    total = sum(len(t) for n, t, _ in blocks if not n.other)
    if not total:
        return ""
    least = THRESHOLD * sum(scores[n.path] * len(t) for n, t, _ in blocks if not n.other) / total
    held = [0] * len(got.nodes)
    for node, text, _ in blocks:
        if not node.other and scores[node.path] >= least:
            held[node.place] += len(text)
    for n in reversed(got.nodes[1:]):
        held[n.parent.place] += held[n.place]
    whole = held[0]
    if not whole:
        return ""

    mains = [n for n in got.nodes[1:] if held[n.place] and n.main and not n.parent.main]
    if sum(held[n.place] for n in mains if n.marked) >= HELD * whole:
        roots = set(mains)
    else:
        # Nodes that hold all content lie on one way from the root.
        root = max((n for n in got.nodes if n.tag not in _INLINE and held[n.place] == whole), key=lambda n: n.depth)
        while root.main and root.parent.main:
            root = root.parent
        roots = {root}
    inside = [False] * len(got.nodes)
    for n in got.nodes:
        inside[n.place] = n in roots or (n.parent is not None and inside[n.parent.place])
    out = []
    for node, text, linked in blocks:
        if node.other or node.chrome or not inside[node.place]:
            continue
        # What links or a name speak against needs the score of content.
        if scores[node.path] < least and (node.level == WEAK or (not node.main and linked >= 0.8 * len(text))):
            continue
        out.append(text)
    return "\n\n".join(out)


_INLINE = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr dt dd ul ol".split())


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, the main text and its code points. Null html is an empty page."""
    prepare(pages.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_rows(chosen, "page_id long, url string, text string, n_chars long", rows)
