"""Main text of web pages from flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each block has its number of words and its link density (share of words inside
links), those of the block before and after it, whether it stands in an article element (or outside the one that the page
has), and whether an element around it is by its kind, or by a whole class name, a menu, header, footer, sidebar, notice,
advert, form or comment section. A decision tree (CART, Gini impurity) learned from the small labelled table below says
which blocks are main text: words and link densities of a block and its neighbours decide wherever the page doesn't say.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
SCRIPT_PART = re.compile(r"<!--(?P<empty>-?>)?|(?P<shut>-->)|<(?P<close>/?)script(?=[\s/>])", re.I)
HINT = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

# Kinds of elements, and whole names of classes, ids and roles.
#: Whose content is never text of the page.
DROPPED = set("script style title noscript template iframe svg math canvas object audio video textarea select datalist".split())
#: Of these, those whose content is no markup: only their own closing tag ends them.
RAW = set("script style title noscript iframe textarea".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Within a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: That can't hold others.
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
#: Ended by the next of their kind; never put on the stack.
LIGHT = set("p li dt dd tr td th thead tbody tfoot option h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS, BOILER_TAGS = {"article", "main"}, set("nav footer aside form button menu dialog fieldset label".split())
#: Names in lower case, compared whole, so that "side-effects" is no sidebar.
ARTICLE_NAMES = set("article article-body article-content entry-content post-content post-body story-body main-content".split())
BOILER_NAMES = set(
    "ad ads ad-box ad-container ad-slot advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "menu main-menu nav navbar nav-bar main-nav navigation breadcrumb breadcrumbs toolbar skip-link search search-form pagination pager "
    "sidebar side-bar aside complementary widget related related-posts related-articles recommended recommendations trending most-read "
    "masthead topbar site-header site-footer footer page-footer contentinfo copyright imprint "
    "cookie cookies cookie-banner cookie-notice cookie-bar cookie-consent consent gdpr notice alert popup modal overlay dialog "
    "newsletter newsletter-signup subscribe signup sign-up login login-form contact-form share sharing share-buttons social-share social-links "
    "comment comments comment-list commentlist comment-section comments-section comment-form replies disqus disqus_thread respond discussion".split()
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: int
    article: int


@dataclass
class _Open:
    tag: str
    boiler: bool
    article: bool


def _hints(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether an element says of itself that it's boilerplate, or the article."""
    boiler, article = tag in BOILER_TAGS, tag in ARTICLE_TAGS
    if tag in ("body", "html"):
        return False, False
    if " " in raw or "\n" in raw or "\t" in raw:
        for name, value in HINT.findall(raw):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                said = set(value.split())
                boiler = boiler or bool(said & BOILER_NAMES)
                article = article or bool(said & ARTICLE_NAMES)
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                boiler = True
    return boiler, article and not boiler


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where the closing tag of a raw element begins whose content begins at ``at``; -1 if it has none.

    As browsers do, a script inside a comment inside a script has a closing tag of its own.
    """
    if tag != "script":
        found = RAW_END[tag].search(page, at)
        return found.start() if found else -1
    comment = inner = False
    for m in SCRIPT_PART.finditer(page, at):
        if m["empty"] or m["shut"]:
            comment = inner = False
        elif m["close"] is None:
            comment = True
        elif not m["close"]:
            inner = comment
        elif inner:
            inner = False
        else:
            return m.start()
    return -1


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page, character references decoded and white space made single spaces."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[tuple[str, bool]] = []
    links, skip, light = 0, "", [False]

    def end() -> None:
        nonlocal parts
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            linked = sum(len(p.split()) for p, inside in parts if inside)
            boiler = light[0] or any(x.boiler for x in stack)
            out.append(Block(text, n := len(text.split()), min(linked, n), int(boiler), int(any(x.article for x in stack))))
        parts = []

    page, at, unclosed = page or "", 0, set()

    def content(tag: str, at: int) -> int:
        """Where to go on after the opening tag of a dropped element: at a raw one's closing tag, if it has one."""
        if tag not in RAW or tag in unclosed:
            return at
        if (close := _raw_end(page, tag, at)) < 0:
            unclosed.add(tag)
            return at
        return close

    while at < len(page):
        token = TOKEN.match(page, at).group()
        at += len(token)
        if token[0] != "<" or token == "<":
            if not skip:
                parts.append((html.unescape(token), links > 0))
            continue
        if token[1] in "!?":
            continue
        closing = token[1] == "/"
        tag = TAG.match(token).group(1).lower()
        if skip:
            if closing and tag == skip:
                skip = ""
            elif not closing and not token.endswith("/>") and skip not in ("svg", "math", *RAW):  # those two are no HTML inside
                at = content(tag, at)
            continue
        if tag in DROPPED:
            if not closing and not token.endswith("/>"):
                skip, at = tag, content(tag, at)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            if tag == "br":
                parts.append((" ", False))
            continue
        end()
        links, light[0] = 0, False
        if tag in EMPTY:
            continue
        if tag in LIGHT:
            light[0] = not closing and _hints(tag, token)[0]
        elif closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        elif not token.endswith("/>"):
            boiler, article = _hints(tag, token)
            if tag == "header":  # of the page, unless it stands in the article
                boiler = not any(x.article for x in stack)
            if article:  # some pages are one form
                for x in stack:
                    x.boiler = x.boiler and x.tag != "form"
            stack.append(_Open(tag, boiler, article))
    end()
    return out


FEATURES = ["words", "link density", "words before", "link density before", "words after", "link density after", "marked as boilerplate", "in the article"]


def features(found: list[Block]) -> list[list[float]]:
    """In the article: 1; outside the article that the page has: -1; 0 on a page without. Beyond the edge of the article or of a marked part a block has no neighbour."""
    outside = -1 if any(b.article and not b.boiler for b in found) else 0

    def beside(b: Block, k: int) -> tuple[float, float]:
        other = found[k] if 0 <= k < len(found) else None
        return (other.words, other.linked / other.words) if other and (other.boiler, other.article) == (b.boiler, b.article) else (0, 0.0)

    return [[b.words, b.linked / b.words, *beside(b, k - 1), *beside(b, k + 1), b.boiler, 1 if b.article else outside] for k, b in enumerate(found)]


@dataclass
class Tree:
    main: bool = False
    feature: int = -1
    most: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def says(self, x: list[float]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.most else node.high
        return node.main


def learn(rows: list[list[float]], labels: list[bool], depth: int = 9) -> Tree:
    """CART: the split with the least Gini impurity, the first feature and lowest threshold of equals; leaves take the majority."""
    yes = sum(labels)
    leaf = Tree(main=2 * yes > len(labels))
    if not depth or yes in (0, len(labels)):
        return leaf

    def impurity(part: list[bool]) -> float:
        p = sum(part) / len(part)
        return 2 * p * (1 - p) * len(part)

    best: tuple[float, int, float] | None = None
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low = [y for r, y in zip(rows, labels, strict=True) if r[f] <= cut]
            high = [y for r, y in zip(rows, labels, strict=True) if r[f] > cut]
            if best is None or impurity(low) + impurity(high) < best[0] - 1e-12:
                best = (impurity(low) + impurity(high), f, cut)
    if best is None:
        return leaf
    _, f, cut = best
    sides = [[(r, y) for r, y in zip(rows, labels, strict=True) if (r[f] <= cut) == is_low] for is_low in (True, False)]
    low, high = (learn([r for r, _ in s], [y for _, y in s], depth - 1) for s in sides)
    return Tree(feature=f, most=cut, low=low, high=high)


def example(page: str) -> tuple[list[list[float]], list[bool]]:
    """Features and labels of a labelled page: its blocks that are main text are those whose text begins with +."""
    found = blocks(page)
    return features(found), [b.text.startswith("+") for b in found]


def sketch(page: str) -> tuple[list[list[float]], list[bool]]:
    """As example(), of a page given as its blocks: words/linked words, before them "n" (marked as boilerplate) or "a" (in the article), after them "+" for main text."""
    found, labels = [], []
    for block in page.split():
        where = block[0] if block[0] in "na" else ""
        words, linked = map(int, block[len(where) :].rstrip("+").split("/"))
        found.append(Block("", words, linked, int(where == "n"), int(where == "a")))
        labels.append(block.endswith("+"))
    return features(found), labels


_PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
#: The labelled table: whole pages, and pages given as their blocks.
LABELLED = [
    f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><div class=ad>Buy the best boots now for less money today.</div><article><h1>+ A title</h1><p>+ {_PROSE} {_PROSE}</p><p>+ Short.</p><p>+ {_PROSE}</p></article><footer>&copy; A site. {_PROSE}</footer></body>",
    f"<header><a href=/>The Site</a></header><main><h1>+ Story</h1><p>+ {_PROSE}</p><p>+ See <a href=x>this page</a> too.</p><ul><li>+ first point</li><li>+ second point</li></ul><h2>+ Part</h2><p>+ {_PROSE} {_PROSE} {_PROSE}</p><aside>Popular now: {_PROSE}</aside><p>+ End.</p></main><footer>Terms</footer>",
    f"<div id=menu><a href=1>One</a> <a href=2>Two</a></div><div><h1>+ Plain page with a title</h1><p>+ {_PROSE} {_PROSE}</p><p>+ {_PROSE}</p><p>+ {_PROSE} {_PROSE}</p></div><div><a href=1>More</a> <a href=2>Older posts</a></div><div>Copyright, all rights kept</div>",
    f"<div class='cookie-notice'><p>We use cookies. {_PROSE}</p></div><article><p>+ {_PROSE} {_PROSE}</p><form><p>Sign up for our letter {_PROSE}</p></form><p>+ Yes.</p><section class=comments><p>I liked it. {_PROSE} {_PROSE}</p><p>Me too</p></section></article>",
    f"<div class=sidebar><h3>Links</h3><p>{_PROSE}</p></div><div><p>+ {_PROSE} {_PROSE} {_PROSE}</p><p>+ {_PROSE}</p></div><div id=comments><p>{_PROSE} says reader</p></div><div>Contact us here</div><p><a href=a>Imprint</a></p>",
    f"<table><tr><td><a href=a>Start</a></td><td><a href=b>Shop</a></td></tr></table><p>+ {_PROSE}</p><p>+ {_PROSE} {_PROSE}</p><p><a href=c>Back to top</a></p><p>Page 3</p>",
    "<nav><a href=a>Index</a></nav><article><p>+ One.</p></article><footer>Last</footer>",
    f"<article><header><h1>+ Head of it</h1></header><p>+ {_PROSE}</p><div class='share'><a href=f>Share</a></div><div class='ad-box'>{_PROSE}</div><p>+ {_PROSE}</p><p>+ <a href=l>a link alone</a></p></article>",
    f"<article><h1>+ Ends early</h1><p>+ {_PROSE}</p><p>+ {_PROSE} {_PROSE}</p>",
    f"<article><p>+ Brief.</p><p>+ {_PROSE}</p><p>+ So.",
    f"<div class=notice>{_PROSE}</div><article><h2>+ One</h2><p>+ {_PROSE}</p><h2>+ Two</h2><p>+ {_PROSE}</p><p>+ Fin</p></article>",
    "<article><p>+ Only this one.</p></article>",
    f"<article><h1>+ Notes</h1><ol><li>+ one</li><li>+ two <a href=t>three</a></li></ol><p>+ {_PROSE}</p></article><div>Site map</div><div>Privacy</div>",
    f"<div>The daily page</div><div><a href=1>Log in</a></div><div><p>+ {_PROSE} {_PROSE}</p><p>+ {_PROSE} <a href=k>five</a></p><p>+ {_PROSE} {_PROSE}</p></div>",
    f"<div><a href=1>A</a> <a href=2>B</a></div><div>Today</div><div><p>+ {_PROSE} {_PROSE}</p><p>+ {_PROSE}</p></div><div>Read on:</div><div><a href=9>The next {_PROSE}</a></div>",
    f"<main><h1>+ Long read</h1><p>+ {_PROSE} {_PROSE} {_PROSE} {_PROSE}</p><p>+ Well.</p></main><p>Printed from a site</p>",
    f"<article><p>+ {_PROSE}</p></article><p><a href=x>All posts</a></p><p>Made with care</p><p>2001</p>",
    f"<p>+ {_PROSE} {_PROSE}</p><p>+ {_PROSE}</p>",
    "<p>Nothing here</p><p><a href=b>Back</a></p>",
]


SKETCHES = [
    # menus, adverts and footers that nothing marks, around plain text
    "1/1 1/1 1/1 1/1 7/0+ 40/0+ 60/0+ 25/0+ 4/4 5/5 3/0",
    "2/0 3/3 2/2 9/0+ 55/3+ 30/0+ 6/0+ 48/0+ 80/4+ 2/2 2/2 9/0",
    "1/1 1/1 8/0 6/0+ 42/0+ 38/0+ 1/1 1/1",
    "3/3 4/4 10/0 5/0+ 70/2+ 22/0+ 35/0+ 6/6 7/7 12/0",
    "12/12 8/0+ 33/1+ 5/5 41/0+ 28/0+ 4/4 4/4",
    "6/5 90/0+ 4/0+ 120/6+ 31/0+ 9/9 2/0",
    "2/2 2/2 2/2 24/0+ 36/0+ 3/3 44/0+ 2/2 2/2 8/1",
    "4/0 1/1 1/1 1/1 11/0+ 64/0+ 19/0+ 52/0+ 15/14 15/15 6/0",
    "5/5 5/5 5/5 5/5 5/5 4/0 3/0",
    "1/1 9/8 2/0 10/10",
    "1/1 1/1 1/1 4/0+ 20/0+ 41/0+ 1/1 1/1 3/0",
    "2/2 6/0 5/0+ 18/0+ 22/0+ 17/0+ 4/4",
    "3/3 9/0+ 16/0+ 3/0+ 19/0+ 8/0",
    "150/0+ 90/0+ 3/0",
    "30/0+",
    # lists of links in an article are menus; a link by itself is text
    "a8/0+ a30/0+ a4/4 a5/5 a3/3 a25/0+ n9/0",
    "a6/0+ a45/2+ a4/4+ a28/0+ a7/7 a6/6",
    "a5/0+ a3/3+ a60/0+ a2/2+ a2/0+",
    "a10/10+ a50/0+ a12/11 a12/12 a14/13 a12/12",
    "n2/2 a9/0+ a1/1 a1/1 a1/1 a33/0+ a2/0+ a1/0+",
    "a70/1+ a5/5 a6/6 a5/5 a80/0+ a3/3+ a55/0+ a6/6+ a90/0+",
    "a5/0+ a9/9+ a12/0+ a1/1+ a16/0+ a8/8 a8/8 a14/0+ a2/2+",
    "a60/0+ n5/5 n50/50 a75/0+ n4/4 a20/0+ n9/9 a48/0+",
    "a3/0+ a4/1+ a5/0+ a6/2+ a2/0+ a3/0+ a1/0+",
    "n1/1 n1/1 a7/7+ a30/0+ a40/0+ 5/5 6/6",
    # outside the article there is none, however long or plain
    "9/0 18/0 40/0 a7/0+ a35/0+ a20/0+ 30/0 2/2",
    "25/2 1/1 a50/0+ a5/0+ 60/0 45/1",
    "70/0 a12/0+ 80/0",
    # marked blocks are none, in the article or out of it
    "n30/0 8/0+ 50/0+ n45/0 60/0+ n12/6",
    "a40/0+ n35/0 a22/0+ n60/0 n80/2 n5/0",
    "n3/0 n90/0 n20/0 32/0+ 28/0+ n70/0",
]


@functools.lru_cache(maxsize=1)
def tree() -> Tree:
    examples = [*map(example, LABELLED), *map(sketch, SKETCHES)]
    return learn([r for rows, _ in examples for r in rows], [y for _, labels in examples for y in labels])


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks in page order, two line feeds between them; empty if there is none."""
    found = blocks(page)
    says = tree().says
    return "\n\n".join(b.text for b, x in zip(found, features(found), strict=True) if says(x))


def extract(pages: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """Adds text and n_chars (code points) to the ``keep`` columns, one row for each row.

    The whole page is used and nothing is capped. A null or empty page, or one without main text, gives an empty text.
    Repeated rows give repeated results; nulls in kept columns pass. No shuffle; the tree is a few nodes.
    """
    kept = pages.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), "text string, n_chars bigint"])
    return map_arrow(pages.select(*keep, F.col(page).alias("__page")), run, ddl)
