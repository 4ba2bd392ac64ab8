import html
import re

import pytest

from tessera.llm import html_extract
from tessera.llm.queries import op2_html_extract


def article(page):
    """The blocks of the synthetic pages' article, which is flat."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", inner.group(1)) if inner else []
    return "\n\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts) if x)


def test_whole_table(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = op2_html_extract(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


PROSE = "Rain fell all day on the quiet town, and nobody went out to look at the river before the evening came."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<", ""),
        ("<p", ""),
        (f"<article><h1>T &amp;amp; U</h1><p>{PROSE}</p><p>A<br>b <b>c</b>d&nbsp;&#233;</p></article><footer>x</footer>", f"T &amp; U\n\n{PROSE}\n\nA b cd é"),
        (f"<body><script>var a = '<p>no</p>';</script><style>p {{}}</style><!-- <p>no</p> --><nav><a href=1>n</a></nav><main><p>{PROSE}</p><aside>{PROSE}</aside></main></body>", PROSE),
        (f"<div class='cookie-banner'><p>{PROSE}</p></div><article><p>{PROSE}</p><form><p>{PROSE}</p></form><div id='comments'><p>{PROSE}</p></div></article>", PROSE),
        (f"<article><p>{PROSE}</p><p>Yes", f"{PROSE}\n\nYes"),
        (f"<div class=SideBar><p>{PROSE}</p></div><article data-x='a > b'><p>{PROSE}</p></article>", PROSE),
        (f"<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div><p>{PROSE}</p><p>{PROSE}</p></div><div>Contact</div>", f"{PROSE}\n\n{PROSE}"),
    ],
)
def test_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "head",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<SCRIPT type='a'>if(i<n) x = \"<!--\"</Script >",
        "<script><!--\nif(a<b){}\n//--></script>",
        "<script><!-- w('<script src=x></script>'); --></script>",
        "<script><!--></script>",
        "<script>'</scripts>' + '<p>no</p>'; i<n</script\n>",
        "<style>a<b{} <!-- </style>",
        "<title>a<b and <!-- c</title>",
        "<noscript>a<b</noscript><iframe>a<b</iframe><textarea>a<b</textarea>",
        "<template><script>i<n</script><p>no</p></template>",
        "<svg><title>x</svg>",
    ],
)
def test_dropped_content_is_no_markup(head):
    assert html_extract.main_text(f"<body>{head}<article><p>{PROSE}</p></article><footer>x</footer></body>") == PROSE


def test_labelled_pages_are_learned():
    for rows, labels in [*map(html_extract.example, html_extract.LABELLED), *map(html_extract.sketch, html_extract.SKETCHES)]:
        assert [html_extract.tree().says(r) for r in rows] == labels


def test_the_tree_uses_neighbours():
    used = set()

    def walk(node):
        if node.feature >= 0:
            used.add(html_extract.FEATURES[node.feature])
            walk(node.low)
            walk(node.high)

    walk(html_extract.tree())
    assert {"words", "link density"} < used and len(used & {"words before", "link density before", "words after", "link density after"}) >= 2


@pytest.mark.parametrize("name", "page-header post-form side-effects social-science story-comment legal-history notice-board".split())
def test_ordinary_class_names(name):
    assert html_extract.main_text(f"<nav><a href=1>Home</a></nav><article><div class={name}><p>{PROSE}</p><p>{PROSE}</p></div></article>") == f"{PROSE}\n\n{PROSE}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p>Buy two for one, only this week, in all our shops and on our pages for members and others.</p><article><p>{PROSE}</p><p>So.</p></article><p>{PROSE}</p>", f"{PROSE}\n\nSo."),
        (f"<div><a href=1>Home</a></div><div><a href=2>News</a></div><div><a href=3>Sport</a></div><h1>Rain on the town</h1><p>{PROSE}</p><p>{PROSE} {PROSE}</p><p><a href=4>Older</a></p><p><a href=5>Newer</a></p><p>All rights kept</p>", f"Rain on the town\n\n{PROSE}\n\n{PROSE} {PROSE}"),
        (f"<article><h1>Rain</h1><p>{PROSE}</p><ul><li><a href=1>More rain</a></li><li><a href=2>And snow</a></li><li><a href=3>Or sun</a></li></ul><p>{PROSE}</p></article>", f"Rain\n\n{PROSE}\n\n{PROSE}"),
        (f"<form action=x><div class=top><a href=1>Home</a></div><article><p>{PROSE}</p></article></form>", PROSE),
        (f"<article><p>{PROSE}</p></article><section class='comments'><article><p>{PROSE}</p></article></section>", PROSE),
        (f"<nav><a href=1>Home</a></nav><article><h1><a href=x>Rain on the town</a></h1><p>{PROSE}</p></article>", f"Rain on the town\n\n{PROSE}"),
        (f"<article><p>{PROSE}</p><article class='comment odd'><p>{PROSE}</p></article></article>", PROSE),
    ],
)
def test_unmarked_parts(page, text):
    assert html_extract.main_text(page) == text


def test_frames(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, f"<article><p>{PROSE}</p></article>"), (2, "v", "<p>x</p>" * 20000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' AS text", "0 AS n_chars"), ["page_id", "url"]).collect()
    assert len(got) == 4 and {r.n_chars for r in got if r.page_id == 1} == {0}
    assert next(r for r in got if r.page_id is None).text == PROSE
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string"), ["page_id"]).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_made_pages(seed):
    """Pages put together of known parts, with and without marks and an article element."""
    import random

    rng = random.Random(seed)
    say = lambda least, most: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(least, most)))
    menu = lambda: "".join(f"<li><a href='/{k}'>{say(1, 4)}</a></li>" for k in range(rng.randrange(3, 7)))
    text = [say(4, 9), *(say(22, 70) for _ in range(rng.randrange(3, 8)))]
    inner = f"<h1>{text[0]}</h1>" + "".join(f"<p>{p}</p>\n" for p in text[1:])
    if rng.random() < 0.5:
        parts = [f"<nav><ul>{menu()}</ul></nav>", f"<div class='promo'>{say(5, 40)}</div>", f"<p>{say(20, 40)}</p>", f"<article>{inner}<aside>{say(20, 40)}</aside></article>", f"<section id=comments><p>{say(20, 60)}</p></section>", f"<footer>{say(5, 20)}</footer>"]
    else:
        parts = [f"<ul>{menu()}</ul>", f"<div>{inner}</div>", f"<ul>{menu()}</ul>"]
    script = rng.choice(["", "<script>for(i=0;i<9;i++){}</script>", "<style>p{}</style><!-- x -->"])
    assert html_extract.main_text(f"<html><body>{script}{''.join(parts)}</body></html>") == "\n\n".join(text)
