import itertools
import math
import random

import numpy as np
import pytest

from loomspan.llm import html_extract
from loomspan.llm.html_tree import blocks
from tests.conftest import DATA


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.fit_on(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_marginals_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        parents = [-1, *[rng.randrange(i) for i in range(1, n)]]
        unary, pair = [rng.gauss(0, 2) for _ in range(n)], [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        total = np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(a * b for a, b in zip(unary, y)) + sum(pair[y[parents[i]]][y[i]] for i in range(1, n)))
            for i in range(n):
                total[i, y[i]] += w
        assert np.allclose(np.log(total[:, 1] / total[:, 0]), html_extract.marginals(parents, unary, pair))


def test_blocks():
    texts = lambda page: [t for _, t in blocks(page)[1]]
    assert texts("<p>a <b>b</b>\n c&amp;d &am; &#65;<p>next<br>line</p>tail") == ["a b c&d &am; A", "next line", "tail"]
    assert texts("<script>x<p>y</script><style>p{}</style><!-- <p>no</p> --><p>yes") == ["yes"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<p>a<div>b</div>c") == ["a", "b", "c"]
    assert texts('<p title="a>b">x</p>< y') == ["x", "< y"]
    assert texts("<p>open <b>bold<p>not in it</b></p></div></span>") == ["open bold", "not in it"]
    assert texts(None) == texts("") == texts("<p> &nbsp; </p>") == []
    assert texts("<script>never closed") == []
    assert len(texts("<div>" * 3000 + "deep")) == 1


def test_pages_of_the_table(spark, model):
    import html
    import re

    for row in html_extract.extracted(spark.read.parquet(f"{DATA}/pages.parquet"), model).collect():
        inside = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1|article)\b[^>]*>", re.sub("<br>", " ", inside))
        lines = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in parts]
        assert row.text == "\n".join(x for x in lines if x)
        assert row.n_chars == len(row.text)


@pytest.mark.parametrize("around", ['<div class="menu-bar">{}</div>', "<nav><p>{}</p></nav>", '<div id="cookie-banner"><p>{}</p></div>', '<section class="user-comments"><div><p>{}</p></div></section>', "<aside><p>{}</p></aside>", "<form><p>{}</p></form>", '<div class="ads">{}</div>', "<footer>{}</footer>", '<div class="sidebar"><ul><li>{}</li></ul></div>'])
def test_other_layouts(model, around):
    other = "Some other words that stand in a box, and are long enough to be read."
    page = f'<body><div id="main"><h1>Head line</h1><p>First words of the article, which go on for a while.</p>{around.format(other)}<p>Last words of the article, and that is that.</p></div>{around.format(other)}</body>'
    text = html_extract.main_text(page, model)
    assert text == "Head line\nFirst words of the article, which go on for a while.\nLast words of the article, and that is that."


#: Layouts that training doesn't know: (page, lines). {} stands for running text.
RUNNING = "Some words of the article, which go on for a while, and then some more of them follow here."
UNSEEN = {
    "topics in an article's class": ('<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article class="post tag-news category-ad"><p>{}</p><ul><li>item one is here</li><li>item two</li></ul></article></body>', ["{}", "item one is here", "item two"]),
    "a header in the article": ("<body><article><header><h1>Real title</h1></header><p>{}</p><p>{} x</p></article></body>", ["Real title", "{}", "{} x"]),
    "a paragraph that is a link": ('<body><article><h1>T one</h1><p>{}</p><p><a href="x">A paragraph that is one link</a></p><p>{} y</p></article></body>', ["T one", "{}", "A paragraph that is one link", "{} y"]),
    "text without markup": ("{} {}", ["{} {}"]),
    "text in the body": ("<body>{}<br>{}</body>", ["{} {}"]),
    "a foot without a name": ("<body><div><h1>T one</h1><p>{}</p><p>{} z</p></div><div>Copyright 2020 All rights reserved</div></body>", ["T one", "{}", "{} z"]),
    "a foot in another language": ('<body><div><h1>T one</h1><p>{}</p><p>{} z</p></div><div id="fusszeile">Some words at the foot</div></body>', ["T one", "{}", "{} z"]),
    "comments as articles": ('<body><main><h1>Title</h1><p>{}</p><p>{} b</p></main><section id="comments"><h2>Comments</h2><article class="comment"><p>I like this very much, thanks for it.</p></article></section></body>', ["Title", "{}", "{} b"]),
    "a table for the layout": ("<table><tr><td><a href=a>one</a><br><a href=b>two</a></td><td><h1>Title</h1><p>{}</p><p>{} c</p></td></tr></table>", ["Title", "{}", "{} c"]),
    "a blog": ('<div id="page"><header id="masthead"><p>My site</p></header><div id="content"><div class="entry-content"><h2>Sub</h2><p>{}</p><blockquote>Quoted words stand here</blockquote><p>{} d</p><div class="sharedaddy"><ul><li><a href=1>Tweet</a></li></ul></div></div></div><div id="secondary" class="widget-area"><h3>Recent</h3><ul><li><a href=1>One post</a></li></ul></div><footer id="colophon"><p>Proudly powered</p></footer></div>', ["Sub", "{}", "Quoted words stand here", "{} d"]),
    "a listing": ("<main><h1>How to</h1><p>{}</p><pre>x = 1\ny = 2</pre><p>{}</p></main><footer>foot words</footer>", ["How to", "{}", "x = 1 y = 2", "{}"]),
    "an article shorter than what is beside it": ("<nav><ul><li><a href=1>Home</a></li><li><a href=1>About</a></li></ul></nav><article><h1>Tiny</h1><p>Just a few words.</p></article><aside><p>Some side text that is longer than the article itself, by far, and goes on and on.</p></aside><footer>c</footer>", ["Tiny", "Just a few words."]),
    "columns without names": ('<div class="container"><div class="col-8"><h1>Head</h1><p>{}</p><form class="newsletter"><p>Sign up for news</p><input><button>Go</button></form><p>{} e</p></div><div class="col-4"><h4>Trending</h4><ul><li><a href=1>A thing</a></li><li><a href=2>B thing</a></li></ul></div></div>', ["Head", "{}", "{} e"]),
    "terms": ("<article><h1>Words</h1><p>{}</p><dl><dt>Term</dt><dd>What it means, in some words</dd></dl></article>", ["Words", "{}", "Term", "What it means, in some words"]),
    "divisions for paragraphs": ('<div class="post-body"><div>{}</div><div>{} f</div></div><div class="related-posts"><a href=1>Other one</a></div>', ["{}", "{} f"]),
}


@pytest.mark.parametrize("layout", UNSEEN)
def test_unseen_layouts(model, layout):
    page, lines = UNSEEN[layout]
    assert html_extract.main_text(page.replace("{}", RUNNING), model) == "\n".join(lines).replace("{}", RUNNING)


def test_labels_of_made_up_pages_are_learned(spark, model):
    """Held-out pages of the generator: nearly all words are judged as labelled."""
    texts = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").limit(8).collect()]
    right = whole = 0
    for page in html_extract.training_pages(texts[::-1]):
        nodes, runs, labels = blocks(page)
        known = list(labels) if any(labels) else ["1"] * len(nodes)
        for i in range(1, len(nodes)):
            known[i] = labels[i] or known[nodes[i].parent]
        kept = html_extract.main_text(page, model).split("\n")
        for i, text in runs:
            if known[i] in ("0", "1"):
                whole += len(text)
                right += len(text) * ((text in kept) == (known[i] == "1"))
    assert right >= 0.93 * whole, right / whole


def test_clashing_columns_and_long_pages(spark, model):
    rows = [(1, "<article><p>" + "word " * 200_000 + "</p></article>" + "<nav><a>x</a></nav>" * 1000), (None, "<article><p>Words to read, some more of them.</p></article>"), (1, None)]
    df = spark.createDataFrame([(*r, "u", "x", 1, 2) for r in rows], "page_id long, html string, url string, MAIN_TEXT string, N_Chars int, Text int")
    got = html_extract.extracted(df, model)
    assert [c for c in got.columns if c.lower() in ("text", "n_chars")] == ["text", "n_chars"] and "MAIN_TEXT" in got.columns
    assert sorted(r.n_chars for r in got.collect()) == [0, len("Words to read, some more of them."), 999_999]


def test_odd_rows(spark, model):
    rows = [(1, None, "u"), (2, "", "u"), (3, "<p></p>", "u"), (3, "<p></p>", "u"), (4, "<article><p>" + "word " * 50_000 + "</p></article>", None)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "page_id long, html string, url string, n_chars int, main_text string")
    got = html_extract.extracted(df, model).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 0), (3, 0), (3, 0), (4, 249_999)]
    assert html_extract.extracted(df.limit(0), model).count() == 0


def test_a_table_without_pages_still_gives_a_model(spark):
    for rows in ([], [(None, "<p>x</p>"), (1, None), (2, "<article><p>a</p></article>"), (2, "<article><p>a</p></article>")]):
        learned = html_extract.fit_on(spark.createDataFrame(rows, "page_id long, html string"))
        assert html_extract.main_text("<nav><a>menu</a></nav><article><p>Words that are read, one after another.</p></article>", learned) == "Words that are read, one after another."
