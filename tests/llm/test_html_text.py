"""Main text of pages of several layouts; the cut against all labellings; the reader's odd inputs."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import html_text
from millrace.llm.html_text import PRIOR, capacities, features, min_cut, read_blocks, text_of
from millrace.llm.queries import QUERIES

LONG = [
    "The river had risen over night, and by the morning the lower fields were under water as far as the mill.",
    "Nobody in the village could remember a flood so late in the year; the old people spoke of one in their childhood.",
    "By noon the council had met, and men with boats were sent to the farms that could no longer be reached by road.",
    "It was over.",
    "The water fell as quickly as it had come, and what it left behind was mud, broken fences and a great deal of work.",
]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LONG)
TEXT = " ".join(LONG)
MENU = "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Weather", "Contact us")) + "</ul>"
COOKIE = '<div class="cookie-notice" role="dialog"><p>We use cookies to give you the best experience. By going on you agree to our terms.</p><button>Accept</button></div>'
COMMENTS = '<section id="comments"><h2>3 comments</h2>' + "".join(f'<article class="comment"><p>{x}</p></article>' for x in ("What a sad story, I hope that all the families are well and safe now.", "My uncle lives there, he says that it was far worse than you write.")) + "</section>"
FORM = '<form action="/s"><label>Your name</label><input name="n"><p>Sign up for our weekly letter, we send no more than one a week.</p><select><option>Daily</option></select><textarea>Type here</textarea></form>'
RELATED = '<div class="related-posts"><h3>You may also like</h3>' + "".join(f'<div><a href="/r{i}">Another story of the week, number {i}</a></div>' for i in range(4)) + "</div>"

PAGES = {
    "landmarks": f"<html><head><title>x</title></head><body><header><h1>The Daily</h1>{MENU}</header><nav>{MENU}</nav><main><article><h1>A flood</h1>{PARAGRAPHS}</article></main><aside><p>{LONG[0]} Read more in our paper edition.</p></aside><footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer></body></html>",
    "classes": f'<body class="has-sidebar"><div id="wrapper" class="with-sidebar"><div class="site-header"><a href="/">The Daily</a></div><div id="navbar">{MENU}</div><div class="post-content"><h1>A flood</h1>{PARAGRAPHS}</div><div class="sidebar"><p>{LONG[1]}</p>{MENU}</div><div class="site-footer">Imprint &middot; Contact</div></div></body>',
    "advert inside": f'<article><h1>A flood</h1><p>{LONG[0]}</p><div class="ad">Buy the best boats of the year now, only this week at half the price!</div><p>{LONG[1]}</p><p>{LONG[2]}</p><p>{LONG[3]}</p><div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div><p>{LONG[4]}</p></article>',
    "notices and comments": f"{COOKIE}<main><h1>A flood</h1>{PARAGRAPHS}{COMMENTS}</main>{RELATED}",
    "comments inside": f'<article class="post"><h1>A flood</h1>{PARAGRAPHS}<div class="comment-list"><p>I was there, and it was just as you say in your story.</p></div></article>',
    "forms": f"<article><h1>A flood</h1>{PARAGRAPHS}{FORM}</article><noscript>Please turn on scripts.</noscript>",
    "no landmarks": f"<table><tr><td>{MENU}</td></tr><tr><td><h1>A flood</h1>{PARAGRAPHS}</td></tr><tr><td><a href='/a'>About</a> | <a href='/i'>Imprint</a></td></tr></table>",
    "plain divisions": f"<div><div>{MENU}</div><div><h1>A flood</h1><div>{'</div><div>'.join(LONG)}</div></div><div><a href=/x>Next</a> <a href=/y>Previous</a></div></div>",
    "old style": f"<body bgcolor=white><center><a href=a>Home</a> | <a href=b>Back</a></center><h1>A flood</h1>{'<p>'.join(['', *LONG])}<hr><a href=c>Home</a> | <a href=d>Back</a></body>",
    "hidden": f'<article><h1>A flood</h1>{PARAGRAPHS}<div style="display:none"><p>{LONG[0]} hidden</p></div><p hidden>{LONG[1]} hidden</p></article>',
}


@pytest.fixture(scope="module")
def fitted(spark, data):
    return html_text.fit(spark.read.parquet(f"{data}/pages.parquet"))


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layouts(name, fitted):
    """The paragraphs and nothing else, with the weights before and after fitting; the heading is the article's."""
    for w in (np.array(list(PRIOR.values())), fitted):
        assert text_of(PAGES[name], w) == f"A flood {TEXT}"


def test_fitted_weights_use_the_text(fitted):
    w = dict(zip(PRIOR, fitted, strict=True))
    assert w["links"] < 0 < w["length"] and w["article"] > 0 > w["outside"] and not np.allclose(fitted, list(PRIOR.values()))


def test_cut_is_the_least_of_all_labellings():
    r = np.random.default_rng(7)
    for _ in range(300):
        n = int(r.integers(1, 9))
        cost = r.integers(-20, 21, n).tolist()
        pairs = [p for p in itertools.combinations(range(n), 2) if r.random() < 0.5]
        edges = [(i, j, int(r.integers(0, 12))) for i, j in pairs]
        energy = lambda own: sum(-c if o else 0 for c, o in zip(cost, own, strict=True)) + sum(c for i, j, c in edges if own[i] != own[j])
        least = min(map(energy, itertools.product([False, True], repeat=n)))
        got = min_cut(cost, edges)
        assert energy(got) == least
        smallest = min((sum(o), o) for o in itertools.product([False, True], repeat=n) if energy(o) == least)
        assert sum(got) == smallest[0]


def test_neighbours_carry_a_doubtful_block():
    """A short unclear paragraph goes with what it stands among."""
    w = np.array(list(PRIOR.values()))
    bare = [b for b in read_blocks(f"<div><p>{LONG[0]}</p><p>Ah yes</p><p>{LONG[1]}</p></div>")]
    alone = features(bare)[1] @ w
    cost, edges = capacities(bare, np.array([5.0, -1.0, 5.0]))
    assert alone < 5 and min_cut(cost, []) == [True, False, True] and min_cut(cost, edges) == [True, True, True]


def test_large_page(fitted):
    html = f"<nav>{MENU}</nav><article>" + PARAGRAPHS * 4000 + '<div class="ad">buy</div>' * 500 + f"</article>{COMMENTS}"
    assert text_of(html, fitted) == " ".join([TEXT] * 4000)


ODD = {
    None: "", "": "", "   ": "", "<": "", "plain text, and no more than that, which is all there is here.": "plain text, and no more than that, which is all there is here.",
    "<article><p>a &lt;b&gt; &amp;amp; &eacute;&#233;&#xE9; &nbsp; x&amp": "a <b> &amp; ééé x&",
    "<article>one<b>two</b>three<br>four<p>five<p>six": "onetwothree four five six",
    "<article><p>a<!-- no -- no --> b</p><!-- open <p>c</p>": "a b",
    '<article><p title="a > b">x</p><p title="open>y</p>': "x y",
    "<article><script>var x = '<p>no</p>';</script><style>p{}</style><p>yes</p><script>never ends <p>no</p>": "yes",
    "<ARTICLE><P>Upper</P></ARTICLE><NAV>no</NAV>": "Upper",
    "<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>": "one two a b",
    "<article></nav></aside></div><p>stray ends</p></article>": "stray ends",
    "<article><p>1 < 2 and 3 > 2</p></article>": "1 < 2 and 3 > 2",
}


HOSTILE = {"open quotes": '<a href="' * 20_000, "open tags": "<a " * 100_000, "brackets": "<" * 100_000, "deep": "<div>x" * 10_000, "comments": "<!--" * 50_000, "scripts": "<script " * 20_000, "ends": "</p" * 50_000, "attributes": "<p " + 'a="b" ' * 50_000 + ">x"}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_are_read_once(name, fitted):
    began = time.time()
    text_of(HOSTILE[name], fitted)
    assert time.time() - began < 10


@pytest.mark.parametrize("html", list(ODD), ids=lambda h: str(h)[:30])
def test_odd_html(html, fitted):
    assert text_of(html, fitted) == ODD[html]


def test_rows_and_columns(spark, fitted):
    names = "Text n_chars doc html2 none block score".split()
    df = spark.createDataFrame([(i, h) for i, h in enumerate(ODD)], "page_id long, html string")
    wide = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    got = html_text.extract(wide.unionByName(wide), fitted)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and "html" not in got.columns
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.where("doc = 2 and none = 4").collect()) == sorted((i, t, len(t)) for i, t in enumerate(ODD.values()) for _ in range(2))
    assert "html" in html_text.extract(wide, fitted, keep_html=True).columns
    assert html_text.extract(df.where("false"), fitted).count() == 0 and html_text.label_blocks(df.where("false"), fitted).count() == 0
    assert html_text.extract(df.select("html"), fitted).count() == len(ODD)
    rows = html_text.label_blocks(wide, fitted)
    assert {r.page_id: " ".join(x.block_text for x in sorted(rows.where(F.col("page_id") == r.page_id).collect(), key=lambda x: x.block) if x.content) for r in df.where("page_id in (5, 7)").collect()} == {5: "a <b> &amp; ééé x&", 7: "a b"}


def test_fit_on_few_repeated_or_no_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("html")
    hot = pages.limit(1).crossJoin(spark.range(3000)).select("html")
    few = html_text.fit(pages.unionByName(hot), max_pages=20)
    assert np.allclose(few, html_text.fit(pages.unionByName(hot), max_pages=20))
    assert np.allclose(html_text.fit(pages.unionByName(hot)), html_text.fit(pages))  # copies count once
    assert np.allclose(html_text.fit(pages.where("false")), list(PRIOR.values()))


def test_query(spark, data):
    got = QUERIES["op12_html"](spark, data)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
