"""Neighbours against brute force, and pages of several templates."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvio.llm import ann, html_wrappers


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 32)).astype(np.float32)
    v[100:160] = v[99]  # copies
    rows = [(i, v[i].tolist()) for i in range(3000)] + [(4000, None), (4100, [0.0] * 32), (4200, [float("nan")] * 32), (4300, [1.0, None] * 16), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    s = ann.Settings(least_block=700)
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, s).collect()
    assert {r.query_id for r in got} == {i for i in range(0, 3000, 100)}
    d = v.astype(float)
    right = 0
    for q in range(0, 3000, 100):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        for _, i, score in mine:
            assert score == pytest.approx(dist[i], abs=1e-12) and i != q
        dist[q] = np.inf
        right += len({i for _, i, _ in mine} & set(np.lexsort((np.arange(3000), dist))[:10].tolist()))
    assert right / 300 >= 0.9
    first = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 100)
    assert [i for _, i in first] == [99, *range(101, 110)]  # ties go to the smaller id


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(df, F.col("vec_id") == 0).count() == 2
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_each_length_is_searched_among_its_own(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(5)] + [(200, [1.0] * 7)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, ann.Settings(k=3)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(q, i, q + i, float(i)) for q in (0, 100) for i in (1, 2, 3)]


BODY = "<h1>Title {0}</h1><p>First &amp; {0}\n  line</p><p><b>Second {0}<br></p><p>Third {0}</p>"
WANT = "Title {0}\nFirst & {0} line\nSecond {0}\nThird {0}"


def page(template, i):
    return template.replace("BODY", BODY.format(i)).replace("NOISE", f"noise {i} " + "x" * (i % 7))


TEMPLATES = [
    "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a>NOISE</a></li></ul></nav><div class='ad'>NOISE</div><article>BODY</article><footer>NOISE</footer>",
    "<body><header><p>NOISE</p></header><main>BODY<aside>NOISE</aside></main><div id='comments'><p>NOISE</p></div></body>",
    "<body><div class='menu-top'>NOISE</div><div class='post-content'>BODY<div class='cookie-notice'>NOISE</div><form><p>NOISE</p><input></form></div><div class='sidebar'><p>NOISE</p></div></body>",
    "<body><div><div role='navigation'>NOISE</div><div>BODY<!-- NOISE --></div><div class='reader-comments'><p>NOISE</p></div></div></body>",
]


def test_templates(spark):
    rows, want = [], {}
    for t, template in enumerate(TEMPLATES):
        for i in range(12):
            n = 100 * t + i
            rows.append((n, f"https://host{t}.example/{i}", page(template, n)))
            want[n] = WANT.format(n)
    got = {r.page_id: r for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_template_text_of_an_article_is_no_slot(spark):
    template = "<article><h1>Head NOISE</h1><span class='kicker'>Share this story</span><p>BODY</p></article>"
    rows = [(i, "http://h/1", template.replace("NOISE", str(i)).replace("BODY", f"text {i}")) for i in range(9)]
    got = {r.text for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {f"Head {i}\ntext {i}" for i in range(9)}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "http://a/", ""), (3, "no url", "plain &lt;text&gt;\n here"), (4, "http://b/", "<p>open <b>bold<p>next"), (5, "http://c/", deep), (5, "http://c/", deep), (6, "http://d/", "<article></article>"), (7, "http://e/", "< <> <!doctype <")]
    got = html_wrappers.extract_main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 8 and by[1] == by[2] == by[6] == "" and by[3] == "plain <text> here" and by[4] == "open bold\nnext" and by[5] == "deep"
    assert html_wrappers.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_layouts_mixed_on_one_host(spark):
    layouts = [
        "<body><nav>NOISE</nav><article>BODY</article></body>",
        "<body><nav>NOISE</nav><main>BODY</main></body>",
        "<body><nav>NOISE</nav><div class='post-content'>BODY</div></body>",
        "<body><nav>NOISE</nav><div><div>BODY</div></div><footer>NOISE</footer></body>",
        "<body><article></article><section class='story'>BODY</section></body>",
    ]
    rows = [(i, None if i < 40 else "https://mixed.example/x", page(layouts[i % 5], i)) for i in range(80)]
    got = html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {i: WANT.format(i) for i in range(80)}


def test_texts_that_all_pages_share_are_kept(spark):
    varied = "<article><h1>Head NOISE</h1><h2>Summary</h2><p>A fixed line.</p><div>Dateline</div><p>text NOISE</p></article>"
    rows = [(i, "http://varied/1", varied.replace("NOISE", str(i))) for i in range(9)]
    rows += [(100 + i, "http://copies/1", "<article><h1>One</h1><p>Short article.</p></article>") for i in range(9)]
    rows += [(200, "http://label/1", "<article><p>Before</p><p>Share this story</p><div>Share this story</div></article>")]
    got = {r.page_id: r.text for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Head {i}\nSummary\nA fixed line.\nDateline\ntext {i}" for i in range(9)}
    assert got == want | {100 + i: "One\nShort article." for i in range(9)} | {200: "Before\nShare this story"}


PARTS = """<h1>Head</h1><section id='discussion'><p>A</p></section><h2 id='search-results'>B</h2><h2 id='social-history'>C</h2><p id='related-work'>D</p>
<h3 id='comment-on-method'>E</h3><div class='promotion-rules'>F</div><table class='prices'><tr class='copyright'><td class='share'>G</td></tr></table><div class='replies'><p>H</p></div>
<div class='skip'>I</div><div class='rail'>J</div><div class='section' id='related'>L</div>"""
LEAVE = """<div class='related-posts'>x</div><ul class='comment-list'><li>x</li></ul><div class='share-buttons'>x</div><div class='share'><a>x</a> <a>x</a></div><div class='ad'>x</div>
<div id='comments'>x</div><div class='newsletterBox'>x</div><section id='related'><a>x</a></section><div class='site-navigation'>x</div><section id='comments'><p>K</p></section>"""


@pytest.mark.parametrize("around", ["<article>PARTS</article>", "<main>PARTS</main>", "<div class='post-content'>PARTS</div>"])
def test_names_of_an_article_s_parts(around):
    page = "<body><nav>x</nav>" + around.replace("PARTS", PARTS + LEAVE) + "<div class='comments'>x</div></body>"
    got = html_wrappers.Reader(html_wrappers.page_wrapper(page)).text(page)
    assert got.split("\n") == ["Head", *"ABCDEFGHIJL"]


@pytest.mark.parametrize("depth", [100, 119, 130, 4000])
def test_text_after_and_in_deep_elements(depth):
    deep = "<div>" * depth + "deep<nav>menu</nav><div class='ad'><p>advert</p></div><p>more<p>again" + "</div>" * depth
    page = f"<body><div><nav>x</nav><article><h1>Head</h1><div>{deep}</div><p>after</p></article><p>out</p></div>"
    got = html_wrappers.Reader(html_wrappers.page_wrapper(page)).text(page)
    assert got == "Head\ndeep\nmore\nagain\nafter"
    below = "<div>" * depth + "<nav>menu</nav><article>text</article>" + "</div>" * depth
    assert html_wrappers.Reader(html_wrappers.page_wrapper(below)).text(below) == "text"


STORY = "<p>" + "real words of the story go on and on. " * 8 + "</p>"
TOLD = " ".join(("real words of the story go on and on. " * 8).split())


@pytest.mark.parametrize(("page", "want"), [
    (f"<article><h1>T</h1>{STORY}<section id='comments'><p>nice post</p></section></article>", f"T\n{TOLD}"),
    (f"<article><h1>T</h1>{STORY}<div id='disqus_thread'><p>nice post</p></div></article>", f"T\n{TOLD}"),
    (f"<article><h1>T</h1>{STORY}</article><section class='comments'><article class='comment'><p>nice post</p></article></section>", f"T\n{TOLD}"),
    (f"<article><h1>T</h1>{STORY}</article><section class='related-posts'><article class='card'><p>teaser</p></article></section>", f"T\n{TOLD}"),
    (f"<article><h1>T</h1>{STORY}</article><div class='sidebar'><article><p>teaser</p></article></div>", f"T\n{TOLD}"),
    (f"<div class='sidebar'><article><h1>T</h1>{STORY}</article></div>", f"T\n{TOLD}"),
    (f"<form id='aspnetForm'><div class='content'><h1>T</h1>{STORY}</div></form>", f"T\n{TOLD}"),
    (f"<article>{STORY}<form><label>Your name</label><p>send it</p></form></article>", TOLD),
    (f"<article><h1>T</h1>{STORY}<section id='discussion'><p>of results</p></section></article>", f"T\n{TOLD}\nof results"),
    ("<div>" * 130 + f"<main><h1>T</h1>{STORY}</main><div><p>other stuff</p></div>" + "</div>" * 130, f"T\n{TOLD}"),
    ("<div>" * 13 + f"<main><h1>T</h1>{STORY}</main><div><p>other stuff</p></div>" + "</div>" * 13, f"T\n{TOLD}"),
])
def test_what_belongs_to_an_article(page, want):
    assert html_wrappers.Reader(html_wrappers.page_wrapper(page)).text(page) == want


def test_a_page_of_another_layout_keeps_its_text():
    pages = [f"<div class='content'><h1>T{i}</h1>{STORY}{STORY}</div>" for i in range(5)]
    odd = f"<div class='content'><h1>T</h1><p>short</p></div><div class='story'>{STORY}</div>"
    reader = html_wrappers.Reader(html_wrappers.merged([html_wrappers.page_wrapper(p) for p in [*pages, odd]]))
    assert TOLD in reader.text(odd)
    assert [reader.text(p) for p in pages] == [f"T{i}\n{TOLD}\n{TOLD}" for i in range(5)]


@pytest.mark.parametrize("bounds", [{"MOST_SHAPES": 3}, {"MOST_SHAPES": 10**9}, {"TABLE": 4}, {"TABLE": 1 << 40}])
def test_bounds_of_memory_do_not_change_texts(monkeypatch, bounds):
    r = random.Random(1)
    pages = []
    for i in range(90):
        parts = [f"<p>word{i} text of part {k} that goes on for a while</p>" + r.choice(["", "<ul><li>a</li><li>b</li></ul>", "<h2>x</h2>", "<blockquote>q</blockquote>"]) for k in range(r.randrange(1, 9))]
        tail = r.choice(["<aside>more</aside>", "<div class='share-buttons'>share</div>", ""])
        pages.append(f"<body><nav>menu</nav><article><h1>t{i}</h1>{''.join(parts)}</article>{tail}<footer>foot</footer></body>")

    def texts(some):
        held = html_wrappers.HostWrappers()
        for p in some:
            held.add("h", html_wrappers.page_wrapper(p))
        (row,) = held.leave()
        return html_wrappers.Reader(json.loads(row["wrapper"]))

    reader = texts(pages)
    plain = {p: reader.text(p) for p in pages}
    for name, value in bounds.items():
        monkeypatch.setattr(html_wrappers, name, value)
    for seed in (1, 2):
        shuffled = random.Random(seed).sample(pages, len(pages))
        reader = texts(shuffled)
        assert {p: reader.text(p) for p in pages} == plain


def test_an_id_that_repeats_is_asked_by_its_least_vector(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 40)] + [(100, [30.0, 1.0]), (100, [5.0, 1.0]), (100, [20.0, 1.0])]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = sorted((r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 100).collect())
        assert [i for _, i in got][:3] == [5, 4, 6]
