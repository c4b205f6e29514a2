import html
import re

from veilstream.llm.page_crf import Field, blocks_of, extract, labelled_pages, main_text, trained

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<header><p>Site header</p><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies on this site.</p></div>
<aside class=sidebar><h3>Side</h3><p>A sidebar with a rather long text that reads like prose.</p></aside>
<article><h1>The &quot;title&quot;&nbsp;here</h1><p>First   paragraph &amp; more <b>bold</b>text&#33;<br>Second line
<p>Unclosed paragraph &lt;tag&gt; <script>var x = "</p><p>not text";</script>goes on.<!-- unseen <p> --><ul><li>Item one.</li><li>Item two.</ul>
<div class="ad"><p>Buy this great product now, it is long enough to be prose.</p></div>
<form><label>Your name</label><p>Subscribe to the letter.</p><button>Send</button></form>
<p>Last words.</p>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I think this is a long reader comment about the text.</p></div></section></article>
<footer><p>&copy; Someone</p></footer></body></html>"""


def test_page():
    assert main_text(PAGE, trained()) == ('The "title" here First paragraph & more boldtext! Second line '
                                          "Unclosed paragraph <tag> goes on. Item one. Item two. Last words.")


def test_new_layouts():
    field, right = trained(), 0
    pages = list(labelled_pages(150, seed=7))
    for page, keep in pages:
        right += main_text(page, field) == " ".join(" ".join(html.unescape(k).split()) for k in keep)
    assert right >= 145


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.DOTALL)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split()) and r.n_chars == len(r.text)


def test_odd_pages(spark, clashing):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "</p></div>&am"), (5, "u", "<script>x"), (6, "u", "<article>" + "<p>word " * 5000),
             (6, "u", "<article><p>cut &amp"), (7, "u", "<!-- open"), (8, "u", "<" * 3000), (None, "u", "<article><p a='>'>x</article>")]
    rows = extract(clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    by_url = {(r.page_id, r.n_chars): r.text for r in rows}
    assert len(rows) == len(pages) and by_url[1, 0] == by_url[2, 0] == by_url[5, 0] == by_url[7, 0] == ""
    assert by_url[6, 24999] == ("word " * 5000).strip() and by_url[6, 5] == "cut &" and by_url[None, 1] == "x"
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_blocks():
    found = blocks_of("<div>a <i>b</i><p>c<p>d</div>e<table><tr><td>f<td>g</table>")
    assert [t for t, _, _ in found] == ["a b", "c", "d", "e", "f", "g"]
    assert [p.tag if p else None for _, p, _ in found] == ["div", "p", "p", None, "td", "td"]


def test_attributes_as_html_reads_them():
    for mark in ("title=it's", "title=it's class=", 'title=a"b', "title='a>b'", 'title="a>b" hidden2', "data-class=ad", 'data-x="class=ad"', "x='id=comments'",
                 'title="id=ad" =', "/ title=it's/"):
        page = f"<article><p>Before it.</p><p {mark}>A paragraph, and it's kept.</p><p>After it's gone.</p></article>"
        assert [t for t, _, _ in blocks_of(page)] == ["Before it.", "A paragraph, and it's kept.", "After it's gone."], mark
        assert main_text(page, trained()) == "Before it. A paragraph, and it's kept. After it's gone.", mark
    assert main_text('<article><p>Kept text.</p><div CLASS = ad><p>Buy this now.</p></div></article>', trained()) == "Kept text."


def test_formulas_and_objects_are_read():
    page = ("<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, <svg><title>no</title><text>drawn</text></svg> and "
            "<object>an object</object><select><option>one<option>two</select> is.</p><p>Next <noscript>to scripts</noscript>.</p></article>")
    assert main_text(page, trained()) == "Where x=2 holds, drawn and an object is. Next to scripts."
    # what nothing closes ends with its parent
    assert main_text("<article><div><select><option>one</div><p>Text that goes on.</p></article>", trained()) == "Text that goes on."
    assert main_text("<article><p>First words.</p><textarea><p>Text that goes on.</p></article>", trained()) == "First words. Text that goes on."
    assert main_text("<article><p>First words.</p><script>var a<p>Text</article>", trained()) == "First words."


def test_deep_and_broken_pages_take_linear_time():
    import time
    n = 100_000
    begin = time.time()
    for page in ("<div>" * n + "x", "<div>a" * n, "<b><div>" + "<i>" * n + "</b>x" * n, "<p>" * n + "</p>" * n, "<title>" * n, "<table><tr><td>" * (n // 3) + "x",
                 "<p a=" + "'" * n + ">x", "<p " + "a =" * n + ">x", "<" * n, "<p" + "/ " * n, "<li><ul>" * (n // 2) + "x"):
        blocks_of(page)
    assert time.time() - begin < 20


def test_viterbi_by_brute_force():
    import itertools
    import random
    import numpy as np
    r, field = random.Random(3), Field()
    field.weights, field.moves = np.random.default_rng(1).normal(size=field.weights.shape), np.random.default_rng(2).normal(size=(2, 2))
    for n in range(7):
        rows = [[r.randrange(len(field.weights)) for _ in range(3)] for _ in range(n)]

        def score(labels):
            return sum(field.weights[x, y].sum() for x, y in zip(rows, labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))
        assert score(field.decode(rows)) == max((score(x) for x in itertools.product((0, 1), repeat=n)), default=0)
