"""Main texts against a plain reading of the given pages, and against pages made by hand."""

import html
import random
import re

import duckdb
import pytest
from pulseloom.llm import wrappers as wr

SF = "/root/testdata/sf0.01"


def plain(source):
    """The article of the given tables, read by its fixed form."""
    found = re.search(r"<article>(.*?)</article>", source or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts) if t)


def test_query_against_plain_reading(spark):
    want = {i: (u, plain(h)) for i, u, h in duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()}
    rows = wr.op11_html(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r["url"], r["text"]) == want[r["page_id"]] and r["n_chars"] == len(r["text"])


def texts(spark, pages, **more):
    df = spark.createDataFrame([(i, u, h, 5, "z") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host int, text string")
    found = wr.extract(df, wr.infer_wrappers(df))
    assert found.columns == ["page_id", "url", "html", "host", "text"]
    return [r["text"] for r in found.orderBy("page_id").collect()]


NOISE = (
    '<header class=top><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><a href="/">Home</a></nav>{}<aside>More</aside>'
    '<form><p>Write to us</p></form><section id="comments"><article class="comment"><p>First!</p></article></section><footer>(c) us</footer>'
)


def test_with_article(spark):
    body = '<article><h1>On  A&amp;B</h1><p>One <b>b</b>old<br>line &lt;p&gt; <script>var x = "</p>";</script>on.<p>Two<div class="ad-slot">Buy!</div>tail<!-- <p>no --><ul><li>x<li>y</ul></article>'
    pages = [("http://A.example/x", NOISE.format(body)), ("http://a.example/y", NOISE.format("<article><p>Only</article>"))]
    assert texts(spark, pages) == ["On A&B\n\nOne bold line <p> on.\n\nTwo\n\ntail\n\nx\n\ny", "Only"]


def test_without_article(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(2, 9) for _ in range(n))
    pages, want = [], []
    for i in range(12):
        paras = [words(rng.randint(5, 60)) for _ in range(rng.randint(1, 5))]
        body = f'<div class="with-sidebar"><div class="col post-{i}">' + "".join(f"<p>{p}</p>" for p in paras) + '<div class="share">Share this</div><p>All rights reserved.</p></div></div>'
        pages.append((f"https://b.example/{i}", NOISE.format(body)))
        want.append("\n\n".join(paras))
    got = texts(spark, pages)
    assert [g.replace("\n\nAll rights reserved.", "") for g in got] == want


def test_template_text_goes_where_pages_differ(spark):
    pages = [(f"http://c.example/{i}", f"<div><p class=lead>Sign here</p><div class=x><p>{'text ' * (20 + i)}</p></div></div>") for i in range(12)]
    assert texts(spark, pages) == [("text " * (20 + i)).strip() for i in range(12)]
    same = [("http://d.example/", "<div><p>All the same</p></div>")] * 12
    assert texts(spark, same) == ["All the same"] * 12


def test_odd_rows(spark):
    long = "<article>" + "<p>" + "word " * 200_000 + "</article>"
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    pages = [
        (None, None), ("no host", ""), (None, "plain words"), ("http://e.example", "<p"), ("http://e.example", "<p>a < b &amp; c</p>"), ("http://f.example", long),
        ("http://g.example", deep), ("http://h.example", "<script>never closed <p>x"), ("http://i.example", "<article><p class='it's>quoted</p>"), ("http://j.example", '<a href="x' * 500),
    ]
    got = texts(spark, pages + pages[4:5])
    assert got[0] == got[1] == "" and got[2] == "plain words" and got[4] == got[-1] == "a < b & c"
    assert got[5] == ("word " * 200_000).strip() and got[6] == "deep text" and got[7] == "" and got[8] == "quoted"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert wr.extract(empty, wr.infer_wrappers(empty)).count() == 0


def test_expression():
    one = wr.wrapper_of(wr.Page("<div><h1>Top</h1><p>a</p><p>b</p></div>"))
    two = wr.wrapper_of(wr.Page("<div><h1>Top</h1><p>c</p><ul><li>x</li></ul><p>d</p></div><i>z</i>"))
    assert wr.expression(wr.align(one, two)["root"]) == "<div><h1>=</h1>((<p>#</p>)?(<ul><li>=</li></ul>)?)+</div>(=)?"


@pytest.mark.parametrize("seed", range(4))
def test_order_of_alignment_does_not_matter(seed, monkeypatch):
    monkeypatch.setattr(wr, "KEYS", 6)
    rng = random.Random(seed)
    made = lambda: "".join(rng.choice(["<p>t</p>", "<div class={}>u</div>".format(rng.choice("abcdefghijkl")), "<ul><li>x</ul>", "<h2>{}</h2>".format(rng.random())]) for _ in range(rng.randint(1, 6)))
    pages = [f"<section>{made()}</section>" for _ in range(30)]
    def chain(order):
        whole = wr.wrapper_of(wr.Page(order[0]))
        for p in order[1:]:
            whole = wr.align(whole, wr.load(wr.dump(wr.wrapper_of(wr.Page(p)))))
        return wr.expression(whole["root"])
    a = chain(pages)
    rng.shuffle(pages)
    assert chain(pages) == a


def test_many_partial_wrappers(spark, monkeypatch):
    monkeypatch.setattr(wr, "FAN", 2)
    rows = [(i, f"http://k{i % 3}.example/{i}", f"<article><p>text {i}</p></article><p>menu</p>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
    found = wr.infer_wrappers(df).collect()
    assert {r["host"]: r["n_pages"] for r in found} == {f"k{i}.example": 20 for i in range(3)}
