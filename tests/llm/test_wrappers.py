"""op4: wrappers on hosts whose pages differ, and texts against what the pages were made of."""

import random
import re

import pyarrow.parquet as pq

from siftline.llm import wrappers as W


def test_alignment_makes_groups_and_options():
    one = W.fold(W.parse("<body><h1>a</h1><p>x</p><p>y</p></body>")[1])
    two = W.fold(W.parse("<body><h1>a</h1><p>x</p></body>")[1])
    three = W.fold(W.parse("<body><p>x</p><div>z</div></body>")[1])
    made = W.infer([(" ".join(f), 1) for f in (one, two, three)])
    assert "(<p>|#/body/p|</p>)+" in made
    assert ")?" in made
    assert set(re.findall(W.SLOT, made)) == {"/body/h1", "/body/p", "/body/div"}


def page(rnd, k):
    say = lambda: " ".join(rnd.choice("one two three four five".split()) for _ in range(rnd.randrange(1, 9))) + f" {k}"
    title, paragraphs = say(), [say() for _ in range(rnd.randrange(1, 7))]
    parts = ["<!DOCTYPE html><html><head><title>t</title><script>var a='<p>no</p>';</script></head><body>"]
    if rnd.random() < 0.8:
        parts.append("<nav><ul>" + "".join(f"<li><a href='/{i}'>menu {i}</a></li>" for i in range(rnd.randrange(1, 5))) + "</ul></nav>")
    if rnd.random() < 0.5:
        parts.append("<div class='cookie-notice'>We use cookies</div>")
    parts.append(f"<article><h1>{title}</h1>" + "".join(f"<p>{p} &amp; <b>bold</b>\n more<br>x" for p in paragraphs))
    if rnd.random() < 0.5:
        parts.append("<aside>see also</aside>")
    parts.append("</article>")
    if rnd.random() < 0.4:
        parts.append("<section id='comments'><p>nice post</p></section>")
    parts.append("<form><input name=q><button>Go</button></form><footer>&copy; me</footer></body></html>")
    return "".join(parts), "\n".join([title, *(f"{p} & bold more x" for p in paragraphs)])


def test_pages_of_one_host_with_many_forms(spark):
    rnd = random.Random(5)
    made = [page(rnd, k) for k in range(300)]
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 7}'}.example/{i}", h) for i, (h, _) in enumerate(made)]
    got = {r.page_id: r for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == want and got[i].n_chars == len(want) for i, (_, want) in enumerate(made))


def test_more_forms_than_a_group_holds(spark, monkeypatch):
    monkeypatch.setattr(W, "PER_GROUP", 4)
    rnd = random.Random(6)
    rows, want = [], []
    for i in range(120):
        tags = [rnd.choice(("div", "section", "p", "h2")) for _ in range(rnd.randrange(1, 6))]
        rows.append((i, "http://x.example/", "<body>" + "".join(f"<{t}>t{i}-{k}</{t}>" for k, t in enumerate(tags)) + "<ul><li><a href=1>link words</a></li></ul></body>"))
        want.append("\n".join(f"t{i}-{k}" for k in range(len(tags))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert W.wrappers(df).count() == 1
    assert {r.page_id: r.text for r in W.extract(df).collect()} == dict(enumerate(want))


def test_long_repeats_fold():
    row = "<section>" + "".join(f"<h{k % 6 + 1}>a</h{k % 6 + 1}><div><p>x</div>" for k in range(12)) + "</section>"
    once, more = (W.fold(W.parse(f"<body>{row * n}</body>")[1]) for n in (2, 5))
    assert once == more and len(once) == 3


def test_template_texts_in_plain_elements(spark):
    """No article, no telling names: only texts that differ between a host's pages are data."""
    rnd = random.Random(7)
    rows, want = [], {}
    for i in range(60):
        paragraphs = [f"paragraph {i} {k} of the story" for k in range(rnd.randrange(1, 5))]
        offer = "<section>Offers of the week</section>" if rnd.random() < 0.4 else ""
        more = "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f"<body><div>The Daily brings you the world</div><div>Story {i}</div>{more}{offer}<div>Call our office</div></body>"
        rows.append((i, "http://x.example/", page))
        want[i] = "\n".join([f"Story {i}", *paragraphs])
    # two pages are too few, and copies count once
    rows += [(100 + i, "http://two.example/", f"<div>Hello</div><div>text {i}</div>") for i in range(2)]
    want |= {100 + i: f"Hello\ntext {i}" for i in range(2)}
    rows += [(200 + i, "http://copies.example/", "<div>Hello</div><div>same</div>") for i in range(20)]
    want |= {200 + i: "Hello\nsame" for i in range(20)}
    # an article keeps its texts, shared or not
    rows += [(300 + i, "http://art.example/", f"<div>Hello</div><article><h1>News</h1><p>{i}</p></article>") for i in range(9)]
    want |= {300 + i: f"News\n{i}" for i in range(9)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in W.extract(df).collect()} == want
    made = {r.host: r.wrapper for r in W.wrappers(df).collect()}
    assert "=" in made["x.example"] and ")+" in made["x.example"] and ")?" in made["x.example"]


def test_edges(spark):
    rows = [
        (1, None, None), (2, "no host", ""), (3, "http://a.example/", "just words"), (4, "http://a.example/", "<p>a<p>b"), (5, "http://a.example/", "<script>x"),
        (6, "http://a.example/", "a < b &lt; c<div"), (6, "http://a.example/", "<div>" * 3000 + "deep"), (2**60 + 1, "http://b.example/", "<x(y+)?|!>q</x(y+)?|!>"), (None, "http://b.example/", "<main>  m&nbsp;n \n o </main>"),
        (7, "http://c.example/", "<p>" + "w " * 300_000 + "</p>"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.n_chars): r.text for r in W.extract(df).collect()}
    assert len(got) == len(rows)
    texts = sorted(got.values(), key=len)
    assert got[1, 0] == got[2, 0] == got[5, 0] == ""
    assert got[3, 10] == "just words" and got[4, 3] == "a\nb" and got[6, 4] == "deep" and got[None, 5] == "m n o"
    assert got[2**60 + 1, 1] == "q" and len(texts[-1]) == 599_999
    assert W.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    """Texts against the article elements of the driver's pages, read in a plain way."""
    import html as H

    path = "/root/testdata/sf0.01/pages.parquet"
    want = {}
    for r in pq.read_table(path).to_pylist():
        body = re.search(r"<article>(.*)</article>", r["html"] or "", re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", body)
        plain = [" ".join(H.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        want[r["page_id"]] = "\n".join(b for b in plain if b)
    assert {r.page_id: r.text for r in W.extract(spark.read.parquet(path)).collect()} == want
