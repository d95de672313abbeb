"""Bytes, accents, references and blocks against what Python's own library does."""

import html
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftline.functions import blocks, encoding


def column(spark, rows, kind, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}").coalesce(1)
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def spliced(data):
    out, pos = [], 0
    while True:
        try:
            return "".join([*out, data[pos:].decode()])
        except UnicodeDecodeError as e:
            out += [data[pos : pos + e.start].decode(), data[pos + e.start : pos + e.end].decode("latin-1")]
            pos += e.end


def test_lossless_bytes(spark):
    rnd = random.Random(5)
    rows = [bytes(rnd.choice([rnd.randrange(256), 0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED]) for _ in range(rnd.randrange(40))) for _ in range(400)]
    rows += [b"", "Zürich €".encode(), "Bjørn".encode("latin-1"), b"a" * 20000 + b"\xff" + "é".encode() * 9000, b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80"]
    assert column(spark, rows, "binary", encoding.lossless) == [spliced(r) for r in rows]


def repaired(text):
    import re

    count = lambda s: len(re.findall(encoding.SIGNATURE, s))
    for _ in range(3):
        if not count(text):
            return text
        for codec in ("latin-1", "cp1252"):
            try:
                new = text.encode(codec).decode()
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if count(new) < count(text):
                text = new
                break
        else:
            return text
    return text


def test_mojibake(spark):
    words = ["Zürich", "naïve €5", "软件", "Φ", "plain", "“quoted” – dash", "Ã", "é²", ""]
    rows = list(words)
    for w in words:
        for codec in ("latin-1", "cp1252"):
            x = w
            for _ in range(4):
                try:
                    x = x.encode().decode(codec)
                except UnicodeDecodeError:
                    break
                rows += [x, x + "软", x + " é"]
    assert column(spark, rows, "string", encoding.repair_mojibake) == [repaired(r) for r in rows]
    assert repaired("ZÃ¼rich") == "Zürich"


def test_accents_of_all_letters(spark):
    points = [chr(n) for n in range(1, 0x30000) if not 0xAC00 <= n <= 0xD7A3 and not 0xD800 <= n <= 0xDFFF]
    rows = ["x" + "".join(points[k : k + 997]) + "y" for k in range(0, len(points), 997)] + ["São Paulo", "Mäntsälä", "ﬁne ½ ①", "é", ""]
    want = ["".join(c for c in unicodedata.normalize("NFKD", r) if not unicodedata.combining(c)) for r in rows]
    got = column(spark, rows, "string", encoding.folded)
    assert [a for a, b in zip(got, want) if sorted(a) != sorted(b)] == [] and got[-5:] == want[-5:]


def test_references(spark):
    rows = ["&amp;lt; &lt;b&gt; &nbsp;|", "&#8364;&#x20AC;&#X1F600;", "&notit; &notin; &not", "&copy &copyright; &AMP&amp", "&unknown; &; & &#; &#x;", "&#0; &#55296; &#9999999; &#99999999999;", "&#128;&#150;", "&NotEqualTilde;", "none", "", "&Aacute&eacute;x", "&#65"]
    assert column(spark, rows, "string", encoding.unescaped) == [html.unescape(r) for r in rows]


PAGES = [
    ("<h1>Title</h1><p>One &amp; two<p>three<br>four", "# Title\n\nOne & two\n\nthree\n\nfour\n"),
    ("<ul><li>a<li>b <b>bold</b></ul>after", "- a\n- b bold\n\nafter\n"),
    ("<table><tr><td>x<td>y</tr><tr><th>p</th><th>q</th></table>", "x y\n\np q\n"),
    ("<nav>menu <header>h</header> more</nav><div>body</div><footer>f", "body\n"),
    ("<head><title>t</title></head><script>if (a<b) x('</p><nav>')</script><style>p{}</style>ok", "ok\n"),
    ("<pre>\n a\n   b\n</pre>c", "a\n   b\n\nc\n"),
    ("<div>a<!-- <p> hidden --> b</div><DIV CLASS='x'>C</DIV>", "a b\n\nC\n"),
    ("<h3 class=q>Head</h3><li>one</li>\n<li>two<br>three</li>", "### Head\n\n- one\n- two\n- three\n"),
    ("a < b and 3 > 2 <i>x</i>", "a < b and 3 > 2 x\n"),
    ("</nav></div>stray<nav/>kept", "straykept\n"),
    ("<p>&amp;lt;tag&amp;gt;&#1;</p>", "&lt;tag&gt;\n"),
    ("\x01P\x03<p>x  y</p>", "P\n\nx y\n"),
    ("", ""),
    (None, ""),
]


def test_blocks(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "i int, html string").coalesce(1)
    got = {r.i: r.text for r in blocks.with_block_text(df, "html", "text").collect()}
    assert [(PAGES[i][0], got[i]) for i in got if got[i] != PAGES[i][1]] == []
    twice = blocks.with_block_text(df.where("i = 10"), "html", "text", times=2).first().text
    assert twice == "<tag>\n"


def test_dead_lines(spark):
    rows = ["# Careers\n\nNo job found.", "Text\n- This position has been filled!", "In prose, no job found is a phrase that stands in a line which is much longer than ninety letters, so nothing.", "no jobs found", ""]
    assert column(spark, rows, "string", blocks.dead_line) == ["No job found.", "This position has been filled!", None, None, None]


def test_very_long_page(spark):
    page = "<div>" + "<p>word <b>bold</b> &eacute;</p>" * 20000 + "<nav>x</nav>" * 300 + "</div>"
    df = spark.createDataFrame([(1, page)], "i int, html string")
    text = blocks.with_block_text(df, "html", "text").first().text
    assert text == "word bold é\n\n" * 19999 + "word bold é\n"
