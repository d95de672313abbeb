"""Pages of odd letters against their SQL."""

import hashlib

import duckdb
import pytest

from siftline import registry

ODD = (
    "<h1>A &quot</h1><p>b &quot;c&quot; &amp d</p>", "<p>&amp;amp &amp;lt; &lt &copy &nbsp;x &eacute;</p>", "<p\x0b>a</p><div\x0bclass=x>b</div>", "<pre>a   </pre>b", "<pre>\na \x0b</pre>", "<pre>\x0b</pre>",
    "<ſcript>a</script>b<blocKquote>c", "<scripté>a</script>b", "<li>a<LI >b<br\x0c/>c", "<nav\r\n>x</nav\t>y", "", None,
    "<p>No job found &quot</p>",
)
#: The SQL reads seven references and no others.
TEXTS = {0: '# A &quot\n\nb "c" & d\n', 1: "& &lt; &lt &copy &nbsp;x &eacute;\n", 3: "a   \n\nb\n", 10: "", 11: ""}


@pytest.mark.parametrize("name", ["page_block_text", "dead_pages"])
def test_odd_pages_as_in_sql(spark, tmp_path, name):
    # dead_pages adds another line for each remainder of the id
    spark.createDataFrame([(8 * i + k, html) for i, html in enumerate(ODD) for k in range(8)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_references_of_pages(spark, tmp_path):
    spark.createDataFrame([(i, html) for i, html in enumerate(ODD)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.h, r.n) for r in registry.queries()["page_block_text"](spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in TEXTS} == {i: (hashlib.md5(t.encode()).hexdigest(), len(t)) for i, t in TEXTS.items()}
