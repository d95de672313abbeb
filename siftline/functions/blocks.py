"""Readable text of a page: one line for each block, without chrome, references decoded; Spark's own functions only.

Chrome elements go with all they hold: a page is cut at their tags, and the depth of open ones, a number carried over the pieces, says
which pieces stay. What opens or ends a block becomes a mark, all other tags go, and the text is split at the marks. Unclosed
tags need no repair: a block ends where the next one begins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.encoding import unescaped

CHROME = "script|style|noscript|template|head|title|svg|iframe|nav|header|footer|form"
GENERIC = "p|div|section|article|main|ul|ol|dl|dt|dd|table|thead|tbody|tfoot|tr|blockquote|figure|figcaption|address|details|summary|aside"
CHROME_TAG = rf"(?i)<(?:/(?:{CHROME})|(?:{CHROME})(?:\s[^>]*)?/?)\s*>"
CODE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
MARK, END, BREAK = "\x01", "\x03", "\x02"
MARKS = (
    (rf"(?i)<h([1-6])(?:\s[^>]*)?>", f"{MARK}$1{END}"), (r"(?i)<li(?:\s[^>]*)?>", f"{MARK}L{END}"), (r"(?i)<pre(?:\s[^>]*)?>", f"{MARK}R{END}"), (r"(?i)<[bh]r\s*/?>|<br\s[^>]*>", BREAK),
    (r"(?i)<t[dh](?:\s[^>]*)?>", " "), (rf"(?i)</(?:h[1-6]|li|pre|{GENERIC})\s*>|<(?:{GENERIC})(?:\s[^>]*)?>", f"{MARK}P{END}"), (r"(?s)<[a-zA-Z/!?][^>]*>", ""),
)
#: A page that says that it carries no posting: a short line that holds one of these.
DEAD = (
    "no job found", "job not found", "job no longer exists", "this job is no longer available", "this job posting is no longer available", "this position is no longer available",
    "this posting is no longer available", "this position has been filled", "this role is no longer open", "the job you are looking for", "no longer accepting applications",
)
DEAD_LINE = 90
BLANK = " \t\n\f\r"


def as_read(pattern: str) -> str:
    """A pattern for Java, which matches what the SQL's engine matches: white space without \\x0B, words of ASCII letters, and the
    long s and the Kelvin sign as forms of s and k where case does not count."""
    forms = {r"\s": f"[{BLANK}]", r"\b": "(?![0-9A-Za-z_])"} | ({"s": "[s\u017f]", "k": "[k\u212a]"} if pattern.startswith("(?i") else {})
    return re.sub(r"\(\?\w+\)|\\.|[sk]", lambda m: forms.get(m[0], m[0]), pattern)


def without_chrome(html: Column) -> Column:
    html = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), MARK + BREAK + END, ""), as_read(CODE), "")
    tag = as_read(CHROME_TAG)
    pieces = F.split(html, tag)
    tags = F.concat(F.array(F.lit("")), F.regexp_extract_all(html, F.lit(tag), F.lit(0)))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(at: Column, x: Column) -> Column:
        move = F.when(F.startswith(x["tags"], F.lit("</")), -1).when((x["tags"] == "") | F.endswith(x["tags"], F.lit("/>")), 0).otherwise(1)
        depth = F.greatest(F.lit(0), at["depth"] + move)
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(at["kept"], F.array(x["pieces"]))).otherwise(at["kept"]).alias("kept"))

    cut = F.aggregate(F.arrays_zip(tags.alias("tags"), pieces.alias("pieces")), start, step, lambda at: F.array_join(at["kept"], ""))
    return F.when(html.rlike(tag), cut).otherwise(html)


def with_block_text(df: DataFrame, html: str, name: str, times: int = 1, references: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """``df`` with the readable text of column ``html``; ``times``: how often references were escaped; ``references``: those that are read and
    their letters, one replaced after the other, else all of the standard."""
    at = df.withColumn("_x", without_chrome(F.col(html)))
    marked = F.col("_x")
    for pattern, to in MARKS:
        marked = F.regexp_replace(marked, as_read(pattern), to)
    at = at.withColumn("_x", marked)
    for _ in range(times):
        if references is None:
            at = at.withColumn("_x", unescaped(F.col("_x")))
        for ref, to in references or ():
            at = at.withColumn("_x", F.replace("_x", F.lit(ref), F.lit(to)))
    kind = lambda s: F.when(F.contains(s, F.lit(END)), F.substring_index(s, END, 1)).otherwise("P")
    rest = lambda s: F.when(F.contains(s, F.lit(END)), F.substring_index(s, END, -1)).otherwise(s)
    blocks = F.flatten(F.transform(F.split("_x", MARK), lambda s: F.transform(F.split(rest(s), BREAK), lambda line: F.struct(kind(s).alias("kind"), line.alias("line")))))

    def shown(b: Column) -> Column:
        plain = F.trim(F.regexp_replace(b.line, SPACE, " "))
        return F.struct(b.kind.alias("kind"), F.when(b.kind == "R", F.rtrim(F.ltrim(b.line, F.lit("\n")), F.lit(BLANK))).otherwise(plain).alias("line"))

    at = at.withColumn("_b", F.filter(F.transform(blocks, shown), lambda b: b.line != ""))
    def line(b: Column, i: Column) -> Column:
        before = F.get("_b", i - 1)["kind"]
        gap = F.when(i == 0, "").when((b.kind == "L") & (before == "L"), "\n").otherwise("\n\n")
        head = F.when(b.kind == "L", "- ").when(b.kind.rlike("^[1-6]$"), F.concat(F.substring(F.lit("######"), F.lit(1), b.kind.try_cast("int")), F.lit(" "))).otherwise("")
        return F.concat(gap, head, b.line)

    text = F.trim(F.regexp_replace(F.array_join(F.transform("_b", line), ""), "\n{3,}", "\n\n"), F.lit(" \n\t"))
    return at.withColumn(name, F.when(text != "", F.concat(text, F.lit("\n"))).otherwise("")).drop("_x", "_b")


def dead_line(text: Column) -> Column:
    """The line by which a page says that it has no posting; null if none does."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(F.ltrim(F.trim(s), F.lit("#-*•> "))))
    said = lambda s: F.rtrim(F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))), F.lit(".!?"))
    return F.get(F.filter(lines, lambda s: (s != "") & (F.length(s) <= DEAD_LINE) & said(s).rlike("|".join(DEAD))), F.lit(0))
