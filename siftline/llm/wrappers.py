"""Main text of pages by wrappers: union-free regular expressions inferred from the pages of a host.

Each page is read as a stream of block tags and texts. A text's place is named by its path, in which elements that the
markup names as navigation, header, footer, sidebar, advert, form, comment and the like are marked. Texts that agree between
the host's pages are tokens of the template: those outside of articles that stand on at least LEAST_PAGES pages of different
text and on more than half of the pages that have the path. Where texts disagree there is a slot (#path). Tandem repeats in
a stream fold into repeated groups, so that pages which differ in the number of their paragraphs or links have one form. The
distinct forms of a host are aligned one after another: where they disagree, one or more copies of a group become the
repeated group, and what is in one alone becomes optional. The outcome is one expression for each host, and each of its
slots gets its role there: article (within article or main elements), body (the others, unless most of the slot's
letters on the host's pages are links), or none (marked elements). A page's text is what its tokens put in article slots;
if there is nothing, what they put in body slots. Template texts are in no slot.

Agreements, forms and slot statistics are grouped sums; a host has fewer template texts than twice the blocks of a mean page
for each path. A host's distinct forms are aligned in salted groups of about PER_GROUP, then the groups' expressions in the
same way until one is left; so no task holds all forms of a host.

Defined results: a null or empty html has an empty text; a null url or one without a host shares the host ''; rows of equal
page_id each get a result; pages of equal text count as one page for the template; an unfinished tag or script runs to the
end of the page; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import difflib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .tables import map_frames, stored

DEEPEST = 256  # elements around a slot; those further in belong to the last of these
PER_GROUP = 32
LEAST_PAGES = 3  # of different text, before what they share is template
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*>)|<[!?/][^>]*>", re.S)
OPEN_END = re.compile(r"<[a-zA-Z/!?][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>]|\Z)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names of HTML and the words that name what is no main text.
RAW = frozenset("script style title noscript template iframe textarea svg math object select noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input picture source br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav footer aside form button menu dialog head fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt td th tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus replies footer masthead topbar toolbar pagination pager widget widgets skip copyright".split())
MAIN = ("article", "main")
WHOLE = frozenset(("html", "body", *MAIN))


@dataclass
class Block:
    path: str
    text: str
    linked: int  # letters in links


def number(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")) - 2**63


def signature(name: str, attributes: str) -> tuple[str, bool]:
    """Name of an element in a form, and whether it is no main text."""
    left_out, sign = name in LEFT_OUT, ""
    if attributes and len(attributes) > 1:
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            if key in ("class", "id"):
                if not sign and value.split():
                    sign = ("." if key == "class" else "#") + re.sub(r"\d+|[\s()+?|/<>!]", "N", value.split()[0])
                # a page or an article named after its sidebar or comments is none
                left_out |= name not in WHOLE and any(w.lower() in NAMES for w in WORD.findall(value))
            elif key == "role":
                left_out |= value.lower() in ROLES
            else:
                left_out |= value.lower() != "false"
    return name + sign, left_out


def parse(page: str | None, template: frozenset[int] = frozenset()) -> tuple[list[Block], list[str]]:
    """Blocks of text outside of the template in page order, and the stream of tokens: <name>, </name>, #path, and =number for a
    text of the template."""
    page = page or ""
    stack: list[tuple[str, str, bool, str]] = []  # name, signature, in main, path
    blocks: list[Block] = []
    tokens: list[str] = []
    held: list[str] = []
    paths: dict[str, str] = {}  # one string for equal paths
    links = linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            held.append(raw)
            if links:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                path = stack[-1][3] if stack else "/"
                if template and (known := number(path, text)) in template:
                    tokens.append(f"={known}")
                else:
                    blocks.append(Block(path, text, min(linked, len(text))))
                    tokens.append(f"#{path}")
        linked = 0

    def close(name: str, stop: frozenset = frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                for s in reversed(stack[k:]):
                    tokens.append(f"</{s[1]}>")
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    while m := TAG.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        ending = bool(m[1])
        if name in RAW:
            if not ending and not m[3].endswith("/>"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            put(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if ending else 1
            elif name == "br":
                put(" ")
            continue
        flush()
        if ending:
            close(name, CELLS if name == "p" else frozenset())
            continue
        if name in ENDS_P:
            close("p", CELLS)
        if name in ("li", "option"):
            close(name, LISTS)
        elif name in ("dd", "dt"):
            close("dd", LISTS)
            close("dt", LISTS)
        elif name in ("td", "th", "tr"):
            close("td", TABLES)
            close("th", TABLES)
            if name == "tr":
                close("tr", TABLES)
        if name in VOID or len(stack) >= DEEPEST:
            continue
        sign, left_out = signature(name, m[3])
        above = stack[-1] if stack else ("", "", False, "")
        # a header of the page is none of the article
        left_out |= name == "header" and not above[2]
        sign = re.sub(r"[\s()+?|/<>!]", "N", sign) + "!" * left_out
        path = f"{above[3]}/{sign}"
        stack.append((name, sign, above[2] or name in MAIN, paths.setdefault(path, path)))
        tokens.append(f"<{sign}>")
        if m[3].endswith("/>") and name not in ENDS_P:
            close(name)
    rest = page[at:]
    cut = OPEN_END.search(rest)
    put(rest[: cut.start()] if cut else rest)
    flush()
    while stack:
        tokens.append(f"</{stack.pop()[1]}>")
    return blocks, tokens


CELLS = frozenset("td th table button object".split())
LISTS = frozenset("ul ol dl menu select table".split())
TABLES = frozenset(["table"])


# ---- expressions: lists of nodes; a node is a token, (...)+ or (...)?


def fold(nodes: list[str]) -> list[str]:
    """Tandem repeats as repeated groups, until nothing folds. A repeat of any length is sought where its first node comes next."""
    folded = True
    while folded:
        out, i, folded, n = [], 0, False, len(nodes)
        ahead, last = [0] * n, {}
        for k in range(n - 1, -1, -1):
            ahead[k] = last.get(nodes[k], 0)
            last[nodes[k]] = k
        while i < n:
            size, copies = max(0, ahead[i] - i), 1
            # only whole elements whose copy would end alike are compared on
            if size and i + 2 * size <= n and nodes[i + size - 1] == nodes[i + 2 * size - 1] and balanced(nodes, i, i + size):
                body = nodes[i : i + size]
                while nodes[i + copies * size : i + (copies + 1) * size] == body:
                    copies += 1
            if copies > 1:
                out.append(body[0] if size == 1 and body[0].endswith(")+") else group(fold(body), "+"))
                i += copies * size
                folded = True
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def balanced(nodes: list[str], start: int, end: int) -> bool:
    depth = 0
    for k in range(start, end):
        x = nodes[k]
        depth += (x[0] == "<" and x[1] != "/") - x.startswith("</")
        if depth < 0:
            return False
    return depth == 0


def group(body: list[str], sign: str) -> str:
    return f"({'|'.join(body)}){sign}" if sign else "|".join(body)


def bare(node: str) -> str:
    """The body of a group, or the token."""
    return node[1:-2] if node[0] == "(" else node


def align(a: list[str], b: list[str]) -> list[str]:
    """The expression that covers both."""
    if a == b:
        return a
    out: list[str] = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += a[i:j]
            continue
        x, y = a[i:j], b[k:m]
        if met := meeting(x, y):
            out += met
        else:
            out += optional(x) + optional(y)
    return fold_options(out)


def meeting(x: list[str], y: list[str]) -> list[str] | None:
    """One node for a group and copies of its body, or for a group that is optional in one."""
    for p, q in ((x, y), (y, x)):
        if len(p) == 1 and p[0][0] == "(" and q:
            body = bare(p[0])
            joined = group(q, "")
            if joined == body or (len(q) == 1 and bare(q[0]) == body):
                sign = "+" if p[0].endswith("+") or q[0].endswith(")+") else "?"
                whole = f"({body}){sign}"
                return [whole if sign == "?" or not (p[0].endswith("?") or q[0].endswith(")?")) else f"({whole})?"]
    return None


def optional(x: list[str]) -> list[str]:
    if not x or (len(x) == 1 and x[0].endswith(")?")):
        return x
    return [group(x, "?")]


def fold_options(nodes: list[str]) -> list[str]:
    return [x for i, x in enumerate(nodes) if not (i and x == nodes[i - 1] and x.endswith(")?"))]


def infer(forms: list[tuple[str, int]]) -> str:
    """The expression of forms with their numbers of pages, the most frequent first."""
    out: list[str] | None = None
    for form, _ in sorted(forms, key=lambda x: (-x[1], len(x[0]), x[0])):
        nodes = form.split()
        out = nodes if out is None else align(out, nodes)
    return " ".join(out or [])


# ---- Spark


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out: set[tuple] = set()
        for h, page in zip(b["host"], b["html"]):
            blocks, _ = parse(page)
            seen = {(x.path, x.text) for x in blocks if "!" not in x.path and not ARTICLE.search(x.path)}
            if seen:
                whole = number(*(x.text for x in blocks))
                out |= {(h, number(path), number(path, text), whole) for path, text in seen}
        yield pd.DataFrame(list(out), columns=["host", "path", "text", "page"])


def templates(pages: DataFrame) -> DataFrame:
    """host, template: numbers of the texts, with their paths, that its pages agree in."""
    read = pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(_agreeing, "host string, path long, text long, page long")
    read = stored(read.distinct(), "texts")
    texts = read.groupBy("host", "path", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    paths = read.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count("*").alias("pages"))
    shared = texts.join(paths, ["host", "path"]).where("2 * n > pages")
    return stored(shared.groupBy("host").agg(F.collect_list("text").alias("template")), "templates")


def numbers(template: list[int] | None) -> frozenset[int]:
    return frozenset(() if template is None else template)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out: dict[tuple, list[int]] = {}
        for h, page, template in zip(b["host"], b["html"], b["template"]):
            blocks, tokens = parse(page, numbers(template))
            for key, n, m in [(("form", " ".join(fold(tokens))), 1, 0), *((("slot", x.path), len(x.text), x.linked) for x in blocks)]:
                kept = out.setdefault((h, *key), [0, 0])
                kept[0] += n
                kept[1] += m
        yield pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["host", "kind", "value", "n", "linked"])


@F.pandas_udf(StringType())
def inferred(forms: pd.Series) -> pd.Series:
    return forms.map(lambda group: infer([(x["form"], x["n"]) for x in group]))


def expressions(forms: DataFrame) -> DataFrame:
    """(host, form, n) of distinct forms to one expression for each host; each round aligns groups of about PER_GROUP forms."""
    while True:
        sizes = forms.groupBy("host").count()
        if sizes.where("count > 1").isEmpty():
            return forms
        salt = F.pmod(F.xxhash64("form"), F.ceil(F.col("count") / PER_GROUP))
        groups = forms.join(sizes, "host").groupBy("host", salt.alias("salt"))
        groups = groups.agg(F.collect_list(F.struct("form", "n")).alias("forms"), F.sum("n").alias("n"))
        form = F.when(F.size("forms") > 1, inferred("forms")).otherwise(F.col("forms")[0]["form"])
        forms = stored(groups.select("host", form.alias("form"), "n").groupBy("host", "form").agg(F.sum("n").alias("n")), "expressions")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (its expression), article and body (paths of its slots by role), template (numbers of its constant texts)."""
    agreed = templates(pages)
    read = pages.select(host(F.col("url")).alias("host"), "html").join(agreed, "host", "left")
    read = read.mapInPandas(_read, "host string, kind string, value string, n long, linked long")
    found = stored(read.groupBy("host", "kind", "value").agg(F.sum("n").alias("n"), F.sum("linked").alias("linked")), "forms")
    made = expressions(found.where("kind = 'form'").select("host", F.col("value").alias("form"), "n"))
    slots = made.select("host", F.explode(F.array_distinct(F.regexp_extract_all("form", F.lit(SLOT), 1))).alias("path")).where(~F.contains("path", F.lit("!")))
    dense = found.where("kind = 'slot' and 2 * linked > n").select("host", F.col("value").alias("path"), F.lit(True).alias("dense"))
    main = F.col("path").rlike(IN_MAIN)
    # links in an article are part of it; elsewhere slots that are mostly links are not
    roles = slots.join(dense, ["host", "path"], "left").withColumn("role", F.when(main, "article").when(F.col("dense").isNull(), "body"))
    roles = roles.groupBy("host").agg(*[F.collect_list(F.when(F.col("role") == r, F.col("path"))).alias(r) for r in ("article", "body")])
    return made.select("host", F.col("form").alias("wrapper")).join(roles, "host", "left").join(agreed, "host", "left")


#: A slot in an expression, and a path through an article.
SLOT = r"#(/[^ |()?+]*)"
IN_MAIN = rf"/({'|'.join(MAIN)})([.#][^/]*)?(/|$)"
ARTICLE = re.compile(IN_MAIN)


def main_text(page: str | None, article: set[str], body: set[str], template: frozenset[int] = frozenset()) -> str:
    blocks, _ = parse(page, template)
    found = [b.text for b in blocks if b.path in article] or [b.text for b in blocks if b.path in body]
    return "\n".join(found)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        roles = ([set(() if r is None else r) for r in b[name]] for name in ("article", "body"))
        texts = [main_text(*x) for x in zip(b["html"], *roles, map(numbers, b["template"]))]
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts], "host": b["host"]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and host of each page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    made = stored(wrappers(pages), "wrappers")
    at = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    return map_frames(
        at.join(made.select("host", "article", "body", "template"), "host", "left"), _texts, f"page_id {kind}, url string, text string, n_chars long, host string"
    )
