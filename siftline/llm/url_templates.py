"""Verdicts on URLs from stated rules, and else from a tree of path templates learnt for each host.

The tree grows level by level over all distinct (host, path). At a node, a segment that has its share of the node's pages
stays as it is; all others are variable and become the wildcard of their form (``<number>``, ``<word>``, ``<file>``, ``<mixed>``).
Branches of a node whose labels and whose next segments do not differ significantly are then merged into one (``de|en|fr``), so that
their labels count together. A node with too few pages is not split: the rest of its paths is ``**``. A template is
rejected when its labelled share of bad pages, smoothed with that of the node above, and so on up to the host and to all
pages, reaches a threshold.

Each level is a few grouped sums and joins on (host, node, segment). A node keeps at most ``1 / SHARE`` constant segments, which bounds
the windows that compare branches. Tables that are joined to all paths are sent to the tasks behind a check of their rows, and beyond
that joined by parts of each key, so that a hot host or segment splits.

Defined results: a URL that is null or has no ``://`` has host and path '' and meets no rule; an empty segment (``//``, a final
``/``) is no segment; a path without segments is its host's root template; pages of null or unknown id have no label; a page of
several labels counts each; pages of equal URL share template and verdict; extra columns are not read; no labels at all give
``allow``; an empty table gives no rows. Paths of any depth and length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Least pages of a node that is split and of a constant segment, and least share of its node's pages that such a segment has.
LEAST, SHARE = 8, 1 / 64
FORMS = {"number": r"^[0-9]+$", "word": r"^[A-Za-z_-]+$", "file": r"^.+\.[A-Za-z][A-Za-z0-9]{1,4}$"}
#: Critical values at 5 %: one degree of freedom for good and bad, four for the form of the next segment.
LABEL_LIMIT, FORM_LIMIT = 3.841, 9.488
#: Pages that a node's smoothing counts for, and the share of bad pages at which a template is rejected.
PRIOR, REJECT = 2.0, 0.5
MOST_SENT, PARTS = 50_000, 16
NEXT = (*FORMS, "mixed", "end")


def address(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule (verdict, host, path) that fits; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, at, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(begin))
        rule, verdict = F.when(fits, at + begin).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def form(segment: Column) -> Column:
    at = F.lit("mixed")
    for name, pattern in reversed(FORMS.items()):
        at = F.when(segment.rlike(pattern), name).otherwise(at)
    return at


def with_few(rows: DataFrame, few: DataFrame, key: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` joined to ``few`` (written before, one row for each key)."""
    if few.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return rows.join(F.broadcast(few), list(key), how)
    parts = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")).join(parts, [*key, "_part"], how).drop("_part")


def cut_off(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Chi-square term of one category seen ``a`` of ``size_a`` and ``b`` of ``size_b`` times."""
    both, size = a + b, size_a + size_b
    expected = [both * s / size for s in (size_a, size_b)]
    terms = [F.when(e > 0, (x - e) * (x - e) / e).otherwise(0.0) for x, e in zip((a, b), expected)]
    return F.when((size_a > 0) & (size_b > 0), terms[0] + terms[1]).otherwise(0.0)


def merged(branches: DataFrame) -> DataFrame:
    """(host, node, branch, name): branches that do not differ significantly from their neighbour share a name. Neighbours are by the
    form that most of their next segments have, then by share of bad pages."""
    most = F.greatest(*[F.struct(F.col(f"next_{x}").alias("n"), F.lit(x).alias("form")) for x in NEXT]).form
    bad = (F.col("bad") + 0.5) / (F.col("labelled") + 1)
    by = Window.partitionBy("host", "node").orderBy("_most", "_bad", "branch")
    at = branches.withColumn("_most", most).withColumn("_bad", bad)
    above = {c: F.lag(c).over(by) for c in ("pages", "labelled", "bad", *(f"next_{x}" for x in NEXT))}
    good = F.col("labelled") - F.col("bad")
    labels = cut_off(F.col("bad"), above["bad"], F.col("labelled"), above["labelled"]) + cut_off(good, above["labelled"] - above["bad"], F.col("labelled"), above["labelled"])
    forms = reduce(lambda x, y: x + y, [cut_off(F.col(f"next_{x}"), above[f"next_{x}"], F.col("pages"), above["pages"]) for x in NEXT])
    at = at.withColumn("_new", ((labels > LABEL_LIMIT) | (forms > FORM_LIMIT)).cast("int"))
    at = at.withColumn("_group", F.sum(F.coalesce("_new", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    same = Window.partitionBy("host", "node", "_group")
    return at.select("host", "node", "branch", F.array_join(F.array_sort(F.collect_list("branch").over(same)), "|").alias("name"))


def next_level(at: DataFrame) -> DataFrame:
    """One more segment of all paths goes from ``rest`` into the template ``node``."""
    open_ = F.size("rest") > 0
    nodes = at.where(open_).groupBy("host", "node").agg(F.sum("pages").alias("of_node"))
    children = at.where(open_).withColumn("segment", F.get("rest", F.lit(0))).groupBy("host", "node", "segment").agg(F.sum("pages").alias("pages"))
    constant = children.where(F.col("pages") >= LEAST).join(nodes.where(F.col("of_node") >= LEAST), ["host", "node"])
    constant = stored(constant.where(F.col("pages") >= SHARE * F.col("of_node")).select("host", "node", "segment", F.lit(True).alias("constant")), "constants")
    thin = stored(nodes.where(F.col("of_node") < LEAST).select("host", "node", F.lit(True).alias("thin")), "thin")
    heads = with_few(with_few(at.withColumn("segment", F.get("rest", F.lit(0))), constant, ["host", "node", "segment"]), thin, ["host", "node"])
    branch = F.when(~open_, F.lit(None)).when(F.col("thin"), "**").when(F.col("constant"), F.col("segment")).otherwise(F.format_string("<%s>", form(F.col("segment"))))
    heads = stored(heads.withColumn("branch", branch).drop("segment", "constant", "thin"), "heads")
    ahead = F.when(F.size("rest") > 1, form(F.get("rest", F.lit(1)))).otherwise("end")
    sums = heads.where("branch is not null and branch <> '**'").withColumn("_next", ahead).groupBy("host", "node", "branch").agg(
        *[F.sum(c).alias(c) for c in ("pages", "labelled", "bad")], *[F.sum(F.when(F.col("_next") == x, F.col("pages")).otherwise(0)).alias(f"next_{x}") for x in NEXT]
    )
    named = with_few(heads, stored(merged(sums), "branches"), ["host", "node", "branch"])
    step = F.when(F.col("branch").isNull(), F.col("node")).otherwise(F.concat("node", F.array(F.coalesce("name", "branch"))))
    left = F.when((F.col("branch") == "**") | F.col("branch").isNull(), F.lit([]).cast("array<string>")).otherwise(F.expr("slice(rest, 2, greatest(size(rest) - 1, 0))"))
    return stored(named.select("host", "path", step.alias("node"), left.alias("rest"), "pages", "labelled", "bad"), "paths")


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, node, pages, labelled, bad): the template of each (host, path), as the array of its segments."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    at = stored(paths.withColumn("rest", segments).withColumn("node", F.lit([]).cast("array<string>")), "paths")
    while not at.where(F.size("rest") > 0).isEmpty():
        at = next_level(at)
    return at.drop("rest")


def purity(at: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(host, node, labelled, p_bad) of all templates: each share of bad pages is smoothed with that of the node above."""
    leaves = stored(at.groupBy("host", "node").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "leaves")
    above = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("node")))).withColumn("prefix", F.expr("slice(node, 1, depth)"))
    sums = stored(above.groupBy("host", "prefix").agg(F.sum("labelled").alias("of"), F.sum("bad").alias("bad_of")), "nodes")
    whole = leaves.agg(F.sum("bad"), F.sum("labelled")).first()
    start = (whole[0] or 0) / whole[1] if whole[1] else 0.0
    chains = above.select("host", "node", "labelled", "depth", "prefix").join(sums, ["host", "prefix"])
    chains = chains.groupBy("host", "node", "labelled").agg(F.array_sort(F.collect_list(F.struct("depth", F.col("of").cast("double").alias("of"), F.col("bad_of").cast("double").alias("bad_of")))).alias("chain"))
    return chains.select("host", "node", "labelled", F.aggregate("chain", F.lit(float(start)), lambda p, x: (x.bad_of + prior * p) / (x.of + prior)).alias("p_bad"))


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, p_bad of all pages; ``labels`` has doc_id and quality (0: bad)."""
    host, path = address(F.col("url"))
    at = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.count("*").alias("labelled"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    known = at.join(marks, at.page_id == marks.doc_id, "left")
    paths = known.groupBy("host", "path").agg(F.count("*").alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("labelled", "bad")])
    learnt = templates(paths)
    shares = stored(purity(learnt), "purity")
    verdicts = stored(with_few(learnt, shares.drop("labelled"), ["host", "node"], "inner").select("host", "path", "node", "p_bad"), "verdicts")
    rule, of_rule = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("p_bad") >= reject, "block").otherwise("allow")
    return at.join(verdicts, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(of_rule, own).alias("verdict"), F.concat(F.lit("/"), F.array_join("node", "/")).alias("template"), "p_bad"
    )
