"""How far the sources of a language differ in their use of words, summed over all kept terms without listing absent ones.

A term's smoothed share ``p`` in a group depends on its count alone, so a group has one constant share for all terms that it
lacks. The distance of two groups is the sum of |p - q| over all kept terms. By inclusion and exclusion over the terms that
occur:

- terms of either group, as if the other lacked them: priced from the group's histogram of counts (count, number of terms);
- terms of both: a join of postings by term corrects what the two histograms priced one-sidedly;
- terms of neither: their number times one constant.

Tasks count their own terms first, (group, term) is summed once, and nothing but these sums is joined. A join of postings
has at most as many rows for a term as there are pairs of sources that use it. All sums are whole numbers.

Defined results: null text, lang or source is ''; groups without terms are there, and so are languages without kept terms, where
all distances are 0; rows of equal id all count as documents; other columns are not read; an empty table gives no rows. A
document of any length is taken apart in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import lean, stored
from .term_ids import Ids, combined, slices

#: A term is a run of ASCII letters, of which A-Z are lower-cased, and of all that is not ASCII; other bytes become blanks.
BYTES = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Words that a task holds before it counts them.
HELD_WORDS = 2_000_000
LEAST_DOCS, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50


def term_counts(docs: DataFrame, held_words: int = HELD_WORDS) -> DataFrame:
    """(lang, source, term, n, docs), written: occurrences and documents of each term in each group; the term '' stands for the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, held = Ids(), Ids(), []  # held: for each document (group, numbers of its terms, how often each)

        def flush() -> pa.RecordBatch:
            sizes = [len(t) for _, t, _ in held]
            group = np.repeat(np.array([g for g, _, _ in held], np.int64), sizes)
            term, n = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            _, first, at, docs_with = np.unique(combined([group, term], [len(groups), len(ids)]), return_index=True, return_inverse=True, return_counts=True)
            total = np.zeros(len(first), np.int64)
            np.add.at(total, at, n)
            keys = list(groups)
            of = pa.array(group[first])
            out = [pa.array([k[i] for k in keys], pa.string()).take(of) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*out, ids.strings().take(pa.array(term[first])), pa.array(total), pa.array(docs_with.astype(np.int64))], ["lang", "source", "term", "n", "docs"])

        words = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                found = [np.array([[ids[b""]], [0]])]
                for part in slices(text.translate(BYTES), b" "):
                    t = ids.of(part.split())
                    if len(t):
                        found.append(np.stack(np.unique(t, return_counts=True)))
                terms, n = np.concatenate(found, axis=1)
                if len(found) > 2:  # slices of one document share terms
                    distinct, at = np.unique(terms, return_inverse=True)
                    n = np.bincount(at, n).astype(np.int64)
                    terms = distinct
                held.append((groups[(lang, source)], terms, n))
                words += len(terms)
                if words >= held_words:
                    yield flush()
                    ids, groups, held, words = Ids(), Ids(), [], 0
        if held:
            yield flush()

    texts = docs.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    made = texts.mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")
    return stored(made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")


def smoothed(n: str, total: str, kept: str) -> str:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * kept)), in whole numbers of 38 digits."""
    return f"1 + ({UNIT} * (cast({n} as decimal(28,0)) + {ADDED})) div (cast({total} as decimal(28,0)) + {ADDED} * cast({kept} as decimal(28,0)))"


def supports(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, total, terms, kept, zero: share of absent terms) and postings (lang, source, term, n, p, q), both
    written; p and q are the term's shares in the group and in the language."""
    vocabulary = stored(
        counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= least).drop("docs"),
        "vocabulary",
    )
    postings = stored(counts.drop("docs").join(vocabulary, ["lang", "term"]), "postings")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("lang_total"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    zero = F.when(F.col("kept") > 0, F.expr(smoothed("0", "total", "greatest(kept, 1)"))).otherwise(0)
    groups = stored(groups.withColumn("zero", zero.cast("long")), "groups")
    # groups and languages are few beside their postings, but no bound on them is known: joined by shuffle, split by AQE
    at = postings.join(groups.select("lang", "source", "total", "kept", "lang_total", "zero"), ["lang", "source"])
    at = at.withColumn("p", F.expr(smoothed("n", "total", "kept")).cast("long")).withColumn("q", F.expr(smoothed("of_lang", "lang_total", "kept")).cast("long"))
    return groups, stored(at.select("lang", "source", "term", "n", "p", "q", "zero"), "postings")


def distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): both directions of each pair of sources of a language."""
    one = groups.select("lang", "source", "terms", "kept", "zero")
    pairs = one.join(one.select("lang", F.col("source").alias("item"), F.col("terms").alias("terms2"), F.col("zero").alias("zero2")), "lang").where("source <> item")
    histogram = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))  # equal counts have equal shares
    alone = pairs.select("lang", "source", "item", "zero2").join(histogram, ["lang", "source"])
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("zero2"))).alias("alone"))
    left = postings.select("lang", "term", "source", "p", "zero")
    right = left.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("zero").alias("zero2"))
    both = left.join(right, ["lang", "term"]).where("source < item")
    fix = F.abs(F.col("p") - F.col("p2")) - F.abs(F.col("p") - F.col("zero2")) - F.abs(F.col("zero") - F.col("p2")) + F.abs(F.col("zero") - F.col("zero2"))
    both = both.groupBy("lang", "source", "item").agg(F.sum(fix).alias("fix"))
    key = ["lang", "source", "item"]
    once = pairs.where("source < item").join(alone, key, "left").join(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("alone2")), key, "left")
    neither = (F.col("kept") - F.col("terms") - F.col("terms2")) * F.abs(F.col("zero") - F.col("zero2"))
    once = once.join(both, key, "left").na.fill(0, ["alone", "alone2", "fix"]).select(*key, (neither + F.col("alone") + F.col("alone2") + F.col("fix")).alias("value"))
    once = stored(once, "distances")
    return once.union(once.select("lang", "item", "source", "value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances to all other sources of the language (``pair``) and the ``top`` terms that a
    group uses more than its language (``term``)."""
    groups, postings = supports(term_counts(docs), least)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(groups, postings).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by))
    terms = postings.where("p > q and n > 0").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    names = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*names).unionByName(terms.select(*names))
