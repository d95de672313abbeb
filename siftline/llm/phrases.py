"""Phrase collocations by suffix sorting (suffix-sigma).

Each task turns its texts into suffixes: every word with the ``max_n - 1`` that follow it in its piece. Equal suffixes of a
task are counted before anything moves. The rest is dealt by language and first word, a first word's suffixes split further by
``PARTS`` hashes of the second word, and sorted in reverse lexicographic order, so that a suffix comes before its own
prefixes and equal prefixes stand together: one stack of ``max_n`` open prefixes counts all phrases in a single pass. Only
single words are counted in parts; their sums are taken afterwards. The counts of a phrase's two parts at each cut are then
joined from the same table.

Defined results: a null or empty text has no words; a null language is ``und``; words are compared by their bytes, with A-Z
lower-cased; rows of equal id all count; other columns are not read; an empty table gives no rows. Texts are taken apart in
slices, so a very long one needs no more memory than a long one; a single word of any length stays whole. Scores
are whole numbers of 38 digits on the way: exact up to counts of 15 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import lean, stored
from .term_ids import Ids, counted, slices

#: What ends a piece, and what separates words within one; A-Z are lower-cased.
ENDS, BETWEEN = b".,;:!?\n\x0b\x0c\r", b" \t"
BYTES = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(ENDS) + b" ")
#: Stands between pieces; no byte of UTF-8 text.
MARK = b"\xff"
#: Words that a task holds before it counts them, and hashes of second words that split a first word's suffixes.
HELD_WORDS, PARTS = 2_000_000, 64
TOP = 2000
#: Least share of a phrase's occurrences, in percent, that a longer candidate around it must have to replace it.
COVERED = 50


#: Between the words of a suffix, of which all have max_n: suffixes that begin alike then stand together in byte order.
TAB = "\t"


def escaped(lang: str) -> str:
    return lang.replace("%", "%25").replace(TAB, "%09")


def plain(lang: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(lang, "%09", TAB), "%25", "%")


def suffixes(docs: DataFrame, max_n: int, held_words: int = HELD_WORDS) -> DataFrame:
    """(suffix, n): suffixes and how often a task saw them, as first word, language and further words, those past the end of a
    piece empty."""

    def batch(lang: str, t: np.ndarray, ids: Ids, words: pa.Array) -> pa.RecordBatch:
        """``t``: numbers of words; those of the last max_n - 1 only follow others."""
        mark, n = ids[MARK], len(t) - max_n + 1
        parts = [t[:n]]
        for k in range(1, max_n):
            parts.append(np.where(parts[-1] == mark, mark, t[k : n + k]))
        begins = parts[0] != mark
        parts = [p[begins] for p in parts]
        parts, count = counted(parts, [len(ids)] * max_n)
        first, *others = [words.take(pa.array(p)) for p in parts]
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, escaped(lang), *others, TAB), pa.array(count, pa.int64())], ["suffix", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pending, held = Ids(), {}, 0
        ids[MARK]

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, pending, held
            words, listed, rest = ids.strings(mark=MARK), list(ids), {}
            for lang, found in pending.items():
                t = np.concatenate(found + [np.full((max_n - 1) * last, ids[MARK])]).astype(np.int64)
                if len(t) >= max_n:
                    yield batch(lang, t, ids, words)
                rest[lang] = [listed[i] for i in t[max(0, len(t) - max_n + 1) :]]
            ids, held = Ids(), 0
            ids[MARK]
            pending = {} if last else {lang: [ids.of(w)] for lang, w in rest.items()}

        for b in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for part in slices(b"\n".join([*texts, b""]).translate(BYTES), b" \n"):
                    t = ids.of(part.replace(b"\n", b" \xff ").split())
                    pending.setdefault(lang, []).append(t)
                    held += len(t)
                    if held >= held_words:
                        yield from flush(False)
        yield from flush(True)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(lean(run), "suffix string, n long")


def prefix_counts(dealt: DataFrame, max_n: int, least: int) -> DataFrame:
    """(lang, phrase, size, n) for all prefixes of sorted suffixes: single words as far as a task has them, longer ones
    whole and only from ``least`` occurrences on."""

    def phrases(lang: pa.Array, words: list[pa.Array], rows: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        """The first words of the given rows, as many as ``words`` has, and their sums."""
        size = len(words)
        parts = [w.take(pa.array(rows)) for w in words]
        fit = pa.array(np.asarray(pc.not_equal(parts[-1], ""), bool) & ((sums >= least) | (size == 1)))
        phrase = pc.binary_join_element_wise(*parts, " ").filter(fit)
        return pa.RecordBatch.from_arrays([plain(lang.take(pa.array(rows)).filter(fit)), phrase, pa.array(np.full(len(phrase), size, np.int32)), pa.array(sums).filter(fit)], ["lang", "phrase", "size", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, stack = None, [0] * max_n  # the row above, and the occurrences so far of its prefixes
        for b in batches:
            if not b.num_rows:
                continue
            n, above = b.column("n").to_numpy(), int(top is not None)
            at = pa.Table.from_batches([top, b] if above else [b]).combine_chunks()
            flat = pc.split_pattern(at.column("suffix").combine_chunks(), TAB).flatten()
            first, lang, *others = [flat.take(pa.array(np.arange(k, len(flat), max_n + 1))) for k in range(max_n + 1)]
            words = [first, *others]
            new = np.zeros(b.num_rows, bool)  # the row opens a new prefix of this size
            new[0] = not above
            for size in range(1, max_n + 1):
                for v in [lang] * (size == 1) + [words[size - 1]]:
                    new[1 - above :] |= np.asarray(pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)), bool)
                starts = np.flatnonzero(new)
                if not len(starts):
                    stack[size - 1] += int(n.sum())
                    continue
                sums = np.add.reduceat(n, starts)
                closed, rows = sums[:-1], starts[:-1] + above
                if above:
                    closed, rows = np.append(stack[size - 1] + int(n[: starts[0]].sum()), closed), np.append(0, rows)
                if len(rows):
                    yield phrases(lang, words[:size], rows, closed)
                stack[size - 1] = int(sums[-1])
            top = b.slice(b.num_rows - 1)
        if top is not None:
            first, lang, *others = [pa.array([w]) for w in top.column("suffix")[0].as_py().split(TAB)]
            words = [first, *others]
            for size in range(1, max_n + 1):
                yield phrases(lang, words[:size], np.array([0]), np.array(stack[size - 1 : size]))

    return dealt.mapInArrow(lean(run), "lang string, phrase string, size int, n long")


def phrase_counts(docs: DataFrame, max_n: int, least: int) -> DataFrame:
    """(lang, phrase, size, n), written: all words, and all phrases of up to ``max_n`` words that occur ``least`` times."""
    found = suffixes(docs, max_n)
    first, second = F.substring_index("suffix", TAB, 2), F.substring_index("suffix", TAB, 3)
    dealt = found.repartition(first, F.pmod(F.xxhash64(second), F.lit(PARTS))).sortWithinPartitions(F.desc("suffix"))
    return stored(prefix_counts(dealt, max_n, least).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")), "phrases")


def scored(counts: DataFrame, min_n: int, least: int) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of candidates by their lowest cut."""
    candidates = counts.where((F.col("size") >= min_n) & (F.col("n") >= least)).withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right")
    )
    parts = counts.where(F.col("n") >= least)
    at = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    at = at.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    # whole numbers of 38 digits: 64 bits do not hold these products
    at = at.withColumn("score", F.expr("cast(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    return at.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, min_n: int, percent: int) -> DataFrame:
    """Candidates that lie in no longer candidate with at least ``percent`` of their occurrences."""
    words = F.split("phrase", " ")
    inner = candidates.where(F.col("size") > min_n).select(
        "lang", "size", words.alias("words"), F.col("a").alias("longer"), F.explode(F.sequence(F.lit(min_n), F.col("size") - 1)).alias("inner")
    ).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1)))
    around = inner.select("lang", F.array_join(F.slice("words", F.col("start"), F.col("inner")), " ").alias("phrase"), "longer")
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    at = candidates.join(around, ["lang", "phrase"], "left")
    return at.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, min_n: int = 2, max_n: int = 3, least: int = 10, top: int = TOP, percent: int = COVERED) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, all numbers long."""
    counts = phrase_counts(docs, max_n, least)
    totals = counts.where("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = stored(scored(counts, min_n, least), "candidates")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = uncovered(candidates, min_n, percent).withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
