"""Evidence in texts: spans of stated rules with what stands around them, as arrays of structs in one projection.

Rules are data: a name, a kind and a pattern. All patterns of a rule set are one alternation, so a text is read once; where two begin
at the same letter the earlier rule wins. What a span means is decided afterwards from its clause, by conditions on the text to
its left and right. Nothing leaves its row: no explode, no shuffle. Patterns use no lookaround, so any engine reads them alike.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that a span sees to either side.
AROUND = 400


class Rule(NamedTuple):
    name: str
    kind: str
    pattern: str


def alternation(rules: Sequence[Rule]) -> str:
    return r"\b(?:" + "|".join(r.pattern for r in rules) + r")\b"


def of_phrase(rules: Sequence[Rule], phrase: Column, what: str) -> Column:
    """Name or kind of the first rule whose pattern the whole phrase has."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(phrase.rlike(f"^(?:{r.pattern})$"), getattr(r, what)).otherwise(out)
    return out


def has_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def with_spans(df: DataFrame, text: str, pattern: str, name: str, apart: str = "", needs: Sequence[str] = (), skip: Column | None = None) -> DataFrame:
    """``df`` with array<struct<at, phrase, left, right>> of all matches in column ``text``; ``at`` counts letters from 0. The parts are
    columns of their own on the way: inside a lambda they would be taken apart again for each match.

    A pattern costs far more than a look for a word, so a text is searched where matches can be. ``apart``: a character that is in
    no match and no part of a word, with ``needs``, of which each match has one; stretches between such characters without any are left out.
    ``skip``: how many letters at the beginning no match can begin in."""
    parts, found = f"_{name}_parts", f"_{name}_found"

    def size(of: Column, n: Column, each: int = 0) -> Column:
        return F.aggregate(F.slice(of, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x) + each)

    if apart:
        df = df.withColumn(parts, F.split(text, re.escape(apart)))
        numbered = F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("t")))
        stretches = F.transform(F.filter(numbered, lambda p: has_any(p.t, needs)), lambda p: F.struct(size(F.col(parts), p.i, 1).alias("begin"), p.t.alias("t")))
    else:
        df = df.withColumn(parts, F.lit(0) if skip is None else skip)
        stretches = F.when(F.col(text).isNotNull(), F.array(F.struct(F.col(parts).alias("begin"), F.substring(text, F.col(parts) + 1, F.length(text)).alias("t"))))
    phrases = F.transform(stretches, lambda h: F.struct(h.begin.alias("begin"), h.t.alias("t"), F.regexp_extract_all(h.t, F.lit(pattern), F.lit(0)).alias("phrases")))
    pieces = F.transform(F.filter(phrases, lambda h: F.size(h.phrases) > 0), lambda h: F.struct(h.begin.alias("begin"), h.phrases.alias("phrases"), F.split(h.t, pattern).alias("pieces")))
    at = df.withColumn(found, pieces)

    def placed(h: Column) -> Column:
        return F.transform(h.phrases, lambda p, i: F.struct((h.begin + size(h.pieces, i + 1) + size(h.phrases, i)).alias("at"), p.alias("phrase")))

    def span(s: Column) -> Column:
        first = F.greatest(F.lit(0), s.at - AROUND)
        return F.struct(
            s.at.alias("at"), s.phrase.alias("phrase"), F.substring(text, first + 1, s.at - first).alias("left"), F.substring(text, s.at + F.length(s.phrase) + 1, F.lit(AROUND)).alias("right")
        )

    return at.withColumn(name, F.transform(F.flatten(F.transform(found, placed)), span)).drop(parts, found)


TOKEN = r"[a-z0-9][a-z0-9'’./-]*"
COORDINATOR = r"[,;]|\b(?:and|or|nor|plus)\b"


def few_tokens(gap: Column, most: int) -> Column:
    return gap.rlike(rf"^[^a-z0-9]*(?:{TOKEN}(?:[^a-z0-9]+|$)){{0,{most}}}$")


def after_last(text: Column, pattern: str) -> Column:
    """What follows the last match; the whole text if there is none."""
    return F.regexp_replace(text, rf"^.*(?:{pattern})", "")


def before_first(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, rf"(?:{pattern}).*$", "")


def near_left(text: Column, cue: str, most: int) -> Column:
    """A cue at most ``most`` words before the end of ``text``, with no coordinator between."""
    gap = after_last(text, cue)
    return text.rlike(cue) & few_tokens(gap, most) & ~gap.rlike(COORDINATOR)


def near_right(text: Column, cue: str, most: int) -> Column:
    gap = F.regexp_extract(text, rf"^(.*?)(?:{cue})", 1)
    return text.rlike(cue) & few_tokens(gap, most) & ~gap.rlike(COORDINATOR)
