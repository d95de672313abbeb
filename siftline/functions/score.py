"""The score of a posting: terms that live in its title or text, its level against the wanted one, and what is known of the employer.

A term counts only where no statement takes it back ("this role does not involve ..."): what such a statement covers is blanked before
terms are looked for. Each part of the score is a column of its own, and the score is their sum.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as T

# ---- fixed values: what takes terms back and how far it reaches, weights

LEAD = (
    r"\b(?:not interested in|no interest in|(?:this|the) (?:role|position|job|team) (?:is not|does not|doesn t|will not|won t) (?:an? |involve[a-z]* |include[a-z]* |entail[a-z]* |focus[a-z]* on |touch[a-z]* |work on |deal with |cover[a-z]* )"
    r"|(?:we|you|candidates?) (?:are|will) not (?:be )?(?:looking for|seeking|hiring|building|doing|writing|working on)|(?:we|you) (?:won t|will not) (?:be )?(?:looking for|seeking|hiring|building|doing|writing|working on)|this (?:role )?is not an?)\b"
)
#: Whatever takes a term back has one of these.
CUES = ("not ", "no interest in", "doesn t ", "won t ")
REACH, STOP = 160, r"(?:\.|\bbut\b|\bhowever\b|\binstead\b|\balthough\b)"
TAKEN_BACK = rf"{LEAD}(?:.{{0,{REACH}}}?{STOP}|.{{{REACH}}}|.*$)"
STRONG_TITLE, STRONG_TEXT, GOOD, NEGATIVE = 8.0, 4.0, 1.5, -4.0
STAFF, SENIOR, SPONSORS, TRANSFERS, METRO, REMOTE, FRESH = 4.0, 3.0, 15.0, 5.0, 5.0, 3.0, 3.0
PER_SIGNAL, MOST_SIGNALS, AI_EMPLOYER, MOST_HISTORY = 2.0, 10.0, 6.0, 10.0


class Profile(NamedTuple):
    strong: Sequence[str]
    good: Sequence[str]
    negative: Sequence[str]
    signals: Sequence[str]
    levels: tuple[float, float]
    years: float
    staff: bool = False
    senior: bool = True
    level_weight: float = 6.0
    years_weight: float = 1.0


def live(text: Column) -> Column:
    """A normalised text without what its statements take back."""
    says = F.lit(False)
    for cue in CUES:
        says = says | F.contains(text, F.lit(cue))
    return F.when(says, F.regexp_replace(text, TAKEN_BACK, " ")).otherwise(text)


def has(text: Column, term: str) -> Column:
    """Whether a text has a term; one without its words, which are found faster, is not matched."""
    out = F.lit(True)
    for w in dict.fromkeys(term.lower().replace("-", " ").split()):
        if re.fullmatch("[a-z0-9]+", w):
            out = out & F.contains(text, F.lit(w))
    return out & text.rlike(T.term_pattern(term))


def total(parts: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def scored(df: DataFrame, profile: Profile, *keep: str) -> DataFrame:
    """``keep``, score, negated (terms that are only taken back) and the parts. df: title, text, level_low, level_high, years (certain least years), sponsors,
    transfers, ai_employer, h1b, perm, metro, remote_us, age_days."""
    at = df.withColumns({"_t": T.normalize(F.col("title")), "_d": T.normalize(F.col("text"))})
    at = at.withColumns({"_lt": live(F.col("_t")), "_ld": live(F.col("_d"))})
    t, d, lt, ld = (F.col(c) for c in ("_t", "_d", "_lt", "_ld"))
    point = lambda c, n: F.when(c, n).otherwise(0.0)
    strong = total([F.when(has(lt, k), STRONG_TITLE).when(has(ld, k), STRONG_TEXT).otherwise(0.0) for k in profile.strong])
    good, bad = total([point(has(ld, k), GOOD) for k in profile.good]), total([point(has(lt, k) | has(ld, k), NEGATIVE) for k in profile.negative])
    gone = lambda k: (has(t, k) | has(d, k)) & ~has(lt, k) & ~has(ld, k)
    negated = F.array_join(F.array_compact(F.array(*[F.when(gone(k), F.lit(k)) for k in (*profile.strong, *profile.good, *profile.negative)])), ",")
    rank = point(has(t, "staff"), STAFF) if profile.staff else F.lit(0.0)
    rank = F.when(rank > 0, rank).otherwise(point((has(t, "senior") | has(t, "sr")), SENIOR) if profile.senior else F.lit(0.0))
    low, high = F.coalesce("level_low", "level_high"), F.coalesce("level_high", "level_low")
    apart = F.when(high < profile.levels[0], profile.levels[0] - high).when(low > profile.levels[1], low - profile.levels[1]).otherwise(0.0)
    over = F.greatest(F.lit(0.0), F.coalesce(F.col("years") - profile.years, F.lit(0.0)))
    signals = total([point(has(t, k) | has(d, k), 1.0) for k in profile.signals])
    history = F.least(F.lit(MOST_HISTORY), (F.coalesce("h1b", F.lit(0)) + 2 * F.coalesce("perm", F.lit(0))) / 20.0)
    parts = {
        "strong": strong, "good": good, "negative": bad, "rank": rank, "level": 0.0 - F.round(apart * profile.level_weight, 1), "over_reach": 0.0 - F.round(over * profile.years_weight, 1),
        "visa": point(F.col("sponsors"), SPONSORS) + point(F.col("transfers"), TRANSFERS), "ai": F.least(F.lit(MOST_SIGNALS), signals * PER_SIGNAL) + point(F.col("ai_employer"), AI_EMPLOYER), "history": history,
        "place": point(F.col("metro"), METRO) + point(F.col("remote_us"), REMOTE), "fresh": point(F.coalesce(F.col("age_days") <= 1, F.lit(False)), FRESH),
    }
    at = at.select(*keep, negated.alias("negated"), *[p.alias(n) for n, p in parts.items()])
    return at.select(*keep, total([F.col(n) for n in parts]).alias("score"), "negated", *parts)
