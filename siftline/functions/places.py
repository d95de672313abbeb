"""Where a posting is and whether one works there: the workplace from all that is said, the category of the place, and a decision.

What contradicts itself is unknown and goes to review. The location field alone says that a place is wanted; a title can only say that it is
not. A remote posting is where its text binds people to live, or else open. Every list of places is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.encoding import folded

# ---- fixed values: words for workplaces and for binding people to a place

REMOTE_FIELD = ("remote", "remotely", "work from home", "wfh", "fully remote", "anywhere", "worldwide", "global")
UNBOUND = ("anywhere", "worldwide", "global")
REMOTE = r"\b(?:fully remote|100% remote|remote[- ]first|work(?:ing)? remotely|(?:is|are) remote|remote (?:role|position|job|opportunity|within|in the|across)|work from home|office or remote|or remotely)\b"
EITHER = r"\b(?:office or remote|or remotely)\b"
NOT_REMOTE = r"\b(?:no|not|never|without|can not|cannot|can't|isn't|aren't|nor|little|rarely)\b[^.;:!?\n]{0,24}$"
HYBRID = r"\bhybrid\b|\b(?:[1-4]|one|two|three|four) days? (?:a|per|each) week (?:in|at) (?:the|our) office\b"
ONSITE = r"\b(?:fully on-?site|on-?site (?:role|position|job|only|required)|must (?:be|work) on-?site|(?:5|five) days? (?:a|per|each) week in(?: the|-)office|in-office (?:role|position|only|required))\b"
NOT_ONSITE = r"(?:\bno\b|\bnot\b|\bwithout\b|\bisn't\b|\baren't\b|\bnever\b|\bzero\b) *$"
OPTIONAL = (
    r"\bremote or hybrid\b|\bhybrid or remote\b|\b(?:option(?:al|s)?|choice|choose|flexib[a-z]*|if you (?:prefer|want|choose|like)|can (?:also )?(?:work|choose|opt)|welcome to)\b[^.\n]{0,40}\bhybrid\b"
    r"|\bhybrid\b[^.\n]{0,40}\b(?:option(?:al)?|available|encouraged|welcome|if you (?:prefer|want|choose)|not required)\b"
)
RESIDENCY = r"\b(?:must|required?|requirement|need to|expected to|have to)\b([^.;:!?\n]{0,60}?)\b(?:resid(?:e|es|ing|ency)|live|living|located|based)\b (?:in|within|near) (?:the )?([^.;:!?\n]{2,60})"
EXCLUDED = r"\b(?:except(?: (?:for|in))?|excluding|not (?:open|available|eligible) (?:to|in|for)|(?:unable|not able) to (?:hire|employ) (?:in|from)|(?:do(?:es)? not|cannot|can't) (?:hire|employ) (?:in|from))\b([^.;:!?\n]{2,180})"
WORKPLACE_ONLY = r"^[^a-z]*(?:(?:fully )?remote(?:ly)?|hybrid|on-?site|work from home|wfh|anywhere|worldwide|global)(?:[^a-z]+(?:remote|hybrid|on-?site))*[^a-z]*$"


class Lexicon(NamedTuple):
    """Places by what they are, in plain lower-case letters."""

    metros: Sequence[str]
    us: Sequence[str]
    offices: Sequence[str]
    foreign: Sequence[str]
    allow_remote: bool = True
    us_only: bool = True
    require_match: bool = True


def named(words: Sequence[str]) -> str:
    """A pattern for any of the words, between no letters or digits; longer words first."""
    return r"(?:^|[^a-z0-9])(?:" + "|".join(sorted((w.replace(".", r"\.") for w in words), key=lambda w: (-len(w), w))) + r")(?:$|[^a-z0-9])"


def plain(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(folded(F.coalesce(x, F.lit("")))), r"[ \t\r\f]+", " "))


def unless(text: Column, pattern: str, denied: str) -> Column:
    """The pattern occurs, and no denial stands before its first match in the same sentence."""
    before = F.regexp_extract(text, rf"(?s)^(.*?)(?:{pattern})", 1)
    return text.rlike(pattern) & ~F.regexp_replace(before, r"(?s)^.*[.;!?\n]", "").rlike(denied)


def with_workplace(df: DataFrame) -> DataFrame:
    """``df`` with workplace, confidence and doubt, from plain columns location, text, and hint ('' if none) and trusted. What decides is a column
    each: inside one expression it would be evaluated once for every branch that asks."""
    at, said = F.col("location"), F.col("text")
    df = df.withColumns({
        "_tag": at.rlike(WORKPLACE_ONLY), "_remote": unless(said, REMOTE, NOT_REMOTE), "_either": said.rlike(EITHER), "_at_remote": at.rlike(named(REMOTE_FIELD)), "_onsite": unless(said, ONSITE, NOT_ONSITE), "_optional": said.rlike(OPTIONAL),
        "_hybrid": said.rlike(HYBRID), "_at_hybrid": at.rlike(named(("hybrid",))),
    })
    up = ~(F.col("_optional") & (F.col("_remote") | F.col("_at_remote")))
    df = df.withColumns({"_hybrid": F.col("_hybrid") & up, "_at_hybrid": F.col("_at_hybrid") & up})
    remote, at_remote, hybrid, at_hybrid, onsite, hint = (F.col(c) for c in ("_remote", "_at_remote", "_hybrid", "_at_hybrid", "_onsite", "hint"))
    clash = (
        F.when(onsite & (remote | at_remote | (hint == "remote")), "remote_onsite_conflict").when(hybrid & remote & ~F.col("_either"), "remote_hybrid_conflict")
        .when(at_hybrid & remote & ~F.col("_either") & ~F.col("_tag"), "location_hybrid_jd_remote_conflict")
    )
    df = df.withColumn("_clash", clash)
    hinted = hint.isin("remote", "hybrid")
    # place and confidence as one text, so that the order of the rules stands once
    both = (
        F.when(F.col("_clash").isNotNull(), "unknown low").when(onsite, "onsite high").when(remote, "remote high").when(hybrid | at_hybrid, "hybrid high").when(at_remote, "remote high").when(hint == "onsite", "onsite medium")
        .when(hinted & F.col("trusted"), F.concat(hint, F.lit(" medium"))).when(hinted, F.concat(hint, F.lit(" low"))).when((at != "") & (F.trim(said) != ""), "unknown medium").when(at != "", "onsite medium").otherwise("unknown unknown")
    )
    df = df.withColumn("_both", both)
    doubt = F.when(F.col("_clash").isNull() & F.col("_both").isin("remote low", "hybrid low"), "uncorroborated_ats_workplace_hint").otherwise(F.col("_clash"))
    return df.withColumns({"workplace": F.substring_index("_both", " ", 1), "confidence": F.substring_index("_both", " ", -1), "doubt": doubt})


CANADA = r"\b(?:us|usa|united states)\b[^a-z]*(?:or|and|&|/|,)[^a-z]*canada\b|\bcanada\b[^a-z]*(?:or|and|&|/|,)[^a-z]*(?:the )?(?:us|usa|united states)\b"


def with_decision(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``df`` of ``with_workplace`` with category, decision and reason; further column title, plain."""
    at, said, both = F.col("location"), F.col("text"), F.concat_ws(" | ", "location", "title")
    gap, home = (F.regexp_extract(said, RESIDENCY, i) for i in (1, 2))
    df = df.withColumns({
        "_pair": both.rlike(CANADA), "_abroad": both.rlike(named(lexicon.foreign)), "_us": at.rlike(named(lexicon.us)), "_office": at.rlike(named(lexicon.offices)), "_metro": at.rlike(named(lexicon.metros)),
        "_gap": gap, "_home": home, "_shut_to": F.regexp_extract(said, EXCLUDED, 1), "_us_said": said.rlike(named(lexicon.us)),
    })
    place = F.col("_home")
    kind = F.when(place.rlike(named(lexicon.metros)), "metro").when(place.rlike(named(lexicon.us)), "us_remote").when(place.rlike(named(lexicon.offices)), "other_us").when(place.rlike(named(lexicon.foreign)), "foreign").otherwise("unknown")
    bound = (place != "") & ~F.substring("_gap", -16, 16).rlike(r"\b(?:no|nor|not|never)\b|n't")
    df = df.withColumns({"_lives": F.when(bound, kind), "_abroad": F.col("_abroad") & ~F.col("_pair"), "_us": F.col("_us") | F.col("_pair")})
    lives, us, abroad, remote = F.col("_lives"), F.col("_us"), F.col("_abroad"), F.col("workplace") == "remote"
    lost = F.col("_tag") & ~us & ~at.rlike(named(UNBOUND)) & ~F.col("_us_said")
    settled = F.col("workplace").isin("hybrid", "onsite") & (F.col("confidence") == "high")
    rule = (
        F.when(F.col("_metro"), "metro").when(abroad & us, "unknown mixed_us_foreign_scope").when(abroad, "foreign").when(remote & (lives == "unknown"), "unknown residency_restriction_unparsed").when(remote & lives.isNotNull(), lives)
        .when(remote & lost, "unknown remote_without_us_scope").when(remote, "us_remote").when(F.col("_office"), "other_us").when(us & settled & F.lit(lexicon.allow_remote), "unknown us_scope_without_remote_workplace")
        .when(us, "us_remote" if lexicon.allow_remote else "other_us").when(F.col("_tag"), "unknown workplace_tag_without_geography").otherwise("unknown")
    )
    df = df.withColumn("_rule", rule)
    category, lost_why = F.substring_index("_rule", " ", 1), F.when(F.contains(F.col("_rule"), F.lit(" ")), F.substring_index("_rule", " ", -1))
    df = df.withColumns({"category": category, "_lost": lost_why})
    shut = (F.col("category") == "us_remote") & (F.col("_shut_to") != "")
    for m in lexicon.metros:
        shut &= F.col("_shut_to").rlike(named([m]))
    df = df.withColumn("_shut", shut)
    df = df.withColumn("_why", F.when((F.col("category") != "foreign") & ~F.col("_shut"), F.coalesce("doubt", "_lost")))
    decision = (
        F.when(F.col("_shut"), "no_match").when(F.col("_why").isNotNull(), "review").when((F.col("category") == "metro") | ((F.col("category") == "us_remote") & F.lit(lexicon.allow_remote)), "match")
        .when(F.col("category") == "other_us", "no_match" if lexicon.require_match else "match").when(F.col("category") == "foreign", "no_match" if lexicon.us_only else "match")
        .otherwise("review" if lexicon.require_match or lexicon.us_only else "match")
    )
    df = df.withColumn("decision", decision)
    return df.withColumn("reason", F.when(F.col("_why").isNull() & (F.col("decision") == "review"), "unclassified_location").otherwise(F.col("_why")))
