"""Titles judged against what a search wants, and the level that a title, a text or a count of years states.

The verdict goes by precedence: a word that the search excludes; an occupation that is none of engineering, unless the search itself
names it; titles that the search does not name, or names only by a broad field; leadership. Only the first two drop a title.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import text as T

# ---- fixed values: role nouns, fields, occupations, levels

ROLE = r"\b(?:engineer|engineers|engineering|developer|developers|swe|sde|sre|programmer|architect)\b|site reliability|reliability engineer"
RESEARCH = r"\b(?:scientist|scientists|researcher|researchers)\b"
BROAD = (
    "infrastructure", "platform", "compute", "cloud", "data", "systems", "distributed systems", "networking", "network", "storage", "security", "observability", "reliability", "devops", "api", "services", "backend", "back end", "frontend",
    "front end", "full stack", "fullstack", "ml", "ai", "machine learning",
)
LEADERSHIP = r"\b(?:lead|leader|leadership)\b"
EARLY = r"\b(?:new (?:college )?grad(?:uate)?|graduate (?:software )?engineer)\b"
SUFFIX = r"(?:, *| [-–—] +)([^,;/|]+?\bmanager(?: *\([^)]*\))?) *$"
MANAGES = r"\b(?:engineering|software development|product|project|program|people|team|technical|lead|senior|delivery|operations?|hiring|line) manager\b"
OCCUPATIONS = {
    "sales": r"\bsales\b|\baccount executive\b|\bbusiness development\b|\bbdr\b|\bsdr\b|\bcustomer success\b",
    "marketing": r"\bmarketing\b|\badvertising\b|\bbrand manager\b|\bcontent strategist\b|\bpartnerships? (?:lead|manager|director)\b|\bpublic relations\b|\bcommunications (?:lead|manager|specialist)\b",
    "recruiting": r"\brecruit(?:er|ing|ment)\b|\btalent acquisition\b|\bpeople operations\b|\bhuman resources\b|\bhr\b",
    "finance": r"\bfinance\b|\bfinancial\b|\bcapital markets?\b|\bfinancing\b|\baccounting\b|\baccountant\b|\bbanking\b|\bbanker\b|\bunderwrit(?:er|ing)\b|\bportfolio manager\b|\binvestment (?:banking|analyst)\b",
    "legal": r"\blegal\b|\bparalegal\b|\battorney\b|\bcounsel\b",
    "clinical": r"\bnurse\b|\bnursing\b|\bphysician\b|\bclinician\b|\btherapist\b|\bpharmacist\b|\bveterinar(?:y|ian)\b|\bclinical\b",
    "education": r"\bteacher\b|\bprofessor\b|\binstructor\b|\btutor\b|\bcurriculum\b",
}
STAFF_MEMBER = r"\bmembers? of (?:the )?(?:[a-z][a-z0-9&/'-]* ){0,2}staff\b"
LEVELS = {
    "distinguished": r"\b(?:distinguished|fellow)\b", "senior_staff": r"\b(?:senior staff|sr\.? staff)\b", "principal": r"\bprincipal\b", "staff": r"\bstaff\b", "senior": r"\b(?:senior|sr\.?|software engineer iii|swe iii)\b",
    "entry": r"\b(?:intern|new grad(?:uate)?|entry[- ]level|junior|jr\.?|associate|software engineer i|swe i)\b", "mid": r"\b(?:mid[- ]level|intermediate|software engineer ii|swe ii|engineer ii)\b",
}
SCOPES = {
    "executive": r"\bchief [a-z]+ officer\b|\b(?:cto|ceo|coo|cio|cfo|cpo|cmo)\b|\b(?:svp|evp|vice president|vp)\b", "director": r"\bdirectors?\b|\bhead of\b",
    "senior_manager": r"\b(?:senior|sr\.?|group|principal|global|regional|area|second[- ]line) (?:[a-z0-9_&/-]+[ ,]+){0,2}managers?\b|\bmanagers? of managers\b", "line_manager": r"\bmanagers?\b",
}
OWN_MANAGER = (
    r"\b(?:product|program|programme|project|portfolio|account|partner|partnership|alliance|channel|category|brand|marketing|content|community|social|communications?|campaign|sales|territory|district|store|restaurant|property|facilit(?:y|ies)"
    r"|office|case|care|clinical|risk|compliance|audit|vendor|supplier|procurement|inventory|logistics|traffic|asset|wealth|fund|investment|relationship|success|events?|talent|recruiting|payroll|benefits?|contract|construction|quality|safety"
    r"|environmental) manager\b"
)
IC_NOUN = r"\b(?:engineer|developer|programmer|scientist|architect|analyst|designer|researcher|consultant|specialist|technician|nurse|accountant|attorney|counsel)\b"
BODY_ROLE = r"(?:software )?(?:engineer|developer|programmer)\b"
BODY_LEVELS = {
    name: (rf"\b{words} {BODY_ROLE}|" if lead else "") + rf"\bthis (?:role|position) is (?:an? )?{words.replace(' ', '[- ]')}[- ]level\b|\b{words.replace(' ', '[- ]')}[- ]level (?:role|position)\b"
    for name, words, lead in (("distinguished", "distinguished", 1), ("senior_staff", "senior staff", 1), ("principal", "principal", 1), ("staff", "staff", 1), ("senior", "senior", 0), ("mid", "mid", 0), ("entry", "entry", 0))
}
CODES = ("entry", "mid", "senior", "staff", "senior_staff", "principal", "distinguished", "distinguished")


class Search(NamedTuple):
    """What a search wants in a title, what it does not, and phrases in which an unwanted word means nothing."""

    include: Sequence[str]
    exclude: Sequence[str]
    neutral: Sequence[str] = ()


def cleaned(title: Column) -> Column:
    """In lower case, dashes as hyphens, blanks single; commas stay."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))


def first_of(patterns: dict[str, str], x: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        out = F.when(x.rlike(p), name).otherwise(out)
    return out


def scope_of(title: Column) -> Column:
    """The people a title says that it leads; null where it names an own trade first, or a manager of things."""
    x = F.regexp_replace(cleaned(title), STAFF_MEMBER, " ")
    out = F.lit(None).cast("string")
    for name, p in reversed(SCOPES.items()):
        trade_first = F.regexp_extract(x, rf"^(.*?)(?:{p})", 1).rlike(IC_NOUN)
        own = x.rlike(OWN_MANAGER) if name in ("senior_manager", "line_manager") else F.lit(False)
        out = F.when(x.rlike(p), F.when(~trade_first & ~own, name)).otherwise(out)
    return out


def level_of_title(title: Column) -> Column:
    return F.coalesce(scope_of(title), first_of(LEVELS, F.regexp_replace(cleaned(title), STAFF_MEMBER, " ")), F.lit("unknown"))


def level_of_body(text: Column) -> Column:
    """A level that a text states in so many words, or by a code; never from a bare adjective."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+", " ")
    code = F.nullif(F.regexp_extract(x, r"\bL([3-9]|10)\b", 1), F.lit("")).cast("int")
    return F.coalesce(first_of(BODY_LEVELS, F.lower(x)), F.get(F.array(*map(F.lit, CODES)), code - 3), F.lit("unknown"))


def level_of_years(least: Column) -> Column:
    return F.when(least.isNull(), "unknown").when(least < 2, "entry").when(least < 5, "mid").when(least < 9, "senior").when(least < 13, "staff").otherwise("senior_staff")


def assessed(title: Column, search: Search) -> dict[str, Column]:
    """decision, level, rules (joined) of a title."""
    raw, x = cleaned(title), T.normalize(title)
    scan = x
    for phrase in search.neutral:
        scan = F.replace(scan, F.lit(phrase.lower()), F.lit(" "))
    scan = F.regexp_replace(scan, STAFF_MEMBER, " ") if any("of" in p and "staff" in p for p in search.neutral) else scan
    hits = lambda terms, at: F.array_compact(F.array(*[F.when(at.rlike(T.term_pattern(t)), F.lit(t)) for t in terms]))
    excluded = hits(search.exclude, scan)
    if "new grad" in search.exclude:
        excluded = F.array_distinct(F.concat(excluded, F.when(scan.rlike(EARLY), F.array(F.lit("new grad"))).otherwise(F.array().cast("array<string>"))))
    named = hits(search.include, x)
    bearing = [t for t in search.include if re.search(ROLE, t.lower())]
    clean = [t for t in search.include if t.lower() not in BROAD]
    tail = F.regexp_extract(raw, SUFFIX, 1)
    product = (tail != "") & ~T.normalize(tail).rlike(MANAGES) & (F.size(hits(bearing, T.normalize(F.regexp_replace(raw, SUFFIX, "")))) > 0)
    only_manager = (F.size(excluded) == 1) & F.array_contains(excluded, "manager")
    other = F.array_compact(F.array(*[F.when(scan.rlike(p), F.lit(n)) for n, p in OCCUPATIONS.items()]))
    foreign = (F.size(hits(clean, x)) == 0) & ~scan.rlike(ROLE) & ~scan.rlike(RESEARCH) & (F.size(other) > 0)
    unnamed = F.size(named) == 0
    broad = ~unnamed & (F.size(hits(bearing, x)) == 0) & (F.size(hits([t for t in search.include if t.lower() in BROAD], x)) > 0) & ~x.rlike(ROLE)
    told = lambda head, names: F.array_join(F.transform(names, lambda n: F.concat(F.lit(head), n)), ",")
    rules = (
        F.when((F.size(excluded) > 0) & only_manager & product, "manager_product_suffix_ambiguous").when(F.size(excluded) > 0, told("excluded.", excluded)).when(foreign, told("nontechnical_occupation.", other))
        .when(unnamed, "not_included").when(broad, "broad_domain_without_role").when(scan.rlike(LEADERSHIP), "leadership_ambiguous").otherwise(told("included.", named))
    )
    decision = F.when(rules.rlike("^(?:excluded|nontechnical)"), "no_match").when(rules.rlike("^included"), "match").otherwise("review")
    return {"decision": decision, "level": level_of_title(title), "rules": rules}
