"""Tri-state classifiers as ordered conditions over lexicons: match, review (kept, never dropped) or no_match.

Patterns use no lookaround and no classes beyond ASCII, so any engine reads them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOREIGN = r"(^|[^a-z])(london|berlin|paris|toronto|canada|india|germany|france|united kingdom|uk)($|[^a-z])"
US = r"(^|[^a-z])(usa|us|united states|new york|seattle|austin|boston|san francisco)($|[^a-z])"
REMOTE = r"(^|[^a-z])(remote|work from home|anywhere)($|[^a-z])"
HYBRID = r"(^|[^a-z])(hybrid)($|[^a-z])"
ONSITE = r"(^|[^a-z])(on-site|onsite|in office|in-office)($|[^a-z])"


def workplace(location: Column, text: Column) -> Column:
    """remote, hybrid, onsite or unknown; words that contradict each other leave it unknown."""
    a, t = F.lower(F.coalesce(location, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    onsite, remote, hybrid = t.rlike(ONSITE), t.rlike(REMOTE), t.rlike(HYBRID)
    at_remote, at_hybrid = a.rlike(REMOTE), a.rlike(HYBRID)
    conflict = (onsite & (remote | at_remote)) | (hybrid & remote) | (at_hybrid & remote)
    return (
        F.when(conflict, "unknown").when(onsite, "onsite").when(remote, "remote").when(hybrid | at_hybrid, "hybrid").when(at_remote, "remote")
        .when((a != "") & (t == ""), "onsite").otherwise("unknown")
    )


def location_category(location: Column, metros: str, allow_remote: bool = True) -> Column:
    """metro, unknown, foreign, us_remote or other_us, in the order of the rules."""
    a = F.lower(F.coalesce(location, F.lit("")))
    foreign, us, remote = a.rlike(FOREIGN), a.rlike(US), a.rlike(REMOTE)
    return (
        F.when(a.rlike(metros), "metro").when(foreign & us, "unknown").when(foreign, "foreign").when(remote & ~us & a.rlike(r"^[^a-z]*remote[^a-z]*$"), "unknown")
        .when(remote, "us_remote" if allow_remote else "other_us").when(us, "other_us").otherwise("unknown")
    )


def location_decision(category: Column, us_only: bool = True, require_match: bool = False) -> Column:
    return (
        F.when(category.isin("metro", "us_remote"), "match").when((category == "foreign") & F.lit(us_only), "no_match")
        .when((category == "other_us") & F.lit(require_match), "no_match").otherwise("review")
    )
