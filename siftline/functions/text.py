"""Text scalars: Column in, Column out, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\r\f\x0b]+"
# Names of tracking parameters, path segments that name lists, and prefixes of platforms' ids.
TRACKING = r"^(utm_.*|gh_src|lever-origin|ref|source)$"
LISTING_SEGMENTS = (
    "job", "jobs", "joblist", "joblistings", "job-list", "job-listings", "remote", "remote-job", "remote-jobs", "remotejobs", "career", "careers", "opening", "openings",
    "position", "positions", "vacancy", "vacancies", "opportunity", "opportunities", "listing", "listings", "board", "boards", "search", "browse", "all",
)
PLATFORMS = {"greenhouse": "gh", "ashby": "ashby", "lever": "lever", "smartrecruiters": "sr", "amazon": "amazon", "apple": "apple", "meta": "meta"}
LEGAL_SUFFIX = r"[ ,]+(inc|llc|ltd|gmbh|corp|corporation|company|co|plc|ag|sa)\.?$"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
HOME_PATH = r"/(home|Users)/[A-Za-z0-9_.-]+"


def normalize(x: Column) -> Column:
    """Small letters, dashes as '-', nothing but a-z 0-9 - + / . # and single spaces."""
    dashes = F.translate(F.lower(x), "‐‑‒–—―", "------")
    return F.trim(F.regexp_replace(F.regexp_replace(dashes, r"[^a-z0-9+/.# -]+", " "), "  +", " "))


def content_hash(x: Column) -> Column:
    """SHA-256 of small letters with collapsed white space."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(x), SPACES, " ")), 256)


def body_fingerprint(x: Column, least: int = 400) -> Column:
    """SHA-256 of the letters and digits; null for short bodies, which say too little to be equal."""
    folded = F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))
    return F.when(F.length(x) >= least, F.sha2(folded, 256))


def strip_html(x: Column) -> Column:
    """Tags out first, then the basic character references, then white space."""
    bare = F.regexp_replace(F.regexp_replace(x, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(bare, SPACES, " "))


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, host (with port), path and query of a URL without fragment and user; one without scheme takes https."""
    bare = F.trim(url)
    bare = F.when(F.contains(bare, F.lit("://")), bare).otherwise(F.concat(F.lit("https://"), bare))
    bare = F.regexp_replace(bare, "#.*$", "")
    part = lambda pattern: F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*)://" + pattern, 2)
    path = part("[^/?]*([^?]*)")
    return {
        "scheme": F.lower(F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)), "host": F.lower(part("(?:[^/?@]*@)?([^/?]*)")),
        "path": F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", "")), "query": F.regexp_extract(bare, r"\?(.*)$", 1),
    }


def canonical_url(url: Column, distinct: bool = False) -> Column:
    """Host in small letters, no fragment, user or tracking pairs, the other pairs in order of name and value, each as it is
    written in a form, and once if ``distinct``; no slash at the end of a longer path. '' for an empty URL."""
    parts = url_parts(url)
    coded = lambda x: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(x), x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.filter(F.split(parts["query"], "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING))
    named = F.transform(pairs, lambda p: F.struct(coded(F.substring_index(p, "=", 1)).alias("k"), coded(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    named = F.array_distinct(named) if distinct else named
    joined = F.array_join(F.transform(F.sort_array(named), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.concat(parts["scheme"], F.lit("://"), parts["host"], parts["path"], F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").otherwise(whole)


def is_listing_url(url: Column) -> Column:
    """No query and no path segment beyond the generic ones: a list of postings, not a posting."""
    canonical = canonical_url(url)
    own = F.filter(F.split(F.regexp_extract(canonical, "^[^:]*://[^/?]*([^?]*)", 1), "/"), lambda s: (s != "") & ~F.lower(s).isin(*LISTING_SEGMENTS))
    return ~F.contains(canonical, F.lit("?")) & (F.size(own) == 0)


def identity_key(url: Column, title: Column, company: Column | None = None, location: Column | None = None, source: Column | None = None, native: Column | None = None) -> Column:
    """By the source's own id where it has one, else by a URL that names one posting, else by content."""
    none = F.lit("")
    spaced = lambda x: F.regexp_replace(F.lower(F.trim(F.coalesce(x, none))), SPACES, " ")
    company, location = (none if x is None else x for x in (company, location))
    basis = F.concat_ws("|", spaced(company), spaced(title), spaced(location))
    key = F.when((canonical_url(url) != "") & ~is_listing_url(url), F.concat(F.lit("url-"), F.substring(F.sha2(canonical_url(url), 256), 1, 12)))
    key = key.otherwise(F.concat(F.lit("ck-"), F.substring(F.sha2(basis, 256), 1, 12)))
    if source is None or native is None:
        return key
    prefix = F.lit(None).cast("string")
    for name, short in PLATFORMS.items():
        prefix = F.when(source == name, short).otherwise(prefix)
    prefix = F.when(source == "workday", F.concat(F.lit("wd-"), F.coalesce(F.nullif(slugify(company), none), F.lit("unknown")))).otherwise(prefix)
    return F.when(prefix.isNotNull() & (F.coalesce(native, none) != ""), F.concat(prefix, F.lit("-"), slugify(native))).otherwise(key)


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip_legal_suffix(x: Column, rounds: int = 3) -> Column:
    """Company names without legal forms; a name that is nothing else stays."""
    out = F.lower(F.trim(x))
    for _ in range(rounds):
        cut = F.regexp_replace(out, LEGAL_SUFFIX, "")
        out = F.when(cut != "", cut).otherwise(out)
    return out


def term_pattern(term: str) -> str:
    """A term between no letters or digits, its separators free and its last word inflected; no lookaround."""
    words = [w for w in term.lower().replace("-", " ").split() if w]
    return r"(^|[^a-z0-9])" + r"[ -]?".join(words) + r"(s|es|ed|ing)?($|[^a-z0-9])"


def has_term(x: Column, term: str) -> Column:
    return F.lower(x).rlike(term_pattern(term))


def count_matches(x: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))


def tokens(x: Column) -> Column:
    """Distinct words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def repeated_lines(x: Column, least: int = 24, times: int = 3) -> Column:
    """Number of different lines of at least ``least`` letters that occur ``times`` times."""
    lines = F.sort_array(F.filter(F.transform(F.split(x, "\n"), F.trim), lambda s: F.length(s) >= least))
    # one pass over the sorted lines: the line before, how often it has come so far, and lines that came often enough
    start = F.struct(F.lit("").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("found"))

    def step(at: Column, line: Column) -> Column:
        run = F.when(at["line"] == line, at["run"] + 1).otherwise(1)
        return F.struct(line.alias("line"), run.alias("run"), (at["found"] + F.when(run == times, 1).otherwise(0)).alias("found"))

    return F.aggregate(lines, start, step, lambda at: at["found"])


def gibberish_tokens(x: Column, least: int = 6) -> Column:
    """Number of long words without a vowel."""
    return count_matches(F.lower(x), rf"(?:^|[^a-z])[bcdfghjklmnpqrstvwxz]{{{least},}}(?:$|[^a-z])")
