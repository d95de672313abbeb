"""Years of experience that a posting asks for: every statement of years, whose they are, and which one is the bar.

A statement counts if its sentence neither only prefers it nor says that somebody else has it. It is certain if it is called
required, is about work in general or stands in the first line, and is not about one tool or field. A count inside another
("including 2 years of ...") is a specialty: it never replaces the count that it narrows, and what is required of it is
required of that one. The bar is the most certain, then the greatest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import evidence as E

# ---- fixed values: spellings and cues

WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
WORD = "(?:" + "|".join(sorted(WORDS, key=len, reverse=True)) + ")"
NUMBER = rf"(?:[0-9]{{1,2}}(?:\.[0-9]+)?|{WORD}\b(?: ?\( ?[0-9]{{1,2}} ?\))?)"
YEARS, MORE = r"(?:years?|yrs?)", r"(?: ?(?:\+|plus) ?)"
RANGE = rf"{NUMBER} ?(?:-|–|—|to|through) ?{NUMBER} ?{MORE}? ?{YEARS}"
PATTERN = (
    rf"\b(?:{RANGE}|(?:minimum|min\.?) (?:of )?{NUMBER}{MORE}? ?{YEARS}|at least {NUMBER}{MORE}? ?{YEARS}|{NUMBER}{MORE}{YEARS}|{NUMBER} or more {YEARS}|{NUMBER} ?{YEARS}['’]? (?:of )?(?:[a-z0-9_-]+ ){{0,3}}experience)\b"
)
STATED = rf"\b{NUMBER}{MORE}? ?{YEARS}\b"
PREFERRED = r"\b(?:preferred|ideally|nice[- ]to[- ]have|bonus|a plus|desired|optional)\b"
REQUIRED = r"\b(?:required|requirements?|must|minimum|at least|should have|you(?:'ll| will)? (?:need|have)|qualifications?)\b"
GENERAL = r"\b(?:professional|industry|work|relevant|software engineering|engineering) experience\b"
OTHERS = (
    r"\b(?:(?:our|the|a|an|its|their) (?:teams?|founders?|co-?founders?|leadership|engineers|staff|employees|people|company|companies|group|advisors?|investors?|board|executives?|management|clients?|customers?|partners?|users?)"
    r"|we (?:have|had|bring|brings|combine|combines|share|shares|boast|boasts|carry|carries|average|averages|count|serve|serves)|(?:clients?|customers?|partners?|users?|founders?|advisors?|investors?|executives?) (?:who|that|with)|founded)\b"
)
APPLICANT = (
    r"\b(?:you|your|candidates?|applicants?|ideal|successful|seeking|seeks?|looking for|hiring|hire|join|opening|opportunit(?:y|ies)|roles?|positions?|vacancy|require[sd]?|requirements?|must|minimum|at least|qualifications?"
    r"|should have|we want|we need|someone|somebody)\b"
)
COMBINED = r"\bcombined\b"
FIELD = r"\byears?(?: of experience)? (?:working with|using|with|in) ([a-z]+(?: [a-z]+)?)"
GENERAL_FIELD = r"^(?:software engineering|engineering|industry|professional)\b"
KIND = r"\byears? (?:of )?([a-z0-9+#.-]+) experience\b"
GENERAL_KIND = r"^(?:professional|industry|work|relevant|engineering|of|in|with|as|at|on|for|to|and|or|the|an?)$"
INSIDE = r"\b(?:including|includes|included|incl\.?|of which|of these|thereof|which includes?|with|within|plus|comprising|comprised of)\b"
FILLER = r"[ ,;:()\[\]/&+.–—-]*(?:(?:at least|a minimum of|minimum(?: of)?|min\.?|over|more than|no less than|up to|the|an?|of|in|on)[ ,;:()\[\]/&+.–—-]*)*"
BLANK, LINE = r"[ \t\r\f\x0B\xA0]+", r"[\n.]"
MOST = 50
#: Each match of PATTERN or STATED has one of these, and no match has a line feed.
NEEDS = ("year", "yr")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), E.UPPER, E.LOWER), BLANK, " ")


def number(token: Column) -> Column:
    """A count in digits or as a word."""
    bare = F.trim(F.regexp_replace(token, r"\(.*\)", ""))
    return F.coalesce(bare.try_cast("double"), F.nullif(F.array_position(F.array(*map(F.lit, WORDS)), bare), F.lit(0)).cast("double"))


def _stated(s: Column, first_line: Column) -> Column:
    """A span with its numbers, its sentence to either side, and where it ends."""
    numbers = F.regexp_extract_all(s.phrase, F.lit(rf"\b{NUMBER}"), F.lit(0))
    both = s.phrase.rlike(rf"^{RANGE}$")
    before, after = F.substring(E.after_last(s.left, LINE), -100, 100), F.substring(E.before_first(s.right, LINE), 1, 100)
    return F.struct(
        s.at.alias("at"), (s.at + F.length(s.phrase)).alias("end"), s.phrase.alias("phrase"), number(F.get(numbers, F.lit(0))).alias("low"), F.when(both, number(F.element_at(numbers, -1))).alias("high"),
        before.alias("before"), E.before_first(after, STATED).alias("after"), F.coalesce(s.at < first_line, F.lit(False)).alias("first"),
    )


def _candidate(s: Column) -> Column:
    """A stated span as a candidate; kind null where it asks nothing of the reader."""
    window = lambda left, right: F.concat(F.substring(s.before, -left, left), s.phrase, F.substring(s.after, 1, right))
    claim = F.substring(s.before, -80, 80)
    others = claim.rlike(OTHERS) & ~E.after_last(claim, OTHERS).rlike(APPLICANT)
    context = F.concat(s.phrase, F.substring(s.after, 1, 80))
    field, kind = F.regexp_extract(context, FIELD, 1), F.regexp_extract(context, KIND, 1)
    contextual = ((field != "") & ~field.rlike(GENERAL_FIELD)) | ((kind != "") & ~kind.rlike(GENERAL_KIND))
    sure = (window(80, 30).rlike(REQUIRED) | context.rlike(GENERAL) | s["first"]) & ~contextual
    real = s.low.isNotNull() & (s.low <= MOST) & F.coalesce((s.high >= s.low) & (s.high <= MOST), F.lit(True))
    asks = real & ~window(60, 30).rlike(PREFERRED) & ~others & ~window(40, 40).rlike(COMBINED)
    return F.struct(
        s.at.alias("at"), s.end.alias("end"), s.phrase.alias("phrase"), s.low.alias("low"), s.high.alias("high"), F.when(asks, F.when(contextual, "contextual").otherwise("required")).alias("kind"), sure.cast("int").alias("sure"),
    )


def _picked(candidates: str) -> Column:
    """The most certain, then greatest, one with an upper bound first, then the first."""
    place = F.transform(candidates, lambda c: F.struct(c.sure.alias("sure"), c.low.alias("low"), c.high.isNotNull().cast("int").alias("bound"), (-c.at).alias("place"), c.high.alias("high"), c.kind.alias("kind")))
    return F.array_max(place)


def with_years(df: DataFrame, text: str, *keep: str, cap: float | None = None) -> DataFrame:
    """``keep`` and min, max, confidence, kind, specialty (its least years), reason and decision."""
    at = E.with_spans(df.select(*keep, normalised(F.col(text)).alias("_t")), "_t", PATTERN, "_s", "\n", NEEDS)
    at = at.withColumn("_line", F.nullif(F.instr("_t", "\n"), F.lit(0)) - 1)
    at = at.withColumn("_n", F.size("_s")).withColumn("_s", F.transform("_s", lambda s: _stated(s, F.col("_line")))).withColumn("_s", F.transform("_s", _candidate))
    at = at.withColumn("_s", F.filter("_s", lambda c: c.kind.isNotNull()))

    def related(c: Column, i: Column) -> Column:
        before = F.get("_s", i - 1)
        gap = F.when(i > 0, F.substring("_t", before["end"] + 1, c.at - before["end"]))
        nested = F.coalesce(~gap.rlike(LINE) & gap.rlike(rf"{INSIDE}{FILLER}$"), F.lit(False))
        return F.struct(c.at.alias("at"), c.low.alias("low"), c.high.alias("high"), c.kind.alias("kind"), c.sure.alias("sure"), nested.alias("nested"), (nested & F.concat(gap, c.phrase).rlike(REQUIRED)).alias("cued"))

    at = at.withColumn("_s", F.transform("_s", related))
    kind = "array<struct<at:int,low:double,high:double,kind:string,sure:int,nested:boolean,cued:boolean>>"
    start = F.struct(F.lit(False).alias("cued"), F.array().cast(kind).alias("out"))

    def raised(state: Column, c: Column) -> Column:
        up = ~c.nested & state["cued"] & (c.kind != "contextual")
        one = F.struct(c.at.alias("at"), c.low.alias("low"), c.high.alias("high"), c.kind.alias("kind"), F.when(up, 1).otherwise(c.sure).alias("sure"), c.nested.alias("nested"), c.cued.alias("cued"))
        return F.struct((c.nested & (state["cued"] | c.cued)).alias("cued"), F.concat(state["out"], F.array(one)).alias("out"))

    # from the last to the first: what is required of a specialty is required of the count around it
    at = at.withColumn("_s", F.aggregate(F.reverse("_s"), start, raised, lambda s: s["out"]))
    at = at.withColumn("_main", F.filter("_s", lambda c: ~c.nested)).withColumn("_inner", F.filter("_s", lambda c: c.nested)).withColumn("_main", F.when(F.size("_main") > 0, F.col("_main")).otherwise(F.col("_s")))
    at = at.withColumn("_p", _picked("_main")).withColumn("_q", _picked("_inner"))
    unread = (F.col("_n") == 0) & E.has_any(F.col("_t"), NEEDS) & F.contains("_t", F.lit("experien")) & F.exists(F.split("_t", LINE), lambda s: s.rlike(STATED) & s.rlike(r"\bexperien(?:ce|ced)\b"))
    confidence = F.when(F.col("_p").isNull(), "unknown").when(F.col("_p.sure") == 1, "high").otherwise("medium")
    over = F.lit(False) if cap is None else F.col("_p.low") > cap
    return at.select(
        *keep, F.col("_p.low").alias("min"), F.col("_p.high").alias("max"), confidence.alias("confidence"), F.coalesce("_p.kind", F.lit("not_stated")).alias("kind"), F.col("_q.low").alias("specialty"),
        F.when(unread, "yoe_stated_but_unparsed").alias("reason"), F.when(confidence != "high", "review").when(over, "no_match").otherwise("match").alias("decision"),
    )
