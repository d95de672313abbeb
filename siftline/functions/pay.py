"""Bands of pay in texts: each money range tied to the nearest words for pay, its currency, its period and its place.

A range is pay only if words for pay or for total compensation are near it, the last such word before it deciding which, or if
both ends state a period. One currency must hold for both ends. The period is stated at an end, or by the one cue around it, or
is the year where both ends are too large for anything else. Ranges that cannot be one band are dropped, each for itself. The
annual envelope spans the annual bands of a text, unless that would be no band itself; why there is none is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import evidence as E

# ---- fixed values: spellings of amounts, words for pay, limits of a band

CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP"}
AMOUNT = r"(?:(USD|CAD|EUR|GBP) ?)?([$€£])? ?([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{2})?|[0-9]{2,3}(?:\.[0-9]+)?) ?([kK])?"
PERIOD = r"(?: ?(per (?:year|month|week|day|hour)|annually|monthly|weekly|daily|hourly|/(?:year|month|week|day|hour|hr)))?"
RANGE = rf"(?i){AMOUNT}{PERIOD} ?(?:-|–|—|to|through) ?{AMOUNT}{PERIOD}"
TOTAL = r"\b(?:total compensation|total annual compensation|total cash compensation|total comp|on-target earnings|on target earnings|ote)\b"
SALARY = r"\b(?:base salary|base pay|salary range|pay range|hourly range|hourly rate|annual salary|annual base|base compensation)\b"
HOURLY, ANNUAL = r"/hour|/hr|per hour|hourly", r"/year|per year|annually|annual salary|annual base|total annual compensation"
FLOOR = {"year": 10_000, "month": 500, "week": 100, "day": 50, "hour": 5}
CEILING = {"hour": 100_000}
SPREAD, MOST = 10, 10_000_000
BEFORE, AFTER = 120, 80
BROKEN_LEFT, BROKEN_RIGHT = r"[0-9.,]$", r"^(?:[0-9]|[.,][0-9])"
LABEL, SCOPED = r"([A-Za-z][A-Za-z0-9 ,/&().-]{1,80}) ?: ?$", r"(?i)\b(?:for|in) ([A-Za-z][A-Za-z0-9 ,/&().-]{1,60}) ?$"
#: Letters that a range has before its first digit at most.
LEAD = 6
BLANK = r"[ \t\n\r\f\x0B\xA0]+"


def lower(x: Column) -> Column:
    return F.translate(x, E.UPPER, E.LOWER)


def lead(text: str) -> Column:
    """How many letters at the beginning of a text no range can begin in."""
    return F.greatest(F.lit(0), F.length(F.regexp_extract(text, "^[^0-9]*", 0)) - LEAD)


def last_start(text: Column, pattern: str) -> Column:
    """Where the last match begins, -1 if there is none."""
    return F.when(text.rlike(pattern), F.length(F.regexp_extract(text, rf"^(.*){pattern}", 1))).otherwise(-1)


def _taken_apart(s: Column) -> Column:
    """A span with the parts of both ends and what stands around it, each looked for once."""
    parts = F.array(*[F.nullif(F.regexp_extract(s.phrase, RANGE, i), F.lit("")) for i in range(1, 11)])
    before, after = F.substring(s.left, -BEFORE, BEFORE), F.substring(s.right, 1, AFTER)
    return F.struct(
        s.at.alias("at"), parts.alias("parts"), (~s.left.rlike(BROKEN_LEFT) & ~s.right.rlike(BROKEN_RIGHT)).alias("whole"), before.alias("said"), lower(before).alias("before"), lower(after).alias("after"), lower(s.phrase).alias("phrase"),
    )


def _read(s: Column) -> Column:
    """A span taken apart, with the amounts of both ends and the words around it."""
    part = lambda i: F.get(s.parts, F.lit(i - 1))
    symbol = lambda i: F.element_at(F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv]), part(i))
    clash = lambda code, sign: F.coalesce(F.upper(part(code)) != symbol(sign), F.lit(False))
    currency = lambda code, sign: F.when(~clash(code, sign), F.coalesce(F.upper(part(code)), symbol(sign)))
    money = lambda i: F.round(F.replace(part(i), F.lit(","), F.lit("")).cast("decimal(18,4)") * F.when(part(i + 1).isNotNull(), 1000).otherwise(1)).cast("long")
    period = lambda i: F.when(lower(part(i)).rlike("hour|/hr"), "hour").when(lower(part(i)).rlike("year|annually"), "year").otherwise(F.regexp_extract(F.replace(lower(part(i)), F.lit("daily"), F.lit("day")), "month|week|day", 0))
    return F.struct(
        s.at.alias("at"), s.whole.alias("whole"), F.array_compact(F.array(currency(1, 2), currency(6, 7))).alias("currencies"),
        money(3).alias("a"), money(8).alias("b"), F.when(part(5).isNotNull(), period(5)).alias("p"), F.when(part(10).isNotNull(), period(10)).alias("q"),
        last_start(s.before, TOTAL).alias("total_at"), last_start(s.before, SALARY).alias("salary_at"), s.after.rlike(TOTAL).alias("total_next"), s.after.rlike(SALARY).alias("salary_next"),
        F.concat_ws(" ", s.before, s.after, s.phrase).alias("around"), s.said.alias("before"),
    )


def _band(s: Column) -> Column:
    named = (s.total_at >= 0) | (s.salary_at >= 0)
    total = F.when(named, s.total_at > s.salary_at).otherwise(s.total_next)
    salary = F.when(named, s.salary_at > s.total_at).otherwise(s.salary_next)
    low, high = F.least(s.a, s.b), F.greatest(s.a, s.b)
    hourly, annual = s.around.rlike(HOURLY), s.around.rlike(ANNUAL)
    cue = F.when(hourly & ~annual, "hour").when(annual & ~hourly, "year")
    stated = F.when(s.p.isNotNull() & s.q.isNotNull() & (s.p != s.q), F.lit(None)).when(F.coalesce(s.p, s.q).isNotNull(), F.coalesce(s.p, s.q)).otherwise(cue)
    period = F.coalesce(stated, F.when(low >= FLOOR["year"], "year"))
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in FLOOR.items() for x in kv]), period)
    ceiling = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CEILING.items() for x in kv]), period), F.lit(MOST))
    one = F.size(F.array_distinct(s.currencies)) == 1
    sane = (low > 0) & (high <= MOST) & period.isNotNull() & (high >= floor) & (high <= ceiling) & (high <= low * SPREAD)
    label, scoped = F.when(s.before.rlike(": ?$"), F.regexp_extract(s.before, LABEL, 1)).otherwise(""), F.regexp_extract(s.before, SCOPED, 1)
    kind = F.when(total, "total").when(salary | (s.p.isNotNull() & s.q.isNotNull()), "salary")
    return F.struct(
        s.at.alias("at"), F.when(s.whole & one & sane, kind).alias("kind"), low.alias("low"), high.alias("high"), F.get(s.currencies, F.lit(0)).alias("currency"), period.alias("period"),
        F.trim(F.when(label != "", label).otherwise(scoped), F.lit(" ,;-")).alias("place"), named.alias("named"),
    )


def with_bands(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, salary and total (arrays of bands in the order of the text), low and high of the year, and reason."""
    blank = df.select(*keep, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK, " ").alias("_text"))
    at = E.with_spans(blank, "_text", RANGE, "_money", skip=lead("_text"))
    for step in (_taken_apart, _read, _band):
        at = at.withColumn("_money", F.transform("_money", step))
    at = at.withColumn("salary", F.filter("_money", lambda s: s.kind == "salary")).withColumn("total", F.filter("_money", lambda s: s.kind == "total"))
    at = at.withColumn("_annual", F.filter("salary", lambda s: s.period == "year"))
    low, high = F.array_min(F.transform("_annual", lambda s: s.low)), F.array_max(F.transform("_annual", lambda s: s.high))
    at = at.withColumns({"low": low, "high": high}).withColumn("_one", F.coalesce(F.col("high") <= F.col("low") * SPREAD, F.lit(False)))
    reason = F.when(F.col("_one"), F.lit(None)).when(F.size("_annual") > 0, "pay_bands_conflict").when(F.size("salary") > 0, "pay_stated_not_annual")
    reason = reason.when(F.exists("_money", lambda s: s.named), "pay_stated_but_unparsed")
    return at.select(*keep, "salary", "total", F.when(F.col("_one"), F.col("low")).alias("low"), F.when(F.col("_one"), F.col("high")).alias("high"), reason.alias("reason"))


def said(bands: str) -> Column:
    """Bands as text: low-high currency/period place."""
    return F.array_join(F.transform(bands, lambda s: F.concat(s.low.cast("string"), F.lit("-"), s.high.cast("string"), F.lit(" "), s.currency, F.lit("/"), s.period, F.lit(" "), s.place)), "; ")
