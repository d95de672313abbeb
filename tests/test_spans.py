"""Spans are the same wherever a text is searched, and texts are searched by pattern only where matches can be."""

import pytest
from pyspark.sql import functions as F

from siftline import registry
from siftline.functions import evidence as E
from siftline.functions import pay as P
from siftline.functions import sponsorship as S
from siftline.functions import years as Y

DATA = "/root/testdata/sf0.001"
YEARS = ("5+ years of experience\nat least 3 yrs\n\n4 years\n", "no such thing", "", None, "seven (7) years\n.5 years", "é☃\U0001f600 3-5 years\n\U0001f600 10 or more years", "\n\n2.5 yrs", "five\nyears", "1 year of\nexperience")
VISA = ("visa sponsorship is available. we do not sponsor. us citizens only.", "candidates here must be a us citizen. none", "no sponsorship", "visa: gc", ".visa sponsorship.", "green card. holders only", "we sponsor \U0001f600. h1b transfers", "cap exempt. cap-exempt", "", None)
PAY = ("Base pay $120,000 - $150,000 per year. or USD 60k-80k", "EUR $ 60-70", "none", "", None, "12", "é\U0001f600 USD $ 50 to 60 hourly", "a GBP £ 1,000.00 - GBP £ 2,000.00", "2020 x \U0001f600 31/hr to $45/hr")


@pytest.mark.parametrize("texts, pattern, options", [
    (YEARS, Y.PATTERN, {"apart": "\n", "needs": Y.NEEDS}), (VISA, S.PATTERN, {"apart": ".", "needs": S.NEEDS}),
    (PAY, P.RANGE, {}),
])
def test_the_same_spans_in_parts(spark, texts, pattern, options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    if pattern == P.RANGE:
        options = {"skip": P.lead("t")}
    whole = {r.i: r.s for r in E.with_spans(df, "t", pattern, "s").collect()}
    assert {r.i: r.s for r in E.with_spans(df, "t", pattern, "s", **options).collect()} == whole
    assert sum(len(s or ()) for s in whole.values()) >= 4
    for i, t in enumerate(texts):
        for s in whole[i] or ():
            assert t[s.at : s.at + len(s.phrase)] == s.phrase and (t[: s.at][-E.AROUND :], t[s.at + len(s.phrase) :][: E.AROUND]) == (s.left, s.right)


def test_spellings_by_their_cues(spark):
    texts = ["We can’t, U.S. and u. s of H-1B, H1-B", "cannot won't don't at all", "at  all\n U.S", "plain", "", None, "u.s.can't"]
    plain = F.translate(F.coalesce("t", F.lit("")), E.UPPER, E.LOWER)
    for pattern, to in S.SPELLINGS:
        plain = F.regexp_replace(plain, pattern, to)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.x for r in S.with_normalised(df, F.col("t"), "x", "i").collect()} == {r.i: r.x for r in df.select("i", plain.alias("x")).collect()}


@pytest.mark.parametrize("name, searched", [("classify_years", "year"), ("metadata_ladder", "year"), ("classify_sponsorship", "sponsor"), ("salary_ranges", "^[^0-9]*")])
def test_texts_are_searched_where_matches_can_be(spark, name, searched):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    found = [line for line in plan.splitlines() if "regexp_extract_all(" in line and "begin" in line]
    assert found and any(searched in line for line in plan.splitlines())
