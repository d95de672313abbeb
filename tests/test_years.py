"""Statements of years and the bar that each one sets."""

import pytest

from siftline.functions import years

READINGS = [
    # text, min, max, confidence, kind, specialty, reason
    ("You must have 5+ years of experience.", 5, None, "high", "required", None, None),
    ("Minimum of 3 years of professional experience.", 3, None, "high", "required", None, None),
    ("3-5 years of relevant experience", 3, 5, "high", "required", None, None),
    ("Between three (3) to five years required.", 3, 5, "high", "required", None, None),
    ("5 years of experience with Kubernetes.", 5, None, "medium", "contextual", None, None),
    ("4+ years of Python experience", 4, None, "medium", "contextual", None, None),
    ("10+ years of experience preferred.", None, None, "unknown", "not_stated", None, None),
    ("Our founders have 20 years of experience.", None, None, "unknown", "not_stated", None, None),
    ("Our team is looking for someone with 6 years of experience.", 6, None, "medium", "required", None, None),
    ("The team has 50 years of combined experience.", None, None, "unknown", "not_stated", None, None),
    ("8-10 years of product management experience, including at least 2 years owning models", 8, 10, "high", "required", 2, None),
    ("At least 2 years of work experience. Must have 7 or more years overall.", 7, None, "high", "required", None, None),
    ("Senior Engineer, 6+ years\nWe build things.", 6, None, "high", "required", None, None),
    ("Green card after two years of service.", None, None, "unknown", "not_stated", None, None),
    ("Experience: seven years.", None, None, "unknown", "not_stated", None, "yoe_stated_but_unparsed"),
    ("99 years of experience required", None, None, "unknown", "not_stated", None, None),
    ("5-3 years of experience required", None, None, "unknown", "not_stated", None, None),
    ("2.5 years of industry experience", 2.5, None, "high", "required", None, None),
    ("", None, None, "unknown", "not_stated", None, None),
    (None, None, None, "unknown", "not_stated", None, None),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(READINGS)], "id int, text string").coalesce(1)
    return {r.id: r for r in years.with_years(rows, "text", "id", cap=6).collect()}


@pytest.mark.parametrize("i", range(len(READINGS)))
def test_reading(read, i):
    r = read[i]
    assert (r.min, r.max, r.confidence, r.kind, r.specialty, r.reason) == READINGS[i][1:], READINGS[i][0]
    assert r.decision == ("review" if r.confidence != "high" else "no_match" if r.min > 6 else "match")
