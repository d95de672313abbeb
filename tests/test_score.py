"""Scores by parts, on postings whose parts are known."""

from pyspark.sql import functions as F

from siftline.functions import score as X

PROFILE = X.Profile(["kubernetes", "rust"], ["sql"], ["php"], ["ai company"], (5.0, 6.0), 4.0, staff=True)
BASE = {"title": "", "text": "", "level_low": None, "level_high": None, "years": None, "sponsors": False, "transfers": False, "ai_employer": False, "h1b": None, "perm": None, "metro": False, "remote_us": False, "age_days": None}
CASES = [
    ({}, 0.0, ""),
    ({"title": "Kubernetes Engineer", "text": "Kubernetes and Rust with SQL, PHP."}, 8 + 4 + 1.5 - 4, ""),
    ({"text": "This role does not involve PHP, but Rust."}, 4.0, "php"),
    ({"text": "We're not. We are not looking for Rust. SQL"}, 1.5, "rust"),
    ({"text": "Not interested in Rust. We use Rust."}, 4.0, ""),
    ({"title": "Senior Staff Engineer"}, 4.0, ""),
    ({"title": "Sr. Engineer"}, 3.0, ""),
    ({"level_low": 3.0, "level_high": 4.0}, -6.0, ""),
    ({"level_low": 8.0}, -12.0, ""),
    ({"level_low": 4.0, "level_high": 5.0, "years": 7.0}, -3.0, ""),
    ({"sponsors": True, "transfers": True, "ai_employer": True, "text": "An AI company"}, 15 + 5 + 6 + 2.0, ""),
    ({"h1b": 100, "perm": 30}, 8.0, ""),
    ({"h1b": 10**6}, 10.0, ""),
    ({"metro": True, "remote_us": True, "age_days": 1}, 11.0, ""),
    ({"age_days": 2}, 0.0, ""),
    ({"text": "You will not be doing " + "x " * 90 + "rust"}, 4.0, ""),
    ({"text": None, "title": None}, 0.0, ""),
]


def test_scores(spark):
    schema = "i int, title string, text string, level_low double, level_high double, years double, sponsors boolean, transfers boolean, ai_employer boolean, h1b long, perm long, metro boolean, remote_us boolean, age_days int"
    rows = [(i, *{**BASE, **c}.values()) for i, (c, _, _) in enumerate(CASES)]
    got = {r.i: r for r in X.scored(spark.createDataFrame(rows, schema).coalesce(1), PROFILE, "i").collect()}
    assert [(c, got[i].score, got[i].negated) for i, (c, s, n) in enumerate(CASES) if (got[i].score, got[i].negated) != (s, n)] == []
    assert all(abs(sum(v for k, v in r.asDict().items() if k not in ("i", "score", "negated")) - r.score) < 1e-9 for r in got.values())
