"""Workplaces, places and decisions by stated readings."""

from pyspark.sql import functions as F

from siftline.functions import places as P

AT = P.Lexicon(metros=["seattle", "new york"], us=["us", "usa", "united states"], offices=["austin", "texas", "chicago"], foreign=["london", "uk", "canada", "germany", "sao paulo", "zurich"])
READINGS = [
    # location, title, text, hint, trusted -> workplace, confidence, category, decision, reason
    ("Seattle, WA", "", "We meet.", None, True, "unknown", "medium", "metro", "match", None),
    ("Seattle, WA", "", "", None, True, "onsite", "medium", "metro", "match", None),
    ("São Paulo", "", "", None, True, "onsite", "medium", "foreign", "no_match", None),
    ("Zürich or Austin", "", "x", None, True, "unknown", "medium", "foreign", "no_match", None),
    ("US or Canada", "", "This is a remote position.", None, True, "remote", "high", "us_remote", "match", None),
    ("United States / London", "", "x", None, True, "unknown", "medium", "unknown", "review", "mixed_us_foreign_scope"),
    ("Remote", "Engineer, UK", "x", None, True, "remote", "high", "foreign", "no_match", None),
    ("Remote", "", "We hire people.", None, True, "remote", "high", "unknown", "review", "remote_without_us_scope"),
    ("Remote", "", "We hire in the United States.", None, True, "remote", "high", "us_remote", "match", None),
    ("Anywhere", "", "x", None, True, "remote", "high", "us_remote", "match", None),
    ("Remote - US", "", "You must reside in Texas.", None, True, "remote", "high", "other_us", "no_match", None),
    ("Remote - US", "", "You must be based in the Seattle area.", None, True, "remote", "high", "metro", "match", None),
    ("Remote - US", "", "You must live in Germany.", None, True, "remote", "high", "foreign", "no_match", None),
    ("Remote - US", "", "You must live near our dog park", None, True, "remote", "high", "unknown", "review", "residency_restriction_unparsed"),
    ("Remote - US", "", "You must not be based in Texas.", None, True, "remote", "high", "us_remote", "match", None),
    ("Remote - US", "", "Not open to Seattle or New York.", None, True, "remote", "high", "us_remote", "no_match", None),
    ("Remote - US", "", "Not open to Seattle.", None, True, "remote", "high", "us_remote", "match", None),
    ("Austin", "", "Hybrid role.", None, True, "hybrid", "high", "other_us", "no_match", None),
    ("US", "", "Hybrid role.", None, True, "hybrid", "high", "unknown", "review", "us_scope_without_remote_workplace"),
    ("US", "", "x", None, True, "unknown", "medium", "us_remote", "match", None),
    ("Seattle", "", "Fully remote. This is an on-site role.", None, True, "unknown", "low", "metro", "review", "remote_onsite_conflict"),
    ("Seattle", "", "Fully remote, hybrid.", None, True, "unknown", "low", "metro", "review", "remote_hybrid_conflict"),
    ("Seattle", "", "Remote or hybrid: a fully remote team.", None, True, "remote", "high", "metro", "match", None),
    ("Hybrid - Seattle", "", "Fully remote.", None, True, "unknown", "low", "metro", "review", "location_hybrid_jd_remote_conflict"),
    ("Hybrid", "", "Fully remote in the US.", None, True, "remote", "high", "us_remote", "match", None),
    ("Hybrid", "", "", None, True, "hybrid", "high", "unknown", "review", "workplace_tag_without_geography"),
    ("Seattle", "", "This is not a fully remote job.", None, True, "unknown", "medium", "metro", "match", None),
    ("Seattle", "", "No on-site role here.", None, True, "unknown", "medium", "metro", "match", None),
    ("Seattle", "", "x", "remote", True, "remote", "medium", "metro", "match", None),
    ("Seattle", "", "x", "hybrid", False, "hybrid", "low", "metro", "review", "uncorroborated_ats_workplace_hint"),
    ("", "", "", None, True, "unknown", "unknown", "unknown", "review", "unclassified_location"),
    (None, None, None, None, True, "unknown", "unknown", "unknown", "review", "unclassified_location"),
]


def test_readings(spark):
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(READINGS)], "i int, l string, t string, d string, h string, trusted boolean").coalesce(1)
    at = df.select("i", "trusted", F.coalesce("h", F.lit("")).alias("hint"), *[P.plain(F.col(c)).alias(n) for c, n in zip("ltd", ("location", "title", "text"))])
    at = P.with_decision(P.with_workplace(at), AT)
    got = {r.i: (r.workplace, r.confidence, r.category, r.decision, r.reason) for r in at.collect()}
    assert [(READINGS[i], got[i]) for i in got if got[i] != READINGS[i][5:]] == []
