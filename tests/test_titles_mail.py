"""Titles, levels, messages and progress by stated readings."""

from pyspark.sql import functions as F

from siftline.functions import mail, titles

SEARCH = titles.Search(["software engineer", "backend", "infrastructure", "site reliability", "account executive"], ["manager", "director", "new grad", "staff", "intern"], ["member of technical staff"])
TITLES = [
    ("Senior Software Engineer", "match", "senior", "included.software engineer"),
    ("Software Engineers II", "match", "unknown", "included.software engineer"),
    ("Engineering Manager", "no_match", "line_manager", "excluded.manager"),
    ("Software Engineer, Ads Manager", "review", "unknown", "manager_product_suffix_ambiguous"),
    ("Software Engineer - Engineering Manager", "no_match", "unknown", "excluded.manager"),
    ("Member of Technical Staff, Backend Engineer", "match", "unknown", "included.backend"),
    ("Staff Software Engineer", "no_match", "staff", "excluded.staff"),
    ("New College Grad Software Engineer", "no_match", "unknown", "excluded.new grad"),
    ("Strategic Finance, Infrastructure", "no_match", "unknown", "nontechnical_occupation.finance"),
    ("Account Executive", "match", "unknown", "included.account executive"),
    ("Infrastructure Planner", "review", "unknown", "broad_domain_without_role"),
    ("Software Engineer Lead", "review", "unknown", "leadership_ambiguous"),
    ("Gardener", "review", "unknown", "not_included"),
    ("Internal Tools Software Engineer", "match", "unknown", "included.software engineer"),
    ("Vice President of Sales", "no_match", "executive", "nontechnical_occupation.sales"),
    ("Senior Product Manager", "no_match", "senior", "excluded.manager"),
    ("Senior Group Engineering Managers", "no_match", "senior_manager", "excluded.manager"),
    (None, "review", "unknown", "not_included"),
]


def test_titles(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TITLES)], "i int, t string").coalesce(1)
    got = {r.i: r for r in df.select("i", *[c.alias(n) for n, c in titles.assessed(F.col("t"), SEARCH).items()]).collect()}
    assert [(t, got[i]) for i, t in enumerate(TITLES) if tuple(got[i])[1:] != t[1:]] == []


def test_levels_of_bodies_and_years(spark):
    rows = [("This role is a senior-level one.", "senior"), ("This position is senior staff-level", "senior_staff"), ("a Principal Software Engineer will", "principal"), ("a senior engineer", "unknown"), ("We hire at L6.", "staff"), ("entry-level position", "entry"), (None, "unknown")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").coalesce(1)
    assert [r.l for r in df.orderBy("i").select(titles.level_of_body(F.col("t")).alias("l")).collect()] == [r[1] for r in rows]
    years = spark.createDataFrame([(0, None), (1, 1.0), (2, 4.9), (3, 8.0), (4, 12.0), (5, 13.0)], "i int, y double").coalesce(1)
    assert [r.l for r in years.orderBy("i").select(titles.level_of_years(F.col("y")).alias("l")).collect()] == ["unknown", "entry", "mid", "senior", "staff", "senior_staff"]


MESSAGES = [
    # text, inbound, categories, steps, time
    ("Thank you for applying!", True, "receipt", "", None),
    ("We regret to inform you that the role has been filled.", True, "rejection", "", None),
    ("Please book a time for your phone screen", True, "follow_up_needed,interview_invite,scheduling", "booking_requested", None),
    ("Your interview is confirmed for 2026-02-03 3:30 PM ET", True, "interview_invite,scheduling", "schedule_confirmed", "2026-02-03T15:30:00"),
    ("Confirmed: the new time is 2026-02-04 09:00 UTC", True, "scheduling", "replacement_confirmed", "2026-02-04T09:00:00"),
    ("Confirmed for 2026-02-04 25:00 UTC", True, "scheduling", "schedule_confirmed", None),
    ("I am available on Monday", False, "scheduling", "availability_submitted", None),
    ("The interview has been cancelled", True, "interview_invite,scheduling", "cancellation", None),
    ("Thank you for interviewing with us", True, "interview_invite", "awaiting_result", None),
    ("We are an equal opportunity employer", True, "unknown", "", None),
    ("An opportunity for you", True, "inbound_recruiter_outreach", "", None),
    ("Reaching out about my application", False, "outbound_cold_outreach", "", None),
    ("We are pleased to offer you the role; next steps: background check", True, "background_check_onboarding,neutral_status_update,offer", "", None),
    ("disassessmentx", True, "unknown", "", None),
    ("", True, "unknown", "", None),
]


def test_messages(spark):
    df = spark.createDataFrame([(i, m[0].lower(), m[1]) for i, m in enumerate(MESSAGES)], "i int, t string, inbound boolean").coalesce(1)
    at = df.withColumn("s", mail.steps(F.col("t"), F.col("inbound"))).withColumn("c", mail.categories(F.col("t"), F.col("inbound"), F.col("s")))
    got = {r.i: (",".join(r.c), ",".join(r.s), r.time) for r in at.withColumn("time", mail.stated_time(F.col("t"))).collect()}
    assert [(m, got[i]) for i, m in enumerate(MESSAGES) if got[i] != m[2:]] == []


def test_proposals_need_an_exact_link(spark):
    text = F.lit("your interview is confirmed for 2026-02-03 15:30 utc")
    for exact in (True, False):
        steps = mail.steps(text, F.lit(True))
        category = mail.categories(text, F.lit(True), steps)
        p = mail.proposals(text, category, steps, mail.stated_time(text), mail.phase_of(text, category, F.lit(None).cast("string")), F.lit(exact), F.lit(True), F.lit(True))
        got = [tuple(x) for x in spark.range(1).select(p.alias("p")).first().p]
        assert got == [("status_transition", "in_progress", exact), ("progress_calendar", "other/scheduled/confirm_occurrence", exact)]


def test_progress(spark):
    rows = [("drafted", "offer", "scheduled", "x"), ("applied", None, None, None), ("rejected", "offer", "scheduled", "x"), ("ignored", "nonsense", "scheduled", ""), ("in_progress", "assessment", "scheduled", None), ("in_progress", "assessment", "closed", ""), ("in_progress", None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, p string, t string, l string").coalesce(1)
    got = [tuple(r.x) for r in df.orderBy("i").select(mail.progress_after(*map(F.col, "sptl")).alias("x")).collect()]
    assert got == [
        ("application_prep", "action_required", None), ("application_review", "waiting_employer", None), ("offer", "closed", "x"), ("other", "closed", "ignored"), ("assessment", "scheduled", None), ("assessment", "unknown", None), ("other", "unknown", "in_progress"),
    ]
