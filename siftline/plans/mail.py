"""Messages linked to applications: events are read as mail of their user's company, orders as its jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import mail as W
from siftline.operators import messages as M
from siftline.plans.queries import query, table

VENDORS = ("greenhouse.io", "lever.co")

JOBS = """SELECT 'co' || o_custkey AS company_key, 'app-' || o_custkey || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '-' || (o_orderkey % 2) END AS slug, o_orderkey AS job_index, o_orderpriority AS role,
  CASE WHEN o_orderkey % 7 = 0 THEN 'applied' ELSE 'rejected' END AS status, 'https://jobs.example/' || o_orderkey AS url, 'ex-' || o_orderkey AS store_key, 'REQ-7' || o_orderkey AS requisition FROM orders"""
MAIL = """SELECT event_id AS message_key, CASE WHEN event_id % 11 <> 0 THEN 't-' || user_id || '-' || (event_id % 4) END AS thread, ts, CASE WHEN event_type = 'signup' THEN 'outbound' ELSE 'inbound' END AS direction, user_id,
  CASE event_id % 13 WHEN 0 THEN 'boards.greenhouse.io' WHEN 1 THEN 'both.example' WHEN 2 THEN 'other.example' WHEN 3 THEN NULL ELSE 'mail.c' || user_id || '.example' END AS domain,
  CASE event_id % 17 WHEN 0 THEN 'see https://jobs.example/' || low || '?src=mail.' WHEN 1 THEN 'Requisition ID: 7' || high WHEN 2 THEN 'https://jobs.example/' || low || ' or https://jobs.example/' || high WHEN 3 THEN 'https://board.example/x/ex-' || high || '/apply' ELSE event_type END AS text
  FROM events LEFT JOIN (SELECT o_custkey AS user_id, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY o_custkey) USING (user_id)"""
DOMAINS = """SELECT DISTINCT 'c' || o_custkey || '.example' AS domain, 'co' || o_custkey AS company_key FROM orders UNION ALL SELECT 'both.example', 'co0' UNION ALL SELECT 'both.example', 'co1'"""
CONFIRMED = """SELECT event_id AS message_key, 'app-' || user_id || CASE WHEN user_id % 3 = 0 THEN '' ELSE '-0' END AS slug, CASE WHEN event_id % 2 = 0 THEN event_id END AS job_index, CASE WHEN event_id % 2 = 1 THEN '1-urgent' END AS role FROM events WHERE event_id % 29 = 0"""

LADDER = f"""
WITH jobs AS ({JOBS}), mail AS ({MAIL}), domains AS ({DOMAINS}), said AS ({CONFIRMED}),
apps AS (SELECT slug, min(company_key) AS company_key, bool_or(status = 'applied') AS active FROM jobs GROUP BY slug),
known AS (SELECT company_key, count(*) FILTER (active) AS n_active, list(slug ORDER BY slug) FILTER (active) AS open_apps FROM apps GROUP BY company_key),
human AS (SELECT message_key, s.slug, a.company_key, coalesce((SELECT j.job_index FROM jobs j WHERE j.slug = s.slug AND j.job_index = s.job_index),
  (SELECT CASE WHEN count(*) = 1 THEN min(j.job_index) END FROM jobs j WHERE j.slug = s.slug AND lower(j.role) = s.role)) AS job_index FROM said s JOIN apps a USING (slug)),
owners AS (SELECT domain, CASE WHEN domain LIKE 'mail.c%' THEN substr(domain, 6) ELSE domain END AS base FROM (SELECT DISTINCT domain FROM mail WHERE domain IS NOT NULL)),
owner AS (SELECT o.domain, min(d.company_key) AS company_key FROM owners o JOIN domains d ON d.domain = o.base GROUP BY o.domain HAVING count(DISTINCT d.company_key) = 1),
m AS (SELECT mail.*, owner.company_key AS co, coalesce(mail.domain LIKE '%greenhouse.io', false) AS veto FROM mail LEFT JOIN owner USING (domain)),
hits AS (SELECT DISTINCT m.message_key, j.slug, j.job_index FROM m JOIN jobs j ON j.company_key = m.co WHERE NOT veto AND
  (regexp_matches(text, 'https://jobs.example/' || j.job_index || '(\\?|$| )') OR contains(text, '/ex-' || j.job_index || '/') OR text = 'Requisition ID: 7' || j.job_index)),
hit AS (SELECT message_key, count(*) AS n, min(slug) AS slug, min(job_index) AS job_index, list(DISTINCT slug ORDER BY slug) AS slugs FROM hits GROUP BY message_key),
own AS (SELECT m.message_key, m.thread, m.ts, m.co, known.n_active, known.open_apps, h.message_key IS NOT NULL AS human, CASE WHEN h.message_key IS NOT NULL THEN 'human_confirmed' WHEN veto THEN 'shared_ats_vendor' WHEN n = 1 THEN 'direct_rule' WHEN n > 1 THEN 'structured_token_ambiguous' END AS own,
  CASE WHEN h.message_key IS NOT NULL THEN h.company_key ELSE co END AS l_co, CASE WHEN h.message_key IS NOT NULL THEN h.slug WHEN NOT veto AND n = 1 THEN hit.slug END AS l_slug, CASE WHEN h.message_key IS NOT NULL THEN h.job_index WHEN NOT veto AND n = 1 THEN hit.job_index END AS l_job, hit.slugs
  FROM m LEFT JOIN human h USING (message_key) LEFT JOIN hit USING (message_key) LEFT JOIN known ON known.company_key = m.co),
sure AS (SELECT thread, ts, message_key, l_co, l_slug, l_job FROM own WHERE thread IS NOT NULL AND l_slug IS NOT NULL),
tried AS (SELECT DISTINCT ON (thread, co) thread, ts, message_key, co AS l_co, open_apps[1] AS l_slug, NULL::BIGINT AS l_job FROM own WHERE thread IS NOT NULL AND own IS NULL AND n_active = 1 ORDER BY thread, co, ts, message_key),
links AS (SELECT thread, l_co, l_slug, l_job, min((ts, message_key)) AS since FROM (SELECT * FROM sure UNION ALL SELECT * FROM tried t WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.thread = t.thread AND s.l_co = t.l_co AND (s.ts, s.message_key) < (t.ts, t.message_key))) GROUP BY ALL),
seen AS (SELECT o.message_key, count(*) AS n, arg_min((l.l_co, l.l_slug, l.l_job), l.since) AS one, list(l.l_slug ORDER BY l.since)[1:2] AS two FROM own o JOIN links l ON l.thread = o.thread AND l.since < (o.ts, o.message_key) AND (o.co IS NULL OR l.l_co = o.co) GROUP BY o.message_key),
d AS (SELECT o.*, s.n AS links, s.one, s.two, coalesce(own, CASE WHEN s.n > 1 THEN 'thread_ambiguous' WHEN s.n = 1 THEN 'thread_inheritance' WHEN n_active > 0 THEN 'temporal_correlation' ELSE 'unresolved' END) AS derivation FROM own o LEFT JOIN seen s USING (message_key)),
e AS (SELECT *, derivation = 'thread_inheritance' AS inherits, derivation = 'temporal_correlation' AND n_active = 1 AS sole FROM d)
SELECT e.message_key, CASE WHEN human THEN l_co WHEN derivation = 'shared_ats_vendor' THEN NULL WHEN n_active IS NOT NULL THEN co WHEN inherits THEN one[1] END AS company_key,
  coalesce(l_slug, CASE WHEN inherits THEN one[2] WHEN sole THEN open_apps[1] END) AS slug, coalesce(l_job, CASE WHEN inherits THEN one[3] END) AS job_index, (SELECT o_orderpriority FROM orders WHERE o_orderkey = coalesce(l_job, CASE WHEN inherits THEN one[3] END)) AS role, derivation,
  CASE WHEN derivation IN ('human_confirmed', 'direct_rule') THEN 'exact' WHEN inherits OR sole THEN 'strong' WHEN derivation IN ('shared_ats_vendor', 'unresolved') THEN 'none' ELSE 'weak' END AS confidence,
  array_to_string(CASE WHEN derivation = 'structured_token_ambiguous' THEN slugs WHEN derivation = 'thread_ambiguous' THEN list_sort(list_distinct(two)) WHEN derivation = 'temporal_correlation' AND NOT sole THEN open_apps ELSE [] END, ',') AS candidates
FROM e"""


@query(LADDER)
def link_ladder(spark, d):
    """Each message's application, role and the rung that found it."""
    orders, events = table(spark, d, "orders"), table(spark, d, "events")
    text = lambda *parts: F.concat(*[F.col(p[1:]).cast("string") if p.startswith("=") else F.lit(p) for p in parts])
    slug = lambda who, app: F.when(F.col(who) % 3 == 0, text("app-", f"={who}")).otherwise(F.concat(text("app-", f"={who}", "-"), app))
    status = F.when(F.col("o_orderkey") % 7 == 0, "applied").otherwise("rejected")
    jobs = orders.select(
        text("co", "=o_custkey").alias("company_key"), slug("o_custkey", (F.col("o_orderkey") % 2).cast("string")).alias("slug"), F.col("o_orderkey").alias("job_index"), F.col("o_orderpriority").alias("role"), status.alias("status"),
        text("https://jobs.example/", "=o_orderkey").alias("url"), text("ex-", "=o_orderkey").alias("store_key"), text("REQ-7", "=o_orderkey").alias("requisition"),
    )
    ends = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    by = lambda n, *values: F.get(F.array(*values), (F.col("event_id") % n).cast("int"))
    domain = F.when(F.col("event_id") % 13 > 3, text("mail.c", "=user_id", ".example")).otherwise(by(13, *map(F.lit, ("boards.greenhouse.io", "both.example", "other.example", None)), *[F.lit("")] * 9))
    said = F.when(F.col("event_id") % 17 > 3, F.col("event_type")).otherwise(by(
        17, text("see https://jobs.example/", "=low", "?src=mail."), text("Requisition ID: 7", "=high"), text("https://jobs.example/", "=low", " or https://jobs.example/", "=high"),
        text("https://board.example/x/ex-", "=high", "/apply"), *[F.lit("")] * 13,
    ))
    mail = events.join(ends, "user_id", "left").select(
        F.col("event_id").alias("message_key"), F.when(F.col("event_id") % 11 != 0, F.concat(text("t-", "=user_id", "-"), (F.col("event_id") % 4).cast("string"))).alias("thread"), F.col("ts").alias("at"),
        F.when(F.col("event_type") == "signup", "outbound").otherwise("inbound").alias("direction"), domain.alias("sender_domain"), F.array(domain).alias("recipient_domains"), said.alias("text"),
    )
    both = spark.createDataFrame([("both.example", "co0"), ("both.example", "co1")], "domain string, company_key string")
    domains = orders.select(text("c", "=o_custkey", ".example").alias("domain"), text("co", "=o_custkey").alias("company_key")).distinct().union(both)
    even = F.col("event_id") % 2 == 0
    confirmed = events.where("event_id % 29 = 0").select(F.col("event_id").alias("message_key"), slug("user_id", F.lit("0")).alias("slug"), F.when(even, F.col("event_id")).alias("job_index"), F.when(~even, F.lit("1-urgent")).alias("role"))
    return M.linked(mail, jobs, domains, confirmed, VENDORS).withColumn("candidates", F.array_join("candidates", ","))


# ---- what messages say, and what they propose

SAID = (
    "Thank you for applying!", "We regret to inform you that the role has been filled.", "Please book a time for your phone screen.", "Your interview is confirmed for 2026-02-03 3:30 PM ET.", "Confirmed: the new time is 2026-02-04 09:00 UTC.",
    "Confirmed for 2026-02-04 25:00 UTC.", "I am available on Monday.", "The interview has been cancelled.", "Thank you for interviewing with us.", "We are an equal opportunity employer.", "An opportunity for you.", "Reaching out about my application.",
    "We are pleased to offer you the role; next steps: background check.", "You must reschedule: please respond.", "Your order has shipped, unsubscribe here.", "All applications: decided not to proceed.", "New jobs matching your search.", "A take-home assessment is next.",
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _says(phrases) -> str:
    return f"regexp_matches(t, {_quoted(W.phrase_pattern(phrases))})"


def _mail_sql() -> str:
    names = lambda found: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in sorted(found.items())) + "], lambda x: x IS NOT NULL)"
    timed, replaced = f"regexp_matches(t, {_quoted(W.STATED_TIME)})", f"({_says(W.REPLACED)} AND {_says(W.CONFIRMED)})"
    steps = names({
        "availability_submitted": f"NOT inbound AND {_says(W.SUBMITTED)}", "awaiting_result": _says(W.DONE), "booking_requested": f"inbound AND {_says(W.BOOKING)}", "cancellation": _says(W.CANCELLED),
        "replacement_confirmed": f"{replaced} AND {timed}", "reschedule_requested": _says(W.RESCHEDULE), "schedule_confirmed": f"{_says(W.CONFIRMED)} AND {timed} AND NOT {replaced}",
    })
    plain = f"regexp_replace(t, {_quoted(W.EEO)}, ' ', 'g')"
    found = {n: _says(p) for n, p in W.CATEGORIES.items()} | {
        "scheduling": f"{_says(W.SCHEDULING)} OR len(list_filter(steps, lambda x: x <> 'awaiting_result')) > 0", "follow_up_needed": f"{_says(W.FOLLOW_UP)} OR list_contains(steps, 'booking_requested')",
        "inbound_recruiter_outreach": f"inbound AND ({_says(W.OUTREACH_IN)} OR regexp_matches({plain}, {_quoted(W.phrase_pattern(('opportunity',)))}))", "outbound_cold_outreach": f"NOT inbound AND {_says(W.OUTREACH_OUT)}",
    }
    part = lambda i: f"regexp_extract(t, {_quoted(W.STATED_TIME)}, {i})"
    return f"""s AS (SELECT conv_id, turn, role = 'user' AS inbound, lower(coalesce(text, '') || ' ' || [{", ".join(map(_quoted, SAID))}][(conv_id * 7 + turn) % {len(SAID)} + 1]) AS t FROM conversations),
    st AS (SELECT *, {steps} AS steps, try_cast(nullif(string_split({part(2)}, ':')[1], '') AS INT) AS h, {part(3)} AS half, {part(1)} AS day, string_split({part(2)}, ':')[2] AS minute FROM s),
    ca AS (SELECT *, {names(found)} AS found, CASE WHEN half <> '' AND h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN half = 'pm' THEN 12 ELSE 0 END WHEN half = '' AND h <= 23 THEN h END AS clock FROM st),
    m AS (SELECT * EXCLUDE (found), CASE WHEN len(found) > 0 THEN found ELSE ['unknown'] END AS categories, CASE WHEN try_cast(day || ' ' || lpad(clock::VARCHAR, 2, '0') || ':' || minute || ':00' AS TIMESTAMP) IS NOT NULL THEN day || 'T' || lpad(clock::VARCHAR, 2, '0') || ':' || minute || ':00' END AS stated FROM ca)"""


def _messages(spark, d):
    at = table(spark, d, "conversations")
    said = F.get(F.array(*map(F.lit, SAID)), ((F.col("conv_id") * 7 + F.col("turn")) % len(SAID)).cast("int"))
    at = at.select("conv_id", "turn", (F.col("role") == "user").alias("inbound"), F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), said)).alias("t"))
    at = at.withColumn("steps", W.steps(F.col("t"), F.col("inbound")))
    return at.withColumn("categories", W.categories(F.col("t"), F.col("inbound"), F.col("steps"))).withColumn("stated", W.stated_time(F.col("t")))


@query(f"WITH {_mail_sql()} SELECT conv_id, turn, array_to_string(categories, ',') AS categories, array_to_string(steps, ',') AS steps, stated FROM m")
def mail_categories(spark, d):
    """Categories, scheduling steps and stated time of each message."""
    return _messages(spark, d).select("conv_id", "turn", F.array_join("categories", ",").alias("categories"), F.array_join("steps", ",").alias("steps"), "stated")


NOW = ("application_review", "assessment", "unknown", None, "hiring_manager")
_EXACT, _LINKED = "conv_id % 2 = 0", "conv_id % 3 > 0"


@query(f"""WITH {_mail_sql()},
p AS (SELECT *, [{", ".join("NULL" if x is None else f"'{x}'" for x in NOW)}][conv_id % {len(NOW)} + 1] AS now, {_says(("all roles", "all applications", "entire application"))} AS everything FROM m),
f AS (SELECT *, CASE WHEN now IS NOT NULL AND now NOT IN ('application_prep', 'application_review', 'unknown') THEN now WHEN list_contains(categories, 'assessment') THEN 'assessment' WHEN {_says(("recruiter", "talent", "phone screen"))} THEN 'recruiter_screen'
  WHEN {_says(("hiring manager",))} THEN 'hiring_manager' WHEN {_says(("technical", "coding", "system design"))} THEN 'technical_interview' WHEN {_says(("onsite", "on-site", "interview loop"))} THEN 'interview_loop' WHEN list_contains(categories, 'offer') THEN 'offer' ELSE 'other' END AS phase FROM p),
x AS (SELECT conv_id, turn, 'status_transition' AS kind, target, {_LINKED} AND CASE WHEN target = 'in_progress' OR {_EXACT} THEN {_EXACT} ELSE everything END AS ready FROM f, (VALUES ('receipt', 'applied'), ('rejection', 'rejected'), ('interview_invite', 'in_progress')) v(c, target) WHERE list_contains(categories, c)
  UNION ALL SELECT conv_id, turn, 'progress_calendar', phase || '/' || state || '/' || act, {_EXACT} AND (step NOT IN ('schedule_confirmed', 'replacement_confirmed') OR stated IS NOT NULL) FROM f, (VALUES {", ".join(f"('{n}', '{s}', '{a}')" for n, (s, a) in W.STEPS.items())}) v(step, state, act) WHERE list_contains(steps, step)
  UNION ALL SELECT conv_id, turn, 'progress', 'offer/waiting_employer', {_EXACT} AND {_LINKED} FROM f WHERE list_contains(categories, 'offer'))
SELECT * FROM x""")
def mail_proposals(spark, d):
    """What each message proposes, and whether its link would allow that."""
    now = F.get(F.array(*[F.lit(x).cast("string") for x in NOW]), (F.col("conv_id") % len(NOW)).cast("int"))
    phase = W.phase_of(F.col("t"), F.col("categories"), now)
    at = _messages(spark, d).withColumn("phase", phase)
    made = W.proposals(F.col("t"), F.col("categories"), F.col("steps"), F.col("stated"), F.col("phase"), F.expr(_EXACT), F.expr(_LINKED), F.lit(True))
    return at.select("conv_id", "turn", F.explode(made).alias("p")).select("conv_id", "turn", "p.*")


STATUSES = ("drafted", "applied", "rejected", "ignored", "in_progress")


@query(f"""WITH o AS (SELECT o_orderkey, ['{"', '".join(STATUSES)}'][o_orderkey % 5 + 1] AS status, ['{"', '".join((*W.PHASES, "nonsense"))}'][o_custkey % {len(W.PHASES) + 1} + 1] AS phase, ['{"', '".join((*W.OPEN_STATES, "closed"))}'][o_orderkey // 5 % {len(W.OPEN_STATES) + 1} + 1] AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'round' WHEN o_orderkey % 3 = 1 THEN '' END AS label FROM orders),
k AS (SELECT *, phase <> 'nonsense' AS known FROM o)
SELECT o_orderkey, CASE status WHEN 'drafted' THEN 'application_prep' WHEN 'applied' THEN 'application_review' ELSE CASE WHEN known THEN phase ELSE 'other' END END AS phase,
  CASE status WHEN 'drafted' THEN 'action_required' WHEN 'applied' THEN 'waiting_employer' WHEN 'in_progress' THEN CASE WHEN state <> 'closed' THEN state ELSE 'unknown' END ELSE 'closed' END AS state,
  CASE WHEN status NOT IN ('drafted', 'applied') THEN nullif(CASE WHEN known THEN label ELSE coalesce(nullif(label, ''), status) END, '') END AS label FROM k""")
def progress_states(spark, d):
    """The progress that a new status leaves, given the one before."""
    key = F.col("o_orderkey")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    label = F.when(key % 3 == 0, "round").when(key % 3 == 1, "")
    after = W.progress_after(pick(STATUSES, key), pick((*W.PHASES, "nonsense"), F.col("o_custkey")), pick((*W.OPEN_STATES, "closed"), F.floor(key / 5)), label)
    return table(spark, d, "orders").select("o_orderkey", after.alias("p")).select("o_orderkey", "p.*")
