"""Postings read for what they offer and ask: evidence of sponsorship and bands of pay, over whole documents with planted statements.

The given texts say nothing about visas or pay, so each document is read with statements set into its end, chosen by its
id; two lists give some thousand combinations. The SQL unnests spans to rows, while the columns here keep them in arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import evidence as E
from siftline.functions import pay as P
from siftline.functions import places as L
from siftline.functions import score as X
from siftline.functions import sponsorship as S
from siftline.functions import titles as N
from siftline.functions import years as Y
from siftline.plans.queries import query, spread, table

# ---- the same conditions in SQL


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def few(gap: str, most: int) -> str:
    return like(gap, rf"^[^a-z0-9]*(?:{E.TOKEN}(?:[^a-z0-9]+|$)){{0,{most}}}$")


def after_last(x: str, pattern: str) -> str:
    return sub(x, rf"^.*(?:{pattern})")


def before_first(x: str, pattern: str) -> str:
    return sub(x, rf"(?:{pattern}).*$")


def near(x: str, gap: str, cue: str, most: int) -> str:
    return f"({like(x, cue)} AND {few(gap, most)} AND NOT {like(gap, E.COORDINATOR)})"


def near_left(x: str, cue: str, most: int) -> str:
    return near(x, after_last(x, cue), cue, most)


def near_right(x: str, cue: str, most: int) -> str:
    return near(x, f"regexp_extract({x}, {q(rf'^(.*?)(?:{cue})')}, 1)", cue, most)


def case(*pairs: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def spans_sql(source: str, key: str, pattern: str) -> str:
    """CTEs ``m`` and ``s``: a row for each match in column ``t`` of ``source``."""
    return f"""m AS (SELECT {key}, t, regexp_extract_all(t, {q(pattern)}) AS phrases, regexp_split_to_array(t, {q(pattern)}) AS pieces FROM {source}),
    n AS (SELECT *, unnest(range(1, len(phrases) + 1)) AS i FROM m),
    a AS (SELECT *, (coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(phrases[1:i - 1], lambda x: length(x))), 0))::INT AS pos, phrases[i] AS phrase FROM n),
    s AS (SELECT {key}, t, pos, phrase, substring(t, greatest(0, pos - {E.AROUND}) + 1, least(pos, {E.AROUND})) AS l, substring(t, pos + length(phrase) + 1, {E.AROUND}) AS r FROM a)"""


# ---- statements

STATEMENTS = (
    "Visa sponsorship is available for qualified people.", "We sponsor H-1B visas, and relocation may be discussed separately.", "Green card sponsorship starts after a year.", "We are happy to sponsor and will handle your visa.",
    "This team doesn't offer sponsorship.", "We cannot extend visa sponsorship for this position.", "U.S. citizens only.", "Citizenship required: Yes", "Citizenship required: No", "Visa: GC/Citizens", "Visa: GC/Citizens/H-1B",
    "Applicants must not require sponsorship now or in the future.", "We can't sponsor visas at all.", "You must hold U.S. citizenship for this work.", "We do not sponsor street fairs.", "We sponsor local teams.",
    "We are unable to sponsor visas for all new hires.", "We are not able to sponsor visas for every role.", "It is not true that we cannot sponsor visas.", "Limited immigration support may be available.",
    "If approved by counsel, we will sponsor H-1B holders.", "We are unable, given our small budget for this opening, to offer visa sponsorship.", "Work without sponsorship for an export license is a must.",
    "We are unable to sponsor new H-1B petitions; H-1B transfers are welcome.", "H-1B sponsorship is unavailable.", "Visa sponsorship: none.", "H-1B sponsorship is available for people who are not yet here.", "We welcome all who need visa sponsorship.",
)


def planted(key: str, statements, step: int) -> Column:
    """A statement by id; every third id has none at the first step."""
    n = len(statements)
    return F.get(F.array(*map(F.lit, (*statements, ""))), F.pmod(F.expr(f"{key} div {step}"), F.lit(n + 1)).cast("int"))


def planted_sql(key: str, statements, step: int) -> str:
    return "[" + ", ".join(q(x) for x in (*statements, "")) + f"][({key} // {step}) % {len(statements) + 1} + 1]"


def with_statements(spark, d, statements) -> DataFrame:
    n = len(statements) + 1
    text = F.concat_ws("", F.coalesce("text", F.lit("")), F.lit(". "), planted("doc_id", statements, 1), F.lit(" "), planted("doc_id", statements, n))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.alias("text"))


def with_statements_sql(statements) -> str:
    n = len(statements) + 1
    return f"SELECT doc_id, coalesce(text, '') || '. ' || {planted_sql('doc_id', statements, 1)} || ' ' || {planted_sql('doc_id', statements, n)} AS text FROM documents"


def _normalised_sql(x: str) -> str:
    x = f"translate({x}, '{E.UPPER}', '{E.LOWER}')"
    for pattern, to in S.SPELLINGS:
        x = sub(x, pattern, to)
    return x


def _sponsorship_sql() -> str:
    rule = lambda what: case(*[(like("phrase", f"^(?:{r.pattern})$"), q(getattr(r, what))) for r in S.RULES], otherwise="NULL")
    near_l, r = f"right(l, {S.SCOPE})", f"substring(r, 1, {S.SCOPE})"
    opens = f"({like(near_l, S.JOIN + '$')} AND {like('phrase || substring(r, 1, 60)', '^' + S.TOPIC_VERB)})"
    bare = lambda g: f"({few(g, S.DOUBLE)} AND NOT {like(g, S.TOPIC)} AND NOT {like(g, E.COORDINATOR)})"
    bounded = lambda p: f"(about AND ({near_right('tail', p, S.BOUND)} OR (has_cue AND {near_left('gap', p, S.BOUND)})))"
    by_quantifier = lambda otherwise: case((bounded(S.EACH), "'scope_limit'"), (bounded(S.ALL), "'unsettled'"), otherwise=otherwise)
    no_denial = (
        f"(kind = 'field' AND {like('r', S.DENIED_FIELD)}) OR (kind = 'list' AND {like('r', S.MORE_IN_LIST)}) OR (kind = 'person' AND {like('r', S.ESCAPE)} AND NOT {like('phrase', 'must be an? us citizen')})"
        f" OR (kind = 'verb' AND NOT {like('around', S.IMMIGRATION)})"
    )
    denial = case((f"has_cue AND {bare('gap')}", "'ambiguous'"), otherwise=by_quantifier(case((no_denial, "'none'"), (f"{bounded(S.NEW_PETITION)} AND {like('t', S.TRANSFER)}", "'unsettled'"), otherwise="'negative'")))
    mention = case(("verb", case(("doubled", "'ambiguous'"), otherwise=by_quantifier("'negative'"))), ("ahead = 'reachable'", denial), otherwise="'none'")
    maybe = f"({near_left('scope', S.HEDGE, S.HEDGED)} OR {near_right('tail', S.HEDGE, S.HEDGED)} OR {like('head', S.CONDITION)})"
    offer = case(
        (f"kind = 'weak' AND NOT {like('around', S.CONTEXT)}", "'none'"), ("reached AND doubled", "'ambiguous'"), ("reached", by_quantifier("'negated_offer'")),
        (f"trim(scope) <> '' AND {like('head', S.CUE)} AND NOT {like(after_last('head', S.CUE), S.HARD)}", "'unreachable'"),
        ("ahead = 'unreachable'", "'unreachable'"), ("ahead = 'reachable'", by_quantifier("'negated_offer'")), (maybe, "'hedged'"), otherwise="'positive'",
    )
    has = lambda *names: "(" + " OR ".join(f"list_contains(says, '{n}')" for n in names) + ")"
    order = "[" + ", ".join(q(c) for c in S.CLASSES) + "]"
    decided = lambda yes, no, low, none: case(("conflict", q(low)), (has("negative", "negated_offer"), q(no)), (has("unsettled", "ambiguous"), q(low)), (has("positive"), q(yes)), ("len(says) > 0", q(low)), otherwise=q(none))
    return f"""
    WITH t AS (SELECT doc_id, {_normalised_sql('text')} AS t FROM ({with_statements_sql(STATEMENTS)})),
    {spans_sql('t', 'doc_id', S.PATTERN)},
    f AS (SELECT *, {rule('name')} AS rule, {rule('kind')} AS kind, CASE WHEN {opens} THEN '' ELSE {after_last(near_l, S.BREAK)} END AS scope, {after_last('l', S.SENTENCE)} AS head, {before_first(r, S.BREAK)} AS tail,
      {before_first(sub(r, S.FIELD_SEPARATOR), S.AHEAD)} AS predicate, {before_first('r', S.SENTENCE)} AS rest, right(l, {S.WINDOW}) || phrase || substring(r, 1, {S.WINDOW}) AS around FROM s),
    g AS (SELECT *, {like('phrase', r'\bsponsor')} AS about, {after_last('scope', S.CUE)} AS gap, {like('scope', S.CUE)} AS has_cue, regexp_extract(scope, {q(rf'^(.*)(?:{S.CUE})')}, 1) AS outside, head || phrase || rest AS sentence,
      {case((f"NOT {like('predicate', S.CUE)}", "'none'"), (near_right('predicate', S.CUE, S.REACH), "'reachable'"), otherwise="'unreachable'")} AS ahead FROM f),
    h AS (SELECT *, has_cue AND {few('gap', S.REACH)} AS reached, {like('outside', S.CUE)} AND {bare(after_last('outside', S.CUE))} AS doubled,
      has_cue AND {few('gap', S.REACH)} AND {like('gap', S.VERB)} AND {few(after_last('gap', S.VERB), S.OFFERING)} AS verb FROM g),
    k AS (SELECT *, {case(("kind = 'head'", mention), ("kind IN ('strong', 'weak')", offer), otherwise=denial)} AS reads FROM h),
    e AS (SELECT doc_id, rule || ': ' || phrase AS what, CASE WHEN reads <> 'none' AND about AND {like('sentence', S.EXPORT)} AND NOT {like('sentence', S.CONTEXT)} THEN 'export_control' ELSE reads END AS says FROM k),
    d AS (SELECT DISTINCT * FROM e WHERE says <> 'none'),
    u AS (SELECT * FROM d WHERE NOT (says = 'unsettled' AND EXISTS (SELECT 1 FROM d x WHERE x.doc_id = d.doc_id AND x.what = d.what AND x.says IN ('negative', 'negated_offer')))),
    w AS (SELECT doc_id, list(DISTINCT says) AS says, string_agg(says || ' ' || what, ' | ' ORDER BY list_position({order}, says), what) AS evidence, string_agg(DISTINCT says, ',' ORDER BY says) AS families FROM u GROUP BY doc_id),
    x AS (SELECT t.doc_id, t.t, coalesce(says, []) AS says, coalesce(evidence, '') AS evidence, coalesce(families, '') AS families FROM t LEFT JOIN w USING (doc_id)),
    y AS (SELECT *, {has('negative', 'negated_offer', 'unsettled', 'unreachable')} AND {has('positive', 'hedged')} AS conflict FROM x),
    z AS (SELECT doc_id, {decided('match', 'no_match', 'review', 'review')} AS decision, {decided('likely', 'unlikely', 'unknown', 'unknown')} AS verdict, {decided('high', 'high', 'low', 'unknown')} AS confidence,
      evidence, families, families <> '' OR {like('t', S.SIGNAL)} AS signal FROM y)
    SELECT *, substring(sha256('sponsorship|' || decision || '|' || verdict || '|' || confidence || '|' || families), 1, 16) AS signature FROM z"""


@query(_sponsorship_sql())
def classify_sponsorship(spark, d):
    """Decision, evidence and signature of each document's statements about sponsorship."""
    return S.assessed(with_statements(spark, d, STATEMENTS), "text", "doc_id")


PAY = (
    "The base salary range is $120,000 - $150,000 per year.", "The hourly rate is $21 to $25.", "Compensation: $31/hr to $45/hr", "Pay range EUR 60k-80k.", "Base pay £80,000 to £60,000 annually.",
    "On-target earnings (OTE): $200,000 - $300,000.", "Annual salary New York: $140,000 - $175,000. Annual salary Austin: $100,000 - $120,000.", "Annual salary $30,000 - $45,000 for interns; annual salary $400,000 - $500,000 for leads.",
    "Base salary $140,000 - $175,000 and a stipend of $240 - $300 per year.", "A stipend of $500 - $700 per month.", "Base salary $3240 - $5000 per month.", "Base salary 60,000 - 80,000.", "Base pay $60,000-€80,000 per year.",
    "Base salary $60,000.00 - $80,000.50 per year.", "Base pay $50 per hour to $90,000 per year.", "Base pay in Ontario CAD 4,500 to 6,000 monthly.", "Total comp $250k-$400k, base salary $150k-$200k.",
)


def _pay_sql() -> str:
    second = P.RANGE.replace(P.AMOUNT + P.PERIOD, re.sub(r"\((?!\?)", "(?:", P.AMOUNT + P.PERIOD), 1)  # that engine tells nine groups apart
    part = lambda i: f"nullif(regexp_extract(phrase, {q(P.RANGE if i < 6 else second)}, {i if i < 6 else i - 5}), '')"
    lower = lambda x: f"translate({x}, '{E.UPPER}', '{E.LOWER}')"
    symbol = lambda i: "CASE " + part(i) + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.CURRENCIES.items()) + " END"
    currency = lambda c, s: f"CASE WHEN upper({part(c)}) IS NULL OR {symbol(s)} IS NULL OR upper({part(c)}) = {symbol(s)} THEN coalesce(upper({part(c)}), {symbol(s)}) END"
    money = lambda i: f"round(replace({part(i)}, ',', '')::DECIMAL(18, 4) * CASE WHEN {part(i + 1)} IS NOT NULL THEN 1000 ELSE 1 END)::BIGINT"
    period = lambda i: f"CASE WHEN {part(i)} IS NULL THEN NULL WHEN {like(lower(part(i)), 'hour|/hr')} THEN 'hour' WHEN {like(lower(part(i)), 'year|annually')} THEN 'year' ELSE regexp_extract(replace({lower(part(i))}, 'daily', 'day'), 'month|week|day') END"
    last = lambda x, p: f"CASE WHEN {like(x, p)} THEN length(regexp_extract({x}, {q('^(.*)' + p)}, 1)) ELSE -1 END"
    limit = lambda of: "CASE period " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + " END"
    before, after = f"right(l, {P.BEFORE})", f"substring(r, 1, {P.AFTER})"
    bands = lambda k: f"coalesce(string_agg(low || '-' || high || ' ' || currency || '/' || period || ' ' || place, '; ' ORDER BY pos) FILTER (kind = '{k}'), '')"
    return f"""
    WITH t AS (SELECT doc_id, {sub('text', P.BLANK, ' ')} AS t FROM ({with_statements_sql(PAY)})),
    {spans_sql('t', 'doc_id', P.RANGE)},
    b AS (SELECT *, {lower(before)} AS before, {lower(after)} AS behind FROM s),
    f AS (SELECT doc_id, pos, NOT {like('l', P.BROKEN_LEFT)} AND NOT {like('r', P.BROKEN_RIGHT)} AS unbroken, list_filter([{currency(1, 2)}, {currency(6, 7)}], lambda x: x IS NOT NULL) AS currencies,
      {money(3)} AS a, {money(8)} AS z, {period(5)} AS p, {period(10)} AS q, {last('before', P.TOTAL)} AS total_at, {last('before', P.SALARY)} AS salary_at, {like('behind', P.TOTAL)} AS total_next, {like('behind', P.SALARY)} AS salary_next,
      before || ' ' || behind || ' ' || {lower('phrase')} AS around, {before} AS said FROM b),
    g AS (SELECT *, least(a, z) AS low, greatest(a, z) AS high, total_at >= 0 OR salary_at >= 0 AS named, currencies[1] AS currency, CASE WHEN {like('around', P.HOURLY)} AND NOT {like('around', P.ANNUAL)} THEN 'hour' WHEN {like('around', P.ANNUAL)} AND NOT {like('around', P.HOURLY)} THEN 'year' END AS cue,
      trim(CASE WHEN regexp_extract(said, {q(P.LABEL)}, 1) <> '' THEN regexp_extract(said, {q(P.LABEL)}, 1) ELSE regexp_extract(said, {q(P.SCOPED)}, 1) END, ' ,;-') AS place FROM f),
    h AS (SELECT *, coalesce(CASE WHEN p <> q THEN NULL ELSE coalesce(p, q, cue) END, CASE WHEN low >= {P.FLOOR['year']} THEN 'year' END) AS period FROM g),
    k AS (SELECT *, CASE WHEN unbroken AND len(list_distinct(currencies)) = 1 AND low > 0 AND high <= {P.MOST} AND period IS NOT NULL AND high >= {limit(P.FLOOR)} AND high <= coalesce({limit(P.CEILING)}, {P.MOST}) AND high <= low * {P.SPREAD}
      THEN CASE WHEN (CASE WHEN named THEN total_at > salary_at ELSE total_next END) THEN 'total' WHEN (CASE WHEN named THEN salary_at > total_at ELSE salary_next END) OR (p IS NOT NULL AND q IS NOT NULL) THEN 'salary' END END AS kind FROM h),
    w AS (SELECT doc_id, {bands('salary')} AS salary, {bands('total')} AS total, min(low) FILTER (kind = 'salary' AND period = 'year') AS lo, max(high) FILTER (kind = 'salary' AND period = 'year') AS hi, count(*) FILTER (kind = 'salary') AS n, bool_or(named) AS named FROM k GROUP BY doc_id)
    SELECT t.doc_id, coalesce(salary, '') AS salary, coalesce(total, '') AS total, CASE WHEN hi <= lo * {P.SPREAD} THEN lo END AS low, CASE WHEN hi <= lo * {P.SPREAD} THEN hi END AS high,
      CASE WHEN hi <= lo * {P.SPREAD} THEN NULL WHEN lo IS NOT NULL THEN 'pay_bands_conflict' WHEN n > 0 THEN 'pay_stated_not_annual' WHEN named THEN 'pay_stated_but_unparsed' END AS reason
    FROM t LEFT JOIN w USING (doc_id)"""


@query(_pay_sql())
def salary_ranges(spark, d):
    """Bands of pay of each document, the annual envelope, and why there is none."""
    at = P.with_bands(with_statements(spark, d, PAY), "text", "doc_id")
    return at.select("doc_id", P.said("salary").alias("salary"), P.said("total").alias("total"), "low", "high", "reason")


ASKED = (
    "You must have 5+ years of experience.", "Minimum of 3 years of professional experience.", "3-5 years of relevant experience.", "Between three (3) to five years required.", "5 years of experience with Kubernetes.", "4+ years of Python experience.",
    "10+ years of experience preferred.", "Our founders have 20 years of experience.", "Our team is looking for someone with 6 years of experience.", "The team has 50 years of combined experience.",
    "8-10 years of product experience, including at least 2 years owning models.", "Must have 7 or more years overall.", "Leave after two years of service.", "Experience: seven years.", "99 years of experience required.", "2.5 years of industry experience.",
    "5 years of work experience, of which 3 years using Spark are required.",
)


def _years_sql() -> str:
    words = "[" + ", ".join(q(w) for w in Y.WORDS) + "]"
    bare = lambda x: f"trim(regexp_replace({x}, '\\(.*\\)', '', 'g'))"
    number = lambda x: f"coalesce(try_cast({bare(x)} AS DOUBLE), nullif(list_position({words}, {bare(x)}), 0)::DOUBLE)"
    window = lambda a, b: f"right(before, {a}) || phrase || substring(behind, 1, {b})"
    claim, context = "right(before, 80)", "(phrase || substring(behind, 1, 80))"
    field, kind = (f"regexp_extract({context}, {q(p)}, 1)" for p in (Y.FIELD, Y.KIND))
    best = lambda cond, col: f"arg_max({col}, (sure, low, (high IS NOT NULL)::INT, -pos)) FILTER ({cond})"
    return f"""
    WITH t AS (SELECT doc_id, regexp_replace(translate(text, '{E.UPPER}', '{E.LOWER}'), {q(Y.BLANK)}, ' ', 'g') AS t FROM ({with_statements_sql(ASKED)})),
    {spans_sql('t', 'doc_id', Y.PATTERN)},
    f AS (SELECT *, regexp_extract_all(phrase, {q(r'\b' + Y.NUMBER)}) AS numbers, {like('phrase', '^' + Y.RANGE + '$')} AS two, right({after_last('l', Y.LINE)}, 100) AS before, {before_first(f"substring({before_first('r', Y.LINE)}, 1, 100)", Y.STATED)} AS behind,
      coalesce(pos < nullif(instr(t, chr(10)), 0) - 1, false) AS starts FROM s),
    g AS (SELECT doc_id, t, pos, phrase, {number('numbers[1]')} AS low, CASE WHEN two THEN {number('numbers[-1]')} END AS high, before, behind, starts,
      ({field} <> '' AND NOT {like(field, Y.GENERAL_FIELD)}) OR ({kind} <> '' AND NOT {like(kind, Y.GENERAL_KIND)}) AS contextual FROM f),
    h AS (SELECT *, ({like(window(80, 30), Y.REQUIRED)} OR {like(context, Y.GENERAL)} OR starts) AND NOT contextual AS certain FROM g WHERE low IS NOT NULL AND low <= {Y.MOST} AND coalesce(high >= low AND high <= {Y.MOST}, true)
      AND NOT {like(window(60, 30), Y.PREFERRED)} AND NOT ({like(claim, Y.OTHERS)} AND NOT {like(after_last(claim, Y.OTHERS), Y.APPLICANT)}) AND NOT {like(window(40, 40), Y.COMBINED)}),
    p AS (SELECT *, lag(pos + length(phrase)) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM h),
    i AS (SELECT *, substring(t, prior + 1, pos - prior) AS gap FROM p),
    j AS (SELECT *, coalesce(NOT {like('gap', Y.LINE)} AND {like('gap', Y.INSIDE + Y.FILLER + '$')}, false) AS nested FROM i),
    k AS (SELECT *, nested AND {like('gap || phrase', Y.REQUIRED)} AS cued, sum((NOT nested)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS family FROM j),
    n2 AS (SELECT *, certain OR (NOT nested AND NOT contextual AND bool_or(cued) OVER (PARTITION BY doc_id, family)) AS sure FROM k),
    o AS (SELECT *, NOT nested OR bool_and(nested) OVER (PARTITION BY doc_id) AS main FROM n2),
    w AS (SELECT doc_id, {best('main', 'low')} AS lo, max((sure, low, (high IS NOT NULL)::INT, -pos)) FILTER (main) AS top, {best('nested', 'low')} AS specialty FROM o GROUP BY doc_id),
    x AS (SELECT w.*, o.high AS hi, o.sure AS certain, o.contextual FROM w JOIN o ON o.doc_id = w.doc_id AND o.pos = -w.top[4]),
    u AS (SELECT doc_id FROM t WHERE NOT {like('t', Y.PATTERN)} AND list_bool_or(list_transform(regexp_split_to_array(t, {q(Y.LINE)}), lambda s: {like('s', Y.STATED)} AND {like('s', r'\bexperien(?:ce|ced)\b')})))
    SELECT t.doc_id, lo AS min, hi AS max, CASE WHEN lo IS NULL THEN 'unknown' WHEN certain THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN lo IS NULL THEN 'not_stated' WHEN contextual THEN 'contextual' ELSE 'required' END AS kind, specialty,
      CASE WHEN u.doc_id IS NOT NULL THEN 'yoe_stated_but_unparsed' END AS reason, CASE WHEN lo IS NULL OR NOT certain THEN 'review' WHEN lo > 6 THEN 'no_match' ELSE 'match' END AS decision
    FROM t LEFT JOIN x USING (doc_id) LEFT JOIN u USING (doc_id)"""


@query(_years_sql())
def classify_years(spark, d):
    """Years that each document asks for, and whether six are enough."""
    return Y.with_years(with_statements(spark, d, ASKED), "text", "doc_id", cap=6)


# ---- titles and levels

SEARCH = N.Search(["software engineer", "backend", "infrastructure", "site reliability", "account executive", "machine learning"], ["manager", "director", "new grad", "staff", "intern"], ["member of technical staff"])
FRONT = ("", "Senior ", "Staff ", "Principal ", "Associate ", "Member of Technical Staff, ", "Distinguished ", "New College Grad ", "Head of ")
CORE = ("Software Engineer", "Infrastructure Planner", "Account Executive", "Backend Developer", "Engineering Manager", "Strategic Finance", "Sales Engineer", "Nurse", "Machine Learning Scientist", "Product Manager", "Gardener", "Site Reliability Engineer", "Counsel, Infrastructure")
BACK = ("", ", Ads Manager", " II", " Lead", " - Engineering Manager", " (Remote)", ", Platform")


def _title_sql() -> str:
    pick = lambda values, by: "[" + ", ".join(q(v) for v in values) + f"][({by}) % {len(values)} + 1]"
    norm = lambda x: f"trim(regexp_replace(regexp_replace(translate(lower({x}), '‐‑‒–—―', '------'), '[^a-z0-9+/.# -]', ' ', 'g'), ' +', ' ', 'g'))"
    hits = lambda terms, x: "list_filter([" + ", ".join(f"CASE WHEN {like(x, N.T.term_pattern(t))} THEN {q(t)} END" for t in terms) + "], lambda x: x IS NOT NULL)"
    scan = norm("title")
    for p in SEARCH.neutral:
        scan = f"replace({scan}, {q(p)}, ' ')"
    scan = sub(scan, N.STAFF_MEMBER, " ")
    bearing = [t for t in SEARCH.include if re.search(N.ROLE, t)]
    scope = "NULL"
    for name, p in reversed(N.SCOPES.items()):
        own = f"AND NOT {like('lev', N.OWN_MANAGER)}" if name in ("senior_manager", "line_manager") else ""
        first = f"regexp_extract(lev, {q(rf'^(.*?)(?:{p})')}, 1)"
        scope = f"CASE WHEN {like('lev', p)} THEN CASE WHEN NOT {like(first, N.IC_NOUN)} {own} THEN '{name}' END ELSE {scope} END"
    levels = case(*[(like("lev", p), q(n)) for n, p in N.LEVELS.items()], otherwise="'unknown'")
    told = lambda head, x: f"array_to_string(list_transform({x}, lambda n: '{head}' || n), ',')"
    return f"""WITH t AS (SELECT p_partkey, {pick(FRONT, 'p_partkey')} || {pick(CORE, f'p_partkey // {len(FRONT)}')} || {pick(BACK, f'p_partkey // {len(FRONT) * len(CORE)}')} AS title FROM part),
    a AS (SELECT p_partkey, title, {norm('title')} AS x, {scan} AS scan, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS raw FROM t),
    b AS (SELECT *, list_distinct({hits(SEARCH.exclude, 'scan')} || CASE WHEN {like('scan', N.EARLY)} THEN ['new grad'] ELSE [] END) AS excluded, {hits(SEARCH.include, 'x')} AS named, {hits(bearing, 'x')} AS bearing, {hits([t for t in SEARCH.include if t not in N.BROAD], 'x')} AS clean,
      {hits([t for t in SEARCH.include if t in N.BROAD], 'x')} AS wide, list_filter([{", ".join(f"CASE WHEN {like('scan', p)} THEN '{n}' END" for n, p in N.OCCUPATIONS.items())}], lambda x: x IS NOT NULL) AS other, regexp_extract(raw, {q(N.SUFFIX)}, 1) AS tail,
      {sub('raw', N.STAFF_MEMBER, ' ')} AS lev FROM a),
    c AS (SELECT *, tail <> '' AND NOT {like(norm('tail'), N.MANAGES)} AND len({hits(bearing, norm(sub('raw', N.SUFFIX)))}) > 0 AS product FROM b),
    d AS (SELECT *, CASE WHEN excluded = ['manager'] AND product THEN 'manager_product_suffix_ambiguous' WHEN len(excluded) > 0 THEN 'excluded:' WHEN len(clean) = 0 AND NOT {like('scan', N.ROLE)} AND NOT {like('scan', N.RESEARCH)} AND len(other) > 0 THEN {told('nontechnical_occupation.', 'other')}
      WHEN len(named) = 0 THEN 'not_included' WHEN len(bearing) = 0 AND len(wide) > 0 AND NOT {like('x', N.ROLE)} THEN 'broad_domain_without_role' WHEN {like('scan', N.LEADERSHIP)} THEN 'leadership_ambiguous' ELSE {told('included.', 'named')} END AS rule FROM c)
    SELECT p_partkey, CASE WHEN rule LIKE 'excluded%' OR rule LIKE 'nontechnical%' THEN 'no_match' WHEN rule LIKE 'included%' THEN 'match' ELSE 'review' END AS decision, coalesce({scope}, {levels}) AS level,
      CASE WHEN rule = 'excluded:' THEN {told('excluded.', f"list_filter([{', '.join(q(t) for t in SEARCH.exclude)}], lambda e: list_contains(excluded, e))")} ELSE rule END AS rules FROM d"""


@query(_title_sql())
def classify_title(spark, d):
    """The verdict on each title, its level, and the rules that decided."""
    key = F.col("p_partkey")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    title = F.concat(pick(FRONT, key), pick(CORE, F.floor(key / len(FRONT))), pick(BACK, F.floor(key / (len(FRONT) * len(CORE)))))
    at = spread(table(spark, d, "part").select("p_partkey")).select("p_partkey", title.alias("title"))
    return at.select("p_partkey", *[c.alias(n) for n, c in N.assessed(F.col("title"), SEARCH).items()])


# ---- places

LEXICON = L.Lexicon(metros=["seattle", "new york"], us=["us", "usa", "united states"], offices=["austin", "texas", "chicago"], foreign=["london", "uk", "canada", "germany", "sao paulo", "zurich"])
PLACES = ("Seattle, WA", "São Paulo", "Zürich or Austin", "US or Canada", "United States / London", "Remote", "Anywhere", "Remote - US", "Austin", "US", "Hybrid - Seattle", "Hybrid", "New York", "", "Chicago (hybrid)", "Somewhere")
MODES = (
    "This is a remote position.", "You must reside in Texas.", "You must be based in the Seattle area.", "You must live in Germany.", "You must live near our dog park.", "Not open to Seattle or New York.", "Not open to Seattle.", "Hybrid role.", "Fully remote.",
    "This is an on-site role.", "Remote or hybrid: a fully remote team.", "This is not a fully remote job.", "No on-site role here.", "We hire in the United States.", "Three days a week in our office.", "You must not be based in Texas.",
)
HINTS = ("", "remote", "onsite", "hybrid", "")


def _places_sql() -> str:
    n = L.named
    denied = lambda p, no: f"({like('d', p)} AND NOT {like(f'regexp_extract(regexp_extract(d, {q(f"(?s)^(.*?)(?:{p})")}, 1), {q("[^.;!?" + chr(92) + "n]*$")})', no)})"
    pick = lambda values, by: "[" + ", ".join(q(v) for v in values) + f"][({by}) % {len(values)} + 1]"
    plain = lambda x: f"trim(regexp_replace(strip_accents(lower({x})), '[ \\t\\r\\f]+', ' ', 'g'))"
    pair = L.CANADA
    return f"""WITH t AS (SELECT doc_id, {plain(pick(PLACES, 'doc_id'))} AS l, {plain(f"coalesce(text, '') || '. ' || {planted_sql('doc_id', MODES, len(PLACES))} || ' ' || {planted_sql('doc_id', MODES, 37)}")} AS d, {pick(HINTS, 'doc_id // 3')} AS h, doc_id % 2 = 0 AS trusted FROM documents),
    a AS (SELECT *, {like('l', L.WORKPLACE_ONLY)} AS tag, {denied(L.REMOTE, L.NOT_REMOTE)} AS remote, {like('d', L.EITHER)} AS either, {like('l', n(L.REMOTE_FIELD))} AS at_remote, {denied(L.ONSITE, L.NOT_ONSITE)} AS onsite, {like('d', L.OPTIONAL)} AS opt FROM t),
    b AS (SELECT *, {like('d', L.HYBRID)} AND NOT (opt AND (remote OR at_remote)) AS hybrid, {like('l', n(('hybrid',)))} AND NOT (opt AND (remote OR at_remote)) AS at_hybrid FROM a),
    c AS (SELECT *, CASE WHEN onsite AND (remote OR at_remote OR h = 'remote') THEN 'remote_onsite_conflict' WHEN hybrid AND remote AND NOT either THEN 'remote_hybrid_conflict' WHEN at_hybrid AND remote AND NOT either AND NOT tag THEN 'location_hybrid_jd_remote_conflict' END AS clash FROM b),
    e AS (SELECT *, CASE WHEN clash IS NOT NULL THEN 'unknown low' WHEN onsite THEN 'onsite high' WHEN remote THEN 'remote high' WHEN hybrid OR at_hybrid THEN 'hybrid high' WHEN at_remote THEN 'remote high' WHEN h = 'onsite' THEN 'onsite medium' WHEN h <> '' AND trusted THEN h || ' medium' WHEN h <> '' THEN h || ' low'
      WHEN l <> '' AND trim(d) <> '' THEN 'unknown medium' WHEN l <> '' THEN 'onsite medium' ELSE 'unknown unknown' END AS w FROM c),
    f AS (SELECT *, string_split(w, ' ')[1] AS workplace, string_split(w, ' ')[2] AS confidence, CASE WHEN clash IS NULL AND h IN ('remote', 'hybrid') AND w = h || ' low' THEN 'uncorroborated_ats_workplace_hint' ELSE clash END AS doubt,
      regexp_extract(d, {q(L.RESIDENCY)}, 1) AS gap, regexp_extract(d, {q(L.RESIDENCY)}, 2) AS home_at, {like('l', pair)} AS pair, regexp_extract(d, {q(L.EXCLUDED)}, 1) AS closed FROM e),
    g AS (SELECT *, {like('l', n(LEXICON.foreign))} AND NOT pair AS abroad, {like('l', n(LEXICON.us))} OR pair AS us, CASE WHEN home_at <> '' AND NOT {like('right(gap, 16)', r"\b(?:no|nor|not|never)\b|n't")} THEN
      {case((like('home_at', n(LEXICON.metros)), "'metro'"), (like('home_at', n(LEXICON.us)), "'us_remote'"), (like('home_at', n(LEXICON.offices)), "'other_us'"), (like('home_at', n(LEXICON.foreign)), "'foreign'"), otherwise="'unknown'")} END AS home FROM f),
    i AS (SELECT *, CASE WHEN {like('l', n(LEXICON.metros))} THEN 'metro' WHEN abroad AND us THEN 'unknown mixed_us_foreign_scope' WHEN abroad THEN 'foreign' WHEN workplace = 'remote' AND home = 'unknown' THEN 'unknown residency_restriction_unparsed' WHEN workplace = 'remote' AND home IS NOT NULL THEN home
      WHEN workplace = 'remote' AND tag AND NOT us AND NOT {like('l', n(L.UNBOUND))} AND NOT {like('d', n(LEXICON.us))} THEN 'unknown remote_without_us_scope' WHEN workplace = 'remote' THEN 'us_remote' WHEN {like('l', n(LEXICON.offices))} THEN 'other_us'
      WHEN us AND workplace IN ('hybrid', 'onsite') AND confidence = 'high' THEN 'unknown us_scope_without_remote_workplace' WHEN us THEN 'us_remote' WHEN tag THEN 'unknown workplace_tag_without_geography' ELSE 'unknown' END AS place FROM g),
    j AS (SELECT *, string_split(place, ' ')[1] AS category, nullif(array_to_string(string_split(place, ' ')[2:], ' '), '') AS lost FROM i),
    k AS (SELECT *, category = 'us_remote' AND closed <> '' AND {" AND ".join(like('closed', n([m])) for m in LEXICON.metros)} AS shut FROM j),
    m AS (SELECT *, CASE WHEN category <> 'foreign' AND NOT shut THEN coalesce(doubt, lost) END AS why FROM k),
    o AS (SELECT *, CASE WHEN shut THEN 'no_match' WHEN why IS NOT NULL THEN 'review' WHEN category IN ('metro', 'us_remote') THEN 'match' WHEN category IN ('other_us', 'foreign') THEN 'no_match' ELSE 'review' END AS decision FROM m)"""


def _placed(spark, d) -> DataFrame:
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    key = F.col("doc_id")
    text = F.concat_ws("", F.coalesce("text", F.lit("")), F.lit(". "), planted("doc_id", MODES, len(PLACES)), F.lit(" "), planted("doc_id", MODES, 37))
    at = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", L.plain(pick(PLACES, key)).alias("location"), L.plain(text).alias("text"), pick(HINTS, F.floor(key / 3)).alias("hint"), (key % 2 == 0).alias("trusted"), F.lit("").alias("title"))
    return L.with_workplace(at)


@query(_places_sql() + " SELECT doc_id, workplace, confidence, doubt AS reason FROM f")
def classify_workplace(spark, d):
    """Remote, hybrid, onsite or unknown, from field, text and hint."""
    return _placed(spark, d).select("doc_id", "workplace", "confidence", F.col("doubt").alias("reason"))


@query(_places_sql() + " SELECT doc_id, category, decision, CASE WHEN why IS NULL AND decision = 'review' THEN 'unclassified_location' ELSE why END AS reason FROM o")
def classify_location(spark, d):
    """The category of each posting's place, and the decision."""
    return L.with_decision(_placed(spark, d), LEXICON).select("doc_id", "category", "decision", "reason")


# ---- scores and the ladder of a level's sources

PROFILE = X.Profile(["kubernetes", "distributed systems"], ["spark", "go", "sql"], ["php", "on-call"], ["ai company", "language models", "machine learning"], (5.0, 6.0), 6.0, staff=True)
TOLD = (
    "You will run Kubernetes and Spark.", "This role does not involve PHP or on-call work, but Go.", "We are not looking for Kubernetes people. SQL is used.", "Distributed systems in Go.", "An AI company that trains language models.", "PHP and SQL.",
    "No interest in distributed systems however good.", "We won't be hiring for machine learning.", "This is not a Spark job.", "On-call every week.", "The team will not touch SQL, and that goes for what is around it, for tools and for all that comes with it, for people who like it, and for those who do not, for ever and ever, Kubernetes.",
)


def _titled(key: Column) -> Column:
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    return F.concat(pick(FRONT, key), pick(CORE, F.floor(key / len(FRONT))), pick(BACK, F.floor(key / (len(FRONT) * len(CORE)))))


def _titled_sql(key: str) -> str:
    pick = lambda values, by: "[" + ", ".join(q(v) for v in values) + f"][({by}) % {len(values)} + 1]"
    return f"{pick(FRONT, key)} || {pick(CORE, f'{key} // {len(FRONT)}')} || {pick(BACK, f'{key} // {len(FRONT) * len(CORE)}')}"


def _norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower({x}), '‐‑‒–—―', '------'), '[^a-z0-9+/.# -]', ' ', 'g'), ' +', ' ', 'g'))"


def _score_sql() -> str:
    has = lambda x, k: like(x, X.T.term_pattern(k))
    plus = lambda parts: "(" + " + ".join(parts) + ")"
    when = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
    p = PROFILE
    return f"""WITH a AS (SELECT doc_id, {_norm_sql(_titled_sql('doc_id'))} AS t, {_norm_sql('text')} AS d, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 7 + 2)::DOUBLE END AS lo, CASE WHEN doc_id % 4 > 1 THEN (doc_id % 7 + 3)::DOUBLE END AS hi, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 11)::DOUBLE END AS years FROM ({with_statements_sql(TOLD)})),
    b AS (SELECT *, {sub('t', X.TAKEN_BACK, ' ')} AS lt, {sub('d', X.TAKEN_BACK, ' ')} AS ld, coalesce(lo, hi) AS l0, coalesce(hi, lo) AS h0 FROM a),
    c AS (SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN ({has('t', k)} OR {has('d', k)}) AND NOT {has('lt', k)} AND NOT {has('ld', k)} THEN {q(k)} END" for k in (*p.strong, *p.good, *p.negative))}], lambda x: x IS NOT NULL), ',') AS negated,
      {plus(f"CASE WHEN {has('lt', k)} THEN 8 WHEN {has('ld', k)} THEN 4 ELSE 0 END" for k in p.strong)}::DOUBLE AS strong, ({plus(when(has('ld', k), 1) for k in p.good)} * 1.5)::DOUBLE AS good, ({plus(when(f"{has('lt', k)} OR {has('ld', k)}", 1) for k in p.negative)} * -4)::DOUBLE AS negative,
      (CASE WHEN {has('t', 'staff')} THEN 4 WHEN {has('t', 'senior')} OR {has('t', 'sr')} THEN 3 ELSE 0 END)::DOUBLE AS rank, 0 - round((CASE WHEN h0 < 5 THEN 5 - h0 WHEN l0 > 6 THEN l0 - 6 ELSE 0 END) * 6, 1) AS level, 0 - round(greatest(0, coalesce(years - 6, 0)), 1) AS over_reach,
      ({when('doc_id % 5 = 0', 15)} + {when('doc_id % 9 = 0', 5)})::DOUBLE AS visa, (least(10, 2 * {plus(when(f"{has('t', k)} OR {has('d', k)}", 1) for k in p.signals)}) + {when('doc_id % 13 = 0', 6)})::DOUBLE AS ai,
      least(10, (doc_id % 90 + 2 * (doc_id % 70)) / 20.0)::DOUBLE AS history, ({when('doc_id % 6 = 0', 5)} + {when('doc_id % 6 = 1', 3)})::DOUBLE AS place, ({when('doc_id % 8 <= 1', 3)})::DOUBLE AS fresh FROM b)
    SELECT doc_id, strong + good + negative + rank + level + over_reach + visa + ai + history + place + fresh AS score, * EXCLUDE (doc_id) FROM c"""


@query(_score_sql())
def weighted_score(spark, d):
    """The score of each posting, its parts, and terms that its text takes back."""
    key = F.col("doc_id")
    at = with_statements(spark, d, TOLD).select(
        "doc_id", "text", _titled(key).alias("title"), F.when(key % 4 > 0, (key % 7 + 2).cast("double")).alias("level_low"), F.when(key % 4 > 1, (key % 7 + 3).cast("double")).alias("level_high"), F.when(key % 3 == 0, (key % 11).cast("double")).alias("years"),
        (key % 5 == 0).alias("sponsors"), (key % 9 == 0).alias("transfers"), (key % 13 == 0).alias("ai_employer"), (key % 90).alias("h1b"), (key % 70).alias("perm"), (key % 6 == 0).alias("metro"), (key % 6 == 1).alias("remote_us"), (key % 8).alias("age_days"),
    )
    return X.scored(at, PROFILE, "doc_id")


def _level_sql(title: str) -> str:
    """The level that a title states, over a column ``lev`` made of it."""
    scope = "NULL"
    for name, p in reversed(N.SCOPES.items()):
        own = f"AND NOT {like('lev', N.OWN_MANAGER)}" if name in ("senior_manager", "line_manager") else ""
        scope = f"CASE WHEN {like('lev', p)} THEN CASE WHEN NOT {like(f'regexp_extract(lev, {q(rf'^(.*?)(?:{p})')}, 1)', N.IC_NOUN)} {own} THEN '{name}' END ELSE {scope} END"
    return f"coalesce({scope}, {case(*[(like('lev', p), q(n)) for n, p in N.LEVELS.items()], otherwise=chr(39) + 'unknown' + chr(39))})"


BODY = ("This role is a senior-level one.", "You are a principal software engineer.", "We hire at L6.", "This position is entry-level.", "", "", "")


@query(f"""WITH y AS ({_years_sql()}), t AS (SELECT doc_id, {sub("trim(regexp_replace(lower(" + _titled_sql('doc_id') + "), '" + chr(92) + "s+', ' ', 'g'))", N.STAFF_MEMBER, ' ')} AS lev, [{", ".join(q(b) for b in BODY)}][doc_id % {len(BODY)} + 1] AS body, ['mid', 'staff', NULL, NULL, NULL][doc_id % 5 + 1] AS known FROM documents),
b AS (SELECT *, {_level_sql('lev')} AS of_title, {case(*[(like('lower(body)', p), q(n)) for n, p in N.BODY_LEVELS.items()], (like('body', r'\bL6\b'), q('staff')), otherwise="'unknown'")} AS of_body FROM t),
l AS (SELECT doc_id, CASE WHEN known IS NOT NULL AND of_title NOT IN ('executive', 'director', 'senior_manager', 'line_manager') THEN known || ' company_reference medium' WHEN of_title <> 'unknown' THEN of_title || ' title medium'
  WHEN min IS NOT NULL THEN CASE WHEN min < 2 THEN 'entry' WHEN min < 5 THEN 'mid' WHEN min < 9 THEN 'senior' WHEN min < 13 THEN 'staff' ELSE 'senior_staff' END || ' required_yoe low' WHEN of_body <> 'unknown' THEN of_body || ' job_description low' ELSE 'unknown generic low' END AS x, min,
  CASE WHEN min IS NOT NULL THEN 'job_description' WHEN known IS NOT NULL THEN 'company_reference' ELSE 'not_stated' END AS years_source FROM b JOIN y USING (doc_id))
SELECT doc_id, string_split(x, ' ')[1] AS level, string_split(x, ' ')[2] AS source, string_split(x, ' ')[3] AS confidence, coalesce(min, CASE WHEN years_source = 'company_reference' THEN 4 END)::DOUBLE AS years, years_source FROM l""")
def metadata_ladder(spark, d):
    """Each posting's level and years from the first source that states them: a reference on the employer, the title, the years asked for, the text."""
    pick = lambda values, by: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (by % len(values)).cast("int"))
    key = F.col("doc_id")
    years = Y.with_years(with_statements(spark, d, ASKED), "text", "doc_id", cap=6).select("doc_id", "min")
    known = pick(("mid", "staff", None, None, None), key)
    at = years.withColumns({"known": known, "title": N.level_of_title(_titled(key)), "body": N.level_of_body(pick(BODY, key))})
    manages = F.col("title").isin(*N.SCOPES)
    said = lambda level, source, sure: F.concat_ws(" ", level, F.lit(source), F.lit(sure))
    found = (
        F.when(F.col("known").isNotNull() & ~manages, said(F.col("known"), "company_reference", "medium")).when(F.col("title") != "unknown", said(F.col("title"), "title", "medium"))
        .when(F.col("min").isNotNull(), said(N.level_of_years(F.col("min")), "required_yoe", "low")).when(F.col("body") != "unknown", said(F.col("body"), "job_description", "low")).otherwise("unknown generic low")
    )
    parts = F.split("found", " ")
    source = F.when(F.col("min").isNotNull(), "job_description").when(F.col("known").isNotNull(), "company_reference").otherwise("not_stated")
    at = at.withColumn("found", found).withColumn("years_source", source)
    years = F.coalesce("min", F.when(F.col("years_source") == "company_reference", 4.0))
    return at.select("doc_id", parts[0].alias("level"), parts[1].alias("source"), parts[2].alias("confidence"), years.alias("years"), "years_source")
