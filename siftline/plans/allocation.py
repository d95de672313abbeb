"""Mailboxes after a sync, time attributed to phases, free windows by the clock, and samples that share no row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline.operators import intervals, mailsync, select
from siftline.plans.queries import EV, query, table, timed

# ---- mail: orders are messages, customers' accounts and folders hold them

BOX = """folders AS (SELECT DISTINCT o_custkey % 7 AS account, (o_custkey // 7) % 3 AS folder, CASE WHEN o_custkey % 7 <> 5 OR (o_custkey // 7) % 3 <> 1 THEN 't' END AS token, CASE WHEN o_custkey % 7 = 4 THEN 1 ELSE 2 END AS fields, o_custkey % 7 = 3 AND (o_custkey // 7) % 3 = 0 AS expired FROM orders),
modes AS (SELECT account, folder, CASE WHEN token IS NULL OR fields <> 2 OR bool_or(expired AND token IS NOT NULL AND fields = 2) OVER (PARTITION BY account) THEN 'full' ELSE 'delta' END AS mode FROM folders),
rows AS (SELECT o_custkey % 7 AS account, (o_custkey // 7) % 3 AS folder, o_orderkey AS key, o_orderkey * 10 AS provider_id, CASE WHEN o_orderkey % 13 <> 0 THEN epoch(o_orderdate)::BIGINT END AS t FROM orders),
messages AS (SELECT account, key, provider_id, folder, t FROM rows WHERE key % 10 < 8),
listing AS (SELECT account, CASE WHEN key % 11 = 0 THEN (folder + 1) % 3 ELSE folder END AS folder, key, provider_id, t FROM rows JOIN modes USING (account, folder) WHERE key % 10 <> 3 AND (mode = 'full' OR key % 4 = 0) AND (t IS NULL OR t >= 852076800)),
removed AS (SELECT account, provider_id FROM rows WHERE key % 20 = 3), readable AS (SELECT account, provider_id FROM rows WHERE key % 3 = 0),
missing AS (SELECT m.account, m.key FROM messages m JOIN modes o USING (account, folder) WHERE o.mode = 'full' AND (t IS NULL OR t >= 852076800) AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.account = m.account AND l.folder = m.folder AND l.key = m.key)),
away AS (SELECT * FROM (SELECT * FROM missing UNION SELECT account, key FROM removed JOIN messages USING (account, provider_id)) a WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.account = a.account AND l.key = a.key))"""


def _box(spark, d):
    o = table(spark, d, "orders")
    account, folder = F.col("o_custkey") % 7, F.floor(F.col("o_custkey") / 7) % 3
    folders = o.select(account.alias("account"), folder.alias("folder")).distinct()
    token = F.when((F.col("account") != 5) | (F.col("folder") != 1), "t")
    folders = folders.select("account", "folder", token.alias("token"), F.when(F.col("account") == 4, 1).otherwise(2).alias("fields"), ((F.col("account") == 3) & (F.col("folder") == 0)).alias("expired"))
    modes = mailsync.modes(folders, 2)
    stamp = F.when(F.col("o_orderkey") % 13 != 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    rows = o.select(account.alias("account"), folder.alias("folder"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") * 10).alias("provider_id"), stamp.alias("at"))
    messages = rows.where("key % 10 < 8").select("account", "key", "provider_id", "folder", "at", F.lit(False).alias("deleted"), F.lit(True).alias("in_scope"))
    listing = rows.join(modes, ["account", "folder"]).where("key % 10 <> 3 and (mode = 'full' or key % 4 = 0)")
    listing = listing.withColumn("folder", F.when(F.col("key") % 11 == 0, (F.col("folder") + 1) % 3).otherwise(F.col("folder"))).select("account", "folder", "key", "provider_id", "at")
    removed, readable = (rows.where(x).select("account", "provider_id") for x in ("key % 20 = 3", "key % 3 = 0"))
    return mailsync.synced(messages, messages.select("account", "folder", "key"), modes, listing, removed, readable, F.lit(852076800))


@query(f"""WITH {BOX}
SELECT coalesce(m.account, l.account) AS account, coalesce(m.key, l.key) AS key, CASE WHEN l.key IS NOT NULL THEN l.folder WHEN a.key IS NULL THEN m.folder END AS folder, l.key IS NULL AND a.key IS NOT NULL AND r.provider_id IS NULL AS deleted,
  l.key IS NOT NULL OR a.key IS NULL AS in_scope, CASE WHEN l.key IS NOT NULL THEN 'upserted' WHEN a.key IS NULL THEN 'kept' WHEN r.provider_id IS NOT NULL THEN 'out_of_scope' ELSE 'tombstoned' END AS outcome
FROM messages m FULL JOIN listing l ON l.account = m.account AND l.key = m.key LEFT JOIN away a ON a.account = m.account AND a.key = m.key LEFT JOIN readable r ON r.account = m.account AND r.provider_id = m.provider_id""")
def mail_sync(spark, d):
    """Every message after a sync of full and of delta folders within a rolling window."""
    return _box(spark, d)[0].select("account", "key", "folder", "deleted", "in_scope", "outcome")


@query(f"""WITH {BOX} SELECT account, folder, key FROM listing UNION SELECT account, folder, key FROM messages m JOIN modes o USING (account, folder) WHERE mode = 'delta'
  AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.account = m.account AND l.key = m.key) AND NOT EXISTS (SELECT 1 FROM away a WHERE a.account = m.account AND a.key = m.key)""")
def mail_inventory(spark, d):
    """What each folder holds after the sync: its listing, or what a delta did not mention carried over."""
    return _box(spark, d)[1]


# ---- time

CLAIMS = f"(SELECT user_id, t * 1000 + (event_id * 37) % 1000 AS s, t * 1000 + (event_id * 37) % 1000 + 1 + (event_id % 9) * 700123 AS e, event_id % 3 AS rank FROM {EV} WHERE event_id % 4 > 0)"
LABELS = ("local_subprocess", "external_wait", "approval_wait")


@query(f"""WITH c AS {CLAIMS}, p AS (SELECT user_id, event_type AS phase, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'other' END AS role, t * 1000 AS s, CASE WHEN lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) IS NOT NULL THEN least(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t + 7200) * 1000 END AS e FROM {EV}),
b AS (SELECT user_id, s AS t FROM c UNION SELECT user_id, e FROM c UNION SELECT user_id, s FROM p WHERE e IS NOT NULL UNION SELECT user_id, e FROM p WHERE e IS NOT NULL),
g AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t2 FROM b),
r AS (SELECT g.user_id, g.t, g.t2, min(c.rank) AS rank FROM g JOIN c ON c.user_id = g.user_id AND c.s <= g.t AND c.e >= g.t2 WHERE t2 IS NOT NULL GROUP BY ALL),
w AS (SELECT user_id, phase, role, count(*) AS occurrences, sum(e - s)::BIGINT AS elapsed FROM p WHERE e IS NOT NULL GROUP BY ALL),
v AS (SELECT p.user_id, phase, role, {", ".join(f"sum(least(r.t2, p.e) - greatest(r.t, p.s)) FILTER (rank = {i}) AS {x}" for i, x in enumerate(LABELS))} FROM p JOIN r ON r.user_id = p.user_id AND r.t < p.e AND r.t2 > p.s GROUP BY ALL),
x AS (SELECT w.*, unnest([{", ".join(f"{{'x': '{x}', 'ms': coalesce({x}, 0)}}" for x in LABELS)}, {{'x': 'active', 'ms': elapsed - {" - ".join(f"coalesce({x}, 0)" for x in LABELS)}}}]) AS k FROM w LEFT JOIN v USING (user_id, phase, role)),
y AS (SELECT *, k.ms // 100 AS down, row_number() OVER (PARTITION BY user_id, phase, role ORDER BY k.ms % 100 DESC, k.x) AS n, elapsed // 100 - sum(k.ms // 100) OVER (PARTITION BY user_id, phase, role) AS more FROM x)
SELECT user_id, phase, role, occurrences, elapsed // 100 AS elapsed, {", ".join(f"(sum(down + (n <= more)::INT) FILTER (k.x = '{x}'))::BIGINT AS {x}" for x in (*LABELS, "active"))} FROM y GROUP BY ALL""")
def phase_rows(spark, d):
    """Tenths of seconds of each phase by what claimed them, which sum to the phase's own."""
    at = timed(spark, d)
    ms = F.col("t") * 1000 + (F.col("event_id") * 37) % 1000
    claims = at.where("event_id % 4 > 0").select("user_id", ms.alias("s"), (ms + 1 + (F.col("event_id") % 9) * 700123).alias("e"), (F.col("event_id") % 3).alias("rank"))
    until = F.least(F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")), F.col("t") + 7200) * 1000
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id"))) == 1
    role = F.when(F.col("event_id") % 2 == 0, "own").otherwise("other")
    phases = at.select("user_id", F.col("event_type").alias("phase"), role.alias("role"), (F.col("t") * 1000).alias("s"), until.alias("e"), last.alias("last")).where("not last").drop("last")
    tiled = claims.unionByName(phases.select("user_id", "s", "e", F.lit(len(LABELS)).cast("long").alias("rank")))
    segments = intervals.tiling(tiled, "user_id", "s", "e", "rank").withColumn("label", F.get(F.array(*map(F.lit, LABELS)), F.col("rank").cast("int")))
    segments = segments.select("user_id", F.col("t").alias("s"), F.col("t2").alias("e"), "label")
    return intervals.attributed(segments, phases, "user_id", "s", "e", "label", ["phase", "role"], LABELS, "active", 86_400_000, 100)


ZONES = ("America/New_York", "Europe/Berlin", "Asia/Kolkata")
DAY0, SHIFT = "2024-03-07", 66 * 86400


@query(f"""WITH z AS (SELECT DISTINCT user_id, ['{"', '".join(ZONES)}'][user_id % 3 + 1] AS zone FROM events), d AS (SELECT user_id, zone, unnest([DATE '2024-03-08', DATE '2024-03-11', DATE '2024-03-12', DATE '2024-03-13', DATE '2024-03-14']) AS date FROM z),
w AS (SELECT user_id, date, epoch(timezone(zone, date + INTERVAL 9 HOUR))::BIGINT AS opens, epoch(timezone(zone, date + INTERVAL 17 HOUR))::BIGINT AS closes FROM d),
b AS (SELECT user_id, t + {SHIFT} - 900 AS s, t + {SHIFT} + 900 + (event_id % 5) * 1800 AS e FROM {EV} WHERE event_id % 3 = 0),
i AS (SELECT w.user_id, date, greatest(s, opens) AS s, least(e, closes) AS e, closes FROM w JOIN b ON b.user_id = w.user_id AND e > opens AND s < closes UNION ALL SELECT user_id, date, opens, opens, closes FROM w UNION ALL SELECT user_id, date, closes, closes, closes FROM w),
n AS (SELECT *, max(e) OVER (PARTITION BY user_id, date ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
SELECT DISTINCT user_id, date, before AS free_from, s AS free_to FROM n WHERE s - before >= 1800""")
def availability_windows(spark, d):
    """Free half hours and more of the next five working days, by the clock of each user's zone."""
    at = timed(spark, d)
    zone = F.get(F.array(*map(F.lit, ZONES)), (F.col("user_id") % 3).cast("int"))
    people = at.select("user_id").distinct().select("user_id", zone.alias("zone"), F.lit(DAY0).cast("date").alias("today"))
    busy = at.where("event_id % 3 = 0").select("user_id", (F.col("t") + SHIFT).alias("s"), (F.col("t") + SHIFT + (F.col("event_id") % 5) * 1800).alias("e"))
    days = intervals.workdays(people, "today", "zone", [0, 1, 2, 3, 4], 5, "09:00", "17:00")
    return intervals.availability(busy, days, "user_id", "s", "e", 900, 1800)


# ---- samples

COMBOS = (("long_en", "lang = 'en' AND n_chars > 1500"), ("with_the", "contains(lower(text), ' the ')"), ("src0", "source = 'src0'"), ("any", "true"), ("src0_again", "source = 'src0'"))
PER_COMBO = 25


def _sample_sql() -> str:
    out = "WITH "
    for i, (name, fits) in enumerate(COMBOS):
        taken = "".join(f" AND doc_id NOT IN (SELECT doc_id FROM c{k})" for k in range(i))
        out += f"c{i} AS (SELECT '{name}' AS combo, doc_id, row_number() OVER (ORDER BY h, doc_id) AS place FROM (SELECT DISTINCT doc_id, sha256('17:{i}:{name}|' || doc_id) AS h FROM documents WHERE {fits}{taken}) ORDER BY h, doc_id LIMIT {PER_COMBO}), "
    return out.rstrip(", ") + " " + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(COMBOS)))


@query(_sample_sql())
def sample_without_replacement(spark, d):
    """A sampling operator: some documents for each combination of conditions, none of them twice."""
    docs = table(spark, d, "documents")
    return select.sampled_once(docs, "doc_id", [(name, F.expr(fits)) for name, fits in COMBOS], PER_COMBO, "17")
