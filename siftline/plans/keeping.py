"""What a store keeps: the retention plan over orders as blobs, line items as manifests and parts as entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import retention as R
from siftline.plans.queries import query, table

NOW = "2000-01-01"
TIERS = {"A": "board", "N": "search", "R": "board"}
RULES = {"board": {"any_of": [{"observed_older_than_days": 900}, {"all_of": [{"posting_older_than_days": 300}, {"observed_older_than_days": 500}]}]}, "search": {"observed_older_than_days": 700}}

STORES = """manifests AS (SELECT l_orderkey % 6 AS store, l_orderkey AS sha, l_orderkey * 8 + l_linenumber AS fetch_id, l_returnflag || CASE WHEN l_linenumber = 6 THEN '?' ELSE '' END AS operation, l_shipdate AS fetched_at,
  l_orderkey % 600 = 5 AND l_linenumber = 1 AS damaged FROM lineitem WHERE l_orderkey % 50 <> 0),
entities AS (SELECT l_orderkey % 6 AS store, l_orderkey * 8 + l_linenumber AS fetch_id, l_partkey AS key, CASE WHEN p_size <> 7 THEN TIMESTAMP '1998-01-01' + to_days(p_size * 20) END AS posted_at FROM lineitem JOIN part ON p_partkey = l_partkey),
blobs AS (SELECT o_orderkey % 6 AS store, o_orderkey AS sha, floor(o_totalprice)::BIGINT AS size FROM orders WHERE o_orderkey % 9 <> 0)"""


def stores(spark, d):
    lines, part, orders = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "orders")
    fetch = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fetch_id")
    store = (F.col("l_orderkey") % 6).alias("store")
    manifests = lines.where("l_orderkey % 50 <> 0").select(
        store, F.col("l_orderkey").alias("sha"), fetch, F.concat("l_returnflag", F.when(F.col("l_linenumber") == 6, "?").otherwise("")).alias("operation"), F.col("l_shipdate").alias("fetched_at"),
        ((F.col("l_orderkey") % 600 == 5) & (F.col("l_linenumber") == 1)).alias("damaged"),
    )
    posted = F.when(F.col("p_size") != 7, F.lit("1998-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("p_size") * 20))
    entities = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).select(store, fetch, F.col("l_partkey").alias("key"), posted.alias("posted_at"), F.lit(False).alias("damaged"))
    blobs = orders.where("o_orderkey % 9 <> 0").select((F.col("o_orderkey") % 6).alias("store"), F.col("o_orderkey").alias("sha"), F.floor("o_totalprice").cast("long").alias("size"))
    return blobs, manifests, entities


@query(f"""WITH {STORES},
harm AS (SELECT DISTINCT store FROM manifests WHERE damaged),
refs AS (SELECT DISTINCT store, sha, fetch_id, operation, fetched_at FROM manifests WHERE NOT damaged),
seen AS (SELECT store, sha, max(fetched_at) AS last_observed, count(*) AS n_refs, arg_min(operation, (fetched_at, fetch_id, operation)) AS op FROM refs GROUP BY store, sha),
fed AS (SELECT r.store, r.sha, max(e.posted_at) AS posting_date, count(DISTINCT e.key) AS n_entities FROM refs r JOIN entities e USING (store, fetch_id) GROUP BY r.store, r.sha),
each AS (SELECT r.store, r.sha, bool_and(coalesce(CASE WHEN operation IN ('A', 'R') THEN coalesce(last_observed < TIMESTAMP '{NOW}' - INTERVAL 900 DAY, false) OR (coalesce(posting_date < TIMESTAMP '{NOW}' - INTERVAL 300 DAY, false) AND coalesce(last_observed < TIMESTAMP '{NOW}' - INTERVAL 500 DAY, false))
  WHEN operation = 'N' THEN last_observed < TIMESTAMP '{NOW}' - INTERVAL 700 DAY END, false)) AS gone FROM refs r JOIN seen USING (store, sha) LEFT JOIN fed USING (store, sha) GROUP BY r.store, r.sha)
SELECT coalesce(b.store, s.store) AS store, coalesce(b.sha, s.sha) AS sha, CASE WHEN coalesce(b.store, s.store) IN (SELECT store FROM harm) THEN 'suspended' WHEN s.sha IS NULL THEN 'orphan' WHEN b.sha IS NULL THEN 'absent' WHEN gone THEN 'prunable' ELSE 'vetoed' END AS status,
  CASE op WHEN 'A' THEN 'board' WHEN 'R' THEN 'board' WHEN 'N' THEN 'search' END AS tier, CASE WHEN op IN ('A', 'R') THEN '(observed older than days older than 900d OR (posting older than days older than 300d AND observed older than days older than 500d))' WHEN op = 'N' THEN 'observed older than days older than 700d' ELSE 'never' END AS reason,
  size, posting_date, last_observed, coalesce(n_refs, 0) AS n_refs, coalesce(n_entities, 0) AS n_entities
FROM blobs b FULL JOIN seen s ON s.store = b.store AND s.sha = b.sha LEFT JOIN fed f ON f.store = s.store AND f.sha = s.sha LEFT JOIN each e ON e.store = s.store AND e.sha = s.sha""".replace("observed older than days older than", "last observed older than").replace("posting older than days older than", "posting date older than"))
def retention_plan(spark, d):
    """Every blob that is here or referred to, what becomes of it, and on what ground."""
    return R.plan(*stores(spark, d), TIERS, RULES, F.lit(NOW).cast("timestamp_ntz"))


@query(f"""WITH {STORES}, later AS (SELECT * FROM manifests UNION ALL SELECT sha % 6, sha, sha * 8, 'A', TIMESTAMP '1999-12-01', false FROM blobs WHERE sha % 4 = 0 UNION ALL SELECT 4, NULL, 1, 'A', NULL, true),
old AS (SELECT store, sha, bool_and(coalesce(CASE WHEN operation IN ('A', 'R') THEN lo < TIMESTAMP '{NOW}' - INTERVAL 900 DAY OR (posted < TIMESTAMP '{NOW}' - INTERVAL 300 DAY AND lo < TIMESTAMP '{NOW}' - INTERVAL 500 DAY) WHEN operation = 'N' THEN lo < TIMESTAMP '{NOW}' - INTERVAL 700 DAY END, false)) AS gone
  FROM (SELECT m.store, m.sha, operation, max(fetched_at) OVER (PARTITION BY m.store, m.sha) AS lo, max(posted_at) OVER (PARTITION BY m.store, m.sha) AS posted FROM manifests m LEFT JOIN entities e USING (store, fetch_id) WHERE NOT m.damaged) GROUP BY store, sha)
SELECT store, sha, CASE WHEN store = 4 THEN 'blocked' WHEN sha % 4 = 0 THEN 're_vetoed' ELSE 'delete' END AS action FROM old JOIN blobs USING (store, sha) WHERE gone AND store <> 5""")
def retention_sweep(spark, d):
    """What is deleted once manifests that came in since the plan, and damage since, are read again."""
    blobs, manifests, entities = stores(spark, d)
    now = F.lit(NOW).cast("timestamp_ntz")
    fresh = blobs.where("sha % 4 = 0").select("store", "sha", (F.col("sha") * 8).alias("fetch_id"), F.lit("A").alias("operation"), F.lit("1999-12-01").cast("timestamp_ntz").alias("fetched_at"), F.lit(False).alias("damaged"))
    broken = spark.createDataFrame([(4, None, 1, "A", None, True)], manifests.schema)
    after = manifests.unionByName(fresh).unionByName(broken)
    return R.swept(R.plan(blobs, manifests, entities, TIERS, RULES, now), R.plan(blobs, after, entities, TIERS, RULES, now))
