"""A tracker's rows by all the flags of its filter, over orders as applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import select
from siftline.plans.queries import query, table

STATUSES = ("drafted", "applied", "rejected", "ignored", "in_progress")
WORK, FIT, STATES = ("onsite", "hybrid", "remote", None), ("strong", None, "Medium"), ("scheduled", "unknown", "waiting_employer")
FILTERS = {
    "status": {"status": ["Applied", "in_progress"]}, "company": {"company": ["#00000001", "99"]}, "role": {"role": ["urgent"]}, "location": {"location": ["furni", "auto"]}, "phase": {"phase": ["offer"]}, "progress_state": {"progress_state": ["scheduled"]},
    "slug": {"slug": ["-7"]}, "channel": {"channel": ["LOW", "high"]}, "workplace": {"workplace": ["remote", "hybrid"]}, "sponsorship": {"sponsorship": ["likely"]}, "fit": {"fit": ["medium"]}, "level": {"min_level": 4, "max_level": 5}, "min_level": {"min_level": 6},
    "max_level": {"max_level": 3}, "salary": {"min_salary": 150000}, "yoe": {"max_yoe": 3}, "posted_after": {"posted_after": "1998-01-01"}, "since": {"since": "1999-06-01"}, "none": {},
    "all": {"status": ["applied", "rejected"], "company": ["customer"], "workplace": ["remote", "hybrid", "onsite"], "min_level": 3, "max_level": 6, "min_salary": 60000, "max_yoe": 8, "posted_after": "1996-01-01", "channel": ["1", "2", "3"]},
}
_LIST = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _matches_sql(flags: dict) -> str:
    out = ["true"]
    for name, v in flags.items():
        if name in select.MEMBERS:
            out.append(f"coalesce(lower({name}) IN ({', '.join(repr(x.lower()) for x in v)}), false)")
        elif name in select.PARTS:
            out.append("(" + " OR ".join(f"coalesce(contains(lower({name}), {x.lower()!r}), false)" for x in v) + ")")
    lo, hi = flags.get("min_level"), flags.get("max_level")
    if lo is not None or hi is not None:
        out.append(f"NOT (level_min IS NULL AND level_max IS NULL) AND coalesce(level_max, 999) >= {lo if lo is not None else -999} AND coalesce(level_min, -999) <= {hi if hi is not None else 999}")
    if "min_salary" in flags:
        out.append(f"coalesce(coalesce(salary_max, salary_min) >= {flags['min_salary']}, false)")
    if "max_yoe" in flags:
        out.append(f"(yoe_min IS NULL OR yoe_min <= {flags['max_yoe']})")
    for name, column in (("posted_after", "posted"), ("since", "researched")):
        if name in flags:
            out.append(f"{column} IS NOT NULL AND {column} >= DATE '{flags[name]}'")
    return " AND ".join(out)


@query(f"""WITH r AS (SELECT o_orderkey, {_LIST(STATUSES)}[o_orderkey % 5 + 1] AS status, c_name AS company, o_orderpriority AS role, c_mktsegment AS location, CASE WHEN o_custkey % 4 = 0 THEN 'offer' ELSE 'other' END AS phase, {_LIST(STATES)}[o_orderkey % 3 + 1] AS progress_state,
  'app-' || o_custkey AS slug, o_orderpriority AS channel, {_LIST(WORK)}[o_orderkey % 4 + 1] AS workplace, CASE WHEN o_orderkey % 7 < 3 THEN 'likely' ELSE 'unknown' END AS sponsorship, {_LIST(FIT)}[o_orderkey % 3 + 1] AS fit, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 6 + 2 END AS level_min,
  CASE WHEN o_orderkey % 8 > 1 THEN o_orderkey % 6 + 3 END AS level_max, CASE WHEN o_orderkey % 3 > 0 THEN floor(o_totalprice / 2)::BIGINT END AS salary_min, CASE WHEN o_orderkey % 5 > 1 THEN floor(o_totalprice)::BIGINT END AS salary_max, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 9 END AS yoe_min,
  CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate::DATE END AS posted, CASE WHEN o_orderkey % 10 > 0 THEN (o_orderdate + INTERVAL 30 DAY)::DATE END AS researched FROM orders JOIN customer ON c_custkey = o_custkey)
""" + " UNION ALL ".join(f"SELECT '{name}' AS filter, o_orderkey FROM r WHERE {_matches_sql(flags)}" for name, flags in FILTERS.items()))
def tracker_filter(spark, d):
    """Applications by each flag of the filter alone, by none, and by many together."""
    key = F.col("o_orderkey")
    pick = lambda values, by: F.get(F.array(*[F.lit(v).cast("string") for v in values]), by.cast("int"))
    at = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", pick(STATUSES, key % 5).alias("status"), F.col("c_name").alias("company"), F.col("o_orderpriority").alias("role"), F.col("c_mktsegment").alias("location"), F.when(F.col("o_custkey") % 4 == 0, "offer").otherwise("other").alias("phase"),
        pick(STATES, key % 3).alias("progress_state"), F.concat(F.lit("app-"), F.col("o_custkey").cast("string")).alias("slug"), F.col("o_orderpriority").alias("channel"), pick(WORK, key % 4).alias("workplace"), F.when(key % 7 < 3, "likely").otherwise("unknown").alias("sponsorship"),
        pick(FIT, key % 3).alias("fit"), F.when(key % 4 > 0, key % 6 + 2).alias("level_min"), F.when(key % 8 > 1, key % 6 + 3).alias("level_max"), F.when(key % 3 > 0, F.floor(F.col("o_totalprice") / 2)).alias("salary_min"), F.when(key % 5 > 1, F.floor("o_totalprice")).alias("salary_max"),
        F.when(key % 9 > 0, key % 9).alias("yoe_min"), F.when(key % 6 > 0, F.to_date("o_orderdate")).alias("posted"), F.when(key % 10 > 0, F.date_add(F.to_date("o_orderdate"), 30)).alias("researched"),
    )
    met = F.array_compact(F.array(*[F.when(select.matching(flags), F.lit(name)) for name, flags in FILTERS.items()]))
    return at.select(F.explode(met).alias("filter"), "o_orderkey")
