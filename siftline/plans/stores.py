"""Logs, payloads and buckets written, read back and checked, over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftline.operators import folds
from siftline.plans.queries import query, table
from siftline.shared import shared_dir
from siftline.sources import jsonl, manifests


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type FROM events")
def log_append_and_scan(spark, d):
    """Two appends to a log, read strictly."""
    at, events = folder(spark, "log"), table(spark, d, "events").select("event_id", "user_id", "event_type")
    for rest in (0, 1):
        jsonl.append(events.where(F.pmod("event_id", F.lit(2)) == rest), at)
    return jsonl.read_strict(spark, at, "event_id long, user_id long, event_type string").drop("_file")


@query("SELECT n_nationkey, n_name FROM nation")
def index_scan(spark, d):
    """Rows of an index without its header."""
    at = folder(spark, "index")
    rows = table(spark, d, "nation").select(F.lit(None).cast("string").alias("_schema"), "n_nationkey", "n_name")
    head = rows.limit(1).select(F.lit("index.v1").alias("_schema"), F.lit(None).cast("int").alias("n_nationkey"), F.lit(None).cast("string").alias("n_name"))
    jsonl.append(head.union(rows), at)
    return jsonl.read_index(spark, at, "n_nationkey int, n_name string")[0].drop("_file")


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"region":{"key":' || r_regionkey || ',"name":"' || r_name || '","note":null}}' AS value
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def canonical_rows(spark, d):
    region = F.struct(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("note"), F.col("r_regionkey").alias("key"))
    at = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return jsonl.canonical(at.select(region.alias("region"), "n_nationkey", "n_name"))


KINDS = ("greenhouse", "lever", "jobicy", "arbeitnow")


@query("""SELECT p_partkey::VARCHAR AS native_id, p_name AS title, 'https://x.org/' || p_partkey AS url, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE NULL END AS location,
['greenhouse', 'lever', 'jobicy', 'arbeitnow'][p_partkey % 4 + 1] AS source FROM part WHERE p_size % 5 <> 0""")
def payload_rows(spark, d):
    """Postings in payloads of four sources by brand; payloads that do not parse, of every fifth size, give none."""
    url = F.concat(F.lit("https://x.org/"), F.col("p_partkey").cast("string"))
    shapes = {
        "greenhouse": F.to_json(F.struct(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), url.alias("absolute_url"), F.struct(F.col("p_brand").alias("name")).alias("location"))).alias("jobs"))),
        "lever": F.to_json(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), url.alias("hostedUrl")))),
        "jobicy": F.to_json(F.struct(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("jobTitle"), url.alias("url"))).alias("jobs"))),
        "arbeitnow": F.to_json(F.struct(F.collect_list(F.struct(F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"), url.alias("url"))).alias("data"))),
    }
    parts = table(spark, d, "part").withColumn("kind", F.pmod("p_partkey", F.lit(len(KINDS))))
    made = None
    for k, name in enumerate(KINDS):
        one = parts.where(F.col("kind") == k).groupBy("p_brand", "p_size").agg(shapes[name].alias("body")).withColumn("source", F.lit(name))
        made = one if made is None else made.unionByName(one)
    torn = F.when(F.col("p_size") % 5 == 0, F.substring("body", 1, 9)).otherwise(F.col("body"))
    return manifests.parse(made.select("source", torn.alias("body"))).select("native_id", "title", "url", "location", "source")


@query("SELECT sha256(text) AS hash, max((doc_id % 3 = 0)::INT) = 1 AS first, any_value(length(text))::BIGINT AS size FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_addressed_write(spark, d):
    """Two writes of texts by their hash, the second of all texts: what the store has is not written again."""
    at, docs = folder(spark, "blobs"), table(spark, d, "documents").where("text is not null")
    none = spark.createDataFrame([], "hash string")
    manifests.write_blobs(manifests.new_blobs(docs.where("doc_id % 3 = 0"), none, "text").withColumn("first", F.lit(True)), at)
    manifests.write_blobs(manifests.new_blobs(docs, spark.read.parquet(at), "text").withColumn("first", F.lit(False)), at)
    return spark.read.parquet(at).select("hash", "first", F.length("content").cast("long").alias("size"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 7 = 0 THEN '' ELSE ts::DATE::VARCHAR END, event_id::VARCHAR) AS place FROM events WHERE event_id % 5 <> 2")
def canonical_manifests(spark, d):
    """Each entity's manifests in an order that arrival does not change; some have no time, some no entity."""
    events = table(spark, d, "events")
    at = events.select("event_id", F.when(F.col("event_id") % 5 != 2, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 7 != 0, F.to_date("ts")).alias("fetched_at"))
    return folds.canonical_order(at, "user_id", "fetched_at", "event_id").select("event_id", "user_id", F.col("place").cast("long").alias("place"))


@query("""SELECT hash, CASE WHEN max(CASE WHEN m = 0 THEN 1 ELSE 0 END) = 1 THEN 'present' WHEN max(CASE WHEN m = 1 THEN 1 ELSE 0 END) = 1 THEN 'corrupt' WHEN max(CASE WHEN m = 2 THEN 1 ELSE 0 END) = 1 THEN 'pruned' ELSE 'not-synced' END AS state
FROM (SELECT sha256(text) AS hash, doc_id % 4 AS m FROM documents WHERE text IS NOT NULL) GROUP BY hash""")
def blob_four_states(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.pmod("doc_id", F.lit(4)).alias("m"))
    found = docs.where("m < 2").select("hash", F.when(F.col("m") == 0, "present").otherwise("corrupt").alias("state"))
    return manifests.blob_states(docs, found, docs.where("m = 2"))


@query("""SELECT o_orderkey, rule FROM (SELECT o_orderkey, 'price' AS rule FROM orders WHERE NOT coalesce(o_totalprice BETWEEN 1000 AND 400000, false)
UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false) UNION ALL SELECT o_orderkey, 'customer' FROM orders WHERE NOT coalesce(o_custkey % 7 <> 0, false))""")
def schema_violations(spark, d):
    rules = {"price": F.col("o_totalprice").between(1000, 400000), "status": F.col("o_orderstatus").isin("F", "O"), "customer": F.col("o_custkey") % 7 != 0}
    return manifests.violations(table(spark, d, "orders"), "o_orderkey", rules)


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_nationkey = 3 THEN 'rejected' ELSE 'imported' END AS outcome FROM customer")
def import_with_row_errors(spark, d):
    good, errors = manifests.imported(table(spark, d, "customer"), "c_custkey", {"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey") != 3})
    rejected = errors.select("c_custkey", F.lit("rejected").alias("outcome")).distinct()
    return good.select("c_custkey", F.lit("imported").alias("outcome")).union(rejected)


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND (event_type <> 'click' OR value > 50)")
def bucketed_sink(spark, d):
    """A bucket is replaced, one that has become empty loses its folder, the others stay."""
    at, events = folder(spark, "buckets"), table(spark, d, "events").select("event_id", "event_type", "value")
    manifests.write_partitioned(events, at, "event_type")
    touched = spark.createDataFrame([("click",), ("error",)], "event_type string")
    manifests.write_partitioned(events.where("event_type = 'click' and value > 50"), at, "event_type", touched)
    return spark.read.parquet(at).select("event_id", "event_type")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 <> 0")
def index_with_durable_floor(spark, d):
    at = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return manifests.durable_index(at.where("s_suppkey % 3 = 0").withColumn("s_name", F.lit("new")), at, at.where("s_suppkey % 5 = 0"), "s_suppkey")


@query("SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') AS local FROM events")
def zone_conversion(spark, d):
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return table(spark, d, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local"))
