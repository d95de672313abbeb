"""Further named queries: calendars, rollups, overlays, carry-over and text checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline.plans.queries import query, table

TS = "epoch(date_trunc('second', ts))::BIGINT"


@query("SELECT event_id, strftime(ts, '%G-W%V') AS week, date_trunc('week', ts)::DATE AS monday FROM events")
def iso_week_label(spark, d):
    at = F.col("ts").cast("timestamp")
    year, week = F.date_part(F.lit("YEAROFWEEK"), at), F.lpad(F.weekofyear(at).cast("string"), 2, "0")
    return table(spark, d, "events").select("event_id", F.concat(year.cast("string"), F.lit("-W"), week).alias("week"), F.date_trunc("week", at).cast("date").alias("monday"))


@query("""WITH a AS (SELECT o_orderkey, o_orderdate::DATE AS day, isodow(o_orderdate) AS w FROM orders)
SELECT o_orderkey, (day + CASE WHEN w <= 5 THEN 7 WHEN w = 6 THEN 6 ELSE 5 END::INT)::DATE AS horizon FROM a""")
def business_day_horizon(spark, d):
    """Five business days on; from a day of a weekend that is the next Friday."""
    day = F.col("o_orderdate").cast("date")
    w = F.weekday(day)  # Monday is 0
    on = F.when(w <= 4, 7).when(w == 5, 6).otherwise(5)
    return table(spark, d, "orders").select("o_orderkey", F.date_add(day, on).alias("horizon"))


@query("""SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5('11|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3""")
def seeded_sample_per_group(spark, d):
    """A sampling operator: three rows of each (source, lang) in the order of a seeded hash."""
    key = F.struct(F.md5(F.concat(F.lit("11|"), F.col("doc_id").cast("string"))).alias("h"), "doc_id")
    w = Window.partitionBy("source", "lang").orderBy(key)
    return table(spark, d, "documents").select("source", "lang", "doc_id").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("""SELECT conv_id, turn, last_value(CASE WHEN length(text) % 3 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS link FROM conversations""")
def thread_link_inheritance(spark, d):
    """A message has the link of the last one in its thread that has one."""
    own = F.when(F.length("text") % 3 == 0, F.col("turn"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(own, True).over(w).alias("link"))


@query("""WITH delta AS (SELECT DISTINCT user_id FROM events WHERE event_id % 97 = 0), days AS (SELECT DISTINCT ts::DATE AS day FROM events SEMI JOIN delta USING (user_id))
SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts::DATE IN (SELECT day FROM days) GROUP BY 1""")
def bucket_closure(spark, d):
    """Day buckets that a delta's entities ever touched, folded anew."""
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"))
    delta = events.where("event_id % 97 = 0").select("user_id").distinct()
    days = events.join(delta, "user_id", "left_semi").select("day").distinct()
    return events.join(days, "day", "left_semi").groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""SELECT user_id, ts::DATE AS day, max(event_id) FILTER (WHERE event_id % 3 > 0) IS NULL AS carried, coalesce(max(event_id) FILTER (WHERE event_id % 3 > 0), max(event_id)) AS seq FROM events GROUP BY ALL""")
def carry_forward(spark, d):
    """Entities whose raw rows are gone keep what the last fold had."""
    events = table(spark, d, "events")
    fresh = F.max(F.when(F.col("event_id") % 3 > 0, F.col("event_id")))
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(fresh.isNull().alias("carried"), F.coalesce(fresh, F.max("event_id")).alias("seq"))


@query("SELECT user_id, event_type, ts::DATE AS day, min(event_id) AS event_id FROM events GROUP BY ALL")
def event_idempotence(spark, d):
    """One event of each (entity, kind, day): the first, however often a log is replayed."""
    log = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "event_id")
    return log.union(log).groupBy("user_id", "event_type", "day").agg(F.min("event_id").alias("event_id"))


@query("""SELECT p_brand, p_size > 9 AS large, CASE WHEN max(p_size * 1500) <= 10 * min(p_size * 1000) THEN min(p_size * 1000) END AS lo, CASE WHEN max(p_size * 1500) <= 10 * min(p_size * 1000) THEN max(p_size * 1500) END AS hi FROM part GROUP BY p_brand, large""")
def band_envelope(spark, d):
    """Least lower and greatest upper bound of all bands, unless they lie too far apart."""
    lo, hi = F.min(F.col("p_size") * 1000), F.max(F.col("p_size") * 1500)
    return table(spark, d, "part").groupBy("p_brand", (F.col("p_size") > 9).alias("large")).agg(F.when(hi <= 10 * lo, lo).alias("lo"), F.when(hi <= 10 * lo, hi).alias("hi"))


ORDER = ("error", "purchase", "signup", "click", "view")


@query("SELECT user_id, day, coalesce(['error', 'purchase', 'signup', 'click', 'view'][min(CASE WHEN value IS NOT NULL AND event_id % 4 <> 0 THEN list_position(['error', 'purchase', 'signup', 'click', 'view'], event_type) END)], 'none') AS status FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY user_id, day")
def precedence_rollup(spark, d):
    """The first status, in order of precedence, that any settled row of the entity has; none without one."""
    names = F.array(*map(F.lit, ORDER))
    settled = F.col("value").isNotNull() & (F.col("event_id") % 4 != 0)
    place = F.min(F.when(settled, F.array_position(names, F.col("event_type")))).alias("p")
    status = F.coalesce(F.when(F.col("p").isNotNull(), F.element_at(names, F.col("p").cast("int"))), F.lit("none"))
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(place).select("user_id", "day", status.alias("status"))


@query("""SELECT count(*) AS n, count_if(c_custkey IS NOT NULL) AS keyed, count_if(c_name IS NULL OR NOT regexp_matches(c_name, '^Customer#[0-9]*[0-8]$')) AS malformed, count_if(o.k IS NULL) AS unresolved FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000) o ON k = c_custkey""")
def coverage_numbers(spark, d):
    seen = table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("k")).distinct()
    at = table(spark, d, "customer").join(seen, F.col("c_custkey") == F.col("k"), "left")
    bad = F.col("c_name").isNull() | ~F.col("c_name").rlike("^Customer#[0-9]*[0-8]$")
    return at.agg(F.count("*").alias("n"), F.count("c_custkey").alias("keyed"), F.count_if(bad).alias("malformed"), F.count_if(F.col("k").isNull()).alias("unresolved"))


@query("SELECT p_partkey, count(l_partkey)::BIGINT AS refs, count_if(l_quantity > 45 AND l_returnflag = 'A') AS live, count_if(l_quantity > 45 AND l_returnflag = 'A') = 0 AS orphan FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def ref_count_orphans(spark, d):
    """All references to each part, those that are live, and whether none is."""
    live = F.count_if((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "A"))
    refs = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("refs"), live.alias("live"))
    n = {c: F.coalesce(c, F.lit(0)) for c in ("refs", "live")}
    return table(spark, d, "part").select("p_partkey").join(refs, "p_partkey", "left").select("p_partkey", *[c.alias(x) for x, c in n.items()], (n["live"] == 0).alias("orphan"))


@query("""WITH old AS (SELECT o_custkey AS k, max(o_orderdate)::DATE AS last, count(*) AS n FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1), new AS (SELECT o_custkey AS k, max(o_orderdate)::DATE AS last, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT k, greatest(coalesce(old.last, new.last), coalesce(new.last, old.last)) AS last, coalesce(old.n, 0) + coalesce(new.n, 0) AS n FROM old FULL JOIN new USING (k)""")
def upsert_merge(spark, d):
    """A log of last searches merged with a batch: later dates win, counts add up."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    fold = lambda x: x.groupBy("k").agg(F.max("day").alias("last"), F.count("*").alias("n"))
    return fold(rows.where("o_orderkey % 5 > 0")).union(fold(rows.where("o_orderkey % 5 = 0"))).groupBy("k").agg(F.max("last").alias("last"), F.sum("n").alias("n"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'human' ELSE 'machine' END AS won, CASE WHEN s_suppkey % 4 = 0 THEN 'checked ' || s_suppkey ELSE s_name END AS name FROM supplier""")
def annotation_overlay(spark, d):
    """What a person has noted wins over what was found."""
    found = table(spark, d, "supplier").select("s_suppkey", "s_name")
    notes = found.where("s_suppkey % 4 = 0").select("s_suppkey", F.concat(F.lit("checked "), F.col("s_suppkey").cast("string")).alias("note"))
    return found.join(notes, "s_suppkey", "left").select("s_suppkey", F.when(F.col("note").isNull(), "machine").otherwise("human").alias("won"), F.coalesce("note", "s_name").alias("name"))


@query("""SELECT o_orderstatus, o_orderdate < TIMESTAMP '1996-01-01' AS past, count(*) AS n, count_if(o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1995-12-01') AS overdue FROM orders GROUP BY ALL""")
def upcoming_past_overdue(spark, d):
    at = F.col("o_orderdate")
    waiting = (F.col("o_orderstatus") == "O") & (at < F.lit("1995-12-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").groupBy("o_orderstatus", (at < F.lit("1996-01-01").cast("timestamp_ntz")).alias("past")).agg(F.count("*").alias("n"), F.count_if(waiting).alias("overdue"))


@query(f"""SELECT user_id, arg_max(event_id, ({TS}, event_id)) AS pointer, max({TS}) AS at, max({TS}) < (SELECT max({TS}) FROM events) - 86400 AS stale FROM events GROUP BY user_id""")
def latest_pointer(spark, d):
    """The newest snapshot of each owner, and whether it is older than a day."""
    at = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    now = at.agg(F.max("t").alias("now"))  # one row
    last = at.groupBy("user_id").agg(F.max_by("event_id", F.struct("t", "event_id")).alias("pointer"), F.max("t").alias("at"))
    return last.join(F.broadcast(now)).select("user_id", "pointer", "at", (F.col("at") < F.col("now") - 86400).alias("stale"))


@query("""SELECT doc_id, strpos(lower(text), 'the') AS place, CASE WHEN strpos(lower(text), 'the') > 0 THEN substring(text, greatest(1, strpos(lower(text), 'the') - 10)::INT, 30) END AS excerpt FROM documents""")
def excerpt_around_marker(spark, d):
    at = F.locate("the", F.lower("text")).cast("long")
    return table(spark, d, "documents").select("doc_id", at.alias("place"), F.when(at > 0, F.col("text").substr(F.greatest(F.lit(1), at.cast("int") - 10), F.lit(30))).alias("excerpt"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])ing([^a-z0-9]|$)') THEN 'boundary' WHEN contains(lower(text), 'ing') THEN 'substring' ELSE 'none' END AS leak FROM documents""")
def token_leak_class(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").select("doc_id", F.when(low.rlike("(^|[^a-z0-9])ing([^a-z0-9]|$)"), "boundary").when(F.contains(low, F.lit("ing")), "substring").otherwise("none").alias("leak"))


@query("SELECT event_type, 'phase-' || substring(sha256(event_type), 1, 12) AS label, count(*) AS n FROM events GROUP BY event_type")
def redacted_phase_names(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.concat(F.lit("phase-"), F.substring(F.sha2("event_type", 256), 1, 12)).alias("label"), "n")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count_if(round(l_extendedprice / l_quantity, 2) = p_retailprice) AS same, count_if(p_retailprice IS NULL) AS missing FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def field_fidelity(spark, d):
    """Raw against generated fields by native id, as a cross table."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    at = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("each"))
    return at.join(parts, "l_partkey", "left").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("each") == F.col("p_retailprice")).alias("same"), F.count_if(F.col("p_retailprice").isNull()).alias("missing")
    )


@query("""WITH hosts AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h FROM pages), known AS (SELECT unnest(['example.com', 'example.org', 'blog.example.com', 'example.net']) AS dom),
m AS (SELECT page_id, dom FROM hosts JOIN known ON h = dom OR ends_with(h, '.' || dom)) SELECT page_id, CASE WHEN count(*) = 1 THEN min(dom) END AS dom FROM m GROUP BY page_id""")
def domain_suffix_match(spark, d):
    """The known domain that a host is or lies under, if there is one alone. Every suffix of a host is looked up: an equi-join."""
    known = spark.createDataFrame([("example.com",), ("example.org",), ("blog.example.com",), ("example.net",)], "dom string")
    h = F.split(F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_join(F.slice(h, i, F.size(h)), "."))
    at = table(spark, d, "pages").select("page_id", F.explode(suffixes).alias("dom")).join(F.broadcast(known), "dom")
    return at.groupBy("page_id").agg(F.when(F.count("*") == 1, F.min("dom")).alias("dom"))


@query("""SELECT user_id, list(event_type ORDER BY p)::VARCHAR AS kinds FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id""")
def stable_union(spark, d):
    """Kinds of each user in the order in which they came first."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("p"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("p", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(kinds, ", "), F.lit("]")).alias("kinds"))
