"""Selection, linking and posting rules over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.plans.queries import EV, URL_SQL, query, table, timed
from siftline.shared import stored


# ---- selection


@query("SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY user_id) WHERE list_contains(types, 'purchase')")
def array_membership(spark, d):
    types = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))  # five kinds at most
    return types.where(F.array_contains("types", "purchase")).select("user_id")


@query("SELECT o_orderkey, l_linenumber, try_cast(l_quantity AS BIGINT) AS quantity, o_orderstatus AS status FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def flatten_nested(spark, d):
    """Documents that hold their lines as an array, back to a row for each line."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("string").alias("quantity"))).alias("lines"))
    docs = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    at = docs.select("o_orderkey", F.explode("lines").alias("line"), F.col("o_orderstatus").alias("status"))
    return at.select("o_orderkey", "line.l_linenumber", F.col("line.quantity").try_cast("double").cast("long").alias("quantity"), "status")


SELECTORS = ("1", "7", "99", "CHINA", "china/2", "UNITED", "ASIA", "nowhere")


def selected(rows: DataFrame, selectors: DataFrame, rank: str, name: str, group: str) -> DataFrame:
    """Each selector with the rank that it means, or why it means none: a number is a rank, 'group/name' both, else a name or
    part of one, else a group. More than one row is an error, not a choice."""
    s = F.lower("selector")
    kind = F.when(s.rlike("^[0-9]+$"), F.col(rank).cast("string") == s).when(F.contains(s, F.lit("/")), F.concat_ws("/", F.lower(group), F.lower(name)) == s)
    hit = kind.otherwise(F.contains(F.lower(name), s) | (F.lower(group) == s))
    # the few selectors go to the rows, not the rows to them
    found = rows.join(F.broadcast(selectors), hit).groupBy("selector").agg(F.count("*").alias("n"), F.min(rank).alias("rank"))
    met = selectors.join(found, "selector", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    error = F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 0, F.when(F.col("selector").rlike("^[0-9]+$"), "out of range").otherwise("no match"))
    return met.select("selector", F.when(F.col("n") == 1, F.col("rank").cast("long")).alias("rank"), error.alias("error"))


@query("WITH s(selector) AS (VALUES " + ", ".join(f"('{x}')" for x in SELECTORS) + """), n AS (SELECT n_nationkey AS k, lower(n_name) AS a, lower(r_name) AS g FROM nation JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT selector, count(k) AS n, min(k)::BIGINT AS k FROM s LEFT JOIN n ON CASE WHEN regexp_matches(selector, '^[0-9]+$') THEN k::VARCHAR = selector WHEN contains(selector, '/') THEN g || '/' || a = lower(selector) ELSE contains(a, lower(selector)) OR g = lower(selector) END GROUP BY selector)
SELECT selector, CASE WHEN n = 1 THEN k END AS rank, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 0 AND regexp_matches(selector, '^[0-9]+$') THEN 'out of range' WHEN n = 0 THEN 'no match' END AS error FROM m""")
def row_selector(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return selected(nations, spark.createDataFrame([(x,) for x in SELECTORS], "selector string"), "n_nationkey", "n_name", "r_name")


@query(URL_SQL + """, n AS (SELECT DISTINCT url AS needle FROM e WHERE page_id % 40 = 0 UNION SELECT DISTINCT regexp_extract(url, '^[^:]*://[^/?]*', 0) FROM e WHERE page_id % 40 = 1),
m AS (SELECT needle, page_id, url = needle AS exact FROM n JOIN e ON contains(url, needle)) SELECT needle, page_id FROM (SELECT *, max(exact) OVER (PARTITION BY needle) AS any_exact FROM m) WHERE exact OR NOT any_exact""")
def exact_else_substring(spark, d):
    """Pages that a URL names: those whose canonical URL it is, or, only if there are none, those that contain it."""
    pages = table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))
    host = F.regexp_extract("url", "^[^:]*://[^/?]*", 0)
    needles = pages.where("page_id % 40 = 0").select(F.col("url").alias("needle")).union(pages.where("page_id % 40 = 1").select(host)).distinct()
    # a needle and what contains it have one host: the join is by host, not by all pairs
    met = needles.withColumn("host", F.regexp_extract("needle", "^[^:]*://[^/?]*", 0)).join(pages.withColumn("host", host), "host").where(F.contains("url", F.col("needle")))
    exact = F.col("url") == F.col("needle")
    any_exact = F.max(exact).over(Window.partitionBy("needle"))
    return met.withColumns({"exact": exact, "any": any_exact}).where("exact or not any").select("needle", "page_id")


WORDS = ("widget", "economy", "brand#1")


@query("SELECT p_partkey FROM part WHERE " + " AND ".join(f"contains(lower(concat_ws(chr(9), p_partkey, p_name, p_brand, p_type)), '{w}')" for w in WORDS[::2]))
def row_grep(spark, d):
    """Rows of which all words occur somewhere."""
    row = F.lower(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type"))
    hit = F.lit(True)
    for w in WORDS[::2]:
        hit &= F.contains(row, F.lit(w))
    return table(spark, d, "part").where(hit).select("p_partkey")


FIELDS = ("p_name", "p_brand", "p_type")


@query("SELECT p_partkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(f{i}, {chr(39)}{w}{chr(39)})' for w in WORDS)} THEN '{f}' END" for i, f in enumerate(FIELDS)) + "], lambda x: x IS NOT NULL), ',') AS matched FROM (SELECT *, "
       + ", ".join(f"trim(regexp_replace(lower({f}), '\\s+', ' ', 'g')) AS f{i}" for i, f in enumerate(FIELDS)) + ") FROM part) ".replace(") FROM part) ", " FROM part) ") + "WHERE " + " AND ".join(f"contains(f0 || chr(10) || f1 || chr(10) || f2, '{w}')" for w in WORDS[:2]))
def multi_field_search(spark, d):
    """Rows that hold every literal in some field, with the fields that any literal is in."""
    folded = [F.trim(F.regexp_replace(F.lower(f), r"\s+", " ")) for f in FIELDS]
    whole, hit = F.concat_ws("\n", *folded), F.lit(True)
    for w in WORDS[:2]:
        hit &= F.contains(whole, F.lit(w))
    any_in = lambda x: F.exists(F.array(*map(F.lit, WORDS)), lambda w: F.contains(x, w))
    matched = F.array_compact(F.array(*[F.when(any_in(x), F.lit(f)) for f, x in zip(FIELDS, folded)]))
    return table(spark, d, "part").where(hit).select("p_partkey", F.array_join(matched, ",").alias("matched"))


HARD, INCLUDE, SOFT = ("promo", "polished"), ("steel", "brass"), ("standard", "small", "anodized")


def title_verdict(x: Column, hard, include, soft) -> Column:
    """drop, keep or review: a hard word drops, else a wanted word keeps, else a soft word asks for a look; else keep."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.concat(F.lit(" "), F.lower(x), F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" "))))
    return F.when(has(hard), "drop").when(has(include), "keep").when(has(soft), "review").otherwise("keep")


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(' ' || lower(p_type) || ' ', ' {w} ')" for w in words) + ")"


@query(f"SELECT p_partkey, CASE WHEN {_any(HARD)} THEN 'drop' WHEN {_any(INCLUDE)} THEN 'keep' WHEN {_any(SOFT)} THEN 'review' ELSE 'keep' END AS verdict FROM part")
def title_word_classes(spark, d):
    return table(spark, d, "part").select("p_partkey", title_verdict(F.col("p_type"), HARD, INCLUDE, SOFT).alias("verdict"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND r_name <> 'AMERICA' THEN 'suppressed' ELSE 'kept' END AS side FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def foreign_suppression(spark, d):
    """Rows of one segment that are plainly elsewhere go to a side output; those of other segments stay whatever their place."""
    at = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    side = F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("r_name") != "AMERICA"), "suppressed").otherwise("kept")
    return at.select("c_custkey", side.alias("side"))


def without_content(df: DataFrame, content=("text", "html", "body")) -> DataFrame:
    """``df``, or an error if it carries a content column."""
    found = sorted(set(c.lower() for c in df.columns) & set(content))
    if found:
        raise ValueError(f"content columns in a projection that must have none: {found}")
    return df


@query("SELECT doc_id, lang, source, length(text)::BIGINT AS size, left(sha256(text), 12) AS digest FROM documents")
def content_free_projection(spark, d):
    return without_content(table(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").cast("long").alias("size"), F.substring(F.sha2("text", 256), 1, 12).alias("digest")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY (o_custkey % 50), o_orderkey LIMIT 100")
def sort_by_seq_and_key(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_custkey") % 50, "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("WITH c AS (SELECT p_brand AS term, count(*) AS n FROM part GROUP BY p_brand), t AS (SELECT * FROM c ORDER BY n DESC, term LIMIT 5) SELECT term, n FROM t UNION ALL SELECT 'others', (SELECT sum(n) FROM c)::BIGINT - (SELECT sum(n) FROM t)::BIGINT")
def topk_with_remainder(spark, d):
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("term")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "term").limit(5)
    both = counts.agg(F.sum("n").alias("a")).crossJoin(top.agg(F.sum("n").alias("b")))  # one row each
    return top.union(both.select(F.lit("others"), F.col("a") - F.col("b")))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN regexp_matches(props, '[0-9][0-9]') THEN regexp_extract(props, '[0-9]+')::BIGINT END NULLS LAST, event_id) AS place FROM events")
def schedule_order(spark, d):
    """Each user's rows by what is parsed from the text; what does not parse comes last."""
    parsed = F.when(F.col("props").rlike("[0-9][0-9]"), F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(parsed.asc_nulls_last(), "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", place.cast("long").alias("place"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_orderkey FROM r WHERE o_orderstatus <> 'O' OR n <= 2")
def review_lane_cap(spark, d):
    """Each customer's rows of the review lane are capped; other lanes are not."""
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("o_orderstatus <> 'O' or n <= 2").select("o_orderkey")


# ---- links


KEYED = "(SELECT {0} AS id, unnest([n_name || '/' || (round({1} / 100))::BIGINT, {2}]) AS k FROM {3} JOIN nation ON {4} = n_nationkey)"


@query(f"SELECT DISTINCT a.id AS c_custkey, b.id AS s_suppkey FROM {KEYED.format('c_custkey', 'floor(c_acctbal)', 'right(c_name, 6)', 'customer', 'c_nationkey')} a JOIN {KEYED.format('s_suppkey', 'floor(s_acctbal)', 'right(s_name, 6)', 'supplier', 's_nationkey')} b ON a.k = b.k")
def match_key_intersection(spark, d):
    """Entities that have any alias in common, each pair once: it comes from the first alias that both have, so pairs are not compared again."""
    def keyed(name: str, p: str, key: str, own: str) -> DataFrame:
        at = table(spark, d, name).join(F.broadcast(table(spark, d, "nation")), F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        place = F.concat_ws("/", "n_name", F.round(F.floor(f"{p}_acctbal") / 100).cast("long").cast("string"))
        aliases = F.array_compact(F.array(place, F.substring(f"{p}_name", -6, 6)))
        at = at.select(key, aliases.alias("k")).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("k"))).alias(own))
        return at.select(key, own, F.explode(own).alias("k"))

    met = keyed("customer", "c", "c_custkey", "a").join(keyed("supplier", "s", "s_suppkey", "b"), "k")
    return met.where(F.col("k") == F.array_min(F.array_intersect("a", "b"))).select("c_custkey", "s_suppkey")


@query(URL_SQL + ", h AS (SELECT page_id, url, regexp_extract(url, '^[^:]*://([^/?]*)', 1) AS host FROM e), k AS (SELECT * FROM h WHERE page_id % 3 = 0) SELECT page_id, CASE WHEN url IN (SELECT url FROM k) THEN 'url' WHEN host IN (SELECT host FROM k) THEN 'company' ELSE 'none' END AS coverage FROM h")
def coverage_join(spark, d):
    """What a known set covers: the same canonical URL, else the same host, else nothing."""
    h = table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url")).withColumn("host", F.regexp_extract("url", "^[^:]*://([^/?]*)", 1))
    known = h.where("page_id % 3 = 0")
    at = h.join(known.select("url", F.lit(1).alias("u")).distinct(), "url", "left").join(known.select("host", F.lit(1).alias("c")).distinct(), "host", "left")
    return at.select("page_id", F.when(F.col("u") == 1, "url").when(F.col("c") == 1, "company").otherwise("none").alias("coverage"))


@query(URL_SQL + ", k AS (SELECT url, 'key-' || min(page_id) AS store_key FROM e WHERE page_id % 2 = 0 GROUP BY url) SELECT page_id, store_key FROM e LEFT JOIN k USING (url)")
def store_key_threading(spark, d):
    """Kept rows with the key that the store has for their canonical URL, if any."""
    at = table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))
    keys = at.where("page_id % 2 = 0").groupBy("url").agg(F.concat(F.lit("key-"), F.min("page_id").cast("string")).alias("store_key"))
    return at.join(keys, "url", "left").select("page_id", "store_key")


@query("SELECT p_partkey, CASE WHEN count(DISTINCT l_orderkey) = 1 THEN min(l_orderkey) END AS holder, CASE count(DISTINCT l_orderkey) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS holders FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 6) ON l_partkey = p_partkey GROUP BY p_partkey")
def one_holder(spark, d):
    """An item's holder, where exactly one refers to it."""
    at = table(spark, d, "part").join(table(spark, d, "lineitem").where("l_linenumber = 6"), F.col("l_partkey") == F.col("p_partkey"), "left")
    n, lo, hi = F.count("l_orderkey"), F.min("l_orderkey"), F.max("l_orderkey")
    return at.groupBy("p_partkey").agg(F.when(lo == hi, lo).alias("holder"), F.when(n == 0, "none").when(lo == hi, "one").otherwise("several").alias("holders"))


LICENSED = (("gh", "lever"), ("lever", "wd"))


@query("WITH k AS (SELECT p_partkey, p_brand, p_type, p_size, ['gh', 'lever', 'wd'][p_partkey % 3 + 1] AS ats FROM part) SELECT a.p_partkey AS old_key, b.p_partkey AS new_key FROM k a JOIN k b USING (p_brand, p_type, p_size) WHERE (a.ats = 'gh' AND b.ats = 'lever') OR (a.ats = 'lever' AND b.ats = 'wd')")
def migration_links(spark, d):
    """The same posting under two systems, where a move between these two is licensed."""
    ats = F.element_at(F.array(F.lit("gh"), F.lit("lever"), F.lit("wd")), (F.col("p_partkey") % 3 + 1).cast("int"))
    k = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", ats.alias("ats"))
    moves = F.create_map(*[F.lit(x) for p in LICENSED for x in p])
    a = k.select(F.col("p_partkey").alias("old_key"), "p_brand", "p_type", "p_size", moves[F.col("ats")].alias("ats")).where("ats is not null")
    return a.join(k.withColumnRenamed("p_partkey", "new_key"), ["p_brand", "p_type", "p_size", "ats"]).select("old_key", "new_key")


def ancestry(parents: DataFrame) -> DataFrame:
    """(id, root, depth, cyclic) by doubling: after each round a pointer spans twice as many steps. A line of any length ends: as long as one
    does, each round settles some of it, so what a round leaves as it was runs in a circle."""
    at = parents.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent", "id").alias("root"))
    open_ = None
    while open_ != (open_ := at.where("up is not null").count()):
        above = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("root").alias("root2"))
        at = at.join(above, "up", "left").select("id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("root2", "root").alias("root"))
        at = stored(at, "ancestry")
    cyclic = F.col("up").isNotNull()
    return at.select("id", F.when(~cyclic, F.col("root")).alias("root"), F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic"))


@query("""WITH RECURSIVE p AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 0 THEN NULL WHEN n_nationkey = 11 THEN 23 ELSE n_nationkey // 2 END::BIGINT AS parent FROM nation),
w AS (SELECT id, id AS here, 0::BIGINT AS depth FROM p UNION ALL SELECT w.id, p.parent, depth + 1 FROM w JOIN p ON p.id = w.here WHERE p.parent IS NOT NULL AND depth < 40)
SELECT id, CASE WHEN max(depth) < 40 THEN arg_max(here, depth) END AS root, CASE WHEN max(depth) < 40 THEN max(depth) END AS depth, max(depth) >= 40 AS cyclic FROM w GROUP BY id""")
def parent_chains(spark, d):
    """Roots and depths of a tree of companies, in which one line of parents runs in a circle."""
    n = F.col("n_nationkey").cast("long")
    parent = F.when(n == 0, None).when(n == 11, 23).otherwise(F.expr("n_nationkey div 2"))
    return ancestry(table(spark, d, "nation").select(n.alias("id"), parent.cast("long").alias("parent")))


SIGNATURE = "sha256(array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(p_name), '[0-9]+', 'N', 'g'), ' '), lambda x: x <> ''))), ' '))"


@query(f"WITH s AS (SELECT p_partkey, p_size, p_brand, {SIGNATURE} AS signature FROM part) SELECT left(signature, 16) AS signature, count(*) AS n, min(p_partkey) AS example, bool_or(p_brand = 'Brand#13' AND p_size <= 25) AS known FROM s GROUP BY s.signature")
def signature_groups(spark, d):
    """Rows for review by the shape of their text, and whether that shape has been judged before."""
    words = F.filter(F.split(F.regexp_replace(F.lower("p_name"), "[0-9]+", "N"), " "), lambda x: x != "")
    at = table(spark, d, "part").withColumn("signature", F.sha2(F.array_join(F.sort_array(F.array_distinct(words)), " "), 256))
    known = at.where("p_brand = 'Brand#13' and p_size <= 25").select("signature", F.lit(True).alias("known")).distinct()
    groups = at.groupBy("signature").agg(F.count("*").alias("n"), F.min("p_partkey").alias("example")).join(known, "signature", "left")
    return groups.select(F.substring("signature", 1, 16).alias("signature"), "n", "example", F.coalesce("known", F.lit(False)).alias("known"))


# ---- reductions


@query("SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' WHEN bool_or(l_linestatus = 'O') THEN 'open' ELSE 'done' END AS state FROM lineitem GROUP BY l_orderkey")
def occurrence_priority(spark, d):
    """One state of all occurrences: any return decides, else any that is open, else all are done."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_linestatus") == "O", 1).otherwise(2)
    states = F.array(F.lit("returned"), F.lit("open"), F.lit("done"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(rank).alias("r")).select("l_orderkey", F.element_at(states, F.col("r") + 1).alias("state"))


@query("SELECT o_custkey, max(CASE o_orderpriority[1] WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END)::BIGINT AS best, arg_max(o_orderkey, (CASE o_orderpriority[1] WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END)::BIGINT * 1000000000000 - o_orderkey) AS first FROM orders GROUP BY o_custkey")
def best_location(spark, d):
    """The best of an entity's places and the first row that has it."""
    value = F.when(F.col("o_orderpriority").startswith("1"), 3).when(F.col("o_orderpriority").startswith("2"), 2).when(F.col("o_orderpriority").startswith("3"), 1).otherwise(0)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(value).cast("long").alias("best"), F.max_by("o_orderkey", F.struct(value, -F.col("o_orderkey"))).alias("first"))


@query(f"SELECT event_type AS cursor, count(*) AS n, sum(length(props))::BIGINT AS size, max(event_id) AS seq, ((SELECT max(t) FROM {EV}) - max(t))::BIGINT AS age FROM (SELECT t, e.event_id, e.event_type, props FROM {EV} x JOIN events e USING (event_id)) e GROUP BY event_type")
def store_report(spark, d):
    """Size of each log, its position, and its age against the newest."""
    at = timed(spark, d).select("event_id", "t").join(table(spark, d, "events").select("event_id", "event_type", "props"), "event_id")
    newest = at.agg(F.max("t").alias("now"))  # one row
    by = at.groupBy(F.col("event_type").alias("cursor")).agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("size"), F.max("event_id").alias("seq"), F.max("t").alias("t"))
    return by.crossJoin(F.broadcast(newest)).select("cursor", "n", "size", "seq", (F.col("now") - F.col("t")).alias("age"))


# ---- streams of facts


@query(f"SELECT user_id, event_id AS opened, CASE WHEN nt = 'purchase' THEN n END AS closed, CASE WHEN nt = 'purchase' THEN nx - t END AS seconds FROM (SELECT *, lead(event_type) OVER w AS nt, lead(event_id) OVER w AS n, lead(t) OVER w AS nx FROM {EV} WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE event_type = 'signup'")
def open_close_pairs(spark, d):
    """Each opening with the closing that follows it; one that is followed by another opening stays open."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    at = timed(spark, d).where(F.col("event_type").isin("signup", "purchase")).withColumn("next", F.lead(F.struct("event_type", "event_id", "t")).over(w)).where("event_type = 'signup'")
    closes = F.col("next.event_type") == "purchase"
    return at.select("user_id", F.col("event_id").alias("opened"), F.when(closes, F.col("next.event_id")).alias("closed"), F.when(closes, F.col("next.t") - F.col("t")).alias("seconds"))


@query(f"SELECT user_id, max(t) AS last, (SELECT max(t) FROM {EV}) - max(t) > 43200 AS stale FROM {EV} GROUP BY user_id")
def watermark_staleness(spark, d):
    at = timed(spark, d)
    newest = at.agg(F.max("t").alias("now"))  # one row
    return at.groupBy("user_id").agg(F.max("t").alias("last")).crossJoin(F.broadcast(newest)).select("user_id", "last", (F.col("now") - F.col("last") > 43200).alias("stale"))


@query(f"SELECT user_id, event_id, event_type AS folder, t AS since, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), -1) AS until FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM {EV}) WHERE p IS NULL OR p <> event_type")
def folder_history(spark, d):
    """Stays in one folder after another; sightings in the same one are a single stay."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    moves = timed(spark, d).withColumn("p", F.lag("event_type").over(w)).where("p is null or p <> event_type")
    return moves.select("user_id", "event_id", F.col("event_type").alias("folder"), F.col("t").alias("since"), F.coalesce(F.lead("t").over(w), F.lit(-1)).alias("until"))


HOUR = 3600
ATTRIBUTED = f"(SELECT user_id, event_id, event_type, unnest(range(t // {HOUR}, (t + 59 + (event_id % 7) * 600) // {HOUR} + 1)) AS h, t AS s, t + 60 + (event_id % 7) * 600 AS e FROM {EV})"


@query(f"SELECT h AS hour, event_type, sum(least(e, (h + 1) * {HOUR}) - greatest(s, h * {HOUR}))::BIGINT AS seconds FROM {ATTRIBUTED} GROUP BY ALL")
def phase_attribution(spark, d):
    """Seconds of each kind in each hour: spans are cut at the hours, so that the parts sum to the whole."""
    at = timed(spark, d).withColumns({"s": F.col("t"), "e": F.col("t") + 60 + (F.col("event_id") % 7) * 600})
    at = at.withColumn("hour", F.explode(F.sequence(F.floor(F.col("s") / HOUR), F.floor((F.col("e") - 1) / HOUR))))
    part = F.greatest(F.lit(0), F.least("e", (F.col("hour") + 1) * HOUR) - F.greatest("s", F.col("hour") * HOUR))
    return at.groupBy("hour", "event_type").agg(F.sum(part).alias("seconds"))


@query(f"SELECT user_id, (max(t) - min(t))::BIGINT AS total, coalesce(sum(least(g, 3600)), 0)::BIGINT AS active, ((max(t) - min(t)) - coalesce(sum(least(g, 3600)), 0))::BIGINT AS residual FROM (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM {EV}) GROUP BY user_id")
def residual_class(spark, d):
    """What of a user's time is in no step of at most an hour: the total less all else."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    at = timed(spark, d).withColumn("g", F.least(step, F.lit(3600)))
    total, active = F.max("t") - F.min("t"), F.coalesce(F.sum("g"), F.lit(0))
    return at.groupBy("user_id").agg(total.alias("total"), active.alias("active"), (total - active).alias("residual"))


@query(f"WITH b AS (SELECT min(t) + 86400 AS lo, max(t) - 86400 AS hi FROM {EV}), s AS (SELECT event_type, t AS s, t + (event_id % 11) * 3000 AS e FROM {EV}) SELECT event_type, sum(greatest(0, least(e, hi) - greatest(s, lo)))::BIGINT AS seconds, count_if(e - s > 20000) AS overlong FROM s, b GROUP BY event_type")
def clipped_spans(spark, d):
    """Seconds within a span of interest, and spans too long to be believed."""
    at = timed(spark, d).withColumns({"s": F.col("t"), "e": F.col("t") + (F.col("event_id") % 11) * 3000})
    bounds = at.agg((F.min("t") + 86400).alias("lo"), (F.max("t") - 86400).alias("hi"))  # one row
    part = F.greatest(F.lit(0), F.least("e", "hi") - F.greatest("s", "lo"))
    return at.crossJoin(F.broadcast(bounds)).groupBy("event_type").agg(F.sum(part).alias("seconds"), F.count_if(F.col("e") - F.col("s") > 20000).alias("overlong"))


# ---- texts


@query("SELECT doc_id, len(regexp_extract_all(text, '[^.!?]*[.!?]+'))::BIGINT AS sentences, len(regexp_extract_all(text, '[^\\s]+'))::BIGINT AS words, md5(trim(regexp_replace(lower(regexp_extract(text, '^[^.!?]*')), '[^a-z0-9]+', ' ', 'g'))) AS first_key FROM documents")
def sentence_counts(spark, d):
    """Sentences, words, and a key of the first sentence that ignores case and marks. Each run of marks ends one sentence: what stands
    before it is not matched, as a pattern would read a text without marks to its end from each of its letters."""
    key = F.trim(F.regexp_replace(F.lower(F.regexp_extract("text", "^[^.!?]*", 0)), "[^a-z0-9]+", " "))
    return table(spark, d, "documents").select(
        "doc_id", T.count_matches(F.col("text"), "[.!?]+").cast("long").alias("sentences"), T.count_matches(F.col("text"), r"[^\s]+").cast("long").alias("words"), F.md5(key).alias("first_key")
    )


# ---- postings made up from phrases by part

TITLES = ("Senior Go Engineer", "Go-to-market Lead", "Sales Engineer", "Machine Learning Engineer", "Backend Developer", "Account Manager", "AI Researcher", "Data Analyst")
BODIES = (
    "We build services in Go. Salary $120,000 - $150,000 per year.", "No experience with Kubernetes is needed. Pay: €40 to €55 an hour.", "You sell to clients and meet quota targets.",
    "We train large language models; not a sales role.", "Kubernetes and Python. Compensation 95k-110k USD.", "Build client relations without coding.", "Deep learning and AI products at an AI company.",
)


def posts(spark, d) -> DataFrame:
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % by + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", pick(TITLES, len(TITLES)).alias("title"), pick(BODIES, len(BODIES)).alias("body"), "p_size")


POSTS = "(SELECT p_partkey, p_size, [" + ", ".join(f"'{t}'" for t in TITLES) + f"][p_partkey % {len(TITLES)} + 1] AS title, [" + ", ".join(f"'{b}'" for b in BODIES) + f"][p_partkey % {len(BODIES)} + 1] AS body FROM part)"


@query(f"SELECT p_partkey, (regexp_matches(title || ' ' || body, '(^|[^A-Za-z])Go([^A-Za-z-]|$)') AND NOT regexp_matches(title, 'Go-to-')) AS go FROM {POSTS}")
def ambiguous_term(spark, d):
    """A term that is a common word, too, counts as the name only where it is written as one."""
    both = F.concat_ws(" ", "title", "body")
    return posts(spark, d).select("p_partkey", (both.rlike("(^|[^A-Za-z])Go([^A-Za-z-]|$)") & ~F.col("title").rlike("Go-to-")).alias("go"))


NEGATED = r"(?i)(no|not|without|never)( [a-z]+){0,3} "
KEYWORDS = "(kubernetes|coding|sales)"


@query(f"SELECT p_partkey, len(regexp_extract_all(lower(body), '{KEYWORDS}'))::BIGINT AS hits, len(regexp_extract_all(body, '{NEGATED}{KEYWORDS}'))::BIGINT AS negated FROM {POSTS}")
def negated_spans(spark, d):
    """Mentions of keywords, and those of them that a negation within three words before takes back."""
    return posts(spark, d).select("p_partkey", T.count_matches(F.lower("body"), KEYWORDS).cast("long").alias("hits"), T.count_matches(F.col("body"), NEGATED + KEYWORDS).cast("long").alias("negated"))


FAMILIES = (("sales", "sales|account|quota|client"), ("engineering", "engineer|developer|kubernetes|services in go"), ("research", "machine learning|ai researcher|language models|deep learning"))


def family(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(FAMILIES):
        out = F.when(F.lower(x).rlike(pattern), name).otherwise(out)
    return out


def _family(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN '{n}'" for n, p in FAMILIES) + " END"


@query(f"SELECT p_partkey, {_family('title')} AS title_family, {_family('body')} AS body_family, coalesce({_family('title')} <> {_family('body')}, false) AS conflict FROM {POSTS}")
def title_body_conflict(spark, d):
    a, b = family(F.col("title")), family(F.col("body"))
    return posts(spark, d).select("p_partkey", a.alias("title_family"), b.alias("body_family"), F.coalesce(a != b, F.lit(False)).alias("conflict"))


AI_WORDS = "(ai company|language models|deep learning|machine learning)"


@query(f"SELECT p_partkey, len(regexp_extract_all(lower(title || ' ' || body), '{AI_WORDS}'))::BIGINT AS signals, regexp_matches(lower(body), 'ai company') OR len(regexp_extract_all(lower(title || ' ' || body), '{AI_WORDS}')) >= 2 AS ai FROM {POSTS}")
def ai_company_signal(spark, d):
    n = T.count_matches(F.lower(F.concat_ws(" ", "title", "body")), AI_WORDS)
    return posts(spark, d).select("p_partkey", n.cast("long").alias("signals"), (F.contains(F.lower("body"), F.lit("ai company")) | (n >= 2)).alias("ai"))


@query(f"SELECT p_partkey, least(abs(CASE WHEN regexp_matches(title, 'Senior') THEN 5 WHEN regexp_matches(title, 'Lead') THEN 6 ELSE 3 END - (p_size % 6 + 1)) * 10, 30)::BIGINT AS penalty FROM {POSTS}")
def level_fit_penalty(spark, d):
    """Ten points for each step between the wanted level and the posting's, thirty at most."""
    level = F.when(F.col("title").rlike("Senior"), 5).when(F.col("title").rlike("Lead"), 6).otherwise(3)
    return posts(spark, d).select("p_partkey", F.least(F.abs(level - (F.col("p_size") % 6 + 1)) * 10, F.lit(30)).cast("long").alias("penalty"))


@query(f"SELECT p_partkey, array_to_string(list_filter(string_split(body, '.'), lambda s: regexp_matches(lower(s), 'salary|pay|compensation')), '|') AS pay, array_to_string(list_filter(string_split(body, '.'), lambda s: regexp_matches(lower(s), 'kubernetes|python|models|learning')), '|') AS skills FROM {POSTS}")
def posting_digest(spark, d):
    """Sentences of a posting by what they are about."""
    said = lambda p: F.array_join(F.filter(F.split("body", r"\."), lambda s: F.lower(s).rlike(p)), "|")
    return posts(spark, d).select("p_partkey", said("salary|pay|compensation").alias("pay"), said("kubernetes|python|models|learning").alias("skills"))


@query(f"SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 45 THEN 'size_high' END, CASE WHEN length(title) < 13 THEN 'title_short' END, CASE WHEN NOT regexp_matches(body, '\\.$') THEN 'body_end' END], lambda x: x IS NOT NULL), ',') AS errors FROM {POSTS}")
def metadata_validation(spark, d):
    """Every rule that a row breaks."""
    rules = {"size_high": F.col("p_size") > 45, "title_short": F.length("title") < 13, "body_end": ~F.col("body").rlike(r"\.$")}
    return posts(spark, d).select("p_partkey", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])), ",").alias("errors"))


#: A search profile as data: compiled to one column, it is pushed to the scan like any filter.
PROFILE = {"brands": ["Brand#11", "Brand#23", "Brand#45"], "size": [5, 40], "not": ["PROMO"], "price_at_most": 1500.0}


def compiled(profile: dict) -> Column:
    out = F.col("p_brand").isin(profile["brands"]) & F.col("p_size").between(*profile["size"]) & (F.col("p_retailprice") <= profile["price_at_most"])
    for word in profile["not"]:
        out &= ~F.startswith("p_type", F.lit(word))
    return out


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#45') AND p_size BETWEEN 5 AND 40 AND p_retailprice <= 1500 AND NOT starts_with(p_type, 'PROMO')")
def compiled_profile(spark, d):
    return table(spark, d, "part").where(compiled(PROFILE)).select("p_partkey")


@query(URL_SQL.replace("list_transform(pairs,", "list_transform(list_distinct(pairs),") + " SELECT page_id, url FROM e")
def page_url_distinct_pairs(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url"), distinct=True).alias("url"))
