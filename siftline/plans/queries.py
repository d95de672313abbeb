"""Named queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.functions import values as V
from siftline.operators import folds, intervals, links, select

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out by its first column, four parts to a core: for work that is heavy on each row. A scan's own parts say nothing of it, as they
    are stretches of bytes, of which few have rows where row groups are large."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, df.columns[0])


def any_contains(x: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(x), F.lit(w))
    return out


def seconds(x: Column) -> Column:
    """Whole seconds of a time without zone."""
    return F.unix_seconds(x.cast("timestamp"))


SEC = "epoch(date_trunc('second', ts))::BIGINT"
Q = "'"

# ---- text

NORM = "trim(regexp_replace(regexp_replace(translate(lower(text), '‐‑‒–—―', '------'), '[^a-z0-9+/.# -]', ' ', 'g'), ' +', ' ', 'g'))"
WS = r"[ \t\n\r\f\x0b]+"
FINGER = "CASE WHEN length(text) >= 400 THEN sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))) END"


@query(f"SELECT doc_id, md5({NORM}) AS h FROM documents")
def doc_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("h"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '{WS}', ' ', 'g'))) AS h FROM documents")
def doc_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h"))


@query(f"SELECT h, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, {FINGER} AS h FROM documents) WHERE h IS NOT NULL GROUP BY h")
def doc_body_fingerprint(spark, d):
    at = table(spark, d, "documents").select("doc_id", T.body_fingerprint(F.col("text")).alias("h")).where("h is not null")
    return at.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(f"""WITH a AS (SELECT doc_id, source, n_chars, coalesce({FINGER}, 'id-' || doc_id) AS k FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY n_chars DESC, doc_id) AS r, min(doc_id) OVER (PARTITION BY source, k) AS position FROM a)
SELECT doc_id, source, n_chars, position FROM b WHERE r = 1""")
def doc_exact_dedupe(spark, d):
    key = F.coalesce(T.body_fingerprint(F.col("text")), F.concat(F.lit("id-"), F.col("doc_id").cast("string")))
    at = table(spark, d, "documents").select("doc_id", "source", "n_chars", key.alias("k"))
    return select.dedupe(at, ["source", "k"], "n_chars", "doc_id").select("doc_id", "source", "n_chars", "position")


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) >= 24 GROUP BY ALL HAVING count(*) >= 3)
SELECT d.doc_id, count(c.line)::BIGINT AS repeated FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def doc_repeated_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", T.repeated_lines(F.col("text")).cast("long").alias("repeated"))


GIB = "(?:^|[^a-z])[bcdfghjklmnpqrstvwxz]{4,}(?:$|[^a-z])"


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{GIB}'))::BIGINT AS n FROM documents")
def doc_gibberish(spark, d):
    return table(spark, d, "documents").select("doc_id", T.gibberish_tokens(F.col("text"), 4).cast("long").alias("n"))


QUALITY_SQL = f"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT doc_id, line FROM l WHERE length(line) >= 24 GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT doc_id, count(*) AS repeated FROM c GROUP BY doc_id),
q AS (SELECT d.doc_id, CASE WHEN length(trim(text)) < 40 OR len(regexp_extract_all(text, '[#*$%&]')) * 20 > length(text) THEN 'drop'
 WHEN coalesce(repeated, 0) > 0 OR len(regexp_extract_all(lower(text), '{GIB}')) >= 20 THEN 'review' ELSE 'keep' END AS quality FROM documents d LEFT JOIN r USING (doc_id))"""


def quality(text: Column) -> Column:
    """drop on a strong sign, review on a weak one."""
    strong = (F.length(F.trim(text)) < 40) | (T.count_matches(text, "[#*$%&]") * 20 > F.length(text))
    weak = (T.repeated_lines(text) > 0) | (T.gibberish_tokens(text, 4) >= 20)
    return F.when(strong, "drop").when(weak, "review").otherwise("keep")


@query(QUALITY_SQL + " SELECT doc_id, quality FROM q")
def doc_quality_tri_state(spark, d):
    return table(spark, d, "documents").select("doc_id", quality(F.col("text")).alias("quality"))


@query(QUALITY_SQL + " SELECT q.quality AS verdict, l.quality AS label, count(*) AS n FROM q JOIN labels l USING (doc_id) GROUP BY ALL")
def doc_quality_vs_labels(spark, d):
    at = table(spark, d, "documents").select("doc_id", quality(F.col("text")).alias("verdict"))
    return at.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").groupBy("verdict", "label").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{T.EMAIL}'))::BIGINT AS emails, len(regexp_extract_all(text, '{T.PHONE}'))::BIGINT AS phones,
len(regexp_extract_all(text, '{T.HOME_PATH}'))::BIGINT AS paths FROM documents""")
def doc_pii_counts(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", *[T.count_matches(x, p).cast("long").alias(n) for n, p in (("emails", T.EMAIL), ("phones", T.PHONE), ("paths", T.HOME_PATH))])


@query("""WITH x AS (SELECT doc_id, source, lang, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS h FROM documents)
SELECT source, lang, h, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM x GROUP BY ALL HAVING count(*) > 1""")
def duplicate_triple(spark, d):
    at = table(spark, d, "documents").groupBy("source", "lang", T.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("doc_id")).alias("s"))
    return at.where("n > 1").select("source", "lang", "h", "n", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("ids"))


TOK = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"""WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), b AS (SELECT doc_id, {TOK} AS t FROM a),
x AS (SELECT item_id, {TOK} AS u FROM benchmark)
SELECT DISTINCT doc_id, item_id FROM b JOIN x ON len(list_intersect(t, u)) * 100 >= 72 * (len(t) + len(u) - len(list_intersect(t, u))) AND len(t) > 0 AND len(u) > 0""")
def bench_token_overlap(spark, d):
    """Lines whose tokens are alike to an item's: pairs meet at one of the item's or line's longest tokens only (prefix filter). Each row orders its
    own tokens, so a line is not taken apart and put together again, and a text moves once."""
    items = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("u")).where(F.size("u") > 0)
    lines = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", T.tokens(F.col("line")).alias("t")).where(F.size("t") > 0)

    def prefixed(df: DataFrame, key: str, words: str) -> DataFrame:
        # all tokens in one order, the longest, which are rare, first; two alike sets share one of the first n - ceil(0.72 n) + 1
        order = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
        n = (F.size(words) - F.ceil(F.size(words) * 0.72) + 1).cast("int")
        return df.select(key, words, F.explode(F.slice(order, F.lit(1), n)).alias("p")).select(key, words, "p.w")

    met = prefixed(lines, "doc_id", "t").join(prefixed(items, "item_id", "u"), "w")
    both = F.size(F.array_intersect("t", "u"))
    return met.where(both * 100 >= 72 * (F.size("t") + F.size("u") - both)).select("doc_id", "item_id").distinct()


STRIP = f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '{WS}', ' ', 'g'))"


@query(f"SELECT page_id, md5({STRIP}) AS h, length({STRIP})::BIGINT AS n FROM pages")
def page_text(spark, d):
    at = table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("t"))
    return at.select("page_id", F.md5("t").alias("h"), F.length("t").cast("long").alias("n"))


CODED = "replace(replace(url_encode(url_decode(replace({0}, '+', ' '))), '%20', '+'), '*', '%2A')"
URL_SQL = f"""WITH a AS (SELECT page_id, regexp_replace(CASE WHEN contains(url, '://') THEN trim(url) ELSE 'https://' || trim(url) END, '#.*$', '') AS u FROM pages),
c AS (SELECT page_id, lower(regexp_extract(u, '^([^:]+)://', 1)) || '://' || lower(regexp_extract(u, '^[^:]+://(?:[^/?@]*@)?([^/?]*)', 1)) AS h, regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1) AS p,
 list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(string_split(x, '=')[1]), '{T.TRACKING}')) AS pairs FROM a),
d AS (SELECT page_id, h, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END AS p, list_sort(list_transform(pairs, lambda x: {{'k': {CODED.format("string_split(x, '=')[1]")}, 'v': {CODED.format("regexp_replace(x, '^[^=]*=?', '')")}}})) AS l FROM c),
e AS (SELECT page_id, p, len(l) > 0 AS has, h || p || CASE WHEN len(l) > 0 THEN '?' || array_to_string(list_transform(l, lambda x: x.k || '=' || x.v), '&') ELSE '' END AS url FROM d)"""


@query(URL_SQL + " SELECT page_id, url FROM e")
def page_url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


LISTING_SQL = "(NOT has AND len(list_filter(string_split(p, '/'), lambda x: x <> '' AND lower(x) NOT IN (" + ", ".join(f"'{s}'" for s in T.LISTING_SEGMENTS) + "))) = 0)"


@query(URL_SQL.replace("FROM pages", "FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '(://[^/]*)/.*$', '\\1/careers/openings/') WHEN 1 THEN regexp_replace(url, '(://[^/]*)/.*$', '\\1/jobs/123') ELSE url END AS url FROM pages)") + f" SELECT page_id, {LISTING_SQL} AS listing FROM e")
def page_url_is_listing(spark, d):
    """Every fourth page's URL is led to a listing, another fourth to one posting below it."""
    led = lambda to: F.regexp_replace("url", "(://[^/]*)/.*$", "$1" + to)
    url = F.when(F.col("page_id") % 4 == 0, led("/careers/openings/")).when(F.col("page_id") % 4 == 1, led("/jobs/123")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.is_listing_url(url).alias("listing"))


@query(URL_SQL + f", k AS (SELECT CASE WHEN {LISTING_SQL} THEN 'ck-' || substring(sha256('||'), 1, 12) ELSE 'url-' || substring(sha256(url), 1, 12) END AS key FROM e) SELECT key, count(*) AS n FROM k GROUP BY key")
def page_identity_keys(spark, d):
    key = T.identity_key(F.col("url"), F.lit(""))
    return table(spark, d, "pages").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


TERMS = ("cold", "blue rod", "bolt", "small widget", "promo")


@query("SELECT p_partkey, " + ", ".join(f"regexp_matches(lower(p_name || ' ' || p_type), '{T.term_pattern(t)}') AS t{i}" for i, t in enumerate(TERMS)) + " FROM part")
def term_bounded_match(spark, d):
    x = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, d, "part").select("p_partkey", *[T.has_term(x, t).alias(f"t{i}") for i, t in enumerate(TERMS)])


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def supplier_slugs(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.slugify(F.col("s_name")).alias("slug"))


# ---- predicates, sorts

LOW, HIGH = "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size::DOUBLE END", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_size + 10)::DOUBLE END"


def ranged(spark, d) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").withColumns({"lo": F.when(s % 7 != 0, s.cast("double")), "hi": F.when(s % 5 != 0, (s + 10).cast("double"))})


RANGED = f"WITH r AS (SELECT *, {LOW} AS lo, {HIGH} AS hi FROM part) SELECT p_partkey FROM r WHERE "


@query(RANGED + "NOT (lo IS NULL AND hi IS NULL) AND coalesce(hi, 'inf'::DOUBLE) >= 20 AND coalesce(lo, '-inf'::DOUBLE) <= 30")
def filter_overlap(spark, d):
    return ranged(spark, d).where(V.overlaps(F.col("lo"), F.col("hi"), 20, 30)).select("p_partkey")


@query(RANGED + "coalesce(hi, lo) >= 35")
def filter_floor(spark, d):
    return ranged(spark, d).where(V.meets_floor(F.col("lo"), F.col("hi"), 35)).select("p_partkey")


@query(RANGED + "lo IS NULL OR lo <= 12")
def filter_cap(spark, d):
    return ranged(spark, d).where(V.under_cap(F.col("lo"), 12)).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'auto')")
def filter_orlist(spark, d):
    return table(spark, d, "customer").where(any_contains(F.col("c_mktsegment"), ("build", "auto"))).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_orderdate >= TIMESTAMP '1995-01-01' AND contains(lower(o_orderpriority), 'urgent')")
def filter_conjunction(spark, d):
    at = table(spark, d, "orders")
    return at.where(F.col("o_orderstatus").isin("F", "O") & (F.col("o_totalprice") >= 1000) & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & any_contains(F.col("o_orderpriority"), ("urgent",))).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events WHERE coalesce(event_id, 0) > 500 AND event_type = 'purchase'")
def cursor_delta(spark, d):
    return table(spark, d, "events").where((F.coalesce("event_id", F.lit(0)) > 500) & (F.col("event_type") == "purchase")).select("event_id", "user_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR date_diff('second', o_orderdate, TIMESTAMP '1998-01-01') / 86400.0 <= 400")
def filter_max_age_null_keeps(spark, d):
    at = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").where(V.within_age(V.age_days(at, F.lit("1998-01-01").cast("timestamp")), 400)).select("o_orderkey")


@query("SELECT o_orderkey, p FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS p FROM orders) ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 50")
def sort_nulls_last_topk(spark, d):
    at = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("p"))
    return at.orderBy(F.desc_nulls_last("p"), "o_orderkey").limit(50)


# ---- gates

GATES = (
    ("blank", "length(trim(text)) > 0", lambda: F.length(F.trim("text")) > 0),
    ("language", "lang IN ('en', 'de', 'fr')", lambda: F.col("lang").isin("en", "de", "fr")),
    ("too_short", "n_chars >= 200", lambda: F.col("n_chars") >= 200),
    ("symbols", "len(regexp_extract_all(text, '[#*$%&]')) * 20 <= length(text)", lambda: T.count_matches(F.col("text"), "[#*$%&]") * 20 <= F.length("text")),
    ("contact", f"NOT regexp_matches(text, '{T.EMAIL}')", lambda: ~F.col("text").rlike(T.EMAIL)),
)
GATE_SQL = "CASE " + " ".join(f"WHEN NOT coalesce({s}, false) THEN '{n}'" for n, s, _ in GATES) + " ELSE 'kept' END"
NAMES = [n for n, *_ in GATES] + ["kept"]


def gated(spark, d) -> DataFrame:
    return table(spark, d, "documents").withColumn("disposition", select.disposition([(n, f()) for n, _, f in GATES]))


@query(f"SELECT doc_id, {GATE_SQL} AS disposition FROM documents")
def gate_disposition(spark, d):
    return gated(spark, d).select("doc_id", "disposition")


@query("WITH g AS (SELECT " + GATE_SQL + " AS disposition FROM documents), l(step, disposition) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES)) + f") SELECT step, l.disposition, count(g.disposition) AS n FROM l LEFT JOIN g ON l.disposition = g.disposition GROUP BY ALL UNION ALL SELECT {len(NAMES)}, 'total', count(*) FROM g")
def funnel(spark, d):
    return select.funnel(gated(spark, d), NAMES)


@query(f"WITH g AS (SELECT doc_id, {GATE_SQL} AS family FROM documents) SELECT * FROM (SELECT family, doc_id, row_number() OVER (PARTITION BY family ORDER BY sha256(doc_id::VARCHAR), doc_id)::INT AS place, count(*) OVER (PARTITION BY family) AS family_rows FROM g) WHERE place <= 5")
def first_reject_census(spark, d):
    return select.census(gated(spark, d).select(F.col("disposition").alias("family"), "doc_id"), "family", "doc_id", 5).select("family", "doc_id", "place", "family_rows")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_orderkey, o_custkey, o_totalprice FROM r WHERE n <= 3 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def diversify_topk(spark, d):
    at = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return select.diversify(at, ["o_custkey"], "o_totalprice", "o_orderkey", 3, 50)


@query("SELECT event_type AS term, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def excluded_term_histogram(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("term")).agg(F.count_distinct("user_id").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def crosstab_rollup(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


# ---- joins


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')
AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal < 0)""")
def anti_considered(spark, d):
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    poor = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    at = links.considered(table(spark, d, "orders").select("o_orderkey", "o_custkey"), seen, ["o_orderkey"])
    return links.considered(at, poor, ["o_custkey"]).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING date_diff('day', max(o_orderdate)::DATE, DATE '1998-08-01') <= 200)")
def semi_recent(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    recent = last.where(F.date_diff(F.lit("1998-08-01").cast("date"), F.to_date("last")) <= 200)
    return table(spark, d, "customer").select("c_custkey").join(recent, "c_custkey", "left_semi")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1994-01-01')
SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN s ON l_suppkey = k WHERE date_diff('day', l_shipdate::DATE, DATE '1998-12-31') <= CASE WHEN k IS NULL THEN 1500 ELSE 300 END""")
def first_search_widening(spark, d):
    at = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    seen = at.where(F.col("l_shipdate") < F.lit("1994-01-01").cast("timestamp_ntz")).select("l_suppkey", F.lit(True).alias("seen")).distinct()
    age = F.date_diff(F.lit("1998-12-31").cast("date"), F.to_date("l_shipdate"))
    return at.join(seen, "l_suppkey", "left").where(age <= F.when(F.col("seen").isNull(), 1500).otherwise(300)).select("l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT lower(n_name) AS alias, n_name AS canonical FROM nation UNION ALL SELECT right(n_name, 1), n_name FROM nation UNION ALL SELECT right(n_name, 2), n_name FROM nation),
u AS (SELECT alias, min(canonical) AS canonical FROM a GROUP BY alias HAVING count(DISTINCT canonical) = 1)
SELECT n_nationkey, canonical FROM nation LEFT JOIN u ON right(n_name, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 2 END) = alias""")
def alias_resolve(spark, d):
    n = table(spark, d, "nation")
    aliases = n.select(F.lower("n_name").alias("alias"), F.col("n_name").alias("canonical"))
    for size in (1, 2):  # a last letter is one that several share, the last two are not
        aliases = aliases.union(n.select(F.substring("n_name", -size, size), "n_name"))
    asked = F.when(F.col("n_nationkey") % 3 == 0, F.substring("n_name", -1, 1)).otherwise(F.substring("n_name", -2, 2))
    return links.resolve_alias(n, asked, aliases).select("n_nationkey", "canonical")


PATTERNS = ("steel", "brushed steel", "tin", "polished", "economy", "nickel", "promo", "brass", "copper", "standard polished tin")


@query("SELECT p_partkey, " + "CASE " + " ".join(f"WHEN contains(lower(p_type), '{p}') THEN '{p}'" for _, p in sorted(enumerate(PATTERNS), key=lambda x: (-len(x[1]), x[0]))) + " END AS pattern FROM part")
def longest_pattern_match(spark, d):
    return table(spark, d, "part").select("p_partkey", links.longest_pattern(table(spark, d, "part"), "p_type", PATTERNS).alias("pattern"))


@query("""WITH f AS (SELECT ps.l_suppkey, l_linenumber AS tier, l_shipdate AS dated, l_orderkey * 10 + l_linenumber AS ord, l_returnflag = 'R' AS override, l_quantity AS value FROM lineitem ps)
SELECT l_suppkey, value, candidates FROM (SELECT l_suppkey, value, row_number() OVER (PARTITION BY l_suppkey ORDER BY override DESC, tier, dated DESC, ord, value) AS r, count(*) OVER (PARTITION BY l_suppkey) AS candidates FROM f) WHERE r = 1""")
def provenance_winner(spark, d):
    at = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("tier"), F.col("l_shipdate").alias("dated"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_returnflag") == "R").alias("override"), F.col("l_quantity").alias("value"))
    return links.provenance_winner(at, ["l_suppkey"], "value")


@query("""SELECT coalesce(a.k, b.k) AS nationkey, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM
(SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k""")
def sponsor_index_full_outer(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return links.full_outer_counts(a, b, "nationkey", ("customers", "suppliers"))


@query("""WITH l AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END) AS last_in, max(CASE WHEN role <> 'user' THEN turn END) AS last_out FROM conversations GROUP BY conv_id)
SELECT conv_id, last_in, last_out FROM l WHERE last_in IS NOT NULL AND (last_out IS NULL OR last_out < last_in)""")
def needs_reply(spark, d):
    return links.needs_reply(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user")


# ---- folds

EV = f"(SELECT event_id, user_id, event_type, value, {SEC} AS t FROM events)"


def timed(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("t"))


@query(f"SELECT user_id, event_id, event_type, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS r FROM {EV}) WHERE r = 1 AND event_type <> 'error'")
def fold_last_wins_tombstone(spark, d):
    return folds.last_wins(timed(spark, d), ["user_id"], ["t", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type", "t")


TRACK = f"(SELECT event_id, user_id, t, event_type AS kind, CASE WHEN value > 50 THEN 'high' WHEN value IS NOT NULL THEN 'low' END AS size FROM {EV})"


@query(f"""WITH x AS (SELECT *, row_number() OVER w AS r, lag(kind) OVER w AS k0, lag(size) OVER w AS s0 FROM {TRACK} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, user_id, CASE WHEN r = 1 THEN 'first_seen' WHEN kind IS DISTINCT FROM k0 OR size IS DISTINCT FROM s0 THEN 'changed' ELSE 'seen' END AS type,
CASE WHEN r = 1 THEN '' ELSE concat_ws(',', CASE WHEN kind IS DISTINCT FROM k0 THEN 'kind' END, CASE WHEN size IS DISTINCT FROM s0 THEN 'size' END) END AS changes FROM x""")
def fold_change_events(spark, d):
    at = timed(spark, d).select("event_id", "user_id", "t", F.col("event_type").alias("kind"), F.when(F.col("value") > 50, "high").when(F.col("value").isNotNull(), "low").alias("size"))
    return folds.change_events(at, "user_id", ["t", "event_id"], ["kind", "size"]).select("event_id", "user_id", "type", F.array_join("changes", ",").alias("changes"))


INDEX_SQL = "SELECT user_id, arg_max(event_type, (t, event_id)) AS event_type, min(t) AS first_seen, max(t) AS last_seen, min(event_id) AS seq, count(*) AS observations FROM {} GROUP BY user_id"


def index_of(df: DataFrame) -> DataFrame:
    return folds.entity_index(df, "user_id", ["t", "event_id"], ["event_type"], "t", "event_id")


@query(INDEX_SQL.format(EV))
def entity_index(spark, d):
    return index_of(timed(spark, d))


@query(INDEX_SQL.format(EV))
def incremental_equals_full(spark, d):
    """The index of the first nine tenths, then the rest as a delta with late rows."""
    at = timed(spark, d)
    log, delta = at.where("event_id % 10 <> 3"), at.where("event_id % 10 = 3")
    return folds.incremental(index_of(log), log, delta, "user_id", index_of)


@query(f"SELECT event_id, user_id FROM (SELECT event_id, user_id, b, lag(b) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN t - 864000 ELSE t END AS b FROM {EV})) WHERE p > b")
def clock_regressions(spark, d):
    """Every fifth event is from a clock that is ten days late."""
    late = F.when(F.col("event_id") % 5 == 0, F.col("t") - 864000).otherwise(F.col("t"))
    return folds.clock_regressions(timed(spark, d).withColumn("at", late), "user_id", "event_id", "at").select("event_id", "user_id")


@query("SELECT user_id, max(event_id) - min(event_id) + 1 - count(DISTINCT event_id) AS gaps FROM events GROUP BY user_id")
def sequence_gaps(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg((F.max("event_id") - F.min("event_id") + 1 - F.count_distinct("event_id")).alias("gaps"))


@query("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events l WHERE l.event_id = e.event_id AND l.event_type IN ('view', 'click'))")
def pending_manifests(spark, d):
    e = table(spark, d, "events")
    return folds.pending(e.select("event_id"), e.where(F.col("event_type").isin("view", "click")), "event_id")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'tombstone' WHEN a.o_totalprice = b.o_totalprice THEN 'same' ELSE 'update' END AS action FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def inventory_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return folds.inventory_diff(o.where("o_orderkey % 3 <> 0"), new, "o_orderkey", ["o_totalprice"])


@query("SELECT l_returnflag AS old, CASE WHEN l_quantity > 25 THEN 'R' ELSE l_returnflag END AS new, count(*) AS n FROM lineitem GROUP BY ALL")
def filter_shift_counts(spark, d):
    new = F.when(F.col("l_quantity") > 25, "R").otherwise(F.col("l_returnflag"))
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("old"), new.alias("new")).agg(F.count("*").alias("n"))


STATES = ("error", "purchase", "signup", "click", "view")


@query("SELECT user_id, day, arg_min(event_type, list_position([" + ", ".join(f"'{s}'" for s in STATES) + "], event_type)) AS worst FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY user_id, day")
def worst_of_rollup(spark, d):
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("event_type"))
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("event_type", rank).alias("worst"))


# ---- intervals

IV = f"(SELECT event_id, user_id, event_type, t AS s, t + 1 + (event_id % 7) * 600 AS e FROM {EV})"


def spans(spark, d) -> DataFrame:
    return timed(spark, d).select("event_id", "user_id", "event_type", F.col("t").alias("s"), (F.col("t") + 1 + (F.col("event_id") % 7) * 600).alias("e"))


@query(f"SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 86400)::INT, 0) AS new FROM {EV})")
def sessions_gap(spark, d):
    return intervals.sessions(timed(spark, d), "user_id", "t", "event_id", 86400).select("user_id", "event_id", "session")


@query(f"SELECT user_id, event_id, sum(step) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS clock FROM (SELECT *, least(greatest(coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id), 0), 0), 3600) AS step FROM {EV})")
def running_clock(spark, d):
    return intervals.running_clock(timed(spark, d), "user_id", "t", "event_id", 3600).select("user_id", "event_id", "clock")


MERGED = f"""WITH a AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {IV}),
b AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS i FROM a),
c AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS parts FROM b GROUP BY user_id, i)"""


@query(MERGED + " SELECT user_id, s, e, parts FROM c")
def busy_merge(spark, d):
    return intervals.merged(spans(spark, d), ["user_id"], "s", "e")


@query(MERGED + " SELECT user_id, e AS free_from, n AS free_to FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS n FROM c) WHERE n - e >= 3600")
def free_windows(spark, d):
    return intervals.free_windows(spans(spark, d), ["user_id"], "s", "e", 3600)


@query(f"SELECT x.user_id, x.event_id AS a, y.event_id AS b FROM {IV} x JOIN {IV} y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.s < y.e AND y.s < x.e")
def overlap_conflicts(spark, d):
    return intervals.conflicts(spans(spark, d), ["user_id"], "event_id", "s", "e", 3600)


@query(f"""WITH b AS (SELECT user_id, s AS t FROM {IV} UNION SELECT user_id, e FROM {IV}), g AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t2 FROM b)
SELECT g.user_id, g.t, g.t2, min(list_position(['error', 'purchase', 'signup', 'click', 'view'], event_type))::BIGINT AS rank FROM g LEFT JOIN {IV} i ON i.user_id = g.user_id AND i.s <= g.t AND i.e >= g.t2 WHERE t2 IS NOT NULL GROUP BY ALL""")
def phase_tiling(spark, d):
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("event_type"))
    return intervals.tiling(spans(spark, d).withColumn("rank", rank), "user_id", "s", "e", "rank", range(1, len(STATES) + 1))


@query("SELECT event_type, count(*) AS n, round(median(event_id), 1) AS mid, max(event_id) AS top, min(event_id) AS low, count_if(value > 50) AS high FROM events GROUP BY event_type")
def session_rollup_median(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("event_id"), 1).alias("mid"), F.max("event_id").alias("top"), F.min("event_id").alias("low"), F.count_if(F.col("value") > 50).alias("high"))


# ---- classifiers, on texts made up from phrases by part

PHRASES = (
    "We offer visa sponsorship. Minimum 5+ years required.", "Unable to sponsor visas. Remote, 3 years.", "Sponsorship available case by case, may consider sponsorship; not eligible for sponsorship.",
    "Export control rules apply; no sponsorship.", "Hybrid role, at least 2-4 years.", "On-site in office. 10 years preferred.", "Work from home. H-1B transfer welcome.", "Nothing to say.",
)
PLACES = ("Seattle, US", "Remote", "London, UK", "Remote - United States", "Austin, US", "Hybrid", "Berlin or New York", "", "Toronto, Canada")
TITLES = ("Senior Software Engineer", "Sales Intern", "Engineering Manager", "Staff Scientist", "Junior Developer", "Principal Architect", "Office Clerk")


def pick(values, by: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.col(by), F.lit(len(values))).cast("int"))


def pick_sql(values, by: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][1 + {by} % {len(values)}]"


PP = f"WITH p AS (SELECT p_partkey, lower({pick_sql(PHRASES, 'p_partkey')}) AS t, lower({pick_sql(PLACES, 'p_partkey')}) AS a, lower({pick_sql(TITLES, 'p_partkey')}) AS h FROM part)"


def postings(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", pick(PHRASES, "p_partkey").alias("t"), pick(PLACES, "p_partkey").alias("a"), pick(TITLES, "p_partkey").alias("h"))


def m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


@query(PP + """, f AS (SELECT p.p_partkey, p_size * 1000.0 AS a, p_size * 1500.0 AS b, CASE WHEN p_size % 6 = 0 THEN NULL ELSE 'USD' END AS cur, ['year', 'month', 'hour', 'day'][1 + p_size % 4] AS per FROM p JOIN part USING (p_partkey)),
g AS (SELECT *, CASE per WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'hour' THEN 2080 END AS k FROM f)
SELECT p_partkey, CASE WHEN ok THEN (a * k)::DOUBLE END AS lo, CASE WHEN ok THEN (b * k)::DOUBLE END AS hi FROM (SELECT *, coalesce(cur IS NOT NULL AND a * k >= 10000 AND b * k <= 2000000 AND b <= 10 * a, false) AS ok FROM g)""")
def salary_normalise(spark, d):
    s = F.col("p_size")
    per = F.get(F.array(*map(F.lit, ("year", "month", "hour", "day"))), s % 4)
    r = V.salary_range(s * 1500.0, s * 1000.0, F.when(s % 6 != 0, "USD"), per)
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", F.col("r.min").alias("lo"), F.col("r.max").alias("hi"))


@query("""SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events""")
def parse_dates(spark, d):
    """The same second out of four spellings."""
    at = table(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("x"))
    text = F.when(F.col("event_id") % 4 == 0, F.date_format("x", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Mon, "), F.date_format("x", "d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
    text = text.when(F.col("event_id") % 4 == 2, F.unix_seconds("x").cast("string")).otherwise(F.concat(F.unix_seconds("x").cast("string"), F.lit("000")))
    return at.select("event_id", F.unix_seconds(V.parse_time(text)).alias("t"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events")
def json_access(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("SELECT lang, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY lang")
def best_by_language(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'th(e|at)') THEN 'english' ELSE 'other' END AS kind, count(*) OVER (PARTITION BY conv_id, role) AS same_role FROM conversations")
def label_disambiguation(spark, d):
    w = Window.partitionBy("conv_id", "role")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.lower("text").rlike("th(e|at)"), "english").otherwise("other").alias("kind"), F.count("*").over(w).alias("same_role"))
