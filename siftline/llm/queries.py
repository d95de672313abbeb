"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decision_lists, divergence, line_runs, mixing, near_duplicates, packing, phrases, quotations, toxicity, url_templates, warc, webp, wrappers
from .tables import read, stored

SEED = 20
TREE = ("domain", "lang", "source")
WEIGHTS = {"domain": {"bulk": 2, "curated": 3}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"*": 1}}
SHARE = (3, 5)
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def tree_columns() -> list[Column]:
    """Domain (one bulk source, all others curated), language and source."""
    domain = F.when(F.col("source") == "src0", "bulk").otherwise("curated")
    return [domain, F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))]


def op1_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_columns(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.linked(read(spark, sf_dir, "conversations"), excerpts=True)


def op4_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), size=2, percent=80)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_lists.quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.drop_repeated_runs(read(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50, whole=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    columns = [c.alias(name) for c, name in zip(tree_columns(), TREE)]
    slim = stored(docs.select("doc_id", *columns, mixing.n_tokens(F.col("text")).alias("n_tokens")), "tokens")
    plan = mixing.leaf_plan(slim, TREE, WEIGHTS, SHARE, 2, SEED, "doc_id")
    return mixing.picked(slim, plan, TREE, SEED, "doc_id")


def op11_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judged(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"), min_n=2, max_n=3, least=10, top=2000, percent=50)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), least=30, top=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_lossless_webp, op2_packing, op3_quotation_links, op4_wrapper_text, op5_toxicity,
        op6_near_duplicates, op7_quality_rules, op8_line_runs, op9_warc, op10_mixing, op11_url_templates, op12_collocations, op13_source_divergence,
    )
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op12_collocations": rf"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
              FROM words, (SELECT unnest([1, 2, 3]) AS size)),
    counts AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL),
    cuts AS (SELECT c.lang, c.phrase, c.size, c.f AS a, string_split(c.phrase, ' ') AS w, k FROM counts c, (SELECT unnest([1, 2]) AS k) WHERE c.size > k AND c.f >= 10),
    scored AS (SELECT c.lang, c.phrase, c.size, c.a, l.f AS l, r.f AS r, k, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
               FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner2 AS (SELECT lang, array_to_string(string_split(phrase, ' ')[s:s + 1], ' ') AS phrase, a FROM lowest, (SELECT unnest([1, 2]) AS s) WHERE size = 3),
    kept AS (SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM inner2 i WHERE i.lang = c.lang AND i.phrase = c.phrase AND c.size = 2 AND 100 * i.a >= 50 * c.a))
    SELECT lang, rank, phrase, a, l, r, n, score FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_source_divergence": rf"""
    WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    words AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS of_lang FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30),
    langs AS (SELECT lang, count(*) AS v, sum(of_lang) AS n_lang FROM kept GROUP BY lang),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v) AS p, 1 + (1000000000::HUGEINT * (of_lang + 5)) // (n_lang + 5 * v) AS q
             FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
             LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
    apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
             UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM grid WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= 50
    """,
}
