"""Steps whose work grows no faster than their input."""

import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftline import registry
from siftline.functions import encoding, score, text
from siftline.operators import messages
from siftline.plans.queries import spread

DATA = "/root/testdata/sf0.001"


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\([^\n]*", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])


def test_sentences_of_a_text_without_marks(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 60_000), (2, "A b. C!? d"), (3, "?!"), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    rows = registry.queries()["sentence_counts"](spark, str(tmp_path)).select("doc_id", "sentences", "words").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 60_000), (2, 2, 4), (3, 1, 1), (4, 0, 0)]
    assert time.time() - began < 15


def test_folded_letters_are_looked_up_once_each(spark):
    one, to, marks, several = encoding.decomposed()
    assert not set("".join(several.values())) & set(several)
    texts = ["".join(several), "ﬁﬁ a½b ① 日本 жЖ", "plain", ""]
    plain = lambda t: "".join(x for c in t for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    at = encoding.folded(F.col("t"))
    assert "split(" not in str(at)
    got = spark.createDataFrame([(t,) for t in (*texts, None)], "t string").select("t", at.alias("x")).collect()
    assert {r.t: r.x for r in got} == {t: plain(t) for t in texts} | {None: None}


def test_texts_move_once(spark):
    assert len(exchanges(registry.queries()["bench_token_overlap"](spark, DATA))) == 1


def test_intervals_move_once(spark):
    assert len(exchanges(registry.queries()["phase_tiling"](spark, DATA))) == 1


def test_pairs_are_not_grouped(spark, tmp_path):
    spark.createDataFrame([(1, "Customer#000001", 0, 150.0), (1, "Customer#000001", 0, 950.0), (2, None, 0, 150.0)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7, "Supplier#000001", 0, 150.0), (8, None, 0, None)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "X")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    df = registry.queries()["match_key_intersection"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, 7), (2, 7)]
    assert not [x for x in exchanges(df) if "c_custkey" in x and "s_suppkey" in x]


@pytest.mark.parametrize("term", ["machine learning", "on-call", "c++", "Spark"])
def test_terms_are_matched_where_their_words_are(spark, term):
    texts = ["machine-learnings here", "a machinelearning", "on call", "oncall.", "c++ x", "sparks", "sparkle", "learning machine", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(score.has(F.col("t"), term).alias("a"), F.col("t").rlike(text.term_pattern(term)).alias("b")).collect() if term != "c++" else []
    assert all(r.a == r.b for r in got)
    assert "contains(" in str(score.has(F.col("t"), "spark"))


def test_texts_without_a_cue_are_not_searched_for_what_is_taken_back(spark):
    texts = ["not interested in go. x", "no interest in go but y", "this role does not involve go", "this role doesn t involve go. z", "we won t be hiring for go", "this is not an go", "nothing", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(score.live(F.col("t")).alias("a"), F.regexp_replace("t", score.TAKEN_BACK, " ").alias("b")).collect()
    assert all(r.a == r.b for r in got) and score.CUES


def test_heavy_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.range(4000).repartition(1).withColumn("text", F.repeat(F.lit("x"), 500)).write.parquet(f"{tmp_path}/t.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        parts = spread(spark.read.parquet(f"{tmp_path}/t.parquet")).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts > 4


def test_suffixes_are_looked_up_for_domains_not_for_messages(spark):
    rows = [("a", "inbound", "Mail.C1.example ", None), ("b", "inbound", "jobs.lever.co", None), ("c", "inbound", None, None), ("d", "outbound", "x", ["c1.example", "mail.c1.example", None, ""]), ("e", "outbound", "x", ["c1.example", "c2.example"]),
            ("f", "outbound", "x", None), ("g", "inbound", "xlever.co", None), ("h", "inbound", "", None), ("i", "outbound", "x", [None, "lever.co"])]
    mail = spark.createDataFrame(rows, "message_key string, direction string, sender_domain string, recipient_domains array<string>")
    domains = spark.createDataFrame([("c1.example", "one"), ("c2.example", "two")], "domain string, company_key string")
    found = messages.companies_of(mail, domains)
    assert {r.message_key: r.company_key for r in found.collect()} == {"a": "one", "d": "one"}
    assert {r.message_key for r in mail.where(messages.vetoed(("lever.co",))).collect()} == {"b", "i"}
    generate = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x and "split(" in x]
    assert generate and all("message_key" not in x for x in generate)


def test_rows_of_manifests_move_once_to_their_blob_and_once_to_their_fetch(spark):
    plan = registry.queries()["retention_sweep"](spark, DATA)
    assert "collect_set" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in exchanges(plan) if "operation" in x or re.search(r"sha#\d+L?, fetch_id", x)]
