"""Edge cases and laws of the operators."""

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.functions import values as V
from siftline.operators import folds, intervals, links, select


def test_dedupe_keeps_first_of_the_greatest_at_the_place_of_the_first_member(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "a", 9), (4, "b", 1), (5, None, 2)], "ord int, k string, score int")
    rows = {r.k: (r.ord, r.position) for r in select.dedupe(df, ["k"], "score", "ord").collect()}
    assert rows == {"a": (2, 1), "b": (4, 4), None: (5, 5)}


def test_funnel_sums_to_its_input(spark):
    df = spark.createDataFrame([(None,), (1,), (20,)], "x int")
    at = df.withColumn("disposition", select.disposition([("null", F.col("x").isNotNull()), ("small", F.col("x") > 10)]))
    rows = {r.disposition: r.n for r in select.funnel(at, ["null", "small", "other", "kept"]).collect()}
    assert rows == {"null": 1, "small": 1, "other": 0, "kept": 1, "total": 3}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, s long, e long, id int")
    assert intervals.merged(empty, ["k"], "s", "e").count() == 0
    assert intervals.conflicts(empty, ["k"], "id", "s", "e", 10).count() == 0
    assert folds.last_wins(empty, ["k"], ["s"], F.lit(False)).count() == 0


def test_incremental_fold_with_late_rows_equals_the_whole(spark):
    rows = [(k, t, f"f{(k * t) % 3}", i) for i, (k, t) in enumerate((k, t) for k in range(5) for t in range(6))]
    df = spark.createDataFrame(rows, "k int, t int, fact string, id int")
    fold = lambda x: folds.entity_index(x, "k", ["t", "id"], ["fact"], "t", "id")
    delta = df.where("t in (0, 3) and k < 3")
    log = df.where("not (t in (0, 3) and k < 3)")
    assert sorted(folds.incremental(fold(log), log, delta, "k", fold).collect()) == sorted(fold(df).collect())


def test_null_rules_of_predicates(spark):
    df = spark.createDataFrame([(None, None), (None, 5.0), (3.0, None)], "lo double, hi double")
    lo, hi = F.col("lo"), F.col("hi")
    assert [r[0] for r in df.select(V.overlaps(lo, hi, 4, 6)).collect()] == [False, True, True]
    assert [r[0] for r in df.select(V.meets_floor(lo, hi, 4)).collect()] == [None, True, False]
    assert [r[0] for r in df.select(V.under_cap(lo, 2)).collect()] == [True, True, False]


def test_parse_time(spark):
    given = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "1704164645", "1704164645000", "Tue, 2 Jan 2024 03:04:05 +0000", "nonsense", None]
    df = spark.createDataFrame([(x,) for x in given], "x string")
    assert [r[0] for r in df.select(F.unix_seconds(V.parse_time(F.col("x")))).collect()] == [1704164645] * 5 + [None, None]


def test_urls(spark):
    df = spark.createDataFrame([("HTTPS://A.com/x/?b=2&a=1&utm_source=q&a=1#f",), ("https://a.com/jobs/",), ("https://a.com/jobs/17",)], "u string")
    rows = df.select(T.canonical_url(F.col("u"), distinct=True), T.is_listing_url(F.col("u"))).collect()
    # an identity keeps repeated pairs; an audit of coverage asks for distinct ones
    assert df.select(T.canonical_url(F.col("u"))).first()[0] == "https://a.com/x?a=1&a=1&b=2"
    assert [tuple(r) for r in rows] == [("https://a.com/x?a=1&b=2", False), ("https://a.com/jobs", True), ("https://a.com/jobs/17", False)]


def test_ambiguous_alias_abstains(spark):
    names = spark.createDataFrame([("acme",), ("x",)], "n string")
    aliases = spark.createDataFrame([("acme", "A"), ("acme", "B"), ("x", "C")], "alias string, canonical string")
    assert {r.n: r.canonical for r in links.resolve_alias(names, F.col("n"), aliases).collect()} == {"acme": None, "x": "C"}


def test_legal_suffix_never_empties(spark):
    df = spark.createDataFrame([("Acme, Inc.",), ("Inc",), ("Foo Co. Ltd",)], "n string")
    assert [r[0] for r in df.select(T.strip_legal_suffix(F.col("n"))).collect()] == ["acme", "inc", "foo"]


def test_torn_tail_and_damaged_lines(spark, tmp_path):
    from siftline.sources import jsonl

    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": 2}\n{"k": 3')
    (tmp_path / "b.jsonl").write_text('{"k": 4}\nnot json\n{"k": 5}\n')
    rows, damaged = jsonl.read(spark, f"file://{tmp_path}/*.jsonl", "k int")
    assert sorted(r.k for r in rows.collect()) == [1, 2, 4, 5]
    assert [r.line for r in damaged.collect()] == ["not json"]


def test_url_identity(spark):
    rows = [("a.com/role/7",), ("b.com/role/7",), ("https://User@A.com:8080/x/?GH_SRC=1&q=a b&Ref=2&z",), ("",), ("https://a.com/",)]
    df = spark.createDataFrame(rows, "u string")
    got = [r[0] for r in df.select(T.canonical_url(F.col("u"))).collect()]
    assert got == ["https://a.com/role/7", "https://b.com/role/7", "https://a.com:8080/x?q=a+b&z=", "", "https://a.com/"]
    keyed = spark.createDataFrame([("greenhouse", "123", "u", ""), ("workday", "R 1", "", "Acme Inc"), ("remoteok", "", "https://r.com/remote-jobs/", "Acme"), ("other", "9", "https://r.com/x/1", "Acme")], "s string, n string, u string, c string")
    keys = [r[0] for r in keyed.select(T.identity_key(F.col("u"), F.lit("Title"), F.col("c"), F.lit("Rome"), F.col("s"), F.col("n"))).collect()]
    assert keys[:2] == ["gh-123", "wd-acme-inc-r-1"] and keys[2].startswith("ck-") and keys[3].startswith("url-")


def test_fold_goes_on_after_a_restart(spark, tmp_path):
    from siftline.plans.queries import index_of
    from siftline.streaming.fold import FoldedLog

    at = spark.createDataFrame([(1, 7, "view", 1.0, 50), (2, 7, "click", 2.0, 90), (3, 8, "view", 1.0, 60), (4, 7, "error", 3.0, 10)], "event_id long, user_id long, event_type string, value double, t long")
    folder = f"file://{tmp_path}/log"
    FoldedLog(spark, folder, "user_id", index_of).take(at.where("event_id <= 3"), 0)
    again = FoldedLog(spark, folder, "user_id", index_of)
    again.take(at.where("event_id = 4"), 1)  # late
    again.take(at.where("event_id = 4"), 1)  # and once more
    assert sorted(map(str, again.entities().collect())) == sorted(map(str, index_of(at).collect()))


def test_long_lines_of_parents_are_no_circle(spark):
    from siftline.plans.rules import ancestry

    rows = [(0, None)] + [(k, k - 1) for k in range(1, 100)] + [(200, 201), (201, 202), (202, 200), (300, 200), (400, None)]
    got = {r.id: (r.root, r.depth, r.cyclic) for r in ancestry(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert all(got[k] == (0, k, False) for k in range(100)) and got[400] == (400, 0, False)
    assert all(got[k] == (None, None, True) for k in (200, 201, 202, 300))


def test_unknown_flags_are_errors(spark):
    import pytest

    from siftline.operators import select

    with pytest.raises(ValueError, match="salaries"):
        select.matching({"salaries": 5})
