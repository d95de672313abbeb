"""Queries that read all of their tables."""

from siftline import registry


def tables(spark, at, lines, parts):
    spark.createDataFrame(lines, "l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{at}/part.parquet")
    return str(at)


LINES = [(1, 1, 50.0, 500.0, "A", "F"), (1, 2, 10.0, 100.0, "A", "F"), (1, 3, 10.0, 100.0, "N", "O"), (2, 1, 10.0, 70.0, "A", "F"), (9, 1, 1.0, 1.0, "N", "O")]
PARTS = [(1, 3, 10.0), (2, 9, 8.0), (3, 1, 1.0)]


def test_every_reference_counts(spark, tmp_path):
    at = registry.queries()["ref_count_orphans"](spark, tables(spark, tmp_path, LINES, PARTS))
    assert sorted(map(tuple, at.select("p_partkey", "refs", "live", "orphan").collect())) == [(1, 3, 1, False), (2, 1, 0, True), (3, 0, 0, True)]


def test_every_line_is_compared_with_its_part(spark, tmp_path):
    at = registry.queries()["field_fidelity"](spark, tables(spark, tmp_path, LINES, PARTS))
    assert sorted(map(tuple, at.select("l_returnflag", "l_linestatus", "n", "same", "missing").collect())) == [("A", "F", 3, 2, 0), ("N", "O", 2, 1, 1)]
